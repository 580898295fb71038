"""Queries on identities, extraction, classification and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corploom.functions import text as T
from corploom.operators import classify as C
from corploom.operators import extract as X
from corploom.operators import identity as I
from corploom.operators import lines as L
from corploom.operators import project as P
from corploom.plans.registry import register
from corploom.rules import LINE_PATTERNS, TAXONOMY, sql_values
from corploom.sources.tables import table

KEY = b"corploom test key"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _pages(spark, d):
    return table(spark, d, "pages")


@register("fingerprint", "SELECT doc_id, sha256(text) AS raw_sha256, sha256(trim(text, ' ' || chr(9))) AS clean_sha256 FROM documents")
def fingerprint(spark, d):
    return _docs(spark, d).select("doc_id", T.sha256(F.col("text")).alias("raw_sha256"), T.sha256(T.trim_blanks(F.col("text"))).alias("clean_sha256"))


def _pad(x):
    return "".join(f"\\x{b ^ x:02X}" for b in KEY.ljust(64, b"\0"))


@register("keyed_id", f"SELECT page_id, 'src_' || substr(sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || 'url\\x00'::BLOB || encode(url)))), 1, 32) AS id FROM pages")
def keyed_id(spark, d):
    return _pages(spark, d).select("page_id", T.keyed_id("url", F.col("url"), KEY).alias("id"))


@register("id_collisions", "SELECT substr(sha256(url), 1, 2) AS id, count(DISTINCT sha256(url)) AS n_locators FROM pages GROUP BY 1 HAVING count(DISTINCT sha256(url)) > 1")
def id_collisions(spark, d):
    h = T.sha256(F.col("url"))
    return I.id_collisions(_pages(spark, d).select(F.substring(h, 1, 2).alias("id"), h.alias("locator")), "id", "locator")


MESSY = "upper(substr(url, 1, 5)) || substr(url, 6)"
PORT = "regexp_replace(" + MESSY + r", '(example\.[a-z]+)', '\1:443')"


@register("canonical_url", rf"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN {MESSY} WHEN 2 THEN {PORT} ELSE 'ftp://x' END AS url FROM pages),
    p AS (SELECT *, regexp_extract(url, '^([A-Za-z]+)://([^/?#:@]+)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$', ['s', 'h', 'p', 'path', 'q']) AS m FROM u)
    SELECT page_id, CASE WHEN lower(m.s) IN ('http', 'https') THEN lower(m.s) || '://' || lower(m.h) || CASE WHEN m.p = '' OR m.p = (CASE WHEN lower(m.s) = 'http' THEN '80' ELSE '443' END) THEN '' ELSE ':' || m.p END || CASE WHEN m.path = '' THEN '/' ELSE m.path END || m.q END AS url FROM p""")
def canonical_url(spark, d):
    n, url = F.col("page_id") % 4, F.col("url")
    messy = F.concat(F.upper(F.substring(url, 1, 5)), F.substring(url, 6, 9999))
    port = F.regexp_replace(messy, r"(example\.[a-z]+)", "$1:443")
    u = F.when(n == 0, url).when(n == 1, messy).when(n == 2, port).otherwise("ftp://x")
    return _pages(spark, d).select("page_id", T.canonical_url(u).alias("url"))


@register("url_policy", r"SELECT page_id, regexp_matches(url, '^https://m\.[a-z]+\.example\.net/') AND contains(url, '://m.ththth.example.net/') AS allowed FROM pages")
def url_policy(spark, d):
    return _pages(spark, d).select("page_id", T.url_allowed(F.col("url"), "https", "m.ththth.example.net").alias("allowed"))


@register("fixed_header", """SELECT doc_id, 'Title ' || doc_id AS title, CASE WHEN doc_id % 3 <> 0 THEN 'original' END AS status, CASE WHEN doc_id % 3 <> 0 THEN 'a' || doc_id END AS author,
    CASE WHEN doc_id % 3 <> 0 THEN '2024-01-02 03:04' END AS published_at, CASE WHEN doc_id % 3 <> 0 THEN lang END AS location, CASE WHEN doc_id % 5 <> 0 THEN 'https://h/' || doc_id END AS source_url FROM documents""")
def fixed_header(spark, d):
    n = F.col("doc_id").cast("string")
    meta = F.concat(F.lit("original a"), n, F.lit(" 2024-01-02 "), F.when(F.col("doc_id") % 3 != 0, "03:04").otherwise("3h"), F.lit(" "), F.col("lang"))
    link = F.concat(F.lit("> from: [https://h/"), n, F.lit("](https://h/"), n, F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""), F.lit(")"))
    text = F.concat(F.lit("     t css\n\nTitle "), n, F.lit("\n====\n\n"), meta, F.lit("\n\n"), link, F.lit("\n"), F.col("text"))
    return I.parse_fixed_header(table(spark, d, "documents").select("doc_id", text.alias("text")))


@register("loose_header", """SELECT doc_id, 'Title ' || doc_id AS title, CASE WHEN doc_id % 3 <> 1 THEN 'a' END AS author, CASE WHEN doc_id % 3 <> 1 THEN 'original' END AS status, CASE WHEN doc_id % 3 <> 1 THEN '2024 May' END AS published_at,
    CASE WHEN doc_id % 3 <> 1 THEN lang END AS location, CASE WHEN doc_id % 4 <> 0 THEN 'https://example.com/' || doc_id END AS source_url, CASE WHEN doc_id % 3 = 1 OR doc_id % 4 = 0 THEN 'needs_review' ELSE 'parsed' END AS review FROM documents""")
def loose_header(spark, d):
    n = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## Title "), n)).otherwise(F.concat(F.lit("Title "), n, F.lit("\n=====")))
    bars = F.when(F.col("doc_id") % 3 != 1, F.concat(F.lit("a｜original｜2024 May | "), F.col("lang"))).otherwise("no bars")
    link = F.concat(F.lit("[x](https://"), F.when(F.col("doc_id") % 4 == 0, "other.org/").otherwise("example.com/"), n, F.lit("#top)"))
    return I.parse_loose_header(table(spark, d, "documents").select("doc_id", F.concat_ws("\n", title, bars, link).alias("text")))


@register("images", "SELECT doc_id, i AS ordinal, 'alt ' || i AS alt, 'https://h/' || doc_id || '/' || i AS url FROM documents, range(1, 4) r(i) WHERE i <= doc_id % 4")
def images(spark, d):
    one = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= F.col("doc_id") % 4), lambda i: F.concat(F.lit("![alt "), i.cast("string"), F.lit("](https://h/"), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string"), F.lit(' "t")')))
    x = I.extract_images(_docs(spark, d).select("doc_id", F.concat(F.lit("x "), F.array_join(one, " and "), F.lit("\nend")).alias("text")))
    return x.withColumn("ordinal", F.col("ordinal").cast("long"))


@register("slug", "SELECT p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 14), '-+$', '') AS slug FROM part")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand"), most=14).alias("slug"))


@register("sniff_title", r"SELECT doc_id, coalesce(list_filter(list_transform(h, lambda x: regexp_extract(x, '^#+[ \t]*(.+)', 1)), lambda x: x <> '')[1], list_filter(h, lambda x: length(x) > 5 AND NOT regexp_matches(x, '^[=*-]'))[1]) AS title FROM (SELECT doc_id, list_transform(string_split(text, chr(10))[1:8], lambda x: trim(x)) AS h FROM documents)")
def sniff_title(spark, d):
    return _docs(spark, d).select("doc_id", I.sniff_title(F.col("text")).alias("title"))


@register("asset_ids", "SELECT page_id, 'asset_' || substr(sha256(page_id || '#' || 1), 1, 24) AS asset_id FROM pages")
def asset_ids(spark, d):
    return _pages(spark, d).select("page_id", I.asset_id(F.col("page_id").cast("string"), F.lit(1)).alias("asset_id"))


@register("content_mode", r"SELECT page_id, CASE WHEN len(regexp_extract_all(h, '<img')) = 0 THEN 'text' WHEN length(regexp_replace(h, '<[^>]+>|\s+', '', 'g')) <= 100 THEN 'image_dominant' ELSE 'mixed' END AS mode FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '<img src=x>' || html ELSE '<img src=x><p>caption</p>' END AS h FROM pages)")
def content_mode(spark, d):
    h = F.when(F.col("page_id") % 3 == 0, F.col("html")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<img src=x>"), "html")).otherwise("<img src=x><p>caption</p>")
    return _pages(spark, d).select("page_id", I.content_mode(h).alias("mode"))


# -- extraction: sentences of documents stand for bullets and numbered items --

ITEMS = r"array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> ''), lambda x, i: i || '. ' || CASE WHEN i % 2 = 0 THEN substr(x, 1, 4) || ': ' || x ELSE x END), chr(10))"


def _items(spark, d):
    one = F.transform(X.sentences(F.col("text")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(i % 2 == 1, F.concat(F.substring(x, 1, 4), F.lit(": "), x)).otherwise(x)))
    return _docs(spark, d).select("doc_id", F.array_join(one, "\n").alias("text"))


@register("split_sections", r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\n') AS a, regexp_split_to_array(text, 'The ') AS b FROM documents),
    c AS (SELECT doc_id, CASE WHEN len(a) >= 3 THEN a WHEN len(b) >= 3 THEN b ELSE a END AS p FROM s)
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS section, sha256(p[i]) AS section_sha256 FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM c) WHERE length(p[i]) >= 80""")
def split_sections(spark, d):
    x = X.split_sections(_docs(spark, d), "\n", "The ")
    return x.select("doc_id", F.col("section").cast("long"), T.sha256(F.col("text")).alias("section_sha256"))


@register("extract_name", r"""WITH h AS (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM (SELECT doc_id, 'Part 3: ' || substr(text, 1, 3) || CASE WHEN doc_id % 2 = 0 THEN ': ' ELSE ' (x) ' END || text AS text FROM documents)),
    n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(l, '^(?:Part|Chapter) [0-9]+[:.] *', ''), '[\[(].*?[\])]', '', 'g')) AS n FROM h)
    SELECT doc_id, trim(CASE WHEN instr(n, ':') > 3 THEN substr(n, 1, least(instr(n, ':') - 1, 15)) ELSE substr(n, 1, 15) END) AS name FROM n""")
def extract_name(spark, d):
    text = F.concat(F.lit("Part 3: "), F.substring("text", 1, 3), F.when(F.col("doc_id") % 2 == 0, ": ").otherwise(" (x) "), F.col("text"))
    return _docs(spark, d).select("doc_id", X.extract_name(text).alias("name"))


@register("extract_definition", "SELECT doc_id, coalesce(nullif(regexp_extract(text, 'that ([a-z]+ is [a-z ]+)', 1), ''), nullif(regexp_extract(text, '((?:is|est|ist|es) [a-z ]{12,60})', 1), ''), substr(text, 1, 120)) AS definition FROM documents")
def extract_definition(spark, d):
    return _docs(spark, d).select("doc_id", X.extract_definition(F.col("text"), [("that ([a-z]+ is [a-z ]+)", 1), ("((?:is|est|ist|es) [a-z ]{12,60})", 1)]).alias("definition"))


@register("first_sentence", r"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 12 AND 150)[1] AS sentence FROM documents")
def first_sentence(spark, d):
    return _docs(spark, d).select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@register("extract_bullets", rf"""WITH t AS (SELECT doc_id, 'Steps' || chr(10) || {ITEMS} AS text FROM documents),
    i AS (SELECT doc_id, list_filter(regexp_extract_all(text, '(?m)^[0-9]+[.] (.+)$', 1), lambda x: length(x) BETWEEN 10 AND 60 AND NOT regexp_matches(x, 'tion')) AS i FROM t)
    SELECT doc_id, array_to_string(i[1:3], '|') AS bullets FROM i""")
def extract_bullets(spark, d):
    b = X.extract_bullets(F.concat(F.lit("Steps\n"), F.col("text")), "Steps", r"[0-9]+[.] ", 10, 60, "tion", 3)
    return _items(spark, d).select("doc_id", F.array_join(b, "|").alias("bullets"))


@register("extract_steps", rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all({ITEMS}, '(?m)^[ \t]*[0-9]+[.)][ \t]*(.+)$', 1), lambda x: NOT contains(x, 'http')) AS i FROM documents),
    p AS (SELECT doc_id, i, list_transform(i, lambda x: trim(CASE WHEN instr(x, ':') BETWEEN 2 AND 10 THEN split_part(x, ':', 1) ELSE substr(x, 1, 10) END)) AS n FROM t),
    f AS (SELECT doc_id, len(i) AS c, list_filter(n, lambda x, k: k = 1 OR n[k - 1] <> x)[1:5] AS n FROM p)
    SELECT doc_id, CASE WHEN c >= 2 THEN len(n) ELSE 0 END AS n_steps, CASE WHEN c >= 2 THEN array_to_string(n, '|') ELSE '' END AS names FROM f""")
def extract_steps(spark, d):
    s = X.extract_steps(F.col("text"))
    return _items(spark, d).select("doc_id", F.size(s).cast("long").alias("n_steps"), F.array_join(F.transform(s, lambda x: x["name"]), "|").alias("names"))


VERBS = "(^| )(is|was|are|ist|est)( |$)"
#: Items without numbers, so that every strategy has its turn: numbered, with a colon, with a verb.
MIXED = f"(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {ITEMS} WHEN 1 THEN regexp_replace({ITEMS}, '(?m)^[0-9]+[.] ', '', 'g') ELSE text END AS text FROM documents)"


@register("mine_steps", rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '(?m)^[ \t]*[0-9]+[.)][ \t]*(.+)$', 1) AS n, regexp_extract_all(text, '(?m)^([^:\n]{{2,12}}: .+)$', 1) AS c,
        list_filter(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_matches(x, '{VERBS}')) AS v FROM {MIXED}),
    b AS (SELECT doc_id, v, CASE WHEN len(n) >= 3 THEN n ELSE list_concat(n, c) END AS f FROM a),
    e AS (SELECT doc_id, list_filter(CASE WHEN len(f) >= 2 THEN f ELSE list_concat(f, v) END, lambda x: length(x) >= 12 AND NOT contains(x, 'http')) AS f FROM b),
    u AS (SELECT doc_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS f FROM e)
    SELECT doc_id, array_to_string(list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: substr(y, 1, 15)), substr(x, 1, 15)) = i)[1:6], '|') AS steps FROM u""")
def mine_steps(spark, d):
    n = F.col("doc_id") % 3
    texts = _docs(spark, d).join(_items(spark, d).withColumnRenamed("text", "items"), "doc_id")
    mixed = texts.select("doc_id", F.when(n == 0, F.col("items")).when(n == 1, F.regexp_replace("items", r"(?m)^[0-9]+[.] ", "")).otherwise(F.col("text")).alias("text"))
    return mixed.select("doc_id", F.array_join(X.mine_steps(F.col("text"), VERBS), "|").alias("steps"))


@register("bullets_or_sentences", r"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '(?m)^- (.+)$', 1), lambda x: length(x) BETWEEN 10 AND 60 AND NOT contains(x, 'tion'))[1:3] AS a,
        list_filter(list_transform(regexp_extract_all(text, '(?:with|der|que) [^.\n]{10,40}'), lambda x: trim(x)), lambda x: length(x) BETWEEN 10 AND 60 AND NOT contains(x, 'tion'))[1:3] AS b,
        list_filter(list_transform(regexp_extract_all(text, '[A-Z][^.\n]{9,50}'), lambda x: trim(x)), lambda x: length(x) BETWEEN 10 AND 60 AND NOT contains(x, 'tion'))[1:3] AS c FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END, '|') AS bullets FROM s""")
def bullets_or_sentences(spark, d):
    """Texts without bullets behind the anchor, so that the fallbacks have their turn."""
    found = X.extract_bullets(F.col("text"), "No such anchor", "- ", 10, 60, "tion", 3, ["(?:with|der|que) [^.\\n]{10,40}", "[A-Z][^.\\n]{9,50}"])
    return _docs(spark, d).select("doc_id", F.array_join(found, "|").alias("bullets"))


@register("steps_anywhere", rf"""WITH t AS (SELECT doc_id, regexp_extract_all({ITEMS}, '(?m)^[ \t]*[0-9]+[.)][ \t]*(.{{15,}})$', 1) AS i FROM documents),
    f AS (SELECT doc_id, len(i) AS c, list_filter(i, lambda x, k: list_position(i, x) = k)[1:7] AS i FROM t)
    SELECT doc_id, CASE WHEN c >= 3 THEN array_to_string(list_transform(i, lambda x: trim(substr(x, 1, 25))), '|') ELSE '' END AS names FROM f""")
def steps_anywhere(spark, d):
    """Texts without the anchor, so that numbered items anywhere are the steps."""
    s = X.extract_steps(F.col("text"), anchor="No such anchor")
    return _items(spark, d).select("doc_id", F.array_join(F.transform(s, lambda x: x["name"]), "|").alias("names"))


NAMED = "'Chapter ' || (doc_id % 9) || ': The ' || lang || ' way' || chr(10) || (doc_id % 5) || '. First ' || source || chr(10) || 'Step 2: Look at ' || lang || chr(10) || 'See **Bold ' || source || '** and the ' || lang || ' effect, the ' || source || ' law.'"


@register("candidate_names", "SELECT doc_id, t AS type, n AS name FROM (SELECT doc_id, unnest([{'t': 'heading', 'n': 'The ' || lang || ' way'}, {'t': 'heading', 'n': 'First ' || source}, {'t': 'heading', 'n': 'Look at ' || lang}, {'t': 'bold', 'n': 'Bold ' || source}, {'t': 'suffix', 'n': 'e **Bold ' || source || '** and the ' || lang || ' effect'}, {'t': 'suffix', 'n': 'the ' || source || ' law'}], recursive := true) FROM documents) WHERE length(n) BETWEEN 3 AND 40 AND t <> 'suffix'")
def candidate_names(spark, d):
    """All pattern families on texts in which each has its match; of the suffixes, whose names reach back twenty letters, a test has the cases."""
    n = F.col("doc_id")
    text = F.concat(F.lit("Chapter "), n % 9, F.lit(": The "), "lang", F.lit(" way\n"), n % 5, F.lit(". First "), "source", F.lit("\nStep 2: Look at "), "lang", F.lit("\nSee **Bold "), "source", F.lit("** and the "), "lang", F.lit(" effect, the "), "source", F.lit(" law."))
    found = X.candidates(table(spark, d, "documents").select("doc_id", text.alias("text")), X.name_patterns(), [])
    return found.where("type <> 'suffix'")


@register("first_url", "SELECT page_id, nullif(regexp_extract(html, 'https?://[^\\s\"'')>]+'), '') AS url FROM pages")
def first_url(spark, d):
    return _pages(spark, d).select("page_id", I.first_url(F.col("html")).alias("url"))


@register("html_escape", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')) AS escaped_sha256 FROM pages")
def html_escape(spark, d):
    return _pages(spark, d).select("page_id", T.sha256(T.html_escape(F.col("html"))).alias("escaped_sha256"))


@register("dotted_url", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://h.org/a/c%20d?q=' || page_id WHEN 1 THEN 'https://h.org/x/' WHEN 2 THEN 'http://[::1]:81/%C3%A9' END AS url FROM pages")
def dotted_url(spark, d):
    n = F.col("page_id")
    u = F.when(n % 4 == 0, F.concat(F.lit("HTTPS://H.org:443/a/./b/../c d?q="), n, F.lit("#f"))).when(n % 4 == 1, "https://h.org/../x/y/%2E%2e").when(n % 4 == 2, "http://[::1]:81/é").otherwise("https://u:p@h.org/")
    return _pages(spark, d).select("page_id", T.canonical_url(u).alias("url"))


@register("prefix_dedup", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
    u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s), f AS (SELECT doc_id, min_by(x, i) AS x, min(i) AS i FROM u GROUP BY doc_id, substr(x, 1, 5))
    SELECT doc_id, sha256(string_agg(x, '|' ORDER BY i)) AS kept_sha256 FROM f GROUP BY doc_id""")
def prefix_dedup(spark, d):
    return _docs(spark, d).where(F.size(X.sentences(F.col("text"))) > 0).select("doc_id", T.sha256(F.array_join(X.prefix_dedup(X.sentences(F.col("text")), 5), "|")).alias("kept_sha256"))


@register("extract_examples", r"SELECT doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i)[1:3], '|') AS examples FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s) with(.{10,80})', 1), lambda x: trim(regexp_replace(x, '\n+', ' ', 'g'))) AS x FROM documents)")
def extract_examples(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.extract_examples(F.col("text"), " with"), "|").alias("examples"))


@register("extract_tags", r"SELECT doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i)[1:7], ' ') AS tags FROM (SELECT doc_id, regexp_extract_all(replace(text, ' th', ' #th'), '#([\p{L}0-9_]{2,14})', 1) AS x FROM documents)")
def extract_tags(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(X.extract_tags(F.replace("text", F.lit(" th"), F.lit(" #th"))), " ").alias("tags"))


KWIC = [("tionan",), ("heiter",), ("moron",), ("token =",)]


@register("kwic", f"SELECT *, array_to_string(list_filter(list_transform(regexp_split_to_array(context, '[.!?\\n]+'), lambda x: trim(x)), lambda x: length(x) > 10), '|') AS sentences FROM (SELECT doc_id, term, substr(text, greatest(instr(text, term) - 60, 1), least(instr(text, term), 61) + length(term) + 59) AS context FROM documents, (VALUES {sql_values(KWIC)}) t(term) WHERE contains(text, term))")
def kwic(spark, d):
    x = X.kwic(_docs(spark, d), spark.createDataFrame(KWIC, "term string"))
    return x.withColumn("sentences", F.array_join("sentences", "|"))


@register("mechanism_paragraph", r"SELECT doc_id, coalesce(list_filter(f, lambda x: regexp_matches(x, 'for|que|der'))[1], f[1], p[1]) AS paragraph FROM (SELECT doc_id, p, list_filter(p, lambda x: length(x) BETWEEN 60 AND 200) AS f FROM (SELECT doc_id, regexp_split_to_array(text, '\n+') AS p FROM documents))")
def mechanism_paragraph(spark, d):
    return _docs(spark, d).select("doc_id", X.mechanism_paragraph(F.col("text"), "for|que|der", 60, 200).alias("paragraph"))


PATTERNS = [("heading", r"(?m)^([A-Z][a-z]+ [a-z]+) the", 1), ("suffix", r"\b([a-z]{3,9}tion)\b", 1)]


@register("candidates", r"""SELECT doc_id, 'heading' AS type, trim(unnest(regexp_extract_all(text, '(?m)^([A-Z][a-z]+ [a-z]+) the', 1))) AS name FROM documents
    UNION ALL SELECT doc_id, 'suffix', trim(unnest(regexp_extract_all(text, '\b([a-z]{3,9}tion)\b', 1))) FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '#', 'g') AS text FROM documents)
    UNION ALL SELECT doc_id, 'known', k FROM documents, (VALUES ('moron'), ('thing')) t(k) WHERE contains(text, k)""")
def candidates(spark, d):
    ascii_ = _docs(spark, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "#"))
    found = X.candidates(_docs(spark, d), PATTERNS[:1], ["moron", "thing"])
    return found.unionByName(X.candidates(ascii_, PATTERNS[1:], ["no such name"]))


# -- classification and scores ----------------------------------------------

HEAD = "lower(substr(text, 1, 800))"


def _chapter_sql(titles, tags):
    return " + ".join([f"CASE WHEN contains(h, '{x}') THEN 3 ELSE 0 END" for x in titles] + [f"CASE WHEN contains(h, '{x}') THEN 1 ELSE 0 END" for x in tags])


CLASSIFY_SQL = f"""classes AS (SELECT doc_id, CASE WHEN max(s) > 0 THEN arg_max(c, s * 1000 - p) ELSE '00' END AS chapter FROM (
    SELECT doc_id, unnest([{', '.join(f"struct_pack(c := '{c}', p := {p}, s := {_chapter_sql(t, g)})" for c, p, t, g in TAXONOMY)}], recursive := true) FROM (SELECT doc_id, {HEAD} AS h FROM documents)) GROUP BY doc_id)"""


@register("classify_documents", f"WITH {CLASSIFY_SQL} SELECT * FROM classes")
def classify_documents(spark, d):
    return _docs(spark, d).select("doc_id", C.classify(F.col("text"), TAXONOMY).alias("chapter"))


@register("chapter_counts", f"WITH {CLASSIFY_SQL} SELECT chapter, count(*) AS n FROM classes GROUP BY chapter")
def chapter_counts(spark, d):
    return classify_documents(spark, d).groupBy("chapter").agg(F.count("*").alias("n"))


@register("curate_documents", rf"""WITH cut AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{"|".join(f"(?:{p})" for p in LINE_PATTERNS)}')) AS l FROM documents),
    joined AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(array_to_string(l, chr(10)), ''), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS text FROM cut),
    documents AS (SELECT * FROM joined WHERE length(text) >= 120), {CLASSIFY_SQL}
    SELECT chapter, count(*) AS n, round(avg(length(text)), 1) AS mean_chars, count(*) FILTER (length(text) >= 1000) AS n_long FROM documents JOIN classes USING (doc_id) GROUP BY chapter""")
def curate_documents(spark, d):
    """Boilerplate lines go, short documents go, the rest is classified and summed up by chapter; one shuffle, of the sums."""
    clean = L.strip_documents(_docs(spark, d), LINE_PATTERNS)
    kept = L.doc_gate(clean, 120).withColumn("chapter", C.classify(F.col("text"), TAXONOMY))
    n = F.length("text")
    return kept.groupBy("chapter").agg(F.count("*").alias("n"), F.round(F.avg(n), 1).alias("mean_chars"), F.count_if(n >= 1000).alias("n_long"))


@register("completeness_score", "SELECT doc_id, least(5, CASE WHEN length(text) > 1000 THEN 2 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN contains(text, ',') THEN 2 ELSE 0 END) AS score FROM documents")
def completeness_score(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", C.score([(F.length(t) > 1000, 2), (F.contains(t, F.lit("\n")), 1), (F.rlike(t, F.lit("[0-9]")), 1), (F.contains(t, F.lit(",")), 2)], 5).alias("score"))


PROMPT_SQL = "SELECT conv_id, turn, text, split_part(text, ' ', 1) AS name FROM conversations WHERE role = 'assistant'"


def _prompts(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text", F.substring_index("text", " ", 1).alias("name"))


@register("is_shell", f"SELECT conv_id, turn, length(text) < 100 OR length(CASE WHEN name = '' THEN text ELSE replace(text, name, '') END) < 40 OR NOT regexp_matches(text, ' the | der | la ') AS shell FROM ({PROMPT_SQL})")
def is_shell(spark, d):
    return _prompts(spark, d).select("conv_id", "turn", C.is_shell(F.col("text"), F.col("name"), " the | der | la ").alias("shell"))


@register("is_generic", "SELECT conv_id, turn, conv_id % 3 <> 2 AS generic FROM conversations WHERE role = 'assistant' AND trim(text) NOT IN ('', 'do it well')")
def is_generic(spark, d):
    n = F.col("conv_id") % 3
    prompt = F.when(n == 0, F.col("text")).when(n == 1, F.concat(F.lit("[protocol] do it well [gate] "), "text")).otherwise(F.concat(F.lit("x [protocol] "), "text"))
    return _prompts(spark, d).where(~F.trim("text").isin("", "do it well")).select("conv_id", "turn", C.is_generic(prompt, "protocol", ["do it well"]).alias("generic"))


LAYERED = "CASE WHEN conv_id % 2 = 0 THEN '[mode] [protocol] [gate] [format] ' ELSE '' END || text"


@register("fidelity", rf"""WITH p AS (SELECT conv_id, turn, name, {LAYERED} AS t FROM ({PROMPT_SQL})),
    b AS (SELECT *, CASE WHEN name = '' THEN t ELSE regexp_replace(replace(t, name, chr(1)), '\x01[^.\n]*', '', 'g') END AS bare, CASE WHEN name = '' THEN 0 ELSE (length(t) - length(replace(t, name, ''))) / length(name) END AS times FROM p),
    r AS (SELECT *, regexp_matches(bare, ' the | der | la ') AS r1, regexp_matches(bare, ' of | und | de ') AS r2, times <= 3 AS r3, contains(t, '[mode]') AND contains(t, '[protocol]') AND contains(t, '[gate]') AND contains(t, '[format]') AS r4 FROM b)
    SELECT conv_id, turn, CASE WHEN length(t) < 50 THEN 0 ELSE 10 * (CASE WHEN length(t) >= 150 THEN 2 WHEN length(t) >= 100 THEN 1 ELSE 0 END + CASE WHEN r1 THEN 3 ELSE 0 END + CASE WHEN r2 THEN 2 ELSE 0 END + CASE WHEN r3 THEN 1 ELSE 0 END + CASE WHEN r4 THEN 2 ELSE 0 END) END AS fidelity,
        CASE WHEN length(t) < 50 THEN 'short' ELSE CASE WHEN length(t) >= 150 THEN '+' WHEN length(t) >= 100 THEN '~' ELSE '-' END || 'length,' || CASE WHEN r1 THEN '+' ELSE '-' END || 'protocol,' || CASE WHEN r2 THEN '+' ELSE '-' END || 'gate,' || CASE WHEN r3 THEN '+' ELSE '-' END || 'name,' || CASE WHEN r4 THEN '+' ELSE '-' END || 'layers' END AS reasons FROM r""")
def fidelity(spark, d):
    prompt = F.concat(F.when(F.col("conv_id") % 2 == 0, "[mode] [protocol] [gate] [format] ").otherwise(""), F.col("text"))
    x = _prompts(spark, d).select("conv_id", "turn", C.fidelity(prompt, F.col("name"), " the | der | la ", " of | und | de ").alias("f"))
    return x.select("conv_id", "turn", F.col("f.value").alias("fidelity"), F.array_join("f.reasons", ",").alias("reasons"))


@register("signature_terms", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{10,12}'))), ' ') AS terms FROM documents")
def signature_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(C.signature_terms(F.col("text"), "[a-z]{10,12}"), " ").alias("terms"))


@register("upgrade_quality", "SELECT doc_id, CAST(ceil(CASE WHEN n >= 20 THEN 4 WHEN n >= 5 THEN 3 ELSE 2 END * 3 / 5.0 + 2) AS INTEGER) AS quality FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def upgrade_quality(spark, d):
    return _docs(spark, d).select("doc_id", C.quality_bands(F.size(F.split("text", "\n", -1)), 20, 5).alias("quality"))


# -- projections -------------------------------------------------------------


@register("assemble_prompt", "SELECT conv_id, sha256(string_agg('Step ' || i || ' - ' || role || ': ' || text, chr(10) || chr(10) ORDER BY i)) AS prompt_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations) GROUP BY conv_id")
def assemble_prompt(spark, d):
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("name"), x["text"].alias("action")))
    x = table(spark, d, "conversations").groupBy("conv_id").agg(steps.alias("steps"))
    return x.select("conv_id", T.sha256(P.assemble_prompt(F.col("steps"), "Answer.")).alias("prompt_sha256"))


@register("assemble_layers", "SELECT doc_id, '[name] ' || CASE WHEN trim(coalesce(source, '')) = '' THEN 'unnamed' ELSE trim(source) END || chr(10) || '[what] ' || CASE WHEN doc_id % 2 = 0 THEN 'nothing' ELSE lang END AS prompt FROM documents")
def assemble_layers(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", P.assemble_layers([("name", F.col("source"), "unnamed"), ("what", F.when(F.col("doc_id") % 2 == 1, F.col("lang")), "nothing")]).alias("prompt"))


@register("replace_layer", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'head' || chr(10) || '[protocol] a; b' || chr(10) || 'tail' WHEN 1 THEN 'x [protocol] a; b' || chr(10) || '[gate] g' END AS prompt FROM conversations WHERE role = 'assistant'")
def replace_layer(spark, d):
    n = F.col("conv_id") % 3
    prompt = F.when(n == 0, "head\ntail").otherwise("x [protocol] old text [gate] g")
    steps = F.when(n == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return _prompts(spark, d).select("conv_id", "turn", P.replace_layer(prompt, "protocol", steps).alias("prompt"))


@register("expand_domains", "SELECT p_partkey, string_agg(r_name || '=' || p_name || ' in ' || r_name, ';' ORDER BY r_name) AS scenarios FROM part, region GROUP BY p_partkey")
def expand_domains(spark, d):
    templates = table(spark, d, "region").select(F.col("r_name").alias("domain"), F.concat(F.lit("{name} in "), "r_name").alias("template"))
    x = P.expand_domains(table(spark, d, "part"), templates, "p_partkey", "p_name")
    return x.select("p_partkey", F.array_join(F.transform(F.map_entries("scenarios"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("scenarios"))


@register("coalesce_from_source", r"SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN string_split(text, chr(10))[1:2] ELSE ['a', 'b'] END, '|') AS steps FROM documents")
def coalesce_from_source(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("a"))).when(F.col("doc_id") % 2 == 1, F.array(F.lit("a"), F.lit("b"))).alias("steps"))
    mined = _docs(spark, d).select("doc_id", F.slice(F.split("text", "\n", -1), 1, 2).alias("steps"))
    return P.coalesce_from_source(rows, mined, "doc_id", "steps").select("doc_id", F.array_join("steps", "|").alias("steps"))


@register("public_projection", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS author, CASE WHEN doc_id % 3 = 0 THEN source END AS url, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS fingerprint, CASE WHEN doc_id % 3 = 0 THEN 'public' ELSE 'redacted' END AS status FROM documents WHERE doc_id % 3 <> 2")
def public_projection(spark, d):
    n = F.col("doc_id") % 3
    policy = F.when(n == 0, "public").when(n == 1, "redacted").otherwise("local_only")
    return P.public_projection(table(spark, d, "documents").select("doc_id", F.col("lang").alias("author"), F.col("source").alias("url"), T.sha256(F.col("text")).alias("fingerprint"), policy.alias("policy")))


@register("catalog_projection", "SELECT doc_id, text, lang, source, n_chars, 'sources/' || doc_id || '.json' AS path FROM documents")
def catalog_projection(spark, d):
    rows = table(spark, d, "documents").withColumns({"audit": F.lit("a"), "changes": F.array(), "warnings": F.array()})
    return P.catalog_projection(rows)


@register("summary_skeleton", "SELECT doc_id AS source_id, sha256(text) AS cleaned_sha256, 'draft' AS summary_status, CAST(0 AS INTEGER) AS n_claims FROM documents")
def summary_skeleton(spark, d):
    catalog = _docs(spark, d).select(F.col("doc_id").alias("source_id"), T.sha256(F.col("text")).alias("cleaned_sha256"))
    x = P.summary_skeleton(catalog)
    n = F.size("mechanisms") + F.when(F.col("core_question").isNotNull(), 1).otherwise(0)
    return x.select("source_id", "cleaned_sha256", "summary_status", n.alias("n_claims"))


ANSWERS = [("ring", "q1"), ("gear", "q2"), ("red", "q3")]


@register("test_question", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'q1' WHEN contains(p_name, 'gear') THEN 'q2' WHEN contains(p_name, 'red') THEN 'q3' ELSE 'q0' END AS question FROM part")
def test_question(spark, d):
    return table(spark, d, "part").select("p_partkey", P.keyed_answer(F.col("p_name"), ANSWERS, "q0").alias("question"))


@register("report_bands", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'mid' ELSE 'low' END AS band FROM part) GROUP BY band")
def report_bands(spark, d):
    return table(spark, d, "part").groupBy(P.band(F.col("p_size")).alias("band")).agg(F.count("*").alias("n"))


@register("report_rows", "SELECT p_partkey, p_size, CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'mid' ELSE 'low' END AS band, CASE WHEN p_partkey % 50 >= 40 THEN 'high' WHEN p_partkey % 50 >= 20 THEN 'mid' ELSE 'low' END AS pair_band, CASE WHEN p_size >= 40 AND p_partkey % 50 < 40 THEN 'keep' WHEN p_size < 20 THEN 'rework' ELSE 'review' END AS verdict FROM part")
def report_rows(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 50).alias("pair"))
    return P.report_rows(x, "p_partkey", "p_size", "pair")


@register("chapter_pages", """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 30 < 25 THEN CAST(o_custkey % 30 AS VARCHAR) ELSE '00' END AS chapter, o_totalprice AS score FROM orders)
    SELECT id, chapter, row_number() OVER w AS rank, lag(id) OVER w AS before, lead(id) OVER w AS after FROM o WINDOW w AS (PARTITION BY chapter ORDER BY score DESC, id)""")
def chapter_pages(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).cast("string").alias("chapter"), F.col("o_totalprice").alias("score"))
    chapters = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("chapter"))
    return P.chapter_pages(rows, chapters, "score").select("id", "chapter", F.col("rank").cast("long"), "before", "after")


@register("reshape_v3", r"""WITH b AS (SELECT doc_id, source || '_' AS name, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'How to use ' || source || '_' END AS def, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS n, text FROM documents),
    q AS (SELECT *, CASE WHEN length(def) <= 150 THEN def WHEN cut_at > 75 THEN substr(def, 1, cut_at) ELSE substr(def, 1, 150) END AS core FROM (SELECT *, greatest(
        151 - instr(reverse(substr(def, 1, 150)), '.') - CASE WHEN contains(substr(def, 1, 150), '.') THEN 0 ELSE 1501 END, 151 - instr(reverse(substr(def, 1, 150)), '!') - CASE WHEN contains(substr(def, 1, 150), '!') THEN 0 ELSE 1501 END,
        151 - instr(reverse(substr(def, 1, 150)), '?') - CASE WHEN contains(substr(def, 1, 150), '?') THEN 0 ELSE 1501 END, 151 - instr(reverse(substr(def, 1, 150)), ';') - CASE WHEN contains(substr(def, 1, 150), ';') THEN 0 ELSE 1501 END) AS cut_at FROM b))
    SELECT CAST(doc_id AS VARCHAR) AS id, name, sha256(core) AS core_sha256, CASE WHEN n = 2 THEN 'do it,then that' ELSE 'Apply ' || name END AS steps, CASE WHEN doc_id % 5 = 0 THEN 'a long enough sign' ELSE 'When ' || name || ' helps' END AS triggers,
        CASE WHEN doc_id % 4 = 0 THEN sha256(text) ELSE 'layers' END AS prompt, CAST(ceil(CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 3 END / 5.0 * 3 + 2) AS INTEGER) AS overall FROM q WHERE length(text) >= 200 AND contains(text, ' ')""")
def reshape_v3(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents").where((F.length("text") >= 200) & F.contains("text", F.lit(" ")))
    step = lambda name, action: F.struct(F.lit(name).alias("name"), F.lit(action).alias("action"), F.lit("").alias("check"))
    steps = F.when(n % 3 == 0, F.array(step("a", "do it"), step("then that", "")))
    rows = docs.select(n.alias("id"), F.concat("source", F.lit("__ (cut")).alias("name"), F.lit(None).cast("string").alias("category"), F.when(n % 2 == 0, F.col("text")).otherwise("").alias("definition"), F.when(n % 5 == 0, F.array(F.lit("short"), F.lit("a long enough sign"))).alias("triggers"), steps.alias("steps"), F.array("source").alias("stops"), F.lit(None).cast("array<string>").alias("pitfalls"), F.when(n % 4 == 0, F.col("text")).otherwise("shell").alias("prompt"), F.when(n % 7 == 0, 5).alias("quality"))
    x = P.reshape(rows, protocol=" ")
    prompt = F.col("codex_integration.system_prompt")
    return x.select("id", "meta.name", T.sha256(F.col("core_definition")).alias("core_sha256"), F.array_join(F.transform("reasoning_steps", lambda s: s["action"]), ",").alias("steps"), F.array_join("when_to_use.triggers", ",").alias("triggers"), F.when(F.startswith(prompt, F.lit("[mode] ")), "layers").otherwise(T.sha256(prompt)).alias("prompt"), "quality.overall")
