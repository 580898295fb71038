"""Queries on joins, inventories, chains, merges, checks, search and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corploom.functions.text import canonical_url, nfkc, sha256
from corploom.functions.text import normalize_text as normal
from corploom.operators import chains as H
from corploom.operators import inventory as N
from corploom.operators import joins as J
from corploom.operators import merge as M
from corploom.operators import quality as Q
from corploom.operators import pairing as PC
from corploom.operators import search as S
from corploom.operators.identity import sniff_title
from corploom.plans.registry import register
from corploom.rules import ALIASES, ANCHORS, COMBOS, HTML_RULES, LEXICON, NOISE, PROBLEM_RULES, ROLES, ROUTE_EXCLUDES, ROUTE_TERMS, ROUTES, SAFETY, SECRET_RULES, SIGNATURE, sql_values
from corploom.sources.tables import table


def _t(spark, d, name):
    return table(spark, d, name)


def _rules(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- joins --------------------------------------------------------------------


@register("assign_ids", "SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'old_' || c_custkey END, 'new_' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 8)) AS id, c_custkey IS NOT NULL AND o_custkey % 3 = 0 AS reused FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def assign_ids(spark, d):
    known = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("old_"), "c_custkey").alias("id"))
    minted = F.concat(F.lit("new_"), F.substring(sha256(F.col("o_custkey").cast("string")), 1, 8))
    return J.assign_ids(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", minted).select("o_orderkey", "id", "reused")


@register("id_conflicts", "SELECT 'KEY_TWICE' AS rule, CAST(c_custkey % 50 AS VARCHAR) AS value FROM customer GROUP BY 2 HAVING count(DISTINCT c_nationkey) > 1 UNION ALL SELECT 'ID_TWICE', CAST(c_nationkey AS VARCHAR) FROM customer GROUP BY 2 HAVING count(DISTINCT c_custkey % 50) > 1")
def id_conflicts(spark, d):
    return J.id_conflicts(_t(spark, d, "customer").select((F.col("c_custkey") % 50).alias("key"), F.col("c_nationkey").alias("id")), "key")


@register("assets_for", r"""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS u FROM pages WHERE page_id % 4 <> 0)
    SELECT 's' || page_id AS source_id, CASE WHEN page_id % 5 = 0 THEN 'fetched' ELSE 'queued' END AS status, i AS ordinal, u[i] AS url FROM (SELECT page_id, u, unnest(generate_series(1, len(u))) AS i FROM l)""")
def assets_for(spark, d):
    n = F.col("page_id")
    catalog = _t(spark, d, "pages").select(n.alias("catalog_id"), F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1).alias("urls"))
    ids = _t(spark, d, "pages").where("page_id % 4 <> 0").select(n.alias("catalog_id"), F.concat(F.lit("s"), n).alias("source_id"))
    base = _t(spark, d, "pages").where("page_id % 5 = 0").select(F.concat(F.lit("s"), n).alias("source_id"), F.lit("fetched").alias("status"))
    return J.assets_for(catalog, ids, base)[0].withColumn("ordinal", F.col("ordinal").cast("long"))


@register("fuzzy_source", r"""WITH f AS (SELECT DISTINCT p_name AS file FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' of the shop' END AS name FROM part),
    fw AS (SELECT DISTINCT file, w FROM (SELECT file, unnest(string_split(file, ' ')) AS w FROM f) WHERE length(w) >= 3), nw AS (SELECT DISTINCT name, w FROM (SELECT name, unnest(string_split(name, ' ')) AS w FROM n) WHERE length(w) >= 3 AND w NOT IN ('the')),
    c AS (SELECT name, file, count(*) AS k FROM nw JOIN fw USING (w) GROUP BY name, file), b AS (SELECT name, arg_min(file, struct_pack(a := -k, b := file)) AS fuzzy FROM c GROUP BY name)
    SELECT n.name, coalesce(f.file, fuzzy) AS file FROM n LEFT JOIN f ON n.name = f.file LEFT JOIN b ON n.name = b.name""")
def fuzzy_source(spark, d):
    p = _t(spark, d, "part")
    names = p.select(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(" of the shop")).alias("name"))
    return J.fuzzy_source(names, p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("file")).distinct(), ["the"])


TERMS = sql_values(LEXICON)


@register("mentions", f"SELECT doc_id, term, CAST(i AS INTEGER) AS position FROM (SELECT doc_id, text, term, unnest(generate_series(1, length(text))) AS i FROM (SELECT doc_id, text, term FROM documents, (VALUES {TERMS}) l(term, ord)) WHERE contains(text, term)) WHERE substr(text, i, length(term)) = term")
def mentions(spark, d):
    return J.mentions(_t(spark, d, "documents").select("doc_id", "text"), _rules(spark, LEXICON, "term string, ord int"))


@register("match_status", """WITH n AS (SELECT DISTINCT p_name AS name FROM part), o(old) AS (VALUES ('red widget'), ('gear'), ('blue bolt and nut'), ('cold'))
    SELECT name, CASE max(CASE WHEN old = name THEN 2 WHEN old IS NOT NULL THEN 1 ELSE 0 END) WHEN 2 THEN 'already_exists' WHEN 1 THEN 'partial_match' ELSE 'new' END AS status FROM n LEFT JOIN o ON contains(name, old) OR contains(old, name) GROUP BY name""")
def match_status(spark, d):
    old = _rules(spark, [("red widget",), ("gear",), ("blue bolt and nut",), ("cold",)], "name string")
    return J.match_status(_t(spark, d, "part").select(F.col("p_name").alias("name")), old)


@register("only_new", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def only_new(spark, d):
    return J.only_new(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register("resolve_evidence", """WITH a AS (SELECT l_orderkey AS source_id, max(l_linenumber) AS line_count, sha256(CAST(l_orderkey AS VARCHAR)) AS s FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY l_orderkey),
    r AS (SELECT l_orderkey AS source_id, l_linenumber AS start_line, l_linenumber + l_suppkey % 2 AS end_line, sha256(CAST(l_orderkey + CASE WHEN l_partkey % 20 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS sha256 FROM lineitem)
    SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN a.s IS NULL THEN 'UNKNOWN_SOURCE' WHEN a.s <> r.sha256 THEN 'HASH_MISMATCH' WHEN end_line > line_count THEN 'LINE_RANGE' ELSE 'OK' END AS verdict FROM r LEFT JOIN a USING (source_id)) GROUP BY verdict""")
def resolve_evidence(spark, d):
    x = _t(spark, d, "lineitem")
    artifacts = x.where("l_orderkey % 10 <> 0").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.max("l_linenumber").alias("line_count")).withColumn("sha256", sha256(F.col("source_id").cast("string")))
    claimed = F.col("l_orderkey") + F.when(F.col("l_partkey") % 20 == 0, 1).otherwise(0)
    refs = x.select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_suppkey") % 2).alias("end_line"), sha256(claimed.cast("string")).alias("sha256"))
    return J.resolve_evidence(refs, artifacts).groupBy("verdict").agg(F.count("*").alias("n"))


@register("resolve_blocks", """WITH b AS (SELECT l_orderkey AS source_id, list(l_linenumber) AS has FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY 1)
    SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN has IS NULL THEN 'UNKNOWN_ASSET' WHEN source_id % 5 = 0 THEN 'NOT_APPROVED' WHEN NOT list_contains(has, 2) THEN 'UNKNOWN_BLOCK' ELSE 'OK' END AS verdict FROM orders LEFT JOIN b ON o_orderkey = source_id) GROUP BY verdict""")
def resolve_blocks(spark, d):
    n = F.col("source_id")
    x = _t(spark, d, "lineitem").where("l_orderkey % 9 <> 0").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("block_ids"))
    blocks = x.select("source_id", F.concat(F.lit("a"), n).alias("asset_id"), "block_ids", F.when(n % 5 == 0, "open").otherwise("approved").alias("review_status"))
    refs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.concat(F.lit("a"), "o_orderkey").alias("asset_id"), F.array(F.lit("2")).alias("block_ids"))
    return J.resolve_blocks(refs, blocks).groupBy("verdict").agg(F.count("*").alias("n"))


@register("resolve_verifications", """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN c_custkey IS NULL THEN 'UNKNOWN_RECORD' WHEN o_orderkey % 6 = 0 THEN 'OTHER_CLAIM' WHEN c_custkey % 4 = 0 THEN 'NOT_APPROVED' ELSE 'OK' END AS verdict FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey) GROUP BY verdict""")
def resolve_verifications(spark, d):
    n = F.col("c_custkey")
    records = _t(spark, d, "customer").where("c_custkey % 10 <> 0").select(n.alias("verification_id"), F.lit("c").alias("claim_id"), n.alias("source_id"), F.when(n % 4 == 0, "open").otherwise("approved").alias("review_status"))
    refs = _t(spark, d, "orders").select(F.col("o_custkey").alias("verification_id"), F.when(F.col("o_orderkey") % 6 == 0, "x").otherwise("c").alias("claim_id"), F.col("o_custkey").alias("source_id"))
    return J.resolve_verifications(refs, records).groupBy("verdict").agg(F.count("*").alias("n"))


@register("one_canonical", "SELECT p_name, count(*) FILTER (p_partkey % 7 = 0) AS n_canonical FROM part WHERE p_size > 25 GROUP BY p_name HAVING count(*) FILTER (p_partkey % 7 = 0) <> 1")
def one_canonical(spark, d):
    x = _t(spark, d, "part").select("p_name", (F.col("p_partkey") % 7 == 0).alias("canonical"), F.when(F.col("p_size") > 25, "ready").otherwise("draft").alias("status"))
    return Q.one_canonical(x, "p_name", "canonical")


LETTERS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: list_contains([" + ", ".join(f"'{x}'" for x in SIGNATURE) + "], x))"
SETS_SQL = f"""sets AS (SELECT DISTINCT doc_id AS id, unnest({LETTERS_SQL}) AS term FROM documents), own AS (SELECT id, list(term ORDER BY term) AS terms FROM sets GROUP BY id),
    cl AS (SELECT min(id) AS rep, terms FROM own GROUP BY terms)"""


def _sets(spark, d):
    """The marking words of each document."""
    words = F.array_intersect(F.split(F.lower("text"), "[^a-z]+", -1), F.array(*map(F.lit, SIGNATURE)))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(words).alias("term"))


@register("pairwise_jaccard", f"WITH {SETS_SQL} SELECT x.rep AS a, y.rep AS b, round(len(list_intersect(x.terms, y.terms)) / (len(x.terms) + len(y.terms) - len(list_intersect(x.terms, y.terms))), 6) AS jaccard FROM cl x JOIN cl y ON x.rep < y.rep WHERE len(list_intersect(x.terms, y.terms)) > 0")
def pairwise_jaccard(spark, d):
    return J.pairwise_jaccard(_sets(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@register("term_classes", f"WITH {SETS_SQL} SELECT id, rep FROM own JOIN cl USING (terms)")
def term_classes(spark, d):
    return J.term_classes(_sets(spark, d))[0]


@register("similar_sets", f"WITH {SETS_SQL}, j AS (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.terms, y.terms)) / (len(x.terms) + len(y.terms) - len(list_intersect(x.terms, y.terms))) AS jaccard FROM cl x JOIN cl y ON x.rep < y.rep) SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.75")
def similar_sets(spark, d):
    return J.pairwise_jaccard(_sets(spark, d), 0.75).withColumn("jaccard", F.round("jaccard", 6))


@register("differentiation", f"""WITH {SETS_SQL}, a AS (SELECT doc_id AS id, coalesce(terms, CAST([] AS VARCHAR[])) AS terms FROM documents LEFT JOIN own ON id = doc_id),
    j AS (SELECT x.id, sum(len(list_intersect(x.terms, y.terms)) / greatest(len(x.terms) + len(y.terms) - len(list_intersect(x.terms, y.terms)), 1)) AS s FROM a x JOIN a y ON x.id <> y.id GROUP BY x.id)
    SELECT id, CAST(greatest(round((1 - round(s / ((SELECT count(*) FROM documents) - 1), 12)) * 100), 0) AS INTEGER) AS score FROM j""")
def differentiation(spark, d):
    return J.differentiation(_t(spark, d, "documents").select(F.col("doc_id").alias("id")), _sets(spark, d))


@register("continuity_diff", """SELECT o_orderkey, CASE WHEN p AND NOT i THEN 'missing' WHEN i AND NOT p AND NOT d THEN 'unexpected' WHEN d AND (p OR NOT i) THEN 'wrongly_declared' END AS problem
    FROM (SELECT o_orderkey, o_orderkey % 7 <> 0 AS i, o_orderkey % 5 <> 0 AS p, o_orderkey % 3 = 0 AS d FROM orders) WHERE (p AND NOT i) OR (i AND NOT p AND NOT d) OR (d AND (p OR NOT i))""")
def continuity_diff(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return J.continuity_diff(o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 3 = 0"), "o_orderkey")


@register("manifest_diff", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'missing' WHEN doc_id % 4 = 2 THEN 'extra' ELSE 'mismatch' END AS problem FROM documents WHERE doc_id % 4 <> 0 AND NOT (doc_id % 4 = 3 AND doc_id % 3 <> 0)")
def manifest_diff(spark, d):
    x = _t(spark, d, "documents").select("doc_id", sha256(F.col("text")).alias("h"))
    actual = x.where("doc_id % 4 <> 1").withColumn("h", F.when((F.col("doc_id") % 4 == 3) & (F.col("doc_id") % 3 == 0), "changed").otherwise(F.col("h")))
    return J.manifest_diff(x.where("doc_id % 4 <> 2"), actual, "doc_id", "h")


# -- inventories --------------------------------------------------------------

VARIANTS = "SELECT p_partkey, p_brand, p_size, p_type, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name || ' ' ELSE p_name END AS name FROM part"
NORM = "regexp_replace(lower(name), '[ _-]+', '', 'g')"


def _variants(spark, d):
    n = F.col("p_partkey") % 4
    name = F.when(n == 0, F.upper("p_name")).when(n == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).when(n == 2, F.concat("p_name", F.lit(" "))).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type", name.alias("name"))


INVENTORY_SQL = f"inv AS (SELECT {NORM} AS norm, list_sort(list_distinct(list(p_brand))) AS sources, count(*) AS frequency, arg_max(name, length(name) * 1000000 - p_partkey) AS display, arg_min(p_type, p_partkey) AS type FROM ({VARIANTS}) GROUP BY 1)"


def _inventory(spark, d):
    return N.merge_candidates(_variants(spark, d).select("name", F.col("p_brand").alias("source"), F.col("p_type").alias("type"), F.col("p_partkey").alias("ord")))


@register("candidate_inventory", f"WITH {INVENTORY_SQL} SELECT norm, array_to_string(sources, ',') AS sources, frequency, display, type FROM inv")
def candidate_inventory(spark, d):
    return _inventory(spark, d).withColumn("sources", F.array_join("sources", ","))


@register("filter_and_alias", f"""WITH {INVENTORY_SQL}, a(variant, canonical) AS (VALUES {sql_values(ALIASES)}),
    k AS (SELECT coalesce(canonical, norm) AS norm, frequency, sources FROM inv LEFT JOIN a ON norm = variant WHERE length(norm) BETWEEN 3 AND 30 AND NOT ({" OR ".join(f"contains(norm, '{x}')" for x in NOISE)}))
    SELECT norm, CAST(sum(frequency) AS BIGINT) AS frequency, array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS sources FROM k GROUP BY norm""")
def filter_and_alias(spark, d):
    x = N.filter_and_alias(_inventory(spark, d), NOISE, _rules(spark, ALIASES, "variant string, canonical string"))
    return x.withColumn("sources", F.array_join("sources", ","))


@register("top_by_frequency", f"WITH {INVENTORY_SQL} SELECT norm, frequency FROM inv ORDER BY frequency DESC, norm LIMIT 10")
def top_by_frequency(spark, d):
    return _inventory(spark, d).select("norm", "frequency").orderBy(F.desc("frequency"), "norm").limit(10)


@register("top_by_weight", f"WITH {INVENTORY_SQL} SELECT norm, frequency * 2 + len(sources) * 3 AS weight FROM inv ORDER BY weight DESC, norm LIMIT 10")
def top_by_weight(spark, d):
    return _inventory(spark, d).select("norm", (F.col("frequency") * 2 + F.size("sources") * 3).alias("weight")).orderBy(F.desc("weight"), "norm").limit(10)


@register("pilot_set", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS ord FROM customer ORDER BY c_custkey LIMIT 16")
def pilot_set(spark, d):
    return N.pilot_set(_t(spark, d, "customer"), "c_custkey", 16)


PILOT = [7, 3, 11, 2]


@register("pilot_explicit", f"SELECT c_custkey, CAST(list_position({PILOT}, c_custkey) AS INTEGER) AS ord FROM customer WHERE list_contains({PILOT}, c_custkey)")
def pilot_explicit(spark, d):
    return N.pilot_set(_t(spark, d, "customer"), "c_custkey", 16, PILOT)


@register("status_counts", "SELECT 'o_orderstatus' AS dim, coalesce(o_orderstatus, '_null') AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', CASE WHEN o_orderkey % 9 = 0 THEN '_null' ELSE o_orderpriority END, count(*) FROM orders GROUP BY 2")
def status_counts(spark, d):
    return N.status_counts(_t(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority"))), ["o_orderstatus", "o_orderpriority"])


@register("score_summary", "SELECT lang, round(avg(n_chars), 1) AS mean_chars, count(*) FILTER (n_chars >= 4000) AS n_high, count(*) AS n FROM documents GROUP BY lang")
def score_summary(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 1).alias("mean_chars"), F.count_if(F.col("n_chars") >= 4000).alias("n_high"), F.count("*").alias("n"))


@register("per_source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def per_source_counts(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(15)


@register("chapter_drift", "WITH c AS (SELECT n_name AS chapter, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), b AS (SELECT n_name AS chapter, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT chapter, coalesce(c.n, 0) AS now, coalesce(b.n, 0) AS base, coalesce(c.n, 0) - coalesce(b.n, 0) AS change FROM c FULL JOIN b USING (chapter)")
def chapter_drift(spark, d):
    nation = F.broadcast(_t(spark, d, "nation"))  # 25 rows by definition
    c = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("chapter")).agg(F.count("*").alias("n"))
    s = _t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("chapter")).agg(F.count("*").alias("n"))
    return N.drift(c, s, "chapter")


VERSION_SQL = "p AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h GROUP BY 1), v AS (SELECT substr(sha256(string_agg(p || ':' || h, ',' ORDER BY p)), 1, 16) AS version FROM p)"
#: JSON strings as Spark writes them: control signs and the two that JSON escapes.
JSON_TEXT = """'"' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '"'"""


@register("corpus_version", f"""WITH h AS (SELECT sha256(doc_id || '=' || '{{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '","text":' || {JSON_TEXT} || '}}') AS h FROM documents), {VERSION_SQL}
    SELECT version FROM v""")
def corpus_version(spark, d):
    return N.corpus_version(_t(spark, d, "documents"), "doc_id")


ARTIFACTS_SQL = "f AS (SELECT 'sources/' || doc_id || '.md' AS relative_path, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes FROM documents)"


def _artifacts(spark, d):
    return N.artifacts(_t(spark, d, "documents"), "doc_id", "text", "sources", ".md")


@register("run_artifacts", f"WITH {ARTIFACTS_SQL} SELECT * FROM f")
def run_artifacts(spark, d):
    return _artifacts(spark, d)


@register("knowledge_version", f"WITH {ARTIFACTS_SQL}, h AS (SELECT sha256(relative_path || chr(10) || sha256) AS h FROM f), {VERSION_SQL} SELECT version FROM v")
def knowledge_version(spark, d):
    return N.knowledge_version(_artifacts(spark, d).withColumnRenamed("relative_path", "path"))


@register("run_summary", f"""WITH {ARTIFACTS_SQL}, h AS (SELECT sha256(relative_path || chr(10) || sha256) AS h FROM f), {VERSION_SQL},
    c AS (SELECT CASE WHEN n_chars > 5000 THEN 'needs_review' ELSE 'cleaned' END AS status, count(*) AS n FROM documents GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS registered, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status, (SELECT count(*) FROM documents WHERE n_chars > 5000) AS n_warnings, (SELECT count(*) FROM f) AS n_artifacts, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM f) AS n_bytes, (SELECT version FROM v) AS version FROM c""")
def run_summary(spark, d):
    long_ = F.col("n_chars") > 5000
    sources = _t(spark, d, "documents").select(F.when(long_, "needs_review").otherwise("cleaned").alias("cleaning_status"), F.when(long_, F.array(F.lit("LONG"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    x = N.run_summary(sources, _artifacts(spark, d))
    return x.withColumn("by_status", F.array_join(F.transform("by_status", lambda s: F.concat_ws("=", s["cleaning_status"], s["n"])), ","))


@register("per_source_sizes", "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(sha256(text)) AS first_sha256 FROM documents GROUP BY source")
def per_source_sizes(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(sha256(F.col("text"))).alias("first_sha256"))


@register("batch_summary", """WITH b AS (SELECT l_orderkey AS batch_id, count(*) AS n, count(DISTINCT l_partkey) AS ids, count(DISTINCT u) AS us, count(u) AS nu, count(*) FILTER (l_partkey NOT IN (SELECT y.l_partkey FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_quantity > 5)) AS gone,
        count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS nn, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'O') AS routes FROM (SELECT *, CASE WHEN l_quantity > 5 THEN l_partkey END AS u FROM lineitem) x GROUP BY l_orderkey)
    SELECT batch_id, n AS source_ids, ids AS source_id_set_size, n AS source_updates, us AS source_update_id_set_size, n AS review_decisions, ids = us AS source_id_set_match, n = nu AND gone = 0 AS source_ids_match,
        concat_ws(',', CASE WHEN a > 0 THEN 'A=' || a END, CASE WHEN nn > 0 THEN 'N=' || nn END, CASE WHEN r > 0 THEN 'R=' || r END) AS decision_by_type, routes AS n_routes, CAST(0 AS BIGINT) AS n_tombstones FROM b""")
def batch_summary(spark, d):
    update = F.struct(F.when(F.col("l_quantity") > 5, F.col("l_partkey")).alias("source_id"), F.lit("merge").alias("action"))
    none = F.lit(None).cast("array<string>")
    rows = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(
        F.collect_list("l_partkey").alias("source_ids"),
        F.collect_list(update).alias("source_updates"),
        F.collect_list(F.struct(F.col("l_returnflag").alias("type"))).alias("review_decisions"),
        F.collect_list(F.when(F.col("l_linestatus") == "O", "r")).alias("routes"),
    )
    x = N.batch_summary(rows.withColumns({"relations": none, "safety_rules": none, "tombstones": none}))
    sizes = ("source_ids", "source_id_set_size", "source_updates", "source_update_id_set_size", "review_decisions")
    kinds = F.array_join(F.transform("decision_by_type", lambda k: F.concat_ws("=", k["kind"], k["n"])), ",")
    return x.select("batch_id", *(F.col(c).cast("long") for c in sizes), "source_id_set_match", "source_ids_match", kinds.alias("decision_by_type"), F.col("n_routes").cast("long"), F.col("n_tombstones").cast("long"))


@register("consensus_quorum", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_sources FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def consensus_quorum(spark, d):
    return N.quorum(_t(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@register("run_summary", "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(sha256(text)) AS first_sha256 FROM documents GROUP BY source")
def run_summary(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(sha256(F.col("text"))).alias("first_sha256"))


@register("keep_best_variant", f"SELECT p_partkey, {NORM} AS norm, row_number() OVER (PARTITION BY {NORM} ORDER BY p_size % 6 DESC, p_partkey) = 1 AS kept FROM ({VARIANTS})")
def keep_best_variant(spark, d):
    x = _variants(spark, d).withColumn("q", F.col("p_size") % 6)
    return N.keep_best_variant(x, "name", "q", "p_partkey").select("p_partkey", "norm", "kept")


@register("latest_version", "SELECT base, max(name) AS name FROM (SELECT p_name || ' ' || p_size AS name, p_name AS base FROM part) GROUP BY base")
def latest_version(spark, d):
    return N.latest_version(_t(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("name")).distinct(), "name").select("base", "name")


@register("round_robin", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) % 16 AS INTEGER) AS batch FROM customer")
def round_robin(spark, d):
    return N.round_robin(_t(spark, d, "customer"), "c_custkey", 16)


@register("next_sequence", "WITH e AS (SELECT o_orderpriority AS type, CAST(max(o_orderkey % 50) AS BIGINT) AS top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT o_orderkey, coalesce(top, 0) + row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS number FROM orders LEFT JOIN e ON o_orderpriority = type WHERE o_orderkey % 2 = 1 AND o_orderpriority <> '2-HIGH'")
def next_sequence(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("type"))
    existing = o.where("o_orderkey % 2 = 0").select("type", (F.col("o_orderkey") % 50).alias("number"))
    return N.next_sequence(o.where("o_orderkey % 2 = 1"), existing, "type", "o_orderkey", manual=["2-HIGH"]).select("o_orderkey", F.col("number").cast("long"))


@register("first_of_type", "WITH e AS (SELECT c_nationkey AS k, max(c_custkey % 40) AS top FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT min(c_custkey) AS c_custkey, c_nationkey, CAST(coalesce(max(top), 0) + 1 AS BIGINT) AS number FROM customer LEFT JOIN e ON c_nationkey = k WHERE c_custkey % 2 = 1 GROUP BY c_nationkey")
def first_of_type(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    existing = c.where("c_custkey % 2 = 0").select("c_nationkey", (F.col("c_custkey") % 40).alias("number"))
    return N.next_sequence(c.where("c_custkey % 2 = 1"), existing, "c_nationkey", "c_custkey", first_only=True).select("c_custkey", "c_nationkey", F.col("number").cast("long"))


@register("exact_duplicates", "WITH k AS (SELECT doc_id, 'raw' AS key, sha256(text) AS value FROM documents UNION ALL SELECT doc_id, 'clean', sha256(lower(trim(text, ' '))) FROM documents) SELECT key, value, min(doc_id) AS keep, count(*) AS n FROM k GROUP BY key, value HAVING count(*) > 1")
def exact_duplicates(spark, d):
    x = _t(spark, d, "documents").select("doc_id", sha256(F.col("text")).alias("raw"), sha256(F.lower(F.trim("text"))).alias("clean"))
    return N.duplicates_by(x, ["raw", "clean"], "doc_id")


@register("duplicate_pages", "WITH k AS (SELECT page_id, 'url' AS key, regexp_replace(url, '#.*$', '') AS value FROM pages UNION ALL SELECT page_id, 'html', sha256(html) FROM pages) SELECT key, value, min(page_id) AS keep, count(*) AS n FROM k GROUP BY key, value HAVING count(*) > 1")
def duplicate_pages(spark, d):
    """Pages with the same canonical URL or the same bytes."""
    x = _t(spark, d, "pages").select("page_id", canonical_url(F.col("url")).alias("url"), sha256(F.col("html")).alias("html"))
    return N.duplicates_by(x, ["url", "html"], "page_id")


@register("review_queue", r"""WITH h AS (SELECT text, list_transform(string_split(text, chr(10))[1:8], lambda x: trim(x)) AS h FROM documents),
    t AS (SELECT text, coalesce(list_filter(list_transform(h, lambda x: regexp_extract(x, '^#+[ \t]*(.+)', 1)), lambda x: x <> '')[1], list_filter(h, lambda x: length(x) > 5 AND NOT regexp_matches(x, '^[=*-]'))[1]) AS title FROM h)
    SELECT trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS title, count(DISTINCT sha256(text)) AS n_bodies FROM t GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1""")
def review_queue(spark, d):
    x = _t(spark, d, "documents").select("text", sha256(F.col("text")).alias("body"))
    return N.review_queue(x, normal(sniff_title(F.col("text"))), "body")


@register("near_copy_candidates", r"""WITH t AS (SELECT min(doc_id) AS id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents GROUP BY text, lower(text)),
    s AS (SELECT id, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM t WHERE len(w) > 0),
    c AS (SELECT min(id) AS id, s FROM s GROUP BY s), e AS (SELECT id, len(s) AS n, unnest(s) AS h FROM c),
    p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.id < y.id GROUP BY ALL)
    SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM p WHERE c / (na + nb - c) >= 0.8""")
def near_copy_candidates(spark, d):
    return N.near_copy_candidates(_t(spark, d, "documents").select("doc_id", "text")).withColumn("jaccard", F.round("jaccard", 6))


PAIR_DOCS = "SELECT doc_id, split_part(text, chr(10), 1) AS title, DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS date, source AS type, text FROM documents"


@register("pair_candidates", rf"""WITH d AS ({PAIR_DOCS}), c AS (SELECT min(doc_id) AS id, title, date, type, text FROM d GROUP BY title, date, type, text),
    w AS (SELECT id, regexp_replace(lower(title), '[ _-]+', '', 'g') AS title_key, date, type, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM c),
    s AS (SELECT id, title_key, date, type, list_distinct(CASE WHEN len(w) > 0 THEN list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END) AS s FROM w),
    f AS (SELECT *, len(s) AS size, coalesce(list_min(list_transform(s, lambda x: md5(x))), '') AS body_key FROM s),
    r AS (SELECT 1 AS o, id, row_number() OVER (ORDER BY title_key, date, id) AS r FROM f UNION ALL SELECT 2, id, row_number() OVER (ORDER BY type, date, id) FROM f UNION ALL SELECT 3, id, row_number() OVER (ORDER BY body_key, size, id) FROM f),
    p AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM r x JOIN r y ON x.o = y.o AND y.r > x.r AND y.r <= x.r + 5),
    k AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS common, x.size AS na, y.size AS nb, x.title_key = y.title_key AND x.title_key <> '' AS same_title, x.type = y.type AS same_type, CAST(abs(date_diff('day', x.date, y.date)) AS INTEGER) AS gap FROM p JOIN f x ON x.id = a JOIN f y ON y.id = b),
    j AS (SELECT *, CASE WHEN na + nb > common THEN round(common / (na + nb - common), 9) ELSE 0 END AS jaccard, CASE WHEN least(na, nb) > 0 THEN round(common / least(na, nb), 9) ELSE 0 END AS containment FROM k),
    t AS (SELECT *, CASE WHEN jaccard >= 0.8 THEN 'near_copy' WHEN containment >= 0.8 AND (same_title OR (same_type AND gap <= 3)) THEN 'long_short' WHEN same_title AND same_type AND gap <= 3 THEN 'same_title' END AS kind FROM j)
    SELECT a, b, kind, jaccard, containment, same_title, same_type, gap FROM t WHERE kind IS NOT NULL""")
def pair_candidates(spark, d):
    """By first line, a date made of the id, source and body."""
    docs = _t(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("date"), F.col("source").alias("type"), "text")
    return PC.pair_candidates(docs)


# -- chains -------------------------------------------------------------------

GAP = 40_000
CHAIN_SQL = f"""m AS (SELECT user_id AS source, event_type AS name, epoch(ts) AS position, event_id AS ord FROM events),
    f AS (SELECT *, CASE WHEN lag(name) OVER w IS NULL OR lag(name) OVER w = name OR position - lag(position) OVER w >= {GAP} THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY source ORDER BY position, ord)),
    g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY source ORDER BY position, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain_no FROM f),
    r AS (SELECT source, chain_no, name, min(position * 1000000 + ord) AS o FROM g GROUP BY ALL), s AS (SELECT source, chain_no, count(*) AS k FROM g GROUP BY ALL),
    ch AS (SELECT source, chain_no, list(name ORDER BY o) AS names FROM r JOIN s USING (source, chain_no) WHERE k >= 2 GROUP BY source, chain_no HAVING count(*) BETWEEN 2 AND 6)"""


def _chains(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    m = _t(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("name"), seconds.alias("position"), F.col("event_id").alias("ord"))
    return H.chains(m, GAP)


@register("event_chains", f"WITH {CHAIN_SQL} SELECT source, chain_no, array_to_string(names, '>') AS chain FROM ch")
def event_chains(spark, d):
    return _chains(spark, d).select("source", F.col("chain_no").cast("long"), F.array_join("names", ">").alias("chain"))


@register("distinct_chains", f"WITH {CHAIN_SQL} SELECT array_to_string(names, '>') AS chain, min(source) AS source FROM ch GROUP BY 1")
def distinct_chains(spark, d):
    return H.distinct_chains(_chains(spark, d), ["source", "chain_no"]).select(F.array_join("names", ">").alias("chain"), "source")


TYPED_SQL = f"""{CHAIN_SQL}, rules(type, ord, keyword, head) AS (VALUES {sql_values(PROBLEM_RULES)}),
    ty AS (SELECT DISTINCT source, chain_no, names, type FROM ch JOIN rules ON contains(names[1], head) OR contains(head, names[1]) OR contains(CAST(source AS VARCHAR), keyword) WHERE len(names) >= 3),
    al AS (SELECT source, chain_no, names, type FROM ty UNION ALL SELECT source, chain_no, names, 'general' FROM ch WHERE (source, chain_no) NOT IN (SELECT source, chain_no FROM ty))"""


def _typed(spark, d):
    x = _chains(spark, d)
    typed = H.assign_problem_types(x, _rules(spark, PROBLEM_RULES, "type string, ord int, keyword string, head string"))
    return H.with_catch_all(x, typed, ["source", "chain_no"])


@register("problem_types", f"WITH {TYPED_SQL} SELECT type, count(*) AS n FROM al GROUP BY type")
def problem_types(spark, d):
    return _typed(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@register("top_chains", f"WITH {TYPED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY source, chain_no) AS rank FROM al) SELECT type, rank, source, chain_no FROM t WHERE rank <= 5")
def top_chains(spark, d):
    return H.top_chains(_typed(spark, d), ["source", "chain_no"]).select("type", F.col("rank").cast("long"), "source", F.col("chain_no").cast("long"))


@register("longest_chains", f"WITH {CHAIN_SQL} SELECT source, max(len(names)) AS longest FROM ch GROUP BY source ORDER BY longest DESC, source LIMIT 15")
def longest_chains(spark, d):
    return _chains(spark, d).groupBy("source").agg(F.max(F.size("names")).cast("long").alias("longest")).orderBy(F.desc("longest"), "source").limit(15)


@register("handoff", f"WITH {CHAIN_SQL}, e AS (SELECT source, chain_no, names, unnest(generate_series(1, len(names))) AS i FROM ch) SELECT names[i] AS name, coalesce(names[i + 1], 'end') AS to_name, count(*) AS n FROM e GROUP BY 1, 2")
def handoff(spark, d):
    return _chains(spark, d).select(F.inline(H.handoff(F.col("names"), "end"))).groupBy("name", F.col("to").alias("to_name")).agg(F.count("*").alias("n"))


@register("drop_consecutive", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def drop_consecutive(spark, d):
    return H.drop_consecutive_duplicates(_t(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id")


PANEL_SQL = f"""{CHAIN_SQL}, fd AS (SELECT source, chain_no, names, list_filter({list(ANCHORS)}, lambda a: list_contains(names, a)) AS f FROM ch),
    pn AS (SELECT source || '-' || chain_no AS id, CASE {" ".join(f"WHEN len(list_intersect(names, {list(c)})) = {len(c)} THEN {list(c)}" for _, c in sorted(COMBOS))} WHEN len(f) >= 3 THEN f[1:3] WHEN len(names) <= 3 THEN names
        ELSE [names[1], names[CAST(floor(len(names) / 2) AS INTEGER) + 1], names[len(names)]] END AS panel FROM fd),
    st AS (SELECT id, unnest(panel) AS name, generate_subscripts(panel, 1) AS seat FROM pn), ro(name, role, stance, challenge) AS (VALUES {sql_values(ROLES)})"""


@register("panels", f"""WITH {PANEL_SQL} SELECT id, string_agg(st.name || ':' || coalesce(role, 'participant') || ':' || coalesce(stance, 'open') || ':' || coalesce(challenge, 'What does ' || st.name || ' overlook?'), ';' ORDER BY seat) AS participants, count(role) AS quality FROM st LEFT JOIN ro ON st.name = ro.name GROUP BY id""")
def panels(spark, d):
    picked = _chains(spark, d).select(F.concat_ws("-", "source", "chain_no").alias("id"), H.select_panel(F.col("names"), COMBOS, ANCHORS).alias("panel"))
    x = H.build_panel(picked, _rules(spark, ROLES, "name string, role string, stance string, challenge string"), "id", "panel")
    return x.withColumn("participants", F.array_join(F.transform("participants", lambda s: F.concat_ws(":", s["name"], s["role"], s["stance"], s["challenge"])), ";"))


# -- merges -------------------------------------------------------------------


@register("upsert_replace", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_replace(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return M.upsert_replace(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


@register("upsert_patch", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0")
def upsert_patch(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    updates = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 1, "NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return M.upsert_patch(c.where("c_custkey % 5 <> 0"), updates, ["c_custkey"], ["c_mktsegment"])[0]


@register("upsert_provided", "SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 6 = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_provided(spark, d):
    """Updates that provide a null segment, or a balance and no segment."""
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    even = F.col("c_custkey") % 2 == 0
    updates = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"), F.when(even, F.array(F.lit("c_mktsegment"))).otherwise(F.array(F.lit("c_acctbal"))).alias("fields"))
    return M.upsert_patch(c, updates, ["c_custkey"], ["c_mktsegment", "c_acctbal"], provided="fields")[0]


@register("merge_routes", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_orderkey % 4 = 0 THEN 'X' ELSE min(l_returnflag) END AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey")
def merge_routes(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_suppkey"]
    x = _t(spark, d, "lineitem").groupBy(*keys).agg(F.min("l_returnflag").alias("flag"))
    return M.upsert_replace(x, x.where("l_orderkey % 4 = 0").withColumn("flag", F.lit("X")), keys)


@register("merge_queue", "SELECT CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' END AS key FROM events")
def merge_queue(spark, d):
    e = _t(spark, d, "events")
    return e.select(M.queue_key(F.when(F.col("event_id") % 2 == 0, F.col("event_id")), F.struct("event_id", "user_id")).alias("key"))


@register("batch_scope_check", """WITH p AS (SELECT 'b' || c_custkey % 4 AS batch_id, c_custkey AS source_id FROM customer), u AS (SELECT 'b' || (CASE WHEN c_custkey % 11 = 0 THEN 9 WHEN c_custkey % 7 = 0 THEN (c_custkey + 1) % 4 ELSE c_custkey % 4 END) AS batch_id, c_custkey AS source_id FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 5 <> 0)
    SELECT CASE WHEN batch_id = 'b9' THEN 'UNKNOWN_BATCH' ELSE 'OUT_OF_SCOPE' END AS rule, batch_id, source_id FROM u WHERE (batch_id, source_id) NOT IN (SELECT batch_id, source_id FROM p)
    UNION ALL SELECT 'NOT_COVERED', batch_id, source_id FROM p WHERE batch_id IN (SELECT batch_id FROM u) AND (batch_id, source_id) NOT IN (SELECT batch_id, source_id FROM u)""")
def batch_scope_check(spark, d):
    c = _t(spark, d, "customer")
    n = F.col("c_custkey")
    plan = c.select(F.concat(F.lit("b"), n % 4).alias("batch_id"), n.alias("source_id"))
    to = F.when(n % 11 == 0, 9).when(n % 7 == 0, (n + 1) % 4).otherwise(n % 4)
    return M.batch_scope_check(plan, c.where("c_custkey % 4 <> 3 AND c_custkey % 5 <> 0").select(F.concat(F.lit("b"), to).alias("batch_id"), n.alias("source_id")))


@register("base_hash_check", "SELECT c_custkey, 'mismatch' AS problem FROM customer WHERE c_custkey % 3 = 0")
def base_hash_check(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", sha256(F.to_json(F.struct("c_custkey", "c_name"))).alias("h"))
    return J.manifest_diff(c, c.withColumn("h", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("h"))), "c_custkey", "h")


@register("carry_review_state", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'rev' || doc_id END AS owner FROM documents")
def carry_review_state(spark, d):
    n = F.col("doc_id")
    new = _t(spark, d, "documents").select("doc_id", sha256(F.col("text")).alias("raw"), F.when(n % 2 == 0, "cleaned").otherwise("needs_review").alias("status"))
    prior = new.select("doc_id", F.when(n % 5 == 0, "old").otherwise(F.col("raw")).alias("raw"), F.concat(F.lit("rev"), n).alias("owner"))
    return M.carry_review_state(new, prior, "doc_id", ["raw"], ["owner"]).select("doc_id", "owner")


@register("ocr_status", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'failed' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'queued' ELSE 'done' END AS status FROM orders GROUP BY o_custkey")
def ocr_status(spark, d):
    x = _t(spark, d, "orders").groupBy("o_custkey").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"))
    return x.select("o_custkey", M.status_transition(F.lit("none"), F.col("O"), F.col("F"), F.col("P")).alias("status"))


# -- checks -------------------------------------------------------------------


@register("check_contract", """SELECT rule, key, path, message FROM (
    SELECT 'range' AS rule, CAST(p_partkey AS VARCHAR) AS key, 'p_size' AS path, 'p_size: range (5, 45)' AS message FROM part WHERE p_size NOT BETWEEN 5 AND 45
    UNION ALL SELECT 'enum', CAST(p_partkey AS VARCHAR), 'p_type', 'p_type: enum (''ECONOMY'', ''SMALL'')' FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL') OR p_partkey % 10 = 0
    UNION ALL SELECT 'regex', CAST(p_partkey AS VARCHAR), 'p_brand', 'p_brand: regex ^Brand#[0-9]$' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$') AND p_partkey % 10 <> 1
    UNION ALL SELECT 'type', NULL, 'p_size', 'type' UNION ALL SELECT 'missing_column', NULL, 'p_color', 'missing_column' UNION ALL SELECT 'unknown_column', NULL, 'p_retailprice', 'unknown_column')""")
def check_contract(spark, d):
    """Nulls break the enum of p_type; p_brand may be null; p_size should be a string."""
    rules = [("p_size", "range", (5, 45)), ("p_size", "type", "string"), ("p_type", "enum", ("ECONOMY", "SMALL")), ("p_brand", "regex", "^Brand#[0-9]$"), ("p_brand", "nullable", None), ("p_name", "required", ""), ("p_name", "type", "string"), ("p_color", "required", "")]
    n = F.col("p_partkey") % 10
    return Q.check_contract(_t(spark, d, "part").withColumn("p_type", F.when(n != 0, F.col("p_type"))).withColumn("p_brand", F.when(n != 1, F.col("p_brand"))), "p_partkey", rules)


@register("unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_keys(spark, d):
    return Q.unique(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("strictly_increasing", "SELECT user_id, event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value <= b")
def strictly_increasing(spark, d):
    return Q.not_increasing(_t(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id")


@register("ready_gate", "SELECT o_orderkey, 'price' AS rule FROM orders WHERE o_orderstatus = 'O' AND NOT o_totalprice > 100000 UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def ready_gate(spark, d):
    o = _t(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "ready").otherwise("draft"))
    return Q.ready_gate(o, "o_orderkey", [("price", F.col("o_totalprice") > 100000), ("priority", F.col("o_orderpriority") != "1-URGENT")])


@register("redaction_check", "SELECT doc_id, 'author' AS path FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 = 0 UNION ALL SELECT doc_id, 'url' FROM documents WHERE doc_id % 3 = 0 AND source = 'src3' UNION ALL SELECT doc_id, 'fingerprint' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 = 0")
def redaction_check(spark, d):
    """Redacted rows of which some still show a field."""
    n = F.col("doc_id")
    hidden = n % 3 == 0
    rows = _t(spark, d, "documents").select("doc_id", F.when(hidden, "redacted").otherwise("public").alias("status"), F.when(~hidden | (n % 4 == 0), F.col("lang")).alias("author"), F.when(~hidden | (F.col("source") == "src3"), F.col("source")).alias("url"), F.when(~hidden, F.lit("2024-01-02")).alias("published_at"), F.when(~hidden | (n % 7 == 0), sha256(F.col("text"))).alias("fingerprint"))
    return Q.redaction_check(rows, "doc_id")


@register("flatten_claims", "SELECT doc_id, 'core' AS path, lang AS claim FROM documents UNION ALL SELECT doc_id, 'limits[' || i || ']', CASE i WHEN 0 THEN source ELSE lang END FROM documents, range(0, 2) r(i) WHERE doc_id % 2 = 0")
def flatten_claims(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("core"), F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).alias("limits"))
    return Q.flatten_claims(rows, "doc_id", ["core"], ["limits"])


@register("check_claims", """WITH a AS (SELECT l_orderkey AS k, max(l_linenumber) AS line_count FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1),
    r AS (SELECT l_orderkey AS claim_id, l_linenumber AS ord, l_suppkey AS s, CASE WHEN line_count IS NULL THEN 'UNKNOWN_SOURCE' WHEN l_linenumber + l_suppkey % 2 > line_count THEN 'LINE_RANGE' ELSE 'OK' END AS verdict, l_partkey % 3 = 0 AS record FROM lineitem LEFT JOIN a ON k = l_orderkey WHERE l_orderkey % 7 <> 0),
    g AS (SELECT claim_id, count(*) AS n, arg_min(verdict, ord) FILTER (verdict <> 'OK') AS bad, count(DISTINCT s) AS sources, count(*) FILTER (record AND verdict = 'OK') AS verified FROM r GROUP BY claim_id)
    SELECT o_orderkey AS claim_id, rule FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'STATUS' WHEN o_orderkey % 9 <> 0 AND n IS NULL THEN 'NO_REFS' WHEN bad IS NOT NULL THEN bad WHEN o_orderstatus = 'F' AND coalesce(sources, 0) < 2 THEN 'QUORUM' WHEN o_orderstatus = 'O' AND coalesce(verified, 0) = 0 THEN 'VERIFICATION' END AS rule
        FROM orders LEFT JOIN g ON claim_id = o_orderkey) WHERE rule IS NOT NULL""")
def check_claims(spark, d):
    """Claims of orders, whose references are lines of their artifacts."""
    status = F.when(F.col("o_orderstatus") == "F", "cross_source_consensus").when(F.col("o_orderstatus") == "O", "independently_verified").otherwise("hearsay")
    claims = _t(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).otherwise(" ").alias("text"), status.alias("claim_status"))
    x = _t(spark, d, "lineitem")
    artifacts = x.where("l_orderkey % 10 <> 0").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.max("l_linenumber").alias("line_count")).withColumn("sha256", F.lit("h"))
    refs = x.where("l_orderkey % 7 <> 0").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_suppkey") % 2).alias("end_line"), F.lit("h").alias("sha256"), F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_partkey") % 3 == 0, "verification_record").otherwise("artifact").alias("kind"))
    checked = J.resolve_evidence(refs, artifacts).select("claim_id", F.col("supplier").alias("source_id"), "kind", "ord", "verdict")
    return Q.check_claims(claims, checked)


@register("count_reconcile", "SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM labels) AS n_labels, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_orphans")
def count_reconcile(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    one = docs.agg(F.count("*").alias("n_documents")).crossJoin(labels.agg(F.count("*").alias("n_labels")))  # one row each
    return one.crossJoin(labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_orphans")))


@register("embedded_meta", "SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN page_id END AS meta_id FROM pages")
def embedded_meta(spark, d):
    n = F.col("page_id")
    body = F.when(n % 3 == 0, F.concat(F.lit('<!-- model-meta: {"id": '), n, F.lit("} -->"))).when(n % 3 == 1, F.concat(F.lit('x <!-- model-meta: {"id":'), n, F.lit(',"z":[1]} -->'))).otherwise("<!-- model-meta: {bad} -->")
    return _t(spark, d, "pages").select("page_id", Q.embedded_meta(F.concat("html", body), "model-meta", "id long")["id"].alias("meta_id"))


@register("external_refs", "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}')) AS {label}" for label, p in HTML_RULES) + r", NOT starts_with(lower(trim(html)), '<!doctype html') AS no_doctype, NOT contains(html, '</html>') AS no_html, len(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1), chr(10)), 'fetch\(|XMLHttpRequest|track\(')) AS calls FROM pages")
def external_refs(spark, d):
    return Q.external_refs(_t(spark, d, "pages"), HTML_RULES)


@register("secret_scan", " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM documents WHERE regexp_matches(text, '{p}')" for label, p in SECRET_RULES))
def secret_scan(spark, d):
    return Q.secret_scan(_t(spark, d, "documents"), SECRET_RULES)


@register("strict_gate", "SELECT min(doc_id) IS NOT NULL AS failed, min(doc_id) AS first_id FROM documents WHERE n_chars > 20000")
def strict_gate(spark, d):
    return Q.strict_gate(_t(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 20000, "needs_review").otherwise("cleaned").alias("status")), "doc_id")


@register("relation_checks", """WITH e AS (SELECT n_nationkey AS f, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey ELSE n_nationkey + n_regionkey END AS t FROM nation)
    SELECT 'SELF' AS rule, f AS "from", t AS "to" FROM e WHERE f = t UNION ALL SELECT 'DANGLING', f, t FROM e WHERE t NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 6 <> 1) OR f NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 6 <> 1)
    UNION ALL SELECT 'UNPAIRED', f, t FROM e WHERE f <> t AND (t, f) NOT IN (SELECT f, t FROM e)""")
def relation_checks(spark, d):
    n = _t(spark, d, "nation")
    to = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + F.col("n_regionkey"))
    edges = n.select(F.col("n_nationkey").alias("from"), to.alias("to"), F.lit("related").alias("type"))
    return Q.relation_checks(edges, n.where("n_nationkey % 6 <> 1").select(F.col("n_nationkey").alias("id")), ["related"])


# -- search and routing -------------------------------------------------------

NORMAL = r"trim(regexp_replace(lower(TEXT), '[^\p{L}\p{N}]+', ' ', 'g'))"


@register("normalize_text", f"SELECT doc_id, sha256({NORMAL.replace('TEXT', 'text')}) AS normal_sha256 FROM documents")
def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", sha256(normal(F.col("text"))).alias("normal_sha256"))


@register("nfkc_differs", "SELECT doc_id, sha256(text) AS nfkc_sha256, contains(text, 'fi') OR contains(text, '1') AS changed FROM documents")
def nfkc_differs(spark, d):
    """Whole texts with ligatures and full-width digits put in: NFKC takes them out again."""
    odd = F.replace(F.replace("text", F.lit("fi"), F.lit("\ufb01")), F.lit("1"), F.lit("\uff11"))
    x = _t(spark, d, "documents").select("doc_id", odd.alias("odd")).withColumn("plain", nfkc(F.col("odd")))
    return x.select("doc_id", sha256(F.col("plain")).alias("nfkc_sha256"), (F.col("plain") != F.col("odd")).alias("changed"))


def _words_sql(text):
    """A text's distinct tokens: its words, and all of it (a long one by its digest)."""
    whole = NORMAL.replace("TEXT", text)
    return f"unnest(list_distinct(list_filter(list_append(string_split({whole}, ' '), CASE WHEN length({whole}) > 64 THEN '=' || sha256({whole}) ELSE {whole} END), lambda x: x <> '')))"


FIELDS = [("title", 12), ("source", 10), ("lang", 8), ("lead", 7), ("second", 6), ("last", 4), ("text", 1)]
FIELDS_SQL = "SELECT doc_id, split_part(text, chr(10), 1) AS title, source, lang, split_part(text, '.', 1) AS lead, split_part(text, chr(10), 2) AS second, list_last(string_split(text, chr(10))) AS last, text FROM documents"


@register("search_topk", f"""WITH dt AS ({FIELDS_SQL}), q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
    t AS ({" UNION ALL ".join(f"SELECT doc_id, title, {_words_sql(f)} AS term, {w} AS w FROM dt" for f, w in FIELDS)}),
    a AS (SELECT query_id, {_words_sql('query')} AS term FROM q), s AS (SELECT query_id, doc_id, title, CAST(sum(w) AS BIGINT) AS score FROM t JOIN a USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 20""")
def search_topk(spark, d):
    """Whole items as queries against all fields."""
    lines = F.split("text", "\n", -1)
    docs = _t(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "source", "lang", F.substring_index("text", ".", 1).alias("lead"), F.get(lines, F.lit(1)).alias("second"), F.element_at(lines, -1).alias("last"), "text")
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S.search(docs, asked, FIELDS).withColumn("rank", F.col("rank").cast("long"))


@register("route_match", f"""WITH i AS (SELECT conv_id || '-' || turn AS id, lower(text) AS text FROM conversations), routes(route, priority, least, "primary", aux) AS (VALUES {sql_values(r[:4] + (",".join(r[4][:2]),) for r in ROUTES)}),
    terms(route, term, w) AS (VALUES {sql_values(ROUTE_TERMS)}), ex(route, term) AS (VALUES {sql_values(ROUTE_EXCLUDES)}), safety(rule, priority, word) AS (VALUES {sql_values(SAFETY)}),
    sc AS (SELECT id, route, sum(w) AS s FROM i JOIN terms ON contains(text, term) GROUP BY ALL),
    ok AS (SELECT sc.id, routes.*, s, rank() OVER (PARTITION BY sc.id ORDER BY s DESC, priority) AS r FROM sc JOIN routes USING (route) WHERE s >= least AND NOT EXISTS (SELECT 1 FROM ex JOIN i ON contains(i.text, ex.term) WHERE ex.route = sc.route AND i.id = sc.id)),
    b AS (SELECT id, min(route) AS route, arg_min("primary", route) AS "primary", arg_min(aux, route) AS aux FROM ok WHERE r = 1 GROUP BY id HAVING count(DISTINCT "primary") = 1),
    al AS (SELECT id, arg_min(rule, priority) AS rule FROM i JOIN safety ON contains(text, word) GROUP BY id)
    SELECT i.id, CASE WHEN rule IS NOT NULL THEN 'safety' WHEN b.id IS NOT NULL THEN 'route' ELSE 'none' END AS kind, coalesce(rule, route) AS route, CASE WHEN rule IS NULL THEN "primary" END AS "primary", CASE WHEN rule IS NULL THEN aux END AS auxiliaries FROM i LEFT JOIN b USING (id) LEFT JOIN al USING (id)""")
def route_match(spark, d):
    inputs = _t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    x = S.match_route(inputs, ROUTES, ROUTE_TERMS, ROUTE_EXCLUDES, SAFETY)
    return x.withColumn("auxiliaries", F.when(F.col("auxiliaries").isNotNull(), F.array_join("auxiliaries", ",")))


@register("render_prompt", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'role: ' || role || chr(10) || 'text: ' || text ELSE 'Please add: more' END AS prompt FROM conversations WHERE trim(text) <> ''")
def render_prompt(spark, d):
    x = _t(spark, d, "conversations").where("trim(text) <> ''")
    return x.select("conv_id", "turn", S.render_prompt(["role", "text"], F.col("conv_id") % 2 == 0, "Please add: ").alias("prompt"))
