"""Queries on lines, cleaning and audit."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from corploom.functions.text import sha256, smart_slice
from corploom.operators import lines as L
from corploom.plans.registry import register
from corploom.rules import LINE_PATTERNS
from corploom.session import small
from corploom.sources.tables import table

LINES_SQL = r"""
    parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
    raw AS (SELECT doc_id, generate_subscripts(p, 1) AS line, unnest(p) AS text, len(p) AS n FROM parts),
    lines AS (SELECT doc_id, line, text, line < n AS has_lf,
                     CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start
              FROM raw WHERE NOT (line = n AND text = ''))"""
#: Lines with some blank ones put in: every third sentence mark starts a paragraph of its own.
SPACED_SQL = LINES_SQL.replace("FROM documents)", "FROM (SELECT doc_id, replace(text, '. T', '.' || chr(10) || ' ' || chr(10) || chr(10) || 'T') || chr(10) || ' ' || chr(10) AS text FROM documents))")
COLLAPSED_SQL = r"""
    m AS (SELECT *, trim(text, ' ' || chr(9)) = '' AS blank FROM lines),
    k AS (SELECT *, lag(blank) OVER w AS was, max(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS more
          FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    kept AS (SELECT doc_id, line, CASE WHEN blank THEN '' ELSE text END AS text FROM k WHERE NOT blank OR (NOT coalesce(was, false) AND coalesce(more, 0) = 1))"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _spaced(spark, d):
    gap = F.replace("text", F.lit(". T"), F.lit(".\n \n\nT"))
    return _docs(spark, d).select("doc_id", F.concat(gap, F.lit("\n \n")).alias("text"))


@register("explode_lines", f"WITH {LINES_SQL} SELECT doc_id, line, sha256(text) AS line_sha256, has_lf, byte_start, CAST(byte_start + strlen(text) AS BIGINT) AS byte_end FROM lines")
def explode_lines(spark, d):
    x = L.explode_lines(_docs(spark, d))
    return x.select("doc_id", F.col("line").cast("long"), sha256(F.col("text")).alias("line_sha256"), "has_lf", "byte_start", F.col("byte_end").cast("long"))


@register("collapse_blank_runs", f"WITH {SPACED_SQL}, {COLLAPSED_SQL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (text = '') AS n_blank, CAST(sum(line) AS BIGINT) AS line_sum FROM kept GROUP BY doc_id")
def collapse_blank_runs(spark, d):
    x = _spaced(spark, d).select("doc_id", L.collapse_blanks(L.line_array(F.col("text"))).alias("l")).where(F.size("l") > 0)
    blank = F.size(F.filter("l", lambda x: x["text"] == "")).cast("long")
    return x.select("doc_id", F.size("l").cast("long").alias("n_lines"), blank.alias("n_blank"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["line"]).alias("line_sum"))


@register("collapsed_line_rows", f"WITH {SPACED_SQL}, {COLLAPSED_SQL} SELECT doc_id, line, sha256(text) AS line_sha256 FROM kept")
def collapsed_line_rows(spark, d):
    """The same on a table of lines."""
    x = L.collapse_blank_runs(L.explode_lines(_spaced(spark, d)))
    return x.select("doc_id", F.col("line").cast("long"), sha256(F.col("text")).alias("line_sha256"))


@register("reassemble_hash", f"WITH {SPACED_SQL}, {COLLAPSED_SQL} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY line) || chr(10)) AS clean_sha256 FROM kept GROUP BY doc_id")
def reassemble_hash(spark, d):
    x = _spaced(spark, d).select("doc_id", L.joined(L.collapse_blanks(L.line_array(F.col("text")))).alias("text"))
    return x.where("text IS NOT NULL").select("doc_id", sha256(F.col("text")).alias("clean_sha256"))


@register("normalize_nbsp", f"WITH {LINES_SQL} SELECT doc_id, line, sha256(replace(t, chr(160), ' ')) AS line_sha256 FROM (SELECT doc_id, line, replace(text, ' th', chr(160) || 'th') AS t FROM lines) WHERE contains(t, chr(160)) AND trim(replace(t, chr(160), ' ')) <> ''")
def normalize_nbsp(spark, d):
    x = L.explode_lines(_docs(spark, d)).withColumn("text", F.replace("text", F.lit(" th"), F.lit(L.NBSP + "th")))
    return L.normalize_nbsp(x).where("nbsp_changed").select("doc_id", F.col("line").cast("long"), sha256(F.col("text")).alias("line_sha256"))


LABELED = "'![Figure ' || n || '](u' || n || ')' || chr(10) || CASE n % 3 WHEN 0 THEN chr(10) WHEN 1 THEN '' ELSE chr(10) || chr(10) END || 'Figure ' || (n - CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END) || chr(10) || 'text'"


@register("duplicate_labels", f"WITH documents AS (SELECT doc_id, {LABELED.replace('n ', 'doc_id ').replace('|| n', '|| doc_id').replace('(n', '(doc_id')} AS text FROM main.documents), {LINES_SQL}, x AS (SELECT *, regexp_extract(text, '^!\\[Figure ([0-9]+)\\]\\(', 1) AS shown, regexp_extract(text, '^Figure ([0-9]+)[ \\t]*$', 1) AS num FROM lines), y AS (SELECT *, lag(shown) OVER w AS one, lag(shown, 2) OVER w AS two, lag(text) OVER w AS up FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line)) SELECT doc_id, line FROM y WHERE num <> '' AND (num = one OR (num = two AND up = ''))")
def duplicate_labels(spark, d):
    n = F.col("doc_id")
    gap = F.when(n % 3 == 0, "\n").when(n % 3 == 1, "").otherwise("\n\n")
    text = F.concat(F.lit("![Figure "), n, F.lit("](u"), n, F.lit(")\n"), gap, F.lit("Figure "), n - F.when(n % 7 == 0, 1).otherwise(0), F.lit("\ntext"))
    x = L.duplicate_labels(L.explode_lines(_docs(spark, d).select("doc_id", text.alias("text"))))
    return x.where("duplicate_label").select("doc_id", F.col("line").cast("long"))


@register("confirmed_removals", f"""WITH {LINES_SQL}, l AS (SELECT *, 'u' || (doc_id % 5) AS url FROM lines),
    pairs AS (SELECT DISTINCT sha256(url) AS u, sha256(trim(text, ' ' || chr(9))) AS s FROM l WHERE line = 1 AND doc_id % 10 = 0),
    h AS (SELECT l.*, p.u IS NOT NULL AS hit, count(p.u) OVER (PARTITION BY doc_id, l.url, trim(l.text, ' ' || chr(9))) AS again FROM l LEFT JOIN pairs p ON sha256(url) = p.u AND sha256(trim(text, ' ' || chr(9))) = p.s),
    a AS (SELECT *, max(CASE WHEN hit THEN again ELSE 0 END) OVER (PARTITION BY doc_id) > 1 AS ambiguous FROM h)
    SELECT doc_id, count(*) FILTER (hit AND NOT ambiguous) AS removed, bool_or(ambiguous) AS ambiguous FROM a GROUP BY doc_id""")
def confirmed_removals(spark, d):
    x = L.explode_lines(_docs(spark, d)).withColumn("url", F.concat(F.lit("u"), F.col("doc_id") % 5))
    pairs = x.where("line = 1 AND doc_id % 10 = 0").select(sha256(F.col("url")).alias("url_sha256"), sha256(L.trim_blanks(F.col("text"))).alias("line_sha256"))
    return L.confirmed_removals(x, pairs).groupBy("doc_id").agg(F.count_if("removed").alias("removed"), F.bool_or("ambiguous").alias("ambiguous"))


def _changes(spark, d):
    before = L.explode_lines(_spaced(spark, d)).select("doc_id", "line", F.col("text").alias("before"))
    after = L.collapse_blank_runs(L.explode_lines(_spaced(spark, d))).select("doc_id", "line", F.col("text").alias("after"))
    both = before.join(after, ["doc_id", "line"], "left").where("after IS NULL OR before <> after")
    kind = F.when(F.col("after").isNull(), "delete").otherwise("normalize")
    return both.select("doc_id", F.lit("blank_runs").alias("rule_id"), kind.alias("kind"), F.col("line").cast("long"), "before", "after")


CHANGES_SQL = f"""{SPACED_SQL}, {COLLAPSED_SQL},
    ch AS (SELECT l.doc_id, 'blank_runs' AS rule_id, CASE WHEN k.text IS NULL THEN 'delete' ELSE 'normalize' END AS kind, l.line, l.text AS before, k.text AS after
           FROM lines l LEFT JOIN kept k ON l.doc_id = k.doc_id AND l.line = k.line WHERE k.text IS NULL OR l.text <> k.text),
    ledger AS (SELECT doc_id, rule_id, kind, list(line ORDER BY line) AS lines, sha256(string_agg(before, chr(10) ORDER BY line)) AS before_sha256,
                      sha256(coalesce(string_agg(after, chr(10) ORDER BY line), '')) AS after_sha256 FROM ch GROUP BY doc_id, rule_id, kind)"""


@register("change_ledger", f"WITH {CHANGES_SQL} SELECT doc_id, rule_id, kind, list_aggregate(lines, 'string_agg', ',') AS lines, before_sha256, after_sha256 FROM ledger")
def change_ledger(spark, d):
    return L.change_ledger(_changes(spark, d)).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@register("verify_changes", f"""WITH {CHANGES_SQL}, s AS (SELECT *, unnest(lines) AS line FROM ledger),
    g AS (SELECT *, line - lag(line) OVER (PARTITION BY doc_id, rule_id, kind ORDER BY line) AS step FROM s)
    SELECT 'DELETE_NOT_CONTIGUOUS' AS rule, doc_id, rule_id FROM g WHERE kind = 'delete' GROUP BY doc_id, rule_id HAVING max(step) > 1
    UNION ALL SELECT 'KIND', doc_id, rule_id FROM ledger WHERE kind <> 'delete'""")
def verify_changes(spark, d):
    kinds = spark.createDataFrame([("blank_runs", "delete")], "rule_id string, kind string")
    return L.verify_changes(L.change_ledger(_changes(spark, d)), kinds)


@register("verify_spans", f"""WITH {SPACED_SQL}, {COLLAPSED_SQL}
    SELECT 'SOURCE_HASH' AS rule, doc_id, line FROM kept WHERE line % 7 = 0 UNION ALL SELECT 'OUTPUT_HASH', doc_id, line FROM kept WHERE line % 5 = 0 UNION ALL SELECT 'VISIBLE', doc_id, line FROM kept WHERE line % 11 = 0""")
def verify_spans(spark, d):
    """An audit of which some rows are changed, checked against both texts."""
    docs = _spaced(spark, d)
    source = L.explode_lines(docs)
    kept = L.collapse_blank_runs(source)
    audit = L.span_audit(source, kept)
    changed = audit.withColumn("source_sha256", F.when(F.col("line") % 7 == 0, "x").otherwise(F.col("source_sha256"))).withColumn("out_sha256", F.when(F.col("line") % 5 == 0, "x").otherwise(F.col("out_sha256"))).withColumn("visible", F.col("visible") + F.when(F.col("line") % 11 == 0, 1).otherwise(0))
    output = docs.select("doc_id", L.joined(L.collapse_blanks(L.line_array(F.col("text")))).alias("text"))
    return L.verify_spans(changed, docs, output).select("rule", "doc_id", F.col("line").cast("long"))


@register("revert_failed", "SELECT doc_id, sha256(text) AS text_sha256, doc_id % 3 = 0 AND contains(split_part(text, chr(10), 1), 'the') AS reverted FROM documents WHERE text <> ''")
def revert_failed(spark, d):
    docs = _docs(spark, d).where("text <> ''")
    bad = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(?s)\A([^\n]*?)the", "$1THE")).otherwise(F.col("text"))
    cleaned = docs.select("doc_id", bad.alias("text"))
    checks = L.postcheck(L.explode_lines(docs), L.explode_lines(cleaned))
    x = L.revert_failed(docs, cleaned, checks)
    return x.select("doc_id", sha256(F.col("text")).alias("text_sha256"), "reverted")


@register("span_overlaps", f"""WITH {LINES_SQL}, s AS (SELECT doc_id, byte_start AS "start", CAST(byte_start + strlen(text) + CASE WHEN line % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS "end" FROM lines),
    m AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) SELECT doc_id, "start", "end" FROM m WHERE "start" < b""")
def span_overlaps(spark, d):
    longer = F.when(F.col("line") % 3 == 0, 2).otherwise(0)
    x = L.explode_lines(_docs(spark, d)).select("doc_id", F.col("byte_start").alias("start"), (F.col("byte_end") + longer).cast("long").alias("end"))
    return L.overlaps(x)


@register("span_audit", f"""WITH {SPACED_SQL}, {COLLAPSED_SQL},
    o AS (SELECT doc_id, line, text AS out, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start FROM kept)
    SELECT doc_id, count(*) AS n, CAST(sum(byte_start * line) AS BIGINT) AS a, CAST(sum(out_start * line) AS BIGINT) AS b, CAST(sum(len(regexp_replace(out, '[\\s ]+', '', 'g'))) AS BIGINT) AS visible, count(*) FILTER (out LIKE '%  ') AS breaks
    FROM lines JOIN o USING (doc_id, line) GROUP BY doc_id""")
def span_audit(spark, d):
    source = L.explode_lines(_spaced(spark, d))
    x = L.span_audit(source, L.collapse_blank_runs(source))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("byte_start") * F.col("line")).alias("a"), F.sum(F.col("out_start") * F.col("line")).alias("b"), F.sum("visible").alias("visible"), F.count_if("hard_break").alias("breaks"))


@register("postcheck", "SELECT doc_id, NOT (doc_id % 3 = 0 AND regexp_replace(split_part(text, chr(10), 1), 'the', 'THE') <> split_part(text, chr(10), 1)) AS ok FROM documents WHERE text <> ''")
def postcheck(spark, d):
    source = L.explode_lines(_docs(spark, d))
    broken = F.when((F.col("doc_id") % 3 == 0) & (F.col("line") == 1), F.regexp_replace("text", "the", "THE")).otherwise(F.col("text"))
    return L.postcheck(source, source.withColumn("text", broken))


@register("verify_audit", f"""WITH {LINES_SQL} SELECT 'SPAN_OUTSIDE' AS rule, doc_id, byte_start AS "start", CAST(byte_start + strlen(text) AS BIGINT) AS "end" FROM lines WHERE doc_id % 4 = 0 AND line > 2""")
def verify_audit(spark, d):
    spans = L.explode_lines(_docs(spark, d)).select("doc_id", "line", F.col("byte_start").alias("start"), F.col("byte_end").cast("long").alias("end"))
    held = spans.where("doc_id % 4 <> 0 OR line <= 2").groupBy("doc_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return L.verify_audit(spans.drop("line"), held)


@register("match_template", f"""WITH documents AS (SELECT doc_id, text || chr(10) || 'foot' || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'B' ELSE CAST(doc_id AS VARCHAR) END || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' AS text FROM main.documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'FINGERPRINT_MISMATCH' END AS template FROM documents""")
def match_template(spark, d):
    n = F.col("doc_id")
    foot = F.when(n % 4 == 0, "").when(n % 4 == 1, "B").otherwise(n.cast("string"))
    docs = _docs(spark, d).select("doc_id", F.concat("text", F.lit("\nfoot"), foot, F.lit("\na\nb\nc")).alias("text"))
    known = spark.createDataFrame([("A", 1, "foot\na\nb\nc"), ("B", 2, "footB\na\nb\nc")], "name string, ord int, tail string").select("name", "ord", sha256(F.col("tail")).alias("sha256"))
    return L.match_template(L.explode_lines(docs), small(known))


CSS = "* {margin: 0}"
ICONS = "data:image/svg+xml" * 5


@register("match_export", """SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'FINGERPRINT_MISMATCH' WHEN doc_id % 6 = 2 THEN 'FINGERPRINT_MISMATCH' WHEN doc_id % 6 = 3 THEN 'FINGERPRINT_MISMATCH' WHEN doc_id % 2 = 0 THEN 'square' ELSE 'round' END AS template FROM documents""")
def match_export(spark, d):
    """Documents in the envelope of an exported page; of six, one has another rule in its header, one another link, one an icon less."""
    n, text = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    icons = F.when(n == 3, ICONS[: -len("data:image/svg+xml")]).otherwise(ICONS)
    css = F.when(n == 1, "other").otherwise(CSS)
    link = F.concat(F.lit("> from: [https://h/"), text, F.lit("](https://h/"), text, F.when(n == 2, "x").otherwise(""), F.lit(")"))
    foot = F.when(n % 2 == 0, "square").otherwise("round")
    lines = (F.concat(F.lit("     Title "), css), F.lit(""), F.lit("Title"), F.lit("===="), F.lit(""), F.lit("original me 2024-01-02 03:04 here"), F.lit(""), link, F.col("text"), F.lit(""), foot, F.lit(""), icons)
    whole = F.concat(*(x for line in lines for x in (line, F.lit("\n"))))
    hashes = [(name, 4, 5, hashlib.sha256(f"\n{name}\n\n{ICONS}".encode()).hexdigest()) for name in ("square", "round")]
    return _docs(spark, d).select("doc_id", L.match_export(whole, hashlib.sha256(CSS.encode()).hexdigest(), hashes).alias("template"))


@register("drop_preamble", r"""SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 2 THEN 'lead' || chr(10) || text ELSE CASE doc_id % 3 WHEN 0 THEN '# Title' || chr(10) ELSE 'Long title' || chr(10) || '====' || chr(10) END || text END) AS clean_sha256 FROM documents""")
def drop_preamble(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "share\nlead\n# Title\n").when(F.col("doc_id") % 3 == 1, "share\nLong title\n====\n").otherwise("lead\n")
    return _docs(spark, d).select("doc_id", sha256(L.drop_preamble(F.concat(head, "text"))).alias("clean_sha256"))


BOIL = "|".join(f"(?:{p})" for p in LINE_PATTERNS)


@register("strip_boilerplate", f"SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{BOIL}')), 'string_agg', chr(10)), ''), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')) AS clean_sha256 FROM documents")
def strip_boilerplate(spark, d):
    return _docs(spark, d).select("doc_id", sha256(L.strip_boilerplate(F.col("text"), LINE_PATTERNS)).alias("clean_sha256"))


@register("clean_card", r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?i)<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '!\[([^\]]*)\]\(([^) ]+)[^)]*\)', ' ', 'g'), 'https?://[^ )]+', ' ', 'g'), '[a-z.*]+\{[^}]*\}', ' ', 'g'), '[ \t\n]+', ' ', 'g'))) AS card_sha256 FROM pages""")
def clean_card(spark, d):
    return table(spark, d, "pages").select("page_id", sha256(L.clean_card(F.col("html"))).alias("card_sha256"))


@register("clean_book", r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(html, '<[^>]+>', ' ', 'g'), chr(10)), lambda x: NOT contains(lower(x), 'all rights reserved')) AS l FROM pages),
    j AS (SELECT page_id, array_to_string(list_transform(l, lambda x, i: x || CASE WHEN i = len(l) OR (length(x) = 1 AND length(l[i + 1]) = 1 AND i + 1 < len(l)) THEN '' ELSE chr(10) END), '') AS t FROM p)
    SELECT page_id, sha256(trim(regexp_replace(coalesce(t, ''), '\n{3,}', chr(10) || chr(10), 'g'))) AS book_sha256 FROM j""")
def clean_book(spark, d):
    return table(spark, d, "pages").select("page_id", sha256(L.clean_book(F.col("html"))).alias("book_sha256"))


@register("doc_gate", "SELECT doc_id FROM documents WHERE length(text) >= 500 AND len(regexp_extract_all(text, '[éèäöüñ]')) >= 50")
def doc_gate(spark, d):
    return L.doc_gate(table(spark, d, "documents"), 500, "[éèäöüñ]", 50).select("doc_id")


@register("smart_slice", """SELECT doc_id, sha256(CASE WHEN length(text) <= 200 THEN text WHEN cut_at > 100 THEN substr(text, 1, cut_at) ELSE substr(text, 1, 200) END) AS cut_sha256
    FROM (SELECT *, greatest(201 - instr(reverse(substr(text, 1, 200)), '.') - CASE WHEN contains(substr(text, 1, 200), '.') THEN 0 ELSE 2000 END,
          201 - instr(reverse(substr(text, 1, 200)), '!') - CASE WHEN contains(substr(text, 1, 200), '!') THEN 0 ELSE 2000 END) AS cut_at FROM documents)""")
def smart_slice_(spark, d):
    return _docs(spark, d).select("doc_id", sha256(smart_slice(F.col("text"), 200, ".!")).alias("cut_sha256"))


@register("eligibility", """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'BAD_MODE' WHEN doc_id % 13 = 0 THEN 'BAD_CONFIG' WHEN doc_id % 7 = 0 THEN 'HAS_CR' WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'NO_FINAL_LF' END AS warning FROM documents""")
def eligibility(spark, d):
    n = F.col("doc_id")
    text = F.concat(F.rtrim("text", F.lit("\n")), F.when(n % 7 == 0, "\r\n").when(n % 3 == 0, "\n").otherwise(""))
    mode = F.when(n % 5 == 4, "other").when(n % 2 == 0, "strict").otherwise("loose")
    return _docs(spark, d).select("doc_id", L.eligibility(text.cast("binary"), mode, configured=n % 13 != 0).alias("warning"))
