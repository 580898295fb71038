"""Data-quality checks; each returns violation rows (rule, key, ...), none collects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_contract(rows: DataFrame, key: str, rules: Sequence[tuple[str, str, object]]) -> DataFrame:
    """(rule, key, path, message) for rules (column, kind, argument); kinds: type, required, min_length, regex, enum, range, nullable.

    A null breaks min_length, regex, enum and range, unless the column is
    nullable. A column that is not there, not named by any rule, or of another
    type than its type rule says (as Spark names it), is a violation of the
    schema: one row with a null key.
    """
    known = set(rows.columns)
    nullable = {c for c, kind, _ in rules if kind == "nullable"}
    checks = []
    for column, kind, arg in rules:
        if column not in known or kind in ("type", "nullable"):
            continue
        c = F.col(column)
        bad = {
            "required": lambda c=c: c.isNull(),
            "min_length": lambda c=c, arg=arg: F.length(c.cast("string")) < arg,
            "regex": lambda c=c, arg=arg: ~F.rlike(c.cast("string"), F.lit(arg)),
            "enum": lambda c=c, arg=arg: ~c.isin(*arg),
            "range": lambda c=c, arg=arg: ~c.between(*arg),
        }[kind]()
        bad = F.coalesce(bad, F.lit(column not in nullable))
        checks.append(F.when(bad, F.struct(F.lit(kind).alias("rule"), F.lit(column).alias("path"), F.lit(f"{column}: {kind} {arg}").alias("message"))))
    found = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*checks) if checks else F.array().cast("array<struct<rule:string,path:string,message:string>>"))).alias("v")).select("v.rule", "key", "v.path", "v.message")
    named = {c for c, _, _ in rules} | {key}
    schema = [("missing_column", c) for c in sorted(named - known)] + [("unknown_column", c) for c in sorted(known - named)]
    schema += [("type", c) for c, kind, arg in rules if kind == "type" and c in known and rows.schema[c].dataType.simpleString() != arg]
    if not schema:
        return found
    extra = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(None).cast("string").alias("key"), F.lit(c).alias("path"), F.lit(r).alias("message")) for r, c in schema)))
    return found.unionByName(rows.sparkSession.range(1).select(extra.alias("v")).select("v.*"))


def unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_increasing(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before, by order within the group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).where(F.col(value) <= F.col("before"))


def ready_gate(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, rule) for each ready row and rule that doesn't hold."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules)))
    return rows.where("status = 'ready'").select(key, F.explode(broken).alias("rule"))


def flatten_claims(rows: DataFrame, key: str, single: Sequence[str], many: Sequence[str]) -> DataFrame:
    """(key, path, claim) from claim columns and claim arrays."""
    ones = [F.array(F.struct(F.lit(c).alias("path"), F.col(c).alias("claim"))) for c in single]
    kind = rows.schema[single[0]].dataType if single else rows.schema[many[0]].dataType.elementType
    none = F.array().cast(f"array<struct<path:string,claim:{kind.simpleString()}>>")

    def listed(c: str) -> Column:
        return F.coalesce(F.transform(c, lambda x, i: F.struct(F.concat(F.lit(c + "["), i.cast("string"), F.lit("]")).alias("path"), x.alias("claim"))), none)

    found = F.filter(F.concat(none, *ones), lambda x: x["claim"].isNotNull())
    return rows.select(key, F.inline(F.concat(found, *map(listed, many))))


def redaction_check(rows: DataFrame, key: str, hidden: Sequence[str] = ("author", "url", "published_at", "fingerprint")) -> DataFrame:
    """(key, path) for each field that a redacted row still shows."""
    shown = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), c) for c in hidden)))
    return rows.where("status = 'redacted'").select(key, F.explode(shown).alias("path"))


def check_claims(claims: DataFrame, refs: DataFrame, statuses: Sequence[str] = ("source_statement", "cross_source_consensus", "independently_verified")) -> DataFrame:
    """(claim_id, rule): the first rule in order that each claim breaks.

    ``claims``: claim_id, text, claim_status; ``refs``: claim_id, source_id, kind,
    ord, verdict (of the resolve operators). In order: the id and status are
    valid; a text needs a reference; every reference is OK, else the verdict of
    the first that isn't; a consensus needs two sources, a verified claim an
    OK verification record.
    """
    grouped = refs.groupBy("claim_id").agg(
        F.count("*").alias("_n"),
        F.min_by("verdict", "ord").alias("_any"),
        F.min(F.when(F.col("verdict") != "OK", F.struct("ord", "verdict"))).alias("_bad"),
        F.count_distinct("source_id").alias("_sources"),
        F.count_if((F.col("kind") == "verification_record") & (F.col("verdict") == "OK")).alias("_verified"),
    )
    status = F.col("claim_status")
    rules = [
        ("CLAIM_ID", F.coalesce(F.col("claim_id").cast("string"), F.lit("")) == ""),
        ("STATUS", ~F.coalesce(status.isin(*statuses), F.lit(False))),
        ("NO_REFS", (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("_n", F.lit(0)) == 0)),
        (F.col("_bad.verdict"), F.col("_bad").isNotNull()),
        ("QUORUM", (status == "cross_source_consensus") & (F.coalesce("_sources", F.lit(0)) < 2)),
        ("VERIFICATION", (status == "independently_verified") & (F.coalesce("_verified", F.lit(0)) == 0)),
    ]
    return first_failing(claims.join(grouped, "claim_id", "left"), "claim_id", rules)


def first_failing(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, rule): the first rule in order that fails; rows without one are left out."""
    rule = F.coalesce(*(F.when(bad, name) for name, bad in rules))
    return rows.select(key, rule.alias("rule")).where("rule IS NOT NULL")


def embedded_meta(text: Column, name: str, schema: str) -> Column:
    """JSON in an HTML comment '<!-- name: {...} -->'; null if it is missing or bad."""
    said = F.regexp_extract(text, rf"<!-- {name}: (\{{.*?\}}) -->", 1)
    return F.when(said != "", F.from_json(said, schema, {"mode": "PERMISSIVE"}))


def external_refs(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts of patterns per page, whether doctype and html are missing, and network calls inside inline scripts."""
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script>(.*?)</script>"), 1), "\n")
    counts = [F.regexp_count("html", F.lit(p)).cast("long").alias(label) for label, p in rules]
    return pages.select("page_id", *counts, (~F.startswith(F.lower(F.trim("html")), F.lit("<!doctype html"))).alias("no_doctype"), (~F.contains("html", F.lit("</html>"))).alias("no_html"), F.regexp_count(scripts, F.lit(r"fetch\(|XMLHttpRequest|track\(")).cast("long").alias("calls"))


def secret_scan(docs: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(doc_id, label) for each credential pattern that occurs."""
    hits = F.array_compact(F.array(*(F.when(F.rlike("text", F.lit(p)), label) for label, p in rules)))
    return docs.select("doc_id", F.explode(hits).alias("label"))


def strict_gate(rows: DataFrame, key: str) -> DataFrame:
    """One row: whether the run fails, and the first id that needs review."""
    first = F.min(F.when(F.col("status") == "needs_review", F.col(key)))
    return rows.agg(first.isNotNull().alias("failed"), first.alias("first_id"))


def relation_checks(edges: DataFrame, nodes: DataFrame, symmetric: Sequence[str]) -> DataFrame:
    """(rule, from, to): loops, edges with an end that doesn't exist, symmetric edges without their counterpart."""
    loops = edges.where(F.col("from") == F.col("to")).select(F.lit("SELF").alias("rule"), "from", "to")
    known = lambda end: nodes.select(F.col("id").alias(end)).distinct().withColumn(f"_{end}", F.lit(True))
    ends = edges.join(known("from"), "from", "left").join(known("to"), "to", "left")
    dangling = ends.where("_from IS NULL OR _to IS NULL").select(F.lit("DANGLING").alias("rule"), "from", "to")
    sym = edges.where(F.col("type").isin(*symmetric) & (F.col("from") != F.col("to")))
    back = sym.select(F.col("to").alias("from"), F.col("from").alias("to"), "type")
    lone = sym.join(back, ["from", "to", "type"], "left_anti").select(F.lit("UNPAIRED").alias("rule"), "from", "to")
    return loops.unionByName(dangling).unionByName(lone)


def one_canonical(rows: DataFrame, model: str, canonical: str) -> DataFrame:
    """Ready models without exactly one canonical row."""
    return rows.where("status = 'ready'").groupBy(model).agg(F.count_if(canonical).alias("n_canonical")).where("n_canonical <> 1")
