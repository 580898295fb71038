"""Queries on sources, sinks, streams and caller-supplied cleaners."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corploom.functions.text import sha256
from corploom.operators.apply import apply_cleaner
from corploom.plans.cleaning import BOIL
from corploom.plans.fields import CLASSIFY_SQL
from corploom.plans.registry import register
from corploom.session import checkpoint_dir
from corploom.sources import keyed as V
from corploom.sources import readers as R
from corploom.sources import sinks as K
from corploom.sources.tables import table
from corploom.streaming import ingest as G


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("scan_corpus", "SELECT doc_id FROM documents WHERE doc_id % 8 <> 3")
def scan_corpus(spark, d):
    """Documents written as text files of a bounded number of rows; folders with 'draft' in their name are excluded."""
    base = _folder(spark, "corpus")
    number = F.col("doc_id")
    book = F.concat(F.when(number % 8 == 3, "draft-").otherwise("book-"), F.floor(number / 500).cast("string"))
    table(spark, d, "documents").select(book.alias("book"), F.concat_ws("\t", "doc_id", F.translate("text", "\n\r", "  ")).alias("value")).repartition("book").write.partitionBy("book").text(base, lineSep="\n")
    files = R.scan_corpus(spark, base, ".txt", exclude=["draft"])
    lines = files.select(F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''")
    return lines.select(F.substring_index("line", "\t", 1).cast("long").alias("doc_id"))


@register("json_docs", "SELECT r_name, r_regionkey, FALSE AS bad FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 'bad files', CAST(count(*) AS INTEGER), TRUE FROM region WHERE r_regionkey = 3")
def json_docs(spark, d):
    """One JSON file per region; bad ones are left out and counted."""
    base = _folder(spark, "json")
    region = table(spark, d, "region").repartition(5, "r_regionkey").withColumn("_part", F.col("r_regionkey"))
    body = F.when(F.col("r_regionkey") == 3, "{bad").otherwise(F.to_json(F.struct("r_name", "r_regionkey")))
    region.select("_part", body.alias("value")).write.partitionBy("_part").text(base)
    rows, bad = R.scan_json_docs(spark, f"{base}/*", "r_name string, r_regionkey int")
    counted = bad.agg(F.lit("bad files").alias("r_name"), F.count("*").cast("int").alias("r_regionkey"))
    return rows.select("r_name", "r_regionkey", F.lit(False).alias("bad")).union(counted.withColumn("bad", F.lit(True)))


@register("jsonl_strict", "SELECT CASE WHEN event_id % 20 = 0 THEN 'EMPTY_LINE' WHEN event_id % 7 = 0 THEN 'BAD_JSON' ELSE 'OK' END AS code, count(*) AS n, CAST(sum(CASE WHEN event_id % 20 <> 0 AND event_id % 7 <> 0 THEN CAST(props->>'k' AS BIGINT) END) AS BIGINT) AS k FROM events GROUP BY 1")
def jsonl_strict(spark, d):
    n = F.col("event_id")  # files of 1,000 events
    line = F.when(n % 20 == 0, "").when(n % 7 == 0, F.lit("{k")).otherwise(F.col("props"))
    files = table(spark, d, "events").select(F.floor(n / 1_000).alias("file"), n, line.alias("line")).groupBy("file").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
    x = R.jsonl_lines(files, "k long")
    return x.groupBy(F.coalesce("code", F.lit("OK")).alias("code")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("code").isNull(), F.col("row.k"))).alias("k"))


@register("json_array", "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS n_accepted, CAST(sum(i) FILTER (o_totalprice > 100000) AS BIGINT) AS places FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY o_custkey")
def json_array(spark, d):
    entry = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    arrays = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("text"))
    rows = R.scan_json_array(arrays, "id long, price double", F.col("entry.price") > 100000, keep=["o_custkey"])
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.sum(F.when(F.col("accepted"), F.col("index"))).cast("long").alias("places"))


@register("taxonomy_tags", "SELECT r_name AS title, CAST(count(n_name) AS BIGINT) AS n_tags, CAST(count(n_name) FILTER (n_nationkey % 2 = 0) AS BIGINT) AS n_parts FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def taxonomy_tags(spark, d):
    part = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").alias("order"), F.col("n_name").alias("title"))
    tags = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("allowed_tags"), F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, part)).alias("subchapters"))
    chapter = F.struct(F.col("r_regionkey").cast("string").alias("id"), F.col("r_regionkey").alias("order"), F.col("r_name").alias("title"), "allowed_tags", "subchapters")
    text = table(spark, d, "region").join(tags, "r_regionkey", "left").agg(F.to_json(F.struct(F.collect_list(chapter).alias("chapters"))).alias("text"))  # a rule table of fixed size
    chapters, listed, parts = R.load_taxonomy(text)
    counted = parts.groupBy(F.col("chapter_id").alias("id")).agg(F.count("*").alias("n_parts"))
    return chapters.join(listed, "id", "left").groupBy("id", "title").agg(F.count("tag").alias("n_tags")).join(counted, "id", "left").select("title", "n_tags", F.coalesce("n_parts", F.lit(0)).cast("long").alias("n_parts"))


@register("markup_text", r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n]+', ' ', 'g')) AS part FROM pages)
    SELECT CAST(floor(page_id / 200) AS BIGINT) AS book, sha256(string_agg(part, chr(10) || '---' || chr(10) ORDER BY page_id)) AS text_sha256 FROM p WHERE length(part) > 100 GROUP BY 1""")
def markup_text(spark, d):
    x = R.extract_markup_text(table(spark, d, "pages").withColumn("book", F.floor(F.col("page_id") / 200)), "book", "page_id")
    return x.select("book", sha256(F.col("text")).alias("text_sha256"))


@register("canonical_json", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"' || lang || '"' END || ',"source":"' || source || '"}') AS json_sha256 FROM documents""")
def canonical_json(spark, d):
    x = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 2 == 1, F.col("lang")).alias("lang"), "doc_id")
    return x.select("doc_id", sha256(K.canonical_json(x)).alias("json_sha256"))


@register("write_models", "SELECT category, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM (SELECT p_name, max(p_partkey) AS p_partkey, arg_max(p_type, p_partkey) AS category FROM part GROUP BY p_name) GROUP BY category")
def write_models(spark, d):
    base = _folder(spark, "models")
    K.write_models(table(spark, d, "part").select("p_name", "p_partkey", F.col("p_type").alias("category")), base, "p_name", "p_partkey")
    return spark.read.parquet(base).groupBy("category").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@register("publish_and_read", "SELECT count(*) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, 0 AS n_violations, TRUE AS same_run, count(*) AS n_reported FROM documents")
def publish_and_read(spark, d):
    """Whole documents published, published again (the same run), and read back against the catalog."""
    base = _folder(spark, "run")
    docs = table(spark, d, "documents")
    first, again = K.publish_run(docs, "doc_id", base), K.publish_run(K.redealt(docs), "doc_id", base)
    rows, violations = K.read_current_run(spark, base, "doc_id")
    report = spark.read.parquet(f"{base}/runs/{first}/report").select(F.col("n_rows").alias("n_reported"))
    counted = rows.agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("text")).alias("n_bytes"))
    return counted.crossJoin(violations.agg(F.count("*").cast("int").alias("n_violations"))).crossJoin(report).withColumn("same_run", F.lit(first == again))  # one row each


@register("ingest_stream", rf"""WITH cut AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{BOIL}')) AS l FROM documents),
    joined AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(array_to_string(l, chr(10)), ''), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS text FROM cut),
    documents AS (SELECT min(doc_id) AS doc_id, text FROM joined WHERE length(text) >= 120 GROUP BY text), {CLASSIFY_SQL}
    SELECT chapter, count(*) AS n FROM classes GROUP BY chapter""")
def ingest_stream(spark, d):
    """Documents arrive in four batches; what a batch or an earlier one has already is dropped."""
    source, catalog, marks = (_folder(spark, x) for x in ("arriving", "catalog", "marks"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    files = G.write_arrivals(docs, source, 4, "doc_id")
    G.ingest_stream(spark, source, catalog, marks, docs.schema, files_per_batch=files).awaitTermination()
    return spark.read.parquet(catalog).groupBy("chapter").agg(F.count("*").alias("n"))


@register("apply_cleaner", "SELECT doc_id, substr(text, 1, 20) AS head, length(text) AS n FROM documents")
def apply_cleaner_(spark, d):
    return apply_cleaner(table(spark, d, "documents"), lambda key, text: {"doc_id": key, "head": text[:20], "n": len(text)}, "doc_id long, head string, n long")


@register("dedup_stream", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def dedup_stream(spark, d):
    """Events as a stream of four batches: a user's repeats of an event type are dropped, also those of earlier batches."""
    source, out, marks = (_folder(spark, x) for x in ("events", "fresh", "marks"))
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    files = G.write_arrivals(events, source, 4, "event_id")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source).withColumn("fingerprint", F.concat_ws("|", "user_id", "event_type"))
    fresh = G.dedup_stream(rows, late="36500 days")  # no state ends
    query = G.start_with_state(fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True), spark)
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@register("upsert_keyed", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT -1 - c_custkey, 'CAME IN', c_acctbal FROM customer WHERE c_custkey % 7 = 0")
def upsert_keyed(spark, d):
    """All customers kept by key ranges; updates and new rows rewrite the ranges that they fall into."""
    base = f"{_folder(spark, 'keyed')}/customers"
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    V.write_keyed(rows, base, ["c_custkey"])
    changed = rows.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW"))
    new = rows.where("c_custkey % 7 = 0").select((-1 - F.col("c_custkey")).cast(rows.schema["c_custkey"].dataType).alias("c_custkey"), F.lit("CAME IN").alias("c_mktsegment"), "c_acctbal")
    V.upsert_keyed(spark, base, changed.union(new), ["c_custkey"])
    return spark.read.parquet(base).drop(V.RANGE)


@register("version_diff", "SELECT doc_id, CASE WHEN doc_id % 89 = 0 THEN 'removed' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 89 = 0 OR doc_id % 97 = 0 UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 83 = 0")
def version_diff(spark, d):
    """Two versions of whole documents, compared from the roots of their hash trees."""
    old, new = (_folder(spark, x) for x in ("version", "version"))
    docs = table(spark, d, "documents")
    kept = docs.where("doc_id % 89 <> 0").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = docs.where("doc_id % 83 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    V.write_version(docs, old, ["doc_id"])
    V.write_version(kept.union(added), new, ["doc_id"])
    return V.version_diff(spark, old, new, docs.select("doc_id").schema)
