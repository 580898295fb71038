"""A stored inverted index, appended version by version, and top-k search in it.

A version numbers its documents in shards of bounded size and tokenises each text
once. Its postings lie in one folder per bucket of terms; a row holds the postings
of a term in one block of a shard's documents, with the block's largest impact. A
search reads the buckets of its terms only. Each shard is one task's work: the sums
of block maxima bound what a block's documents can score, so blocks are taken by
falling bound until no other can reach the k best.

    path/documents/version=V    shard, at, doc_id, title
    path/postings/version=V/bucket=B    term, shard, block, most, at[], impact[]
    path/gone/version=V    documents of earlier versions that came again: since, shard, at
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corploom.functions.arrays import let
from corploom.functions.text import nfkc, normalize_text
from corploom.session import small

#: Documents of a shard, about, and of a block.
SHARD, BLOCK = 1 << 15, 128
#: Shards over which a small version spreads, of a few documents at least.
SPREAD, FEW = 64, 128
#: Folders of terms.
BUCKETS = 64
#: Queries searched for in one pass over the index.
QUERIES = 2_000
#: Code points from which a whole text counts by its digest.
LONG = 64
#: Blocks scored at a time.
TAKEN = 16


def tokenize(text: Column, compatible: bool = False) -> Column:
    """The distinct tokens of a normalised text: all of it, its words, and of runs of Han letters also the bigrams.

    ``compatible``: of its NFKC form, by an Arrow UDF. The whole text is a token,
    so a query finds fields that say just that; a long one counts by its digest.
    """

    def tokens(plain: Column) -> Column:
        whole = F.when(F.length(plain) > LONG, F.concat(F.lit("="), F.sha2(plain, 256))).otherwise(plain)
        words = F.filter(F.concat(F.array(whole), F.split(plain, " ", -1)), lambda x: x != "")
        runs = F.when(F.rlike(plain, F.lit(r"\p{IsHan}{2}")), F.regexp_extract_all(plain, F.lit(r"\p{IsHan}{2,}"), 0)).otherwise(F.array().cast("array<string>"))
        bigrams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
        return F.array_distinct(F.concat(words, bigrams))

    # Bound once: each of its uses would normalise the text again.
    plain = normalize_text(nfkc(text) if compatible else text)
    return F.when(text.isNotNull(), let(plain, tokens))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _weighed(field: Column, weight: int) -> Column:
    tokens = F.coalesce(tokenize(field), F.array().cast("array<string>"))
    return F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def add_version(docs: DataFrame, weights: Sequence[tuple[str, int]], path: str, version: int, buckets: int = BUCKETS, shard: int = SHARD) -> None:
    """Adds stored ``docs`` (doc_id, title, the fields of ``weights``) to the index at ``path`` under a new, higher version.

    A term counts once a field. A document whose id an earlier version has takes
    its place. Null fields have no terms; documents without any, and null ids,
    are kept but never found or replaced. The versions before aren't rewritten.
    """
    spark = docs.sparkSession
    fields = [f for f, _ in weights]
    n = docs.count()
    shards = max(1, -(-n // min(shard, max(FEW, n // SPREAD))))
    # Dealt by content, so both tables below have the same shards, and numbered there; rows of one title and id are alike to them.
    own = F.pmod(F.xxhash64("doc_id", "title", *fields), F.lit(shards)).alias("shard")
    dealt = docs.select(own, *(F.col(c) for c in dict.fromkeys(["doc_id", "title", *fields]))).repartition("shard")
    at = (F.row_number().over(Window.partitionBy("shard").orderBy(F.col("title").cast("string"), "doc_id")) - 1).alias("at")
    terms = F.flatten(F.array(*(_weighed(F.col(f), w) for f, w in weights)))
    rows = dealt.select("*", at).select("shard", "at", "doc_id", F.col("title").cast("string").alias("title"), terms.alias("_terms"))
    rows.select("shard", "at", "doc_id", "title").write.mode("errorifexists").parquet(f"{path}/documents/version={version}")

    impacts = rows.select("shard", "at", F.inline("_terms")).groupBy("shard", "term", "at").agg(F.sum("w").cast("int").alias("w"))
    block = F.expr(f"at div {BLOCK}").cast("int").alias("block")
    lists = impacts.groupBy("shard", "term", block).agg(F.max("w").alias("most"), F.array_sort(F.collect_list(F.struct("at", "w"))).alias("_p"))  # a block's rows
    postings = lists.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "shard", "block", "most", F.col("_p.at").alias("at"), F.col("_p.w").alias("impact"))
    ordered = postings.repartition("bucket", F.pmod("shard", F.lit(16))).sortWithinPartitions("bucket", "term", "shard", "block")
    ordered.write.partitionBy("bucket").mode("errorifexists").parquet(f"{path}/postings/version={version}")

    known = spark.read.parquet(f"{path}/documents").where(F.col("version") < version)
    again = spark.read.parquet(f"{path}/documents").where(F.col("version") == version).select("doc_id").distinct()
    gone = known.join(again, "doc_id", "left_semi").select(F.lit(version).alias("since"), F.col("version").alias("of"), "shard", "at")
    gone.write.mode("errorifexists").parquet(f"{path}/gone/version={version}")


def index_postings(spark: SparkSession, path: str, buckets: Sequence[int], upto: int | None = None) -> DataFrame:
    """Postings of some buckets, of the versions up to one; other buckets' files aren't opened."""
    found = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted(set(buckets))))
    return found if upto is None else found.where(F.col("version") <= upto)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, least: int = 1, upto: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, doc_id, score, rank): for each of ``queries`` (query_id, query) the k best documents.

    Score: the weights of the fields with the query's tokens, summed; ``least`` at
    least. Order: score falling, title, id. Queries without tokens find nothing.
    ``upto`` searches as of an earlier version. Queries go to the tasks
    ``QUERIES`` at a time, the shards' k best come back.
    """
    found, page = None, []
    asked = queries.select("query_id", tokenize(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    for r in asked.toLocalIterator():
        page.append((r["query_id"], list(r["terms"])))
        if len(page) == QUERIES:
            found, page = _both(found, _page(spark, path, page, queries, k, least, upto, buckets)), []
    if page or found is None:
        found = _both(found, _page(spark, path, page, queries, k, least, upto, buckets))
    # Ties may go on in other shards, so all of them wait for their titles.
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    best = found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    docs = spark.read.parquet(f"{path}/documents")
    named = best.join(docs, ["version", "shard", "at"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "title", "doc_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def _both(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.union(b)


def _page(spark: SparkSession, path: str, page: list[tuple], queries: DataFrame, k: int, least: int, upto: int | None, buckets: int) -> DataFrame:
    """(query_id, version, shard, at, score): each shard's k best for each query of a page."""
    kind = queries.schema["query_id"].dataType.simpleString()
    arrow_kind = queries.select("query_id").limit(0).toArrow().schema.field(0).type
    terms = sorted({t for _, ts in page for t in ts})
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "t int, term string")
    wanted = [r[0] for r in asked.select(bucket_of(F.col("term"), buckets)).distinct().collect()]  # at most ``buckets``
    held = index_postings(spark, path, wanted, upto).join(small(asked, 10_000_000), "term").select("version", "shard", "t", "block", "most", "at", "impact")
    gone = spark.read.parquet(f"{path}/gone").where(F.lit(True) if upto is None else F.col("since") <= upto)
    gone = gone.groupBy(F.col("of").alias("version"), "shard").agg(F.collect_set("at").alias("at"))  # of one shard
    marks = gone.select("version", "shard", F.lit(-1).alias("t"), F.lit(0).alias("block"), F.lit(0).alias("most"), "at", F.array().cast("array<int>").alias("impact"))
    places = {t: i for i, t in enumerate(terms)}
    asks = [(q, np.array([places[t] for t in ts], np.int64)) for q, ts in page]
    shared = spark.sparkContext.broadcast(asks)

    def run(table: pa.Table) -> pa.Table:
        q, at, score = best_of_shard(table, shared.value, k, least)
        n = len(q)
        ids = [shared.value[i][0] for i in q]
        return pa.table({"query_id": pa.array(ids, arrow_kind), "version": pa.array([table["version"][0].as_py()] * n, pa.int32()), "shard": pa.array([table["shard"][0].as_py()] * n, pa.int64()), "at": pa.array(at, pa.int32()), "score": pa.array(score, pa.int64())})

    return held.unionByName(marks).groupBy("version", "shard").applyInArrow(run, f"query_id {kind}, version int, shard long, at int, score long")


def best_of_shard(table: pa.Table, asks: Sequence[tuple[object, np.ndarray]], k: int, least: int) -> tuple[list[int], list[int], list[int]]:
    """Of one shard's postings: (query's place, at, score) of each query's k best, ties by ``at``."""
    term = table["t"].to_numpy()
    lists = table["at"].combine_chunks()
    dead = np.array([x for i in np.flatnonzero(term < 0).tolist() for x in lists[i].as_py()], np.int64)
    rows = np.flatnonzero(term >= 0)
    order = rows[np.lexsort((table["block"].to_numpy()[rows], term[rows]))]
    held = table.select(["at", "impact"]).take(pa.array(order)).combine_chunks()
    term, block, most = term[order], table["block"].to_numpy()[order].astype(np.int64), table["most"].to_numpy()[order].astype(np.int64)
    sizes = held["at"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at, impact = (held[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("at", "impact"))
    impact[np.isin(at, dead)] = 0
    terms, first = np.unique(term, return_index=True)
    last = np.append(first[1:], len(term))
    known = {t: i for i, t in enumerate(terms.tolist())}
    n_blocks = int(block.max()) + 1 if len(block) else 0
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for q, (_, wanted) in enumerate(asks):
        mine = [known[t] for t in wanted.tolist() if t in known]
        if not mine:
            continue
        those = np.concatenate([np.arange(first[i], last[i]) for i in mine])
        bound = np.bincount(block[those], most[those], n_blocks).astype(np.int64)
        by_bound = np.argsort(-bound, kind="stable")
        by_bound = by_bound[bound[by_bound] >= max(1, least)]
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, len(by_bound), TAKEN):
            some = by_bound[start : start + TAKEN]
            if len(best) == k and bound[some[0]] < best[-1]:
                break  # no document of the blocks left reaches the k best
            local = np.full(n_blocks, -1)
            local[some] = np.arange(len(some))
            rows = those[local[block[those]] >= 0]
            size = sizes[rows]
            run = np.repeat(np.arange(len(rows)), size)
            entry = begin[rows][run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
            score = np.bincount(local[block[rows]][run] * BLOCK + at[entry] % BLOCK, impact[entry], len(some) * BLOCK).astype(np.int64)
            good = np.flatnonzero(score >= max(1, least))
            best_at, best = np.concatenate([best_at, some[good // BLOCK] * BLOCK + good % BLOCK]), np.concatenate([best, score[good]])
            keep = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[keep], best[keep]
        out[0].extend([q] * len(best))
        out[1].extend(best_at.tolist())
        out[2].extend(best.tolist())
    return out
