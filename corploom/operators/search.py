"""Search over an inverted index, and rule-based routing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.operators.search_index import add_version, search_index, tokenize
from corploom.session import checkpoint_dir

__all__ = ["match_route", "render_prompt", "search", "tokenize"]

#: Queries, and their different terms, up to which documents are scanned and not indexed.
FEW_QUERIES, FEW_TERMS = 1_000, 20_000
#: Documents scored at a time, and hits that a task holds before it keeps the best.
SCORED, HELD = 256, 1 << 17


def search(docs: DataFrame, queries: DataFrame, weights: Sequence[tuple[str, int]], k: int = 20, least: int = 1) -> DataFrame:
    """(query_id, doc_id, score, rank) of a single search in stored ``docs``; scores and order as in search_index().

    Few queries go to the tasks, which scan the documents once and give the k best
    of each task; no token is shuffled. For more an index is built and searched.
    """
    asked = queries.select("query_id", tokenize(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    page = [(r["query_id"], r["terms"]) for r in asked.limit(FEW_QUERIES + 1).toLocalIterator()]
    terms = sorted({t for _, ts in page for t in ts})
    if len(page) <= FEW_QUERIES and len(terms) <= FEW_TERMS:
        return _scan(docs, queries, page, terms, weights, k, least)
    path = f"{checkpoint_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    add_version(docs, weights, path, 1)
    return search_index(docs.sparkSession, path, queries, k, least)


def _best(hits: pa.Table, k: int) -> pa.Table:
    """Each query's first ``k`` by score falling, title, id."""
    keys = [("q", "ascending"), ("score", "descending"), ("title", "ascending"), ("doc_id", "ascending")]
    hits = hits.take(pc.sort_indices(hits, sort_keys=keys, null_placement="at_start")).combine_chunks()
    q = hits["q"].to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return hits.filter(pa.array(place < k))


def _scan(docs: DataFrame, queries: DataFrame, page: list[tuple], terms: list[str], weights: Sequence[tuple[str, int]], k: int, least: int) -> DataFrame:
    kinds = [queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
    arrow_kind = queries.select("query_id").limit(0).toArrow().schema.field(0).type
    shared = docs.sparkSession.sparkContext.broadcast((page, terms))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, terms = shared.value
        places, known = {t: i for i, t in enumerate(terms)}, pa.array(terms, pa.string())
        wanted = np.zeros((len(terms), len(page)), np.float32)
        for q, (_, ts) in enumerate(page):
            wanted[[places[t] for t in ts], q] = 1
        floor = np.full(len(page), max(1, least), np.float32)
        held, n = [], 0

        def keep() -> pa.Table:
            best = _best(pa.concat_tables(held), k)
            q, score = best["q"].to_numpy(), best["score"].to_numpy()
            full = np.flatnonzero(np.bincount(q, minlength=len(page)) == k)
            lowest = np.full(len(page), np.iinfo(np.int64).max)
            np.minimum.at(lowest, q, score)
            floor[full] = np.maximum(floor[full], lowest[full])
            return best

        for batch in batches:
            for start in range(0, batch.num_rows, SCORED):
                part = batch.slice(start, SCORED)
                own = np.zeros((part.num_rows, len(terms)), np.float32)
                for f, (_, w) in enumerate(weights):
                    lists = part.column(2 + f)
                    at = pc.index_in(lists.flatten(), value_set=known)
                    hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())[hit]
                    own[row, at.drop_null().to_numpy()] += w  # a field's tokens are distinct
                used = np.flatnonzero(own.any(axis=0))
                scores = own[:, used] @ wanted[used]
                if len(scores) > k:  # what a slice alone rules out
                    np.maximum(scores, 0, out=scores)
                    cut_off = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                else:
                    cut_off = floor
                d, q = np.nonzero(scores >= cut_off)
                if len(d):
                    rows = pa.array(d)
                    held.append(pa.table({"q": pa.array(q.astype(np.int64)), "score": pa.array(scores[d, q].astype(np.int64)), "title": part.column(1).take(rows), "doc_id": part.column(0).take(rows)}))
                    n += len(d)
                if n > HELD:
                    held = [keep()]
                    n = len(held[0])
                    n = 0 if n > HELD // 2 else n
        if held:
            best = keep()
            ids = pa.array([page[i][0] for i in best["q"].to_pylist()], arrow_kind)
            yield from pa.table({"query_id": ids, "doc_id": best["doc_id"], "title": best["title"], "score": best["score"]}).combine_chunks().to_batches()

    empty = F.array().cast("array<string>")
    rows = docs.select("doc_id", F.col("title").cast("string").alias("title"), *(F.coalesce(tokenize(F.col(f)), empty).alias(f"_{i}") for i, (f, _) in enumerate(weights)))
    found = rows.mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, title string, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "title", "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def match_route(inputs: DataFrame, routes, terms, excludes, safety) -> DataFrame:
    """(id, kind, route, primary, auxiliaries) per input: safety first by priority, else the best route, else none.

    Routes score the weights of their terms that occur, need their least score
    and none of their excluded words; the highest score wins, then the lower
    priority; on a full tie of different primary models there is no match, else
    the smallest route. Rule tables are literals, so this is one narrow pass.
    """
    text = F.lower(F.col("text"))
    has = lambda t: F.contains(text, F.lit(t.lower()))
    alarm = F.coalesce(*(F.when(has(word), rule) for rule, _, word in sorted(safety, key=lambda s: s[1])))
    scored = []
    for route, priority, least, primary, auxiliaries in routes:
        score = sum((F.when(has(t), w).otherwise(0.0) for r, t, w in terms if r == route), F.lit(0.0))
        barred = F.lit(False)
        for r, t in excludes:
            barred = barred | (has(t) if r == route else F.lit(False))
        scored.append(F.when((score >= least) & ~barred, F.struct((-score).alias("s"), F.lit(priority).alias("p"), F.lit(route).alias("route"), F.lit(primary).alias("primary"), F.array(*map(F.lit, auxiliaries[:2])).cast("array<string>").alias("auxiliaries"))))
    hits = F.array_sort(F.array_compact(F.array(*scored)))
    best = F.get(hits, F.lit(0))
    ties = F.filter(hits, lambda h: (h["s"] == best["s"]) & (h["p"] == best["p"]))
    clear = F.size(F.array_distinct(F.transform(ties, lambda h: h["primary"]))) == 1
    found = inputs.select("id", alarm.alias("alarm"), F.when(clear, best).alias("best"))
    kind = F.when(F.col("alarm").isNotNull(), "safety").when(F.col("best").isNotNull(), "route").otherwise("none")
    only = lambda c: F.when(F.col("alarm").isNull(), c)
    return found.select("id", kind.alias("kind"), F.coalesce("alarm", F.col("best.route")).alias("route"), only(F.col("best.primary")).alias("primary"), only(F.col("best.auxiliaries")).alias("auxiliaries"))


def render_prompt(fields: Sequence[str], matched: Column, ask: str) -> Column:
    """'field: value' lines in fixed order; without a match, a question for the first field that is missing."""
    lines = F.concat_ws("\n", *(F.concat(F.lit(f + ": "), F.coalesce(F.col(f), F.lit("-"))) for f in fields))
    missing = F.coalesce(*(F.when(F.coalesce(F.trim(f), F.lit("")) == "", F.lit(f)) for f in fields), F.lit("more"))
    return F.when(matched, lines).otherwise(F.concat(F.lit(ask), missing))
