"""Pairs of documents to be reviewed, by title, date, type and body together.

Several orders put documents that may belong together side by side: by title key and
date, by type and date, by the body's least shingle hash. Each document is compared
with the few before it in each order (the sorted-neighbourhood method), so a group of
any size gives links in proportion to its rows. Orders are ranked by ranges and cut
into blocks that overlap by the window, so no key, however frequent, is one task's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions.text import norm_name
from corploom.operators.inventory import ranks
from corploom.operators.similar import WordHashes, shingle_hashes, slices
from corploom.session import cut

#: Places back that a document is compared with, and documents of a block.
WINDOW, BLOCK = 5, 4096
#: The orders, by names of the columns made here; ties go by id.
ORDERS: tuple[tuple[str, ...], ...] = (("title_key", "date"), ("type", "date"), ("body_key", "size"))


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, rep): documents of equal text, title, date and type are one class, named by the least id."""
    same = ["title", "date", "type", "text"]
    reps = docs.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    on = [docs[c].eqNullSafe(reps[c]) for c in same]
    return docs.join(reps, on).select(docs["doc_id"], "rep")


def _reps(docs: DataFrame) -> DataFrame:
    """One document of each class with its least id, and ``t``, a hash that tells texts of one id apart."""
    same = ["title", "date", "type", "text"]
    return docs.groupBy(*same).agg(F.min("doc_id").alias("id")).withColumn("t", F.xxhash64(*same))


def features(docs: DataFrame, width: int = 5) -> DataFrame:
    """(id, t, title_key, date, type, size, body_key) of one document of each class; what the orders go by."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+", -1), lambda x: x != "")
    rows = _reps(docs).select("id", "t", norm_name(F.coalesce("title", F.lit(""))).alias("title_key"), "date", "type", words.alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    shingles = F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " "))
    rows = rows.select("id", "t", "title_key", "date", "type", F.array_distinct(shingles).alias("s"))
    return rows.select("id", "t", "title_key", "date", "type", F.size("s").alias("size"), F.coalesce(F.array_min(F.transform("s", lambda x: F.md5(x.cast("binary")))), F.lit("")).alias("body_key"))


def places(rows: DataFrame, order: Sequence[str], window: int, block: int) -> DataFrame:
    """(id, t, _rank, _own, _block): each row's place in the order, its block, and the blocks it is needed in."""
    key = F.struct(*order, "id", "t")
    placed = ranks(rows.select("id", "t", key.alias("_key")), None, "_key", "_rank")
    own = F.floor((F.col("_rank") - 1) / block).cast("long")
    # The last rows of a block come before the first of the next one.
    blocks = F.when((F.col("_rank") - 1) % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    return placed.select("id", "t", "_rank", own.alias("_own"), F.explode(blocks).alias("_block"))


def neighbours(docs: DataFrame, rows: DataFrame, orders: Sequence[Sequence[str]], window: int, block: int, width: int = 5) -> DataFrame:
    """(a, b, common) structs of features and the number of common shingles: each row with up to ``window`` rows before it in one of the orders.

    Ids and keys alone are ranked. Texts go to the blocks, once an order, and become
    shingles there; those take twice the bytes of a text and don't compress.
    """
    placed = None
    for number, order in enumerate(orders):
        one = places(rows, order, window, block).withColumn("_order", F.lit(number))
        placed = one if placed is None else placed.union(one)
    title = norm_name(F.coalesce("title", F.lit("")))
    texts = _reps(docs).select("id", "t", F.when(title != "", F.md5(title)).otherwise("").alias("title_key"), "date", "type", "text")
    kept = ["id", "title_key", "date", "type"]
    dealt = placed.join(texts, ["id", "t"]).select("_order", "_block", "_own", "_rank", *kept, F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    names = [f"{side}_{c}" for side in "ab" for c in (*kept, "size")]
    kinds = [texts.schema[c].dataType.simpleString() for c in kept] + ["int"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, sets = WordHashes(), None, []
        for batch in batches:
            for part in slices(batch, 8):
                new = [shingle_hashes(t.as_py().encode("utf-8", "surrogatepass").split(), width, memo) for t in part.column(8)]
                rows = pa.Table.from_batches([part.select([0, 1, 2, *range(4, 8)])])
                if last is not None:
                    rows = pa.concat_tables([last, rows])
                sets = sets + new
                order, blocks, own = (rows[c].to_numpy() for c in ("_order", "_block", "_own"))
                found = [(j, i) for i in range(len(sets) - len(new), len(sets)) if own[i] == blocks[i] for j in range(max(0, i - window), i) if order[i] == order[j] and blocks[i] == blocks[j]]
                common = pa.array([len(np.intersect1d(sets[j], sets[i], assume_unique=True)) for j, i in found], pa.int32())
                sizes = pa.array([len(x) for x in sets], pa.int32())
                ends = [pa.array([x[side] for x in found], pa.int64()) for side in (0, 1)]
                cols = [c for e in ends for c in (*(rows[k].combine_chunks().take(e) for k in kept), sizes.take(e))]
                yield pa.RecordBatch.from_arrays([*cols, common], names=[*names, "common"])
                last, sets = rows.slice(max(0, len(rows) - window)), sets[max(0, len(sets) - window) :]

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds * 2, strict=True))
    sides = [F.struct(*(F.col(f"{side}_{c}").alias(c) for c in (*kept, "size"))).alias(side) for side in "ab"]
    met = dealt.repartition("_order", "_block").sortWithinPartitions("_order", "_block", "_rank").mapInArrow(run, f"{schema}, common int")
    return met.select(*sides, "common")


def pair_candidates(docs: DataFrame, least: float = 0.8, days: int = 3, window: int = WINDOW, orders: Sequence[Sequence[str]] = ORDERS, block: int = BLOCK) -> DataFrame:
    """(a, b, kind, jaccard, containment, same_title, same_type, gap) of classes a < b of (doc_id, title, date, type, text); see text_classes().

    Compared are classes at most ``window`` places apart in one of the orders.
    near_copy: the Jaccard similarity of their shingles is ``least`` or more.
    long_short: that share of the shorter one's shingles is in the longer, and they
    have the same title key, or the same type and at most ``days`` between them.
    same_title: neither, but title key and type are the same and the dates that near.
    Others give no row. A null date is near no date, a null type is no type; empty
    titles are no title; texts without words are similar to none.
    """
    found = neighbours(docs, cut(features(docs)), orders, window, block)
    scored = found.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), *_compared(F.col("a"), F.col("b")))
    pairs = scored.withColumn("kind", _kind(least, days)).where("kind IS NOT NULL")
    # A pair that several orders bring together is judged alike each time.
    return pairs.dropDuplicates(["a", "b"]).select("a", "b", "kind", "jaccard", "containment", "same_title", "same_type", "gap")


def _compared(a: Column, b: Column) -> list[Column]:
    common = F.col("common")
    either, smaller = a["size"] + b["size"] - common, F.least(a["size"], b["size"])
    part = lambda x, of: F.when(of > 0, F.round(x / of, 9)).otherwise(0.0)
    return [
        part(common, either).alias("jaccard"),
        part(common, smaller).alias("containment"),
        ((a["title_key"] == b["title_key"]) & (a["title_key"] != "")).alias("same_title"),
        F.coalesce(a["type"] == b["type"], F.lit(False)).alias("same_type"),
        F.abs(F.datediff(a["date"], b["date"])).alias("gap"),
    ]


def _kind(least: float, days: int) -> Column:
    near = F.coalesce(F.col("gap") <= days, F.lit(False))
    akin = F.col("same_title") | (F.col("same_type") & near)
    return F.when(F.col("jaccard") >= least, "near_copy").when((F.col("containment") >= least) & akin, "long_short").when(F.col("same_title") & F.col("same_type") & near, "same_title")
