"""Exact overlaps of all sets by a blocked sparse product.

Sets are rows of a set x term matrix, dealt into blocks of rows by hash. Each pair
of blocks is one task's work: it multiplies them and gives either the pairs that
overlap or only each row's sum of similarities. A task holds two blocks and one
square of counts, whatever the terms: terms in many rows of both blocks go through a
dense product, the others add up their pairs. The blocks are the salt of hot terms:
a term in half of all sets is in half of the rows of every block, never in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of a block, on average: a square of counts is 16 MB.
ROWS = 2048
#: Dense terms multiplied, and pairs of rare ones added up, at a time.
COLUMNS, PAIRS = 512, 1 << 21
#: A term is multiplied densely if its pairs are more than this share of all of a square.
DENSE = 1 / 64


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row of each term, terms), all rows one after the other."""
    size = lists.value_lengths().to_numpy()
    return np.repeat(np.arange(len(size)), size), lists.flatten()


def common_terms(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Numbers of common terms, left rows by right rows; rows are sets."""
    (a, ta), (b, tb) = _matrix(left), _matrix(right)
    code = pa.concat_arrays([ta, tb]).dictionary_encode().indices.to_numpy().astype(np.int64)
    ca, cb = code[: len(ta)], code[len(ta) :]
    n = int(code.max()) + 1 if len(code) else 0
    a, b = a[np.argsort(ca, kind="stable")], b[np.argsort(cb, kind="stable")]
    na, nb = np.bincount(ca, minlength=n), np.bincount(cb, minlength=n)
    begin_a, begin_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    out = np.zeros((len(left), len(right)), np.float32)
    pairs = na * nb
    dense = np.flatnonzero(pairs > DENSE * out.size)
    for at in range(0, len(dense), COLUMNS):
        some = dense[at : at + COLUMNS]
        x, y = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        for k, t in enumerate(some.tolist()):
            x[a[begin_a[t] : begin_a[t] + na[t]], k] = 1
            y[b[begin_b[t] : begin_b[t] + nb[t]], k] = 1
        out += x @ y.T
    rare = np.flatnonzero((pairs > 0) & (pairs <= DENSE * out.size))
    upto = np.cumsum(pairs[rare])
    for chunk in np.split(rare, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS)) if len(rare) else []):
        size = pairs[chunk]
        term = np.repeat(chunk, size)
        place = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
        np.add.at(out, (a[begin_a[term] + place // nb[term]], b[begin_b[term] + place % nb[term]]), 1)
    return out


def _products(classes: DataFrame, rows: int, emit: Callable[[pa.Table, pa.Table, np.ndarray, bool], Iterator[pa.Table]], schema: str) -> DataFrame:
    """What ``emit`` makes of each pair of blocks of (rep, terms, n): left rows, right rows, Jaccards, whether both are one block."""
    blocks = max(1, -(-classes.count() // rows))
    own = classes.select("rep", "terms", "n", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("_own"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other")

    def run(table: pa.Table) -> pa.Table:
        i, j, side = table["_i"][0].as_py(), table["_j"][0].as_py(), table["_own"].to_numpy()
        left, right = table.filter(pa.array(side == i)), table.filter(pa.array(side == j))
        lists = [pa.concat_arrays(t["terms"].chunks) if t["terms"].num_chunks else pa.array([], t.schema.field("terms").type) for t in (left, right)]
        c = common_terms(*lists).astype(np.float64)
        na, nb = (x.value_lengths().to_numpy().astype(np.float64) for x in lists)
        return pa.concat_tables(emit(left, right, c / np.maximum(na[:, None] + nb[None, :] - c, 1), i == j))

    return dealt.groupBy("_i", "_j").applyInArrow(run, schema)


def overlapping_pairs(classes: DataFrame, rows: int = ROWS) -> DataFrame:
    """(a, b, jaccard) of all sets a < b of (rep, terms, n) with a common term."""
    kind = classes.schema["rep"].dataType.simpleString()

    def emit(left: pa.Table, right: pa.Table, jaccard: np.ndarray, same: bool) -> Iterator[pa.Table]:
        x, y = np.nonzero(np.triu(jaccard, 1) if same else jaccard)
        a, b = left["rep"].combine_chunks().take(pa.array(x)), right["rep"].combine_chunks().take(pa.array(y))
        yield pa.table({"a": a, "b": b, "jaccard": pa.array(jaccard[x, y])})

    pairs = _products(classes, rows, emit, f"a {kind}, b {kind}, jaccard double")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def overlap_sums(classes: DataFrame, rows: int = ROWS) -> DataFrame:
    """(rep, s): each set's Jaccards to all others of (rep, terms, n), summed with their ``n``; a row a block comes from each task."""
    kind = classes.schema["rep"].dataType.simpleString()

    def emit(left: pa.Table, right: pa.Table, jaccard: np.ndarray, same: bool) -> Iterator[pa.Table]:
        if same:
            np.fill_diagonal(jaccard, 0)
        yield pa.table({"rep": left["rep"].combine_chunks(), "s": pa.array(jaccard @ right["n"].to_numpy().astype(np.float64))})
        if not same:
            yield pa.table({"rep": right["rep"].combine_chunks(), "s": pa.array(left["n"].to_numpy().astype(np.float64) @ jaccard)})

    return _products(classes, rows, emit, f"rep {kind}, s double").groupBy("rep").agg(F.sum("s").alias("s"))
