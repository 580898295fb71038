"""Mixing sources to target weights over a time-varying curriculum.

Each source has a share of the mix (its target, in words) and a schedule: a
piecewise-linear weight over training time 0 .. 1. The integral of the schedule,
scaled to the target, is the source's cumulative word demand. A document's
copies lie one after another on the source's word axis; inverting the demand at
a copy's midpoint gives its training position, and a range sort by position
gives the order of the whole mix. All of it is built-in column functions.

Cumulative sizes never need a source, or an id, in one task: documents are
ranged by source and order, each range adds up its own, and the ranges' sums add
up by source, a row for each source and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm.common import WORD, cut, documents, numbered, text_or_empty, unused
from corploom.operators.inventory import ranks

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: (time, weight) knots, given out like the weights: falling, level, rising.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)


def _pick(rank: Column, values: Sequence, make) -> Column:
    """values[rank modulo their number]."""
    out = None
    for i, value in enumerate(values):
        hit = rank % len(values) == i
        out = F.when(hit, make(value)) if out is None else out.when(hit, make(value))
    return out


def _areas(knots: Sequence[tuple[float, float]]) -> list[float]:
    """The integral of the schedule up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. Targets share
    the total of all sizes by weight; one that would pass ``cap`` times its
    source's size stops there, and the excess goes to the others by weight until
    none is above. That is one water level, which rises while sources stop: each
    step is one sum over all sources.
    """
    order = F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("source"))
    ranked = ranks(sizes.select("source", "source_size", order.alias("_order")), None, "_order").withColumn("rank", F.col("rank") - 1)
    ranked = cut(ranked.withColumn("_w", _pick(F.col("rank"), weights, F.lit)).withColumn("_cap", F.col("source_size") * F.lit(cap)))
    level, stopped = 0.0, -1
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("_w")
        r = ranked.agg(F.count_if(full), F.sum("source_size"), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("_w")))).first()
        if r[0] == stopped or not r[3]:  # none stops any more, or all have
            break
        stopped, level = r[0], (r[1] - r[2]) / r[3]
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_w")) if r[3] else F.col("_cap")
    return ranked.withColumn("target", target).select("source", "source_size", "rank", "target")


def curriculum_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, source, size, source_size, target, copies, taken, positions.

    ``docs`` must be a scan of stored data (see ``numbered``). size counts words;
    null and empty texts have none and are free to take. A null source is a
    source of its own, the last. copies is the number of whole passes over the
    source that fit its target, plus one for documents, in the order of the md5
    of their id (without one, of their place), whose middle lies within the rest; so a source misses its
    target by half a document at most, and none is taken more than ``cap``
    times (rounded down) its size. Equal ids are ordered by size, then by place.
    positions holds a training time in 0 .. 1 for each copy. No rows give no
    rows. Other columns are not read, so their names can't clash.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), F.col("_row").cast("string")))
    sized = numbered(docs).select(
        "_row",
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(name.cast("binary")).alias("_key"),
    )
    # Stored, so that all uses see the same ranges.
    order = ["_key", "size", "_row"]
    ranged = cut(sized.repartitionByRange("source", *order).withColumn("_range", F.spark_partition_id()))
    sums = cut(ranged.groupBy("source", "_range").agg(F.sum("size").alias("_n")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, cap)
    rank = F.col("rank")
    targets = targets.select(
        "source",
        "source_size",
        "target",
        _pick(rank, schedules, lambda s: _doubles([t for t, _ in s])).alias("_t"),
        _pick(rank, schedules, lambda s: _doubles([w for _, w in s])).alias("_w"),
        _pick(rank, schedules, lambda s: _doubles(_areas(s))).alias("_a"),
    )
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.withColumn("_from", F.sum("_n").over(before) - F.col("_n")).alias("c")
    starts = starts.join(targets.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    starts = starts.select("c.source", "_range", "_from", "source_size", "target", "_t", "_w", "_a")

    found = ranged.alias("d").join(starts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._range") == F.col("p._range")))
    found = found.drop(F.col("p.source")).drop(F.col("p._range"))
    inside = Window.partitionBy("source", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_from") + F.sum("size").over(inside) - F.col("size") / 2
    passes = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rest = F.col("target") - passes * F.col("source_size")
    found = found.withColumn("_middle", middle).withColumn("copies", (passes + F.when(F.col("_middle") < rest, 1).otherwise(0)).cast("int"))
    return found.select(
        "_row",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.transform(F.slice(F.sequence(F.lit(0), F.col("copies")), F.lit(1), F.col("copies")), _position).alias("positions"),
    )


def _position(copy: Column) -> Column:
    """Training time at which the source's demand reaches the middle of a copy."""
    demand = F.col("_middle") + copy * F.col("source_size")
    share = F.least(F.when(F.col("target") > 0, demand / F.col("target")).otherwise(0.0), F.lit(1.0))
    area = share * F.element_at("_a", -1)
    knot = F.greatest(F.lit(1), F.least(F.size("_a") - 1, F.size(F.filter("_a", lambda x: x <= area))))
    at = lambda name, i: F.element_at(name, i)
    rest, w = area - at("_a", knot), at("_w", knot)
    slope = (at("_w", knot + 1) - w) / (at("_t", knot + 1) - at("_t", knot))
    root = w + F.sqrt(F.greatest(w * w + 2 * slope * rest, F.lit(0.0)))
    return F.least(at("_t", knot) + F.when(root > 0, 2 * rest / root).otherwise(0.0), at("_t", knot + 1))


def training_order(mix: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by position; equal positions by id and copy."""
    copies = mix.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return copies.orderBy("position", "doc_id", "_row", "copy")


def op7_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, in the order of their first position; those the mix leaves out come last."""
    mix = curriculum_mix(documents(spark, sf_dir))
    out = mix.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("_first"))
    return out.orderBy(F.col("_first").asc_nulls_last(), "doc_id").drop("_first")


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix in training order, a row for each copy: the columns of documents, copy and position.

    Where ``docs`` has a column named copy or position, that of the mix gets an
    underscore behind its name. Null and empty texts have no words and cost no
    part of the target; repeated rows are documents of their own; no rows
    give none.
    """
    row, copy, position = (unused(docs, name) for name in ("_row", "copy", "position"))
    order = curriculum_mix(docs).select(F.col("_row").alias(row), F.posexplode("positions").alias(copy, position))
    return numbered(docs, row).join(order, row).drop(row).orderBy(position, "doc_id", copy)


SQL = {
    "op7_curriculum_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
        w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END :: DOUBLE AS w,
                     CAST(source_size AS DOUBLE) * 3.0 AS cap FROM ranked),
        l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                     - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM w),
        t AS (SELECT *, least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE level <= cap / w)) AS target FROM l),
        d AS (SELECT doc_id, size, source_size, target,
                     sum(size) OVER (PARTITION BY sized.source ORDER BY k, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS middle,
                     floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS passes
              FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (passes + CASE WHEN middle < target - passes * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM d
    """
}
