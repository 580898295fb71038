"""Merging reviewed updates by key. Null keys match null keys; a key twice among the updates is an error row, not a merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_duplicates(updates: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(updates with unique keys, duplicate keys)."""
    twice = updates.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return updates.alias("b").join(twice.alias("u"), _same(keys), "left_anti"), twice


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"u.{k}"))
    return same


def _joined(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.withColumn("_b", F.lit(True)).alias("b").join(updates.withColumn("_u", F.lit(True)).alias("u"), _same(keys), "full_outer")


def upsert_replace(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole rows of ``updates`` replace base rows of their key; other keys are inserted."""
    joined = _joined(base, updates, keys)
    return joined.select(*(F.when(F.col("_u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns))


def upsert_patch(base: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], provided: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(patched base, out-of-scope updates): the columns that an update provides overlay the row; unknown keys are errors.

    Provided are the columns that are not null or, with a column ``provided`` of
    names in the updates, those it lists; so a null can be provided too.
    """
    joined = _joined(base, updates, keys).where(F.col("_b").isNotNull())

    def overlaid(c: str) -> Column:
        if provided is None:
            return F.coalesce(F.col(f"u.{c}"), F.col(f"b.{c}"))
        return F.when(F.array_contains(F.col(f"u.{provided}"), c), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}"))

    patched = joined.select(*((overlaid(c) if c in columns else F.col(f"b.{c}")).alias(c) for c in base.columns))
    return patched, updates.alias("b").join(base.alias("u"), _same(keys), "left_anti")


def queue_key(id_col: Column, row: Column) -> Column:
    """The decision's id, else the row as JSON."""
    return F.coalesce(id_col.cast("string"), F.to_json(row))


def batch_scope_check(plan: DataFrame, batch: DataFrame) -> DataFrame:
    """(rule, batch_id, source_id): updates out of their batch, ids twice, unknown batches, assigned ids without update."""
    pairs = ["batch_id", "source_id"]
    twice = batch.groupBy(*pairs).count().where("count > 1").select(F.lit("DUPLICATE").alias("rule"), *pairs)
    outside = batch.select(*pairs).distinct().join(plan.select(*pairs), pairs, "left_anti")
    known = plan.select("batch_id").distinct().withColumn("_k", F.lit(True))
    outside = outside.join(known, "batch_id", "left").select(F.when(F.col("_k").isNull(), "UNKNOWN_BATCH").otherwise("OUT_OF_SCOPE").alias("rule"), *pairs)
    open_ = plan.select(*pairs).join(batch.select("batch_id").distinct(), "batch_id", "left_semi").join(batch.select(*pairs), pairs, "left_anti").select(F.lit("NOT_COVERED").alias("rule"), *pairs)
    return twice.unionByName(outside).unionByName(open_)


def carry_review_state(new: DataFrame, prior: DataFrame, key: str, bound: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Reviewer columns of the prior row stay only if all bound columns are the same and the status is cleaned."""
    old = prior.select(key, *(F.col(c).alias(f"_{c}") for c in [*bound, *carried]))
    same = F.col("status") == "cleaned"
    for c in bound:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = new.join(old, key, "left")
    return joined.select(*new.columns, *(F.when(same, F.col(f"_{c}")).alias(c) for c in carried))


def status_transition(status: Column, queued: Column, failed: Column, done: Column) -> Column:
    """The source's status from its assets' counts: failed before queued before done."""
    return F.when(failed > 0, "failed").when(queued > 0, "queued").when(done > 0, "done").otherwise(status)
