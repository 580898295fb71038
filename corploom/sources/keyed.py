"""Keyed tables by hash ranges of their keys: upserts that rewrite what they touch, and versions with hash trees.

A row's range is ``r`` and the first hexadecimal digits of its key's sha256, so it is the same
in every version. A table keeps each range in a folder of its own. A version's tree
has a digest for each range and, above, for each prefix of one digit less, up to the
root: of two versions only the ranges whose digests differ are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corploom.operators.merge import split_duplicates, upsert_replace
from corploom.session import cut
from corploom.sources.sinks import canonical_json

RANGE = "_range"
#: Digits of a range: 256 folders. More rows want more digits; a table keeps the number it began with.
DIGITS = 2


def range_of(keys: Sequence[str], digits: int = DIGITS) -> Column:
    """The range of a row: digits of the sha256 of its key values (null: ``-``, else length, ``:`` and text)."""
    texts = (F.col(k).cast("string") for k in keys)
    digest = F.sha2(F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)
    return F.concat(F.lit("r"), F.substring(digest, 1, digits))  # a letter, lest a folder's name be read as a number


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table by ranges that may have no rows."""
    return spark.read.schema(StructType([*schema.fields, StructField(RANGE, StringType())])).parquet(path)


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], digits: int = DIGITS) -> None:
    """A new keyed table. No column may be named ``_range``."""
    df.withColumn(RANGE, range_of(keys, digits)).repartition(RANGE).write.partitionBy(RANGE).mode("errorifexists").parquet(path)


def upsert_keyed(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], digits: int = DIGITS) -> tuple[list[str], DataFrame]:
    """Whole rows of ``updates`` replace rows of their key or come in; (ranges written anew, keys that came twice and were left out).

    Only ranges that an update falls into are read, merged and written over; the
    files of all others stay as they are. A rerun with the same updates gives
    the same rows. ``updates`` has the table's columns.
    """
    base = _stored(spark, path, updates.schema)
    schema, first = updates.columns, base.select(RANGE).first()
    if first is not None and len(first[0]) != digits + 1:
        raise ValueError(f"the table's ranges have {len(first[0]) - 1} digits")
    once, twice = split_duplicates(updates.select(*schema), keys)
    once = cut(once.withColumn(RANGE, range_of(keys, digits)))
    touched = sorted(r[0] for r in once.select(RANGE).distinct().collect())  # at most 16 ** digits
    held = base.where(F.col(RANGE).isin(touched))
    merged = upsert_replace(held.select(*schema, RANGE), once.select(*schema, RANGE), keys)
    merged.repartition(RANGE).write.partitionBy(RANGE).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched, twice


# -- versions -------------------------------------------------------------------


def hash_tree(rows: DataFrame, digits: int) -> DataFrame:
    """(level, prefix, digest, n) from (_range, sha256 of each row): level ``digits`` are the ranges, level 0 the root.

    A range's digest adds its rows' digests as numbers, so it needs neither order
    nor a list; upper ones are hashes of at most 16 children in order.
    """
    # Four sums of 60 bits each: rows that aren't the same have the same sums with a chance of 2 ** -240.
    parts = [F.sum(F.conv(F.substring("sha256", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    leaves = rows.groupBy(F.col(RANGE).alias("prefix")).agg(*parts, F.count("*").alias("n"))
    level = cut(leaves.select(F.lit(digits).alias("level"), "prefix", F.sha2(F.concat_ws(",", "n", *(f"s{k}" for k in range(4))), 256).alias("digest"), "n"))
    tree = level
    for d in range(digits - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        level = level.groupBy(F.substring("prefix", 1, d + 1).alias("prefix")).agg(children.alias("c"), F.sum("n").alias("n"))
        level = level.select(F.lit(d).alias("level"), "prefix", F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["prefix"], F.lit(":"), x["digest"])), ","), 256).alias("digest"), "n")
        tree = tree.union(level)
    return tree


def write_version(df: DataFrame, path: str, keys: Sequence[str], digits: int = DIGITS) -> str | None:
    """A version under ``path``: its rows by range, each row's sha256 by range, and the tree. Returns the root (None without rows)."""
    write_keyed(df, f"{path}/rows", keys, digits)
    stored = _stored(df.sparkSession, f"{path}/rows", df.schema)
    plain = stored.drop(RANGE)
    stored.select(RANGE, *keys, F.sha2(canonical_json(plain), 256).alias("sha256")).write.partitionBy(RANGE).parquet(f"{path}/digests")
    kept = StructType([*(df.schema[k] for k in keys), StructField("sha256", StringType())])
    hash_tree(_stored(df.sparkSession, f"{path}/digests", kept), digits).coalesce(1).write.parquet(f"{path}/tree")
    top = df.sparkSession.read.parquet(f"{path}/tree").where("level = 0").first()
    return top["digest"] if top else None


def differing_ranges(old: DataFrame, new: DataFrame) -> list[str]:
    """Ranges in which two trees differ: from the root down, only below prefixes that differ."""
    levels = max((t.agg(F.max("level")).first()[0] or 0) for t in (old, new))
    apart = ["r"]
    for level in range(levels + 1):
        below = F.col("level") == level
        asked = F.substring("prefix", 1, max(level, 1)).isin(apart)
        a, b = (t.where(below & asked).select("prefix", F.col("digest").alias(d)) for t, d in ((old, "a"), (new, "b")))
        rows = a.join(b, "prefix", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix").collect()  # at most 16 ** level
        apart = sorted(r[0] for r in rows)
    return apart


def version_diff(spark: SparkSession, old: str, new: str, keys: StructType) -> DataFrame:
    """(keys, problem): rows added, removed or changed, by their key columns; only the digests of ranges that differ are read.

    Repeats of a key are compared as a set of rows: changed, unless the same.
    """
    ranges = differing_ranges(spark.read.parquet(f"{old}/tree"), spark.read.parquet(f"{new}/tree"))
    kept, keys = StructType([*keys.fields, StructField("sha256", StringType())]), keys.names
    one = lambda path, name: _stored(spark, f"{path}/digests", kept).where(F.col(RANGE).isin(ranges)).groupBy(RANGE, *keys).agg(F.array_sort(F.collect_list("sha256")).alias(name))
    a, b = one(old, "_a").alias("b"), one(new, "_b").alias("u")
    same = F.lit(True)
    for k in (RANGE, *keys):
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"u.{k}"))
    both = a.join(b, same, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    problem = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.select(*(F.when(F.col("_a").isNull(), F.col(f"u.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys), problem.alias("problem"))
