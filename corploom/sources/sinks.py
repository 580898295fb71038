"""Sinks: canonical JSON, one output per id, content-addressed runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted(c: Column, kind: T.DataType) -> Column:
    """The value with fields and keys in order, at any depth; keys of maps become text first."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), _sorted(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return c


def _not_finite(c: Column, kind: T.DataType) -> Column | None:
    """Whether the value, or one inside it, is a number that JSON can't hold; None if its kind has no such numbers."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, T.StructType):
        found = [x for f in kind.fields if (x := _not_finite(c[f.name], f.dataType)) is not None]
        return F.greatest(*found, F.lit(False), F.lit(False)) if found else None
    if isinstance(kind, T.MapType):
        parts = [_not_finite(x, T.ArrayType(t)) for x, t in ((F.map_keys(c), kind.keyType), (F.map_values(c), kind.valueType))]
        found = [x for x in parts if x is not None]
        return F.greatest(*found, F.lit(False), F.lit(False)) if found else None
    if isinstance(kind, T.ArrayType) and _not_finite(F.lit(None), kind.elementType) is not None:
        return F.coalesce(F.exists(c, lambda x: _not_finite(x, kind.elementType)), F.lit(False))
    return None


def canonical_json(df: DataFrame) -> Column:
    """The row as JSON with sorted keys, nulls kept, without blanks; a number that JSON can't hold, at any depth, fails the run."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    text = F.to_json(F.struct(*(_sorted(F.col(f.name), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})
    return F.when(not_finite(df), F.raise_error(F.lit("a number is not finite")).cast("string")).otherwise(text)


def not_finite(df: DataFrame) -> Column:
    """Whether a row has, at any depth, a number that JSON can't hold."""
    found = [x for f in df.schema.fields if (x := _not_finite(F.col(f.name), f.dataType)) is not None]
    return F.greatest(*found, F.lit(False), F.lit(False))


def last_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each id."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_models(df: DataFrame, path: str, key: str, order: str, by: str = "category") -> None:
    last_per_id(df, key, order).write.partitionBy(by).parquet(path)


def run_id(df: DataFrame, key: str) -> DataFrame:
    """One row (run_id): sha256 over the rows' canonical JSON in key order, by groups of hash prefixes."""
    hashed = df.select(F.sha2(canonical_json(df), 256).alias("h"))
    part = hashed.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "h"))), ","), 256).alias("run_id"))


def redealt(df: DataFrame) -> DataFrame:
    """The same rows in other partitions, whose bytes are bounded by spark.sql.adaptive.advisoryPartitionSizeInBytes and whose number grows with the rows."""
    return df.hint("rebalance")


def publish_run(df: DataFrame, key: str, root: str) -> str:
    """Writes rows, catalog, report and pointer under a content-addressed folder and returns the run id.

    A run that is there and verifies is not written again, only pointed to; one
    that a crash left unfinished, without its report, is written over.
    """
    spark = df.sparkSession
    run = run_id(df, key).first()["run_id"]
    folder = f"{root}/runs/{run}"
    if not _finished(spark, folder, key):
        df.write.mode("overwrite").parquet(f"{folder}/rows")
        df.select(key, F.sha2(canonical_json(df), 256).alias("sha256")).write.mode("overwrite").parquet(f"{folder}/catalog")
        # The report comes last, so it tells that the run is whole.
        spark.read.parquet(f"{folder}/catalog").agg(F.lit(run).alias("run_id"), F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).write.mode("overwrite").parquet(f"{folder}/report")
    spark.createDataFrame([(run,)], "run_id string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    return run


def _finished(spark: SparkSession, folder: str, key: str) -> bool:
    """Whether a run's report is there and its rows equal its catalog."""
    try:
        report = spark.read.parquet(f"{folder}/report").first()
    except AnalysisException:
        return False
    if report is None:
        return False
    rows, catalog = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/catalog")
    if catalog.count() != report["n_rows"] or not _differences(rows, catalog, key).isEmpty():
        raise ValueError(f"{folder} is not what its report says")
    return True


def _differences(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    got = rows.select(key, F.sha2(canonical_json(rows), 256).alias("got"))
    both = got.join(catalog, key, "full_outer")
    return both.where(~F.col("got").eqNullSafe(F.col("sha256"))).select(key)


def read_current_run(spark: SparkSession, root: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): the current run, and keys whose row differs from the catalog's hash or is not in it."""
    run = spark.read.parquet(f"{root}/current").first()["run_id"]
    rows, catalog = spark.read.parquet(f"{root}/runs/{run}/rows"), spark.read.parquet(f"{root}/runs/{run}/catalog")
    return rows, _differences(rows, catalog, key)
