"""The corpus pipeline: documents through the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corploom.llm.curriculum_mix import mix_sources
from corploom.llm.decontaminate import drop_contaminated
from corploom.llm.exact_dedup import drop_exact_copies
from corploom.llm.pu_toxicity import drop_toxic
from corploom.llm.simhash_dedup import drop_near_copies
from corploom.session import checkpoint_dir

#: (name, function(spark, docs, sf_dir) -> DataFrame), in order.
STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]

#: The stages run trained and approximate operators, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the shared folder and read again.

    A stage's folder goes once the next one is written, so at most two are held.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whichever file system holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
