"""Incremental ingest with Structured Streaming: gate, clean, classify, keep what is new.

What was seen before is keyed state in a RocksDB store: a batch looks up and adds its
own keys only, so its cost doesn't grow with the batches before it, and the state
may outgrow memory. State and offsets are in the query's checkpoint, so a query that
is started again goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from corploom.operators.classify import classify
from corploom.operators.lines import doc_gate, strip_documents
from corploom.rules import LINE_PATTERNS, TAXONOMY

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def curate(docs: DataFrame) -> DataFrame:
    """The steps that need no other row, so they run alike on a table and on a stream."""
    clean = strip_documents(docs, LINE_PATTERNS)
    kept = doc_gate(clean, 120)
    return kept.withColumn("fingerprint", F.sha2("text", 256)).withColumn("chapter", classify(F.col("text"), TAXONOMY))


def write_arrivals(docs: DataFrame, path: str, batches: int, key: str) -> int:
    """Writes ``docs`` to ``path`` as files for at most so many batches of a stream, and returns how many files a batch takes.

    A batch has about as many files as the scan of ``docs`` has parts, so writing a
    table and reading a batch of it spread over more tasks as the table grows.
    """
    docs.repartition(batches * max(1, docs.rdd.getNumPartitions()), key).write.parquet(path)
    return max(1, -(-len(docs.sparkSession.read.schema(docs.schema).parquet(path).inputFiles()) // batches))


def append_batch(catalog: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, over what a failed try of the same batch has left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{catalog}/batch={number}")

    return write


def start_with_state(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query whose state is in RocksDB; the session's own setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def ingest_stream(spark: SparkSession, source: str, catalog: str, checkpoint: str, schema, files_per_batch: int = 100) -> StreamingQuery:
    """All new Parquet files of ``source`` through curate() into ``catalog``, then stops.

    A fingerprint is appended once, ever: of copies in one batch any, of copies in
    several the first batch's. Rows without text don't pass the gate.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    fresh = curate(docs).dropDuplicates(["fingerprint"])
    return start_with_state(fresh.writeStream.foreachBatch(append_batch(catalog)).option("checkpointLocation", checkpoint).trigger(availableNow=True), spark)


def dedup_stream(docs: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Drops rows of a stream whose fingerprint came within the watermark; state ends with it. Start it by start_with_state()."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"])
