"""What several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.session import cut
from corploom.sources.tables import table

__all__ = ["WORD", "arrow_rows", "crc_remainder", "cut", "documents", "numbered", "table", "text_or_empty", "texts_of", "unused", "where_text"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a number that tells equal rows apart.

    It depends on the row's place in its partition, so ``df`` must be a scan
    of stored data (or narrow steps over one): then a retried task, or a second
    scan, numbers the rows alike.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it if the rows have such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Texts that a task holds as Python strings at once, in bytes.
SLICE_BYTES = 16 << 20


def texts_of(batches: Iterable[pa.RecordBatch], column: int = 0, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches in slices whose texts stay small, with those texts (null: empty)."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            rows = batch.num_rows - start
            while rows > 1 and batch.column(column).slice(start, rows).nbytes > most:
                rows = (rows + 1) // 2
            part = batch.slice(start, rows)
            yield part, [x or "" for x in part.column(column).to_pylist()]
            start += rows


def arrow_rows(part: pa.RecordBatch, keep: Iterable[int], names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    """Kept input columns (by position), then new ones, as one batch."""
    return pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *columns], names=names)


def where_text(docs: DataFrame, judge: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts (null: empty) are judged true, with their columns as they came, in one narrow pass.

    Each task calls ``judge`` once for its function from texts to booleans.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for part, texts in texts_of(batches, at):
            yield part.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
