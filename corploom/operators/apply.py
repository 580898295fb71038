"""Caller-supplied cleaners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def apply_cleaner(docs: DataFrame, cleaner: Callable[[str, str], dict], schema: str, id_col: str = "doc_id") -> DataFrame:
    """cleaner(id, text) -> dict of the schema's columns, Arrow-batched; an error or another shape fails the run and names the source."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch["text"], strict=True):
                try:
                    row = cleaner(key, text)
                    if sorted(row) != sorted(names):
                        raise ValueError(f"columns {sorted(row)}, expected {sorted(names)}")
                except Exception as e:
                    raise ValueError(f"cleaner failed on {id_col} {key}: {e}") from e
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return docs.select(id_col, "text").mapInPandas(run, schema)
