"""Terms of a lexicon in texts, by one Aho-Corasick automaton.

The automaton finds all terms, also those that overlap or lie in others, in one pass
over a text, whatever their number. The terms are broadcast after a check of their
number; each task builds its automaton once and takes texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Terms of a lexicon, at most, and rows of an output batch.
TERMS, ROWS = 500_000, 50_000


def lexicon_terms(lexicon: DataFrame, column: str = "term") -> list[str]:
    """The distinct terms, null and empty ones left out; more than ``TERMS`` are an error."""
    rows = lexicon.select(column).where(f"`{column}` <> ''").distinct().limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError(f"a lexicon has more than {TERMS} terms")
    return sorted(r[0] for r in rows)


def scan_terms(docs: DataFrame, terms: Sequence[str], emit: Callable[[str, list[tuple[int, str]]], Iterable[tuple]], columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``columns``): what ``emit`` makes of each text that has terms, with its hits (place from 0, term) by place, longest first; ``columns`` are strings and longs."""
    shared = docs.sparkSession.sparkContext.broadcast(list(terms))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in shared.value:
            found.add_word(t, t)
        if shared.value:
            found.make_automaton()
        ids, rows = [], []

        def batch(like: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, like.schema.field(0).type), *map(pa.array, columns)], names=names)

        last = None
        for b in batches if shared.value else ():
            last = b
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = sorted(((end + 1 - len(t), t) for end, t in found.iter(text)), key=lambda h: (h[0], -len(h[1]))) if text else []
                for row in emit(text, hits) if hits else ():
                    ids.append(key)
                    rows.append(row)
                if len(rows) >= ROWS:
                    yield batch(b)
                    ids, rows = [], []
        if rows:
            yield batch(last)

    schema = f"`{id_col}` {kind}, {columns}"
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]
    return docs.select(id_col, text_col).mapInArrow(run, schema)
