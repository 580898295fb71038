"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k | text) = sigmoid(w . x - theta_k): all grades share one vector of
weights over hashed text features; the thresholds theta_1 < theta_2 < ... tell
the grades apart. A text gets its expected grade and the tail probability of a
wanted grade, by which documents are selected.

The fit reads a bounded sample of rated texts and runs in numpy; the scores
cover every row and whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import arrow_rows, cut, documents, numbered, table, text_or_empty, texts_of

#: Rated texts that the fit reads at most, and hash buckets of features.
RATED, BUCKETS = 6_000, 1 << 18
#: Tail probability from which a document is selected.
SELECT = 0.5
#: Words a task remembers the buckets of.
REMEMBERED = 300_000
_CORE = re.compile(r"[^\W_]+")


def shape(word: str) -> str:
    """What a word looks like: its case and the signs around its letters."""
    core = _CORE.search(word)
    if core is None:
        return "S" + word[:3]
    w = core.group()
    case = "D" if w.isdigit() else "U" if w.isupper() and len(w) > 1 else "T" if w[:1].isupper() else "l" if w.islower() else "m"
    return case + word[: core.start()][-2:] + "_" + word[core.end() :][:3]


class Features:
    """Hashed features of texts: words, shapes, and how varied the words are."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.memo: dict[str, tuple[int, int]] = {}

    def _hash(self, sign: str) -> int:
        return zlib.crc32(sign.encode("utf-8", "surrogatepass")) % (self.buckets - 1) + 1

    def _of(self, word: str) -> tuple[int, int]:
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        found = self.memo[word] = (self._hash("w" + word.lower()), self._hash("s" + shape(word)))
        return found

    def text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values); values are shares under a square root, so long and short texts compare."""
        words = text.split()
        if not words:
            return np.array([self._hash("empty")]), np.array([1.0])
        found = list(map(self.memo.get, words))
        if None in found:
            found = [x or self._of(w) for w, x in zip(words, found, strict=True)]
        at, n = np.unique(np.array(found, np.int64).ravel(), return_counts=True)
        varied = len(set(words)) / len(words)
        extra = [self._hash(f"v{int(varied * 10)}"), self._hash(f"n{min(len(words).bit_length(), 12)}")]
        return np.concatenate([at, extra]), np.concatenate([np.sqrt(n / len(words)), [0.5, 0.5]])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(float(self.weights[at] @ values) - self.thresholds)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def cumulative_link_fit(row: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, levels: int, buckets: int, epochs: int = 200, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Maximum likelihood by Adam over triples (row, bucket, value); thresholds stay ordered as sums of positive steps."""
    n = max(len(grade), 1)
    used, column = np.unique(at, return_inverse=True)
    above = np.array([(grade >= k).mean() if len(grade) else 0.5 for k in range(1, levels)])
    start = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / (1 - np.clip(above, 1e-3, 1 - 1e-3)))
    steps = np.log(np.maximum(np.diff(start), 0.05))
    p = np.concatenate([np.zeros(len(used)), start[:1], steps])
    m, v = np.zeros(len(p)), np.zeros(len(p))
    w = len(used)
    lower = np.tril(np.ones((levels - 1, levels - 1)))
    for epoch in range(1, epochs + 1):
        theta = lower @ np.concatenate([p[w : w + 1], np.exp(p[w + 1 :])])
        f = np.bincount(row, p[:w][column] * value, minlength=len(grade))
        edge = np.concatenate([np.full((len(grade), 1), 1.0), _sigmoid(f[:, None] - theta), np.zeros((len(grade), 1))], axis=1)
        i = np.arange(len(grade))
        hi, lo = edge[i, grade], edge[i, grade + 1]  # P(>= g), P(>= g + 1)
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)  # slopes; 0 at the outer edges
        d_f = -(d_hi - d_lo) / prob / n
        d_theta = np.zeros(levels - 1)
        for k in range(1, levels):
            d_theta[k - 1] = (d_hi / prob)[grade == k].sum() / n - (d_lo / prob)[grade == k - 1].sum() / n
        inner = lower.T @ d_theta
        g = np.concatenate([np.bincount(column, d_f[row] * value, minlength=w) + decay * p[:w], inner[:1], inner[1:] * np.exp(p[w + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    weights = np.zeros(buckets, np.float32)
    weights[used] = p[:w]
    return Model(weights, lower @ np.concatenate([p[w : w + 1], np.exp(p[w + 1 :])]))


def fit_quality(docs: DataFrame, ratings: DataFrame, levels: int, rated: int = RATED, buckets: int = BUCKETS) -> Model:
    """Learns from ``ratings`` (doc_id, grade 0 .. levels - 1) and the texts of ``docs``.

    At most ``rated`` ids are read, those with the least hash. Of several
    ratings of one id the highest counts; null ids and grades, and grades out of
    range, are passed over. Without ratings every text gets the same middle
    probabilities.
    """
    said = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1)).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = F.broadcast(cut(said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rated)))  # at most ``rated`` rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for part, texts in texts_of(batches, 2):
            found = [features.text(t) for t in texts]
            at, value = (pa.array([x[i].tolist() for x in found], pa.list_(kind)) for i, kind in ((0, pa.int32()), (1, pa.float32())))
            yield arrow_rows(part, (0, 1), ["doc_id", "grade", "at", "value"], [at, value])

    sample = docs.select("doc_id", text_or_empty().alias("_text")).join(chosen, "doc_id").select("doc_id", "grade", "_text")
    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, grade int, at array<int>, value array<float>").orderBy("doc_id").toArrow()
    lists = got["at"].combine_chunks()
    row = np.repeat(np.arange(got.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    value = got["value"].combine_chunks().flatten().to_numpy().astype(np.float64)
    return cumulative_link_fit(row, lists.flatten().to_numpy().astype(np.int64), value, got["grade"].to_numpy().astype(np.int64), levels, buckets)


def score_quality(docs: DataFrame, model: Model, wanted: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, expected_grade, tail (probability of grade >= ``wanted``), selected.

    Only the text is scored, all of it; null and empty texts are scored by a
    feature of their own. Other columns are not read, so names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float per bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        features = Features(len(m.weights))
        for part, texts in texts_of(batches, 2):
            tails = np.array([m.tails(*features.text(t)) for t in texts]).reshape(len(texts), -1)
            columns = [pa.array(tails.sum(axis=1)), pa.array(tails[:, wanted - 1]), pa.array(tails[:, wanted - 1] >= SELECT)]
            yield arrow_rows(part, (0, 1), ["_row", "doc_id", "expected_grade", "tail", "selected"], columns)

    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))).select("_row", "doc_id", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, doc_id {kind}, expected_grade double, tail double, selected boolean")


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels: 0 low quality, 1 good but toxic, 2 good."""
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op4_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """All documents; selected: probably at least of grade 1."""
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, grades(table(spark, sf_dir, "labels")), levels=3)
    return score_quality(docs, model).drop("_row")
