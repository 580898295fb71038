"""Toxicity by non-negative positive-unlabelled learning.

Numpy linear models over hashed words learn from confirmed toxic texts and
unlabelled ones with the non-negative risk estimator of Kiryo et al. (2017):
prior * R_p+ + max(0, R_u- - prior * R_p-), where a negative bracket makes the
step go the other way. No text is ever taken as a confirmed negative: the class
prior, too, is estimated from how confirmed and unlabelled texts are
distributed, and the score is the posterior that both give.

* Spark counts, for every hashed word, the unlabelled and the confirmed texts
  that have it. A word weighs in, for or against, by how far its two shares lie
  apart in standard errors; what ``LEAST_Z`` of them can explain weighs nothing.
* Each task trains a model for each fold of the confirmed texts on its part of
  the unlabelled ones; the weights are averaged over parts and folds.
* Each confirmed text's margin comes from the models that didn't see it. From
  these and all unlabelled margins follow the prior (the least ratio of the two
  tails, as in best bin estimation, Garg et al. 2021) and the posterior: prior
  times the ratio of the densities, made monotone.

All rows learnt from count as unlabelled texts; only the confirmed ones are a
bounded sample. The scores cover every row and whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import arrow_rows, crc_remainder, cut, documents, numbered, table, text_or_empty, texts_of, where_text

LETTERS = re.compile(r"[^\W\d_]+")
#: Confirmed texts that the fit takes at most; buckets of words.
POSITIVES, BUCKETS = 4_000, 1 << 20
#: Standard errors that a word's shares must lie apart, and those beyond them that count as one unit of weight.
LEAST_Z, UNIT_Z = 5.0, 10.0
#: Unlabelled texts of a part; folds of the confirmed texts.
PART, FOLDS = 50_000, 4
#: Steps of a weight of one in whole-number sums.
STEPS_OF_ONE = 1 << 20
#: Steps of a fit, and the share of itself that a weight loses in the risk.
STEPS, DECAY = 100, 3e-3
#: The prior with which the first fit starts; the second takes that estimated from the first.
FIRST_PRIOR = 0.1
THRESHOLD = 0.7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class Hashes:
    """Buckets of the distinct words of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, text: str) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        found, known = [], self.known.get
        for word in set(LETTERS.findall(text.lower())):
            h = known(word)
            if h is None:
                h = self.known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
            found.append(h)
        return np.unique(np.array(found, np.int64))


class Bags:
    """Texts as sets of columns, in a row; column 0, the bias, is in every text."""

    def __init__(self, lists: pa.Array):
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = n + 1
        self.columns = np.insert(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n) - n, 0)
        self.starts = np.cumsum(self.n) - self.n

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.columns], self.starts) if len(self.n) else np.zeros(0)

    def sums(self, by_text: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(by_text, self.n), minlength=width)


def nnpu_fit(positive: Bags, unlabelled: Bags, scale: np.ndarray, prior: float, steps: int = STEPS, decay: float = DECAY) -> np.ndarray:
    """Weights of the columns; logistic loss, accelerated gradient steps on ``scale``d columns, all texts in each step."""
    width, n_p, n_u = len(scale), len(positive.n), len(unlabelled.n)
    share_p, share_u = positive.sums(np.full(n_p, 1 / n_p), width), unlabelled.sums(np.full(n_u, 1 / n_u), width)
    rate = 16 / (prior * (scale**2 * share_p).sum() + (scale**2 * share_u).sum())
    v = np.zeros(width)
    v[0] = np.log(prior / (1 - prior))
    ahead = v
    free = np.arange(width) == 0
    for step in range(1, steps + 1):
        g_p, g_u = positive.margins(ahead * scale), unlabelled.margins(ahead * scale)
        a, b = _sigmoid(g_p), _sigmoid(g_u)
        if _softplus(g_u).mean() >= prior * _softplus(g_p).mean():
            c_p, c_u = np.full(n_p, -prior / n_p), b / n_u
        else:
            c_p, c_u = prior * a / n_p, -b / n_u
        grad = (positive.sums(c_p, width) + unlabelled.sums(c_u, width)) * scale + decay * np.where(free, 0, ahead)
        new = ahead - rate * grad
        ahead = new + (step - 1) / (step + 2) * (new - v)
        v = new
    return v * scale


def bin_edges(margins: np.ndarray) -> np.ndarray:
    """Edges with a few confirmed texts in each bin."""
    return np.unique(np.quantile(margins, np.linspace(0, 1, min(max(len(margins) // 6, 2), 100) + 1)))


def estimate_prior(share_p: np.ndarray, share_u: np.ndarray, n_p: int) -> float:
    """The least ratio of the tails of unlabelled and confirmed margins, with an allowance for few confirmed ones."""
    tail_p, tail_u = np.cumsum(share_p[::-1]), np.cumsum(share_u[::-1])
    some = tail_p * n_p > max(min(10, n_p), 0.1 * n_p) - 0.5
    ratio = tail_u[some] / tail_p[some] * (1 + 2 / np.sqrt(tail_p[some] * n_p))
    return float(np.clip(ratio.min(), 0.001, 0.5))


def posterior(share_p: np.ndarray, share_u: np.ndarray, prior: float) -> np.ndarray:
    """prior * p / u of each bin, the nearest that doesn't fall (bins that would are pooled), 1 at most."""
    pools: list[list[float]] = []
    for p, u in zip(share_p * prior, share_u, strict=True):
        pools.append([p, u, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), min(1.0, p / max(u, 1e-12))) for p, u, k in pools])


@dataclass(frozen=True)
class Model:
    """Weights of buckets, bias, and the posterior by bins of the margin."""

    weights: dict[int, float]
    bias: float
    edges: np.ndarray
    values: np.ndarray
    prior: float
    buckets: int = BUCKETS

    def margin(self, found: np.ndarray) -> float:
        return self.bias + sum(self.weights[h] for h in found.tolist() if h in self.weights)

    def score(self, margins: np.ndarray) -> np.ndarray:
        """The posterior, and a hundredth that tells margins of one bin apart."""
        found = self.values[np.searchsorted(self.edges, margins)] if len(self.edges) else np.zeros(len(margins))
        return 0.99 * found + 0.01 * _sigmoid(margins)


# -- on Spark -----------------------------------------------------------------


def _least(df: DataFrame, n: int) -> DataFrame:
    """At most n rows of (doc_id): those whose hash is least, the same on each run."""
    return df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, u, p): texts, and confirmed ones, with a word of the bucket; bucket -1 counts all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = Hashes(buckets), np.zeros((2, buckets + 1), np.int64)
        for part, texts in texts_of(batches, 1):
            confirmed = part.column(0).to_pylist()
            for text, sure in zip(texts, confirmed, strict=True):
                found = hashes.of(text)
                n[0, found] += 1
                n[0, -1] += 1
                if sure:
                    n[1, found] += 1
                    n[1, -1] += 1
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == buckets, -1, at)), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "u", "p"])

    return rows.mapInArrow(run, "bucket long, u long, p long").groupBy("bucket").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))


def _columns(rows: DataFrame, place: dict[int, int], buckets: int) -> DataFrame:
    """(confirmed, columns) of (confirmed, _text): the places of the buckets that weigh in."""
    shared = rows.sparkSession.sparkContext.broadcast(place)  # at most a place for each bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = Hashes(buckets), shared.value
        for part, texts in texts_of(batches, 1):
            found = [[places[h] for h in hashes.of(t).tolist() if h in places] for t in texts]
            yield arrow_rows(part, (0,), ["confirmed", "columns"], [pa.array(found, pa.list_(pa.int32()))])

    return rows.mapInArrow(run, "confirmed boolean, columns array<int>")


def _train(parts: DataFrame, positive: pa.Array, scale: np.ndarray, prior: float, folds: int) -> np.ndarray:
    """(fold, column) weights averaged over the parts, each by its number of texts.

    A part gives a row for each weight, in whole steps, so that Spark adds them up
    before and after the shuffle, to the same sum in any order.
    """
    shared = parts.sparkSession.sparkContext.broadcast((positive, scale))  # at most POSITIVES texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0) for b in batches if b.num_rows]
        if held:
            positive, scale = shared.value
            unlabelled, at = Bags(pa.concat_arrays(held)), np.arange(len(positive)) % folds
            weights = np.array([nnpu_fit(Bags(positive.filter(pa.array(at != f))), unlabelled, scale, prior) for f in range(folds)])
            steps = np.round(weights.ravel() * (len(unlabelled.n) * STEPS_OF_ONE)).astype(np.int64)
            cells = np.flatnonzero(steps)
            cells, steps = np.append(cells, -1), np.append(steps[cells], len(unlabelled.n))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(steps)], names=["cell", "steps"])

    sums = parts.select("columns").mapInArrow(run, "cell long, steps long").groupBy("cell").agg(F.sum(F.col("steps").cast("decimal(38,0)")).cast("double").alias("s"))
    cells, total = (x.to_numpy() for x in sums.toArrow().columns)  # at most a row for each fold and bucket
    out = np.zeros(folds * len(scale))
    out[cells[cells >= 0]] = total[cells >= 0]
    return out.reshape(folds, -1) / (total[cells < 0][0] * STEPS_OF_ONE)


def _shares(parts: DataFrame, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Share of the unlabelled margins in each bin."""
    shared = parts.sparkSession.sparkContext.broadcast((weights, edges))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, edges = shared.value
        n = np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            n += np.bincount(np.searchsorted(edges, Bags(b.column(0)).margins(weights)), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["bin", "n"])

    out = np.zeros(len(edges) + 1)
    for r in parts.select("columns").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most 101 bins
        out[r["bin"]] = r["n"]
    return out / max(out.sum(), 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, positives: int = POSITIVES, prior: float | None = None, least_z: float = LEAST_Z, buckets: int = BUCKETS, part: int = PART, folds: int = FOLDS) -> Model:
    """Learns from the rows of ``docs`` and ``labels`` (doc_id, toxic) for which ``train`` holds.

    At most ``positives`` confirmed toxic texts are read for the fit, those with
    the least id hash; every row learnt from counts as unlabelled, whatever its
    label. ``prior`` is the share of toxic texts; by default it is estimated.
    With fewer than two confirmed texts the model scores every text alike, below
    the threshold. Of conflicting labels of one id, toxic wins; null labels, and
    labels that aren't toxic, are passed over.
    """
    said = labels.where(train & (F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    sure = F.broadcast(cut(_least(said, positives)).withColumn("confirmed", F.lit(True)))  # at most ``positives`` ids
    rows = docs.where(train).select("doc_id", text_or_empty().alias("_text")).join(sure, "doc_id", "left").select(F.coalesce("confirmed", F.lit(False)).alias("confirmed"), "_text")
    counts = cut(_bucket_counts(rows, buckets))
    all_ = counts.where("bucket = -1").first()
    nothing = Model({}, -5.0, np.zeros(0), np.zeros(0), 0.0, buckets)
    if all_ is None or all_["p"] < 2:
        return nothing
    n_u, n_p = all_["u"], all_["p"]
    both = (F.col("u") + F.col("p") + 1) / (n_u + n_p + 2)
    z = ((F.col("p") + 0.5) / (n_p + 1) - (F.col("u") + 0.5) / (n_u + 1)) / F.sqrt(both * (1 - both) * F.lit(1 / (n_u + 1) + 1 / (n_p + 1)))
    listed = counts.where("bucket >= 0").select("bucket", F.abs(z).alias("z")).where(F.col("z") > least_z).orderBy("bucket").toPandas()  # at most ``buckets``
    place = {int(b): i for i, b in enumerate(listed["bucket"], 1)}
    scale = np.concatenate([[1.0], (listed["z"].to_numpy() - least_z) / UNIT_Z])

    bags = cut(_columns(rows, place, buckets))
    lists = bags.where("confirmed").select("columns").orderBy(F.xxhash64("columns"), "columns").limit(positives).toArrow()["columns"].combine_chunks()
    parts = cut(bags.select("columns").repartition(max(1, -(-n_u // part))))
    folds = min(folds, len(lists))
    at, margins, found = np.arange(len(lists)) % folds, np.zeros(len(lists)), None
    estimated = prior or FIRST_PRIOR
    for _ in range(1 if prior else 2):
        by_fold = _train(parts, lists, scale, estimated, folds)
        for f in range(folds):
            margins[at == f] = Bags(lists.filter(pa.array(at == f))).margins(by_fold[f])
        weights, edges = by_fold.mean(0), bin_edges(margins)
        share_p = np.bincount(np.searchsorted(edges, margins), minlength=len(edges) + 1) / len(margins)
        share_u = _shares(parts, weights, edges)
        estimated = prior or estimate_prior(share_p, share_u, len(margins))
        found = Model({b: float(weights[i]) for b, i in place.items() if weights[i]}, float(weights[0]), edges, posterior(share_p, share_u, estimated), estimated, buckets)
    return found


def _scores(shared) -> Callable[[list[str]], np.ndarray]:
    """A task's function from texts to scores by a broadcast model."""
    model = shared.value
    hashes = Hashes(model.buckets)
    return lambda texts: model.score(np.array([model.margin(hashes.of(t)) for t in texts], np.float64))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, score (0 to 1), predicted (1 from ``threshold``).

    Only the text is scored, all of it; null and empty texts get the score of a
    text without words. Other columns are not read, so their names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a weight for each bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(shared)
        for part, texts in texts_of(batches, 2):
            score = scores(texts)
            yield arrow_rows(part, (0, 1), ["_row", "doc_id", "score", "predicted"], [pa.array(score), pa.array((score >= threshold).astype(np.int32))])

    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))).select("_row", "doc_id", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, doc_id {kind}, score double, predicted int")


def _learns() -> Column:
    return crc_remainder("doc_id", 3) != 1


def op5_pu_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of those whose id's crc32 modulo 3 is not 1."""
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), _learns())
    found = score_toxicity(docs, model)
    return found.select("doc_id", (~_learns()).alias("held_out"), "score", "predicted")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; all columns as they came.

    One narrow pass, without a shuffle or new columns, so no name can clash.
    Null and empty texts are scored as texts without words; repeated rows share
    their fate; no rows, or no confirmed text to learn from, drop none.
    """
    shared = spark.sparkContext.broadcast(fit_toxicity(docs, table(spark, sf_dir, "labels"), _learns()))

    def judge() -> Callable[[list[str]], np.ndarray]:
        scores = _scores(shared)
        return lambda texts: scores(texts) < THRESHOLD

    return where_text(docs, judge)
