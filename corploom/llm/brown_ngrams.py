"""Language-model scoring with Brown class-based n-grams.

P(word | previous word) = P(class | previous class) * P(word | class). Frequent
words are units of their own; all other words share a unit with those that end
in the same two code points, if that ending is frequent, else one last unit.
Exchange clustering (Brown et al. 1992, with the exchange algorithm of Kneser
and Ney) moves units between classes while the likelihood of the bigrams grows.
It starts on the most frequent words and the endings, whose pairs are few enough
to be counted one by one. Then, in rounds, Spark counts for every unit the
classes before and behind it in the whole corpus, and each unit moves to the
class that these counts favour (as in Uszkoreit and Brants 2008).

Counts cover the whole training corpus and are shuffled as sums. What tasks get
to look words up is bounded: the units and the ``LOOKUP`` most frequent words.
Words beyond those are joined with their counts, so every token is scored with
its exact count however many distinct words there are. Texts are split once;
later passes read them as numbers from a table in the shared folder.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import arrow_rows, crc_remainder, cut, documents, numbered, text_or_empty, texts_of
from corploom.session import checkpoint_dir

#: Words and endings that are units; words whose pairs are counted one by one; words whose counts tasks hold.
UNIT_WORDS, UNIT_ENDINGS, FIRST_WORDS, LOOKUP = 20_000, 500, 1_000, 100_000
#: Classes, and rounds in which all units may move.
CLASSES, ROUNDS = 64, 3
#: Distinct words that a task counts before it passes the counts on.
HELD = 200_000
#: Bytes of texts that a task splits at once; numbers that it looks up at once.
SPLIT_BYTES, AT_ONCE = 4 << 20, 1 << 18
#: Cells of a matrix in a row of sums; a cell's place in it takes two bytes.
CELLS = 1 << 15
#: The token at the end of each text; no word is empty.
END = b""


def tokens(text: str) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased, and the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def ending(word: bytes) -> bytes:
    """The last two code points of a word."""
    at, seen = len(word), 0
    while at and seen < 2:
        at -= 1
        seen += word[at] & 0xC0 != 0x80
    return word[at:]


@dataclass
class Units:
    """Numbers of words and units.

    A word's number is 0 for the end, its rank if tasks hold it, else beyond
    all ranks the number of its ending, the last one if that has none. Units
    are the end, the ``own`` - 1 most frequent words, the endings and the rest.
    """

    numbers: dict[bytes, int]
    endings: dict[bytes, int]
    own: int
    #: By number: the word's count (0 beyond the ranks) and its unit.
    counts: np.ndarray
    unit: np.ndarray
    #: By unit: that of the first clustering, in which only the first words are units; those number ``firsts``.
    first: np.ndarray
    firsts: int

    @property
    def size(self) -> int:
        return len(self.first)

    def number(self, word: bytes) -> int:
        found = self.numbers.get(word)
        return self.endings.get(ending(word), len(self.unit) - 1) if found is None else found

    def of(self, word: bytes) -> int:
        return int(self.unit[self.number(word)])


# -- exchange ---------------------------------------------------------------


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(big: np.ndarray) -> float:
    """Of the bigrams, up to what no move of a unit changes, from the counts of class pairs."""
    return float(_h(big).sum() - _h(big.sum(0)).sum() - _h(big.sum(1)).sum())


def _move(big: np.ndarray, k: int, right: np.ndarray, left: np.ndarray, loop: float) -> int:
    """Moves a unit of class ``k`` to the class that raises the likelihood most and updates ``big``; class 0 takes none.

    ``right`` and ``left`` count the classes behind and before the unit, without
    the unit itself, which follows itself ``loop`` times.
    """
    big[k] -= right
    big[:, k] -= left
    big[k, k] -= loop
    rows, cols = big.sum(1) + left, big.sum(0) + right  # whatever class the unit joins
    r, c = np.flatnonzero(right), np.flatnonzero(left)
    d = big.diagonal()
    # Change of sum h(N_ij) - sum h(row) - sum h(col) when the unit joins each class.
    gain = (_h(big[:, r] + right[r]) - _h(big[:, r])).sum(1) + (_h(big[c] + left[c, None]) - _h(big[c])).sum(0)
    gain += _h(d + right + left + loop) - _h(d + right) - _h(d + left) + _h(d)
    out, into = right.sum() + loop, left.sum() + loop
    gain -= _h(rows + out) - _h(rows) + _h(cols + into) - _h(cols)
    gain[0] = -np.inf
    best = int(np.argmax(gain))
    if gain[best] <= gain[k] + 1e-9:
        best = k
    big[best] += right
    big[:, best] += left
    big[best, best] += loop
    return best


def exchange(pairs: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each unit from the dense counts of unit pairs; unit 0 (the end) has class 0 to itself.

    Units start in classes by frequency rank; each in turn moves to the class
    that raises the bigram likelihood most, until a round moves none.
    """
    n = len(pairs)
    totals = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-totals[1:], kind="stable") + 1
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % max(classes - 1, 1)
    if classes < 3:
        return of
    onehot = np.eye(classes)
    big = onehot[of].T @ pairs @ onehot[of]
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not totals[u]:
                continue
            loop = pairs[u, u]
            right = np.bincount(of, pairs[u], minlength=classes)  # u before a class
            left = np.bincount(of, pairs[:, u], minlength=classes)
            right[of[u]] -= loop
            left[of[u]] -= loop
            best = _move(big, int(of[u]), right, left, loop)
            moved += best != of[u]
            of[u] = best
        if not moved:
            break
    return of


def sweep(around: np.ndarray, of: np.ndarray, classes: int, turn: np.ndarray) -> np.ndarray:
    """New classes of the units in ``turn``, most frequent first; ``around`` is context_counts() under ``of``.

    The counts of class pairs follow every move, those around units wait for
    the next round.
    """
    of = of.copy()
    right, left, loop = around[:, :classes].astype(float), around[:, classes : 2 * classes].astype(float), around[:, -1].astype(float)
    big = np.zeros((classes, classes))
    np.add.at(big, of, right)
    for u in turn[np.argsort(-right[turn].sum(1), kind="stable")]:
        r, c = right[u].copy(), left[u].copy()
        if u and r.any():
            r[of[u]] -= loop[u]
            c[of[u]] -= loop[u]
            of[u] = _move(big, int(of[u]), np.maximum(r, 0), np.maximum(c, 0), loop[u])
    return of


# -- the model --------------------------------------------------------------


@dataclass
class Model:
    """Logarithms (base 10) of transitions between the classes of units and of units in their class."""

    units: Units
    step: np.ndarray  # (class before, class)
    of: np.ndarray  # class of each unit
    unit: np.ndarray  # of a unit in its class
    spread: np.ndarray  # of a word with count 1 / 2 in its unit; 0 for units of one word
    base: float  # log of N + 0.5 (V + 1)


def build(units: Units, of: np.ndarray, big: np.ndarray, seen: np.ndarray, open_sizes: np.ndarray, total: int, distinct: int) -> Model:
    """A model from the counts of class pairs and of units and, of each unit that words share, the number of distinct words.

    A class after a class: counts, with a part of the weight for the classes'
    own frequencies. A unit in a class: its share. A word in a shared unit:
    (count + 0.5) over the unit's counts + 0.5 for each of its words and for
    one unknown word. All sums are 1.
    """
    classes = len(big)
    own = np.bincount(of, seen, minlength=classes)
    prior = (own + 0.5) / (own + 0.5).sum()
    weight = 5.0
    step = np.log10((big + weight * prior) / (big.sum(1, keepdims=True) + weight))
    shared = np.arange(units.size) >= units.own
    mass = seen + np.where(shared, 0.5, 1e-9)
    unit = np.log10(mass / np.bincount(of, mass, minlength=classes)[of])
    spread = np.zeros(units.size)
    spread[shared] = -np.log10(seen[shared] + 0.5 * (open_sizes[shared] + 1))
    return Model(units, step, of, unit, spread, float(np.log10(total + 0.5 * (distinct + 1))))


# -- on Spark ---------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n): tokens of all texts, the end included; tasks add up before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for _, texts in texts_of(batches, most=SPLIT_BYTES):
            for text in texts:
                counts.update(tokens(text))
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(text_or_empty(text_col).alias("_text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def units_of(counts: DataFrame, unit_words: int = UNIT_WORDS, unit_endings: int = UNIT_ENDINGS, lookup: int = LOOKUP, first_words: int = FIRST_WORDS) -> tuple[Units, np.ndarray]:
    """(units, distinct words of each unit that words share) from stored word_counts(); the driver gets ``lookup`` words."""
    words = counts.where(F.length("word") > 0)
    wanted = max(lookup, unit_words)
    # A histogram of the counts, at most 1,024 bars, tells from where on words are
    # frequent enough, so that the sort sees few more words than it keeps.
    bar = F.floor(F.log2("n") * 16)
    bars, enough, so_far = sorted(words.groupBy(bar.alias("bar")).count().collect(), reverse=True), 0, 0
    for r in bars:
        if so_far < wanted:
            enough, so_far = r["bar"], so_far + r["count"]
    top = words.where(bar >= enough).orderBy(F.desc("n"), "word").limit(wanted).toArrow()
    ranked = top["word"].to_pylist()
    numbers = {END: 0} | {w: i for i, w in enumerate(ranked, 1)}
    at_end = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    own = 1 + min(unit_words, len(ranked))
    frame = counts.sparkSession.createDataFrame([(w,) for w in ranked[: own - 1]], "word binary")  # at most unit_words rows
    rest = words.join(F.broadcast(frame), "word", "left_anti")
    # The last two code points, as ending() takes them; words are UTF-8.
    tail = F.encode(F.right(F.decode("word", "UTF-8"), F.lit(2)), "UTF-8")
    tails = cut(rest.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("words")))
    chosen = tails.orderBy(F.desc("n"), "tail").limit(unit_endings).collect()
    left = tails.agg(F.sum("words")).first()[0] or 0
    endings = {bytes(r["tail"]): 1 + len(ranked) + i for i, r in enumerate(chosen)}
    of_ending = lambda w: own + endings.get(ending(w), 1 + len(ranked) + len(chosen)) - 1 - len(ranked)
    unit = np.array([*range(own), *map(of_ending, ranked[own - 1 :]), *range(own, own + len(chosen) + 1)], np.int32)
    n = np.array([at_end, *top["n"].to_pylist(), *[0] * (len(chosen) + 1)], np.int64)
    size = own + len(chosen) + 1
    sizes = np.zeros(size)
    sizes[own : size - 1] = [r["words"] for r in chosen]
    sizes[-1] = left - sizes.sum()
    kept = min(own, 1 + first_words)
    first = np.arange(size) - (own - kept)
    first[:kept] = np.arange(kept)
    first[kept:own] = [first[of_ending(w)] for w in ranked[kept - 1 : own - 1]]
    return Units(numbers, endings, own, n, unit, first.astype(np.int32), kept + len(chosen) + 1), sizes


def encoded(docs: DataFrame, units: Units, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of the texts as numbers: _row, doc_id, train, n_tokens, numbers, rare.

    rare has the words that tasks don't hold, each with its times in the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(units)  # at most LOOKUP words and the endings

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        known, memo = u.numbers.get, {}
        for part, texts in texts_of(batches, 3, SPLIT_BYTES):
            sizes, numbers, rare, times, ends = [], [], [], [], [0]
            for text in texts:
                words = tokens(text)
                found = list(map(known, words))
                open_: Counter[bytes] = Counter()
                if None in found:
                    if len(memo) > HELD:
                        memo.clear()
                    for i, number in enumerate(found):
                        if number is None:
                            w = words[i]
                            open_[w] += 1
                            number = memo.get(w)
                            if number is None:
                                number = memo[w] = u.number(w)
                            found[i] = number
                sizes.append(len(found))
                numbers.append(np.array(found, np.int32))
                rare.extend(open_)
                times.extend(open_.values())
                ends.append(len(rare))
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int32)))
            open_words = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"])
            yield arrow_rows(part, (0, 1, 2), ["_row", "doc_id", "train", "n_tokens", "numbers", "rare"], [pa.array(sizes, pa.int64()), lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), open_words)])

    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), text_or_empty(text_col).alias("_text"))).select("_row", "doc_id", "train", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    path = f"{checkpoint_dir(docs.sparkSession)}/numbers-{uuid.uuid4().hex}"
    rows.mapInArrow(run, f"_row long, doc_id {kind}, train boolean, n_tokens long, numbers array<int>, rare array<struct<word:binary,times:bigint>>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _block_sums(texts: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all training texts of the matrix to which ``add`` adds, in place and flat, numbers and those before them.

    Each text ends with the end, so texts in a row lead each other in. Tasks add
    up all of theirs in one matrix and pass on blocks of ``CELLS`` cells, of
    which only those above 0, in as few bytes as their counts need; their sums
    are added in two levels, so that no group has more than about twice the
    square root of the tasks' number.
    """
    size = shape[0] * shape[1]

    def packed(block: int, sums: np.ndarray) -> tuple[int, bytes, bytes]:
        at = np.flatnonzero(sums)
        n = sums[at]
        return block, at.astype(np.uint16).tobytes(), n.astype(np.min_scalar_type(n.max(initial=0))).tobytes()

    def unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
        return (cells := np.frombuffer(at, np.uint16)), np.frombuffer(n, f"u{len(n) // len(cells)}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros(size, np.int64), 0
        for batch in batches:
            numbers = _flat(batch.column(0))
            for start in range(0, len(numbers), AT_ONCE):
                now = numbers[start : start + AT_ONCE]
                add(total, _before(now, last), now)
                last = now[-1]
        for start in range(0, size, CELLS):
            block, at, n = packed(start // CELLS, total[start : start + CELLS])
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at], pa.binary()), pa.array([n], pa.binary())], names=["block", "at", "n"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS, np.int64)
        for row in zip(pdf["at"], pdf["n"], strict=True):
            at, n = unpacked(*row)
            total[at] += n.astype(np.int64)
        return pd.DataFrame([packed(pdf["block"].iloc[0], total)], columns=["block", "at", "n"])

    schema = "block int, at binary, n binary"
    parts = texts.where("train").select("numbers").mapInArrow(run, schema)
    once = parts.withColumn("salt", F.floor(F.sqrt(F.spark_partition_id()))).groupBy("block", "salt").applyInPandas(together, schema)
    out = np.zeros(size, np.int64)
    for r in once.groupBy("block").applyInPandas(together, schema).toArrow().to_pylist():  # at most the cells of the matrix
        at, n = unpacked(r["at"], r["n"])
        out[r["block"] * CELLS + at.astype(np.int64)] = n
    return out.reshape(shape)


def _before(units: np.ndarray, first: int = 0) -> np.ndarray:
    """What comes before each of some texts' tokens in a row; ``first``, the end unless given, before the first."""
    return np.concatenate([np.array([first], units.dtype), units[:-1]])


def first_pairs(texts: DataFrame, units: Units) -> np.ndarray:
    """Dense counts of pairs of units of the first clustering, each text led in by the end."""
    shared = texts.sparkSession.sparkContext.broadcast(units.first[units.unit].astype(np.int64))
    n = units.firsts

    def add(total: np.ndarray, before: np.ndarray, numbers: np.ndarray) -> None:
        of_ = shared.value
        np.add.at(total, of_[before] * n + of_[numbers], 1)

    return _block_sums(texts, add, (n, n)).astype(float)


def context_counts(texts: DataFrame, units: Units, of: np.ndarray, classes: int) -> np.ndarray:
    """A row for each unit: how often each class is behind it, before it, and it behind itself."""
    shared = texts.sparkSession.sparkContext.broadcast((units.unit.astype(np.int64), of))  # bounded by LOOKUP and the units
    width = 2 * classes + 1

    def add(total: np.ndarray, before: np.ndarray, numbers: np.ndarray) -> None:
        unit, of_ = shared.value
        a, b = unit[before], unit[numbers]
        np.add.at(total, a * width + of_[b], 1)
        np.add.at(total, b * width + classes + of_[a], 1)
        np.add.at(total, b[a == b] * width + 2 * classes, 1)

    return _block_sums(texts, add, (units.size, width))


def fit(texts: DataFrame, units: Units, open_sizes: np.ndarray, total: int, distinct: int, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """A model of the training rows of encoded() texts; the driver gets sums by unit, never by pair of units.

    In each round half of the units may move, so that neighbours don't move at
    once on each other's old classes; the classes of the best round are kept.
    """
    classes = min(classes, max(2, units.firsts))
    of = exchange(first_pairs(texts, units), classes)[units.first]
    best = None
    for turn in range(2 * rounds + 1):
        around = context_counts(texts, units, of, classes)
        big = np.zeros((classes, classes))
        np.add.at(big, of, around[:, :classes])
        value = likelihood(big)
        if best is None or value > best[0]:
            best = value, of, big, around[:, classes:-1].sum(1)
        if classes < 3 or turn == 2 * rounds:
            break
        of = sweep(around, of, classes, np.arange(1 + turn % 2, units.size, 2))
    _, of, big, seen = best
    return build(units, of, big, seen.astype(float), open_sizes, total, distinct)


def score(texts: DataFrame, model: Model, counts: DataFrame, total: int) -> DataFrame:
    """One row per row of encoded() ``texts``: _row, doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-0.5 unigram log10 probability, score the class
    model's; the end counts as a token. Null and empty texts are one token, the
    end. Equal rows each give a row; with nothing learnt every token is
    unknown; no rows give none. Other columns are not read, so their names
    can't clash.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by LOOKUP and the units

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        u = m.units
        ranked = np.arange(len(u.unit)) < len(u.numbers)
        logs = np.where(ranked, np.log10(u.counts + 0.5), 0.0)
        own = np.where(u.unit < u.own, 0.0, logs) + m.spread[u.unit] + m.unit[u.unit]
        of = m.of[u.unit]
        held = ranked & (u.counts > 0)
        for batch in batches:
            ends, start = np.cumsum(batch.column(3).to_numpy()), 0
            while start < batch.num_rows:
                begun = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, begun + AT_ONCE, "right")))
                part = batch.slice(start, stop - start)
                numbers = _flat(part.column(4))
                starts = np.concatenate([[0], ends[start : stop - 1] - begun])
                classes = of[numbers]
                inside = np.add.reduceat(own[numbers] + m.step[_before(classes), classes], starts)
                columns = [np.add.reduceat(held[numbers].astype(np.int64), starts), np.add.reduceat(logs[numbers], starts), inside]
                yield arrow_rows(part, (0, 1, 2, 3), ["_row", "doc_id", "train", "n_tokens", "known", "base", "inside"], [pa.array(x) for x in columns])
                start = stop

    kind = texts.schema["doc_id"].dataType.simpleString()
    parts = texts.select("_row", "doc_id", "train", "n_tokens", "numbers").mapInArrow(run, f"_row long, doc_id {kind}, train boolean, n_tokens long, known long, base double, inside double")
    # Only the words, their texts' numbers and times travel to the counts, and only sums by text from there.
    rare = texts.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.times")
    joined = rare.join(counts, "word", "left")
    logs = F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5))
    known = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))
    more = joined.groupBy("_row").agg(logs.alias("logs"), known.alias("more"))
    found = parts.join(more, "_row", "left").na.fill(0, ["logs", "more"])
    return found.select(
        "_row",
        "doc_id",
        "train",
        "n_tokens",
        (F.col("known") + F.col("more")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(model.base)).alias("base_score"),
        (F.col("inside") + F.col("logs")).alias("score"),
    )


def score_documents(docs: DataFrame, train: Column, unit_words: int = UNIT_WORDS, unit_endings: int = UNIT_ENDINGS, lookup: int = LOOKUP, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model, DataFrame]:
    """(scores of all rows of ``docs``, the model of those for which ``train`` holds, word counts); see score().

    ``docs`` must be a scan of stored data (see ``numbered``).
    """
    counts = cut(word_counts(docs.where(F.coalesce(train, F.lit(False))), text_col))
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    units, open_sizes = units_of(counts, unit_words, unit_endings, lookup)
    texts = encoded(docs, units, train, id_col, text_col)
    model = fit(texts, units, open_sizes, total, distinct, classes, rounds)
    return score(texts, model, counts, total), model, counts


def op10_brown_ngrams(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of those whose id's crc32 modulo 5 is not 1."""
    found, _, _ = score_documents(documents(spark, sf_dir), crc_remainder("doc_id", 5) != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
