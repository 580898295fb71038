"""Language identification by unigram pieces, all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. A
word (a run of letters, with the mark of a word's begin) may be cut into pieces in
many ways; its probability is the sum over all of them, which a forward algorithm
takes in one pass over its places. A text's probability is the product over its
words, and Bayes' rule gives the languages' shares.

The piece probabilities come from rounds of expectation and maximisation: forward
and backward sums give how often each piece is expected in the words of a language.
Words are taken many at a time: all of them advance by one place together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.llm.common import arrow_rows, crc_remainder, cut, documents, text_or_empty, texts_of

MODEL = "piece_bpe_32k.model"
BEGIN = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Texts of a language that the fit reads, about, rounds of the fit, and letters of a word in it.
FIT_TEXTS, ROUNDS, FIT_LETTERS = 2_000, 3, 48
#: Weight of the pieces' shares in all languages, in pieces, and of an even share among those.
SMOOTH, EVEN = 500.0, 0.05
#: Languages, at most: the model takes 256 KB for each.
LANGS = 500
#: Words whose probabilities a task remembers, and letters taken at a time.
REMEMBERED, LETTERS = 500_000, 1 << 19
#: Places after which sums are scaled, lest they vanish.
SCALED = 8


def letter_words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(text.lower())


def spellings(path: str) -> list[str]:
    """The distinct ordinary pieces of a sentencepiece vocabulary in lower case, in order of first use."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(held.get_piece_size()) if not (held.is_control(i) or held.is_unknown(i) or held.is_byte(i)))
    found = dict.fromkeys(held.id_to_piece(i).lower() for i in plain)
    return [p for p in found if all(c.isalpha() or c == BEGIN and not k for k, c in enumerate(p))]


class Pieces:
    """A trie over pieces. Piece 0 stands for any single code point that is none."""

    def __init__(self, pieces: list[str]):
        self.names = ["", *pieces]
        self.longest = max(map(len, self.names))
        nodes: dict[tuple[int, int], int] = {}
        self.piece_at = [0]  # of each node; 0 if none ends there
        for k, piece in enumerate(pieces, 1):
            node = 0
            for c in map(ord, piece):
                if (node, c) not in nodes:
                    nodes[node, c] = len(self.piece_at)
                    self.piece_at.append(0)
                node = nodes[node, c]
            self.piece_at[node] = k
        self.piece_at = np.array(self.piece_at, np.int32)
        self.bits = (4 * len(nodes)).bit_length()
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for (node, c), to in nodes.items():
            at = int(self._slot(np.array([node << 21 | c]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.next[at] = node << 21 | c, to

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The children of nodes by code point; 0 where there is none."""
        keys = nodes.astype(np.int64) << 21 | chars
        out, at, left = np.zeros(len(keys), np.int32), self._slot(keys), np.arange(len(keys))
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.next[at[hit]]
            more = ~hit & (held >= 0)
            left, at = left[more], (at[more] + 1) % len(self.keys)
        return out


class Lattice:
    """Words side by side, longest first: which piece goes from each place over m letters."""

    def __init__(self, pieces: Pieces, words: list[str]):
        texts = [BEGIN + w for w in words]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        chars = np.frombuffer("".join([texts[i] for i in self.order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        room = np.repeat(self.begin + self.size, self.size) - np.arange(len(chars))  # letters to the word's end
        self.over: list[np.ndarray] = []
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int32)
        for m in range(pieces.longest):
            fits = room[at] > m
            at, node = at[fits], node[fits]
            if not len(at):
                break
            node = pieces.step(node, chars[at + m])
            at, node = at[node > 0], node[node > 0]
            found = np.full(len(chars), -1, np.int32)
            found[at] = np.where(pieces.piece_at[node] > 0, pieces.piece_at[node], -1)
            if not m:
                found[found < 0] = 0
            self.over.append(found)
        self.places = int(self.size[0]) if len(words) else 0

    def alive(self, k: int) -> int:
        """Words of at least k places."""
        return int(np.searchsorted(-self.size, -k, side="right"))

    def edges(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of the edges that end at place k: (letters, words, pieces)."""
        n = self.alive(k)
        for m in range(1, min(k, len(self.over)) + 1):
            piece = self.over[m - 1][self.begin[:n] + (k - m)]
            words = np.flatnonzero(piece >= 0)
            if len(words):
                yield m, words, piece[words]


def log_sums(lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Log probability of each word, summed over its segmentations, by each column of ``p`` (piece x language)."""
    n, langs, width = len(lattice.size), p.shape[1], max(1, len(lattice.over)) + 1
    ring = np.zeros((width, n, langs))
    ring[0] = 1.0
    scale, out = np.zeros((n, langs)), np.zeros((n, langs))
    for k in range(1, lattice.places + 1):
        alive = lattice.alive(k)
        here = np.zeros((alive, langs))
        for m, words, piece in lattice.edges(k):
            here[words] += ring[(k - m) % width, words] * p[piece]
        ring[k % width, :alive] = here
        ended = lattice.alive(k + 1)
        out[ended:alive] = np.log(here[ended:]) + scale[ended:alive]
        if not k % SCALED:
            most = ring[:, :ended].max(axis=0)
            ring[:, :ended] /= most
            scale[:ended] += np.log(most)
    back = np.empty_like(out)
    back[lattice.order] = out
    return back


def expected(lattice: Lattice, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of given weights, by one language's ``p``."""
    n = len(lattice.size)
    forward, back = np.zeros((lattice.places + 1, n)), np.zeros((lattice.places + 1, n))
    forward[0] = 1.0
    for k in range(1, lattice.places + 1):
        for m, words, piece in lattice.edges(k):
            forward[k, words] += forward[k - m, words] * p[piece]
    total = forward[lattice.size, np.arange(n)]
    back[lattice.size, np.arange(n)] = np.where(total > 0, weight[lattice.order] / np.maximum(total, 1e-300), 0)
    out = np.zeros(len(p))
    for k in range(lattice.places, 0, -1):
        for m, words, piece in lattice.edges(k):
            through = back[k, words] * p[piece]
            back[k - m, words] += through
            out += np.bincount(piece, through * forward[k - m, words], len(p))
    return out


def batches_of(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words with about LETTERS letters."""
    start, held = 0, 0
    for i, w in enumerate(words):
        held += len(w) + 1
        if held >= LETTERS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(words):
        yield start, len(words)


# -- fit ------------------------------------------------------------------------


def _fit_words(train: DataFrame) -> DataFrame:
    """(lang, word, f) of a fit's texts (lang, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 1):
            counts: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                counts.setdefault(lang, Counter()).update(w for w in letter_words(text) if len(w) <= FIT_LETTERS)
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "f"])

    return train.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Piece probabilities (piece x language) from expected counts: drawn to the shares in all languages, these to even ones."""
    every = counts.sum(axis=1)
    every = (1 - EVEN) * every / max(every.sum(), 1e-300) + EVEN / len(every)
    return (counts + SMOOTH * every[:, None]) / (counts.sum(axis=0) + SMOOTH)


class Model:
    """langs, log shares of the training texts, and piece probabilities (piece x language)."""

    def __init__(self, pieces: Pieces, langs: list[str], prior: np.ndarray, p: np.ndarray):
        self.pieces, self.langs, self.prior, self.p = pieces, langs, prior, p


def fit(train: DataFrame, path: str, rounds: int = ROUNDS, fit_texts: int = FIT_TEXTS) -> Model:
    """Learns from rows (lang, text, key); rows of a null lang or text are left out.

    Of each language about ``fit_texts`` whole texts are read, chosen by the hash
    of ``key``, all if there are fewer; the languages' shares count all rows. Words are counted
    and rounds are run in tasks; the driver gets a sum for each piece and language.
    """
    spark = train.sparkSession
    known = train.where("lang IS NOT NULL AND text IS NOT NULL")
    shares = known.groupBy("lang").count().orderBy("lang").limit(LANGS + 1).collect()
    if len(shares) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    langs = [r["lang"] for r in shares]
    pieces = Pieces(spellings(path))
    if not langs:
        return Model(pieces, [], np.zeros(0), np.zeros((len(pieces.names), 0)))
    prior = np.log(np.array([r["count"] for r in shares], float) / sum(r["count"] for r in shares))
    # Each language's share of hashes that makes its fit's texts: no row is moved to choose them.
    part = spark.createDataFrame([(r["lang"], min(1.0, fit_texts / r["count"])) for r in shares], "lang string, _part double")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    chosen = known.join(F.broadcast(part), "lang").where(place < F.col("_part")).select("lang", "text")  # at most LANGS rows
    words = cut(_fit_words(chosen))
    shared, at = spark.sparkContext.broadcast(pieces), {g: i for i, g in enumerate(langs)}

    def sums(p: np.ndarray | None) -> np.ndarray:
        held = spark.sparkContext.broadcast(p)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, p, found = shared.value, held.value, {}
            for b in batches:
                lang, word, f = (np.array(b.column(i).to_pylist(), object) for i in range(3))
                for g in sorted(set(lang)):
                    mine = lang == g
                    mine_words, weight = word[mine].tolist(), f[mine].astype(float)
                    into = found.setdefault(at[g], np.zeros(len(pieces.names)))
                    for x, y in batches_of(mine_words):
                        lattice = Lattice(pieces, mine_words[x:y])
                        if p is not None:
                            into += expected(lattice, weight[x:y], p[:, at[g]])
                            continue
                        for k in range(1, lattice.places + 1):  # first, every use that could be
                            for m, words, piece in lattice.edges(k):
                                into += np.bincount(piece, weight[x:y][lattice.order[words]] * m, len(into))
            for g, c in found.items():
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g)), pa.array(some), pa.array(c[some])], names=["g", "piece", "n"])

        total = np.zeros((len(pieces.names), len(langs)))
        rows = words.mapInArrow(run, "g long, piece long, n double").groupBy("g", "piece").agg(F.sum("n").alias("n")).toArrow()
        np.add.at(total, (rows["piece"].to_numpy(), rows["g"].to_numpy()), rows["n"].to_numpy())
        return total

    p = _smoothed(sums(None))
    for _ in range(rounds):
        p = _smoothed(sums(p))
    return Model(pieces, langs, prior, p)


# -- prediction -----------------------------------------------------------------


class Scorer:
    """Log probabilities of texts by language; words that came before are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self._anew()

    def _anew(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)))

    def _learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        # Numerals that aren't digits count as parts of words, but are none by themselves.
        void = np.array([not (w.isalpha() or any(map(str.isalpha, w))) for w in new], bool)
        parts = [log_sums(Lattice(self.model.pieces, new[x:y]), self.model.p) for x, y in batches_of(new)]
        if parts:
            got = np.concatenate(parts)
            got[void] = np.nan
            self.known |= {w: len(self.table) + i for i, w in enumerate(new)}
            self.table = np.concatenate([self.table, got])

    def scores(self, texts: list[str]) -> np.ndarray:
        """(text x language): log probabilities with the languages' shares; NaN for texts without letters."""
        out = np.full((len(texts), len(self.model.langs)), np.nan)
        words = [letter_words(t) for t in texts]
        self._learn([w for ws in words for w in ws])
        for i, ws in enumerate(words):
            if ws:
                rows = self.table[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))]
                rows = rows[~np.isnan(rows[:, 0])]
                if len(rows):
                    out[i] = rows.sum(axis=0) + self.model.prior
        if len(self.known) > REMEMBERED:
            self._anew()
        return out


#: Bytes of texts scored at once.
SCORED_BYTES = 4 << 20


def predict(docs: DataFrame, model: Model, keep: Iterable[Column], text_col: str = "text") -> DataFrame:
    """``keep``'s columns, lang_pred and score (the language's share by Bayes' rule) of every whole text.

    Texts without letters, null and empty ones, and all if no language was learned,
    are ``und`` with score 0. Of equal shares the first language in code-point order wins.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, text_or_empty(text_col).alias("_text"))
    last = len(rows.columns) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = Scorer(held.value), held.value.langs
        for part, texts in texts_of(batches, last, SCORED_BYTES):
            pred, share = ["und"] * len(texts), np.zeros(len(texts))
            if langs:
                logs = scorer.scores(texts)
                some = np.flatnonzero(~np.isnan(logs[:, 0]))
                logs = logs[some]
                best = logs.argmax(axis=1)
                share[some] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b in zip(some.tolist(), best.tolist(), strict=True):
                    pred[i] = langs[b]
            yield arrow_rows(part, range(last), names, [pa.array(pred, pa.string()), pa.array(share)])

    names = [*rows.columns[:-1], "lang_pred", "score"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from those whose id's crc32 mod 4 is not 2."""
    import public_tokenizers

    docs = documents(spark, sf_dir)
    held_out = crc_remainder("doc_id", 4) == 2
    model = fit(docs.where(~held_out).select("lang", "text", F.col("doc_id").alias("key")), public_tokenizers.path(MODEL))
    return predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
