"""Benchmark decontamination: BM25 inverted index of test items with block-max WAND.

The test items are the index (long ones in several entries), every passage of
the training texts is a query. Impacts are scaled by each entry's own threshold
(a share of the score that its text gets against itself), so that one threshold,
1, holds for all. A passage goes on only while its upper bounds allow a hit:
first the sum of its terms' maxima, then the sums over blocks of entries, then
block-max WAND with pivots. That returns every entry above the threshold; an
item counts as leaked if the word 5-grams of its question and of its answer both
recur around the passage.

The index is read in shards of bounded size (items and characters), each small
enough to broadcast; more items give more shards and more passes over the
texts, never a larger broadcast. Texts are not shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import documents, numbered, table, text_or_empty, texts_of, where_text

#: ASCII other than letters, digits and _ parts words; so does punctuation of some other blocks.
_ASCII = bytes.maketrans(SEPARATORS := bytes(c for c in range(128) if not (chr(c).isalnum() or c == 95)), b" " * len(SEPARATORS))
_OTHER = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f]+")
#: Words of a passage; passages start every half of it.
PASSAGE = 64
#: Words of an index entry at most: a longer item has several, of about equal length.
ENTRY = 48
#: Share of an entry's own score that a passage must reach.
SHARE = 0.6
#: Words of a shingle, and the share of shingles that must recur.
SHINGLE, OVERLAP = 5, 0.8
#: Bounds of a shard.
SHARD_ITEMS, SHARD_CHARS = 2_000, 1_000_000
#: Entries of a block.
BLOCK = 8
#: Words bounded at a time, so that a very long text needs little memory.
CHUNK = 1 << 12
K1, B = 1.2, 0.75


def tokens(text: str) -> list[bytes]:
    """Lower-case words in UTF-8."""
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_ASCII).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The word 5-grams; of fewer words, the whole sequence; of none, nothing."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def overlap(part: list[bytes], around: list[bytes]) -> float:
    """Share of a part's shingles that recur in the words around; 1 for a part without words."""
    wanted = shingles(part)
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    there = set(zip(*(around[i:] for i in range(n)), strict=False))
    return len(wanted & there) / len(wanted)


class Index:
    """BM25 postings of test items' entries with maxima by term and by block of entries."""

    def __init__(self, items: list[tuple[int | None, str, str]], share: float = SHARE):
        parts = [(i, tokens(q or ""), tokens(a or "")) for i, q, a in items]
        self.items = [x for x in parts if x[1] or x[2]]
        self.of, bags = [], []  # of each entry: its item, its words
        for k, (_, q, a) in enumerate(self.items):
            words, pieces = q + a, -(-len(q + a) // ENTRY)
            for p in range(pieces):
                self.of.append(k)
                bags.append(Counter(words[len(words) * p // pieces : len(words) * (p + 1) // pieces]))
        n, mean = max(len(bags), 1), sum(sum(b.values()) for b in bags) / max(len(bags), 1)
        df = Counter(t for b in bags for t in b)
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        idf = {t: np.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.threshold = np.zeros(len(bags))
        for k, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            impacts = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in bag.items()}
            self.threshold[k] = share * sum(impacts.values())
            for t, x in impacts.items():
                postings[self.terms[t]].append((k, x / self.threshold[k]))
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64)
        self.item = np.array([k for p in postings for k, _ in p], np.int64)
        self.impact = np.array([x for p in postings for _, x in p], np.float64)
        self.block_max = np.zeros((len(postings), max(-(-len(bags) // BLOCK), 1)), np.float32)
        term = np.repeat(np.arange(len(postings)), np.diff(self.start))
        np.maximum.at(self.block_max, (term, self.item // BLOCK), self.impact.astype(np.float32) * np.float32(1.0001))
        self.term_max = self.block_max.max(axis=1) if len(postings) else np.zeros(0, np.float32)

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: every (entry, scaled score) of at least 1 for the distinct ``terms``."""
        blocks = np.flatnonzero(self.block_max[terms].sum(axis=0, dtype=np.float64) >= 1)
        found: list[tuple[int, float]] = []
        for block in blocks.tolist():  # blocks whose maxima stay below 1 are skipped whole
            lists = []
            for t, most in zip(terms.tolist(), self.block_max[terms, block].tolist(), strict=True):
                if most > 0:
                    lo, hi = int(self.start[t]), int(self.start[t + 1])
                    a, b = lo + np.searchsorted(self.item[lo:hi], (block * BLOCK, (block + 1) * BLOCK))
                    lists.append([0, most, self.item[a:b].tolist(), self.impact[a:b].tolist()])
            self._pivots(lists, found)
        return found

    @staticmethod
    def _pivots(lists: list[list], found: list[tuple[int, float]]) -> None:
        """WAND over the lists (cursor, maximum, entries, impacts) of one block."""
        while True:
            lists = sorted((x for x in lists if x[0] < len(x[2])), key=lambda x: x[2][x[0]])
            total, pivot = 0.0, None
            for x in lists:
                total += x[1]
                if total >= 1:
                    pivot = x[2][x[0]]
                    break
            if pivot is None:
                return
            score = 0.0
            for x in lists:  # all lists up to the pivot go to it
                here = x[2][x[0]]
                if here > pivot:
                    break
                if here < pivot:
                    x[0] = bisect_left(x[2], pivot, x[0])
                if x[0] < len(x[2]) and x[2][x[0]] == pivot:
                    score += x[3][x[0]]
                    x[0] += 1
            if score >= 1:
                found.append((pivot, score))

    def passages(self, ids: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, distinct terms) of the passages whose bounds allow a hit; ids: a term or -1 for each word."""
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        terms = ids[at]
        order = np.argsort(terms, kind="stable")
        before = np.full(len(at), -(1 << 40))
        same = terms[order][1:] == terms[order][:-1]
        before[order[1:][same]] = at[order[:-1][same]]
        high = self.term_max[terms]
        for shift in (0, size // 2):
            window = (at + shift) // size
            new = (before + shift) // size != window
            chosen = np.flatnonzero(new & (np.bincount(window, high * new) >= 1)[window])
            for lo in range(0, int(window[-1]) + 1, CHUNK // size) if len(chosen) else ():
                part = chosen
                if window[-1] >= CHUNK // size:
                    part = chosen[slice(*np.searchsorted(window[chosen], (lo, lo + CHUNK // size)))]
                if not len(part):
                    continue
                first = np.flatnonzero(np.diff(window[part], prepend=-1))
                bound = np.add.reduceat(self.block_max[terms[part]], first, axis=0)
                ends = np.append(first[1:], len(part))
                for w in np.flatnonzero((bound >= 1).any(axis=1)):
                    mine = part[first[w] : ends[w]]
                    yield int(window[mine[0]]) * size - shift, terms[mine]

    def leaks(self, text: str, size: int = PASSAGE) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word) of each item leaked into a text; its best passage."""
        words = tokens(text)
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        best: dict[int, tuple[int, float, float, float, int]] = {}
        for first, terms in self.passages(ids, size):
            for entry, score in self.search(terms):
                k, score = self.of[entry], score * float(self.threshold[entry])
                if k in best and score <= best[k][1]:
                    continue
                _, question, answer = self.items[k]
                reach = len(question) + len(answer)
                around = words[max(0, first - reach) : max(0, first) + size + reach]
                if reach < SHINGLE:  # few words tell little, so that all must come one after another
                    question, answer = question + answer, []
                q, a = overlap(question, around), overlap(answer, around)
                if q >= OVERLAP and a >= OVERLAP:
                    best[k] = (k, score, q, a, max(0, first))
        return sorted(best.values())


def with_answer(items: DataFrame) -> DataFrame:
    """(item_id, question, answer) from (item_id, text): the answer is the last sentence, if there are two."""
    text = F.trim(text_or_empty())
    cut_at = F.regexp_extract(text, r"(?s)^(.*[.?!])\s+[^.?!]+[.?!]*$", 1)
    answer = F.when(cut_at != "", F.substring(text, F.length(cut_at) + 1, F.length(text))).otherwise(F.lit(""))
    return items.select("item_id", F.when(cut_at != "", cut_at).otherwise(text).alias("question"), answer.alias("answer"))


def leaked_items(docs: DataFrame, items: DataFrame, share: float = SHARE, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` and item leaked into it: _row, doc_id, item_id, score, question_overlap, answer_overlap, word.

    ``docs`` must be a scan of stored data (see ``numbered``); ``items`` has
    item_id, question, answer. Null texts, questions and answers count as
    empty; an item without an answer is judged by its question; of an item of
    fewer than five words all must recur one after another; items without words
    match nothing. Equal items and repeated rows each give their own rows; no
    rows or no items give none. Other columns are not read.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))).select("_row", "doc_id", "_text")
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"_row long, doc_id {id_type}, item_id {item_type}, score double, question_overlap double, answer_overlap double, word int"
    out = None
    for index in indexes(items, share):
        found = rows.mapInArrow(_leaks_in(docs.sparkSession.sparkContext.broadcast(index), passage), schema)
        out = found if out is None else out.union(found)
    return out


def indexes(items: DataFrame, share: float = SHARE) -> Iterator[Index]:
    """The index of (item_id, question, answer), a bounded shard at a time; one shard at least."""
    items = items.select("item_id", text_or_empty("question").alias("question"), text_or_empty("answer").alias("answer"))
    chars = F.coalesce(F.sum(F.length("question") + F.length("answer")), F.lit(0))
    n, total = items.agg(F.count("*"), chars).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-total // SHARD_CHARS))
    for shard in range(shards):
        of = F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(shards)) == shard
        yield Index(sorted(map(tuple, items.where(of).collect()), key=lambda x: (x[0] is None, x)), share)


def _leaks_in(shared, passage: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part, texts in texts_of(batches, 2):
            found = [(i, *leak) for i, t in enumerate(texts) for leak in index.leaks(t, passage)]
            if found:
                at, k, score, q, a, first = zip(*found, strict=True)
                kept = part.take(pa.array(at))
                names = ["_row", "doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word"]
                ids = pa.array([index.items[x][0] for x in k])
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), ids, pa.array(score), pa.array(q), pa.array(a), pa.array(first, pa.int32())], names=names)

    return run


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all test items."""
    return leaked_items(documents(spark, sf_dir), with_answer(table(spark, sf_dir, "benchmark"))).drop("_row")


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a leaked test item go; all columns as they came.

    One narrow pass for each shard of the items, without a shuffle or new
    columns, so no name can clash. Null and empty texts leak nothing; repeated
    rows share their fate; no rows, or no items, drop none.
    """
    for index in indexes(with_answer(table(spark, sf_dir, "benchmark"))):
        docs = where_text(docs, _clean_of(spark.sparkContext.broadcast(index)))
    return docs


def _clean_of(shared):
    return lambda: lambda texts: np.array([not shared.value.leaks(t) for t in texts], bool)
