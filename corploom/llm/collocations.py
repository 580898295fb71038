"""Phrase collocations by HAT-trie counting.

Each task counts phrases in a HAT-trie: a shallow trie over word ids whose leaves
are hash containers of the words that follow; a container that grows too large
bursts into a node with a container for each next word. When the trie outgrows its
memory, its largest subtrees leave whole as sorted runs of phrases with their
counts. A run is cut by prefix partition, a hash of the first words, into compressed
blocks, and each prefix partition merges its blocks. There are as many partitions as
the corpus has words for, and a prefix is three words (of pairs both), so that none
is much larger than the others.

Counting goes by length: words, then pairs of frequent words, then phrases whose
pairs are all frequent. What isn't frequent is told by bitmaps of hashed words and
pairs, of bounded size: a false hit only counts a phrase that is dropped after
the merge, so all counts are exact.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm.common import cut, documents, text_or_empty, texts_of

#: Words of the longest phrase.
WIDTH = 5
#: Entries of a container before it bursts, levels of nodes, and entries of a task's trie before subtrees leave.
BURST, SHALLOW, ENTRIES = 4096, 3, 1_000_000
#: Words a task names before it starts anew, and those counted at a time.
NAMES, CHUNK = 1_000_000, 1 << 20
#: Bytes of a text that are cut into words at a time.
SEGMENT = 1 << 22
#: Words of the corpus for each prefix partition, and words of a prefix.
PARTITION_WORDS, PREFIX = 500_000, 3
#: Parts of a language's phrases that are ranked by themselves first.
PARTS = 64
#: Bits of the bitmaps of frequent words and of frequent pairs, at most: 2 MB and 16 MB.
WORD_BITS, PAIR_BITS = 1 << 24, 1 << 27
#: Bits in a row of Spark's bitmap aggregate.
ROW_BITS = 1 << 15

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_BREAKS + bytes(range(65, 91)), b"." * len(_BREAKS) + bytes(range(97, 123)))
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, some at a time; b"." stands where a piece ends."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SEGMENT)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_PLAIN).replace(b".", b" . ").split()
        at = end


# -- bitmaps of what is frequent ----------------------------------------------


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words, from the words' hashes."""
    with np.errstate(over="ignore"):
        h = (a ^ (b >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)


class Bits:
    """A bitmap over hashes; size is a power of two."""

    def __init__(self, size: int, rows: dict[int, bytes]):
        self.shift = 64 - (size.bit_length() - 1)
        self.held = np.zeros(max(size, ROW_BITS) // 8, np.uint8)
        for k, bits in rows.items():
            self.held[k * ROW_BITS // 8 : (k + 1) * ROW_BITS // 8] = np.frombuffer(bits, np.uint8)
        self.plain = self.held.tobytes()

    def __contains__(self, h: int) -> bool:
        place = h >> self.shift
        return bool(self.plain[place >> 3] >> (place & 7) & 1)

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(self.shift)
        return (self.held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def frequent(phrases: DataFrame, most: int):
    """A broadcast bitmap of (lang, phrase) rows of one or two words, about 16 bits each and ``most`` at most."""
    size = min(most, 1 << max(15, (16 * phrases.count()).bit_length()))
    shift = 64 - (size.bit_length() - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = [np.array([word_hash(lang.encode(), w)], np.uint64) for w in phrase.encode().split(b" ")]
                found.append(int(h[0][0] if len(h) == 1 else pair_hashes(*h)[0]) >> shift)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["place"])

    places = phrases.select("lang", "phrase").mapInArrow(run, "place long")
    rows = places.groupBy(F.expr(f"place div {ROW_BITS}").alias("k")).agg(F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bits"))
    return phrases.sparkSession.sparkContext.broadcast(Bits(size, {r["k"]: bytes(r["bits"]) for r in rows.collect()}))


# -- the trie of one task -------------------------------------------------------


class Container(dict):
    """Counts by the ids of the words that follow, as bytes."""


class HatTrie:
    """Counts of sequences of at most ``width`` word ids, padded with zeros."""

    def __init__(self, width: int, burst: int = BURST, shallow: int = SHALLOW):
        self.width, self.burst, self.shallow = width, burst, min(shallow, width - 1)
        self.root: dict[int, dict] = {}
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct rows of ids in order, with their counts."""
        if len(ids):
            self._add(self.root, ids, counts, 0)

    def _add(self, node: dict, ids: np.ndarray, counts: np.ndarray, depth: int) -> None:
        column = ids[:, depth]
        heads = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        for a, b, w in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)], column[heads].tolist(), strict=True):
            child = node.get(w)
            if child is None:
                child = node[w] = Container()
            if type(child) is not Container:
                self._add(child, ids[a:b], counts[a:b], depth + 1)
                continue
            before, step = len(child), 4 * (self.width - depth - 1)
            raw, get = np.ascontiguousarray(ids[a:b, depth + 1 :]).tobytes(), child.get
            for i, n in enumerate(counts[a:b].tolist()):
                rest = raw[i * step : i * step + step]
                child[rest] = get(rest, 0) + n
            self.size += len(child) - before
            if len(child) > self.burst and depth + 1 < self.shallow:
                node[w] = self._burst(child)

    def _burst(self, container: Container) -> dict[int, Container]:
        node: dict[int, Container] = {}
        for rest, n in container.items():
            w = int.from_bytes(rest[:4], "little")
            held = node.get(w)
            if held is None:
                held = node[w] = Container()
            held[rest[4:]] = n
        return node

    def _leaves(self, node: dict, lead: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], Container]]:
        if type(node) is Container:
            yield lead, node
        else:
            for w, child in node.items():
                yield from self._leaves(child, (*lead, w))

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Removes whole subtrees of the root, the largest first, until at most ``most`` entries are left: their (ids, counts)."""
        ids, counts = [np.zeros((0, self.width), np.uint32)], [np.zeros(0, np.int64)]
        for n, w in sorted(((self._count(child), w) for w, child in self.root.items()), reverse=True):
            if self.size <= most:
                break
            for lead, held in self._leaves(self.root.pop(w), (w,)):
                rest = np.frombuffer(b"".join(held), np.uint32).reshape(len(held), -1)
                ids.append(np.concatenate([np.broadcast_to(np.array(lead, np.uint32), (len(held), len(lead))), rest], axis=1))
                counts.append(np.fromiter(held.values(), np.int64, len(held)))
            self.size -= n
        return np.concatenate(ids), np.concatenate(counts)

    def _count(self, node: dict) -> int:
        return len(node) if type(node) is Container else sum(map(self._count, node.values()))


class Names(dict):
    """Ids of one language's words; words that can't be frequent have 0."""

    def __init__(self, lang: bytes, common: list, bits: Bits):
        super().__init__({b".": 0})
        self.lang, self.seed, self.common, self.bits = lang, xxhash.xxh64_intdigest(lang), common, bits

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if h in self.bits:
            self.common.append((self.lang, word, h))
            self[word] = found = len(self.common)
        else:
            self[word] = found = 0
        return found


def windows(ids: np.ndarray, joins: np.ndarray, width: int, least: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sequences, in order, that begin at the first ``starts`` places, with their counts.

    ``joins`` tells whether a place and the next may be in one phrase. A
    sequence goes on for ``width`` words or to the first place that doesn't
    join; those of fewer than ``least`` words are left out.
    """
    alive = ids > 0
    reach = alive.astype(np.int64)
    for k in range(1, width):
        alive = alive & np.concatenate([joins[k - 1 :], np.zeros(min(k - 1, len(ids)), bool)])
        reach += alive
    at = np.flatnonzero(reach[:starts] >= least)
    columns = [np.where(reach[at] > k, ids[np.minimum(at + k, len(ids) - 1)], 0).astype(np.uint64) for k in range(width)]
    keys = [(columns[k] << np.uint64(32)) | (columns[k + 1] if k + 1 < width else np.uint64(0)) for k in range(0, width, 2)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return np.stack(columns, axis=1)[order[first]].astype(np.uint32), np.diff(np.append(first, len(at)))


class Counting:
    """The phrases of ``least`` to ``width`` words of one task's texts."""

    def __init__(self, width: int, least: int, words: Bits, pairs: Bits | None, entries: int, partitions: int):
        self.width, self.least, self.words, self.pairs, self.entries, self.partitions = width, least, words, pairs, entries, partitions
        self.held: list[np.ndarray] = []
        self.n = 0
        self._anew()

    def _anew(self) -> None:
        self.common: list[tuple[bytes, bytes, int]] = []
        self.names: dict[bytes, Names] = {}
        self.trie = HatTrie(self.width, BURST)

    def text(self, lang: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        if lang not in self.names:
            self.names[lang] = Names(lang, self.common, self.words)
        for part in tokens(text):
            names = self.names[lang]
            self.held.append(np.fromiter(map(names.__getitem__, part), np.int64, len(part)))
            self.n += len(part)
            if self.n >= CHUNK:
                yield from self._chunk(self.width - 1)
        self.held.append(np.zeros(1, np.int64))
        self.n += 1
        if sum(map(len, self.names.values())) > NAMES:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        """Counts what is held, and lets all subtrees go."""
        yield from self._chunk(0)
        yield from self._runs(-1)
        self._anew()

    def _chunk(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Counts all places but the last ``keep``, which are held until more words follow."""
        ids = np.concatenate([*self.held, np.zeros(0, np.int64)])
        joins = np.zeros(len(ids), bool)
        joins[:-1] = (ids[:-1] > 0) & (ids[1:] > 0)
        if self.pairs is not None and joins.any():
            hashes = np.array([0, *(h for _, _, h in self.common)], np.uint64)
            at = np.flatnonzero(joins)
            joins[at] = self.pairs.hit(pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]))
        self.trie.add(*windows(ids, joins, self.width, self.least, len(ids) - keep))
        self.held, self.n = ([ids[len(ids) - keep :]], keep) if keep else ([], 0)
        if self.trie.size > self.entries:
            yield from self._runs(self.entries // 2)

    def _runs(self, most: int) -> Iterator[pa.RecordBatch]:
        """Subtrees as sorted runs: (lang, partition, block), the blocks' phrases in order of their words."""
        order = sorted(range(len(self.common)), key=lambda i: self.common[i][:2])
        place = np.zeros(len(order) + 1, np.int64)
        place[np.array(order, np.int64) + 1] = np.arange(1, len(order) + 1)
        ids, counts = self.trie.take(most)
        by = np.lexsort(place[ids].T[::-1])
        ids, counts = ids[by], counts[by]
        words, hashes = [b"", *(w for _, w, _ in self.common)], np.array([0, *(h for _, _, h in self.common)], np.uint64)
        langs = {g: i for i, g in enumerate(self.names)}
        lang_of, named = np.array([0, *(langs[g] for g, _, _ in self.common)]), list(langs)
        for k in range(self.least, self.width + 1):
            full = np.flatnonzero(ids[:, k - 1])
            if not len(full):
                continue
            held = ids[full, :k]
            first = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)]))
            rows, sums = held[first], np.add.reduceat(counts[full], first)
            prefix = hashes[rows[:, 0]]
            for column in range(1, min(k, PREFIX)):
                prefix = pair_hashes(prefix, hashes[rows[:, column]])
            part, lang = (prefix % np.uint64(self.partitions)).astype(np.int64), lang_of[rows[:, 0]]
            by = np.lexsort((part, lang))
            rows, sums, part, lang = rows[by], sums[by], part[by], lang[by]
            starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])]))
            phrases = [b" ".join([words[i] for i in row]) for row in rows.tolist()]
            blocks = [packed(phrases[x:y], sums[x:y]) for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True)]
            shown = pa.array([named[i] for i in lang[starts].tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([shown, pa.array(part[starts]), pa.array(blocks, pa.binary())], names=["lang", "part", "block"])


def packed(phrases: list[bytes], counts: np.ndarray) -> bytes:
    """Phrases and their counts as one compressed block."""
    return zlib.compress(len(phrases).to_bytes(8, "little") + counts.astype("<i8").tobytes() + b"\n".join(phrases), 1)


def unpacked(block: bytes) -> tuple[list[bytes], list[int]]:
    raw = zlib.decompress(block)
    n = int.from_bytes(raw[:8], "little")
    return raw[8 * n + 8 :].split(b"\n"), np.frombuffer(raw, "<i8", n, 8).tolist()


def count_batch(langs: list[bytes], phrases: list[bytes], f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()).cast(pa.string()) for x in (langs, phrases)), pa.array(f)], names=["lang", "phrase", "f"])


# -- on Spark ---------------------------------------------------------------


def _langs_and_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    for part, texts in texts_of(batches, 1):
        for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
            yield lang.encode(), text.encode("utf-8", "surrogatepass")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all single words of (lang, text)."""

    def rows(lang: bytes, held: Counter) -> pa.RecordBatch:
        return count_batch([lang] * len(held), list(held), np.fromiter(held.values(), np.int64, len(held)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}
        for lang, text in _langs_and_texts(batches):
            for part in tokens(text):
                counts.setdefault(lang, Counter()).update(part)
            if sum(map(len, counts.values())) > NAMES:
                yield from (rows(g, c) for g, c in counts.items())
                counts.clear()
        yield from (rows(g, c) for g, c in counts.items())

    counted = texts.mapInArrow(run, "lang string, phrase string, f long").where("phrase <> '.'")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(texts: DataFrame, n_words: int, width: int, shortest: int, least: int, words, pairs=None, entries: int = ENTRIES) -> DataFrame:
    """(lang, phrase, f): phrases of ``shortest`` to ``width`` words with at least ``least`` occurrences, exactly counted.

    The bitmaps let all such phrases through; ``n_words`` is the corpus's number of words.
    """
    partitions = max(64, n_words // PARTITION_WORDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(width, shortest, words.value, pairs.value if pairs is not None else None, entries, partitions)
        for lang, text in _langs_and_texts(batches):
            yield from counting.text(lang, text)
        yield from counting.end()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, {}

        def rows() -> pa.RecordBatch:
            kept = [(p, n) for p, n in held.items() if n >= least]
            return count_batch([own[0].encode()] * len(kept), [p for p, _ in kept], np.array([n for _, n in kept], np.int64))

        for b in batches:
            for lang, part, block in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (lang, part) != own:
                    if own is not None:
                        yield rows()
                    own, held = (lang, part), {}
                get = held.get
                for p, n in zip(*unpacked(block), strict=True):
                    held[p] = get(p, 0) + n
        if own is not None:
            yield rows()

    runs = texts.mapInArrow(run, "lang string, part long, block binary")
    return runs.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(merge, "lang string, phrase string, f long")


def collocations(docs: DataFrame, least: int = 100, width: int = WIDTH, first: int | None = 2000, text_col: str = "text", lang_col: str = "lang", entries: int = ENTRIES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``width`` words by how much their weakest cut binds.

    ``a`` is a phrase's count, at least ``least``; n its language's words. A cut
    scores floor(1000 a n / (l r)) with the counts of its two parts; the lowest
    counts, of equal ones the earliest. A phrase is dropped if it lies in a longer
    one that is as frequent. ``first`` bounds the rows of a language (None: all),
    by score, then a, both descending, then phrase in UTF-8 order. A null language
    is ``und``, as texts named so; null and empty texts have no words; repeated
    rows count each. No rows, or none frequent, give none. Other columns aren't
    read. Products are 38-digit decimals: 1000 a n must stay below 10^38.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    single = cut(word_counts(texts))
    sizes = single.groupBy("lang").agg(F.sum("f").alias("n"))
    common = cut(single.where(F.col("f") >= least))
    words = frequent(common, WORD_BITS)
    n_words = single.agg(F.sum("f")).first()[0] or 0
    found = cut(phrase_counts(texts, n_words, 2, 2, least, words, None, entries))
    if width > 2:
        found = cut(found.union(phrase_counts(texts, n_words, width, 3, least, words, frequent(found, PAIR_BITS), entries)))
    counts = common.union(found)

    parted = found.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    inner = F.array(joined(1, F.size("w") - 1), joined(2, F.size("w") - 1))
    cover = parted.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_cover"))
    kept = parted.join(cover, ["lang", "phrase"], "left").where("_cover IS NULL OR _cover < a")

    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(1, F.col("k")).alias("_l"), joined(F.col("k") + 1, F.size("w")).alias("_r"))
    for side in ("l", "r"):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(f"_{side}"), F.col("f").alias(side)), ["lang", f"_{side}"])
    cuts = cuts.join(sizes, "lang").withColumn("score", F.expr("CAST(1000 * (CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("least")).select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    best = F.desc("score"), F.desc("a"), "phrase"
    place = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*best)).cast("long")
    if first is not None:
        # A language's first are among the first of its parts, which are many tasks' work.
        parts = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("_place", place("_part"))
        scored = parts.where(F.col("_place") <= first)
    ranked = scored.select("lang", place().alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return ranked if first is None else ranked.where(F.col("rank") <= first)


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of all documents."""
    return collocations(documents(spark, sf_dir))


SQL = {
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        parts AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
        spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM parts),
        sized AS (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS k FROM spans),
        phrases AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM sized WHERE i + k - 1 <= len(w) GROUP BY ALL),
        sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang),
        found AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 100),
        inner_ AS (
            SELECT x.lang, array_to_string(x.w[i : i + m - 1], ' ') AS phrase, max(x.f) AS longer
            FROM found x, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS m) WHERE m < x.k AND i + m - 1 <= x.k GROUP BY ALL),
        kept AS (SELECT f.* FROM found f LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f.f),
        cuts AS (
            SELECT k.lang, k.phrase, k.f AS a, c, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * k.f * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
            FROM kept k JOIN (SELECT unnest([1, 2, 3, 4]) AS c) ON c < k.k
            JOIN phrases l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1 : c], ' ')
            JOIN phrases r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[c + 1 : k.k], ' ')
            JOIN sizes s ON s.lang = k.lang),
        scored AS (SELECT lang, phrase, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM scored QUALIFY rank <= 2000
    """
}
