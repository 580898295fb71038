"""All pairs of sets of at least a given Jaccard similarity, without a shuffle of pairs or of all sets.

Two sets that similar share one of the first terms of each, in any order of all terms;
the order here is by how full a term's bucket is, so frequent terms come last. A large
set's first terms are those of the ``SAMPLE`` terms of least hash. Terms go with a
64-bit code of their set; only those that two codes share are shuffled once more, each
with a sketch of its set: 64 counts, whose distance is at most that of the sets, and the
least hash of each of ``BINS`` parts of the set, of which similar sets share many. Tasks
give stars of the candidates they join, in proportion to their rows. The sets of each
component of candidates then meet in pairs of bounded blocks, where all their pairs are
decided by exact similarity.

Sets are told apart by hashes of 64 bits, of terms and of whole sets. Sample and parts
add to that a chance of at most 2**-64 each, for any pair similar enough, to miss it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.operators.components import components, own_exchange
from corploom.operators.overlap import common_terms
from corploom.session import cut

#: Buckets whose terms are counted for the order of terms, and those of a row of counts.
BUCKETS, COUNTED = 1 << 20, 1 << 12
#: Terms, and sets, of a block that is compared with another.
BLOCK_TERMS, BLOCK_SETS = 1 << 20, 2048
#: Rows of first terms, and pairs of sketches, that a task holds at a time.
ROWS, PAIRS = 1 << 17, 1 << 16
#: Rows that are broadcast; against more, the sets that the screen lets through are shuffled.
SENT = 1_000_000
#: Bits of the screen for sets of candidates: 8 MB; with more candidates it lets more through, to the same result.
SCREEN = 1 << 26
#: Sets with a term whose pairs are all looked at; in more, those of one tree are skipped.
FEW = 16
#: Terms of least hash that stand for a large set, and parts of a set in its sketch.
SAMPLE, BINS = 128, 128
#: What tells first terms of samples from those of whole sets.
SALT = np.uint64(0xA24BAED4963EE407)
#: Bytes of texts sliced off a batch at a time, and different words remembered.
SLICE_BYTES, WORDS = 16 << 20, 1 << 18
#: Sets that a task remembers, to give the terms of equal ones once.
SEEN = 1 << 18


class WordHashes(dict):
    """64-bit hashes of words, those of recent ones kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def run_hashes(words: list[bytes], width: int, memo: dict[bytes, int]) -> np.ndarray:
    """The 64-bit hashes of the runs of ``width`` words, each as often as it occurs; of fewer words one of all, of none none."""
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    out ^= out >> np.uint64(32)
    return (out * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def shingle_hashes(words: list[bytes], width: int, memo: dict[bytes, int]) -> np.ndarray:
    """The distinct run_hashes() in order."""
    return np.unique(run_hashes(words, width, memo))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts take up to ``most`` bytes (a longer one is a part of its own)."""
    start = 0
    while start < batch.num_rows:
        rows = batch.num_rows - start
        while rows > 1 and batch.column(column).slice(start, rows).nbytes > most:
            rows = (rows + 1) // 2
        yield batch.slice(start, rows)
        start += rows


def sure(n: int, least: float) -> int:
    """How many of n terms drawn from the union of two sets of similarity ``least`` both have, at least; fewer by a chance of at most 2**-64 (Hoeffding's bound)."""
    if least >= 1:
        return n
    found = 0
    for more in range(1, n + 1):
        x = (more - 1) / n
        gap = (x * math.log(x / least) if x else 0) + (1 - x) * math.log((1 - x) / (1 - least))
        if x < least and n * gap >= 64 * math.log(2):
            found = more
    return found


def _spread(terms: np.ndarray) -> np.ndarray:
    """Each 64-bit term in place of another one, which no pattern of the terms shows (a bijection)."""
    x = terms.astype(np.int64, copy=False).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code(terms: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(terms.tobytes(), digest_size=8).digest(), "little", signed=True)


def _terms(width: int | None) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]]:
    """What makes of a batch of (id, terms) or, with a width, (id, text) parts of it with their rows' terms, which may occur again."""
    memo = WordHashes()

    def one(x: pa.Scalar) -> np.ndarray:
        if width is None:
            return _spread(x.values.drop_null().to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64))
        return _spread(run_hashes(x.as_py().encode("utf-8", "surrogatepass").split(), width, memo))

    return lambda batch: ((part, (one(x) for x in part.column(1))) for part in slices(batch, 1))


def _bucket(terms: np.ndarray) -> np.ndarray:
    return (terms & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counts(rows: DataFrame, width: int | None) -> np.ndarray:
    """How many terms fall into each bucket. A task gives a row for ``COUNTED`` buckets, in as few bytes as hold its counts."""

    def unpacked(x: bytes) -> np.ndarray:
        return np.frombuffer(x, f"u{len(x) // COUNTED}").astype(np.uint32)

    def packed(at: Iterable[int], tallies: Iterable[np.ndarray]) -> pa.RecordBatch:
        of = [t.astype(next(k for k in ("u1", "u2", "u4") if t.max() <= np.iinfo(k).max)).tobytes() for t in tallies]
        return pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array(of, pa.binary())], names=["at", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, found, held, n = _terms(width), np.zeros(BUCKETS, np.uint32), [], 0
        for batch in batches:
            for _, lists in make(batch):
                for terms in lists:
                    held.append(_bucket(terms))
                    n += len(terms)
                    if n >= BUCKETS:
                        found += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.uint32)
                        held, n = [], 0
        if held:
            found += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.uint32)
        yield packed(range(BUCKETS // COUNTED), found.reshape(-1, COUNTED))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums[at] + unpacked(x) if at in sums else unpacked(x)
        yield packed(sums, sums.values())

    kind = "at int, counts binary"
    found = rows.mapInArrow(count, kind).repartition("at").mapInArrow(add, kind).toArrow()  # BUCKETS counts
    out = np.zeros((BUCKETS // COUNTED, COUNTED), np.uint32)
    for at, x in zip(found["at"].to_pylist(), found["counts"].to_pylist(), strict=True):
        out[at] = unpacked(x)
    return out.ravel()


def _first(terms: np.ndarray, counts: np.ndarray, least: float, shared: int) -> np.ndarray:
    """The first terms of a set: one is in those of any set as similar.

    Sets of up to ``whole`` terms take them from all, those larger from their sample,
    of which two sets have ``shared`` in common; sets that may be similar to both do both.
    """
    n = len(terms)
    whole = (SAMPLE - shared + 1) / (1 - least) if shared and least < 1 else math.inf
    found = []
    if n <= whole:
        order = np.lexsort((terms, counts[_bucket(terms)]))
        found.append(terms[order[: n - math.ceil(n * least - 1e-9) + 1]])
    if n >= whole * least - 1:
        some = terms[:SAMPLE]
        order = np.lexsort((some, counts[_bucket(some)]))
        found.append(some[order[: SAMPLE - shared + 1]] ^ SALT)
    return np.concatenate(found)


def _sketch(terms: np.ndarray) -> bytes:
    """64 counts and, for BINS parts of the hashes, what is left of the least (0: none), in 4 bits each."""
    tally = (np.bincount(((terms >> np.uint64(40)) & np.uint64(63)).astype(np.int64), minlength=64) & 15).astype(np.uint8)
    part = (terms >> np.uint64(64 - int(math.log2(BINS)))).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    bins = np.zeros(BINS, np.uint8)
    bins[part[head]] = terms[head] % np.uint64(15) + np.uint64(1)
    both = np.concatenate([tally, bins])
    return (both[::2] | both[1::2] << 4).tobytes()


def unpacked_sketches(sketches: list[bytes]) -> np.ndarray:
    """A row for each of _sketch()."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.stack([rows & 15, rows >> 4], axis=2).reshape(len(sketches), -1)


def _signatures(rows: DataFrame, least: float, width: int | None) -> DataFrame:
    """(id, code, n, firsts, sketch) of each set that isn't empty; the last two are null where the task has had an equal set."""
    kind = rows.schema["id"].dataType.simpleString()
    shared, counted = sure(SAMPLE, least), rows.sparkSession.sparkContext.broadcast(_counts(rows, width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, counts, seen = _terms(width), counted.value, set()
        for batch in batches:
            for part, lists in make(batch):
                codes, sizes, firsts, sketches = [], [], [], []
                for terms in map(np.unique, lists):
                    code = _code(terms)
                    new = len(terms) > 0 and code not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(code)
                    codes.append(code)
                    sizes.append(len(terms))
                    firsts.append(_first(terms, counts, least, shared).view(np.int64) if new else None)
                    sketches.append(_sketch(terms) if new else None)
                columns = [part.column(0), pa.array(codes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "code", "n", "firsts", "sketch"]).filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return rows.mapInArrow(run, f"id {kind}, code long, n int, firsts array<long>, sketch binary")


def _shared(firsts: DataFrame) -> DataFrame:
    """The distinct (term, code) whose term has another code too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, code, given = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # the last row, and whether it was given
        for batch in batches:
            had = len(term)
            term, code = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((term, code)))
            new = np.concatenate([[True] * min(len(term), 1), (term[1:] != term[:-1]) | (code[1:] != code[:-1])])
            term, code = term[new], code[new]
            if not len(term):
                continue
            same = term[1:] == term[:-1]
            good = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            last = bool(good[-1]) or (len(term) == 1 and had > 0 and given)
            if had and given:
                good[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(term[good]), pa.array(code[good])], names=["term", "code"])
            term, code, given = term[-1:], code[-1:], last

    return firsts.select("term", "code").repartition("term").sortWithinPartitions("term", "code").mapInArrow(run, "term long, code long")


class _Trees:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        up = self.parent
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


def candidate_stars(term: np.ndarray, code: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) codes as stars that join all rows of one term (in order) which may be as similar by size and sketch."""
    codes, first, own = np.unique(code, return_index=True, return_inverse=True)
    size, tally, bins, trees = n[first].astype(np.float64), sketch[first, :64], sketch[first, 64:], _Trees(len(codes))
    enough = np.array([sure(k, least) for k in range(BINS + 1)])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.broadcast_arrays(a, b)
        good = (size[a] >= least * size[b] - 1e-6) & (size[b] >= least * size[a] - 1e-6)
        x, y = a[good], b[good]
        d = (tally[x] - tally[y]) & 15
        far = np.minimum(d, 16 - d).sum(axis=-1, dtype=np.int64)
        good[good] = close = far <= (size[x] + size[y]) * (1 - least) / (1 + least) + 1e-6
        p, q = bins[x[close]], bins[y[close]]
        either, same = np.count_nonzero(p | q, axis=-1), np.count_nonzero((p == q) & (p > 0), axis=-1)
        good[good] = same >= enough[either]
        return good

    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    sizes = np.diff(np.append(starts, len(term)))
    few = np.repeat(sizes <= FEW, sizes)
    pairs = [np.zeros(0, np.int64)]
    for k in range(1, FEW):
        x = np.flatnonzero((term[k:] == term[:-k]) & few[k:])
        if not len(x):
            break
        a, b = own[x], own[x + k]
        pairs.append(np.minimum(a, b) * len(codes) + np.maximum(a, b))
    pairs = np.unique(np.concatenate(pairs))
    for at in range(0, len(pairs), PAIRS):
        a, b = pairs[at : at + PAIRS] // len(codes), pairs[at : at + PAIRS] % len(codes)
        good = near(a, b) & (a != b)
        trees.join(a[good], b[good])
    for at, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        rows = np.unique(own[at : at + m])
        for step in range(len(rows)):  # a row of another tree than most with all others, till one tree is left
            roots = np.array([trees.root(x) for x in rows.tolist()])
            names, members = np.unique(roots, return_counts=True)
            outside = rows[roots != names[members.argmax()]]
            if step == 0:
                outside = rows[:1]
            if not len(outside):
                break
            if step < 8:
                good = rows[near(np.repeat(outside[:1], len(rows)), rows)]
                trees.join(np.repeat(outside[:1], len(good)), good)
                continue
            share = max(1, PAIRS // len(rows))
            for x in range(0, len(outside), share):
                i, j = np.nonzero(near(outside[x : x + share, None], rows[None, :]))
                trees.join(outside[x + i], rows[j])
            break
    roots = np.array([trees.root(x) for x in range(len(codes))], np.int64)
    u = np.flatnonzero(roots != np.arange(len(codes)))
    return codes[u], codes[roots[u]]


def _candidates(firsts: DataFrame, least: float) -> DataFrame:
    """(u, v): stars of what may be as similar, of each stretch of a task's terms."""

    def stars(rows: pa.Table) -> pa.RecordBatch:
        sketches = unpacked_sketches(rows["sketch"].to_pylist())
        u, v = candidate_stars(rows["term"].to_numpy(), rows["code"].to_numpy(), rows["n"].to_numpy(), sketches, least)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                term = rows["term"].to_numpy()
                end = int(np.searchsorted(term, term[-1]))  # the last term may go on
                if end:
                    yield stars(rows.slice(0, end))
                held, n = rows.slice(end).to_batches(), len(rows) - end
        if held:
            yield stars(pa.Table.from_batches(held).combine_chunks())

    return firsts.repartition("term").sortWithinPartitions("term").mapInArrow(run, "u long, v long")


def _screen(ids: DataFrame) -> np.ndarray:
    """Bits of which the hash of each of ``ids`` has set one."""
    words = ids.select(F.xxhash64("id").bitwiseAND(F.lit(SCREEN - 1)).alias("place")).groupBy(F.expr("place div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(place % 64)))").alias("bits"))
    rows = words.toArrow()  # at most SCREEN / 64
    out = np.zeros(SCREEN // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _screened_sets(rows: DataFrame, width: int | None, ids: DataFrame) -> DataFrame:
    """(id, code, terms) of the rows with one of ``ids``, and of some others."""
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(_screen(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, bits = _terms(width), shared.value
        for batch in batches:
            place = batch.column(2).to_numpy() & (SCREEN - 1)
            let = batch.filter(pa.array((bits[place >> 6] >> (place & 63) & 1).astype(bool)))
            for part, lists in make(let):
                sets = [np.unique(terms) for terms in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_code, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "code", "terms"])

    return rows.withColumn("h", F.xxhash64("id")).mapInArrow(run, f"id {kind}, code long, terms array<long>")


def similar_pairs(rows: DataFrame, least: float, width: int | None = None) -> DataFrame:
    """(a, b, jaccard) of all a < b of (id, terms) whose similarity is ``least`` (above 0) or more; terms are 64-bit.

    With a ``width``, ``rows`` are (id, text), and a set is a text's runs of so many
    words in lower case. Equal sets are one, named by the least id; empty ones give no
    pairs. ``rows`` are read three times: stored rows or a narrow pass over some.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", "terms" if width is None else F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    signed = cut(_signatures(rows, least, width))
    full = signed.where("firsts IS NOT NULL")
    shared = _shared(full.select(F.explode("firsts").alias("term"), "code"))
    drawn = shared.join(full.select("code", "n", "sketch").dropDuplicates(["code"]), "code").select("term", "code", "n", "sketch")
    of = components(_candidates(drawn, least)).withColumnRenamed("u", "code")
    named = of.join(signed.groupBy("code").agg(F.min("id").alias("id"), F.max("n").alias("n")), "code")
    load = F.greatest(F.ceil(F.sum("n") / BLOCK_TERMS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    blocks = named.groupBy("component").agg(load.alias("blocks"))
    placed = named.join(own_exchange(blocks, "component"), "component").withColumn("own", F.pmod(F.xxhash64("code", F.lit(1)), F.col("blocks")).cast("int"))
    members = cut(placed.select("code", "id", "component", "own", "blocks"))
    sets = _screened_sets(rows, width, members)
    joined = sets.join(F.broadcast(members) if members.count() <= SENT else members, ["code", "id"])
    dealt = joined.select("component", "own", "code", "id", "terms", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "code", "id", "terms")

    def pairs_of(rows: pa.Table, i: int, j: int) -> pa.RecordBatch:
        rows = rows.take(pa.array(np.unique(rows["code"].to_numpy(), return_index=True)[1]))  # an id may have a text twice
        own = rows["own"].to_numpy()
        left, right = (rows.filter(pa.array(own == x)).combine_chunks() for x in (i, j))
        lists = [t["terms"].combine_chunks() if len(t) else pa.array([], t.schema.field("terms").type) for t in (left, right)]
        lists = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in lists]
        c = common_terms(*lists).astype(np.float64)
        na, nb = (x.value_lengths().to_numpy().astype(np.float64) for x in lists)
        jaccard = c / np.maximum(na[:, None] + nb[None, :] - c, 1)
        good = jaccard >= least
        x, y = np.nonzero(np.triu(good, 1) if i == j else good)
        a, b = left["id"].combine_chunks().take(pa.array(x)), right["id"].combine_chunks().take(pa.array(y))
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (a, b)), pa.array(jaccard[x, y])], names=["a", "b", "jaccard"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            key = np.column_stack([b.column(k).to_numpy() for k in range(3)])
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else []
            for x, y in zip(heads, [*heads[1:], len(key)], strict=True):
                if now != (mine := tuple(key[x].tolist())):
                    if len(rows):
                        yield pairs_of(pa.Table.from_batches(rows), *now[1:])
                    now, rows = mine, []
                rows.append(b.slice(x, y - x))
        if rows:
            yield pairs_of(pa.Table.from_batches(rows), *now[1:])

    near = placed.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, f"a {kind}, b {kind}, jaccard double")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").where("a < b")
