"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints that differ in at most ``radius`` of 64 bits agree on at least one
of ``radius + 1`` blocks of bits, so each distinct fingerprint goes to one
bucket per block. A bucket too large for a task is split the same way by its
other bits; that loses no pair. A task sorts its buckets by the Gray rank of the
fingerprints, which puts codes with the same leading bits side by side, and
builds a tree over them: each upper node keeps the bits that all codes below
share (a mask and a pattern). The search descends pairs of nodes: where the
shared bits of two nodes already differ in more than ``radius`` places, all
pairs below are pruned at once; where shared differences and unshared bits
together stay within it, all are linked at once by a star. A task returns a
spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import arrow_rows, cut, documents, numbered, text_or_empty, texts_of, unused
from corploom.llm.components import components, own_exchange
from corploom.llm.fuse_filter import rows_in, rows_not_in
from corploom.operators.overlap import common_terms

SEED = 42
#: Fingerprints in a bucket that a task takes; larger ones are split by further bits.
BUCKET_ROWS = 1_000_000
FANOUT = 8
#: Pairs of nodes expanded at a time.
FRONTIER = 1 << 15


# -- fingerprints -----------------------------------------------------------


def _hashes(words: list[bytes], width: int) -> Iterator[int]:
    if len(words) < width:
        if words:
            yield xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True):
        yield digest(joined[a:b], SEED)


#: Hashes counted at a time, so that a very long text needs little memory.
CHUNK = 1 << 15


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash over the XXH64 of all word shingles, repeats included; 0 without words."""
    hashes = _hashes(text.encode("utf-8", "surrogatepass").lower().split(), width)
    set_bits, total = np.zeros(64, np.int64), 0
    while len(part := np.fromiter(islice(hashes, CHUNK), np.uint64)):
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, doc_id, code): the signed 64-bit SimHash of every row's whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 2):
            codes = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield arrow_rows(part, (0, 1), ["_row", "doc_id", "code"], [pa.array(codes)])

    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))).select("_row", "doc_id", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, doc_id {kind}, code long")


# -- the index of one task --------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Forest:
    """Union-find over 0..n-1, joined by arrays of edges."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.used: list[tuple[np.ndarray, np.ndarray]] = []  # edges that joined two trees

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, root) of all places but the roots: as connected as the links, and shallower."""
        self._flatten()
        places = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return places, self.parent[places]

    def _flatten(self) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.parent[u], self.parent[v]
            if not len(apart := np.flatnonzero(a != b)):
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.parent, high, low)
            won = np.flatnonzero(self.parent[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]
            self.used.append((u[won], v[won]))
            self._flatten()


def _levels(codes: np.ndarray, bucket: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the leaves up: (pattern, mask, first leaf, first child) of each node; the last level has one node a bucket."""
    levels = [(codes, np.full(len(codes), ~np.uint64(0)), np.arange(len(codes) + 1), np.arange(0))]
    while True:
        pattern, mask, leaf, _ = levels[-1]
        new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
        heads = np.flatnonzero((np.arange(len(bucket)) - start) % FANOUT == 0)
        if len(heads) == len(bucket) and len(levels) > 1:
            return levels
        same = np.bitwise_and.reduceat(mask, heads)
        ands, ors = np.bitwise_and.reduceat(pattern, heads), np.bitwise_or.reduceat(pattern, heads)
        shared = same & ~(ands ^ ors)
        levels.append((ands & shared, shared, np.append(leaf[heads], leaf[-1]), np.append(heads, len(bucket))))
        bucket = bucket[heads]


def _runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run start .. start + size - 1: (run, place in it), all runs in a row."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)


def link_buckets(codes: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of at most ``radius`` bits that span, bucket by bucket, all of them."""
    u, v = link_places(codes, bucket, radius)
    return codes[u], codes[v]


def link_places(codes: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links as places of rows; of equal codes in a bucket the first row stands for all."""
    order = np.lexsort((gray_rank(codes), bucket))
    codes, bucket = codes[order], bucket[order]
    if len(codes):
        first = np.concatenate([[True], (codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1])])
        codes, bucket, order = codes[first], bucket[first], order[first]
    if len(codes) < 2:
        return order[:0], order[:0]
    levels, forest = _levels(codes, bucket), Forest(len(codes))
    tops = np.arange(len(levels[-1][0]))
    pending = [(len(levels) - 1, tops, tops)]
    while pending:
        level, a, b = pending.pop()
        if len(a) > FRONTIER:
            pending.append((level, a[FRONTIER:], b[FRONTIER:]))
            a, b = a[:FRONTIER], b[:FRONTIER]
        pattern, mask, leaf, child = levels[level]
        shared = mask[a] & mask[b]
        apart = np.bitwise_count((pattern[a] ^ pattern[b]) & shared)
        near = apart + np.bitwise_count(~shared) <= radius  # any code below a links to any below b
        if near.any():
            for side in (a[near], b[near]) if level else ():
                side = np.unique(side)
                run, place = _runs(leaf[side], leaf[side + 1] - leaf[side])
                forest.join(leaf[side][run], leaf[side][run] + place)
            forest.join(leaf[a[near]], leaf[b[near]])
        more = ~near & (apart <= radius)
        a, b = a[more], b[more]
        if not level or not len(a):
            continue
        size = child[b + 1] - child[b]
        pair, place = _runs(child[a], (child[a + 1] - child[a]) * size)
        x, y = child[a][pair] + place // size[pair], child[b][pair] + place % size[pair]
        once = x <= y
        if level == 1:
            once &= forest.parent[x] != forest.parent[y]
        pending.append((level - 1, x[once], y[once]))
    u, v = (np.concatenate(x) for x in zip(*forest.used, strict=True)) if forest.used else (np.arange(0),) * 2
    return order[u], order[v]


# -- on Spark ---------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(mask: int, blocks: int) -> list[int]:
    """Masks that part the set bits of ``mask`` into blocks of about equal size."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def buckets(codes: DataFrame, radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(code, bucket): any two codes within ``radius`` bits share a bucket, and no bucket outgrows a task.

    A bucket holds the distinct codes that agree on the bits of a mask. One of
    more than ``bucket_rows`` codes is split by each of ``radius + 1`` blocks of
    the other bits: codes of a pair agree on one of those too. The split ends
    where few bits are left, as few distinct codes are then possible. A bucket
    is named by a hash; should two share a name, they are searched together.
    """
    masks = {(1 << 64) - 1: _parts((1 << 64) - 1, radius + 1)}
    rows, done = codes.select("code", F.lit(-1).cast("long").alias("free")), []
    while True:
        split = F.create_map(*(x for m, parts in masks.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(m & ~p)) for p in parts)))))
        rows = rows.select("code", F.explode(split[F.col("free")]).alias("free"))
        rows = rows.withColumn("bucket", F.xxhash64("free", F.col("code").bitwiseAND(F.bitwise_not("free"))))
        large = rows.groupBy("free", "bucket").count().where(F.col("count") > bucket_rows).select("free", "bucket")
        masks = {f: _parts(f, radius + 1) for m, parts in masks.items() for f in (m & ~p for p in parts)}
        masks = {f: parts for f, parts in masks.items() if f.bit_count() >= 4 * (radius + 1)}
        if not masks or large.isEmpty():
            return _all([*done, rows.select("code", "bucket")])
        large = cut(large)
        done.append(rows.join(large, ["free", "bucket"], "left_anti").select("code", "bucket"))
        rows = rows.join(large, ["free", "bucket"], "left_semi")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.union(df)
    return out


def links(codes: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links between distinct codes that join all pairs within ``radius`` bits, at most a row per code and bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            code, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            u, v = link_buckets(code.view(np.uint64), bucket, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    rows = buckets(codes, radius, bucket_rows)
    tasks = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-codes.count() * (radius + 1) // bucket_rows))
    return rows.repartition(tasks, "bucket").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, code, component_id, first.

    ``docs`` must be a scan of stored data (see ``numbered``). component_id is
    the smallest id reachable by links of at most ``radius`` bits; null ids are
    passed over, and a component of null ids only has a null one. ``first``
    marks one row of each component, that with the smallest id (of repeats the
    first). Null and empty texts have code 0 and link like any other; no rows
    give no rows. Other columns are not read, so their names can't clash.
    """
    marks = cut(fingerprints(docs, width, id_col, text_col))
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).alias("least")
    codes = cut(marks.groupBy("code").agg(least))
    return _components_of(marks, codes, components(links(codes.select("code"), radius)))


def _components_of(marks: DataFrame, codes: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows of ``marks`` with the component of their code, by (u, component); ``codes`` has the least row of each code."""
    heads = codes.join(linked, codes["code"] == linked["u"]).groupBy("component").agg(F.min("least").alias("head"))
    moved = linked.join(own_exchange(heads, "component"), "component").select(F.col("u").alias("code"), "head")
    of_code = codes.join(moved, "code", "left").select("code", F.coalesce("head", "least").alias("head"))
    return marks.join(own_exchange(of_code, "code"), "code").select("_row", "doc_id", "code", F.col("head.doc_id").alias("component_id"), (F.col("head._row") == F.col("_row")).alias("first"))


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, links at 3 or fewer bits."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies by similarity -------------------------------------------------

#: Words of a shingle and the Jaccard similarity of shingle sets from which texts are near copies.
WIDTH, SIMILARITY = 5, 0.8
#: 64-bit words of a long fingerprint.
LONG = 6
#: Bytes of texts whose shingle sets a task holds at once.
SET_BYTES = 4 << 20
#: Bits in which first words may differ for the index to bring texts together.
NEAR = 14
#: Bits in which long fingerprints of near copies may differ: about 58 of 384 are expected at 0.8, and more than 86 in 3 of 100,000 pairs.
WITHIN = 86
#: Share of the bits that differ at a similarity of 0.8, and of the pairs there that no table may bring together.
APART, MISSED = 0.1514, 0.001
#: Unlike texts in a bucket.
UNLIKE = 1024
#: Pairs of fingerprints compared at a time.
COMPARED = 1 << 21
#: Shingles of a block of sets that are compared with those of another.
BLOCK_SHINGLES = 1 << 20


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles; none without words."""
    return np.unique(np.fromiter(_hashes(text.encode("utf-8", "surrogatepass").lower().split(), width), np.uint64))


def long_fingerprint(hashes: np.ndarray, words: int = LONG) -> np.ndarray:
    """A SimHash of 64 * words bits of a set of hashes; zeros for none."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            with np.errstate(over="ignore"):
                h = (hashes[at : at + CHUNK] ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15 | 1 << 2 * k)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def tables_for(n: int) -> tuple[int, int]:
    """(bits, tables) for n texts: buckets of about UNLIKE unlike texts, and tables enough to miss few pairs."""
    bits = max(8, int(np.ceil(np.log2(max(n, 2) / UNLIKE))))
    return bits, int(np.ceil(np.log(MISSED) / np.log1p(-((1 - APART) ** bits))))


def _table_masks(bits: int, tables: int) -> list[list[int]]:
    """For each table one mask for each word but the first, together ``bits`` bits; the same on each run."""
    rng, masks = np.random.default_rng(SEED), []
    for _ in range(tables):
        chosen = rng.choice(64 * (LONG - 1), bits, replace=False)
        masks.append([_signed(sum(1 << int(b % 64) for b in chosen if b // 64 == w)) for w in range(LONG - 1)])
    return masks


def bucket_links(words: np.ndarray, bucket: np.ndarray, within: int = WITHIN) -> tuple[np.ndarray, np.ndarray]:
    """Stars (i, j) of places that join, bucket by bucket, all pairs whose ``words`` (one row a text) differ in at most ``within`` bits.

    Equal first words of a bucket are linked, near ones by the Gray-order index;
    then all rows outside a bucket's largest tree are compared with all others. So a large
    group of alike texts costs about its size, and no pair is left out.
    """
    order = np.argsort(bucket, kind="stable")
    words, bucket = words[order], bucket[order]
    ends = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    forest = Forest(len(order))
    by = np.lexsort((words[:, 0], bucket))
    same = np.flatnonzero((words[by[1:], 0] == words[by[:-1], 0]) & (bucket[by[1:]] == bucket[by[:-1]]))
    forest.join(by[same], by[same + 1])
    forest.join(*link_places(words[:, 0], bucket, NEAR))
    for at, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        tree = forest.parent[at:end]
        names, n = np.unique(tree, return_counts=True)
        if len(names) < 2:
            continue
        large = tree == names[n.argmax()]
        rows = at + np.concatenate([np.flatnonzero(~large), np.flatnonzero(large)])
        outside = len(rows) - int(large.sum())
        held = words[rows]
        start = 0
        while start < outside:
            stop = min(outside, start + max(1, COMPARED // (len(rows) - start)))
            apart = sum(np.bitwise_count(w[start:stop, None] ^ w[None, start:]).astype(np.uint16) for w in held.T)
            i, j = np.nonzero(apart <= within)
            forest.join(rows[i + start], rows[j + start])
            start = stop
    i, j = forest.stars()
    return order[i], order[j]


def alike(left: pa.ListArray, right: pa.ListArray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) of sets at least that similar, all; without ``right`` pairs of left."""
    c = common_terms(left, left if right is None else right)
    na, nb = (x.value_lengths().to_numpy().astype(np.float64) for x in (left, left if right is None else right))
    found = c >= similarity * (na[:, None] + nb[None, :] - c) - 1e-6
    return np.nonzero(np.triu(found, 1) if right is None else found)


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, component_id, first, as near_duplicates().

    Texts link whose sets of ``width``-word shingles have a Jaccard similarity
    of ``similarity`` or more. Three bits of a 64-bit SimHash are too few for
    that, so a longer one gives each text a bucket in each of some tables of
    sampled bits, and in a bucket the Gray-order index and comparisons of whole
    fingerprints find candidates. These only tell which texts might be linked: the
    shingle sets of each component of candidates then come together in tasks, a
    pair of bounded blocks each, and all their pairs are decided there by exact
    similarity. A task gives stars of what it joined, so neither step has more
    rows than texts went in, and paths stay short. Texts of the same long fingerprint count as
    copies. Null and empty texts are copies of each other; ids, repeats and
    other columns as in near_duplicates().
    """

    def codes_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 2):
            sets = [shingle_hashes(t, width) for t in texts]
            found = np.array([long_fingerprint(s) for s in sets]).reshape(-1, LONG).view(np.int64)
            yield arrow_rows(part, (0, 1), ["_row", "doc_id", *names, "n"], [*(pa.array(np.ascontiguousarray(found[:, k])) for k in range(LONG)), pa.array(map(len, sets), pa.int64())])

    def linked_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            i, j = bucket_links(np.column_stack([rows[n].to_numpy() for n in names]).view(np.uint64), rows["bucket"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(rows["code"].to_numpy()[x]) for x in (i, j)], names=["u", "v"])

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 3, SET_BYTES):
            sets = [shingle_hashes(t, width).view(np.int64) for t in texts]
            yield arrow_rows(part, (0, 1, 2), ["code", "component", "blocks", "set"], [pa.array(sets, pa.list_(pa.int64()))])

    def decided(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def links_of() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            (_, i, j), codes, block = own, rows["code"].to_numpy(), rows["block"].to_numpy()
            forest, parts = Forest(len(codes)), [np.flatnonzero(block == b) for b in dict.fromkeys((i, j))]
            sets = [rows["set"].combine_chunks().take(pa.array(p)) for p in parts]
            u, v = alike(sets[0], sets[1] if len(sets) > 1 else None, similarity)
            forest.join(parts[0][u], parts[-1][v])
            u, v = forest.stars()
            return pa.RecordBatch.from_arrays([pa.array(codes[u]), pa.array(codes[v])], names=["u", "v"])

        for b in batches:
            key = np.column_stack([b.column(k).to_numpy() for k in range(3)])
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else []
            for x, y in zip(heads, [*heads[1:], len(key)], strict=True):
                if own != (now := tuple(key[x].tolist())):
                    if own is not None:
                        yield links_of()
                    own, held = now, []
                held.append(b.slice(x, y - x))
        if own is not None:
            yield links_of()

    names = [f"w{k}" for k in range(LONG)]
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))).select("_row", "doc_id", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = rows.mapInArrow(codes_of, f"_row long, doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", n long")
    marks = cut(marks.withColumn("code", F.xxhash64(*names)))
    bits, tables = tables_for(marks.count())
    keys = [F.xxhash64(F.lit(t), *(F.col(f"w{k + 1}").bitwiseAND(F.lit(m)) for k, m in enumerate(masks))) for t, masks in enumerate(_table_masks(bits, tables))]
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).alias("least")
    codes = cut(marks.groupBy("code").agg(least, F.max("n").alias("n"), *(F.first(n).alias(n) for n in names)))

    placed = codes.select("code", *names, F.explode(F.array(*keys)).alias("bucket"))
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    candidates = components(placed.repartition("bucket").mapInArrow(linked_in, "u long, v long").select(*ends).distinct())
    members = cut(candidates.join(codes.select(F.col("code").alias("u"), "n", F.col("least._row").alias("_row")), "u").withColumnRenamed("u", "code"))
    sizes = members.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    named = cut(members.join(own_exchange(sizes, "component"), "component").select("_row", "code", "component", F.greatest("blocks", F.lit(1)).alias("blocks")))
    sets = rows_in(rows.select("_row", "_text"), named, "_row").select("code", "component", "blocks", "_text").mapInArrow(sets_of, "code long, component long, blocks int, set array<long>")
    block = F.pmod(F.xxhash64("code", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    dealt = sets.select("code", "component", "set", block, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = dealt.select("component", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), F.col("block").cast("long").alias("block"), "code", "set")
    near = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(decided, "u long, v long")
    return _components_of(marks, codes.select("code", "least"), components(near))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, that with the smallest id; all columns as they came.

    Null and empty texts are one component, of repeated rows the first stays, a
    null id loses to any other; no rows give none. Rows are told apart by a
    column whose name no column of ``docs`` has.
    """
    row = unused(docs, "_row")
    gone = cut(similar_documents(docs).where("NOT first").select(F.col("_row").alias(row)))
    return rows_not_in(numbered(docs, row), gone, row).drop(row)
