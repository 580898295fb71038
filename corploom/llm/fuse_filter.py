"""Static binary-fuse filters, and screens of bounded size made of them.

A three-wise binary fuse filter with 8-bit fingerprints holds a set of 64-bit
keys in about 9 bits each: it never rules out a key of the set, and rules out
all but about 1 in 256 others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct digests in a shard, about: 1 MB of filter.
SHARD_KEYS = 500_000
FILTER_SCHEMA = "shard long, seed long, segment long, segments long, fingerprints binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Murmur's 64-bit finaliser over key + seed."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each hash: one in each of three segments next to each other."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary fuse filter of distinct 64-bit keys: (seed, segment length, segments, fingerprints)."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = min(1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)), 1 << 18)
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))
    segments = max(1, -(-room // segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        at = _slots(h, segment, segments)
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        layers, left = [], len(keys)
        while left:
            lone = np.flatnonzero(count == 1)
            who, first = np.unique(owner[lone], return_index=True)
            if not len(who):
                break
            layers.append((who, lone[first]))
            left -= len(who)
            for row in at[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, who)
        if left:
            continue
        table, prints = np.zeros(size, np.uint8), _prints(h)
        for who, slot in reversed(layers):
            table[slot] = 0
            table[slot] = prints[who] ^ np.bitwise_xor.reduce(table[at[:, who]], axis=0)
        return seed, segment, segments, table.tobytes()
    raise ValueError("no seed peels these keys; are they 64-bit hashes?")


def probe_filter(keys: np.ndarray, seed: int, segment: int, segments: int, fingerprints: bytes) -> np.ndarray:
    """True for every key of the set, and for about 1 in 256 others."""
    h = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    table = np.frombuffer(fingerprints, np.uint8)
    return np.bitwise_xor.reduce(table[_slots(h, segment, segments)], axis=0) == _prints(h)


def _sharded(digests: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    return digests.withColumn("_key", key).withColumn("_shard", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(shards)))


def snapshot_filters(digests: DataFrame, shards: int) -> DataFrame:
    """Static filters of a snapshot's distinct ``digest`` values, one row a shard; store them beside the snapshot."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = build_filter(pdf["_key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [pdf["_shard"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "fingerprints": [table]})

    return _sharded(digests.select("digest"), shards).select("_shard", "_key").groupBy("_shard").applyInPandas(build, FILTER_SCHEMA)


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct incoming ``digest`` values that a snapshot's filters can't rule out."""

    def probe(incoming: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if held.empty or incoming.empty:
            return incoming[["digest"]].iloc[:0]
        f = held.iloc[0]
        hit = probe_filter(incoming["_key"].to_numpy().view(np.uint64), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["fingerprints"])
        return incoming.loc[hit, ["digest"]]

    kind = digests.schema["digest"].dataType.simpleString()
    return _sharded(digests.select("digest"), shards).groupBy("_shard").cogroup(filters.groupBy(F.col("shard"))).applyInPandas(probe, f"digest {kind}")


# -- screens of rows ----------------------------------------------------------

#: Keys of which a screen is made: its filters take about 5 MB.
SCREEN_KEYS = 4_000_000


def may_be_in(keys: DataFrame, column: str, most: int = SCREEN_KEYS) -> Column | None:
    """A condition on ``column`` that holds for every value in stored ``keys`` and for few others; None for too many keys.

    The filters are built in tasks and broadcast: at most 9 bits for each of
    ``most`` keys. Only the hashes of the column go to Python.
    """
    n = keys.count()
    if n > most:
        return None
    shards = max(1, -(-n // SHARD_KEYS))
    filters = {r["shard"]: tuple(r)[1:] for r in snapshot_filters(keys.select(F.col(column).alias("digest")), shards).collect()}
    shared = keys.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def probe(key: pd.Series, shard: pd.Series) -> pd.Series:
        out = np.zeros(len(key), bool)
        for s in np.unique(shard):
            if s in shared.value:
                at = np.flatnonzero(shard == s)
                out[at] = probe_filter(key.to_numpy()[at].view(np.uint64), *shared.value[s])
        return pd.Series(out)

    key = F.xxhash64(column)
    return probe(key, F.pmod(F.xxhash64(key, F.lit(1)), F.lit(shards)))


def rows_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among the distinct stored ``keys``, with the keys' other columns.

    Rows that the screen rules out stay where they are; only the others are
    shuffled. For too many keys to screen all rows are.
    """
    maybe = may_be_in(keys, column)
    return (rows if maybe is None else rows.where(maybe)).join(keys, column)


def rows_not_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is not among the stored ``keys``; the others as in rows_in()."""
    maybe = may_be_in(keys, column)
    if maybe is None:
        return rows.join(keys, column, "left_anti").select(*rows.columns)
    sure = rows.where(~maybe)
    return sure.unionByName(rows.where(maybe).join(keys, column, "left_anti").select(*rows.columns))
