"""Exact dedup: static binary-fuse filters screen incoming digests.

A snapshot is immutable, so its distinct digests get static filters (three-wise
binary fuse filters with 8-bit fingerprints, about 9 bits a key), one per shard
of the digest space. Incoming digests are probed against the filter of their
shard; only positives join the snapshot's exact buckets. Duplicates inside the
incoming batch are grouped on their own. All digests that come up twice by
either way get a byte check: their texts are grouped by content, not by digest.

Nothing here holds a group: copies are counted before they are shuffled, shards
hold a bounded number of distinct digests, and the two joins that see copies are
plain equi-joins with their own exchanges, which Spark splits where they skew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import cut, documents, numbered, text_or_empty, unused
from corploom.llm.fuse_filter import SHARD_KEYS, may_be_in, rows_not_in, screen, snapshot_filters

def exact_dedup(
    docs: DataFrame,
    in_snapshot: Column,
    digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, digest, keep_id, group_size, kept.

    ``docs`` must be a scan of stored data (see ``numbered``). Rows for which
    ``in_snapshot`` holds form the snapshot, the others the incoming batch. Of
    equal texts the row with the largest id stays; among repeated rows with
    that id, the first. Null texts count as empty; a null id loses to any other
    and keeps its own group only if all ids in it are null. No rows give no
    rows. Other columns are not read, so their names can't clash.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"), F.coalesce(in_snapshot, F.lit(False)).alias("_old")))
    marks = cut(rows.select("_row", "doc_id", "_old", digest(F.col("_text")).alias("digest")))
    tally = marks.groupBy("_old", "digest").agg(F.count("*").alias("n"))
    old, new = tally.where("_old").select("digest", "n"), tally.where("NOT _old").select("digest", "n")

    shards = max(1, -(-marks.count() // shard_keys))
    positives = screen(new, snapshot_filters(old, shards), shards)
    both = positives.join(old.select("digest"), "digest", "left_semi")
    twice = old.where("n > 1").select("digest").union(new.where("n > 1").select("digest"))
    # Stored, the digests have no partitioning that Spark could take over: both
    # sides of the join below get their own exchange, so hot digests split.
    candidates = cut(both.union(twice).distinct())

    # Byte check: group the candidates' texts by content. The tag keeps Spark
    # from grouping inside the join's partitioning, so copies are first counted
    # where the join leaves them.
    texts = rows.select("_row", "doc_id", digest(F.col("_text")).alias("digest"), "_text")
    maybe = may_be_in(candidates, "digest")  # texts that this rules out aren't shuffled
    suspects = (texts if maybe is None else texts.where(maybe)).join(candidates.hint("shuffle_hash"), "digest", "left_semi")
    groups = cut(
        suspects.groupBy(F.struct("digest").alias("tag"), "_text")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", -F.col("_row"))).alias("top"))
        .select("tag.digest", F.sha2("_text", 256).alias("_sha"), F.length("_text").alias("_len"), "group_size", F.col("top.doc_id").alias("keep_id"), (-F.col("top.col2")).alias("_keep_row"))
    )
    collided = groups.groupBy("digest").count().where("count > 1").select("digest")
    if collided.isEmpty():
        found = marks.join(groups, "digest", "left")
    else:  # different texts under one digest: tell them apart by content
        parted = texts.join(collided, "digest", "left_semi").select("_row", F.sha2("_text", 256).alias("_sha"), F.length("_text").alias("_len"))
        sure = marks.join(collided, "digest", "left_anti").join(groups, "digest", "left")
        apart = marks.join(parted, "_row").join(groups, ["digest", "_sha", "_len"], "left")
        found = sure.unionByName(apart)
    return found.select(
        "_row",
        "doc_id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_keep_row").isNull() | (F.col("_keep_row") == F.col("_row"))).alias("kept"),
    )


def second_half() -> Column:
    """A split of one table into snapshot and batch, by the id's checksum."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: half of them as the snapshot, the other half coming in."""
    return exact_dedup(documents(spark, sf_dir), second_half()).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one document stays, that with the largest id; all columns as they came.

    Null and empty texts are equal, of repeated rows the first stays, a null id
    loses to any other; no rows give none. Rows are told apart by a column whose
    name no column of ``docs`` has.
    """
    row = unused(docs, "_row")
    gone = cut(exact_dedup(docs, second_half()).where("NOT kept").select(F.col("_row").alias(row)))
    return rows_not_in(numbered(docs, row), gone, row).drop(row)


SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
