"""Merkle manifest of a dataset by slot pivots.

Every row is a leaf. Leaves are numbered in order within their group, and the
nodes of a level are pivoted: conditional aggregates spread the children of each
parent over ``fanout`` slot columns. The slot columns side by side give the
parent's digest; without a child's own column they are its siblings. Groups end
in a subroot each, the subroots in one root.

Levels are climbed some at a time: a tier parts its nodes into blocks of whole
subtrees, shuffles them once by block, and pivots all levels of a block in place
(windows over the block's columns); one row a block goes on to the next tier. On
the way back each tier's proofs are extended by those of its blocks. So the
texts are never shuffled, only leaves, and all but the first tier are small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm.common import cut, documents

#: Leaves of a block, at most: the levels of a tier are as many as fit.
BLOCK_LEAVES = 256
STEP = "struct<before: string, after: string>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hex sha256 of the values: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = (v.cast("string") for v in values)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof (array of struct(before, after), leaf first) lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hex sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds _at, the place from 0 within the group, and _n, the group's rows.

    The rows are sorted by ranges of (group, order), so a large group spreads over
    many tasks; sums of the ranges' rows tell where each begins.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    parts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_rows"), F.min("_i").alias("_least"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "_range", (before - F.col("_least")).alias("_shift"), F.sum("_rows").over(whole).alias("_n"))
    return ranged.join(parts, [group, "_range"]).withColumn("_at", F.col("_i") + F.col("_shift")).drop("_range", "_i", "_shift")



def _pivoted(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Rows (_g, _at, _n, _node) with _node raised by ``levels`` levels, and _path, the steps there."""
    rows = rows.withColumn("_block", F.expr(f"_at div {fanout**levels}"))
    steps = []
    for level in range(1, levels + 1):
        below = fanout ** (level - 1)
        run = Window.partitionBy("_g", "_block", F.expr(f"_at div {below * fanout}"))
        slot = F.expr(f"(_at div {below}) % {fanout}")
        slots = [f"_c{s}" for s in range(fanout)]
        rows = rows.select("*", slot.alias("_slot"), *(F.max(F.when(slot == s, F.col("_node"))).over(run).alias(c) for s, c in enumerate(slots)))
        before = F.concat_ws("", *(F.when(F.col("_slot") > s, F.col(c)) for s, c in enumerate(slots)))
        after = F.concat_ws("", *(F.when(F.col("_slot") < s, F.col(c)) for s, c in enumerate(slots)))
        many = F.col("_n") > below  # nodes of this level, if more than one
        step = F.when(many, F.struct(before.alias("before"), after.alias("after")))
        steps.append(f"_step{level}")
        rows = rows.withColumn(steps[-1], step).withColumn("_node", F.when(many, F.sha2(F.concat_ws("", *slots), 256)).otherwise(F.col("_node"))).drop("_slot", *slots)
    return rows.withColumn("_path", F.array_compact(F.array(*steps))).drop(*steps)


def _climb(rows: DataFrame, most: int, fanout: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (_g, _at, _n, _node, ...) with _path up to their root, and what ``finish`` tells of the groups.

    ``most`` is the largest group's number of nodes. ``finish`` takes one row a
    group (_g, _at = 0, _n = 1, _node) and adds _path and further columns.
    """
    if most <= 1:
        return finish(rows)
    levels = 1
    while fanout ** (levels + 1) <= BLOCK_LEAVES and fanout**levels < most:
        levels += 1
    width = fanout**levels
    raised = _pivoted(rows, fanout, levels)
    heads = raised.groupBy("_g", "_block").agg(F.max("_node").alias("_node"), F.max(F.expr(f"(_n + {width - 1}) div {width}")).alias("_n"))
    above = _climb(cut(heads.withColumnRenamed("_block", "_at")), -(-most // width), fanout, finish)
    above = above.drop("_n", "_node").withColumnRenamed("_at", "_block").withColumnRenamed("_path", "_above")
    return raised.join(above, ["_g", "_block"]).withColumn("_path", F.concat("_path", "_above")).drop("_block", "_above")


def merkle_manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str, fanout: int = 2, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``keep``'s columns, leaf, subroot, root, path.

    A leaf is the digest of ``fields``. Each group's leaves ascend by ``order``
    (null first; rows of equal order by their digest); every ``fanout``
    consecutive nodes, of the last run fewer and even one, become a node until
    one remains, the subroot. Subroots by group (null first, UTF-8 bytewise) give
    the root likewise. ``path`` is an array of struct(before, after), the
    siblings left and right of a leaf's ancestors; see fold() and
    proof_digest(). A lone row is its own root with an empty path. Repeated rows
    are leaves of their own; no rows give none. Other columns aren't read, so
    their names can't clash.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    extra = {f"_keep{i}": c for i, c in enumerate((keep or {}).values())}
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(key.alias("_g"), F.col(order).alias("_o"), leaf_digest([F.col(f) for f in fields]).alias("_leaf"), *(c.alias(n) for n, c in extra.items()))
    # The row's number only spreads repeated rows over ranges.
    leaves = positions(leaves.withColumn("_row", F.monotonically_increasing_id()), "_g", ["_o", "_leaf", "_row"]).drop("_row").withColumn("_node", F.col("_leaf"))

    def top(subroots: DataFrame) -> DataFrame:
        placed = positions(subroots.select(F.lit("").alias("_all"), F.col("_g").alias("_of"), F.col("_node").alias("_subroot")), "_all", ["_of"])
        placed = placed.select(F.col("_all").alias("_g"), "_at", "_n", F.col("_subroot").alias("_node"), "_of", "_subroot")
        whole = _climb(placed, placed.agg(F.max("_n")).first()[0] or 0, fanout, lambda one: one.withColumn("_path", F.array().cast(f"array<{STEP}>")).withColumn("_root", F.col("_node")))
        found = whole.select(F.col("_of").alias("_g"), "_subroot", "_path", "_root")
        return subroots.join(cut(found), "_g")

    most = leaves.agg(F.max("_n")).first()[0] or 0
    found = _climb(leaves, most, fanout, top)
    return found.select(F.col("_o").alias(order), *(F.col(n).alias(name) for n, name in zip(extra, keep or {}, strict=True)), F.col("_leaf").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents by language; where 7 divides the id's crc32, a leaf with one more in n_chars is folded. A null id isn't tampered with."""
    docs = documents(spark, sf_dir)
    tampered = [F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = F.when(hit, leaf_digest(tampered))
    found = merkle_manifest(docs, FIELDS, "lang", "doc_id", keep={"tampered": shown})
    folded = found.withColumn("folded_root", fold(F.col("path"), F.coalesce("tampered", "leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _hashed(values: Sequence[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


_CRC = "list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda k: CAST(k AS BIGINT)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END))"
_LEVELS = "SELECT g, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))"

SQL = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS g, {_hashed(FIELDS)} AS leaf, {_hashed([f"{f} + 1" if f == "n_chars" else f for f in FIELDS])} AS spoilt,
                   coalesce(xor({_CRC}, CAST(4294967295 AS BIGINT)) % 7 = 0, false) AS hit FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
        levels AS (
            SELECT g, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY g
            UNION ALL {_LEVELS} FROM levels WHERE len(nodes) > 1),
        subroots AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS g_at FROM levels WHERE len(nodes) = 1),
        tops AS (
            SELECT 'top' AS g, 0 AS level, list(subroot ORDER BY g_at) AS nodes FROM subroots
            UNION ALL {_LEVELS} FROM tops WHERE len(nodes) > 1),
        steps AS (
            SELECT p.doc_id, p.g, p.place, l.level, (p.place >> l.level) AS node, l.nodes[xor(p.place >> l.level, 1) + 1] AS sibling
            FROM placed p JOIN levels l USING (g) WHERE len(l.nodes) > 1
            UNION ALL
            SELECT p.doc_id, p.g, p.place, 1000 + t.level, s.g_at >> t.level, t.nodes[xor(s.g_at >> t.level, 1) + 1]
            FROM placed p JOIN subroots s USING (g), tops t WHERE len(t.nodes) > 1),
        proofs AS (
            SELECT g, place, list({{'right': node & 1 = 1, 'sibling': coalesce(sibling, '')}} ORDER BY level) AS path FROM steps GROUP BY g, place),
        folded AS (
            SELECT p.doc_id, p.g, p.leaf, coalesce(q.path, []) AS path,
                   list_reduce([{{'right': false, 'sibling': CASE WHEN p.hit THEN coalesce(p.spoilt, p.leaf) ELSE p.leaf END}}] || coalesce(q.path, []),
                       lambda a, s: {{'right': false, 'sibling': sha256(CASE WHEN s.right THEN s.sibling || a.sibling ELSE a.sibling || s.sibling END)}}).sibling AS folded_root
            FROM placed p LEFT JOIN proofs q USING (g, place))
        SELECT f.doc_id, f.leaf, s.subroot, r.nodes[1] AS root, sha256(list_aggregate(list_transform(f.path, lambda x: x.sibling), 'string_agg', '')) AS proof_sha256,
               f.folded_root, f.folded_root = r.nodes[1] AS verified
        FROM folded f JOIN subroots s USING (g), tops r WHERE len(r.nodes) = 1
    """
}
