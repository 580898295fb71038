"""Connected components of an edge table, as joins and group-bys.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
components in MapReduce and beyond", 2014). Each step sends every node only the
least neighbour it knows, so a node with very many edges is an aggregation that
is combined before the shuffle and a join that Spark can split, never a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.session import cut


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def own_exchange(df: DataFrame, key: str) -> DataFrame:
    """The same rows with ``key`` computed anew.

    Grouped rows are partitioned by their key already. A join would take that
    over and send all rows of a hot key to the group's task; a computed key has
    no partitioning, so both sides of the join get an exchange of their own and
    adaptive execution splits the hot key.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _directed(edges)
    least = own_exchange(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = own_exchange(down.groupBy("u").agg(F.min("v").alias("m")), "u")
    return down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(u, component) for every node of ``edges`` (u, v); component is the least node reachable.

    Loops and repeated edges are allowed; rows with a null end are left out.
    No edges give no rows. The rounds grow with the logarithm of the longest
    path; each ends in a checkpoint of at most one row per edge.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before = None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)).distinct())
        # Stars map to themselves, so equal sums of row hashes mean the end.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point; raise max_rounds")
    return edges.select("u", F.col("v").alias("component")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("component"))).distinct()
