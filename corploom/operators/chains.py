"""Chains of mentions and panels built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.session import small


def drop_consecutive_duplicates(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    before = F.lag(name).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(name)) | F.col("_before").isNull()).drop("_before")


def chains(mentions: DataFrame, gap: float, least: int = 2, most: int = 6) -> DataFrame:
    """(source, chain_no, names): runs of mentions closer than ``gap`` with other names than the mention before, as distinct names.

    ``mentions``: source, name, position, ord. Runs of one mention, and chains
    of fewer or more names, are left out.
    """
    w = Window.partitionBy("source").orderBy("position", "ord")
    new = (F.col("position") - F.lag("position").over(w) >= gap) | (F.lag("name").over(w) == F.col("name")) | F.lag("name").over(w).isNull()
    numbered = mentions.withColumn("_new", new.cast("int")).withColumn("chain_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("source", "chain_no").agg(F.array_sort(F.collect_list(F.struct("position", "ord", "name"))).alias("l"))
    names = F.array_distinct(F.transform("l", lambda x: x["name"]))
    return runs.where(F.size("l") >= 2).select("source", "chain_no", names.alias("names")).where(F.size("names").between(least, most))


def distinct_chains(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first chain of each signature."""
    w = Window.partitionBy(F.array_join("names", ">")).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assign_problem_types(rows: DataFrame, rules: DataFrame, least: int = 3) -> DataFrame:
    """(chain columns, type), many to many: the chain's head equals or is part of a rule's head, or the source has the keyword."""
    head = F.element_at("names", 1)
    hit = F.contains(head, F.col("head")) | F.contains(F.col("head"), head) | F.contains(F.col("source").cast("string"), F.col("keyword"))
    return rows.where(F.size("names") >= least).join(small(rules.select("type", "keyword", "head")), hit).drop("keyword", "head").distinct()


def with_catch_all(rows: DataFrame, typed: DataFrame, key: Sequence[str], name: str = "general") -> DataFrame:
    """Typed chains, and the rest under a catch-all type."""
    rest = rows.join(typed.select(*key), list(key), "left_anti").withColumn("type", F.lit(name))
    return typed.select(*rest.columns).unionByName(rest)


def top_chains(typed: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    w = Window.partitionBy("type").orderBy(*order)
    return typed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def handoff(names: Column, last: str) -> Column:
    """array<struct<name, to>>: each name's successor; the last hands off to the closing text."""
    return F.transform(names, lambda x, i: F.struct(x.alias("name"), F.coalesce(F.get(names, i + 1), F.lit(last)).alias("to")))


def select_panel(names: Column, combos: Sequence[tuple[int, Sequence[str]]], anchors: Sequence[str]) -> Column:
    """The first full combination; else the first three anchors that occur; else first, middle and last of the distinct names."""
    distinct = F.array_distinct(names)
    found = F.filter(F.array(*map(F.lit, anchors)), lambda a: F.array_contains(distinct, a))
    out = F.when(F.size(found) >= 3, F.slice(found, 1, 3)).when(F.size(distinct) <= 3, distinct)
    out = out.otherwise(F.array(F.element_at(distinct, 1), F.element_at(distinct, F.floor(F.size(distinct) / 2).cast("int") + 1), F.element_at(distinct, -1)))
    for _, combo in sorted(combos, reverse=True):
        full = F.size(F.array_intersect(distinct, F.array(*map(F.lit, combo)))) == len(combo)
        out = F.when(full, F.array(*map(F.lit, combo))).otherwise(out)
    return out


def build_panel(rows: DataFrame, roles: DataFrame, id_col: str, panel: str, default: tuple[str, str, str] = ("participant", "open", "What does {name} overlook?")) -> DataFrame:
    """(id, participants, quality): names with role, stance and challenge, in order; quality counts known roles.

    ``roles``: name, role, stance, challenge; names without a role have the
    default, with their name put in for {name}.
    """
    seats = rows.select(id_col, F.posexplode(panel).alias("seat", "name")).join(small(roles), "name", "left")
    asked = F.coalesce("challenge", F.replace(F.lit(default[2]), F.lit("{name}"), F.col("name")))
    one = F.struct("seat", "name", F.coalesce("role", F.lit(default[0])).alias("role"), F.coalesce("stance", F.lit(default[1])).alias("stance"), asked.alias("challenge"))
    return seats.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias("participants"), F.count("role").alias("quality"))
