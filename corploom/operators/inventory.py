"""Inventories: grouping, noise, best variants, ranks, duplicates and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions.text import norm_name
from corploom.operators.similar import similar_pairs
from corploom.session import cut, small


def merge_candidates(rows: DataFrame) -> DataFrame:
    """(norm, sources, frequency, display, type) from (name, source, type, ord): the longest name (first on ties), the first type.

    Grouped in two steps, by name and source and then by name: a source's rows
    are added up before its name's, so a name in all rows is many tasks' work and
    its list gets each source once. See source_lists() for names whose sources
    don't fit a row.
    """
    named = rows.withColumn("norm", norm_name(F.col("name")))
    longest, first = F.struct(F.length("name").alias("n"), (-F.col("ord")).alias("o"), "name"), F.struct("ord", "type")
    each = named.groupBy("norm", "source").agg(F.count("*").alias("times"), F.max(longest).alias("longest"), F.min(first).alias("first"))
    whole = each.groupBy("norm").agg(F.array_sort(F.collect_list("source")).alias("sources"), F.sum("times").alias("frequency"), F.max("longest").alias("longest"), F.min("first").alias("first"))
    return whole.select("norm", "sources", "frequency", F.col("longest.name").alias("display"), F.col("first.type").alias("type"))


def source_lists(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """(norm, part from 0, n_sources, sources): each name's distinct sources in order, about ``most`` in a row, however many there are."""
    pairs = rows.select(norm_name(F.col("name")).alias("norm"), "source").where("source IS NOT NULL").distinct()
    counts = pairs.groupBy("norm").agg(F.count("*").alias("n_sources"))
    # Ranges of (name, source): a hot name spreads over many, and each makes lists of its own rows.
    ranged = cut(pairs.repartitionByRange("norm", "source").sortWithinPartitions("norm", "source").withColumn("_i", F.monotonically_increasing_id()))
    lists = ranged.groupBy("norm", F.expr(f"_i div {most}").alias("_k")).agg(F.array_sort(F.collect_list("source")).alias("sources"))
    place = F.row_number().over(Window.partitionBy("norm").orderBy("_k")) - 1
    return lists.withColumn("part", place).join(counts, "norm").select("norm", "part", "n_sources", "sources")


def filter_and_alias(inventory: DataFrame, noise: Sequence[str], aliases: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """Names of fitting length, with a letter, not led by a number, without noise; variants take their name and add up."""
    norm = F.col("norm")
    bad = F.lit(False)
    for term in noise:
        bad = bad | F.contains(norm, F.lit(term))
    kept = inventory.where(F.length(norm).between(least, most) & F.rlike(norm, F.lit(r"\p{L}")) & ~F.rlike(norm, F.lit("^[0-9]")) & ~bad)
    named = kept.join(small(aliases), F.col("norm") == F.col("variant"), "left").withColumn("norm", F.coalesce("canonical", "norm"))
    return named.groupBy("norm").agg(F.sum("frequency").alias("frequency"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def status_counts(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dim, value, n) for every dimension in one pass; null is '_null'."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("_null")).alias("value")) for d in dims))
    return rows.select(F.inline(pairs)).groupBy("dim", "value").agg(F.count("*").alias("n"))


def keep_best_variant(rows: DataFrame, name: str, quality: str, order: str) -> DataFrame:
    """Adds norm and kept: of names alike the one of highest quality, the first on ties."""
    norm = rows.withColumn("norm", norm_name(F.col(name)))
    w = Window.partitionBy("norm").orderBy(F.desc(quality), order)
    return norm.withColumn("kept", F.row_number().over(w) == 1)


def latest_version(rows: DataFrame, name: str) -> DataFrame:
    """Of names alike but for a trailing number the last by name."""
    base = rows.withColumn("base", F.regexp_replace(name, " [0-9]+$", ""))
    w = Window.partitionBy("base").orderBy(F.desc(name))
    return base.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranks(rows: DataFrame, group: str | None, order: str, name: str = "rank") -> DataFrame:
    """Adds each row's place from 1 in its group (or among all), by ``order``, whose values are distinct.

    Places come from a range sort: each range counts its rows, the counts add
    up (a row for each range and group), and each range numbers its own; no task
    sees a whole group. The sorted rows are stored, so that both passes see the
    same ranges.
    """
    keys = [group] if group else []
    ranged = cut(rows.repartitionByRange(*keys, order).withColumn("_p", F.spark_partition_id()))
    # A null group is a group too, so groups are matched null-safe.
    counts = ranged.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*(F.col(k).alias("_g") for k in keys), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    same = F.col("_p") == F.col("_q")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_g"))
    own = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(order))
    return ranged.withColumn("_own", own).join(start, same).withColumn(name, (F.col("_own") + F.col("_from")).cast("long")).select(*rows.columns, name)


def round_robin(ids: DataFrame, key: str, n: int) -> DataFrame:
    """(key, batch): the place of a key among all in order, modulo n."""
    return ranks(ids.select(key), None, key).select(key, ((F.col("rank") - 1) % n).cast("int").alias("batch"))


def next_sequence(rows: DataFrame, existing: DataFrame, group: str, order: str, manual: Sequence[str] = (), first_only: bool = False) -> DataFrame:
    """Numbers a group's rows on from its highest number; groups made by hand are left out, with ``first_only`` all but the first of a group."""
    top = existing.groupBy(group).agg(F.max("number").alias("_top"))
    left = rows.where(~F.coalesce(F.col(group).isin(*manual), F.lit(False))) if manual else rows
    numbered = ranks(left, group, order, "number")
    if first_only:
        numbered = numbered.where("number = 1")
    return numbered.join(top, group, "left").withColumn("number", F.col("number") + F.coalesce("_top", F.lit(0))).drop("_top")


def pilot_set(ids: DataFrame, key: str, n: int, explicit: Sequence | None = None) -> DataFrame:
    """(ord from 1, key): the explicit ids in their order, which must be known and distinct, else the first n in order."""
    if explicit is None:
        first = ids.select(key).distinct().orderBy(key).limit(n)
        return first.select(F.row_number().over(Window.orderBy(key)).alias("ord"), key)  # n rows
    if len(set(explicit)) < len(explicit):
        raise ValueError("an id is listed twice")
    listed = ids.sparkSession.createDataFrame(list(enumerate(explicit, 1)), f"ord int, {key} {ids.schema[key].dataType.simpleString()}")
    known = ids.select(key).join(F.broadcast(listed), key, "left_semi").distinct()  # as long as the list
    checked = listed.join(known.withColumn("_known", F.lit(True)), key, "left")
    fine = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown id "), F.col(key).cast("string"))).cast(listed.schema[key].dataType))
    return checked.select("ord", fine.alias(key))


def duplicates_by(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """(key, value, keep, n): groups of more than one row by each of several keys."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    rows = rows.select(id_col, F.inline(pairs)).where("value IS NOT NULL")
    return rows.groupBy("key", "value").agg(F.min(id_col).alias("keep"), F.count("*").alias("n")).where("n > 1")


def review_queue(rows: DataFrame, title: Column, body: str) -> DataFrame:
    """Normalised titles with more than one body: for review, never merged."""
    return rows.groupBy(title.alias("title")).agg(F.count_distinct(body).alias("n_bodies")).where("n_bodies > 1")


def near_copy_candidates(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(a, b, jaccard): all pairs of different texts whose word-shingle sets have at least ``least``.

    Equal texts, and texts with the same shingles, are one class, represented by
    the least id, so copies give no pairs; a pair of different texts is a result
    of its own and none is dropped. Similarities are exact (see operators/similar.py);
    texts without words give none. ``docs`` are stored: they are read three times.
    """
    return similar_pairs(docs.select(F.col("doc_id").alias("id"), "text"), least, width)


def _version(hashes: DataFrame) -> DataFrame:
    """One row (version): 16 hex digits over all ``h``, whatever their order; prefixes are grouped first, so the last step sorts at most 65,536."""
    part = hashes.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return part.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "h"))), ","), 256), 1, 16).alias("version"))


def corpus_version(rows: DataFrame, key: str) -> DataFrame:
    """One row (version) over all columns of all rows."""
    body = F.to_json(F.struct(*sorted(rows.columns)))
    return _version(rows.select(F.sha2(F.concat_ws("=", F.col(key).cast("string"), body), 256).alias("h")))


def knowledge_version(files: DataFrame) -> DataFrame:
    """One row (version) over the (path, sha256) of all published files."""
    return _version(files.select(F.sha2(F.concat_ws("\n", "path", "sha256"), 256).alias("h")))


def artifacts(rows: DataFrame, key: str, text: str, folder: str, suffix: str) -> DataFrame:
    """(relative_path, sha256, size_bytes) of the files that rows are published as."""
    path = F.concat(F.lit(folder + "/"), F.col(key).cast("string"), F.lit(suffix))
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return rows.select(path.alias("relative_path"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("size_bytes"))


def run_summary(sources: DataFrame, published: DataFrame) -> DataFrame:
    """One row: sources registered, by cleaning status, their warnings, and number, bytes and version of the artifacts.

    ``sources``: cleaning_status, warnings; ``published``: artifacts().
    """
    listed = sources.groupBy("cleaning_status").agg(F.count("*").alias("n"), F.sum(F.size("warnings")).alias("w"))
    each = F.array_sort(F.collect_list(F.struct("cleaning_status", "n")))
    one = listed.agg(F.sum("n").alias("registered"), each.alias("by_status"), F.sum("w").alias("n_warnings"))
    files = published.agg(F.count("*").alias("n_artifacts"), F.sum("size_bytes").alias("n_bytes"))
    version = knowledge_version(published.withColumnRenamed("relative_path", "path"))
    return one.crossJoin(files).crossJoin(version)  # one row each


def batch_summary(batches: DataFrame) -> DataFrame:
    """Sizes, distinct sizes, alignment of ids with updates, histograms and route sizes of each batch.

    ``batches``: batch_id, source_ids array, source_updates array<struct<source_id,
    action>>, review_decisions array<struct<type>>, routes, relations,
    safety_rules and tombstones arrays. A null array counts as empty.
    """

    def histogram(kinds: Column) -> Column:
        listed = F.array_sort(F.array_distinct(F.array_compact(kinds)))
        return F.transform(listed, lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n")))

    empty = lambda c: F.coalesce(F.col(c), F.array().cast(batches.schema[c].dataType))
    rows = batches.select("batch_id", *(empty(c).alias(f"_{c}") for c in batches.columns if c != "batch_id"))
    ids, updated = F.col("_source_ids"), F.array_compact(F.transform("_source_updates", lambda x: x["source_id"]))
    return rows.select(
        "batch_id",
        F.size(ids).alias("source_ids"),
        F.size(F.array_distinct(ids)).alias("source_id_set_size"),
        F.size("_source_updates").alias("source_updates"),
        F.size(F.array_distinct(updated)).alias("source_update_id_set_size"),
        F.size("_review_decisions").alias("review_decisions"),
        (F.size(F.array_distinct(ids)) == F.size(F.array_distinct(updated))).alias("source_id_set_match"),
        ((F.size(ids) == F.size(updated)) & (F.size(F.array_except(ids, updated)) == 0)).alias("source_ids_match"),
        histogram(F.transform("_review_decisions", lambda x: x["type"])).alias("decision_by_type"),
        histogram(F.transform("_source_updates", lambda x: x["action"])).alias("updates_by_action"),
        *(F.size(f"_{c}").alias(f"n_{c}") for c in ("routes", "relations", "safety_rules", "tombstones")),
    )


def quorum(claims: DataFrame, claim: str, source: str, least: int = 2) -> DataFrame:
    return claims.groupBy(claim).agg(F.count_distinct(source).alias("n_sources")).where(F.col("n_sources") >= least)


def drift(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, now, base, change) of counts; missing ones are 0."""
    both = current.select(key, F.col("n").alias("now")).join(baseline.select(key, F.col("n").alias("base")), key, "full_outer").na.fill(0, ["now", "base"])
    return both.withColumn("change", F.col("now") - F.col("base"))
