"""Projections: prompts, layers, reshaped and public rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.functions.text import slug, smart_slice
from corploom.operators.classify import is_shell
from corploom.operators.inventory import ranks
from corploom.session import small


def assemble_prompt(steps: Column, stock: str) -> Column:
    """'Step i - name: action' parted by blank lines; the stock sentence without steps."""
    said = F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(" - "), s["name"], F.lit(": "), s["action"])), "\n\n")
    return F.when(F.size(steps) > 0, said).otherwise(F.lit(stock))


def assemble_layers(layers: Sequence[tuple[str, Column, str]]) -> Column:
    """'[layer] text' lines; a layer without text gets its fallback."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"[{name}] "), F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(other))) for name, text, other in layers))


def replace_layer(prompt: Column, layer: str, steps: Column) -> Column:
    """Swaps one layer's text, or adds the layer behind the first line; null with fewer than two steps."""
    said = F.array_join(steps, "; ")
    has = F.contains(prompt, F.lit(f"[{layer}]"))
    before, rest = F.substring_index(prompt, f"[{layer}]", 1), F.regexp_extract(prompt, rf"(?s)\[{layer}\][^\[]*(.*)\z", 1)
    swapped = F.concat(before, F.lit(f"[{layer}] "), said, F.when(rest == "", "").otherwise(F.concat(F.lit("\n"), rest)))
    first = F.substring_index(prompt, "\n", 1)
    added = F.concat(first, F.lit(f"\n[{layer}] "), said, F.substr(prompt, F.length(first) + 1))
    return F.when(F.size(steps) >= 2, F.when(has, swapped).otherwise(added))


def expand_domains(rows: DataFrame, templates: DataFrame, key: str, name: str) -> DataFrame:
    """(key, scenarios map<domain, text>): each template with the row's name put in for {name}."""
    both = rows.select(key, name).crossJoin(small(templates))  # a template per domain
    said = F.replace("template", F.lit("{name}"), F.col(name))
    return both.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", said.alias("text"))))).alias("scenarios"))


def coalesce_from_source(rows: DataFrame, mined: DataFrame, key: str, column: str, least: int = 2) -> DataFrame:
    """Where the array has fewer than ``least`` items, the mined one."""
    other = mined.select(key, F.col(column).alias("_mined"))
    short = F.coalesce(F.size(column), F.lit(0)) < least
    return rows.join(other, key, "left").withColumn(column, F.when(short, F.coalesce("_mined", column)).otherwise(F.col(column))).drop("_mined")


def public_projection(catalog: DataFrame) -> DataFrame:
    """Without local_only rows; author, url and fingerprint are hidden where redacted."""
    hide = F.col("policy") == "redacted"
    shown = catalog.where("policy <> 'local_only'")
    for name in ("author", "url", "fingerprint"):
        shown = shown.withColumn(name, F.when(~hide, F.col(name)))
    return shown.withColumn("status", F.when(hide, "redacted").otherwise("public")).drop("policy")


def keyed_answer(name: Column, answers: Sequence[tuple[str, str]], default: str) -> Column:
    """The answer of the first key that the name contains."""
    return F.coalesce(*(F.when(F.contains(F.lower(name), F.lit(k)), v) for k, v in answers), F.lit(default))


def band(score: Column, high: int = 40, middle: int = 20) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "mid").otherwise("low")


def report_rows(rows: DataFrame, key: str, score: str, pair_score: str, high: int = 40, middle: int = 20) -> DataFrame:
    """A row for each entity: its score, its band, that of its closest pair, and a verdict of both."""
    own, pair = band(F.col(score), high, middle), band(F.col(pair_score), high, middle)
    verdict = F.when((own == "high") & (pair != "high"), "keep").when(own == "low", "rework").otherwise("review")
    return rows.select(key, score, own.alias("band"), pair.alias("pair_band"), verdict.alias("verdict"))


def chapter_pages(rows: DataFrame, chapters: DataFrame, order: str) -> DataFrame:
    """Rank by descending order inside the chapter, with neighbours; unknown chapters count as '00'."""
    known = rows.join(small(chapters.select(F.col("chapter").alias("_known"))), F.col("chapter") == F.col("_known"), "left")
    placed = known.withColumn("chapter", F.coalesce("_known", F.lit("00"))).drop("_known")
    key = F.struct((-F.col(order)).alias("o"), F.col("id").alias("i"))
    ranked = ranks(placed.withColumn("_key", key), "chapter", "_key").drop("_key")
    beside = lambda name, step: ranked.select("chapter", (F.col("rank") + step).alias("rank"), F.col("id").alias(name))
    return ranked.join(beside("before", 1), ["chapter", "rank"], "left").join(beside("after", -1), ["chapter", "rank"], "left")


def reshape(row: DataFrame, protocol: str = "step|check|list") -> DataFrame:
    """Flat V2 columns to the nested V3 row.

    V2: id, name, category, definition, triggers, steps array<struct<name, action,
    check>>, stops, pitfalls, prompt, quality. Names lose a broken end; triggers
    and stops of eight code points or fewer go; every part has a fallback; a
    prompt that says little is written anew in layers.
    """
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("name", "_+$", ""), "_{2,}", "_"), r"\([^)]*$", ""))
    base = row.withColumn("_name", F.coalesce(F.nullif(name, F.lit("")), F.col("name")))
    said = F.coalesce(F.nullif("definition", F.lit("")), F.concat(F.lit("How to use "), F.col("_name")))
    long_ = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.length(x) > 8)
    triggers = F.slice(long_("triggers"), 1, 5)
    base = base.withColumn("_definition", said).withColumn("_triggers", F.when(F.size(triggers) > 0, triggers).otherwise(F.array(F.concat(F.lit("When "), F.col("_name"), F.lit(" helps")))))
    steps = F.transform(F.slice("steps", 1, 6), lambda s, i: F.struct((i + 1).alias("step"), F.coalesce(F.nullif(s["action"], F.lit("")), s["name"]).alias("action"), F.coalesce(F.nullif(s["check"], F.lit("")), F.lit("Is the result clear?")).alias("checkpoint")))
    one = F.array(F.struct(F.lit(1).alias("step"), F.concat(F.lit("Apply "), F.col("_name")).alias("action"), F.lit("Is its idea clear?").alias("checkpoint")))
    base = base.withColumn("_steps", F.when(F.coalesce(F.size("steps"), F.lit(0)) > 0, steps).otherwise(one))
    prompt = F.coalesce("prompt", F.lit(""))
    written = assemble_layers([("mode", F.col("_definition"), "-"), ("protocol", F.array_join(F.transform("_steps", lambda s: s["action"]), "; "), "-"), ("gate", F.get("_steps", F.lit(0))["checkpoint"], "-"), ("format", F.lit(""), "Text")])
    base = base.withColumn("_shell", is_shell(prompt, F.col("_name"), protocol))
    overall = F.coalesce("quality", F.lit(3))
    return base.select(
        F.lit("3.0.0").alias("schema_version"),
        slug(F.coalesce(F.col("id").cast("string"), F.col("_name")), most=50).alias("id"),
        F.struct(F.col("_name").alias("name"), F.coalesce("category", F.lit("00")).alias("category"), slug(F.col("_name")).alias("skill_name")).alias("meta"),
        smart_slice(F.col("_definition"), 150).alias("core_definition"),
        F.struct(F.col("_triggers").alias("triggers"), F.slice(long_("stops"), 1, 3).alias("anti_triggers")).alias("when_to_use"),
        F.struct(F.concat(F.lit("Without "), F.col("_name"), F.lit(": "), F.get("_triggers", F.lit(0))).alias("without_model"), F.concat(F.lit("With "), F.col("_name"), F.lit(": "), smart_slice(F.col("_definition"), 60)).alias("with_model")).alias("before_after"),
        F.col("_steps").alias("reasoning_steps"),
        F.struct(F.concat(F.lit("Use "), F.col("_name"), F.lit(" on: ")).alias("activation"), F.when(F.col("_shell"), written).otherwise(prompt).alias("system_prompt")).alias("codex_integration"),
        F.slice(F.coalesce("pitfalls", F.array().cast("array<string>")), 1, 3).alias("pitfalls"),
        F.struct(
            F.least(overall, F.lit(5)).alias("definition_clarity"),
            F.when(F.size("_triggers") >= 3, 4).otherwise(2).alias("trigger_precision"),
            F.when(F.size("_steps") >= 3, 4).otherwise(3).alias("step_completeness"),
            F.when(F.col("_shell"), 3).otherwise(4).alias("prompt_effectiveness"),
            F.ceil(overall / 5 * 3 + 2).cast("int").alias("overall"),
        ).alias("quality"),
    )


def catalog_projection(rows: DataFrame, hidden: Sequence[str] = ("audit", "changes", "warnings")) -> DataFrame:
    return rows.drop(*hidden).withColumn("path", F.concat(F.lit("sources/"), F.col("doc_id").cast("string"), F.lit(".json")))


def summary_skeleton(catalog: DataFrame) -> DataFrame:
    """An empty summary per source, bound to its cleaned hash, to be filled in by a reviewer."""
    claim = F.lit(None).cast("struct<claim_id:string,text:string,claim_status:string>")
    none = F.array().cast("array<struct<claim_id:string,text:string,claim_status:string>>")
    names = ("mechanisms", "use_cases", "limitations", "unique_contributions")
    return catalog.select("source_id", "cleaned_sha256", F.lit("draft").alias("summary_status"), claim.alias("core_question"), claim.alias("core_conclusion"), *(none.alias(n) for n in names))
