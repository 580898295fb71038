"""Sections, names and fields mined from text by rules; arrays stay in their row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.functions.text import first_match
from corploom.operators.lexicon import lexicon_terms, scan_terms


def split_sections(docs: DataFrame, heading: str, chapter: str, least: int = 80, parts: int = 3) -> DataFrame:
    """(doc_id, section, text): split at headings; with fewer than ``parts`` parts at chapters if those give enough; short ones go."""
    one, two = F.split("text", heading, -1), F.split("text", chapter, -1)
    chosen = F.when(F.size(one) >= parts, one).when(F.size(two) >= parts, two).otherwise(one)
    return docs.select("doc_id", F.posexplode(chosen).alias("section", "text")).where(F.length("text") >= least)


def extract_name(text: Column, series: str = r"^(?:Part|Chapter) [0-9]+[:.] *", most: int = 15) -> Column:
    """The first heading of the first eight lines, else the first line, without series prefix and brackets, cut at a colon past place 2 or at ``most``."""
    head = F.slice(F.split(text, "\n", -1), 1, 8)
    heading = F.get(F.filter(F.transform(head, lambda x: F.regexp_extract(x, r"^#+[ \t]*(.+)", 1)), lambda x: x != ""), F.lit(0))
    name = F.coalesce(heading, F.get(head, F.lit(0)))
    name = F.trim(F.regexp_replace(F.regexp_replace(name, series, ""), r"[\[(].*?[\])]", ""))
    colon = F.instr(name, ":")
    return F.trim(F.when(colon > 3, F.substring(name, F.lit(1), F.least(colon - 1, F.lit(most)))).otherwise(F.substring(name, 1, most)))


def extract_definition(text: Column, patterns: Sequence[tuple[str, int]], intro: int = 120) -> Column:
    """The first pattern that hits; else the text's first ``intro`` code points."""
    return F.coalesce(first_match(text, list(patterns)), F.substring(text, 1, intro))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?\n]+", -1), lambda x: F.trim(x)), lambda x: x != "")


def first_sentence(text: Column, least: int = 12, most: int = 150) -> Column:
    return F.get(F.filter(sentences(text), lambda x: F.length(x).between(least, most)), F.lit(0))


def extract_bullets(text: Column, anchor: str, item: str, least: int, most: int, exclude: str, k: int, fallback: Sequence[str] = ()) -> Column:
    """Items of the section behind an anchor (to the next blank line), without marker, of fitting length, k at most.

    Where that gives none, the matches of the first of the ``fallback`` patterns
    that gives some, of fitting length.
    """
    section = F.regexp_extract(text, f"(?s){anchor}[^\\n]*\\n(.*?)(?:\\n\\n|\\z)", 1)
    items = F.regexp_extract_all(section, F.lit(f"(?m)^{item}(.+)$"), 1)
    fits = lambda found: F.slice(F.filter(found, lambda x: F.length(x).between(least, most) & ~F.rlike(x, F.lit(exclude))), 1, k)
    found = fits(items)
    for pattern in fallback:
        other = fits(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.trim(x)))
        found = F.when(F.size(found) > 0, found).otherwise(other)
    return found


def prefix_dedup(items: Column, n: int) -> Column:
    """Items whose first n code points no earlier kept item has."""
    start = F.array().cast("array<string>")
    return F.aggregate(items, start, lambda kept, x: F.when(F.exists(kept, lambda y: F.substring(y, 1, n) == F.substring(x, 1, n)), kept).otherwise(F.concat(kept, F.array(x))))


def extract_steps(text: Column, noise: str = "http", k: int = 5, anchor: str | None = None, least: int = 15) -> Column:
    """array<struct<step, name, action>> of numbered items, split at a colon in places 2 to 10, without noise and names twice in a row; two at least, or none.

    With an ``anchor`` the items are those behind it, to the next blank line;
    where that gives none, three or more numbered items of ``least`` code points
    anywhere in the text are steps, the first seven distinct ones.
    """
    body = text if anchor is None else F.regexp_extract(text, f"(?s){anchor}[^\\n]*\\n(.*?)(?:\\n\\n|\\z)", 1)
    items = F.filter(F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*[0-9]+[.)][ \t]*(.+)$"), 1), lambda x: ~F.rlike(x, F.lit(noise)))
    at = lambda x: F.instr(x, ":")
    parts = F.transform(items, lambda x: F.struct(F.trim(F.when(at(x).between(2, 10), F.substring_index(x, ":", 1)).otherwise(F.substring(x, 1, 10))).alias("name"), F.trim(F.when(at(x).between(2, 10), F.substr(x, at(x) + 1)).otherwise(x)).alias("action")))
    # A fold, so that the items are computed once: the name before, and the first k fresh ones.
    kind = "struct<before:string,kept:array<struct<name:string,action:string>>>"
    start = F.struct(F.lit(None).alias("before"), F.array().alias("kept")).cast(kind)

    def add(state: Column, x: Column) -> Column:
        fresh = ~state["before"].eqNullSafe(x["name"]) & (F.size(state["kept"]) < k)
        return F.struct(x["name"].alias("before"), F.when(fresh, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate(parts, start, add, lambda state: state["kept"])
    steps = F.transform(kept, lambda x, i: F.struct((i + 1).alias("step"), x["name"].alias("name"), x["action"].alias("action")))
    none = F.array().cast("array<struct<step:int,name:string,action:string>>")
    found = F.when(F.size(items) >= 2, steps).otherwise(none)
    if anchor is None:
        return found
    anywhere = F.regexp_extract_all(text, F.lit(rf"(?m)^[ \t]*[0-9]+[.)][ \t]*(.{{{least},}})$"), 1)
    some = F.slice(F.array_distinct(anywhere), 1, 7)
    other = F.transform(some, lambda x, i: F.struct((i + 1).alias("step"), F.trim(F.substring(x, 1, 25)).alias("name"), F.trim(F.substring(x, 1, 150)).alias("action")))
    return F.when(F.size(found) > 0, found).when(F.size(anywhere) >= 3, other).otherwise(none)


def mine_steps(text: Column, verbs: str, k: int = 6) -> Column:
    """Numbered items; with fewer than three, lines with a colon too; with fewer than two, sentences with a verb; distinct by prefix."""
    numbered = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*[0-9]+[.)][ \t]*(.+)$"), 1)
    colons = F.regexp_extract_all(text, F.lit(r"(?m)^([^:\n]{2,12}: .+)$"), 1)
    acting = F.filter(sentences(text), lambda x: F.rlike(x, F.lit(verbs)))
    found = F.when(F.size(numbered) >= 3, numbered).otherwise(F.concat(numbered, colons))
    found = F.when(F.size(found) >= 2, found).otherwise(F.concat(found, acting))
    fit = F.filter(found, lambda x: (F.length(x) >= 12) & ~F.contains(x, F.lit("http")))
    return F.slice(prefix_dedup(F.array_distinct(fit), 15), 1, k)


def extract_examples(text: Column, word: str, most: int = 80, k: int = 3) -> Column:
    """Distinct cuts behind an example word, on one line."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){word}(.{{10,{most}}})"), 1)
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\n+", " ")))), 1, k)


def extract_tags(text: Column, k: int = 7) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"#([\p{L}0-9_]{2,14})"), 1)), 1, k)


def kwic(docs: DataFrame, terms: DataFrame, around: int = 60) -> DataFrame:
    """(doc_id, term, context, sentences): the first hit of each of a lexicon's terms in each document, with its surroundings and their sentences of more than ten code points."""

    def first(text: str, hits: list[tuple[int, str]]) -> list[tuple[str, str]]:
        places = {t: at for at, t in reversed(hits)}
        return [(t, text[max(at - around, 0) : at + len(t) + around]) for t, at in places.items()]

    found = scan_terms(docs, lexicon_terms(terms), first, "term string, context string")
    return found.withColumn("sentences", F.filter(sentences(F.col("context")), lambda x: F.length(x) > 10))


def mechanism_paragraph(text: Column, cause: str, least: int, most: int) -> Column:
    """The first paragraph of fitting length with a causal word; else the first of fitting length; else the first."""
    parts = F.split(text, r"\n+", -1)
    fit = F.filter(parts, lambda x: F.length(x).between(least, most))
    return F.coalesce(F.get(F.filter(fit, lambda x: F.rlike(x, F.lit(cause))), F.lit(0)), F.get(fit, F.lit(0)), F.get(parts, F.lit(0)))


#: Headings: chapters, roman, numbered and twice numbered parts, steps; and bold names.
HEADINGS: tuple[tuple[str, str, int], ...] = (
    ("heading", r"(?m)^(?:Chapter|Part) [0-9]+[:. ]+([^(),\n]{3,40})", 1),
    ("heading", r"(?m)^[IVX]+[.)] +([^(),\n]{3,40})", 1),
    ("heading", r"(?m)^[0-9]+[.)] +([^(),\n0-9][^(),\n]{2,39})", 1),
    ("heading", r"(?m)^[0-9]+\.[0-9]+[. ]+([^(),\n0-9][^(),\n]{2,39})", 1),
    ("heading", r"(?m)^Step [0-9]+[: ]+([^(),\n]{3,40})", 1),
    ("bold", r"\*\*([^*]{3,40})\*\*", 1),
)
#: Words that end the name of a method.
SUFFIXES: tuple[str, ...] = ("model", "law", "principle", "rule", "effect", "analysis", "theory", "thinking")


def name_patterns(suffixes: Sequence[str] = SUFFIXES) -> list[tuple[str, str, int]]:
    """The heading and bold patterns, and one for each suffix."""
    return [*HEADINGS, *(("suffix", rf"([^.,\n]{{2,20}} {s})", 1) for s in suffixes)]


def candidates(docs: DataFrame, patterns: Sequence[tuple[str, str, int]], known: Sequence[str], least: int = 3, most: int = 40) -> DataFrame:
    """(doc_id, type, name): matches of each (type, pattern, group), and known names that occur, these by one automaton."""
    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), F.trim(x).alias("name")))

    arrays = [named(kind, F.regexp_extract_all("text", F.lit(p), g)) for kind, p, g in patterns]
    rows = docs.select("doc_id", F.inline(F.concat(*arrays))) if arrays else None
    if known:
        named_known = scan_terms(docs, sorted({k for k in known if k}), lambda text, hits: [(t,) for t in dict.fromkeys(t for _, t in hits)], "name string")
        named_known = named_known.select("doc_id", F.lit("known").alias("type"), F.trim("name").alias("name"))
        rows = named_known if rows is None else rows.unionByName(named_known)
    return rows.where(F.length("name").between(least, most))
