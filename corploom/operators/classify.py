"""Classification by a taxonomy and scoring by rubrics: sums of CASE expressions, no join, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(text: Column, taxonomy, title_weight: int = 3, most: int = 800, default: str = "00") -> Column:
    """The chapter with the most weight in the first ``most`` code points, ties by place; ``default`` without a hit.

    A tag that occurs weighs 1, a title word ``title_weight``. The taxonomy is a literal of bounded size.
    """
    head = F.lower(F.substring(text, 1, most))
    weigh = lambda words, w: [F.when(F.contains(head, F.lit(x.lower())), w).otherwise(0) for x in words]
    scores = [(sum(weigh(titles, title_weight) + weigh(tags, 1), F.lit(0)), -place, chapter) for chapter, place, titles, tags in taxonomy]
    best = F.greatest(*(F.struct(s.alias("s"), F.lit(p).alias("p"), F.lit(c).alias("c")) for s, p, c in scores))
    return F.when(best["s"] > 0, best["c"]).otherwise(default)


def score(rules: Sequence[tuple[Column, int]], most: int) -> Column:
    """Points of the rules that hold, ``most`` at most."""
    return F.least(sum((F.when(rule, points).otherwise(0) for rule, points in rules), F.lit(0)), F.lit(most))


def is_shell(prompt: Column, name: Column, protocol: str) -> Column:
    """Short, or little but its name, or without a protocol word."""
    bare = F.when(name == "", prompt).otherwise(F.replace(prompt, name, F.lit("")))
    return (F.length(prompt) < 100) | (F.length(bare) < 40) | ~F.rlike(prompt, F.lit(protocol))


def is_generic(prompt: Column, layer: str, stock: Sequence[str]) -> Column:
    """The layer is missing or says only stock phrases."""
    said = F.trim(F.regexp_extract(prompt, rf"(?s)\[{layer}\](.*?)(?:\[|\z)", 1))
    return (said == "") | said.isin(*stock)


def fidelity(prompt: Column, name: Column, protocol: str, gate: str, layers: Sequence[str] = ("mode", "protocol", "gate", "format")) -> Column:
    """struct<value, reasons>: 0 .. 100 in tens for the length (2 or 1), a protocol word (3), a gate word (2), the name at most three times (1) and all layers (2).

    Protocol and gate are looked for in what is left without the name and the
    rest of its sentence. A reason says what was met (+), nearly (~) or not (-);
    a prompt of fewer than 50 code points has value 0 and the reason 'short'.
    """
    n = F.length(prompt)
    named = F.coalesce(name, F.lit("")) != ""
    bare = F.when(named, F.regexp_replace(F.replace(prompt, name, F.lit("\x01")), "\x01[^.\n]*", "")).otherwise(prompt)
    times = F.when(named, (n - F.length(F.replace(prompt, name, F.lit("")))) / F.length(name)).otherwise(0)
    every = F.lit(True)
    for layer in layers:
        every = every & F.contains(prompt, F.lit(f"[{layer}]"))
    rules = [("protocol", F.rlike(bare, F.lit(protocol)), 3), ("gate", F.rlike(bare, F.lit(gate)), 2), ("name", times <= 3, 1), ("layers", every, 2)]
    points = F.when(n >= 150, 2).when(n >= 100, 1).otherwise(0)
    reasons = [F.when(n >= 150, "+length").when(n >= 100, "~length").otherwise("-length")]
    for label, met, worth in rules:
        points = points + F.when(met, worth).otherwise(0)
        reasons.append(F.concat(F.when(met, "+").otherwise("-"), F.lit(label)))
    short = n < 50
    return F.struct(F.when(short, 0).otherwise(points * 10).cast("int").alias("value"), F.when(short, F.array(F.lit("short"))).otherwise(F.array(*reasons)).alias("reasons"))


def signature_terms(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)))


def quality_bands(n: Column, high: int, middle: int) -> Column:
    """5, 4 or 3 by size, then ceil(q / 5 * 3 + 2)."""
    q = F.when(n >= high, 4).when(n >= middle, 3).otherwise(2)
    return F.ceil(q * 3 / 5 + 2).cast("int")
