"""Identities, headers and metadata of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.functions.text import canonical_url, sha256, trim_white
from corploom.operators.lines import IMAGE, META


def id_collisions(rows: DataFrame, id_col: str, locator_col: str) -> DataFrame:
    """Ids given to more than one locator."""
    return rows.groupBy(id_col).agg(F.count_distinct(locator_col).alias("n_locators")).where("n_locators > 1")


def asset_id(source: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("asset_"), F.substring(sha256(F.concat_ws("#", source, ordinal.cast("string"))), 1, 24))


def line_of(text: Column, n: int) -> Column:
    return F.get(F.split(text, "\n", -1), F.lit(n - 1))


def parse_fixed_header(docs: DataFrame) -> DataFrame:
    """doc_id, title, status, author, published_at, location, source_url by fixed line numbers.

    Line 3 is the title, line 6 'status author yyyy-MM-dd HH:mm place', line 8
    '> label: [url](url)', where the shown URL must equal the target. What does
    not match is null.
    """
    link = r"^> [^:]+: \[([^\]]+)\]\(([^)]+)\)$"
    part = lambda n, p, i: F.nullif(F.regexp_extract(F.coalesce(line_of(F.col("text"), n), F.lit("")), p, i), F.lit(""))
    url = F.when(part(8, link, 1) == part(8, link, 2), part(8, link, 2))
    return docs.select("doc_id", F.nullif(trim_white(line_of(F.col("text"), 3)), F.lit("")).alias("title"), part(6, META, 1).alias("status"), part(6, META, 2).alias("author"), part(6, META, 3).alias("published_at"), part(6, META, 4).alias("location"), url.alias("source_url"))


def parse_loose_header(docs: DataFrame, host: str = "example.com") -> DataFrame:
    """doc_id, title, author, status, published_at, location, source_url, review: the first heading, bar-parted line and link.

    A heading is '# x' or a line over '===='. Anything missing marks the row needs_review.
    """
    text = F.col("text")
    title = F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^#{1,3} (.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?m)^(.+)\n={3,}$", 1), F.lit("")))
    bars = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"^[^|｜]+[|｜][^|｜]+[|｜][^|｜]+[|｜][^|｜]+$")))
    parts = F.split(F.get(bars, F.lit(0)), r"\s*[|｜]\s*", -1)
    link = F.regexp_extract(text, r"\]\((https?://" + host.replace(".", r"\.") + r"/[^)#]*)(?:#[^)]*)?\)", 1)
    names = ("author", "status", "published_at", "location")
    found = docs.select("doc_id", title.alias("title"), *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)), F.nullif(link, F.lit("")).alias("source_url"))
    missing = F.lit(False)
    for name in ("title", *names, "source_url"):
        missing = missing | F.col(name).isNull()
    return found.withColumn("review", F.when(missing, "needs_review").otherwise("parsed"))


def extract_images(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal from 1, alt, url) of Markdown images in order."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(IMAGE), 1).alias("alt"), F.regexp_extract_all("text", F.lit(IMAGE), 2).alias("url"))
    rows = docs.select("doc_id", F.posexplode(pairs).alias("ordinal", "i"))
    return rows.select("doc_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("i").getItem("alt").alias("alt"), F.col("i").getItem("url").alias("url"))


def sniff_title(text: Column) -> Column:
    """Of the first eight lines: the first heading, else the first line of more than five code points that isn't a rule or list."""
    head = F.transform(F.slice(F.split(text, "\n", -1), 1, 8), lambda x: F.trim(x))
    headings = F.filter(F.transform(head, lambda x: F.regexp_extract(x, r"^#+[ \t]*(.+)", 1)), lambda x: x != "")
    lines = F.filter(head, lambda x: (F.length(x) > 5) & ~F.rlike(x, F.lit("^[=*-]")))
    return F.coalesce(F.get(headings, F.lit(0)), F.get(lines, F.lit(0)))


def first_url(text: Column, pattern: str = r"https?://[^\s\"')>]+") -> Column:
    """The first match of a URL pattern; null without one."""
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def content_mode(html: Column) -> Column:
    """text without images, mixed with some, image_dominant with little else."""
    images = F.regexp_count(html, F.lit("<img"))
    shown = F.length(F.trim(F.regexp_replace(html, r"<[^>]+>|\s+", "")))
    return F.when(images == 0, "text").when(shown <= 100, "image_dominant").otherwise("mixed")


__all__ = ["asset_id", "canonical_url", "content_mode", "extract_images", "first_url", "id_collisions", "line_of", "parse_fixed_header", "parse_loose_header", "sniff_title"]
