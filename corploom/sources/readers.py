"""Sources: corpora, JSON documents, strict JSONL, JSON arrays, taxonomies, markup and published runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_corpus(spark: SparkSession, folder: str, suffix: str = ".txt", exclude: Sequence[str] = ()) -> DataFrame:
    """(file, text) of whole files with the suffix whose path below the folder has none of the excluded words."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}").select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    below = F.substring_index("_path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    for word in exclude:
        files = files.where(~F.contains(below, F.lit(word)))
    return files.select("file", "text")


def scan_json_docs(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): one JSON object per file; bad has the files that don't parse."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    row = F.from_json("value", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    docs = files.select("file", row.alias("row"))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return docs.where(~bad).select("row.*", "file").drop("_corrupt"), docs.where(bad).select("file")


def jsonl_lines(files: DataFrame, schema: str) -> DataFrame:
    """(file, line_no, row, code): parsed lines of (file, text); code names what is wrong with a line, null if nothing.

    Each file ends with LF, no line is empty, each is a JSON object of the schema.
    """
    parts = F.split("text", "\n", -1)
    lines = files.select("file", F.size(parts).alias("_n"), F.posexplode(parts).alias("i", "line"))
    last = F.col("i") == F.col("_n") - 1
    lines = lines.where(~(last & (F.col("line") == "")))
    parsed = F.from_json("line", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    code = F.when(last, "NO_FINAL_LF").when(F.col("line") == "", "EMPTY_LINE").when(F.col("row").isNull() | F.col("row._corrupt").isNotNull(), "BAD_JSON")
    return lines.withColumn("row", parsed).select("file", (F.col("i") + 1).alias("line_no"), "row", code.alias("code"))


def scan_json_array(text: DataFrame, element: str, ok: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(columns kept, index, entry, accepted): entries of a JSON array column ``text``; ``ok`` is a condition on ``entry``."""
    rows = text.select(*keep, F.posexplode(F.from_json("text", f"array<struct<{element}>>")).alias("index", "entry"))
    return rows.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def load_taxonomy(text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chapters, tags, subchapters) of one taxonomy document in JSON."""
    schema = "chapters array<struct<id string, order int, title string, allowed_tags array<string>, subchapters array<struct<id string, order int, title string>>>>"
    chapters = text.select(F.inline(F.from_json("text", schema)["chapters"]))
    parts = chapters.select(F.col("id").alias("chapter_id"), F.inline("subchapters")).select("chapter_id", "id", "order", "title")
    return chapters.select("id", "order", "title"), chapters.select("id", F.explode("allowed_tags").alias("tag")), parts


def extract_markup_text(pages: DataFrame, by: str, order: str, least: int = 100) -> DataFrame:
    """(by, text): style and script blocks go, tags become blanks, white space is squeezed; long parts joined in order."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(style|script)[^>]*>.*?</\1>", ""), "<[^>]+>", " ")
    parts = pages.select(by, order, F.trim(F.regexp_replace(plain, r"[ \t\n]+", " ")).alias("part")).where(F.length("part") > least)
    return parts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda x: x["part"]), "\n---\n").alias("text"))
