"""Line-level cleaning with a byte-exact, hash-checked audit.

A document's lines are an array in its row, with their byte offsets; steps that
need neighbours work on the array, so texts are never shuffled. Steps on tables
of lines, for checks that bring in other tables, use windows over (document,
line), so that consecutive ones share one shuffle by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions.arrays import let, starts
from corploom.functions.text import sha256, trim_blanks
from corploom.session import small


def by_line():
    """Lines of a document in order."""
    return Window.partitionBy("doc_id").orderBy("line")


def before():
    return by_line().rowsBetween(Window.unboundedPreceding, -1)


def after():
    return by_line().rowsBetween(1, Window.unboundedFollowing)


NBSP = "\u00a0"
#: The metadata line of an exported page: status, author, time, place.
META = r"^(\S+) (\S+) ([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}) (\S+)[ \t]*$"
IMAGE = r"!\[([^\]]*)\]\(([^) ]+)[^)]*\)"


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line from 1, text, has_lf, byte_start, byte_end) of physical lines; null and empty texts have none."""
    return docs.select("doc_id", F.inline(line_array(F.col("text"))))


def line_array(text: Column) -> Column:
    """array<struct<line, text, has_lf, byte_start, byte_end>> of a text's physical lines."""

    def lines(parts: Column) -> Column:
        def line(x: Column, i: Column, begin: Column) -> Column:
            fields = ((i + 1).alias("line"), x.alias("text"), (i < F.size(parts) - 1).alias("has_lf"), begin.alias("byte_start"), (begin + F.octet_length(x)).alias("byte_end"))
            return F.struct(*fields)

        begins = starts(F.transform(parts, lambda x: (F.octet_length(x) + 1).cast("long")))
        return let(begins, lambda b: F.transform(parts, lambda x, i: line(x, i, F.get(b, i))))

    # The end after the last LF is no line.
    return F.filter(let(F.split(text, "\n", -1), lines), lambda x: x["has_lf"] | (x["text"] != ""))


def collapse_blanks(lines: Column) -> Column:
    """collapse_blank_runs() of a line_array()."""

    def kept(lines: Column, blank: Column) -> Column:
        later = F.array_position(F.reverse(blank), F.lit(False))  # from the end; 0 if all are blank
        last = F.when(later > 0, F.size(blank) - later).otherwise(-1)
        emptied = F.transform(lines, lambda x, i: F.when(F.get(blank, i), x.withField("text", F.lit(""))).otherwise(x))
        before = lambda i: F.coalesce(F.get(blank, i - 1), F.lit(False))
        return let(last, lambda n: F.filter(emptied, lambda x, i: ~F.get(blank, i) | (~before(i) & (i < n))))

    return let(lines, lambda a: let(F.transform(a, lambda x: is_blank(x["text"])), lambda b: kept(a, b)))


def joined(lines: Column) -> Column:
    """The text of a line_array(): lines in order, each ended by LF; null without lines."""
    return let(lines, lambda a: F.when(F.size(a) > 0, F.concat(F.array_join(F.transform(a, lambda x: x["text"]), "\n"), F.lit("\n"))))


def is_blank(text: Column) -> Column:
    """Whether a line has nothing but blanks, tabs and no-break spaces."""
    return F.btrim(text, F.lit(f" \t{NBSP}")) == ""


def normalize_nbsp(lines: DataFrame) -> DataFrame:
    """No-break spaces become blanks; ``nbsp_changed`` marks lines with other text in which that happened."""
    plain = F.translate("text", NBSP, " ")
    return lines.withColumn("nbsp_changed", (plain != F.col("text")) & ~is_blank(F.col("text"))).withColumn("text", plain)


def collapse_blank_runs(lines: DataFrame) -> DataFrame:
    """Of each run of blank lines one empty line stays; the last run goes."""
    blank = is_blank(F.col("text"))
    first = blank & ~F.coalesce(F.lag("_blank").over(by_line()), F.lit(False))
    more = F.coalesce(F.max((~F.col("_blank")).cast("int")).over(after()), F.lit(0)) == 1
    marked = lines.withColumn("_blank", blank)
    kept = marked.withColumn("_keep", ~F.col("_blank") | (first & more)).where("_keep")
    return kept.withColumn("text", F.when(F.col("_blank"), "").otherwise(F.col("text"))).drop("_blank", "_keep")


def reassemble(lines: DataFrame) -> DataFrame:
    """(doc_id, text): lines in order, each ended by LF."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("doc_id").agg(F.concat(joined, F.lit("\n")).alias("text"))


def duplicate_labels(lines: DataFrame, label: str = "Figure ") -> DataFrame:
    """Lines 'label N' right below image N, or below one empty line under it."""
    shown = F.regexp_extract("text", r"^!\[" + label + r"([0-9]+)\]\(", 1)
    number = F.regexp_extract("text", "^" + label + r"([0-9]+)[ \t]*$", 1)
    one, two = F.lag(shown, 1).over(by_line()), F.lag(shown, 2).over(by_line())
    gap = F.lag(F.col("text") == "", 1).over(by_line())
    hit = (number != "") & ((number == one) | ((number == two) & gap))
    return lines.withColumn("duplicate_label", F.coalesce(hit, F.lit(False)))


def confirmed_removals(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines (with url) whose (url_sha256, line_sha256) is listed go; a pair hit twice in a document makes it ambiguous, unchanged."""
    marked = lines.withColumn("url_sha256", sha256(F.col("url"))).withColumn("line_sha256", sha256(trim_blanks(F.col("text"))))
    listed = pairs.select("url_sha256", "line_sha256").distinct().withColumn("_hit", F.lit(True))
    marked = marked.join(listed, ["url_sha256", "line_sha256"], "left")
    again = F.count("_hit").over(Window.partitionBy("doc_id", "url_sha256", "line_sha256"))
    marked = marked.withColumn("_again", again)
    ambiguous = F.max(F.when(F.col("_hit"), F.col("_again")).otherwise(0)).over(Window.partitionBy("doc_id")) > 1
    marked = marked.withColumn("ambiguous", ambiguous).withColumn("removed", F.coalesce("_hit", F.lit(False)) & ~F.col("ambiguous"))
    return marked.drop("_hit", "_again", "url_sha256", "line_sha256")


def change_ledger(changes: DataFrame) -> DataFrame:
    """One entry per (doc_id, rule_id, kind): line numbers and sha256 of the joined before and after lines.

    ``changes``: doc_id, rule_id, kind (delete, normalize, append_eof), line, before, after (null if deleted).
    """
    def hash_of(name: str) -> Column:
        kept = F.filter(F.array_sort(F.collect_list(F.struct("line", name))), lambda x: x[name].isNotNull())
        return sha256(F.array_join(F.transform(kept, lambda x: x[name]), "\n"))

    grouped = changes.groupBy("doc_id", "rule_id", "kind")
    lines = F.array_sort(F.collect_list("line"))  # those of an added last LF are null and not collected
    return grouped.agg(F.when(F.size(lines) > 0, lines).alias("lines"), hash_of("before").alias("before_sha256"), hash_of("after").alias("after_sha256"))


def span_audit(source: DataFrame, output: DataFrame) -> DataFrame:
    """Of each kept line (same doc_id, line): source and output byte span, line hash, hard break, code points that show."""
    size = F.octet_length("text") + 1
    start = F.coalesce(F.sum(size).over(before()), F.lit(0)).cast("long")
    out = output.select("doc_id", "line", F.col("text").alias("out"), start.alias("out_start"), (start + F.octet_length("text")).alias("out_end"))
    both = source.select("doc_id", "line", "text", "byte_start", "byte_end").join(out, ["doc_id", "line"])
    shown = F.regexp_replace(F.regexp_replace("out", IMAGE, ""), r"[\s\u00a0]+", "")
    return both.select("doc_id", "line", "byte_start", "byte_end", "out_start", "out_end", sha256(F.col("text")).alias("source_sha256"), sha256(F.col("out")).alias("out_sha256"), F.endswith("out", F.lit("  ")).alias("hard_break"), F.length(shown).cast("long").alias("visible"))


def postcheck(source: DataFrame, output: DataFrame) -> DataFrame:
    """(doc_id, ok): kept lines that show equal the source's but for no-break spaces, and images come in the same order."""
    out = output.select("doc_id", "line", F.col("text").alias("out"))
    same = F.translate("text", NBSP, " ") == F.col("out")
    lines = source.select("doc_id", "line", "text").join(out, ["doc_id", "line"], "left")
    images = lambda c: F.regexp_extract_all(c, F.lit(IMAGE), 2)
    order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", images(F.coalesce(c, F.lit(""))).alias("i")))), lambda x: x["i"]))
    ok = F.bool_and(F.when(F.col("out").isNull() | is_blank(F.col("text")), True).otherwise(same)) & (order(F.col("text")) == order(F.col("out")))
    return lines.groupBy("doc_id").agg(ok.alias("ok"))


def revert_failed(docs: DataFrame, cleaned: DataFrame, checks: DataFrame) -> DataFrame:
    """(doc_id, text, reverted): the cleaned text where postcheck() holds, else the document as it was."""
    new = cleaned.select("doc_id", F.col("text").alias("_clean")).join(checks.where("ok").select("doc_id"), "doc_id", "left_semi")
    both = docs.select("doc_id", "text").join(new, "doc_id", "left")
    return both.select("doc_id", F.coalesce("_clean", "text").alias("text"), F.col("_clean").isNull().alias("reverted"))


def match_export(text: Column, css_sha256: str, footers: Sequence[tuple[str, int, int, str]], icon: str = "data:image/svg+xml") -> Column:
    """The first footer whose envelope an exported page has; 'FINGERPRINT_MISMATCH' if none.

    The envelope: twelve lines at least; line 3 the title, line 1 five blanks, the
    title, a blank and a style rule of the known hash; lines 2, 5 and 7 empty, line
    4 of '='; line 6 the metadata and line 8 the link that parse_fixed_header()
    reads. A footer (name, lines, icons, sha256) has that many last lines, joined
    by LF of that hash, and that many icons.
    """

    def found(lines: Column) -> Column:
        line = lambda n: F.get(lines, F.lit(n - 1))
        lead = F.concat(F.lit("     "), line(3), F.lit(" "))
        css = F.substr(line(1), F.length(lead) + 1)
        link = r"^> [^:]+: \[([^\]]+)\]\(([^)]+)\)$"
        envelope = (F.size(lines) >= 12) & (line(3) != "") & (line(2) == "") & F.rlike(line(4), F.lit("^=+$")) & (line(5) == "") & (line(7) == "")
        envelope = envelope & F.startswith(line(1), lead) & (sha256(css) == css_sha256) & F.rlike(line(6), F.lit(META)) & (F.regexp_extract(line(8), link, 1) == F.regexp_extract(line(8), link, 2)) & (F.regexp_extract(line(8), link, 1) != "")
        names = []
        for name, n, icons, digest in footers:
            tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")
            hit = envelope & (F.size(lines) >= n) & ((F.length(tail) - F.length(F.replace(tail, F.lit(icon), F.lit("")))) == icons * len(icon)) & (sha256(tail) == digest)
            names.append(F.when(hit, name))
        return F.coalesce(*names, F.lit("FINGERPRINT_MISMATCH"))

    return let(F.transform(line_array(text), lambda x: x["text"]), found)


def match_template(lines: DataFrame, templates: DataFrame, tail: int = 4) -> DataFrame:
    """(doc_id, template): the template whose hash the last lines have; 'FINGERPRINT_MISMATCH' if none.

    ``templates``: name, sha256 of the last ``tail`` lines joined by LF; the first by place (``ord``) wins.
    """
    ends = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    last = F.slice("l", F.greatest(F.size("l") - tail + 1, F.lit(1)), tail)
    ends = ends.select("doc_id", sha256(F.array_join(F.transform(last, lambda x: x["text"]), "\n")).alias("sha256"))
    named = ends.join(templates, "sha256", "left").groupBy("doc_id").agg(F.min_by("name", "ord").alias("template"))
    return named.select("doc_id", F.coalesce("template", F.lit("FINGERPRINT_MISMATCH")).alias("template"))


def drop_preamble(text: Column) -> Column:
    """What stands before the first heading ('# x', or a line of eight code points or more over '===') goes; without one, nothing."""
    return F.regexp_replace(text, r"(?s)\A.*?\n(?=#{1,3}\s|[^\n]{8,}\n={3,})", "")


def strip_boilerplate(text: Column, patterns: Sequence[str]) -> Column:
    """Whole lines that hit a pattern go; runs of four and more LF become three; blanks at the ends go."""
    keep = F.filter(F.split(text, "\n", -1), lambda x: ~F.rlike(x, F.lit("|".join(f"(?:{p})" for p in patterns))))
    return F.btrim(F.regexp_replace(F.array_join(keep, "\n"), r"\n{4,}", "\n\n\n"), F.lit(" \t\n"))


def clean_card(html: Column) -> Column:
    """Text of a card: images, tags, style rules and URLs go; white space is squeezed."""
    plain = F.regexp_replace(html, r"(?i)<(script|style)[^>]*>[^<]*</(script|style)>", " ")
    for pattern in (r"<[^>]+>", IMAGE, r"https?://[^ )]+", r"[a-z.*]+\{[^}]*\}"):
        plain = F.regexp_replace(plain, pattern, " ")
    return F.trim(F.regexp_replace(plain, r"[ \t\n]+", " "))


def clean_book(html: Column, rights: str = "all rights reserved") -> Column:
    """Tags become blanks, one-character lines are joined, rights lines go, blank lines are squeezed."""
    plain = F.regexp_replace(html, "<[^>]+>", " ")
    plain = F.array_join(F.filter(F.split(plain, "\n", -1), lambda x: ~F.contains(F.lower(x), F.lit(rights))), "\n")
    plain = F.regexp_replace(plain, r"(?m)^([^\n])\n(?=[^\n]\n)", "$1")
    return F.trim(F.regexp_replace(plain, r"\n{3,}", "\n\n"))


def strip_documents(docs: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """``docs`` with strip_boilerplate() of its text, done once a row: Spark moves no later filter below an explode()."""
    return docs.withColumn("text", F.explode(F.array(strip_boilerplate(F.col("text"), patterns))))


def doc_gate(docs: DataFrame, least: int = 120, script: str = "[A-Za-z]", least_of_script: int = 0) -> DataFrame:
    """Documents of at least so many code points, and so many of a script."""
    kept = docs.where(F.length("text") >= least)
    return kept.where(F.regexp_count("text", F.lit(script)) >= least_of_script) if least_of_script else kept


def eligibility(text: Column, mode: Column, modes: Sequence[str] = ("strict", "loose"), configured: Column | None = None) -> Column:
    """The first warning that applies; null if the document may be cleaned. ``text`` is binary; ``configured`` tells whether its rules are valid."""
    plain = F.try_validate_utf8(text.cast("string"))
    return (
        F.when(plain.isNull(), "INVALID_UTF8")
        .when(~mode.isin(*modes) | mode.isNull(), "BAD_MODE")
        .when(F.lit(False) if configured is None else ~F.coalesce(configured, F.lit(False)), "BAD_CONFIG")
        .when(F.contains(plain, F.lit("\r")), "HAS_CR")
        .when((mode == "strict") & ~F.endswith(plain, F.lit("\n")), "NO_FINAL_LF")
    )


def verify_audit(spans: DataFrame, retained: DataFrame) -> DataFrame:
    """Violations (rule, doc_id, start, end): spans of a document that are out of order, or in no retained span.

    Both: doc_id, start, end (half open). One sweep over both tables by start: a
    span lies in a retained one if the largest end of those that have begun isn't
    before its own, so no span meets more than its neighbours. A null bound is in
    no span; repeated spans overlap.
    """
    kinds = (retained.select("doc_id", "start", "end", F.lit(0).alias("_kind")), spans.select("doc_id", "start", "end", F.lit(1).alias("_kind")))
    order = Window.partitionBy("doc_id").orderBy("start", "_kind", "end")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    held, before = (F.max(F.when((F.col("_kind") == k) & F.col("start").isNotNull(), F.col("end"))).over(upto) for k in (0, 1))
    swept = kinds[0].unionByName(kinds[1]).withColumns({"_held": held, "_before": before}).where("_kind = 1")
    rules = F.array(F.when((F.col("start") < F.col("_before")) | (F.col("end") < F.col("start")), "SPAN_ORDER"), F.when(~F.coalesce(F.col("end") <= F.col("_held"), F.lit(False)), "SPAN_OUTSIDE"))
    return swept.select(F.explode(F.array_compact(rules)).alias("rule"), "doc_id", "start", "end")


def verify_spans(audit: DataFrame, source: DataFrame, output: DataFrame) -> DataFrame:
    """Violations (rule, doc_id, line) of a span_audit() against both texts: bounds, hashes of bytes, hard breaks and what shows, all computed anew.

    ``source`` and ``output``: doc_id, text.
    """
    texts = source.select("doc_id", F.encode("text", "UTF-8").alias("_raw")).join(output.select("doc_id", F.encode("text", "UTF-8").alias("_out")), "doc_id", "full_outer")
    part = lambda c, a, b: F.substring(c, F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))
    raw, out = part("_raw", "byte_start", "byte_end"), part("_out", "out_start", "out_end")
    shown = F.length(F.regexp_replace(F.regexp_replace(out.cast("string"), IMAGE, ""), r"[\s\u00a0]+", ""))
    inside = lambda a, b, c: F.coalesce((F.col(a) >= 0) & (F.col(a) <= F.col(b)) & (F.col(b) <= F.octet_length(c)), F.lit(False))
    checks = F.array(
        F.when(~inside("byte_start", "byte_end", "_raw") | ~inside("out_start", "out_end", "_out"), "BOUNDS"),
        F.when(~F.sha2(raw, 256).eqNullSafe(F.col("source_sha256")), "SOURCE_HASH"),
        F.when(~F.sha2(out, 256).eqNullSafe(F.col("out_sha256")), "OUTPUT_HASH"),
        F.when(~F.endswith(out.cast("string"), F.lit("  ")).eqNullSafe(F.col("hard_break")), "HARD_BREAK"),
        F.when(~shown.cast("long").eqNullSafe(F.col("visible")), "VISIBLE"),
    )
    joined_ = audit.join(texts, "doc_id", "left")
    return joined_.select("doc_id", "line", F.explode(F.array_compact(checks)).alias("rule")).select("rule", "doc_id", "line")


def overlaps(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end; half open) that begin before an earlier one of their document ends."""
    order = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_end", F.max("end").over(order)).where("start < _end").drop("_end")


#: sha256 of no text and of one LF.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
LF_SHA256 = "01ba4719c80b6fe911b091a7c05124b64eeece964e09c058ef8f9805daca546b"


def verify_changes(ledger: DataFrame, kinds: DataFrame) -> DataFrame:
    """Violations (rule, doc_id, rule_id) of a ledger: unknown rule or kind, lines not increasing, deleted lines not in one run, hashes that their kind rules out.

    ``kinds``: rule_id, kind. Deleted lines leave nothing; an added last LF has no
    lines, nothing before and an LF after.
    """
    known = kinds.select("rule_id", F.col("kind").alias("_kind"))
    rows = ledger.join(small(known), "rule_id", "left")
    steps = F.zip_with(F.slice("lines", 2, 1 << 30), F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))), lambda b, a: b - a)
    checks = F.array(
        F.when(F.col("_kind").isNull() | (F.col("_kind") != F.col("kind")), "KIND"),
        F.when(F.exists(steps, lambda d: d <= 0), "LINES_NOT_INCREASING"),
        F.when((F.col("kind") == "delete") & F.exists(steps, lambda d: d > 1), "DELETE_NOT_CONTIGUOUS"),
        F.when((F.col("kind") == "delete") & (F.col("after_sha256") != EMPTY_SHA256), "DELETE_LEAVES_TEXT"),
        F.when((F.col("kind") == "append_eof") & (F.col("lines").isNotNull() | (F.col("before_sha256") != EMPTY_SHA256) | (F.col("after_sha256") != LF_SHA256)), "EOF"),
        F.when((F.col("kind") != "append_eof") & (F.coalesce(F.size("lines"), F.lit(0)) < 1), "NO_LINES"),
    )
    return rows.select(F.explode(F.array_compact(checks)).alias("rule"), "doc_id", "rule_id")
