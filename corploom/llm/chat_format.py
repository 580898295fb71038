"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only that reply under the loss mask. A turn is written as

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

Control strings inside a text (this template's and those of other common ones)
get a backslash after their first character, one more if they already have some,
so the text never opens or closes a turn and can be read back unchanged. Roles
are URL-encoded. Turns after the last reply, or a conversation without one, give
one more row with nothing under the mask, so no turn is lost. Built-in column
functions do all of it: one shuffle, by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
#: A control string: its first character, backslashes added so far, the rest.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/SYS>>|unk>|pad>)"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\]|</?SYS>>|/SYS>>|unk>|pad>)"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def prefix_target_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per assistant turn, and per conversation that doesn't end in one: conv_id, example, n_turns, text, loss_start, loss_end.

    text is the context and the reply; the reply's text lies in the code points
    loss_start .. loss_end - 1 (equal: nothing to train on). example counts from
    0 within the conversation. Turns are ordered by turn, then role and text; a
    null turn comes first; repeated rows are turns too. Null texts and roles
    count as empty; null ids form one conversation. An example is one row, so a
    conversation must fit one; examples of a conversation of n turns hold its
    text up to n times, which is what the expansion asks for. No rows give
    none. Other columns are not read.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    lead = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
    body = escape(text)
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("raw"), F.concat(lead, body, F.lit(END + "\n")).alias("shown"), F.length(lead).alias("before"), F.length(body).alias("size"))
    whole = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == TRAINED) | (i == F.size("turns")))
    rows = whole.select("conv_id", "turns", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("turns", F.col("n_turns"))
    rows = rows.select("conv_id", "example", "n_turns", F.array_join(F.transform(F.slice("turns", 1, F.col("n_turns")), lambda t: t["shown"]), "").alias("text"), last.alias("last"))
    trained = F.col("last.role") == TRAINED
    at = F.length("text") - F.length("last.shown") + F.col("last.before")
    at = F.when(trained, at).otherwise(F.length("text"))
    return rows.select("conv_id", "example", "n_turns", "text", at.cast("int").alias("loss_start"), (at + F.when(trained, F.col("last.size")).otherwise(0)).cast("int").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> read back from an example's text."""
    shown = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda t: t != "")
    return F.transform(
        shown,
        lambda t: F.struct(
            F.url_decode(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(t, F.locate("\n", t) + 1)).alias("text"),
        ),
    )


def trained_text(text: str = "text", start: str = "loss_start", end: str = "loss_end") -> Column:
    """The reply under the loss mask, as it was before escaping."""
    return unescape(F.substr(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 made of control strings, read back from the examples."""
    probe = F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in enumerate(("user", TRAINED)))))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.range(1).select(probe.alias("t")).select("t.*"))
    examples = prefix_target_examples(turns)
    replies = F.array_sort(F.collect_list(F.struct("example", trained_text().alias("text"))))
    per_conv = examples.groupBy("conv_id").agg(F.max_by("text", "example").alias("longest"), replies.alias("replies"), F.sum(F.length("text")).alias("formatted_chars"))
    read = per_conv.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("replies", lambda r: r["text"]), "").alias("loss"), "formatted_chars")
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = {
    "op1_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (
            SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                   length(role) + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/SYS>>|unk>|pad>)', '\1\\\2\3', 'g')) + 24 AS shown
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        p AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
        SELECT conv_id, max(n) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
        FROM p GROUP BY conv_id
    """
}
