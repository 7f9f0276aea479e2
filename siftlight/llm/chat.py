r"""Chat formatting: every assistant turn becomes an example with all turns before it as context.

Built-in DataFrame functions only. A turn is rendered as ``<s>[role]text</s>``; inside role and text ``\``, ``<``,
``[`` and ``]`` are written ``\\``, ``\l``, ``\b`` and ``\e``, so no text can contain a control string and the
rendering can be undone. Only the target reply is trainable: its span (code points) is ``loss_start``/``loss_chars``.
Turns that no reply follows are kept in one example without a trainable span.

Defined results: null text or role is empty; turns with equal numbers are ordered by role, then text; repeated rows
are repeated turns; null turn numbers come first; rows without a conversation id form one conversation of their own;
an empty table gives no examples; other columns are not read. One example is one string, so a conversation is the
unit of work, and its examples hold each prefix once (quadratic in its own turns, linear in conversations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>[", "]", "</s>"
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    for raw, shown in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def unescape(text: Column) -> Column:
    """Between doubled backslashes every other escape stands alone."""

    def single(part: Column) -> Column:
        for raw, shown in ESCAPES[1:]:
            part = F.replace(part, F.lit(shown), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), single), "\\")


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position of the target turn (from 1), formatted text, loss_start, loss_chars (null: nothing trainable)."""
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    c = c.select(
        "conv_id",
        F.transform("turns", lambda x: x["role"] == ASSISTANT).alias("is_reply"),
        F.transform("turns", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"))).alias("turns"),
    )
    c = c.select("conv_id", "is_reply", "turns", F.transform("turns", lambda x: F.concat(F.lit(TURN_OPEN), x["role"], F.lit(ROLE_CLOSE), x["text"], F.lit(TURN_CLOSE))).alias("shown"))
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("is_reply", i) | (i == F.size("turns")))
    e = c.select("conv_id", "is_reply", "turns", "shown", F.explode(at).alias("position"))
    e = e.select(
        "conv_id", "position",
        F.array_join(F.slice("shown", F.lit(1), F.col("position")), "").alias("formatted"),
        F.when(F.element_at("is_reply", F.col("position")), F.char_length(F.element_at("turns", F.col("position"))["text"])).alias("loss_chars"),
    )
    return e.select("conv_id", "position", "formatted", (F.char_length("formatted") - len(TURN_CLOSE) - F.col("loss_chars")).alias("loss_start"), "loss_chars")


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped."""
    parts = F.split(formatted, TURN_CLOSE)
    inner = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(TURN_OPEN) + 1)))
    return F.transform(inner, lambda p: F.struct(
        unescape(F.substring_index(p, ROLE_CLOSE, 1)).alias("role"),
        unescape(F.substr(p, F.char_length(F.substring_index(p, ROLE_CLOSE, 1)) + 2)).alias("text"),
    ))


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, start + 1, chars))


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    e = examples(rows.unionByName(extra))
    e = e.select("*", trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("trained"))
    g = e.groupBy("conv_id").agg(
        F.max_by("formatted", "position").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "trained"))), lambda x: x["trained"]), "").alias("trained"),
        F.sum(F.char_length("formatted")).cast("bigint").alias("formatted_chars"),
    )
    g = g.select("conv_id", "trained", "formatted_chars", parsed(F.col("whole")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return g.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("trained").cast("bigint").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )


QUERIES = {"op6_chat_formatting": op6_chat_formatting}
ORACLE = {
    "op6_chat_formatting": r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
   sum(9 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g'))) OVER w AS upto
   FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id""",
}
