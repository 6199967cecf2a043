"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is under the loss. The template writes a turn as
``### role: text</turn>\\n``; control strings inside texts and roles are escaped
reversibly (a backslash is doubled, ``</turn>`` becomes ``\\e``, ``### `` becomes
``\\h`` and, in roles, a colon becomes ``\\c``).

Edge cases: a null text or role counts as empty; turns are ordered by
(turn, role, text), so ties and repeated rows have one order; a conversation
whose last turn is no assistant's gets one more example without a target, so
that no text is lost; a null conv_id is a conversation of its own; an empty
table gives no example; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import read

END = "</turn>"
HEAD = "### "


def escape(text: Column, role: bool = False) -> Column:
    """``text`` without a control string; :func:`unescape` undoes it."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit(END), F.lit("\\e")), F.lit(HEAD), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """What was given to :func:`escape`: doubled backslashes part the text, so those left begin a code."""

    def codes(part: Column) -> Column:
        for code, string in (("\\e", END), ("\\h", HEAD), ("\\c", ":")):
            part = F.replace(part, F.lit(code), F.lit(string))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), codes), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per training example of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, example (from 0), n_turns (turns that the example holds),
    formatted (the whole text), loss_start and loss_end (code points of
    ``formatted`` under the loss; null where the example has no target).
    A conversation is one record of the output, so it is gathered in one row; the
    exchange on conv_id is the only one.
    """
    part = F.struct(
        F.col("turn"),
        F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(": ")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("parts")),
        lambda i: (F.get("parts", i - 1)["role"] == F.lit("assistant")) | (i == F.size("parts")),
    )
    row = whole.select("conv_id", "parts", F.posexplode(ends).alias("example", "n_turns"))
    last = F.get("parts", F.col("n_turns") - 1)
    text = lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("n_turns") - 1), text), "")
    row = row.select(
        "conv_id",
        "example",
        "n_turns",
        last["role"].alias("role"),
        F.concat(context, last["head"]).alias("prompt"),
        last["body"].alias("reply"),
    )
    target = F.col("role") == "assistant"
    return row.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("prompt", "reply", F.lit(END + "\n")).alias("formatted"),
        F.when(target, F.length("prompt")).alias("loss_start"),
        F.when(target, F.length("prompt") + F.length("reply")).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """A row per conversation, read from the formatted texts alone.

    The longest example gives the turns; the spans under the loss give the
    assistant's texts in order.
    """
    span = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    by = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", F.coalesce(unescape(span), F.lit("")).alias("text")))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    lines = F.filter(F.split("whole", f"{END}\n", -1), lambda s: s != "")
    turns = F.transform(
        lines,
        lambda s: F.struct(
            unescape(F.regexp_extract(s, r"(?s)^### ([^:]*): ", 1)).alias("role"),
            unescape(F.regexp_replace(s, r"(?s)^### [^:]*: ", "")).alias("text"),
        ),
    )
    return by.select("conv_id", turns.alias("turns"), F.array_join("replies.text", "").alias("loss_text"), "formatted_chars")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every formatted conversation, and of conversation -7."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.sql("SELECT -7L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = turns.unionByName(planted.withColumn("text", F.lit(said)))
    back = read_back(format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    4 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '### ', '\h'), ':', '\c')) + 2
      + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '### ', '\h')) + 8 AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
