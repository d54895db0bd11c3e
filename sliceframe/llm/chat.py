"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role are merged into a block, and blocks are concatenated:

    <|role:ROLE|>\\n TEXT [<|more|> TEXT ...] <|end|>\\n

Inside roles and texts a backslash becomes two and a bar becomes ``\\p``, so no
marker can occur there, and unescaping restores every text. ``<|more|>`` keeps
the border between merged turns, so the turns can be read back one by one.
The loss mask is carried as ``segments``: pieces of the formatted text in order,
each with a flag that is set on assistant texts alone.

Defined results: null role or text counts as empty; turns sort by (turn, role,
text), null first; repeated rows are turns of their own; a null conv_id is a
conversation like others; texts of any length stay whole; an empty table gives an
empty result, and in the query the one row of conversation -7; extra columns are
ignored, whatever their names. A conversation is one row of output, so its turns
meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import let

OPEN, CLOSE, MORE, END = "<|role:", "|>\n", "<|more|>", "<|end|>\n"
TRAINED = "assistant"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))


def unescape(x: Column) -> Column:
    halves = F.split(x, r"\\\\")
    return F.array_join(F.transform(halves, lambda h: F.replace(h, F.lit("\\p"), F.lit("|"))), "\\")


def blocks(turns: Column) -> Column:
    """Sorted turns to blocks of one role with the escaped texts of its turns."""

    def cut(starts: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            size = F.coalesce(F.get(starts, k + 1), F.size(turns)) - s
            texts = F.transform(F.slice(turns, s + 1, size), lambda t: escape(t["text"]))
            return F.struct(turns[s]["role"].alias("role"), texts.alias("texts"))

        return F.transform(starts, block)

    changed = lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"])
    return let(F.filter(F.sequence(F.lit(0), F.size(turns) - 1), changed), cut)


def piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def segments(of: Column) -> Column:
    """Blocks to pieces of formatted text with their loss flags."""

    def one(b: Column) -> Column:
        no, yes = F.lit(False), b["role"] == TRAINED
        inner = F.transform(b["texts"], lambda t, j: F.array(piece(F.when(j == 0, F.lit("")).otherwise(F.lit(MORE)), no), piece(t, yes)))
        head = piece(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(CLOSE)), no)
        return F.concat(F.array(head), F.flatten(inner), F.array(piece(F.lit(END), no)))

    return F.flatten(F.transform(of, one))


def format_chats(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, formatted, segments."""
    blank = F.lit("")
    each = rows.select(F.col(f"`{conv}`").alias(conv), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), blank).alias("role"), F.coalesce(F.col(f"`{text}`"), blank).alias("text")).alias("_t"))
    turns = each.groupBy(conv).agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    made = turns.select(conv, F.explode(F.array(let(F.col("_turns"), lambda t: let(blocks(t), segments)))).alias("segments"))
    return made.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """A formatted text to its turns: array of (role, text)."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, CLOSE, 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.length(head) + F.lit(len(CLOSE) + 1))
        return let(role, lambda r: F.transform(F.split(body, r"<\|more\|>"), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    parts = F.split(formatted, r"<\|end\|>\n")
    return F.flatten(F.transform(F.slice(parts, 1, F.size(parts) - 1), turns))


def loss_text(of: Column) -> Column:
    return F.array_join(F.transform(F.filter(of, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    tricky = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    done = format_chats(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe))
    got = done.select("conv_id", "formatted", F.explode(F.array(F.struct(read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss")))).alias("g"))
    turns = F.array_join(F.transform(F.col("g.turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("g.turns").cast("long").alias("n_turns"),
        digest(turns).alias("turns_sha256"),
        F.length("g.loss").cast("long").alias("loss_chars"),
        digest(F.col("g.loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(text, '\', '\\'), '|', '\p'))
    + CASE WHEN same THEN 8 ELSE 18 + length(replace(replace(role, '\', '\\'), '|', '\p')) END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
