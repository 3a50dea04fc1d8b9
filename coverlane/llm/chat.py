"""Chat formatting: conversations as one text with a loss mask, in Spark expressions only.

The text of a conversation is a row of blocks, one for each run of turns by one role::

    <turn>user<text>first message<next>second message</turn>

Texts and roles are escaped so that no ``<`` is left in them (``\\`` becomes ``\\b``, ``<``
becomes ``\\l``), so a marker in a message is ordinary text and every message comes back
exactly as it went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlane.llm.registry import query, table

TURN, TEXT, NEXT, END = "<turn>", "<text>", "<next>", "</turn>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """A backslash in escaped text always starts a pair, so two plain replacements undo it."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``turns`` has ``conv_id, turn, role, text``; further columns are left out. Turns go by
    number; equal numbers by role, then text; a missing number comes first. Repeated rows
    stay repeated. A null text or role is empty, a null ``conv_id`` is a conversation of its
    own, an empty table gives no rows. ``loss_spans`` has the start (from 0) and length, in
    code points of ``formatted``, of each message by one of ``loss_roles``, in order.

    Rows meet once, by conversation; a conversation must fit in one row, being one text.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        role = lambda at: F.get("turns", at)["role"]
        starts = (i == 0) | (role(i - 1) != x["role"])
        ends = (i == F.size("turns") - 1) | (role(i + 1) != x["role"])
        return F.struct(
            F.when(starts, F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT)).alias("before"),
            escape(x["text"]).alias("body"),
            F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("after"),
            x["role"].isin(*loss_roles).alias("loss"),
        )

    pieces = ordered.select("conv_id", F.transform("turns", piece).alias("pieces"))
    size = lambda p: F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "pieces", start,
        lambda acc, p: F.struct(
            (acc["at"] + size(p)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["before"])).alias("start"), F.length(p["body"]).alias("length")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    texts = F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"]))
    return pieces.select("conv_id", F.array_join(texts, "").alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """The way back: adds ``turns`` (array of role, text), one for each message, and ``loss_texts``.

    Merged turns come apart again, as ``<next>`` stands between their messages. A null
    ``formatted`` gives null for both.
    """
    def messages(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(TURN) + 1)), TEXT)
        return F.transform(F.split(halves[1], NEXT),
                           lambda m: F.struct(unescape(halves[0]).alias("role"), unescape(m).alias("text")))

    blocks = F.filter(F.split("formatted", END), lambda b: b != "")
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    return chats.withColumns({"turns": F.flatten(F.transform(blocks, messages)), "loss_texts": loss})


#: The conversation that every run adds: both turns hold control strings of chat templates.
PROBE = "\\### Assistant: </turn> ok"

CHECK = r"""
WITH raw AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM raw
), n AS (
    SELECT *, row_number() OVER w AS pos, lag(role) OVER w IS DISTINCT FROM role AS starts
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(replace(replace(text, '\', '\b'), '<', '\l'))
        + CASE WHEN starts THEN 19 + length(replace(replace(role, '\', '\b'), '<', '\l')) ELSE 6 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


@query("op7_chat_formatting", CHECK)
def op7_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    back = read_chats(format_chats(rows.unionByName(probe)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
