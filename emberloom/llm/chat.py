"""Chat formatting from event logs, with DataFrame functions only.

A log has events of messages: ``start`` and ``delta`` add text, ``edit``
replaces it, ``regenerate`` empties it (and adds its own text), ``delete``
takes the message away. Events are folded per message in sequence order, and the
messages stand in the order of their first event.

A conversation of ``LONG`` events at most is dealt to one task by its id, and is
folded and rendered there without another exchange. A longer one is dealt by
message, rendered in blocks of ``BLOCK`` places, and its blocks are joined, so
that it is worked on in many tasks before its one row is made. Which ones are
long is counted first; their list is broadcast only up to ``LISTED`` ids.

Template: ``<s>``, then ``[INST role]text</s>`` for each message. Texts and
roles have ``&``, ``<``, ``[`` and ``]`` written as ``&amp;``, ``&lt;``,
``&lb;`` and ``&rb;``, so that no control string can stand inside a text.

Defined results: null text and role are empty; rows of the same turn stay
separate turns, ordered by role and text; events of equal sequence number stand
in the order of op, role and text, and an edit or regeneration counts with what
stands behind it; repeated events count each; a null conversation id is a
conversation, a null message id one message of it; null turns and sequence
numbers come first; texts of any length stay whole; other columns are ignored,
whatever their names; an empty table gives no conversation, nor does one of
which all messages are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Events up to which a conversation stays in one task, and long ones whose list is broadcast.
LONG = 2_048
LISTED = 50_000
#: Places of a long conversation that are rendered in one task.
BLOCK = 256
#: What is escaped, the sign of escapes first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;")]
BEGIN, TURN, TURN_END, END = "<s>", "[INST ", "]", "</s>"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, seq, op, role, text) events -> (conv_id, place, role, text) messages.

    place is the sequence number of a message's first event; the role is that
    of its first event that has one.
    """
    events = events.select("conv_id", "message_id", "seq", "op", "role", "text")
    reset = F.col("op").isin("edit", "regenerate")
    each = events.groupBy("conv_id", "message_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "op", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("events"),
        F.max(F.when(reset, F.struct("seq", "op"))).alias("reset"),
        F.min("seq").alias("place"),
        F.max(F.when(F.col("op") == "delete", True)).alias("gone"),
    )
    last = F.col("reset")
    live = F.filter("events", lambda e: last.isNull() | (F.struct(e["seq"], e["op"]) >= last))
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    return each.where(F.col("gone").isNull()).select(
        "conv_id",
        "place",
        F.try_element_at(F.transform(roles, lambda e: e["role"]), F.lit(1)).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def events_of_rows(rows: DataFrame) -> DataFrame:
    """Each (conv_id, turn, role, text) row as a message of one event."""
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.monotonically_increasing_id().alias("message_id"),
        F.col("turn").cast("bigint").alias("seq"),
        F.lit("start").alias("op"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )


def conversations(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """render(fold(events)), with the events of all but long conversations dealt once, by conversation."""
    n = events.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select(F.col("conv_id").alias("long_id"))
    long = materialise(n, "long")
    listed = F.broadcast(long) if long.count() <= LISTED else long
    same = events["conv_id"].eqNullSafe(listed["long_id"])
    short = events.join(listed, same, "left_anti").repartition("conv_id")
    return render(fold(short), trained).unionByName(render(fold(events.join(listed, same, "left_semi")), trained))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, n_messages, formatted, loss_spans (start, length: code points of trained texts)."""
    text, role = escape(F.coalesce("text", F.lit(""))), escape(F.coalesce("role", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(TURN_END))
    pieces = messages.select(
        "conv_id",
        F.floor(F.col("place") / BLOCK).alias("block"),
        F.struct(
            F.col("place"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.concat(head, text, F.lit(END)).alias("piece"),
            F.length(head).alias("skip"),
            F.length(text).alias("size"),
        ).alias("m"),
    )
    blocks = pieces.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    walk = F.aggregate(
        "ms",
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["piece"])).alias("at"),
            F.when(
                m["role"] == trained,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["skip"]).alias("start"), m["size"].cast("bigint").alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    drawn = blocks.select(
        "conv_id",
        F.struct(
            F.coalesce("block", F.lit(-(2**62))).alias("block"),
            F.array_join(F.transform("ms", lambda m: m["piece"]), "").alias("text"),
            F.size("ms").cast("bigint").alias("n"),
            walk.alias("walk"),
        ).alias("b"),
    )
    whole = drawn.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    moved = F.aggregate(
        "bs",
        F.struct(F.lit(len(BEGIN)).cast("bigint").alias("at"), F.array().cast("array<array<struct<start:bigint,length:bigint>>>").alias("spans")),
        lambda acc, b: F.struct(
            (acc["at"] + b["walk"]["at"]).alias("at"),
            F.concat(
                acc["spans"],
                F.array(F.transform(b["walk"]["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length")))),
            ).alias("spans"),
        ),
    )
    return whole.select(
        "conv_id",
        F.aggregate("bs", F.lit(0).cast("bigint"), lambda n, b: n + b["n"]).alias("n_messages"),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("bs", lambda b: b["text"]), "")).alias("formatted"),
        F.flatten(moved["spans"]).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The messages of a formatted conversation: array of (role, text), unescaped."""
    parts = F.filter(F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substr(p, F.lit(len(TURN) + 1), F.instr(p, TURN_END) - len(TURN) - 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, TURN_END) + 1)).alias("text"),
        ),
    )


def digest(rendered: DataFrame) -> DataFrame:
    """The contract's columns, read back from formatted and loss_spans."""
    turns = rendered.withColumn("turns", read_back(F.col("formatted"))).withColumn(
        "loss",
        F.array_join(
            F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
        ),
    )
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;') AS er,
    replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(3 + sum(6 + length(er) + 1 + length(et) + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
