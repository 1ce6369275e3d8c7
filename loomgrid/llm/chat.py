r"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log of events (conv_id, message_id, seq, kind, role, text) is partitioned by conversation and sorted by ``seq``.
``delta`` appends; ``edit`` replaces the message's text; ``regenerate`` does so too and drops the messages begun between
the message and it (the abandoned branch). The fold is per message first, so the text of one conversation meets only as
its finished messages. Rendering: ``<|role|>`` text ``<|end|>`` newline; inside roles and texts ``\`` becomes ``\b``,
``<`` becomes ``\l`` and, in roles, ``|`` becomes ``\p``, so no control string can appear in them, and each escape is undone by the reverse replacements.

Defined results: null text is empty, null role is the empty role; rows that tie in ``turn`` are ordered by role, then
text, and repeated rows are turns of their own; a null conv_id is one conversation; an empty log gives no rows. A
conversation's rendering is one string, so it is bounded by the size of a string cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hex_sha256, let, table

END = "<|end|>\n"
PLANTED = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: (conv_id, message_id, first_seq, role, text)."""
    resets = F.col("kind").isin("edit", "regenerate")
    piece = F.struct("seq", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first_seq"),
        F.min_by(F.coalesce(F.col("role"), F.lit("")), F.when(F.col("kind") == "start", F.col("seq"))).alias("role"),
        F.max(F.when(resets, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.sort_array(F.collect_list(piece)).alias("pieces"),
    )
    live = F.filter("pieces", lambda p: F.coalesce(p["seq"] >= F.col("reset"), F.lit(True)))
    before = Window.partitionBy("conv_id").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        folded.withColumn("cut", F.max("regenerated").over(before))
        .where(F.col("cut").isNull() | (F.col("cut") < F.col("first_seq")))
        .select("conv_id", "message_id", "first_seq", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss): ``loss`` has, for each turn, where in its rendering the text to learn starts and how long it is (0: none)."""
    head = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>"))
    body = escape(F.col("text"))
    turn = F.struct(
        "first_seq",
        F.concat(head, body, F.lit(END)).alias("text"),
        F.struct(F.length(head).cast("long").alias("start"), F.when(F.col("role").isin(*learn), F.length(body)).otherwise(0).cast("long").alias("length")).alias("loss"),
    )
    return (
        messages.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), F.transform("turns", lambda t: t["loss"]).alias("loss"))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learned): role and text of each turn, and the texts under the loss mask, from the rendering alone."""
    chunks = F.slice(F.split("formatted", r"<\|end\|>\n"), 1, F.size("loss"))

    def parsed(c: Column) -> Column:
        at = F.locate("|>", c)
        return F.struct(unescape(F.substring(c, F.lit(3), at - 3)).alias("role"), unescape(F.substr(c, at + 2)).alias("text"))

    return formatted.select("*", chunks.alias("chunks")).select(
        "conv_id", "formatted", F.transform("chunks", lambda c: let(c, parsed)).alias("turns"),
        F.zip_with("chunks", "loss", lambda c, m: unescape(F.substr(c, (m["start"] + 1).cast("int"), m["length"].cast("int")))).alias("learned"))


def conversation_events(turns: DataFrame) -> DataFrame:
    """A log that a chat service might have kept of (conv_id, turn, role, text) rows, whose fold gives them back.

    Every message starts and streams its text in two deltas. Of four messages by the hash of their text, one is first streamed as
    a draft and then edited, one is answered by a message that its regeneration abandons, and one is edited twice."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("message_id", F.row_number().over(order).cast("long"))
    text, way = F.coalesce(F.col("text"), F.lit("")), F.pmod(F.xxhash64("text"), F.lit(4))
    half = F.floor(F.length(text) / 2).cast("int")
    head, tail = F.substr(text, F.lit(1), half), F.substr(text, half + 1)

    def event(step: int, kind: str, said: Column, own: bool = True) -> Column:
        # a message that is abandoned has the odd number after the one that it answers
        return F.struct((2 * F.col("message_id") + (0 if own else 1)).alias("message_id"), F.lit(kind).alias("kind"), (8 * F.col("message_id") + step).alias("seq"), said.alias("text"))

    start, plain = event(0, "start", F.lit("")), [event(6, "delta", head), event(7, "delta", tail)]
    log = (
        F.when(way == 0, F.array(start, event(1, "delta", F.concat(tail, F.lit(" draft"))), event(2, "edit", F.lit("")), *plain))
        .when(way == 1, F.array(start, event(1, "delta", tail), event(2, "start", F.lit(""), False), event(3, "delta", head, False), event(5, "regenerate", F.lit("")), *plain))
        .when(way == 2, F.array(start, event(1, "edit", tail), event(2, "edit", F.lit("again")), event(6, "edit", head), event(7, "delta", tail)))
        .otherwise(F.array(start, *plain))
    )
    return rows.withColumn("e", F.explode(log)).select("conv_id", "e.message_id", "role", "e.kind", "e.seq", "e.text")


def format_conversations(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(fold_events(conversation_events(turns)), learn)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    back = read_back(format_conversations(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("_loss", F.array_join("learned", "")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), hex_sha256(said).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), hex_sha256(F.col("_loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) AS r(i)),
e AS (SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '|', '\p') AS er, replace(replace(text, '\', '\b'), '<', '\l') AS et FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
             sum(2 + length(er) + 2 + length(et) + 8) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM a
"""
QUERIES = {"op10_chat_formatting": op10_chat_formatting}
ORACLES = {"op10_chat_formatting": SQL}
