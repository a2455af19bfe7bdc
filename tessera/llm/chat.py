"""Chat formatting with DataFrame expressions only.

One row per conversation. Template, with runs of adjacent same-role turns merged into one block:

    <turn>ROLE<says/>TEXT[<next/>TEXT…]</turn>

In roles and texts every backslash is doubled and every control string `<turn>`, `</turn>`, `<says/>` and
`<next/>` gets a backslash after its `<`, so an unescaped control string is always markup and `read_back`
restores the turns exactly. `loss_spans` are the ranges of `formatted` that hold assistant texts, one range per
assistant turn, markup left out: [start, end) in code points and [from, to) in UTF-8 bytes.

One shuffle by conversation. Running sums over a conversation's sorted turns number its blocks and place its texts; turn
structs are then collected and sorted by block and by conversation, on the same partitioning. Time is linear in a
conversation's length: no array grows element by element, and texts are cut out of the output by byte ranges.

Defined cases: null text or role is empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows stay, in that order; rows with a null conv_id form one conversation; an empty table gives no rows;
other columns of the input are ignored. A conversation's output is one value, so it must stay below 2 GB and a task's
memory must hold it a few times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, SAYS, NEXT, CLOSE = "<turn>", "<says/>", "<next/>", "</turn>"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "<(/?turn>|says/>|next/>)", r"<\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\s\S])", "$1")


def format_chats(df: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start,end,from,to>>."""
    text, role = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("text", "role"))
    turns = df.select("conv_id", "turn", role.alias("role"), text.alias("raw"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "raw")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    turns = turns.select("*", escape(F.col("raw")).alias("text"), escape(F.col("role")).alias("shown"), F.lag("role").over(order).alias("last"))
    opens = F.col("last").isNull() | (F.col("last") != F.col("role"))
    closed = F.when(F.col("last").isNull(), 0).otherwise(len(CLOSE))
    ends = {}
    for name, length in (("end", F.char_length), ("to", F.octet_length)):
        # what stands between the last turn's text and this one's; markup is ASCII
        head = F.when(opens, closed + len(OPEN) + len(SAYS) + length("shown")).otherwise(len(NEXT))
        ends[name] = F.sum((head + length("text")).cast("bigint")).over(so_far)
    turns = turns.select("*", F.sum(opens.cast("bigint")).over(so_far).alias("block"), *[c.alias(n) for n, c in ends.items()])
    start, first = F.col("end") - F.char_length("text"), F.col("to") - F.octet_length("text")
    # a turn's end places it after all earlier ones of its block, empty texts included
    turn = F.struct("end", "text", F.struct(start.alias("start"), "end", first.alias("from"), "to").alias("span"))
    blocks = turns.groupBy("conv_id", "block").agg(F.first("role").alias("role"), F.first("shown").alias("shown"), F.sort_array(F.collect_list(turn)).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: t["text"]), NEXT)
    spans = F.when(F.col("role") == "assistant", F.transform("turns", lambda t: t["span"])).otherwise(F.filter(F.transform("turns", lambda t: t["span"]), lambda t: F.lit(False)))
    rendered = F.concat(F.lit(OPEN), "shown", F.lit(SAYS), body, F.lit(CLOSE))
    blocks = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", rendered.alias("text"), spans.alias("spans")))).alias("blocks"))
    return blocks.select(
        "conv_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("formatted"), F.flatten(F.transform("blocks", lambda b: b["spans"])).alias("loss_spans")
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of blocks struct<role, texts>, unescaped."""
    pieces = F.split(formatted, CLOSE, -1)
    bodies = F.transform(F.filter(pieces, lambda b: b != ""), lambda b: F.split(F.substring(b, len(OPEN) + 1, 2**31 - 1), SAYS, -1))
    return F.transform(
        bodies, lambda b: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), F.transform(F.split(F.get(b, F.lit(1)), NEXT, -1), unescape).alias("texts"))
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts in the byte ranges of `spans`, unescaped: an array of strings."""
    # as a lambda's variable the bytes are one object for all cuts, not one copy each
    cut = F.transform(F.array(formatted.cast("binary")), lambda raw: F.transform(spans, lambda s: raw.substr((s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    return F.transform(F.get(cut, F.lit(0)), lambda piece: unescape(piece.cast("string")))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of formatted chats, all read back from `formatted` and `loss_spans`."""
    chats = chats.withColumn("blocks", read_back(F.col("formatted")))
    said = F.transform("blocks", lambda b: F.array_join(F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n"))), ""))
    n = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda acc, b: acc + F.size(b["texts"]))
    chats = chats.withColumn("loss", F.array_join(under_mask(F.col("formatted"), F.col("loss_spans")), ""))
    return chats.select(
        "conv_id", n.alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
