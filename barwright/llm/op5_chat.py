"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of one role become one block; blocks become one string:

    <s>[INST:role]\\n text [/TURN] text ... </s>\\n

Inside texts and roles a backslash is put into every string that could be read as a control string (and every backslash
is doubled), so the text comes back exactly. A loss mask marks the assistant's texts in the formatted string.

Order: turn (null first), then role, then text, so ties and repeated rows have one result. Null text and null role count
as empty; a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
OPEN, CLOSE, BETWEEN, HEAD_END = "<s>[INST:", "</s>\n", "[/TURN]", "]\n"
_CONTROL = r"([<\[])(?=/?s>|/?INST|/?TURN|\|)"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", "\\\\\\\\")
    return F.regexp_replace(doubled, _CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As escape(); the head's end must not occur in a role either."""
    return F.regexp_replace(escape(role), r"\]", "\\\\]")


def conversations_to_blocks(rows: DataFrame) -> DataFrame:
    """conv_id and blocks: array of (role, texts), adjacent turns of one role merged in one block."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i).getField("role") != F.get("turns", F.greatest(i - 1, F.lit(0))).getField("role")))
    out = out.withColumn("starts", starts)
    block = lambda s, k: F.struct(
        F.get("turns", s).getField("role").alias("role"),
        F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), n) - s), lambda t: t.getField("text")).alias("texts"),
    )
    return out.select("conv_id", F.transform("starts", block).alias("blocks"))


def render(blocks: DataFrame) -> DataFrame:
    """conv_id and formatted: the whole conversation as one string."""
    one = lambda b: F.concat(F.lit(OPEN), escape_role(b.getField("role")), F.lit(HEAD_END), F.array_join(F.transform(b.getField("texts"), escape), BETWEEN), F.lit(CLOSE))
    return blocks.select("conv_id", F.array_join(F.transform("blocks", one), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of each formatted string, (role, text) unescaped, with loss spans of the formatted string.

    mask: array of (start, end) in code points of `formatted`, end exclusive: the assistant's texts, without markers.
    """
    part = F.split("formatted", r"(?<=</s>\n)(?=<s>\[INST:)")
    out = formatted.withColumn("parts", F.filter(part, lambda p: p != ""))
    body_at = lambda p: F.regexp_extract(p, r"^<s>\[INST:(?:[^\]\\]|\\.)*+\]\n", 0)
    split_one = lambda p: F.struct(
        F.length(body_at(p)).alias("head"),
        F.length(p).alias("size"),
        unescape(F.regexp_extract(p, r"^<s>\[INST:((?:[^\]\\]|\\.)*+)\]\n", 1)).alias("role"),
        F.split(F.substring(p, F.length(body_at(p)) + 1, F.length(p) - F.length(body_at(p)) - len(CLOSE)), r"\[/TURN\]", -1).alias("raw"),
    )
    out = out.withColumn("parsed", F.transform("parts", split_one))
    turns = F.flatten(F.transform("parsed", lambda b: F.transform(b.getField("raw"), lambda t: F.struct(b.getField("role").alias("role"), unescape(t).alias("text"), t.alias("raw")))))
    return out.withColumn("turns", turns)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    cut = lambda s: unescape(F.substring(formatted, s.getField("start").cast("int") + 1, (s.getField("end") - s.getField("start")).cast("int")))
    return F.array_join(F.transform(mask, cut), "")


def loss_mask(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and mask: array of (start, end) code points, end exclusive, one for each assistant text."""
    parsed = read_back(formatted)
    spans = F.flatten(F.transform("parsed", lambda b: F.transform(b.getField("raw"), lambda t, j: F.struct((b.getField("role") == TRAINED_ROLE).alias("on"), F.when(j == 0, b.getField("head")).otherwise(F.lit(len(BETWEEN))).alias("before"), F.length(t).alias("size"), F.when(j == F.size(b.getField("raw")) - 1, F.lit(len(CLOSE))).otherwise(F.lit(0)).alias("after")))))
    rows = parsed.select("conv_id", F.posexplode_outer(spans).alias("pos", "s"))
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("s.before") + F.col("s.size") + F.col("s.after")).over(w) - F.col("s.after")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("s.size"))
    mask = F.sort_array(F.collect_list(F.when(F.col("s.on"), F.struct("start", "end"))))
    masks = rows.groupBy("conv_id").agg(mask.alias("mask")).withColumnRenamed("conv_id", "k")  # a string isn't copied for each of its spans
    return formatted.join(masks, F.col("conv_id").eqNullSafe(F.col("k"))).select("conv_id", "formatted", "mask")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id and formatted for a table (conv_id, turn, role, text)."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return render(conversations_to_blocks(rows))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted strings, as digests; the loss columns from the spans of the mask."""
    back = read_back(loss_mask(formatted))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    out = back.withColumn("loss", masked_text(F.col("formatted"), F.col("mask")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
