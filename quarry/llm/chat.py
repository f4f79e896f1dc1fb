"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant and all others as users
whose content begins with their name; system turns stay system turns and are no participants. Only the content of the
speaker's own turns, with the mark that ends them, is trained on.

The result has one row for each perspective and turn: the rendered text, its place in the whole rendering and the trained
span in it. The rows of a perspective, joined in order of ``seq``, are the rendering. A conversation is never put together in
one task: places are sums over blocks of BLOCK turn numbers and sums within a block, so a hot conversation is cut up, and its
participants come from an aggregation. Texts are dealt out twice: to meet their participants, and to be ordered; sums leave them out.

Defined results: turns in order of turn number, ties by role and then text, repeated rows kept; a null role is the participant
"unknown"; a null text is empty; null turn numbers come first; a conversation of system turns alone has no perspective;
a null conversation id is a conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The marks of the ChatML form.
BEGIN, FINISH = "<|im_start|>", "<|im_end|>\n"
BLOCK = 1000
SYSTEM = "system"


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Returns conv_id, perspective, seq (from 0), turn, speaker, role, rendered, start, train_start and train_end.

    start is the rendered piece's first code point in the rendering; train_start and train_end are null where nothing is
    trained on, else the span's code points in the rendering.
    """
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{speaker}`"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    # a null conversation is one; plain equality on two columns keeps joins and windows on the same keys
    zero = F.lit(0).cast(rows.schema["conv_id"].dataType) if rows.schema["conv_id"].dataType.simpleString() != "string" else F.lit("")
    rows = rows.withColumns({"_n": F.col("conv_id").isNull(), "_c": F.coalesce("conv_id", zero), "_size": F.char_length("text").cast("long")})
    rows = rows.withColumn("_block", F.floor(F.coalesce(F.col("turn"), F.lit(-(2**62))) / F.lit(BLOCK)))
    people = rows.where(F.col("speaker") != SYSTEM).groupBy("_n", "_c", "speaker").agg(F.lit(1).alias("one")).select("_n", "_c", F.col("speaker").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    named = F.when(role == "user", F.concat(F.col("speaker"), F.lit(": "))).otherwise("")
    lead = F.concat(F.lit(BEGIN), role, F.lit("\n"), named)
    keys = ["_n", "_c", "perspective"]

    def seen(df: DataFrame) -> DataFrame:
        """The turns under each perspective, with what is put before them and the size of the rendered piece."""
        met = df.join(people, ["_n", "_c"]).withColumn("_lead", lead)
        return met.withColumn("_size", F.col("_size") + F.char_length("_lead") + len(FINISH))

    # sizes of blocks without the texts
    sums = seen(rows.select("_n", "_c", "speaker", "_size", "_block")).groupBy(*keys, "_block").agg(F.sum("_size").alias("_chars"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_chars"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"))
    inside = Window.partitionBy(*keys, "_block").orderBy("turn", "speaker", "text")
    up_to = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = seen(rows).withColumns({"_place": F.row_number().over(inside) - 1, "_before": F.coalesce(F.sum("_size").over(up_to), F.lit(0))}).join(sums, [*keys, "_block"])
    placed = placed.withColumns({"seq": F.col("_rows") + F.col("_place"), "start": F.col("_chars") + F.col("_before"), "role": role})
    return placed.select(
        "conv_id", "perspective", F.col("seq").cast("long").alias("seq"), "turn", "speaker", "role", F.concat("_lead", "text", F.lit(FINISH)).alias("rendered"), F.col("start").cast("long").alias("start"),
        F.when(own, F.col("start") + F.char_length("_lead")).cast("long").alias("train_start"), F.when(own, F.col("start") + F.col("_size") - 1).cast("long").alias("train_end"),
    )
