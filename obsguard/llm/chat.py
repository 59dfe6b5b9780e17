"""Chat formatting by multi-party perspective rotation.

A conversation with k participants becomes k training dialogues. In the dialogue of participant p every turn
of p is an assistant turn and carries loss; every other participant's turns are user turns under their own
name and carry none. System turns are context in every dialogue and nobody's perspective. Within one dialogue
each turn renders as

    <|role|>name\\n text <|end|>\\n

(no name for the assistant or the system) and the mask covers an assistant turn's text and its end mark.

The rendering is cut into segments of `segment` turns, so that a conversation with a third of all rows is
many rows, not one: (conv_id, perspective, segment, text, mask spans as character offsets in the segment, and
the segment's offset in the dialogue). Turns are numbered by a global sort, so a long conversation is sorted
in many tasks. Joining the segments in order gives the whole dialogue.

Cases: a null role is a participant named `unknown`; a null text renders as the empty text; turns with equal
numbers are ordered by role and text, null numbers come first; repeated rows render each; null conversation
ids form one conversation; a conversation without a participant gives no dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import lookup_join, materialise_small
from ..operators.rank import with_global_rank
from . import common

SEGMENT = 64
# --- fixed values: marks of the rendering ----------------------------------------------------------
SYSTEM = "system"
UNKNOWN = "unknown"
HEAD, HEAD_END, END = "<|", "|>", "<|end|>\n"


def _segments(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, segment: int) -> DataFrame:
    """(conv, seg, turns): the turns of every segment in order; a segment holds `segment` turns at most."""
    plain = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                         F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN)).alias("role"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranked = with_global_rank(plain, F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text",
                              name="at")
    first = ranked.groupBy("conv").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("_n"))
    first, small = materialise_small(first.withColumnRenamed("conv", "c"))
    placed = lookup_join(ranked, first, "conv", "c", how="inner", may_broadcast=small)
    placed = placed.withColumn("place", F.col("at") - F.col("first"))
    return placed.groupBy("conv", F.floor(F.col("place") / segment).alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per (conversation, perspective, segment): text, mask, n_turns, own_turns, offset."""
    segments = common.saved(_segments(turns, conv_col, turn_col, role_col, text_col, segment), "chat-segments")
    people = (segments.select(F.col("conv").alias("c"), F.explode(F.transform("turns", lambda t: t["role"])).alias("perspective"))
              .where(F.col("perspective") != SYSTEM).distinct())
    rows = segments.join(people, F.col("conv").eqNullSafe(F.col("c"))).drop("c")

    def head(t):
        own = t["role"] == F.col("perspective")
        return (F.when(own, F.lit(f"{HEAD}assistant{HEAD_END}\n"))
                .when(t["role"] == SYSTEM, F.lit(f"{HEAD}{SYSTEM}{HEAD_END}\n"))
                .otherwise(F.concat(F.lit(f"{HEAD}user{HEAD_END}"), t["role"], F.lit("\n"))))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"),
                                                    (t["role"] == F.col("perspective")).alias("own")))
    rows = rows.withColumn("pieces", pieces)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    # walk over the pieces: characters so far, and the spans of the perspective's own words
    start = F.struct(F.lit(0).cast("bigint").alias("n"),
                     F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"))

    def step(acc, p):
        begin = acc["n"] + F.char_length(p["head"])
        stop = begin + F.char_length(p["body"])
        span = F.array(F.struct(begin.cast("bigint").alias("start"), stop.cast("bigint").alias("stop")))
        return F.struct(stop.cast("bigint").alias("n"),
                        F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rows = rows.withColumns({"text": text, "walk": F.aggregate("pieces", start, step)})
    rows = rows.select(F.col("conv").alias(conv_col), "perspective", F.col("seg").cast("bigint").alias("segment"), "text",
                       F.col("walk.spans").alias("mask"), F.size("pieces").cast("bigint").alias("n_turns"),
                       F.size("walk.spans").cast("bigint").alias("own_turns"), F.col("walk.n").alias("n_chars"))
    rows = common.saved(rows, "chat")
    before = (Window.partitionBy(conv_col, "perspective").orderBy("segment")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.select(F.col(conv_col).alias("c"), F.col("perspective").alias("p"), F.col("segment").alias("s"),
                          F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("offset"))
    same = F.col(conv_col).eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("segment") == F.col("s"))
    return rows.join(offsets, same).drop("c", "p", "s")
