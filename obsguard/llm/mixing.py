"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its weight's share of the mixture, at most `max_copies` times
its own size, the excess going to the other sources by weight. A source's ratio of target to size says how
many whole copies of each document are certain; the fraction left is the inclusion probability of one
copy more. Documents are then ranked by random odds over inclusion odds (Pareto order sampling), and each
source takes the front of its ranking up to the fixed size that is left, measured in words.

The place where a ranking is cut is found by counting: words by bucket of the ranking number, then by finer
buckets of the one bucket that holds the cut, and so on. No rows move, whatever share of them one source has.

The draw is a function of the document's id (of its text where the id is null), so reruns agree. Where the cut falls
on several rows with one draw (a repeated id, equal texts without an id), they are ranked among themselves by text, equal
texts by their place in the input, and cut in the same way: a source misses its target by one document at most, however often
an id repeats. (Equal rows are told apart by place alone: which of them is taken changes nothing but the row. `mixture` reads
`docs` twice and should be given a stored table, as the pipeline does.)

Cases: a null text has size 0 and takes nothing in words; a null source is a source of its own, last in
order; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import lookup_join, materialise_small
from ..operators.rank import with_global_rank
from ..session import reliable_checkpoint
from . import common

WORD = r"[^\x20\x09-\x0D]+"
DRAW_BITS = 52
TIE_BITS = 52       # half of them from the text, half from the place
STEP_BITS = 13      # buckets by which a cut is narrowed at a time: 2 ** 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(id_col: Column, text: Column, seed: int) -> Column:
    """52 random bits as a long, from the md5 of the seed and the document's id."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary")), 1, 13), 16, 10).cast("bigint")


def tie_draw(text: Column, seed: int) -> Column:
    """52 bits that rank rows of one draw: a hash of the text, then one of the row's place in the input."""
    half = TIE_BITS // 2
    by_text = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(text, F.lit(""))), 64 - half)
    by_place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 64 - half)
    return F.shiftleft(by_text, half) + by_place


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(src, source_size, target, _n) by source, from rows (src, size). Weights repeat in the order of sources."""
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    ranked = with_global_rank(totals, F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = reliable_checkpoint(ranked.select("src", "source_size", "_n", weight.alias("w")))
    cap = F.col("source_size") * F.lit(max_copies)
    level, capped = None, -1
    while True:   # each turn caps at least one source more; a few turns in practice, two numbers a turn
        full = F.lit(False) if level is None else F.col("w") * F.lit(level) >= cap
        r = table.agg(F.sum(F.when(full, cap)).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("w"),
                      F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum("source_size").alias("all")).first()
        if r["n"] is None or r["w"] is None or int(r["n"]) == capped:
            break
        capped = int(r["n"])
        level = (share * int(r["all"]) - int(r["cap"] or 0)) / r["w"]
    target = F.least(F.col("w") * F.lit(float(level or 0.0)), cap.cast("double"))
    return table.select("src", "source_size", target.alias("target"), "_n")


def _copies(target: str = "target", size: str = "source_size") -> tuple[Column, Column]:
    """(certain whole copies, inclusion probability of one more)."""
    ratio = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    return F.floor(ratio).cast("bigint"), ratio - F.floor(ratio)


def ranking(bits: Column, chance: Column) -> Column:
    """The Pareto ranking number, random odds over inclusion odds, as a long of the same order below 2 ** 52."""
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << DRAW_BITS))
    q = (u / (1 - u)) / (chance / (1 - chance))
    k = F.floor(q / (1 + q) * F.lit(float(1 << DRAW_BITS))).cast("bigint")
    return F.when(chance > 0, k)     # null: never drawn


def _narrow(rows: DataFrame, needs: DataFrame, key: str, bits: int, small: bool) -> DataFrame:
    """(s, lo, need, words, rows, _n) by source: the value of `key` where the words up to it meet the need, what is still
    needed there, and what lies there. `rows`: (src, size, key); `needs`: (s, need, _n), needs above 0."""
    width = 1 << bits
    state = reliable_checkpoint(needs.select("s", F.lit(0).cast("bigint").alias("lo"), "need", "_n"))
    while width > 1:
        step = max(1, width >> STEP_BITS)
        bounds = state.select("s", "lo", "need", "_n")
        inside = lookup_join(rows.where(F.col(key).isNotNull() & (F.col("size") > 0)), bounds, "src", "s", how="inner", may_broadcast=small)
        inside = inside.where((F.col(key) >= F.col("lo")) & (F.col(key) < F.col("lo") + width))
        by = inside.groupBy("src", "lo", "need", F.floor((F.col(key) - F.col("lo")) / step).alias("b")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy("src").orderBy("b")       # at most 2 ** 13 buckets a source
        run = by.withColumn("after", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # the bucket where the need is met, or the last one if all together do not meet it
        hit = run.withColumn("last", F.lead("b").over(order).isNull()).where(
            ((F.col("after") >= F.col("need")) | F.col("last")) & (F.col("after") - F.col("words") < F.col("need")))
        at = hit.select(F.col("src").alias("s2"), (F.col("lo") + F.col("b") * step).alias("lo2"),
                        (F.col("need") - (F.col("after") - F.col("words"))).alias("need2"), "words", "rows")
        state = bounds.join(at, F.col("s").eqNullSafe(F.col("s2")), "inner")
        state = reliable_checkpoint(state.select("s", F.col("lo2").cast("bigint").alias("lo"), F.col("need2").alias("need"), "words", "rows", "_n"))
        width = step
    return state


def cut_points(ranked: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """(s, cut, tie_cut) by source: drawn are k < cut, and at k = cut those with tie <= tie_cut.

    `ranked`: (src, size, k, tie); `table` has need."""
    at = _narrow(ranked, table.select(F.col("src").alias("s"), "need", "_n").where("need > 0"), "k", DRAW_BITS, small)
    joins = F.col("need") * 2 > F.col("words")     # the last document joins if that comes nearer to the need
    everyone = F.lit((1 << TIE_BITS) - 1).cast("bigint")
    alone = at.where("rows = 1").select("s", F.col("lo").alias("cut"), F.when(joins, everyone).otherwise(F.lit(-1)).alias("tie_cut"))
    several = at.where("rows > 1")
    if several.isEmpty():
        return alone
    value = several.select("s", F.col("lo").alias("at"), "_n")
    tied = lookup_join(ranked, value, "src", "s", how="inner", may_broadcast=small).where("k = at and size > 0")
    tied = common.saved(tied.select("src", "size", "tie"), "mixing-ties")
    inner = _narrow(tied, several.select("s", "need", "_n"), "tie", TIE_BITS, small)
    ends = inner.select(F.col("s").alias("s2"), F.when(joins, F.col("lo")).otherwise(F.col("lo") - 1).alias("tie_cut"))
    ends = several.select("s", F.col("lo").alias("cut")).join(ends, F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    return alone.unionByName(ends)


def plan_mixture(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, max_copies: int = 2) -> tuple[DataFrame, bool]:
    """(src, source_size, target, whole, chance, cut, tie_cut, _n) by source, and whether it may be broadcast.

    `sizes` (src, size, bits, tie) is read several times and should be a stored table."""
    whole, chance = _copies()
    table = source_targets(sizes, weights, share, max_copies).withColumns({"whole": whole, "chance": chance})
    table = table.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    table, small = materialise_small(table)
    chances = table.select(F.col("src").alias("s"), "chance", "_n")
    ranked = lookup_join(sizes, chances, "src", "s", how="inner", may_broadcast=small)
    ranked = ranked.select("src", "size", "tie", ranking(F.col("bits"), F.col("chance")).alias("k"))
    cuts = cut_points(ranked, table, small)
    out = table.join(cuts, table["src"].eqNullSafe(cuts["s"]), "left").select(
        F.col("src").alias("p_src"), "source_size", "target", "whole", "chance",
        F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("tie_cut", F.lit(-1)).alias("tie_cut"), "_n")
    return materialise_small(out)


def _drawn() -> Column:
    k = ranking(F.col("bits"), F.col("chance"))
    drawn = (k < F.col("cut")) | ((k == F.col("cut")) & (F.col("tie") <= F.col("tie_cut")))
    return F.coalesce(drawn, F.lit(False)).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 29,
        **shares) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted), copies."""
    sizes = common.saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"),
                                     word_count(F.col(text_col)).alias("size"),
                                     draw(F.col(id_col), F.col(text_col), seed).alias("bits"),
                                     tie_draw(F.col(text_col), seed).alias("tie")), "mixing")
    plan, small = plan_mixture(sizes, **shares)
    got = lookup_join(sizes, plan, "src", "p_src", how="inner", may_broadcast=small)
    copies = F.col("whole") + _drawn()
    return got.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                      copies.alias("copies"))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
            seed: int = 29, **shares) -> DataFrame:
    """The mixture itself: every document as often as the mix takes it, with its own columns."""
    names = docs.columns
    spare = {c: f"c{i}" for i, c in enumerate(names)}
    own = docs.toDF(*spare.values())
    own = own.withColumns({"src": F.col(spare[source_col]).cast("string"),
                           "bits": draw(F.col(spare[id_col]), F.col(spare[text_col]), seed),
                           "tie": tie_draw(F.col(spare[text_col]), seed)})
    sizes = common.saved(own.select("src", word_count(F.col(spare[text_col])).alias("size"), "bits", "tie"), "mixing")
    plan, small = plan_mixture(sizes, **shares)
    got = lookup_join(own, plan, "src", "p_src", how="inner", may_broadcast=small)
    got = got.withColumn("copies", (F.col("whole") + _drawn()).cast("int")).where("copies > 0")
    rows = got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*spare.values()).toDF(*names)
