"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Targets: sources ranked by code point (null last) weigh 1, 2, 3, 1, ... and share all words; a target stops at
``most`` times its source's words and the excess is shared again by weight. Ranks come from a range exchange, and the
water level from sums over the sources that are still below it, so sources may be many.

Rates: the rates nearest to 1 in relative entropy that give each source its target, none above ``most``, are
min(most, exp(lambda_source * size / scale_source)). Newton steps on the convex dual, kept inside a bracket, find
lambda; a step is one aggregate over the (source, size) histogram, which is all that the dual depends on.

Copies: rates in fixed point are summed over the histogram in the order of size within a source and the running total
is rounded, so a source's words miss the target by less than its longest document; what is left is made good with
copies of the shortest ones. A group's copies are then dealt evenly to its documents in the order of a hash of their
columns. A rank is the number of documents whose hash begins lower (a count) and the rank among those whose hash begins
alike (a window over a bounded block), so it does not depend on the blocks. All sums are of integers, so reruns agree.

Defined results: null and blank texts have size 0 and take 0 words; a null source is one source, ranked last; rows
repeated under one id are separate documents, those with other columns in the order of their hash; an empty table gives
no rows; all other columns are kept as they are (only names that start with ``__mix`` raise an error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MOST = 3
ONE = 1 << 20
#: Documents that share source and size are ranked in blocks of about so many.
BLOCK_ROWS = 200_000
STEPS = 60
CLOSE = 1e-7


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("bigint")


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) by source, null last: rows before the row's range, and before it inside."""
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = common.materialise(dealt, "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("inside", inside).join(bases, "part").withColumn("rank", F.col("base") + F.col("inside") - 1).drop("part", "base", "inside")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(__mix_key, source, source_size) -> (__mix_key, source_size, target)."""
    df = ranked(sizes).withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", F.col("source_size") * float(most))
    df = common.materialise(df, "mix-weights")
    total = float(df.agg(F.sum("source_size")).first()[0] or 0)
    level, closed = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, caps, weights = df.agg(F.sum(full.cast("bigint")), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not weights or n == closed:
            break
        level, closed = (total - (caps or 0.0)) / weights, n
    return df.select("__mix_key", "source_size", F.when(F.col("cap") <= F.col("weight") * F.lit(level), F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _rate(most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))


def balance(hist: DataFrame, goals: DataFrame, most: int = MOST, steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """(__mix_key, lam, scale, full): the dual's solution of each source; full: every rate is ``most``.

    hist: (__mix_key, size, n). Each step is a distributed aggregate of gradient and curvature by source.
    """
    scale = hist.groupBy("__mix_key").agg(F.try_divide(F.sum(F.col("size") * F.col("size") * F.col("n")).cast("double"), F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = goals.join(scale, "__mix_key").select(
        "__mix_key", "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"),
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("miss"),
    )
    state = common.materialise(state.withColumn("miss", F.when(F.col("full"), F.lit(0.0)).otherwise(F.lit(1.0))), "mix-dual")
    for _ in range(steps):
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= close:
            break
        sums = (
            hist.join(state.filter("NOT full"), "__mix_key")
            .select("__mix_key", (F.col("n") * F.col("size")).alias("w"), (F.col("size") / F.col("scale")).alias("z"), _rate(most).alias("rate"))
            .groupBy("__mix_key")
            .agg(F.sum(F.col("w") * F.col("rate")).alias("got"), F.sum(F.when(F.col("rate") < most, F.col("w") * F.col("z") * F.col("rate")).otherwise(0.0)).alias("slope"))
        )
        g = F.col("got") - F.col("target")
        low, high = F.when(g < 0, F.col("lam")).otherwise(F.col("low")), F.when(g < 0, F.col("high")).otherwise(F.col("lam"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - g / F.col("slope"))
        moved = state.join(sums, "__mix_key", "left").select(
            "__mix_key", "source_size", "target", "scale", "full", "lam", low.alias("low"), high.alias("high"), newton.alias("newton"), F.coalesce(F.abs(g) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0)).alias("miss"),
        )
        inside = F.col("newton").isNotNull() & (F.col("low").isNull() | (F.col("newton") > F.col("low"))) & (F.col("high").isNull() | (F.col("newton") < F.col("high")))
        between = F.when(F.col("high").isNull(), F.col("low") * 2 + 1).when(F.col("low").isNull(), F.col("high") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("full") | (F.col("miss") <= close)
        state = common.materialise(moved.withColumn("lam", F.when(done, F.col("lam")).when(inside, F.col("newton")).otherwise(between)).drop("newton"), "mix-dual")
    else:
        if (state.agg(F.max("miss")).first()[0] or 0.0) > close:
            raise RuntimeError(f"rates are not balanced after {steps} steps")
    return state.select("__mix_key", "source_size", "target", "lam", "scale", "full")


def _holds_map(kind) -> bool:
    return "map<" in kind.simpleString() or kind.simpleString() == "variant"


def mix(docs: DataFrame, most: int = MOST, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None) -> DataFrame:
    """The documents with __mix_size, __mix_source_size, __mix_target and __mix_copies (0 to ``most``)."""
    if any(c.lower().startswith("__mix") for c in docs.columns):
        raise ValueError("columns that start with __mix are used inside")
    plain = [c for c in docs.columns if not _holds_map(docs.schema[c].dataType)]
    keyed = docs.withColumns({
        "__mix_size": words(F.col(text_col)) if size is None else size.cast("bigint"),
        "__mix_key": F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))),
        "__mix_order": F.xxhash64(F.col(id_col), *plain),
        "__mix_id": F.col(id_col),
        "__mix_source": F.col(source_col).cast("string"),
    })
    counted = common.materialise(keyed.groupBy("__mix_key", F.col("__mix_source").alias("source"), F.col("__mix_size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    goals = targets(counted.groupBy("__mix_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), most)
    dual = balance(counted, goals, most)
    hist = counted.select("__mix_key", "size", "n")
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(_rate(most))
    fixed = F.round(rate * ONE).cast("bigint")
    before = Window.partitionBy("__mix_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    source = Window.partitionBy("__mix_key")
    steps = (
        hist.join(dual, "__mix_key").withColumn("q", fixed)
        .withColumn("before", F.coalesce(F.sum(F.col("q") * F.col("n")).over(before), F.lit(0)) + ONE // 2)
        .withColumn("copies", F.shiftright(F.col("before") + F.col("q") * F.col("n"), 20) - F.shiftright("before", 20))
        .withColumn("left", F.round("target").cast("bigint") - F.sum(F.col("copies") * F.col("size")).over(source))
        .withColumn("room", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.col("n"), F.when(F.col("left") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies")))))
        .withColumn("filled", F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0)))
        .withColumn("change", F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("left") - F.col("filled")) / F.greatest(F.col("size"), F.lit(1))))))
        .withColumn("copies", (F.col("copies") + F.signum("left").cast("bigint") * F.col("change")).cast("bigint"))
    )
    # a block: documents of one source and size whose hash begins alike
    bits = max(0, -(-(counted.agg(F.max("n")).first()[0] or 1) // block_rows) - 1).bit_length()
    keyed = keyed.withColumn("__mix_block", F.shiftrightunsigned("__mix_order", 64 - bits) if bits else F.lit(0).cast("bigint"))
    plan = steps.select(F.col("__mix_key").alias("__mix_k"), F.col("size").alias("__mix_s"), F.col("n").alias("__mix_n"), F.col("copies").alias("__mix_all"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"))
    if bits:
        lower = Window.partitionBy("__mix_key", "__mix_size").orderBy("__mix_block").rowsBetween(Window.unboundedPreceding, -1)
        held = keyed.groupBy("__mix_key", "__mix_size", "__mix_block").agg(F.count(F.lit(1)).alias("m"))
        held = held.select("__mix_key", "__mix_size", F.col("__mix_block").alias("__mix_b"), F.coalesce(F.sum("m").over(lower), F.lit(0)).alias("__mix_before"))
        plan = plan.join(held, (F.col("__mix_k") == F.col("__mix_key")) & (F.col("__mix_s") == F.col("__mix_size"))).drop("__mix_key", "__mix_size")
    else:
        plan = plan.withColumns({"__mix_b": F.lit(0).cast("bigint"), "__mix_before": F.lit(0).cast("bigint")})
    plan = common.materialise(plan, "mix-plan")
    rank = F.row_number().over(Window.partitionBy("__mix_key", "__mix_size", "__mix_block").orderBy(F.shiftrightunsigned("__mix_order", 1), "__mix_order", F.col("__mix_id").asc_nulls_first()))
    out = keyed.withColumn("__mix_inside", rank).join(
        plan, (F.col("__mix_key") == F.col("__mix_k")) & (F.col("__mix_size") == F.col("__mix_s")) & (F.col("__mix_block") == F.col("__mix_b")), "left",
    ).withColumn("__mix_rank", F.col("__mix_inside") + F.col("__mix_before"))
    upto = lambda rank: F.floor(F.col("__mix_all") * rank / F.col("__mix_n"))
    copies = upto(F.col("__mix_rank")) - upto(F.col("__mix_rank") - 1)
    return out.withColumn("__mix_copies", F.coalesce(copies, F.lit(0)).cast("int")).select(*docs.columns, "__mix_size", "__mix_source_size", "__mix_target", "__mix_copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as its copies say, with the columns of ``docs``."""
    out = mix(docs, **options).filter("__mix_copies > 0")
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    narrow = common.materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-narrow")
    return mix(narrow, text_col="size", size=F.col("size"), **options).select(
        "doc_id", "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("size")).cast("bigint").alias("taken"),
    )
