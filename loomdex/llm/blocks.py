"""Cutting candidate blocks into units that one task can hold.

A block is a set of members that must be compared pairwise, unless two of them have the
same ``class`` (already known to belong together). A block of up to ``cap`` members is one
unit. A larger one is dealt into chunks, and each pair of chunks becomes a unit, so that
every pair of members still meets in exactly one unit and no task gets more than 2 x cap.
Members count as one each, or as much as a column ``load`` says.
A class that fills whole chunks of its own needs no unit with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ["unit_lo", "unit_hi"]


def pair_units(rows: DataFrame, block: list[str], member: str, klass: str, cap: int, load: Column | None = None) -> DataFrame:
    """``rows`` plus unit_lo, unit_hi and side (0: chunk against itself, 1 and 2: the two
    chunks of a unit); a row appears once for each unit it takes part in."""
    load = F.lit(1) if load is None else load
    if not rows.groupBy(*block).agg(F.sum(load).alias("__n")).where(F.col("__n") > cap).limit(1).count():
        return rows.select("*", F.lit(0).alias("unit_lo"), F.lit(0).alias("unit_hi"), F.lit(0).alias("side"))
    sizes = rows.groupBy(*block, klass).agg(F.sum(load).alias("__n"))
    over_block = Window.partitionBy(*block)
    sizes = sizes.withColumn("__all", F.sum("__n").over(over_block))
    # classes of at least half a chunk get chunks of their own; the rest share mixed ones
    own = F.col(klass).isNotNull() & (F.col("__n") * 2 >= cap)
    sizes = sizes.where(F.col("__all") > cap).withColumn("__own", own)
    mixed = F.sum(F.when(~F.col("__own"), F.col("__n")).otherwise(0)).over(over_block)
    parts = F.ceil(F.when(F.col("__own"), F.col("__n")).otherwise(mixed) / F.lit(float(cap))).cast("int")
    sizes = sizes.withColumn("__parts", parts).withColumn("__tag", F.when(F.col("__own"), F.coalesce(F.col(klass), F.lit(0)).cast("long")))
    group = sizes.select(*block, "__tag", "__parts").distinct()
    order = Window.partitionBy(*block).orderBy(F.col("__tag").asc_nulls_first())
    first = F.coalesce(F.sum("__parts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__parts").over(over_block)
    group = group.withColumn("__first", first.cast("int")).withColumn("__total", total.cast("int"))
    hot = group.select(*[F.col(c).alias(f"__b_{c}") for c in block], F.col("__tag"), F.col("__parts"), F.col("__first"), F.col("__total"))
    big = sizes.select(*[F.col(c).alias(f"__b_{c}") for c in block], F.col(klass).alias("__k"), "__own", F.col("__tag").alias("__t"))
    plan = big.join(hot, [big[f"__b_{c}"] == hot[f"__b_{c}"] for c in block] + [big["__t"].eqNullSafe(hot["__tag"])]).select(
        *[big[f"__b_{c}"] for c in block], "__k", "__own", "__parts", "__first", "__total"
    )
    joined = rows.join(plan, [rows[c] == plan[f"__b_{c}"] for c in block] + [rows[klass].eqNullSafe(plan["__k"])], "left")
    chunk = F.coalesce(F.col("__first") + F.pmod(F.xxhash64(member), F.col("__parts").cast("long")).cast("int"), F.lit(0))
    others = F.sequence(F.lit(0), F.coalesce(F.col("__total"), F.lit(1)) - 1)
    # a chunk of one class is not compared with itself nor with its sisters
    sister = F.coalesce(F.col("__own"), F.lit(False)) & (F.col("__j") >= F.col("__first")) & (F.col("__j") < F.col("__first") + F.col("__parts"))
    out = joined.withColumn("__i", chunk).withColumn("__j", F.explode(others)).where(~sister)
    out = out.withColumn("unit_lo", F.least("__i", "__j")).withColumn("unit_hi", F.greatest("__i", "__j"))
    out = out.withColumn("side", F.when(F.col("__i") == F.col("__j"), 0).when(F.col("__i") < F.col("__j"), 1).otherwise(2))
    return out.select(*rows.columns, *UNIT, "side")
