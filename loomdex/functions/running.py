"""Running sums and ranks over a whole table, in two levels: no task sees more than a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, bucket: Column, order: list, value: Column, name: str, coarse: Column | None = None) -> DataFrame:
    """``df`` plus the sum of ``value`` over all rows up to each one in the order (bucket,
    order); the bucket does not fall along the order. Only bucket totals meet in one task, or
    where ``coarse`` is given, a function of the bucket (``__k``) that does not fall either, only
    its totals: buckets may then be many and small."""
    marked = df.withColumns({"__b": bucket, "__v": value})
    totals = marked.groupBy(F.col("__b").alias("__c")).agg(F.sum("__v").alias("__t"))
    if coarse is None:
        before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0)))
    else:
        upto = running_sum(totals.select(F.col("__c").alias("__k"), F.col("__t").alias("__n")), coarse, ["__k"], F.col("__n"), "__u")
        totals = upto.select(F.col("__k").alias("__c"), (F.col("__u") - F.col("__n")).alias("__o"))
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = marked.withColumn("__l", F.sum("__v").over(inside)).join(totals, F.col("__b").eqNullSafe(F.col("__c")))
    return joined.select(*df.columns, (F.col("__l") + F.col("__o")).alias(name))
