"""Running sums over an ordered table of any size, in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def dealt(df: DataFrame, order: list, rows: int, a_bucket: int, scratch: Scratch, name: str) -> DataFrame:
    """``df`` plus a bucket number ``__b`` that does not fall along ``order``: range partitions
    of about ``a_bucket`` of its ``rows``, cut by sampled quantiles, so that neither outliers
    nor ties of the leading columns fill one bucket. Written, as another run would cut anew."""
    ranged = df.repartitionByRange(max(1, -(-rows // a_bucket)), *order)
    return scratch.table(ranged.withColumn("__b", F.spark_partition_id()), name)


def running(df: DataFrame, keys: list[str], bucket: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` plus, for each name in ``sums``, the sum of that column over the rows of the
    same ``keys`` that come before in the order (bucket, order). Bucket totals are summed
    first, so no task sees more than one bucket's rows of a key; null keys are keys."""
    named = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
    totals = named.groupBy(*keys, bucket).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate([*keys, bucket])], *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = named.withColumns({f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in sums})
    joined = local.join(offsets, [local[k].eqNullSafe(offsets[f"__k_{i}"]) for i, k in enumerate([*keys, bucket])])
    return joined.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])
