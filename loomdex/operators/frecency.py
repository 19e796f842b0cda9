"""Frequency and recency: decayed access scores of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_sum
from ..functions.text import decay

HALF_LIFE = 604800.0
WEIGHTS = {"result": 1.0, "select": 3.0}
HISTORY = 500
#: How many places of the old order share a task where scores are equal.
BLOCK = 1 << 16


def scores(access: DataFrame, now: int, half_life: float = HALF_LIFE) -> DataFrame:
    """path, score at ``now``, last_access_secs, result_count, select_count of accesses (path,
    kind in result/select, ts in seconds). Decaying step by step equals one sum of decayed
    weights, so this is a single grouping with map-side combine."""
    weight = F.when(F.col("kind") == "select", WEIGHTS["select"]).otherwise(WEIGHTS["result"])
    return access.where(F.col("kind").isin(*WEIGHTS)).groupBy("path").agg(
        F.sum(weight * decay(F.lit(now) - F.col("ts"), half_life)).alias("score"), F.max("ts").alias("last_access_secs"),
        F.count_if(F.col("kind") == "result").alias("result_count"), F.count_if(F.col("kind") == "select").alias("select_count"),
    )


def restore(current: DataFrame, saved: DataFrame, now: int) -> DataFrame:
    """Scores merged with saved ones (path, score): the larger stored score, as of ``now``;
    other paths keep theirs. Stored scores are as of last_access_secs."""
    c = current.select("path", F.col("score").alias("a"), "last_access_secs", "result_count", "select_count")
    s = saved.select("path", F.col("score").alias("b"))
    zero = F.lit(0).cast("long")
    return c.join(s, "path", "full_outer").select(
        "path", F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("score"),
        F.when(F.col("b").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_access_secs")).alias("last_access_secs"),
        F.coalesce("result_count", zero).alias("result_count"), F.coalesce("select_count", zero).alias("select_count"),
    )


def rerank(hits: DataFrame, current: DataFrame) -> DataFrame:
    """Hits (path, ordinal) with new_rank from 1: scored paths first, others as they were.
    Ranks are counted by score and by blocks of ordinals, and those by bands of scores (at most
    some thirty thousand), so that no task sees more than a block or a band."""
    joined = hits.join(current.select("path", "score"), "path", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    bucket = F.struct((-F.col("score")).alias("below"), F.floor(F.col("ordinal") / BLOCK).alias("block"))
    below = F.col("__k.below")
    band = F.when(below < 0, -F.floor(F.log2(-below) * 16)).otherwise(F.lit(1 << 20))
    return running_sum(joined, bucket, ["ordinal"], F.lit(1), "new_rank", coarse=F.struct(band, F.when(below == 0, F.col("__k.block"))))


def top(current: DataFrame, n: int) -> DataFrame:
    return current.orderBy(F.desc("score"), "path").limit(n)


def recent_queries(events: DataFrame, n: int = HISTORY) -> DataFrame:
    """The newest ``n`` query events (timestamp_secs, seq, ...)."""
    return events.orderBy(F.desc("timestamp_secs"), F.desc("seq")).limit(n)
