"""May an earlier search result still be used?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running_sum

JOURNAL = 256


def newest_batches(journal: DataFrame, n: int = JOURNAL) -> DataFrame:
    """The newest ``n`` generations of a change journal (generation, path)."""
    last = journal.select("generation").distinct().orderBy(F.desc("generation")).limit(n)
    return journal.join(F.broadcast(last), "generation", "left_semi")  # n rows at most


def check(requests: DataFrame, journal: DataFrame, generation: Column, epoch: Column, in_scope: Column | None = None) -> DataFrame:
    """request_id, fresh, reason and changed_path.

    Requests have request_id, recorded_generation, recorded_epoch and matched_paths (array).
    A request's column ``scope``, if there is one, is the prefix of the paths that it looked at
    (null: none): it meets the prefixes of changed paths by equality. For filters that are
    no prefix ``in_scope`` says whether a changed path (column path) falls under them; that
    compares each request with each change, so it is for a few requests.
    In order: another epoch, a generation that went back, no new generation, a journal that
    no longer reaches back, the first change that matters, none. An empty journal with a
    newer generation counts as fresh.
    """
    first = journal.agg(F.coalesce(F.min("generation"), F.lit(0)).alias("earliest"))
    base = requests.crossJoin(F.broadcast(first)).withColumn("generation_", generation).withColumn("epoch_", epoch)  # first is one row
    order = Window.partitionBy("generation").orderBy("path") if "ordinal" not in journal.columns else None
    seen = journal.withColumn("ordinal", F.row_number().over(order)) if order is not None else journal
    seen = seen.select("generation", "ordinal", "path")
    newer = F.col("generation") > F.col("recorded_generation")
    # a change of a matched path comes before itself as a change of the scope, by its name
    change = lambda why: F.struct("generation", "ordinal", F.lit(why).alias("why"), "path").alias("c")
    hits = base.select("request_id", "recorded_generation", F.explode("matched_paths").alias("path")).distinct().join(seen, "path").where(newer).select("request_id", change("changed_matched_path"))
    if in_scope is not None:
        hits = hits.union(base.join(F.broadcast(seen), newer & in_scope).select("request_id", change("changed_search_scope")))  # the newest generations only
    elif "scope" in base.columns:
        below = seen.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("scope"))
        # requests of one scope and generation meet the same first change
        asked = base.select("scope", "recorded_generation").distinct().join(below, "scope").where(newer)
        first_ = asked.groupBy("scope", "recorded_generation").agg(F.min(change("changed_search_scope")).alias("c"))
        hits = hits.union(base.join(first_, ["scope", "recorded_generation"]).select("request_id", "c"))
    hits = hits.groupBy("request_id").agg(F.min("c").alias("c"))
    j = base.join(hits, "request_id", "left")
    why = (
        F.when(F.col("epoch_") != F.col("recorded_epoch"), "context_invalidated")
        .when(F.col("generation_") < F.col("recorded_generation"), "generation_reset")
        .when(F.col("generation_") == F.col("recorded_generation"), "unchanged")
        .when(F.col("earliest") > F.col("recorded_generation") + 1, "journal_overflow")
        .when(F.col("c").isNotNull(), F.col("c.why"))
        .otherwise("unchanged")
    )
    out = j.select("request_id", why.alias("reason"), F.col("c.path").alias("p"))
    changed = F.when(F.col("reason").isin("changed_matched_path", "changed_search_scope"), F.col("p"))
    return out.select("request_id", (F.col("reason") == "unchanged").alias("fresh"), "reason", changed.alias("changed_path"))


def epochs(events: DataFrame) -> DataFrame:
    """``events`` plus epoch: how many session starts and compactions came so far, of all
    sessions. Counted by second, and seconds by day, so no task sees more than a second's events."""
    starts = F.when(F.col("event").isin("session_start", "pre_compact"), 1).otherwise(0).cast("long")
    return running_sum(events, F.date_trunc("second", "ts"), ["ts", "seq"], starts, "epoch", coarse=F.date_trunc("day", "__k"))


def search_memo(uses: DataFrame, n: int = 256) -> DataFrame:
    """What a session remembers of its searches (session_id, seq, key): the ``n`` used last,
    with search_id (numbered by first use) and last_use."""
    per = uses.groupBy("session_id", "key").agg(F.min("seq").alias("first_use"), F.max("seq").alias("last_use"))
    session = Window.partitionBy("session_id")
    named = per.withColumn("search_id", F.format_string("search-%06d", F.row_number().over(session.orderBy("first_use", "key"))))
    kept = named.withColumn("__n", F.row_number().over(session.orderBy(F.desc("last_use"), "key"))).where(F.col("__n") <= n)
    return kept.select("session_id", "search_id", "key", "last_use")
