"""Benchmark and retrieval-quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(sorted_values: Column, p: float) -> Column:
    """Nearest rank round(p (n - 1)) of a sorted array; 0 if it is empty."""
    n = F.size(sorted_values)
    at = F.floor(F.lit(p) * (n - 1) + 0.5).cast("int") + 1
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(sorted_values, at))


#: The sketch's rank error is a group's rows divided by this.
ACCURACY = 10_000
#: Tasks that the rows of one group are dealt to.
SPREAD = 32


def percentiles(samples: DataFrame, keys: list[str], value: str, ps: dict[str, float] | None = None) -> DataFrame:
    """Exact nearest-rank percentiles, mean, min and max of each group. A sketch bounds each
    wanted value from below and above; rows below are counted, and only the distinct values
    between the bounds, a few in ACCURACY of a group's rows, are put in order."""
    ps = ps or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    names, slack = [f"__k{i}" for i in range(len(keys))], 4 / ACCURACY
    rows = samples.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("__v"))
    near = [x for p in ps.values() for x in (max(p - slack, 0.0), min(p + slack, 1.0))]
    about = rows.groupBy(*names).agg(F.percentile_approx("__v", near, ACCURACY).alias("__q"), F.count("*").alias("__n"), F.avg("__v").alias("mean"), F.min("__v").alias("min"), F.max("__v").alias("max"))
    few = F.col("__n") <= 4 * ACCURACY  # a rank is less than the slack: all values are put in order
    wanted = F.array(*[
        F.struct(F.lit(n).alias("name"), F.floor(F.lit(p) * (F.col("__n") - 1) + 0.5).alias("rank"), F.when(few, F.col("min")).otherwise(F.get("__q", 2 * i)).alias("lo"), F.when(few, F.col("max")).otherwise(F.get("__q", 2 * i + 1)).alias("hi"))
        for i, (n, p) in enumerate(ps.items())
    ])
    about = about.withColumn("__w", wanted).drop("__q", "__n")
    bounds = about.select(*[F.col(n).alias(f"{n}_") for n in names], "__w")
    # a group's values meet its bounds in SPREAD tasks, by the task that read them: few groups may hold all rows
    dealt = rows.withColumn("__s", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    each = bounds.withColumn("__s_", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = dealt.join(each, [F.col("__s") == F.col("__s_"), *[F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]]) if names else rows.join(bounds, F.lit(True))
    met = met.select(*names, "__v", F.explode(F.filter("__w", lambda w: F.col("__v") <= w["hi"])).alias("__w"))
    # all that is below the bounds counts as one value
    met = met.withColumn("__v", F.when(F.col("__v") >= F.col("__w.lo"), F.col("__v"))).groupBy(*names, "__w", "__v").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*names, "__w").orderBy(F.col("__v").asc_nulls_first()))
    found = met.withColumn("__upto", before).where((F.col("__w.rank") < F.col("__upto")) & (F.col("__w.rank") >= F.col("__upto") - F.col("__c")))
    found = found.groupBy(*names).agg(*[F.max(F.when(F.col("__w.name") == n, F.col("__v"))).alias(n) for n in ps])
    on = [F.col(f"f.{n}").eqNullSafe(F.col(f"a.{n}")) for n in names]
    joined = found.alias("f").join(about.drop("__w").alias("a"), on if on else F.lit(True))
    return joined.select(*[F.col(f"f.{n}").alias(k) for n, k in zip(names, keys)], *[F.col(f"f.{n}") for n in ps], "mean", "min", "max")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side alone, as sets, with side ('left' or 'right')."""
    return left.subtract(right).withColumn("side", F.lit("left")).union(right.subtract(left).withColumn("side", F.lit("right")))


def retrieval(ranked: DataFrame, oracle: DataFrame) -> DataFrame:
    """Per scenario: hit_at_1, hit_at_4, mrr, coverage, precision, misleading_top1.

    ranked: scenario, rank (from 1), path. oracle: scenario, path, label (required, helpful, bad).
    """
    j = ranked.join(oracle, ["scenario", "path"], "left")
    is_ = lambda x: F.coalesce(F.col("label") == x, F.lit(False))
    useful = is_("required") | is_("helpful")
    got = j.groupBy("scenario").agg(
        F.max((F.col("rank") == 1) & is_("required")).alias("hit_at_1"), F.max((F.col("rank") <= 4) & is_("required")).alias("hit_at_4"),
        F.coalesce(1.0 / F.min(F.when(is_("required"), F.col("rank"))), F.lit(0.0)).alias("mrr"), F.countDistinct(F.when(useful, F.col("path"))).alias("covered"),
        F.countDistinct("path").alias("n"), F.max((F.col("rank") == 1) & is_("bad")).alias("misleading_top1"),
    )
    want = oracle.where("label != 'bad'").groupBy("scenario").agg(F.countDistinct("path", "label").alias("wanted"))
    out = got.join(want, "scenario", "left")
    return out.select("scenario", "hit_at_1", "hit_at_4", "mrr", (F.col("covered") / F.greatest(F.coalesce("wanted", F.lit(0)), F.lit(1))).alias("coverage"), (F.col("covered") / F.col("n")).alias("precision"), "misleading_top1")


def verdict(misleading: Column, hit_at_4: Column, token_reduction: Column, call_reduction: Column, more_tokens: Column) -> Column:
    return F.when(misleading, "hurts").when(hit_at_4 & ((token_reduction > 0.15) | (call_reduction >= 1)), "helps").when(~hit_at_4 & more_tokens, "hurts").otherwise("neutral")


def validation_summary(runs: DataFrame, group: str | None = None) -> DataFrame:
    """Measured runs (verdict, hit_at_1, hit_at_4, token_reduction_ratio, tool_call_reduction) as one
    row, or one for each value of ``group`` and one, total true, for all: total_runs, helps, neutral,
    hurts, hit rates and averages. What a run lacks counts as no hit and as no reduction; without
    runs all is 0. One pass, summed before the shuffle."""
    keys = [group] if group else []
    grouped = runs.rollup(*keys) if group else runs.groupBy()
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), F.lit(0.0))
    out = grouped.agg(
        (F.grouping(group) == 1 if group else F.lit(True)).alias("total"), F.count("*").alias("total_runs"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("helps", "neutral", "hurts")],
        mean(F.col("hit_at_1")).alias("hit_at_1_rate"), mean(F.col("hit_at_4")).alias("hit_at_4_rate"), mean(F.col("token_reduction_ratio")).alias("avg_token_reduction_ratio"), mean(F.col("tool_call_reduction")).alias("avg_tool_call_reduction"),
    )
    return out if group else out.drop("total")


def replay_totals(runs: DataFrame) -> DataFrame:
    """eligible, saved and saved_ratio of replayed runs (eligible_tokens, tokens_saved, false_negatives)."""
    t = runs.agg(F.sum("eligible_tokens").alias("eligible"), F.sum("tokens_saved").alias("saved"), F.sum("false_negatives").alias("false_negatives"))
    return t.withColumn("saved_ratio", F.when(F.col("eligible") > 0, F.col("saved") / F.col("eligible")).otherwise(0.0))


def reusable_searches(searches: DataFrame, edits: DataFrame) -> DataFrame:
    """Repeated searches (session_id, turn, key, epoch, matched_paths) with previous_turn and
    reusable: same epoch and no path that the previous one matched was edited since."""
    w = Window.partitionBy("session_id", "key").orderBy("turn")
    prev = searches.withColumns({"previous_turn": F.lag("turn").over(w), "pe": F.lag("epoch").over(w), "pm": F.lag("matched_paths").over(w)}).where("previous_turn is not null")
    # the last edit before each search, of each path that the previous one matched: both kinds of
    # rows in one window, instead of all edits of a session met with all its searches
    probes = prev.select("session_id", "turn", F.explode("pm").alias("path"), "previous_turn").distinct()
    both = probes.unionByName(edits.select("session_id", "turn", "path", F.lit(None).cast("long").alias("previous_turn"), F.lit(True).alias("edit")), allowMissingColumns=True)
    before = Window.partitionBy("session_id", "path").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("edited", F.max(F.when(F.col("edit"), F.col("turn"))).over(before)).where(F.col("edit").isNull() & (F.col("edited") > F.col("previous_turn")))
    touched = seen.select("session_id", "turn", "previous_turn", F.lit(True).alias("hit")).distinct()
    j = prev.join(touched, ["session_id", "turn", "previous_turn"], "left")
    return j.select("session_id", "turn", "key", "previous_turn", ((F.col("pe") == F.col("epoch")) & F.col("hit").isNull()).alias("reusable"))


def session_rollup(queries: DataFrame) -> DataFrame:
    """engine, queries, total_matches of a session's query rows (engine, matches)."""
    return queries.groupBy("engine").agg(F.count("*").alias("queries"), F.sum("matches").alias("total_matches"))


def batch_rollup(hits: DataFrame, queries: list[str], build_units: float) -> DataFrame:
    """query, matches, files and amortised of each search of a batch (``hits`` with query and
    relative_path): what the batch cost, ``build_units``, is shared evenly, as its scans are."""
    named = hits.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    per = hits.groupBy("query", "relative_path").agg(F.count("*").alias("n")).groupBy("query").agg(F.sum("n").alias("matches"), F.count("*").alias("files"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("matches", "files")}
    return named.join(F.broadcast(per), "query", "left").withColumns(zero).withColumn("amortised", F.lit(build_units / max(len(queries), 1)))  # a row a query
