"""Mixing sources to target weights by Pfair scheduling. DataFrame and SQL functions only.

Each source's documents form blocks of ``block_rows``. With integer weights e (sum W) the
k-th block of a source has the window [floor((k-1) W / e), ceil(k W / e)) of block slots,
and in each slot the released block with the earliest deadline goes next. On one output
this meets every deadline (Baruah et al.), so at any slot t of a phase a source has had
t e / W blocks with a deviation of less than one.

The schedule repeats after W slots, so one template of W slots is computed (an SQL
``aggregate``) and every block's slot follows from its number: nothing is walked in order.
When a source runs out, its last block ends the phase; the rest go on with their weights
among themselves. There are as many phases as sources.

Within a source, documents come in the order of md5(doc_id), a fixed shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import dealt, running
from .scratch import Scratch, broadcast_if_small, fresh

ROWS_A_BUCKET = 20_000


def tempered_weights(counts: list[int], alpha: float, resolution: int) -> list[int]:
    """Integer weights in proportion to count ** alpha, of sum about ``resolution``; 1 at least."""
    power = [math.pow(c, alpha) for c in counts]
    total = sum(power)
    return [1 + math.floor(resolution * p / total) for p in power]


def template(spark: SparkSession, weights: list[int]) -> list[int]:
    """Source number in each of the sum(weights) slots of one period."""
    e = ", ".join(f"{w}L" for w in weights)
    n, w = len(weights), sum(weights)
    row = spark.sql(
        f"""
        SELECT aggregate(
          sequence(0L, {w - 1}L),
          named_struct('next', transform(array({e}), x -> 1L), 'out', cast(array() AS array<int>)),
          (acc, t) -> transform(
            array(array_min(transform(array({e}), (x, i) ->
              CASE WHEN acc.next[i] <= x AND (acc.next[i] - 1) * {w} div x <= t
                   THEN ((acc.next[i] * {w} + x - 1) div x) * {n} + i END))),
            p -> named_struct(
              'next', transform(acc.next, (k, i) -> CASE WHEN i = p % {n} THEN k + 1 ELSE k END),
              'out', concat(acc.out, array(cast(p % {n} AS int)))))[0],
          acc -> acc.out) AS slots
        """
    ).first()
    return list(row["slots"])


def plan(spark: SparkSession, weights: list[int], blocks: list[int]) -> list[dict]:
    """For each source and phase: first block, weight, first slot, period, places in it."""
    left, used, base, rows = list(blocks), [0] * len(blocks), 0, []
    active = [i for i, n in enumerate(blocks) if n > 0]
    phase = 0
    while active:
        divisor = math.gcd(*[weights[i] for i in active])
        e = {i: weights[i] // divisor for i in active}
        slots = template(spark, [e[i] for i in active]) if len(active) > 1 else [0]
        if len(active) == 1:
            e = {active[0]: 1}
        places = {i: [] for i in active}
        for at, k in enumerate(slots):
            places[active[k]].append(at)
        w = len(slots)
        end = min((left[i] - 1) // e[i] * w + places[i][(left[i] - 1) % e[i]] + 1 for i in active)
        for i in active:
            rows.append({"source_no": i, "phase": phase, "first": used[i], "weight": e[i], "base": base, "period": w, "places": places[i]})
            had = end // w * e[i] + sum(p < end % w for p in places[i])
            used[i] += had
            left[i] -= had
        base += end
        phase += 1
        active = [i for i in active if left[i] > 0]
    return rows


def mix(docs: DataFrame, weights: dict | None = None, default_weight: int = 1, alpha: float = 0.5, resolution: int = 1000, block_rows: int = 4, tie: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, source, any others) plus mix_block long (number within the source),
    mix_phase int, mix_slot long (of the block) and mix_position long (gapless from 0).

    ``weights`` gives an integer for each source, ``default_weight`` for those it lacks;
    without it weights follow count ** alpha. A null source is a source of its own. Every
    row is kept, repeated ones too; rows with the same doc_id are ordered by ``tie``, which is
    a hash of all columns if not given. An empty table stays empty. The driver holds one row
    for each source (sources are assumed to be few: the plan has sources x sources rows at
    most). Columns of ``docs`` named like the new ones are replaced; others may have any
    name, as the rows travel as one struct beside the helper columns. ``docs`` is written twice
    on the way, in the order of a source's rows and with the result, so give it narrow.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_phase", "mix_slot", "mix_position")
    counts = sorted(((r["source"], r["count"]) for r in docs.groupBy("source").count().collect()), key=lambda r: (r[0] is not None, r[0]))
    total = sum(n for _, n in counts)
    names = [s for s, _ in counts]
    if weights is None:
        e = tempered_weights([n for _, n in counts], alpha, resolution)
    else:
        e = [int(weights.get(s, default_weight)) for s in names]
        if any(x < 1 for x in e):
            raise ValueError("weights are whole numbers of 1 at least")
    rows = plan(spark, e, [-(-n // block_rows) for _, n in counts])
    last = {i: max((r["phase"] for r in rows if r["source_no"] == i), default=0) for i in range(len(names))}
    lack = [(last[i], (-n) % block_rows) for i, (_, n) in enumerate(counts)]  # rows that a source's last block lacks
    kind = docs.schema["source"].dataType.simpleString() if "source" in docs.columns else "string"
    schema = f"__s {kind}, __phase int, __first long, __until long, __e long, __base long, __w long, __places array<int>, __lack long"
    data = []
    for r in rows:
        later = [x["first"] for x in rows if x["source_no"] == r["source_no"] and x["phase"] > r["phase"]]
        data.append((names[r["source_no"]], r["phase"], r["first"], min(later, default=1 << 60), r["weight"], r["base"], r["period"], r["places"], sum(x for p, x in lack if p < r["phase"])))
    phases = spark.createDataFrame(data, schema)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    along = ["__h", "doc_id", "__tie", "__row"]
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", key.alias("__h"), (F.xxhash64(*docs.columns) if tie is None else tie).alias("__tie"), F.monotonically_increasing_id().alias("__row"))
    with Scratch(spark, "mixing") as scratch:
        ranked = dealt(named, ["source", *along], total, ROWS_A_BUCKET, scratch, "ranked")
        ranked = running(ranked, ["source"], "__b", along, {"__rank": F.lit(1).cast("long")})
        return scratch.keep(_positions(ranked, phases, block_rows))


def _positions(ranked: DataFrame, phases: DataFrame, block_rows: int) -> DataFrame:
    """The slot and position of each row from its rank within its source; ``row`` holds its columns."""
    block = F.expr(f"__rank div {block_rows}")
    ranked = ranked.withColumn("mix_block", block)
    found = ranked.join(broadcast_if_small(phases), ranked["source"].eqNullSafe(phases["__s"]) & (F.col("mix_block") >= F.col("__first")) & (F.col("mix_block") < F.col("__until")))
    nth = F.col("mix_block") - F.col("__first")
    slot = F.expr("__base + (mix_block - __first) div __e * __w") + F.element_at("__places", ((nth % F.col("__e")) + 1).cast("int"))
    found = found.withColumn("mix_slot", slot.cast("long"))
    position = F.col("mix_slot") * block_rows + F.col("__rank") % block_rows - F.col("__lack")
    return found.select("row.*", "mix_block", F.col("__phase").alias("mix_phase"), "mix_slot", position.cast("long").alias("mix_position"))
