"""Reports of measured runs, as files that people and scripts read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import validation_summary


def _percent(c: str) -> Column:
    return F.format_string("%.1f%%", F.col(c) * 100)


def summary_lines(runs: DataFrame) -> DataFrame:
    """ordinal, id and line of the Markdown summary: totals, then a line for each run by its id."""
    c = F.concat
    text = lambda n: F.col(n).cast("string")
    head = validation_summary(runs).select(F.posexplode(F.array(
        F.lit("# Context Pack Validation Summary"), F.lit(""), c(F.lit("- Total runs: "), text("total_runs")), c(F.lit("- Helps / neutral / hurts: "), F.concat_ws(" / ", text("helps"), text("neutral"), text("hurts"))),
        c(F.lit("- Hit@1: "), _percent("hit_at_1_rate")), c(F.lit("- Hit@4: "), _percent("hit_at_4_rate")), c(F.lit("- Average token reduction: "), _percent("avg_token_reduction_ratio")),
        c(F.lit("- Average tool-call reduction: "), F.format_string("%.2f", "avg_tool_call_reduction")), F.lit(""), F.lit("## Runs"),
    )).alias("ordinal", "line")).select("ordinal", F.lit("").alias("id"), "line")
    hit = F.when(F.coalesce("hit_at_4", F.lit(False)), "True").otherwise("False")
    some = lambda n: F.coalesce(text(n), F.lit(""))
    line = c(F.lit("- "), some("id"), F.lit(" ("), some("group"), F.lit("): "), some("verdict"), F.lit(" hit@4="), hit, F.lit(" pack_tokens="), some("pack_tokens"), F.lit(" baseline_tokens="), some("baseline_tokens"))
    return head.union(runs.select(F.lit(1000), some("id"), line))


def write(runs: DataFrame, folder: str) -> None:
    """Below ``folder``: report.csv and report.json (all columns of ``runs``, by id), aggregate.json (the
    totals) and groups.json (by group), and summary.md. Each is a folder of files in order, as
    Spark writes them; runs are sorted by ranges and never meet in one task."""
    by_id = runs.orderBy("id")
    by_id.write.mode("overwrite").option("header", True).csv(f"{folder}/report.csv")
    by_id.write.mode("overwrite").json(f"{folder}/report.json")
    validation_summary(runs).coalesce(1).write.mode("overwrite").json(f"{folder}/aggregate.json")  # one row
    validation_summary(runs, "group").orderBy("total", "group").write.mode("overwrite").json(f"{folder}/groups.json")
    summary_lines(runs).orderBy("ordinal", "id", "line").select("line").write.mode("overwrite").text(f"{folder}/summary.md")
