"""Validation totals by group and the files that tell of them."""

import json

import pytest

from loomdex.functions.text import normalize_line_text
from loomdex.operators import analytics
from loomdex.sources import reports

SCHEMA = "id string, group string, verdict string, hit_at_1 boolean, hit_at_4 boolean, token_reduction_ratio double, tool_call_reduction int, pack_tokens long, baseline_tokens long"
RUNS = [("r2", "a", "helps", True, True, 0.5, 2, 10, 20), ("r1", "a", "hurts", False, None, None, -1, 30, 20), ("r3", None, "neutral", None, True, 0.25, None, 5, None)]


def _lines(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


def test_totals_by_group(spark):
    found = {(r.group, r.total): r for r in analytics.validation_summary(spark.createDataFrame(RUNS, SCHEMA), "group").collect()}
    assert set(found) == {("a", False), (None, False), (None, True)}  # runs of no group are not the total
    a, total = found["a", False], found[None, True]
    assert (a.total_runs, a.helps, a.neutral, a.hurts, a.hit_at_1_rate, a.hit_at_4_rate, a.avg_token_reduction_ratio, a.avg_tool_call_reduction) == (2, 1, 0, 1, 0.5, 0.5, 0.25, 0.5)
    assert (total.total_runs, total.hit_at_4_rate, total.avg_token_reduction_ratio) == (3, pytest.approx(2 / 3), 0.25)
    none = analytics.validation_summary(spark.createDataFrame([], SCHEMA)).first()
    assert (none.total_runs, none.hit_at_1_rate, none.avg_token_reduction_ratio) == (0, 0.0, 0.0)


def test_files(spark, tmp_path):
    reports.write(spark.createDataFrame(RUNS, SCHEMA), str(tmp_path))
    md = _lines(tmp_path / "summary.md")
    assert md[:4] == ["# Context Pack Validation Summary", "", "- Total runs: 3", "- Helps / neutral / hurts: 1 / 1 / 1"] and "- Hit@4: 66.7%" in md
    assert md[-3:] == ["- r1 (a): hurts hit@4=False pack_tokens=30 baseline_tokens=20", "- r2 (a): helps hit@4=True pack_tokens=10 baseline_tokens=20", "- r3 (): neutral hit@4=True pack_tokens=5 baseline_tokens="]
    assert [json.loads(x)["id"] for x in _lines(tmp_path / "report.json")] == ["r1", "r2", "r3"]
    assert json.loads(_lines(tmp_path / "aggregate.json")[0])["helps"] == 1 and len(_lines(tmp_path / "groups.json")) == 3
    assert _lines(tmp_path / "report.csv")[0].startswith("id,group,verdict")
    reports.write(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert "- Total runs: 0" in _lines(tmp_path / "summary.md")


def test_line_text(spark):
    lines = spark.createDataFrame([("a\r\r",), ("\rb ",), (None,)], "t string")
    assert [r[0] for r in lines.select(normalize_line_text(lines["t"])).collect()] == ["a", "\rb ", None]
