"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from loomdex import queries
from loomdex.operators import index as ix
from loomdex.operators import search as se
from loomdex.plans.request import SearchRequest
from loomdex.session import get_spark
from loomdex.sources import corpora

CASES = {
    "literal_selective": SearchRequest(pattern="thanedble"),
    "literal_rare": SearchRequest(pattern="porci"),
    "literal_moderate": SearchRequest(pattern="heit "),
    "literal_high": SearchRequest(pattern="tion"),
    "literal_no_match": SearchRequest(pattern="zzqqxx"),
    "regex_anchor": SearchRequest(pattern=r"\blicens\w+", kind="regex"),
    "regex_weak": SearchRequest(pattern="[0-9]+[.]", kind="regex"),
    "regex_no_match": SearchRequest(pattern="zzqq[a-z]xx", kind="regex"),
    "multi_or": SearchRequest(pattern="license|réeaux|achlich", kind="regex"),
    "path_all": SearchRequest(kind="path"),
    "path_substring": SearchRequest(pattern="src1/", kind="path"),
    "path_plus_content": SearchRequest(pattern="license", path_prefixes=("src1",)),
}
FRAMES = ("index_change_classify", "frecency_scores", "memo_session_totals", "reuse_check", "working_set", "bench_percentiles")


def timed(run, times: int = 3) -> float:
    took = []
    for _ in range(times):
        t = time.perf_counter()
        run()
        took.append(time.perf_counter() - t)
    return round(statistics.median(took), 4)


class Told(dict):
    """Says each figure on stderr as it comes."""

    def __setitem__(self, name: str, seconds: float) -> None:
        super().__setitem__(name, seconds)
        print(name, seconds, file=sys.stderr, flush=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="loomdex-bench-")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"{work}/warehouse"}
    spark = get_spark("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    out = Told()
    out["index_build"] = timed(lambda: ix.build(corpora.documents(spark, sf_dir), f"{work}/index"), 2)
    index = ix.load(spark, f"{work}/index")
    for name, request in CASES.items():
        out[name] = timed(lambda r=request: se.search(index, r).count())
        if request.kind != "path":
            if name in ("literal_rare", "literal_selective"):  # by the index, though a scan of so little is faster
                out[f"{name}_indexed"] = timed(lambda r=request: se.search(index, r, "indexed").count())
            out[f"{name}_scan"] = timed(lambda r=request: se.search(index, r, "direct_scan").count())
    session = [r for n, r in CASES.items() if n not in ("regex_weak", "literal_no_match", "regex_no_match") and r.kind != "path"]
    twenty = {f"q{i}": session[i % len(session)] for i in range(20)}
    out["session_20"] = timed(lambda: se.search_many(index, twenty).groupBy("query").count().collect())
    out["session_20_one_by_one"] = timed(lambda: [se.search(index, r).count() for r in twenty.values()], 1)
    for name in FRAMES:
        out[name] = timed(lambda f=queries.QUERIES[name]: f(spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    sys.exit(main())
