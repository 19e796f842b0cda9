"""Bundles: round trip, tampering, collisions and writers that are lost."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from loomdex.operators import bundle


@pytest.fixture
def tables(spark):
    files = spark.range(500).select(F.concat(F.lit("f/"), "id").alias("path"), F.when(F.col("id") % 7 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("sha"))
    log = spark.range(900).select((F.col("id") % 30).alias("entry_id"), F.lit('{"query": "é"}').alias("payload"), F.timestamp_seconds(F.col("id") % 3).alias("ts"))
    return {"files": files, "action_log": log, "searches": spark.createDataFrame([], "search_id string, n int")}


def _rows(table):
    return sorted(map(str, table.collect()))


def test_round_trip_and_names_that_are_taken(spark, tables, tmp_path):
    out, snaps = f"file://{tmp_path}/bundle", f"file://{tmp_path}/snapshots"
    record = bundle.export(tables, "snap", out)
    assert {n: t["rows"] for n, t in record["tables"].items()} == {"files": 500, "action_log": 900, "searches": 0}
    assert [bundle.load(spark, out, snaps) for _ in range(3)] == ["snap", "snap-1", "snap-2"]
    for name in ("snap", "snap-2"):
        found = bundle.open_tables(spark, f"{snaps}/{name}")
        assert {n: _rows(t) for n, t in found.items()} == {n: _rows(t) for n, t in tables.items()}
        assert bundle.verify(spark, f"{snaps}/{name}")["snapshot_id"] == name
    assert sorted(os.listdir(tmp_path / "snapshots")) == ["snap", "snap-1", "snap-2"]
    with pytest.raises(bundle.BundleError, match="already"):
        bundle.export(tables, "snap", out)


def test_digests_depend_on_rows_alone(spark, tables):
    log = tables["action_log"]
    digests = lambda t: _rows(bundle.bucket_digests(t, 8))
    assert digests(log) == digests(log.orderBy(F.desc("entry_id")).repartition(7).select("ts", "payload", "entry_id"))
    assert digests(log) != digests(log.union(log.limit(1))) and digests(log) != digests(log.withColumn("payload", F.lit(None).cast("string")))
    one = bundle.bucket_digests(log.select(F.lit("same").alias("x")), 1).first()
    assert one["rows"] == 900


def test_bundles_that_are_not_whole(spark, tables, tmp_path):
    good = tmp_path / "good"
    bundle.export(tables, "snap", f"file://{good}")

    def spoil(name):
        shutil.copytree(good, tmp_path / name)
        return tmp_path / name, f"file://{tmp_path}/{name}"

    folder, url = spoil("row")  # one value of one row
    tables["files"].withColumn("sha", F.when(F.col("path") == "f/9", "x").otherwise(F.col("sha"))).write.mode("overwrite").parquet(f"{url}/tables/files")
    with pytest.raises(bundle.BundleError, match="checksum mismatch for files"):
        bundle.load(spark, url, f"file://{tmp_path}/s")
    folder, url = spoil("less")
    tables["action_log"].where("entry_id > 0").write.mode("overwrite").parquet(f"{url}/tables/action_log")
    with pytest.raises(bundle.BundleError, match="checksum mismatch for action_log"):
        bundle.load(spark, url, f"file://{tmp_path}/s")
    folder, url = spoil("sums")  # rows and their checksums, but not the root
    tables["files"].limit(3).write.mode("overwrite").parquet(f"{url}/tables/files")
    part = bundle.bucket_digests(spark.read.parquet(f"{url}/tables/files"), 1).select(F.lit("files").alias("table"), "*")
    part.union(bundle.bucket_digests(tables["action_log"], 1).select(F.lit("action_log").alias("table"), "*")).write.mode("overwrite").parquet(f"{url}/checksums")
    with pytest.raises(bundle.BundleError, match="not those of the manifest"):
        bundle.load(spark, url, f"file://{tmp_path}/s")
    folder, url = spoil("version")
    about = json.loads((folder / "manifest.json").read_text())
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    (folder / "manifest.json").write_text(json.dumps(about | {"schema_version": 9}))
    with pytest.raises(bundle.BundleError, match="version 9"):
        bundle.load(spark, url, f"file://{tmp_path}/s")
    folder, url = spoil("lost")  # an exporter that was lost before its manifest
    (folder / "manifest.json").unlink()
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(bundle.BundleError, match="no manifest"):
        bundle.load(spark, url, f"file://{tmp_path}/s")
    assert not (tmp_path / "s").exists() or os.listdir(tmp_path / "s") == []
    assert bundle.export(tables, "snap", url)["snapshot_id"] == "snap"  # the next exporter is not in its way


def test_an_importer_that_is_lost_leaves_no_snapshot(spark, tables, tmp_path, monkeypatch):
    out, snaps = f"file://{tmp_path}/bundle", f"file://{tmp_path}/snapshots"
    bundle.export(tables, "snap", out)

    def lost(*_):
        raise KeyboardInterrupt

    for step in ("_copy", "_write_json", "verify", "_rename"):
        with monkeypatch.context() as m:
            m.setattr(bundle, step, lost)
            with pytest.raises(KeyboardInterrupt):
                bundle.load(spark, out, snaps)
        assert not (tmp_path / "snapshots").exists() or os.listdir(tmp_path / "snapshots") == []
    assert bundle.load(spark, out, snaps) == "snap"
