"""Snapshots as bundles that can be carried to another workspace and are checked on the way.

A bundle is a folder: tables/<name> in Parquet, checksums (table, bucket, rows, sha256) in Parquet,
and manifest.json, which comes last, by one rename; a folder without it is no bundle. A row's digest
is that of its canonical JSON; equal rows are counted, a bucket's digest is that of its rows' digests in
order, and a table's root is that of its buckets'. So the digests do not depend on files, partitions
or the order of rows, no task holds more than a bucket, and a difference is traced to its buckets.

An import copies the tables beside the snapshots, checks the copy, and only then gives it its
name, by one rename that fails if the name is taken: the next of id, id-1, id-2, ... is tried. A lost
importer leaves a folder that starts with a dot and is no snapshot.
"""

from __future__ import annotations

import hashlib
import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .segments import _fs, remove

SCHEMA_VERSION = 1
#: About how many different rows share a bucket.
BUCKET_ROWS = 4096
#: Most buckets of a table: the driver reads one row of each where it checks a bundle.
BUCKETS = 1 << 16


class BundleError(ValueError):
    """What is wrong with a bundle, and where."""


def row_digest(table: DataFrame) -> Column:
    """Over the columns in order of their names, nulls written out, times in UTC."""
    names = sorted(table.columns)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false", "timeZone": "UTC"}), 256)


def bucket_digests(table: DataFrame, buckets: int) -> DataFrame:
    """bucket, rows and sha256 of a table cut into ``buckets`` by its rows' digests. A row that
    is repeated any number of times is one digest with its count, summed before the shuffle."""
    digests = table.select(row_digest(table).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % buckets
    lines = F.concat_ws(" ", "digest", F.col("n").cast("string"))
    one = digests.groupBy(place.alias("bucket")).agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(lines)).alias("lines"))
    return one.select("bucket", "rows", F.sha2(F.concat_ws("\n", "lines"), 256).alias("sha256"))


def _buckets(rows: int) -> int:
    return min(BUCKETS, 1 << max(0, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))))


def _root(sums: list[tuple[int, str]]) -> str:
    return hashlib.sha256("\n".join(f"{b} {s}" for b, s in sorted(sums)).encode()).hexdigest()


def _write_json(spark: SparkSession, path: str, record: dict) -> None:
    """The file appears whole or not at all."""
    fs, temporary = _fs(spark, f"{path.rpartition('/')[0]}/.{random.getrandbits(60):x}.json")
    out = fs.create(temporary, True)
    out.write(json.dumps(record, indent=2, sort_keys=True).encode())
    out.close()
    _rename(spark, str(temporary), path)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Fails with FileAlreadyExists if there is something at ``target``."""
    options = getattr(spark._jvm.org.apache.hadoop.fs.Options, "Rename")
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE
    (fs, a), (_, b) = _fs(spark, source), _fs(spark, target)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(b).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(a), fs.makeQualified(b), none)


def manifest(spark: SparkSession, folder: str) -> dict:
    fs, target = _fs(spark, f"{folder}/manifest.json")
    if not fs.exists(target):
        raise BundleError(f"no manifest in {folder}")
    stream = fs.open(target)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    if found.get("schema_version") != SCHEMA_VERSION:
        raise BundleError(f"unsupported snapshot schema version {found.get('schema_version')}")
    return found


def export(tables: dict[str, DataFrame], snapshot_id: str, folder: str) -> dict:
    """Writes a bundle of a snapshot's tables and returns its manifest. What is described is
    what was written: digests are taken from the written tables."""
    spark = next(iter(tables.values())).sparkSession
    if _fs(spark, folder)[0].exists(_fs(spark, f"{folder}/manifest.json")[1]):
        raise BundleError(f"{folder} is a bundle already")
    about, sums = {}, None
    for name, table in sorted(tables.items()):
        table.write.mode("overwrite").parquet(f"{folder}/tables/{name}")
        written = spark.read.schema(table.schema).parquet(f"{folder}/tables/{name}")
        rows = written.count()
        about[name] = {"rows": rows, "buckets": _buckets(rows), "schema": table.schema.json()}
        part = bucket_digests(written, about[name]["buckets"]).select(F.lit(name).alias("table"), "*")
        sums = part if sums is None else sums.unionByName(part)
    sums.write.mode("overwrite").parquet(f"{folder}/checksums")
    for name, found in _sums(spark.read.parquet(f"{folder}/checksums"), about).items():
        about[name]["root"] = _root([(b, s) for b, (_, s) in found.items()])
    record = {"schema_version": SCHEMA_VERSION, "snapshot_id": snapshot_id, "tables": about}
    _write_json(spark, f"{folder}/manifest.json", record)
    return record


def _sums(checksums: DataFrame, tables: dict) -> dict[str, dict[int, tuple[int, str]]]:
    """Rows and digest of each bucket, by table: at most BUCKETS a table."""
    out = {name: {} for name in tables}
    for r in checksums.select("table", "bucket", "rows", "sha256").toLocalIterator():
        out.setdefault(r["table"], {})[r["bucket"]] = (r["rows"], r["sha256"])
    return out


def problems(spark: SparkSession, folder: str, record: dict) -> DataFrame:
    """table, bucket, expected and found rows and digests of every bucket of ``folder`` that is
    not as its checksums say."""
    found = None
    for name, about in sorted(record["tables"].items()):
        table = spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).parquet(f"{folder}/tables/{name}")
        part = bucket_digests(table, about["buckets"]).select(F.lit(name).alias("table"), "bucket", F.col("rows").alias("found_rows"), F.col("sha256").alias("found"))
        found = part if found is None else found.unionByName(part)
    expected = spark.read.schema("table string, bucket long, rows long, sha256 string").parquet(f"{folder}/checksums")
    both = expected.withColumnsRenamed({"rows": "expected_rows", "sha256": "expected"}).join(found, ["table", "bucket"], "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")) | ~F.col("expected_rows").eqNullSafe(F.col("found_rows")))


def verify(spark: SparkSession, folder: str) -> dict:
    """The manifest of a bundle that is whole; BundleError otherwise."""
    record = manifest(spark, folder)
    checksums = spark.read.schema("table string, bucket long, rows long, sha256 string").parquet(f"{folder}/checksums")
    sums = _sums(checksums, record["tables"])
    for name in sorted(sums):
        about = record["tables"].get(name)
        if about is None or _root([(b, s) for b, (_, s) in sums[name].items()]) != about["root"]:
            raise BundleError(f"checksums of {name} are not those of the manifest")
    wrong = problems(spark, folder, record).orderBy("table", "bucket").first()
    if wrong:
        raise BundleError(f"checksum mismatch for {wrong['table']}, bucket {wrong['bucket']}")
    return record


def _copy(spark: SparkSession, source: str, target: str, record: dict) -> None:
    for name, about in record["tables"].items():
        table = spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).parquet(f"{source}/tables/{name}")
        table.write.parquet(f"{target}/tables/{name}")
    spark.read.parquet(f"{source}/checksums").write.parquet(f"{target}/checksums")


def load(spark: SparkSession, folder: str, snapshots: str) -> str:
    """Imports a bundle below ``snapshots`` and returns the id that it has there. Nothing is
    there under that id before all of it has been checked; a bundle that fails leaves nothing."""
    record = manifest(spark, folder)
    staged = f"{snapshots}/.import-{random.getrandbits(60):x}"
    try:
        _copy(spark, folder, staged, record)
        _write_json(spark, f"{staged}/manifest.json", record)
        verify(spark, staged)  # the copy, not what may change behind it
        number, wanted = 0, record["snapshot_id"]
        while True:
            name = f"{wanted}-{number}" if number else wanted
            if name != record["snapshot_id"]:
                record = record | {"snapshot_id": name}
                remove(spark, f"{staged}/manifest.json")
                _write_json(spark, f"{staged}/manifest.json", record)
            try:
                _rename(spark, staged, f"{snapshots}/{name}")
                return name
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
            number += 1
    except BaseException:
        remove(spark, staged)
        raise


def open_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an imported snapshot or of a bundle."""
    about = manifest(spark, folder)["tables"]
    return {name: spark.read.schema(StructType.fromJson(json.loads(a["schema"]))).parquet(f"{folder}/tables/{name}") for name, a in about.items()}
