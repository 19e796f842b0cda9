"""Versioned storage of an index: immutable segments, and a manifest that commits them.

Below its folder an index has docs/segment=N and postings/segment=N (written once, never
changed), gone/change=N (which rows of which segment no longer count), frequency/change=N (by
how much each document frequency rose or fell) and manifest/vK.json, which names all of these that
make up version K. A writer adds folders under new numbers and then puts its manifest in
place by one rename, which fails if that version is there already. So a reader sees one version
or the next, a writer that is lost leaves only folders that nothing names, and of two
writers one is told so (``Conflict``).

A change costs what it touches: its documents become a small segment with postings of their own,
the rows that it replaces are listed as gone, frequencies are summed. Segments of like size are
merged when there are FANOUT of them: postings are merged as they are, no text is read for
its trigrams again unless more than SENT rows are gone.

A row is known by (segment, doc_id); doc_ids must be unique among the documents that are live.
Postings hold trigrams of the contents and, from PATH on, those of the path. They are kept in blocks,
a trigram and some of its doc_ids: a sort or a shuffle moves a row for each block, not for each pair.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.trigrams import BLOCKS, blocks, unpacked, without

FORMAT, FANOUT, PATH = 3, 8, 1 << 24
KEY = ["segment", "doc_id"]
#: Bytes and rows of Parquet pages of the documents: about what a candidate costs to read.
PAGE, PAGE_ROWS = 1 << 16, 64
#: Rows that a broadcast may have (two or three words each).
SENT = 1_000_000


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


@dataclass(frozen=True)
class Segment:
    number: int
    docs: int
    gone: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    segments: tuple[Segment, ...] = ()
    gone: tuple[int, ...] = ()
    frequency: tuple[int, ...] = ()
    docs: int = 0
    bytes: int = 0
    postings: int = 0
    trigrams: int = 0
    built_secs: int = 0
    applied: int = -1  # the newest generation of a change feed that is in
    format: int = FORMAT


# ---------------------------------------------------------------- folders and manifests


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, target = _fs(spark, folder)
    return sorted(str(f.getPath().getName()) for f in fs.listStatus(target)) if fs.exists(target) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:-5]) for n in _names(spark, f"{path}/manifest") if n.startswith("v") and n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest version, or the one asked for."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        return None
    fs, target = _fs(spark, f"{path}/manifest/v{known[-1] if version is None else version:012d}.json")
    stream = fs.open(target)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    if found["format"] != FORMAT:
        raise ValueError(f"index format {found['format']} is not {FORMAT}")
    return Manifest(**found | {"segments": tuple(Segment(**s) for s in found["segments"]), "gone": tuple(found["gone"]), "frequency": tuple(found["frequency"])})


def commit(spark: SparkSession, path: str, new: Manifest) -> Manifest:
    jvm, final = spark._jvm, f"{path}/manifest/v{new.version:012d}.json"
    fs, temporary = _fs(spark, f"{path}/manifest/.{new.version}-{random.getrandbits(60):x}")
    out = fs.create(temporary, True)
    out.write(json.dumps(asdict(new)).encode())
    out.close()
    options = jvm.org.apache.hadoop.fs.Options
    none = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    none[0] = getattr(options, "Rename").NONE
    target = _fs(spark, final)[1]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {new.version} is there already") from e
        raise
    return new


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forget all but the newest versions, and folders that none of those names. A folder of a
    writer at work is one of these, so run it where no other writer is."""
    known = versions(spark, path)
    for old in known[:-keep]:
        remove(spark, f"{path}/manifest/v{old:012d}.json")
    kept = [manifest(spark, path, v) for v in known[-keep:]]
    segments = {f"segment={s.number}" for m in kept for s in m.segments}
    for table, live in (("docs", segments), ("postings", segments), ("gone", {f"change={n}" for m in kept for n in m.gone}), ("frequency", {f"change={n}" for m in kept for n in m.frequency})):
        for name in set(_names(spark, f"{path}/{table}")) - live:
            remove(spark, f"{path}/{table}/{name}")


def _write(rows, target: str, **options) -> None:
    rows.write.mode("overwrite").options(**options).parquet(target)


# ---------------------------------------------------------------- reading a version


@dataclass(frozen=True)
class Stored:
    """One version of an index on disk; a reader of it is not touched by later ones."""

    spark: SparkSession
    path: str
    manifest: Manifest

    def _read(self, table: str, names: list[str], schema) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/{n}" for n in names])

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.manifest.schema))

    def _segments(self, only: set[int] | None) -> list[str]:
        return [f"segment={s.number}" for s in self.manifest.segments if only is None or s.number in only]

    def docs(self, only: set[int] | None = None) -> DataFrame:
        """All rows of the segments, those that are gone too, with their segment."""
        return self._read("docs", self._segments(only), self.schema.add("segment", "long"))

    def blocks(self, only: set[int] | None = None) -> DataFrame:
        return self._read("postings", self._segments(only), f"{BLOCKS}, segment long")

    def postings(self, only: set[int] | None = None) -> DataFrame:
        return unpacked(self.blocks(only))

    def gone(self) -> DataFrame:
        names = [f"change={n}" for n in self.manifest.gone]
        return self._read("gone", names, "segment long, doc_id long, change long").select(*KEY)

    @property
    def n_gone(self) -> int:
        return sum(s.gone for s in self.manifest.segments)

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (segment, doc_id, ...) without those that are gone."""
        if not self.n_gone:
            return rows
        return rows.join(F.broadcast(self.gone()) if self.n_gone <= SENT else self.gone(), KEY, "left_anti").select(*rows.columns)

    def live_blocks(self, only: set[int] | None = None) -> DataFrame | None:
        """Blocks of the live documents; None if more than SENT rows of these segments are gone."""
        mine = {s.number: s.gone for s in self.manifest.segments if only is None or s.number in only}
        partly = {n for n, gone in mine.items() if gone}
        if sum(mine.values()) > SENT:
            return None
        found = self.blocks(mine.keys() - partly).drop("segment")
        if not partly:
            return found
        gone = self.gone().where(F.col("segment").isin(*partly)).orderBy(*KEY).toArrow()
        segment, doc_id = (gone.column(c).to_numpy() for c in KEY)
        left = without(self.blocks(partly), {n: doc_id[segment == n] for n in partly})
        return found.union(left) if mine.keys() - partly else left

    def frequency(self) -> DataFrame:
        """trigram and docs: of how many live documents, at most 2 ** 25 rows."""
        found = self._read("frequency", [f"change={n}" for n in self.manifest.frequency], "trigram int, docs long, change long")
        return found.groupBy("trigram").agg(F.sum("docs").alias("docs")).where("docs > 0")


def stored(spark: SparkSession, path: str, version: int | None = None) -> Stored | None:
    found = manifest(spark, path, version)
    return Stored(spark, path, found) if found else None


# ---------------------------------------------------------------- writing


def new_number() -> int:
    """Of its own for each writer, so no writer touches another's folders."""
    return random.getrandbits(48)


def all_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of contents and paths."""
    return blocks(docs).union(blocks(docs, "relative_path").select((F.col("trigram") + PATH).alias("trigram"), "first", "docs"))


def counted(found: DataFrame) -> DataFrame:
    """trigram and docs, how many documents its blocks hold."""
    return found.groupBy("trigram").agg(F.sum(F.size("docs")).alias("docs"))


def _ranged(found: DataFrame, files: int | None = None) -> DataFrame:
    """Blocks ranged and sorted by trigram and first doc_id, so that neither a lookup nor a
    frequent trigram is one task's work."""
    return found.repartitionByRange(*([files] if files else []), "trigram", "first").sortWithinPartitions("trigram", "first")


def _write_segment(docs: DataFrame, path: str, number: int, files: int | None = None) -> DataFrame:
    """Documents sorted by doc_id in small pages, and their postings."""
    spark, spread = docs.sparkSession, [files] if files else []
    ranged = docs.repartitionByRange(*spread, "doc_id").sortWithinPartitions("doc_id")
    _write(ranged, f"{path}/docs/segment={number}", **{"parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS})
    written = spark.read.schema(docs.schema).parquet(f"{path}/docs/segment={number}")
    temporary = f"{path}/pairs-{number}"
    _write(all_blocks(written), temporary)  # extracted once, though ranging reads it twice
    _write(_ranged(spark.read.schema(BLOCKS).parquet(temporary), files), f"{path}/postings/segment={number}")
    remove(spark, temporary)
    return written


def _finished(new: Stored, built_secs: int) -> Manifest:
    """The manifest with the sums that its frequencies and documents give."""
    content = new.frequency().where(F.col("trigram") < PATH).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("postings"), F.count("*").alias("trigrams")).first()
    return replace(new.manifest, postings=int(content["postings"]), trigrams=int(content["trigrams"]), built_secs=built_secs)


def _size(docs: DataFrame):
    return F.col("size") if "size" in docs.columns else F.octet_length(F.col("contents").cast("binary"))


def _totals(docs: DataFrame) -> tuple[int, int]:
    return tuple(map(int, docs.agg(F.count("*"), F.coalesce(F.sum(_size(docs)), F.lit(0))).first()))


def build(docs: DataFrame, path: str, files: int | None = None, now: int = 0, applied: int = -1) -> Manifest:
    """A new version that holds ``docs`` and nothing else."""
    spark, number = docs.sparkSession, new_number()
    last = max(versions(spark, path), default=0)
    written = _write_segment(docs, path, number, files)
    _write(counted(spark.read.schema(BLOCKS).parquet(f"{path}/postings/segment={number}")), f"{path}/frequency/change={number}")
    n, size = _totals(written)
    new = Manifest(last + 1, docs.schema.json(), (Segment(number, n),), (), (number,), n, size, applied=applied)
    return commit(spark, path, _finished(Stored(spark, path, new), now))


def change(spark: SparkSession, path: str, docs: DataFrame, removed: DataFrame, now: int = 0, applied: int | None = None) -> Manifest:
    """A new version in which ``docs`` take the place of live documents with their paths, and
    those of ``removed`` (relative_path) are gone. Only what is touched is read or written, but
    for the column of paths."""
    old = stored(spark, path)
    number, m = new_number(), old.manifest
    added = _write_segment(docs.select(*old.schema.fieldNames()), path, number)
    touched = removed.select("relative_path").union(added.select("relative_path")).distinct()
    here = old.live(old.docs().select(*KEY, "relative_path", *(["size"] if "size" in old.schema.fieldNames() else [])))
    dead = here.join(touched, "relative_path", "left_semi")
    _write(dead.select(*KEY), f"{path}/gone/change={number}")
    dead = spark.read.schema("segment long, doc_id long").parquet(f"{path}/gone/change={number}")
    each = {r["segment"]: r["count"] for r in dead.groupBy("segment").count().collect()}  # a row a segment
    texts = rows_of(old, dead, sum(each.values()))
    fell = counted(all_blocks(texts)).select("trigram", (-F.col("docs")).alias("docs"))
    rose = counted(spark.read.schema(BLOCKS).parquet(f"{path}/postings/segment={number}"))
    _write(rose.union(fell).groupBy("trigram").agg(F.sum("docs").alias("docs")).where("docs != 0"), f"{path}/frequency/change={number}")
    (n, size), (n_dead, size_dead) = _totals(added), _totals(texts)
    kept = [replace(s, gone=s.gone + each.get(s.number, 0)) for s in m.segments]
    new = replace(
        m, version=m.version + 1, segments=(*(s for s in kept if s.gone < s.docs), *([Segment(number, n)] if n else [])), gone=(*m.gone, *([number] if n_dead else [])),
        frequency=(*m.frequency, number), docs=m.docs + n - n_dead, bytes=m.bytes + size - size_dead, applied=m.applied if applied is None else applied,
    )
    done = commit(spark, path, _finished(Stored(spark, path, new), now))
    return compact(spark, path) or done


def rows_of(index: Stored, wanted: DataFrame, n: int) -> DataFrame:
    """The documents of ``wanted`` (segment, doc_id), ``n`` of them: looked up where few."""
    from .lookup import LOOKUP, ranges

    if n <= LOOKUP:
        return index.docs().where(ranges([tuple(r) for r in wanted.collect()]))
    return index.docs().join(F.broadcast(wanted) if n <= SENT else wanted, KEY, "left_semi")


def due(m: Manifest, fanout: int = FANOUT) -> set[int]:
    """Segments to merge: of a tier that is full, and those of which less than half is live."""
    tiers: dict[int, list[int]] = {}
    for s in m.segments:
        tiers.setdefault(int(math.log(max(s.docs - s.gone, 1), fanout)), []).append(s.number)
    full = {n for t in tiers.values() if len(t) >= fanout for n in t}
    return full | {s.number for s in m.segments if 2 * s.gone > s.docs}


def compact(spark: SparkSession, path: str, fanout: int = FANOUT, which: set[int] | None = None) -> Manifest | None:
    """Merge segments into one: their live rows, and their blocks without what is gone. None if
    nothing is due."""
    old = stored(spark, path)
    m = old.manifest
    which = due(m, fanout) if which is None else which
    if not which:
        return None
    number = new_number()
    docs = old.live(old.docs(which)).drop("segment")
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    _write(ranged, f"{path}/docs/segment={number}", **{"parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS})
    found = old.live_blocks(which)
    if found is None:  # too many rows are gone to be sent: the trigrams of those that stay are extracted again
        found = all_blocks(spark.read.schema(docs.schema).parquet(f"{path}/docs/segment={number}"))
    found = found.persist(StorageLevel.DISK_ONLY)  # made once, though ranging reads it twice
    try:
        _write(_ranged(found), f"{path}/postings/segment={number}")
    finally:
        found.unpersist()
    rest = [s for s in m.segments if s.number not in which]
    n = sum(s.docs - s.gone for s in m.segments if s.number in which)
    gone = ()
    if any(s.gone for s in rest):
        _write(old.gone().where(F.col("segment").isin([s.number for s in rest])), f"{path}/gone/change={number}")
        gone = (number,)
    _write(old.frequency(), f"{path}/frequency/change={number}")
    return commit(spark, path, replace(m, version=m.version + 1, segments=(*rest, Segment(number, n)), gone=gone, frequency=(number,)))


def apply_feed(spark: SparkSession, path: str, changes: DataFrame, read: Callable[[DataFrame], DataFrame], generation: int, now: int = 0) -> Manifest:
    """Bring an index up to a batch of changed paths (relative_path, deleted). ``read`` gives the
    documents of a table of paths, and is asked for the changed ones only; a path that it does
    not give is gone. A generation that is in already changes nothing, so a batch that is
    run again, or a lost writer's, is safe."""
    m = manifest(spark, path)
    if generation <= m.applied:
        return m
    last = changes.groupBy("relative_path").agg(F.max("deleted").alias("deleted"))
    wanted = last.where("not deleted").select("relative_path")
    docs = read(F.broadcast(wanted) if last.count() <= SENT else wanted)  # a join by shuffle moves every text
    return change(spark, path, docs, last.select("relative_path"), now, generation)
