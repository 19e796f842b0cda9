"""The trigram index: candidates of seed conditions, changes, and indexes in memory or on disk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.trigrams import encode, of_bytes, postings
from ..plans.seeds import Condition, PathSeed, literals
from . import segments
from .segments import KEY, PATH, Conflict, Stored, remove

REBUILD_AT = 0.25
#: Trigrams of a literal that a search looks up: the rarest ones, and no one that so many times
#: as many documents have as the rarest.
PROBES, SPREAD = 16, 8


class Frequency:
    """Document frequency of each trigram on the driver: at most 2 ** 25 entries, whatever
    the corpus."""

    def __init__(self, table: DataFrame):
        got = table.orderBy("trigram").toArrow()
        self.trigram = got.column("trigram").to_numpy()
        self.docs = got.column("docs").to_numpy()

    def of(self, trigram: int) -> int:
        at = int(np.searchsorted(self.trigram, trigram))
        return int(self.docs[at]) if at < len(self.trigram) and self.trigram[at] == trigram else 0


_frequency: dict[str, tuple[int, Frequency]] = {}


@dataclass
class Index:
    """Live docs (without contents a search prunes them) and live postings (trigram, doc_id) of
    their contents. An index on disk also has its ``stored`` version."""

    docs: DataFrame
    postings: DataFrame
    stored: Stored | None = None

    @property
    def ranged(self) -> bool:
        """One segment, none of whose rows is gone."""
        return self.stored is not None and len(self.stored.manifest.segments) == 1 and not self.stored.n_gone

    def frequency(self) -> Frequency | None:
        """Read once for each version of an index."""
        if self.stored is None:
            return None
        key, version = self.stored.path, (self.stored.manifest.version, self.stored.manifest.frequency)
        found = _frequency.get(key)
        if found is None or found[0] != version:
            found = _frequency[key] = (version, Frequency(self.stored.frequency()))
        return found[1]


def metadata(spark: SparkSession, path: str) -> dict | None:
    """version, docs, bytes, postings, trigrams, segments and built_secs of the newest version, or None."""
    m = segments.manifest(spark, path)
    return m and {"version": m.version, "format": m.format, "built_secs": m.built_secs, "docs": m.docs, "bytes": m.bytes, "postings": m.postings, "trigrams": m.trigrams, "segments": len(m.segments), "generation": m.applied}


def build(docs: DataFrame, path: str, files: int | None = None, now: int = 0) -> dict:
    """Write an index of ``docs`` as a new version; returns its metadata."""
    segments.build(docs, path, files, now)
    return metadata(docs.sparkSession, path)


def load(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The newest version of an index, or the one asked for. It stays readable as it is while
    later ones are written."""
    found = segments.stored(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no index in {path}" + (f" has version {version}" if version is not None else ""))
    live = found.live(found.postings().where(F.col("trigram") < PATH))
    return Index(found.live(found.docs()).drop("segment"), live.select("trigram", "doc_id"), found)


load_current = load


def _grams(literal: bytes) -> list[int]:
    at = PATH if isinstance(literal, PathSeed) else 0
    return [int(g) + at for g in of_bytes(bytes(literal))]


def _met(condition: Condition, flag: dict[bytes, Column]) -> Column:
    if isinstance(condition, bytes):
        return flag[condition]
    out = None
    for part in condition[1]:
        c = _met(part, flag)
        out = c if out is None else out & c if condition[0] == "and" else out | c
    return out


def candidates(index: DataFrame, condition: Condition, frequency: Frequency | None = None) -> DataFrame | None:
    """Keys (doc_id, with a segment where ``index`` has them) of the documents that may hold
    what a seed condition asks for: one scan of the wanted postings, one grouping with
    map-side combine. With ``frequency`` only the PROBES rarest trigrams of each literal are
    read, and None means that there are no candidates."""
    key = [c for c in KEY if c in index.columns]
    grams = {s: _grams(s) for s in set(literals(condition))}
    if frequency is not None:
        grams = {s: sorted(gs, key=lambda g: (frequency.of(g), g))[:PROBES] for s, gs in grams.items()}
        if not _possible(condition, {s: frequency.of(gs[0]) > 0 for s, gs in grams.items()}):
            return None
        condition = _selective(condition, {s: frequency.of(gs[0]) for s, gs in grams.items()})
        grams = {s: grams[s] for s in set(literals(condition))}
        grams = {s: [g for g in gs if frequency.of(g) <= SPREAD * frequency.of(gs[0])] for s, gs in grams.items()}
    wanted = sorted({g for gs in grams.values() for g in gs})
    rows = index.where(F.col("trigram").isin(wanted))
    if len(wanted) == 1:
        return rows.select(*key)  # each pair is there once
    names = {s: f"s{i}" for i, s in enumerate(grams)}
    counted = rows.groupBy(*key).agg(*[F.count_if(F.col("trigram").isin(gs)).alias(names[s]) for s, gs in grams.items()])
    flag = {s: F.col(names[s]) >= len(gs) for s, gs in grams.items()}
    return counted.where(_met(condition, flag)).select(*key)


def _bound(condition: Condition, known: dict[bytes, int]) -> int:
    if isinstance(condition, bytes):
        return known[condition]
    return (min if condition[0] == "and" else sum)(_bound(p, known) for p in condition[1])


def _selective(condition: Condition, known: dict[bytes, int]) -> Condition:
    """The parts of a conjunction that bound its candidates about as well as all of it."""
    if isinstance(condition, bytes) or condition[0] == "or":
        return condition
    best = _bound(condition, known)
    kept = [p for p in condition[1] if _bound(p, known) <= SPREAD * best]
    return ("and", kept) if len(kept) > 1 else kept[0]


def most(condition: Condition, frequency: Frequency) -> int:
    """A bound on the candidates of a condition."""
    return _bound(condition, {s: min(frequency.of(g) for g in _grams(s)) for s in set(literals(condition))})


def _possible(condition: Condition, known: dict[bytes, bool]) -> bool:
    if isinstance(condition, bytes):
        return known[condition]
    return (all if condition[0] == "and" else any)(_possible(p, known) for p in condition[1])


def document_frequency(index: DataFrame | Index) -> DataFrame:
    """trigram and docs, out of pairs, or out of an index: where it is stored, its blocks are
    counted as they are."""
    if isinstance(index, Index):
        found = index.stored.live_blocks() if index.stored else None
        if found is not None:
            return segments.counted(found.where(F.col("trigram") < PATH))
        index = index.postings
    return index.groupBy("trigram").agg(F.count("*").alias("docs"))


def classify_changes(base: DataFrame, scan: DataFrame) -> DataFrame:
    """relative_path and change (added, modified, removed, same) by size, time and hash."""
    b = base.select("relative_path", F.struct("size", "modified_unix_secs", "hash").alias("b"))
    s = scan.select("relative_path", F.struct("size", "modified_unix_secs", "hash").alias("s"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("s").isNull(), "removed").when(F.col("b") == F.col("s"), "same").otherwise("modified")
    return b.join(s, "relative_path", "full_outer").select("relative_path", change.alias("change"))


def change_ratio(changes: DataFrame) -> DataFrame:
    """changed (a modified document counts twice: it goes and comes), base_docs, ratio and
    whether that calls for a rebuild."""
    weight = F.expr("CASE change WHEN 'modified' THEN 2 WHEN 'same' THEN 0 ELSE 1 END")
    n = changes.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("changed"), F.count_if(F.col("change") != "added").alias("base_docs"))
    ratio = F.col("changed") / F.greatest("base_docs", F.lit(1))
    return n.withColumn("ratio", ratio).withColumn("rebuild", ratio >= REBUILD_AT)


def overlay(base: DataFrame, delta: DataFrame, removed: DataFrame) -> DataFrame:
    """Base documents without removed and replaced ones, and the delta. The delta wins."""
    gone = removed.select("relative_path").union(delta.select("relative_path")).distinct()
    return base.join(gone, "relative_path", "left_anti").unionByName(delta, allowMissingColumns=True)


def overlay_postings(index: Index, delta: DataFrame, removed: DataFrame) -> Index:
    """Base postings of the documents that stay, and the delta's own: a replaced document's
    old postings are gone even where its doc_id stays the same."""
    gone = removed.select("relative_path").union(delta.select("relative_path")).distinct()
    stay = index.docs.join(gone, "relative_path", "left_anti")
    base = index.postings.join(stay.select("doc_id"), "doc_id", "left_semi")
    return Index(overlay(index.docs, delta, removed), base.select("trigram", "doc_id").union(postings(delta)))


def apply_changes(spark: SparkSession, path: str, scan: DataFrame, now: int = 0) -> dict:
    """Bring an index up to ``scan`` (its documents' columns, with size, modified_unix_secs
    and hash): what differs becomes a segment of its own, or, from REBUILD_AT on, all of ``scan``
    the only one. Returns changed, base_docs, ratio and rebuild."""
    live = load(spark, path)
    kinds = classify_changes(live.docs, scan)
    what = change_ratio(kinds).first().asDict()
    if what["rebuild"]:
        build(scan, path, now=now)
    elif what["changed"]:
        new = kinds.where("change in ('added', 'modified')").select("relative_path")
        new = F.broadcast(new) if what["changed"] <= segments.SENT else new  # a join by shuffle moves every text
        segments.change(spark, path, scan.join(new, "relative_path", "left_semi").select(*live.docs.columns), kinds.where("change = 'removed'"), now)
    return what


def latest(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(delta, removed) out of an append-only log (batch, relative_path, deleted, ...): the
    newest entry of each path counts, so no batch undoes an earlier one."""
    newest = Window.partitionBy("relative_path").orderBy(F.desc("batch"))
    last = log.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
    return last.where("not deleted").drop("batch", "deleted"), last.where("deleted").select("relative_path")


def trigrams_of(text: str) -> list[int]:
    return [int(t) for t in of_bytes(text.encode())]


__all__ = [
    "Conflict", "Index", "apply_changes", "build", "candidates", "change_ratio", "classify_changes", "document_frequency", "encode", "latest", "load", "load_current",
    "metadata", "most", "overlay", "overlay_postings", "remove", "trigrams_of",
]
