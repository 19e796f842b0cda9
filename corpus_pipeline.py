"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their
columns; the last returns them with shard and slot. ``run`` writes each stage's rows as
Parquet and reads them again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm import decontam, jaccard, mixing, shards, toxicity
from loomdex.llm.queries import TOXIC_AT
from loomdex.llm.scratch import Scratch, broadcast_if_small, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic; the model is fitted on the stage's own input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) < TOXIC_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of those with the smallest doc_id (rows without one come
    last) the first. Rows are told apart by their place, so repeated and null ids lose nothing."""
    with Scratch(spark, "dedup") as scratch:
        rows, at = _row_keys(docs, scratch)
        found = scratch.table(jaccard.jaccard_components(rows.select(F.col(at).alias("doc_id"), "text")), "components")
        found = found.select(F.col("doc_id").alias(at), F.col("component_id").alias("__comp"))
        groups = found.groupBy("__comp").agg(F.count("*").alias("n")).where("n > 1").select("__comp")
        ids = rows.select(at, F.col("doc_id").cast("long").alias("__id"))
        members = scratch.table(found.join(groups, "__comp").join(ids, at), "members")
        first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col(at).alias("at")))
        stays = members.groupBy("__comp").agg(first["at"].alias("__stays"))
        dropped = scratch.keep(members.join(stays, "__comp").where(F.col(at) != F.col("__stays")).select(at))
    return rows.join(broadcast_if_small(dropped), at, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark passage."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair mixture of their sources: the order of the
    rows in the files that this stage is written to."""
    with Scratch(spark, "mix") as scratch:
        rows, at = _row_keys(docs, scratch)
        place = fresh(rows, "__place")
        places = _mixture(rows, docs.columns, at).withColumnRenamed("mix_position", place)
        return rows.join(places, at).orderBy(place).select(*docs.columns)


def _mixture(rows: DataFrame, columns: list[str], at: str) -> DataFrame:
    """(row key, mix_position): a function of the rows alone, so any stage can ask for it."""
    tie = fresh(rows, "__tie")
    narrow = rows.select(at, "doc_id", "source", F.xxhash64(*columns).alias(tie))
    return mixing.mix(narrow, tie=F.col(tie)).select(at, "mix_position")


def _file_order(docs: DataFrame) -> tuple[DataFrame, str] | None:
    """``docs`` with a whole number of each row's own, its place in its files, if it is read from files."""
    name, file, row, of, first = (fresh(docs, n) for n in ("__at", "__file", "__row", "__of", "__first"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        return None
    files = placed.groupBy(F.col(file).alias(of)).agg((F.max(row) + 1).alias("n"))
    before = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = files.select(of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    placed = placed.join(broadcast_if_small(files, 100_000), F.col(file) == F.col(of))
    return placed.select(*docs.columns, (F.col(first) + F.col(row)).alias(name)), name


def _row_keys(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` with a whole number of each row's own."""
    name = fresh(docs, "__at")
    return _file_order(docs) or (scratch.keep(docs.withColumn(name, F.monotonically_increasing_id())), name)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard (0 to 15) and its slot there, cut from the mixture, which
    is computed from the rows again and not read off file names. Columns that ``docs`` has of
    these names are replaced."""
    with Scratch(spark, "cut") as scratch:
        rows, at = _row_keys(docs, scratch)
        about = scratch.table(shards.described(rows, keep=(at,)).drop("__ord"), "about")
        base = scratch.table(about.join(_mixture(rows, docs.columns, at).withColumnRenamed("mix_position", "__ord"), at), "base")
        found = scratch.keep(shards.place(base, 16, (at,), scratch).select(at, "shard", "slot"))
    rows = rows.drop("shard", "slot")
    return rows.join(found, at).select(*[c for c in docs.columns if c in rows.columns], "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage fits a model, which SQL cannot express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
