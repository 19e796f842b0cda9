"""Table corpora as documents, and the logs that sessions read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.request import NamedRequest, SearchRequest


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, relative_path, file_name, extension (the language), size, contents (string)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", F.concat_ws("/", "source", "lang", name).alias("relative_path"), name.alias("file_name"), F.col("lang").alias("extension"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("contents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages; the path is the address without scheme."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return p.select(F.col("page_id").alias("doc_id"), path.alias("relative_path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), F.lit("html").alias("extension"), F.octet_length("html").cast("long").alias("size"), F.col("html").alias("contents"))


def memo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events out of the table events: session_id, seq, ts, event, path, content_hash, tokens."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.expr("CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'pre_compact' WHEN 'signup' THEN 'session_start' ELSE 'select' END")
    value = F.floor("value").cast("long")
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"),
        F.concat(F.lit("k/"), F.get_json_object("props", "$.k")).alias("path"), (F.coalesce(value, F.lit(0)) % 2).alias("content_hash"), value.alias("tokens"),
    )


def action_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a session's actions; blank lines are skipped, a wrong version is an error."""
    schema = "schema_version int, entry_id long, session_id string, ts long, kind string, payload string"
    rows = spark.read.schema(schema).json(path)
    version = F.when(F.col("schema_version") == 1, F.lit(1)).otherwise(F.raise_error(F.lit("unsupported action log schema version")).cast("int"))
    return rows.where("schema_version is not null or entry_id is not null").withColumn("schema_version", version)


def session_queries(spark: SparkSession, path: str) -> list[NamedRequest]:
    """The requests of a session file: a JSON array of records with a name each."""
    out = []
    for r in spark.read.option("multiLine", True).json(path).toJSON().toLocalIterator():
        import json

        row = {k: v for k, v in json.loads(r).items() if v is not None}
        name = row.pop("name", "")
        fields = {k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k in SearchRequest.__dataclass_fields__}
        out.append(NamedRequest(name, SearchRequest(**fields).checked()))
    return out
