"""Choice of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out():
    """True for the third of the documents whose labels are never read."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int = 64) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``per_class`` documents of each class outside of the held-out
    third, and how many labelled rows each class has there. Rows are taken in the order of
    a hash of doc_id; labels other than 0 and 1 are ignored, and a document with both is 1.
    Equal texts are kept once. The bound is on what the fit reads, not on what is scored.
    The texts are spread over ``parts`` tasks, as each task's texts come as one Arrow batch.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {int(r["y"]): int(r["count"]) for r in known.groupBy("y").count().collect()}
    order = F.xxhash64(F.lit(20240607), "doc_id")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id")  # 2 x per_class rows at most
    return rows.where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y").repartition(parts), counts
