"""Session traces: JSON lines of an assistant's messages, as tool calls with their answers.

A line is a record with ``type``; in ``message.content`` an assistant's record lists ``tool_use``
blocks (id, name, input) and a user's lists ``tool_result`` blocks (tool_use_id, content), with the
structured answer in ``toolUseResult`` beside the message. A file is one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import running_sum


def tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """run_id (the file), turn (1 for a file's first call), name, input, answer, text and cwd of
    every call; input and answer are JSON text, answer and text are null where no result follows.
    Lines that are no JSON count as nothing. Of several results of one call the first counts.
    Files are split like any text: a place is a block's start and the line's place in it."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("run_id"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), F.try_parse_json("value").alias("v")
    )
    get = lambda c, p, t="string": F.try_variant_get(c, p, t)
    blocks = lines.select("run_id", "at", get("v", "$.type").alias("type"), get("v", "$.cwd").alias("cwd"), F.to_json(get("v", "$.toolUseResult", "variant")).alias("answer"), F.posexplode(get("v", "$.message.content", "array<variant>")).alias("pos", "b"))
    kind = get("b", "$.type")
    uses = blocks.where((F.col("type") == "assistant") & (kind == "tool_use")).select(
        "run_id", "at", "pos", get("b", "$.id").alias("id"), get("b", "$.name").alias("name"), F.to_json(get("b", "$.input", "variant")).alias("input"), "cwd"
    )
    parts = F.transform(get("b", "$.content", "array<variant>"), lambda p: F.try_variant_get(p, "$.text", "string"))
    said = F.when(F.schema_of_variant(get("b", "$.content", "variant")).startswith("ARRAY"), F.concat_ws("", parts)).otherwise(get("b", "$.content"))
    results = blocks.where((F.col("type") == "user") & (kind == "tool_result")).select("run_id", get("b", "$.tool_use_id").alias("id"), F.struct("at", "pos", "answer", said.alias("text")).alias("r"))
    results = results.groupBy("run_id", "id").agg(F.min("r").alias("r"))
    # numbered over all files, block by block; a run's turns count from its first call
    numbered = running_sum(uses, F.struct("run_id", "at.block"), ["at", "pos"], F.lit(1), "n")
    first = numbered.groupBy("run_id").agg(F.min("n").alias("first"))
    turns = numbered.join(first, "run_id").withColumn("turn", F.col("n") - F.col("first") + 1)
    return turns.join(results, ["run_id", "id"], "left").select("run_id", "turn", "name", "input", F.col("r.answer").alias("answer"), F.col("r.text").alias("text"), "cwd")
