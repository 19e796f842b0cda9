"""Audit of how filters interact: what each removes, alone and in every order.

Five filters give each document a five-bit mask of those it fails. All else follows from how
many documents of a part have each mask: in any order a document goes at the first of its
failing filters, so each of the 120 orders is read off 32 cells, not run over the corpus.

The text is read once and left behind: what is written and shuffled is its digest (SHA-256),
by which a grouping with map-side combine finds the smallest doc_id of each text. The rows
meet it by (digest, doc_id), a pair that not even the largest group of copies shares.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4 and 8: the text fails A (few words), B (repeated words), C (capitals), D (symbols)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.char_length(text), text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask (of the four filters that look at one text only)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask"))


def cells(described: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (0 to 31) and how many documents have it: n, good of them, toxic of them.
    ``described`` is read twice."""
    firsts = described.groupBy("digest").agg(F.min("doc_id").alias("first")).where("first is not null")
    firsts = firsts.select(F.col("digest").alias("of"), "first", F.lit(True).alias("is_first"))
    said = labels.select(F.col("doc_id").cast("long").alias("labelled"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("labelled is not null").groupBy("labelled").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    rows = described.join(firsts, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("of")), "left")
    rows = rows.join(said, F.col("doc_id") == F.col("labelled"), "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("mask") + F.when(copy, 16).otherwise(0)
    return rows.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def orders(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, out of at most 32 cells a part."""
    spark = cells.sparkSession
    bits = range(len(FILTERS))
    # (filters before, filter): 80 pairs, which each of the 600 steps is one of
    pairs = [(before, f) for f in bits for before in range(1 << len(FILTERS)) if not before >> f & 1]
    met = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("filter")) for b, f in pairs])).alias("at")
    bit = F.expr("shiftleft(1, at.filter)")
    fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("at.before")) != 0
    count = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    # of the orders, each of a document's k failing filters comes first among them in 120 / k
    share = F.expr("n * (120 div bit_count(mask))")
    counted = cells.select("*", met).groupBy("part", "at").agg(
        count(~gone & ~fails).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == bit).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("long").alias("shapley"),
    )
    steps = [(sum(1 << f for f in p[:i]), p[i], "".join(FILTERS[f] for f in p), i + 1) for p in permutations(bits) for i in bits]
    steps = spark.createDataFrame(steps, "before int, filter int, filter_order string, step int")
    joined = counted.join(F.broadcast(steps), (F.col("at.before") == F.col("before")) & (F.col("at.filter") == F.col("filter")))  # 600 rows
    return joined.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley, all long, of ``docs`` (doc_id, text, source) and
    ``labels`` (doc_id, quality, toxic); other columns are not looked at.

    Part is the source, a null one counts as the empty one. A null text is the empty text,
    which fails A alone. E: a smaller doc_id has the same text, whatever its part; rows that
    share the smallest doc_id of their text are all kept, and a row without doc_id has no
    smaller one and no label. Repeated rows count each. A document with labels that differ
    counts as good (toxic) if one of them says so. Empty tables give no rows.
    """
    with Scratch(docs.sparkSession, "audit") as scratch:
        return scratch.keep(orders(cells(scratch.table(described(docs), "described"), labels)))
