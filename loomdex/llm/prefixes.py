"""A trie of conversation prefixes, built from digests.

Conversations are rebuilt first: some share their opening with the first conversation of
their group of five. Then each prefix of a rebuilt conversation is named by a chained SHA-256,
and conversations that start alike share a name, so grouping by (depth, digest) gives the
nodes. Texts are digested once, where they are read; only digests are shuffled.

Chains are cut into pieces of PIECE turns, so no conversation is one row or one task. With
P(p, i) = H(P(p, i-1) + turn i of piece p) inside a piece and C(p) for what comes before it,
a node's name is H(C(p) + P(p, i)), and C(p+1) is the name of the last node of piece p: only
one digest a piece has to be chained along a whole conversation.

Sums over subtrees: a node belongs to its smallest member, the owner, and so do all nodes
below it on the owner's path. What one owner's nodes send to the same ancestor is summed along
that path before the shuffle (a running sum from the end), so each owner sends one row to each of
its ancestors instead of one for each pair of nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import dealt, running
from .scratch import Scratch
from .stream import frugal

PIECE = 64
HEAD = 9  # an opening has fewer turns than this
FAMILY = 5
ROWS_A_BUCKET = 20_000
_ITEM = "struct<pos:bigint,digest:binary,bytes:bigint>"


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


ROOT = hashlib.sha256(b"").digest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of role and text) and bytes (of the text) of each message
    that has a conv_id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    # a digest of each, so that no pair of role and text runs into another
    digest = _sha(F.unhex(F.sha2("role", 256)), F.unhex(F.sha2("text", 256)))
    return rows.select("conv_id", "turn", "role", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def opening(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("long")


def _placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns with their place from 0 in their conversation; no conversation is one task's."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    spread = dealt(turns, [F.col("conv_id"), *order], turns.count(), ROWS_A_BUCKET, scratch, "dealt")
    placed = running(spread, ["conv_id"], "__b", order, {"pos": F.lit(1).cast("long")})
    return scratch.table(placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "bytes"), "placed")


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv_id, pos, digest and bytes of each turn after rebuilding; a conversation that has none is missing."""
    convs = placed.where("pos = 0").select("conv_id", opening(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    heads = placed.where((F.col("pos") < HEAD - 1) & (F.col("conv_id") % FAMILY == 0)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    # at most nine conversations, those from -4 to 4, share an opening
    about = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select(F.col("conv_id").alias("of"), "h", F.slice(F.coalesce("head", F.expr(f"cast(array() as array<{_ITEM}>)")), F.lit(1), F.col("h").cast("int")).alias("head"))
    first = about.select(F.col("of").alias("conv_id"), F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.bytes")
    shift = about.select("of", "h", F.size("head").cast("long").alias("given"))
    rest = placed.join(shift, F.col("conv_id") == F.col("of")).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "digest", "bytes")
    return first.union(rest)


def pieces(rebuilt: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, piece, start (name of the node before the piece), names and bytes of its
    nodes in order."""
    chain = "aggregate(items, cast(struct(cast('' as binary), array()) as struct<h:binary,l:array<binary>>), (a, t) -> named_struct('h', unhex(sha2(concat(a.h, t.digest), 256)), 'l', concat(a.l, array(unhex(sha2(concat(a.h, t.digest), 256))))))"
    own = rebuilt.groupBy("conv_id", F.expr(f"pos div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("items"))
    own = own.select("conv_id", "piece", F.expr(f"({chain}).l").alias("inner"), F.col("items.bytes").alias("bytes"))
    own = scratch.table(own, "inner")
    root = F.lit(ROOT)
    # piece p starts at C(p): one digest for each piece of the conversations that have several
    ends = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.size("inner") == PIECE, F.struct("piece", F.element_at("inner", -1).alias("d"))))).alias("ends")).where("size(ends) > 0")
    starts = "aggregate(ends, cast(array(root) as array<binary>), (a, e) -> concat(a, array(unhex(sha2(concat(element_at(a, -1), e.d), 256)))))"
    starts = ends.withColumn("root", root).select(F.col("conv_id").alias("of"), F.posexplode(F.expr(starts)).alias("at", "start"))
    joined = own.join(starts, (F.col("conv_id") == F.col("of")) & (F.col("piece") == F.col("at")), "left")
    start = F.coalesce("start", root)
    named = joined.select("conv_id", "piece", start.alias("start"), "inner", "bytes")
    names = F.transform("inner", lambda p: F.unhex(F.sha2(F.concat("start", p), 256)))
    return named.select("conv_id", "piece", "start", names.alias("names"), "bytes")


def paths(pieces: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent (null at the root), bytes: the nodes that each conversation
    passes, one row each."""
    at = F.posexplode(F.arrays_zip("names", "bytes")).alias("i", "t")
    rows = pieces.select("conv_id", "piece", "start", "names", at)
    parent = F.when(F.col("i") == 0, F.col("start")).otherwise(F.expr("names[i - 1]"))
    below = rows.select("conv_id", (F.col("piece") * PIECE + F.col("i") + 1).alias("depth"), F.col("t.names").alias("node"), parent.alias("parent"), F.col("t.bytes").alias("bytes"))
    return convs.select("conv_id", F.lit(0).cast("long"), F.lit(ROOT), F.lit(None).cast("binary"), F.lit(0).cast("long")).union(below).toDF("conv_id", "depth", "node", "parent", "bytes")


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of chunks of a node; holds one batch and one digest's state."""
    schema = pa.schema([("of", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        nodes, out = [], []
        for at, text in zip(batch.column("node").to_pylist(), batch.column("chunk").to_pylist()):
            if at != node:
                if node is not None:
                    nodes.append(node)
                    out.append(state.hexdigest())
                node, state = at, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], schema=schema)


def ends_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """of (node) and ends_sha256 of the conv_ids that end there (node, conv_id). A digest
    needs its input in one order, but a task only streams ready chunks of ids."""
    spread = dealt(ends, [F.col("node"), F.col("conv_id")], ends.count(), ROWS_A_BUCKET, scratch, "ends-dealt")
    chunks = spread.groupBy("node", "__b").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("chunk"))
    ordered = chunks.repartition("node").sortWithinPartitions("node", "__b").select("node", "chunk")
    return ordered.mapInArrow(frugal(_hashed), "of binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), one row per node: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, all long, and
    ends_sha256 string.

    A null role or text is the empty one. Turns stand in order of turn, null first; equal ones
    in order of role, then of a digest of role and text. Repeated rows are turns each. Rows without
    conv_id belong to no conversation and are passed over; other columns are not looked at. A
    conversation whose rebuilt form has no turn is a member of the root alone and ends there.
    An empty table gives no rows.
    """
    with Scratch(conversations.sparkSession, "trie") as scratch:
        placed = _placed(scratch.table(turns(conversations), "turns"), scratch)
        convs = placed.where("pos = 0").select("conv_id")
        path = scratch.table(paths(pieces(rebuilt(placed), scratch), convs), "paths")
        ends = path.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
        ends = scratch.table(ends, "ends")

        nodes = path.groupBy("depth", "node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("parent").alias("parent"))
        ended = ends.groupBy(F.col("node").alias("of")).agg(F.count("*").alias("n_ends"))
        leaf = (F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).cast("long")
        nodes = nodes.join(ended, F.col("node") == F.col("of"), "left").select("depth", "node", "owner", "n_convs", "parent", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
        nodes = scratch.table(nodes, "nodes")

        # what an owner's nodes add to each node of its path, from the end
        mine = nodes.select(F.col("node").alias("of"), F.col("owner").alias("conv_id"), "leaf", "saved")
        owners = mine.select("conv_id").distinct()  # copies of a conversation own nothing and send nothing
        sends = path.select("conv_id", "depth", "node").join(owners, "conv_id", "left_semi")
        sends = sends.join(mine, (sends["node"] == mine["of"]) & (sends["conv_id"] == mine["conv_id"]), "left").select(
            sends["conv_id"], "depth", "node", F.col("of").isNotNull().cast("long").alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved")
        )
        sends = sends.withColumns({"back": -F.expr(f"depth div {PIECE}"), "rank": -F.col("depth")})
        sends = scratch.table(sends, "sends")
        summed = running(sends, ["conv_id"], "back", ["rank"], {"leaves_below": F.col("leaf"), "saved_below": F.col("saved")})
        ups = summed.groupBy("depth", "node").agg(F.sum(F.col("leaf") + F.col("leaves_below")).alias("n_leaves"), F.sum(F.col("saved") + F.col("saved_below")).alias("saved_tokens"))
        ups = ups.select(F.col("node").alias("summed"), "n_leaves", "saved_tokens")
        children = nodes.where("parent is not null").groupBy(F.col("parent").alias("above")).agg(F.count("*").alias("n_children"))
        about = nodes.join(ups, F.col("node") == F.col("summed")).join(children, F.col("node") == F.col("above"), "left")
        about = about.join(ends_digests(ends.select("node", "conv_id"), scratch), F.col("node") == F.col("of"), "left")
        parents = nodes.select(F.col("node").alias("over"), F.col("owner").alias("parent_conv_id"))
        out = about.join(parents, F.col("parent") == F.col("over"), "left")
        return scratch.keep(out.select(
            F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ))
