"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

* Fit, on at most ``sample`` vectors (those with the smallest hash): centre, principal
  axes, and for each code a rotation found by iterative quantisation (Gong and Lazebnik)
  from its own random start; each bit is cut at its median, so codes are balanced.
* Index: every vector gets the bits of all codes. Tables are substrings of ``s`` bits,
  s = ceil(log2 N) - 3, so a bucket holds a few vectors at any N. How often bits of a pair
  right at the threshold differ depends on the data (centring widens angles if vectors
  share a direction), so it is measured: sample vectors are moved to the threshold, at
  random and towards other vectors, and ``tables`` is the least number that brings a share
  of ``recall`` of either kind together; nearer pairs more. Where that takes over
  MANY_TABLES, s is smaller if that makes fewer keys and comparisons together.
* Retrieve: pairs of a bucket whose first code differs in few enough bits (four standard
  deviations above the mean of the moved vectors).
* Rerank: cosine in double precision on the original vectors decides; a pair is counted
  in the first table where both collide, so once.

Hot groups: equal vectors are merged first. Then up to PIVOTS pivots are taken from the
largest buckets, and vectors within half the threshold angle of a pivot form a ball: any
two of them link, so they are counted by its size and never compared. Everything else is
compared; buckets over ``cap`` are cut into units by ``blocks.pair_units``.

Vectors of different lengths link with none of each other. The commonest length, and any other
with over ``cap`` vectors, gets a model of its own; the vectors of a rarer length are few and
are all compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import UNIT, pair_units
from .components import connected_components
from .scratch import Scratch, broadcast_if_small
from .stream import frugal, runs

PIVOTS = 256
BALL_AT_LEAST = 32
MANY_TABLES = 64
#: Comparisons that cost as much as one key of a vector.
KEY_COST = 256


def unit_vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows as unit vectors in double precision; a row that is null, zero, of another
    dimension or has a null or non-finite component is all NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.full((len(column), dim), np.nan)
    size = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    if len(rows):
        flat = column.take(pa.array(rows)).flatten()
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null becomes NaN
        top = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (top > 0)
        x, rows = x[good] / top[good, None], rows[good]
        out[rows] = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return out


@dataclass
class ItqModel:
    dim: int
    bits: int  # of one code
    width: int  # of a table's substring; 0: one table that holds all vectors
    tables: int
    centre: np.ndarray
    axes: np.ndarray  # dim x (codes * bits)
    cut: np.ndarray
    differ: int  # most bits in which the first codes of a retrieved pair differ

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.axes.shape[1]), dtype=bool)
        for i in range(0, len(x), 1024):  # the products are large if there are many codes
            out[i : i + 1024] = (x[i : i + 1024] - self.centre) @ self.axes > self.cut
        return out

    def keys(self, bits: np.ndarray) -> np.ndarray:
        per = self.bits // self.width if self.width else 1
        weight = 1 << np.arange(self.width, dtype=np.int64)
        out = np.zeros((len(bits), self.tables), dtype=np.int64)
        for t in range(self.tables):
            at = (t // per) * self.bits + (t % per) * self.width
            out[:, t] = bits[:, at : at + self.width] @ weight
        return out


def table_count(differ: float, width: int, recall: float) -> int:
    """Tables for pairs of which a bit differs with probability ``differ``."""
    hit = (1 - differ) ** width
    return 1 if hit >= recall else max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))


def moved(x: np.ndarray, axes: np.ndarray, cosine: float, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors right at the threshold: vectors of ``x`` and the same moved at
    random within the span of ``axes``, and moved towards other vectors."""
    out = []
    for to in (random.normal(size=(len(x), axes.shape[1])) @ axes.T, x[random.permutation(len(x))]):
        away = to - (to * x).sum(axis=1)[:, None] * x
        size = np.sqrt((away * away).sum(axis=1))
        good = size > 1e-6
        if good.any():
            out.append((x[good], cosine * x[good] + math.sqrt(1 - cosine * cosine) * away[good] / size[good, None]))
    return out


def fit(x: np.ndarray, n: int, cosine: float, recall: float, rounds: int = 30, seed: int = 7, tried: int = 8192) -> ItqModel:
    """``x``: sample of unit vectors; ``n``: how many vectors will be indexed; ``tried``:
    how many vectors are moved to measure recall."""
    dim = x.shape[1]
    bits = min(64, dim)
    width = min(max(4, math.ceil(math.log2(max(n, 2))) - 3), bits, 48)
    centre = x.mean(axis=0)
    z = x - centre
    values, vectors = np.linalg.eigh(z.T @ z)
    axes = vectors[:, ::-1][:, :bits]
    v = z @ axes
    random, all_axes, cuts = np.random.default_rng(seed), [], []
    pairs = moved(x[:tried], vectors[:, values > 1e-9 * max(values[-1], 1e-9)], cosine, np.random.default_rng(seed + 1))
    seen: list[list[np.ndarray]] = [[] for _ in pairs]  # of each code, where its bits agree

    def learn():
        r, _ = np.linalg.qr(random.normal(size=(bits, bits)))
        for _ in range(rounds):
            b = np.where(v @ r > 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        all_axes.append(axes @ r)
        cuts.append(np.median(v @ r, axis=0))
        for k, (a, c) in enumerate(pairs):
            seen[k].append(((a - centre) @ all_axes[-1] > cuts[-1]) == ((c - centre) @ all_axes[-1] > cuts[-1]))

    learn()
    p = max((1 - agree[0].mean() for agree in seen), default=math.acos(cosine) / math.pi)
    tables = table_count(p, width, recall)
    if tables > MANY_TABLES:
        width = min(range(1, width + 1), key=lambda w: table_count(p, w, recall) * (KEY_COST + n / 2**w))
        tables = table_count(p, width, recall)
    distance = [bits - agree[0].sum(axis=1) for agree in seen]
    spread = math.sqrt(bits * p * (1 - p))
    differ = min(bits, max((math.ceil(d.mean() + 4 * max(d.std(), spread)) for d in distance), default=math.ceil(bits * p + 4 * spread)))
    per, together, found = bits // width, [np.zeros(len(a), dtype=bool) for a, _ in pairs], 0
    least, most = table_count(math.acos(cosine) / math.pi, width, recall), max(4 * tables, 4 * MANY_TABLES)

    def short() -> bool:
        return found < least or any((t & (d <= differ)).mean() < recall for t, d in zip(together, distance))

    while found < most and short():
        if found // per == len(all_axes):
            learn()
        for t, agree in zip(together, seen):
            t |= agree[found // per][:, found % per * width : (found % per + 1) * width].all(axis=1)
            if found % per == per - 1:
                agree[found // per] = agree[found // per][:, :0]  # read to its end
        found += 1
    if short():
        width, found, differ = 0, 1, bits  # codes do not tell such pairs from others: all are compared
    used = -(-found // per)
    return ItqModel(dim, bits, width, found, centre, np.concatenate(all_axes[:used], axis=1), np.concatenate(cuts[:used]), differ)


def _encode(model: ItqModel):
    def run(batches):
        for batch in batches:
            x = unit_vectors(batch.column("embedding"), model.dim)
            good = np.flatnonzero(~np.isnan(x[:, 0]))
            x = x[good]
            bits = model.codes(x)
            first = np.packbits(bits[:, : model.bits], axis=1)
            keys = model.keys(bits)
            pick = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cid").take(pick), batch.column("least").take(pick), batch.column("m").take(pick),
                    pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in first], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), model.tables).cast(pa.list_(pa.int64())),
                ],
                names=["cid", "least", "m", "vector", "code", "keys"],
            )

    return run


def _balls(pivots: np.ndarray, least_cosine: float):
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)
            ball = np.full(len(x), -1, dtype=np.int64)
            if len(x) and len(pivots):
                c = x @ pivots.T
                near = c.argmax(axis=1)
                ok = c[np.arange(len(x)), near] >= least_cosine
                ball[ok] = near[ok]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(ball, mask=ball < 0)], names=[*names, "ball"])

    return run


def _sides(side: np.ndarray):
    own, left, right = (np.flatnonzero(side == s) for s in (0, 1, 2))
    return (own, own, True) if len(own) else (left, right, False)


def _near_codes(model: ItqModel, block: int = 512):
    """Members of each unit that have a partner with a near code."""

    def run(batches):
        for unit in runs(batches, ["t", "key", *UNIT]):
            n = unit.num_rows
            if n < 2:
                continue
            code = np.frombuffer(b"".join(unit.column("code").to_pylist()), dtype=np.uint8).reshape(n, -1)
            ball = unit.column("ball").fill_null(-1).to_numpy()
            a, b, same = _sides(unit.column("side").to_numpy())
            found = np.zeros(n, dtype=bool)
            for s in range(0, len(a), block):
                i = a[s : s + block]
                for q in range(s if same else 0, len(b), block):
                    j = b[q : q + block]
                    near = np.bitwise_count(code[i][:, None, :] ^ code[j][None, :, :]).sum(axis=2, dtype=np.int32) <= model.differ
                    near &= (ball[i][:, None] != ball[j][None, :]) | (ball[i][:, None] < 0)
                    if same:
                        near &= i[:, None] != j[None, :]
                    found[i[near.any(axis=1)]] = True
                    found[j[near.any(axis=0)]] = True
            if found.any():
                kept = unit.filter(pa.array(found)).select(["t", "key", *UNIT, "side", "cid", "ball"]).combine_chunks()
                yield from kept.to_batches()

    return run


def _least_of_component(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that edges (u, v) lead to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _whole(cosine: float, block: int = 512):
    """All vectors of one length against each other: links and least member of the component."""

    def run(batches):
        for group in runs(batches, ["d"]):
            x = unit_vectors(group.column("embedding"), group.column("d")[0].as_py())
            good = np.flatnonzero(~np.isnan(x[:, 0]))
            x, cid, m, least = x[good], *(group.column(c).to_numpy(zero_copy_only=False)[good] for c in ("cid", "m", "least"))
            links, pairs = m - 1, [(np.zeros(0, dtype=np.int64),) * 2]
            for s in range(0, len(x), block):
                u, v = np.nonzero(x[s : s + block] @ x.T >= cosine)
                u, v = u[u + s != v] + s, v[u + s != v]
                np.add.at(links, u, m[v])
                pairs.append((u, v))
            root = _least_of_component(len(x), *(np.concatenate(p) for p in zip(*pairs)))
            yield pa.RecordBatch.from_arrays([pa.array(cid), group.column("least").combine_chunks().take(pa.array(good)), pa.array(links), pa.array(cid[root])], names=["cid", "least", "n_links", "comp"])

    return run


def _rerank(cosine: float, block: int = 512):
    """Per unit and member: how many vectors it links with, counted once over the tables,
    and the least member of its component within the unit."""

    def run(batches):
        for unit in runs(batches, ["t", "key", *UNIT]):
            n = unit.num_rows
            x = np.frombuffer(b"".join(unit.column("vector").to_pylist()), dtype=np.float64).reshape(n, -1)
            keys = np.stack(unit.column("keys").to_pylist())[:, : unit.column("t")[0].as_py()]
            ball, cid, m = unit.column("ball").fill_null(-1).to_numpy(), unit.column("cid").to_numpy(), unit.column("m").to_numpy()
            a, b, same = _sides(unit.column("side").to_numpy())
            links, pairs = np.zeros(n, dtype=np.int64), []
            for s in range(0, len(a), block):
                i = a[s : s + block]
                for q in range(s if same else 0, len(b), block):
                    j = b[q : q + block]
                    ok = (x[i] @ x[j].T >= cosine) & ((ball[i][:, None] != ball[j][None, :]) | (ball[i][:, None] < 0))
                    if same:
                        ok &= i[:, None] < j[None, :]
                    u, v = np.nonzero(ok)
                    u, v = i[u], j[v]
                    later = (keys[u] == keys[v]).any(axis=1)
                    u, v = u[~later], v[~later]
                    np.add.at(links, u, m[v])
                    np.add.at(links, v, m[u])
                    pairs.append((u, v))
            u, v = (np.concatenate(z) if pairs else np.zeros(0, dtype=np.int64) for z in (list(zip(*pairs)) or [[], []]))
            root = _least_of_component(n, u, v)
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(links[hit]), pa.array(cid[root[hit]])], names=["cid", "links", "root"])

    return run


def _of_length(merged: DataFrame, dim: int, n: int, cosine: float, recall: float, sample: int, cap: int, scratch: Scratch, name: str) -> DataFrame:
    """(cid, least, n_links, comp) of the n vectors of one length, those without direction left out."""
    table = lambda df, what: scratch.table(df, f"{what}-{name}")
    some = merged.orderBy(F.xxhash64("h1"), "cid").limit(sample).select("embedding").toArrow()  # sample rows at most
    x = unit_vectors(some.column("embedding"), dim)
    x = x[~np.isnan(x[:, 0])]
    if not len(x):
        x = np.eye(dim)[:1]
    model = fit(x, n, cosine, recall)
    schema = "cid long, least long, m long, vector binary, code binary, keys array<long>"
    index = table(merged.mapInArrow(frugal(_encode(model)), schema), "index")
    slots = index.select("cid", F.posexplode("keys").alias("t", "key"))
    hot = slots.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).where(F.col("n") >= BALL_AT_LEAST)
    hot = hot.groupBy("cid").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "cid").limit(PIVOTS)
    chosen = index.join(F.broadcast(hot), "cid").select("n", "cid", "vector").orderBy(F.desc("n"), "cid").collect()  # PIVOTS rows at most
    least = math.cos(math.acos(cosine) / 2) + 1e-9
    pivots: list[np.ndarray] = []
    for r in chosen:
        v = np.frombuffer(r["vector"], dtype=np.float64)
        if all(v @ p < least for p in pivots):
            pivots.append(v)
    centre = np.array(pivots).reshape(-1, dim)
    index = table(index.mapInArrow(frugal(_balls(centre, least)), f"{schema}, ball long"), "balls")

    slots = table(index.select("cid", "ball", "code", F.posexplode("keys").alias("t", "key")), "slots")
    units = pair_units(slots, ["t", "key"], "cid", "ball", cap)
    order = ["t", "key", *UNIT]
    units = units.repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order).select("t", "key", *UNIT, "side", "cid", "ball", "code")
    near = units.mapInArrow(frugal(_near_codes(model)), "t int, key long, unit_lo int, unit_hi int, side int, cid long, ball long")
    near = table(near, "near")
    again = near.join(index.select("cid", "m", "vector", "keys"), "cid").repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    counts = again.select("t", "key", *UNIT, "side", "cid", "ball", "m", "vector", "keys").mapInArrow(frugal(_rerank(cosine)), "cid long, links long, root long")
    counts = table(counts, "counts")

    balls = index.where("ball is not null").groupBy("ball").agg(F.sum("m").alias("size"), F.min("cid").alias("head"))
    balls = table(balls, "heads")
    in_ball = index.select("cid", "ball").join(broadcast_if_small(balls), "ball")
    edges = counts.select(F.col("cid").alias("u"), F.col("root").alias("v")).union(in_ball.select("cid", "head"))
    comp = table(connected_components(edges, scratch, f"cc-{name}"), "comp")
    total = counts.groupBy("cid").agg(F.sum("links").alias("links"))
    full = index.select("cid", "least", "m", "ball").join(total, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    full = full.join(broadcast_if_small(balls.select("ball", "size")), "ball", "left")
    linked = F.coalesce("links", F.lit(0)) + F.coalesce("size", F.col("m")) - 1
    return table(full.select("cid", "least", linked.cast("long").alias("n_links"), F.coalesce("comp", "cid").alias("comp")), "full")


def near_duplicates(table: DataFrame, cosine: float = 0.9, recall: float = 0.95, sample: int = 20_000, cap: int = 2048) -> DataFrame:
    """(vec_id long, n_links long, component_id long, kept boolean), one row per row of
    ``table`` (vec_id, embedding: array of numbers; other columns are ignored).

    n_links counts the other rows linked directly; equal vectors link, also under one id.
    component_id is the smallest vec_id reachable, itself included; kept: vec_id is that.
    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, and those of different lengths do not link. A null vec_id is never the smallest
    unless all of its component are null. An empty table gives no rows.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # 128 bits name a vector's value; null vectors have no name
    named = F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.size("embedding")))
    rows = rows.withColumns({"h1": named, "h2": F.when(named.isNotNull(), F.xxhash64(F.lit(7), "embedding"))})
    with Scratch(table.sparkSession, "itq") as scratch:
        merged = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
        merged = scratch.table(merged.withColumns({"d": F.size("embedding"), "cid": F.monotonically_increasing_id()}), "merged")
        lengths = scratch.table(merged.where("d > 0").groupBy("d").agg(F.count("*").alias("n")), "lengths")
        large = lengths.where(F.col("n") > cap).union(lengths.orderBy(F.desc("n"), "d").limit(1)).distinct().orderBy("d").collect()  # a model each
        rest = lengths.where(~F.col("d").isin([r["d"] for r in large])).select("d")
        few = merged.join(broadcast_if_small(rest), "d").repartition("d").sortWithinPartitions("d")
        full = few.select("d", "cid", "least", "m", "embedding").mapInArrow(frugal(_whole(cosine)), "cid long, least long, n_links long, comp long")
        for r in large:
            full = full.union(_of_length(merged.where(F.col("d") == r["d"]), r["d"], r["n"], cosine, recall, sample, cap, scratch, str(r["d"])))
        full = scratch.table(full, "all")
        found = full.join(full.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").join(merged.select("cid", "h1", "h2"), "cid").select("h1", "h2", "n_links", "component_id")
        out = rows.select("vec_id", "h1", "h2").join(found, ["h1", "h2"], "left")
        component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        return scratch.keep(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
