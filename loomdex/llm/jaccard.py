"""N-gram Jaccard join with signature trees.

Exact: documents link when their sets of distinct word k-grams have a Jaccard similarity
of at least ``percent``/100, and every link between different sets is found or implied by
the component that is returned.

1. ``profile``: one pass over the texts gives each document the size and a 64-bit
   fingerprint of its set; equal fingerprints form a class, so copies are joined once.
   The same pass notes shingles that repeat within a task.
2. ``prefixes``: sets that reach the threshold share one of their first
   n - ceil(percent * n / 100) + 1 shingles in any common order. The order here puts
   shingles that many classes share last (a Bloom filter of fixed size names them; a
   false positive changes the order for all sets alike and loses nothing).
3. Classes that share a prefix shingle form a block. A block of two is a pair; such pairs are
   counted, and those with too few common shingles are dropped unless they meet in a larger
   block. Each larger block has a hub, the member
   of which the largest part is shared at all (a text that others were edited from). All
   members of the blocks of one hub form a group; two sets that link meet in at least one.
4. In each group the dual traversal of signature trees finds the members that can reach the
   threshold with another one: by sizes, by the overlap that the bitmaps allow, and by the
   prefix shingles that two linking sets have in common (``least_common``). The traversal
   leaves the task as a list of members, not of pairs.
5. The full sets of these members only come to the same groups, where the tree's pairs are
   counted exactly, first each member against the hub. A pair within a component is skipped,
   as its link would change nothing, so a group returns less links than it has members.

Groups over ``cap`` are first cut into parts that all hold the hub; what then is not yet of
one component is compared across parts by ``blocks.pair_units``. No group is collected,
capped or sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import UNIT, pair_units
from .components import connected_components
from .lexer import BLANK_SEPARATED, U64, mix64, per_row, shingle_set, signed, unsigned, words
from .scratch import Scratch, broadcast_if_small
from .sigtree import SignatureTree, bitmap, dual
from .stream import frugal, runs

#: Repeats within tasks, over all tasks, that make a shingle frequent.
FREQUENT = 4
BLOOM_BITS = 1 << 25
#: Shingles of a set that one row carries, and those that a member of a full unit has on average.
SET_ROW = 2048
SHINGLES_A_MEMBER = 512
GROUP = ["hub", *UNIT]
#: Parts that the members of a frequent shingle's block are spread over.
SALTS = 64
#: Members a task compares, and members of which a table is broadcast (about 200 bytes each).
ROWS_A_TASK = 20_000
MEMBERS_SENT = 200_000
_NO_ID = -(1 << 63)


def fingerprint(distinct: np.ndarray) -> int:
    """Order-free 64-bit value of a set of shingle hashes."""
    total = mix64(distinct ^ U64(0x8EBC6AF09C88C6E3)).sum(dtype=U64)
    return int(mix64(np.array([total], dtype=U64) ^ U64(len(distinct) * 0x589965CC75374CC3 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, k: int):
    """(row, its sorted distinct shingles) for each row of a batch with a column text."""
    for lo, hi, w in words(batch.column("text"), BLANK_SEPARATED):
        at = per_row(w.row, lo, hi)
        for r in range(lo, hi):
            yield r, shingle_set(w.hash[at[r - lo] : at[r - lo + 1]], k)


def _profile(k: int, buffered: int = 1 << 21):
    names = ["doc_id", "n", "cid", "token", "map"]

    def run(batches):
        held, size, seen = [], 0, set()

        def repeated() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            value, n = value[n > 1], n[n > 1]
            none = pa.nulls(len(value), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(n), none, pa.array(signed(value)), pa.nulls(len(value), pa.binary())], names=names)

        for batch in batches:
            n, cid = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            maps: list[bytes | None] = [None] * batch.num_rows
            for r, s in _sets(batch, k):
                n[r] = len(s)
                if not len(s):
                    continue
                cid[r] = fingerprint(s)
                if int(cid[r]) not in seen:
                    seen.add(int(cid[r]))
                    maps[r] = bitmap(s).tobytes()
                    held.append(s)
                    size += len(s)
                    if size >= buffered:
                        yield repeated()
                        held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(cid, mask=n == 0), pa.nulls(len(n), pa.int64()), pa.array(maps, pa.binary())], names=names)
        if held:
            yield repeated()

    return run


def _bloom(profile: DataFrame) -> np.ndarray:
    """Bits of the frequent shingles as 64-bit words; its size does not depend on the data."""
    hot = profile.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    at = F.explode(F.array(F.col("token").bitwiseAND(F.lit(BLOOM_BITS - 1)), F.shiftrightunsigned("token", 23).bitwiseAND(F.lit(BLOOM_BITS - 1))))
    cells = hot.select(at.alias("at")).select(F.shiftright("at", 6).alias("cell"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()  # BLOOM_BITS / 64 rows at most
    out = np.zeros(BLOOM_BITS // 64, dtype=U64)
    out[rows["cell"].to_numpy(dtype=np.int64)] = unsigned(rows["bits"].to_numpy(dtype=np.int64))
    return out


def _frequent(bloom: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    def has(at):
        return (bloom[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1

    mask = U64(BLOOM_BITS - 1)
    return has(tokens & mask) & has((tokens >> U64(23)) & mask)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def rounded_up(x, y: int):
    """Column x / y rounded up."""
    return -F.floor(-x / F.lit(float(y)))


def least_common_of(a: str, b: str, percent: int):
    """``sigtree.least_common`` of two columns."""
    o = rounded_up(percent * (F.col(a) + F.col(b)), 100 + percent)
    room = [o - rounded_up(percent * F.col(n), 100) + 1 for n in (a, b)]
    return F.greatest(F.least(*room), F.lit(1))


def _prefixes(k: int, percent: int, bloom):
    def run(batches):
        bits, seen = bloom.value, set()
        for batch in batches:
            cids, ns, rare, lists = [], [], [], []
            for _, s in _sets(batch, k):
                if not len(s) or (c := fingerprint(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(c)
                frequent = _frequent(bits, s)
                p = prefix_length(len(s), percent)
                cids.append(c)
                ns.append(len(s))
                rare.append(len(s) - int(frequent.sum()))
                lists.append(signed(np.concatenate([s[~frequent], s[frequent]])[:p] if frequent.any() else s[:p]))
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(ns, pa.int64()), pa.array(rare, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["cid", "n", "rare", "prefix"])

    return run


def _full_sets(k: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            cids, part, sets = [], [], []
            for _, s in _sets(batch, k):
                if not len(s) or (c := fingerprint(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(c)
                for i in range(0, len(s), SET_ROW):
                    cids.append(c)
                    part.append(i // SET_ROW)
                    sets.append(s[i : i + SET_ROW].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(part, pa.int32()), pa.array(sets, pa.binary())], names=["cid", "part", "shingles"])

    return run


def _unit(unit: pa.Table) -> dict[str, np.ndarray]:
    """Columns of the distinct members of a unit (a long set comes as several rows)."""
    cid, first, member = np.unique(unit.column("cid").to_numpy(), return_index=True, return_inverse=True)
    out = {c: unit.column(c).to_numpy()[first] for c in ("n", "shared", "comp", "side")}
    maps = unit.column("map").take(pa.array(first)).to_pylist()
    return out | {"cid": cid, "member": member, "map": np.frombuffer(b"".join(maps), dtype=np.uint64).reshape(len(cid), -1)}


def _pairs(u: dict[str, np.ndarray], label: np.ndarray, percent: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of members of different labels that may link and of which one at least
    is ``open_``, by dual traversal."""

    def tree(at):
        return SignatureTree(u["n"][at], u["map"][at], label[at], u["shared"][at])

    whole = (u["side"] == 0).any()
    sides = [(open_, np.ones(len(open_), dtype=bool))] if whole else [(open_ & (u["side"] == 1), u["side"] == 2), (open_ & (u["side"] == 2), u["side"] == 1)]
    left, right = [], []
    for a, b in sides:
        a, b = np.flatnonzero(a), np.flatnonzero(b)
        if len(a) and len(b):
            i, j = dual(tree(a), tree(b), percent)
            left.append(a[i])
            right.append(b[j])
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    once = ~open_[j] | (i < j)  # a pair of two open members comes twice
    return i[once], j[once]


def _able(percent: int):
    """Members of each unit that may link with a member of another component."""

    def run(batches):
        for unit in runs(batches, GROUP):
            u = _unit(unit)
            _, label = np.unique(u["comp"], return_inverse=True)
            able = np.zeros(len(label), dtype=bool)
            hub = np.flatnonzero(u["cid"] == unit.column("hub")[0].as_py())
            if len(hub) and (u["side"] == 0).all():
                h = np.zeros(len(label), dtype=bool)
                h[hub] = True
                i, j = _pairs(u, label, percent, h)
                able[i] = able[j] = True
            i, j = _pairs(u, label, percent, ~able)
            able[i] = able[j] = True
            if able.any():
                first = np.unique(u["member"], return_index=True)[1][able]
                yield from unit.take(pa.array(first)).combine_chunks().to_batches()

    return run


def linked(shared, a, b, percent: int):
    return (a > 0) & (b > 0) & (100 * shared >= percent * (a + b - shared))


def _links(percent: int):
    """Links (a, b) that join the components of each unit's members, counted on full sets."""

    def run(batches):
        for unit in runs(batches, GROUP):
            once = np.unique(np.stack([unit.column("cid").to_numpy(), unit.column("part").to_numpy()]), axis=1, return_index=True)[1]
            if len(once) < unit.num_rows:  # copies of a text that several tasks have seen
                unit = unit.take(pa.array(np.sort(once)))
            u = _unit(unit)
            n, cid = u["n"], u["cid"]
            parts = [np.frombuffer(x.as_buffer(), dtype=U64) for x in unit.column("shingles")]
            _, code = np.unique(np.concatenate(parts), return_inverse=True)
            owner = np.repeat(u["member"], [len(x) for x in parts])
            order = np.argsort(owner, kind="stable")
            code, at = code[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
            mark = np.zeros(int(code.max()) + 1, dtype=bool)
            _, label = np.unique(u["comp"], return_inverse=True)
            out: list[tuple[int, int]] = []

            def count(i: int, j: np.ndarray) -> None:
                """Joins what links with i."""
                j = j[label[j] != label[i]]
                if not len(j):
                    return
                mark[code[at[i] : at[i + 1]]] = True
                size = at[j + 1] - at[j]
                start = np.cumsum(size) - size
                both = np.add.reduceat(mark[code[np.arange(int(size.sum())) + np.repeat(at[j] - start, size)]], start, dtype=np.int64)
                mark[code[at[i] : at[i + 1]]] = False
                for k in j[linked(both, n[i], n[j], percent)].tolist():
                    if label[k] != label[i]:
                        out.append((min(cid[i], cid[k]), max(cid[i], cid[k])))
                        label[label == label[k]] = label[i]

            hub = np.flatnonzero(cid == unit.column("hub")[0].as_py())
            if len(hub) and (u["side"] == 0).all():
                near = (100 * n >= percent * n[hub[0]]) & (100 * n[hub[0]] >= percent * n)
                for block in np.array_split(np.flatnonzero(near), len(n) // 256 + 1):
                    count(int(hub[0]), block)
            open_ = label != np.bincount(label).argmax()
            i, j = _pairs(u, label.copy(), percent, open_)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for first, block in zip(i[np.concatenate([[0], cuts])] if len(i) else [], np.split(j, cuts)):
                for some in np.array_split(block, len(block) // 256 + 1):
                    count(int(first), some)
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, cap: int = 2048) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long), one row per row of ``docs``
    (columns doc_id and text; others are ignored, whatever their names).

    Words are runs of anything but blank, tab to carriage return, with A-Z lowered. A text
    of 1 to k-1 words is one shingle. A null, empty or blank text has 0 shingles and links
    with nothing: its component is its own doc_id. A null doc_id gets the component of
    its class, which is null if no member has an id. Repeated rows give repeated results.
    Memory: one document's set, one unit of 2 x cap members of SHINGLES_A_MEMBER shingles on
    average, and the fixed Bloom filter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark, "jaccard") as scratch:
        profile = scratch.table(rows.mapInArrow(frugal(_profile(k)), "doc_id long, n long, cid long, token long, map binary"), "profile")
        own = profile.where("token is null").select("doc_id", F.col("n").alias("n_shingles"), "cid")
        classes = scratch.table(own.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep")), "classes")
        bloom = spark.sparkContext.broadcast(_bloom(profile))
        prefixes = rows.select("text").mapInArrow(frugal(_prefixes(k, percent, bloom)), "cid long, n long, rare int, prefix array<long>")
        tokens = prefixes.select("cid", "n", "rare", F.posexplode("prefix").alias("at", "token")).withColumn("frequent", F.col("at") >= F.col("rare"))
        # a shingle that no task saw twice has no large block; the members of others are spread
        tokens = tokens.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).otherwise(-1))
        block = Window.partitionBy("token", "salt")
        seen = tokens.select("token", "salt", "cid", "n", "frequent").withColumn("lo", F.min("cid").over(block)).withColumn("hi", F.max("cid").over(block))
        seen = seen.where("frequent or lo < hi").dropDuplicates(["token", "salt", "cid"])
        seen = seen.withColumn("more", F.max((F.col("cid") != F.col("lo")) & (F.col("cid") != F.col("hi"))).over(block))
        seen = scratch.table(seen.select("token", "cid", "n", "frequent", "lo", "hi", "more"), "seen")
        often = seen.where("frequent")
        common = often.groupBy("token").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("token")
        multi = seen.where("not frequent and more").select("token", "cid", "n").union(often.join(common, "token", "left_semi").select("token", "cid", "n"))
        multi = scratch.table(multi, "multi")

        # most blocks are of two: the pair needs no hub, and its count is known unless it meets in others too
        two = seen.where("not frequent and not more").groupBy("lo", "hi").agg(F.min_by("n", "cid").alias("na"), F.max_by("n", "cid").alias("nb"), (F.count("*") / 2).cast("long").alias("c"))
        two = scratch.table(two, "two")
        each = two.select(F.explode(F.array("lo", "hi")).alias("cid"), "c").union(multi.groupBy("cid").agg(F.count("*").alias("c")))
        shared = scratch.table(each.groupBy("cid").agg(F.sum("c").alias("shared")), "shared")
        two = two.where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")) & (F.col("c") >= least_common_of("na", "nb", percent)))
        # a text that others were edited from shares all of its shingles, an edited one misses some
        part = F.col("shared") / (F.col("n") - rounded_up(percent * F.col("n"), 100) + 1)
        multi = scratch.table(multi.join(shared, "cid").select("token", "cid", "n", part.alias("part")), "ranked")
        hubs = multi.groupBy("token").agg(F.max(F.struct("part", "cid"))["cid"].alias("hub"))
        groups = multi.join(hubs, "token").select("hub", "cid", "n")
        groups = groups.union(two.select("lo", "lo", "na")).union(two.select("lo", "hi", "nb")).groupBy("hub", "cid").agg(F.first("n").alias("n"))
        maps = profile.where("map is not null").select("cid", "map").dropDuplicates(["cid"])
        groups = groups.join(shared, "cid").join(maps, "cid")
        groups = scratch.table(groups.select("hub", "cid", "n", "shared", F.col("cid").alias("comp"), "map"), "groups")
        load = F.greatest(F.lit(1.0), F.col("n") / F.lit(float(SHINGLES_A_MEMBER)))

        def links(units: DataFrame, name: str) -> DataFrame:
            """Links between the components of each unit's members."""
            fields = [*GROUP, "side", "cid", "n", "shared", "comp", "map"]
            keys = [F.col(c) for c in GROUP]
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups.count() // ROWS_A_TASK + 1)  # work follows members, not bytes
            able = units.select(*fields).repartition(tasks, *keys).sortWithinPartitions(*GROUP)
            able = able.mapInArrow(frugal(_able(percent)), "hub long, unit_lo int, unit_hi int, side int, cid long, n long, shared long, comp long, map binary")
            able = scratch.table(able, f"able-{name}")
            wanted = scratch.table(able.select("cid").distinct().join(classes, "cid").select(F.coalesce("rep", F.lit(_NO_ID)).alias("__id")).distinct(), f"wanted-{name}")
            keyed = rows.withColumn("__id", F.coalesce("doc_id", F.lit(_NO_ID)))
            texts = keyed.join(broadcast_if_small(wanted), "__id", "left_semi").select("text")
            full = texts.mapInArrow(frugal(_full_sets(k)), "cid long, part int, shingles binary")
            if able.limit(MEMBERS_SENT + 1).count() <= MEMBERS_SENT:  # the sets are shuffled once
                both = full.join(F.broadcast(able), "cid")
            else:
                both = full.repartition("cid").dropDuplicates(["cid", "part"]).join(able, "cid")
            both = both.select(*fields, "part", "shingles").repartition(tasks, *keys).sortWithinPartitions(*GROUP)
            return scratch.table(both.mapInArrow(frugal(_links(percent)), "a long, b long"), f"links-{name}").select(F.col("a").alias("u"), F.col("b").alias("v"))

        over = groups.groupBy("hub").agg(F.ceil(F.sum(load) / F.lit(float(cap))).cast("int").alias("parts")).where("parts > 1")
        over = scratch.table(over, "over")
        dealt = groups.join(broadcast_if_small(over), "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64("cid"), F.col("parts").cast("long")).cast("int")
        dealt = dealt.withColumn("unit_lo", F.explode(F.when(F.col("cid") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
        dealt = dealt.withColumn("unit_hi", F.col("unit_lo")).withColumn("side", F.lit(0))
        edges = links(dealt, "1")
        found = scratch.table(connected_components(edges, scratch, "cc1"), "comp-1")
        if over.limit(1).count():
            large = groups.join(broadcast_if_small(over.select("hub")), "hub", "left_semi").drop("comp").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
            mixed = large.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("hub")
            large = scratch.table(large.join(mixed, "hub", "left_semi"), "large")
            again = links(pair_units(large, ["hub"], "cid", "comp", cap, load), "2")
            found = scratch.table(connected_components(edges.union(again), scratch, "cc2"), "comp-2")

        member = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        member = scratch.table(member, "members")
        least = member.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = member.join(least, "comp").select("cid", "component_id")
        out = own.join(named, "cid", "left").select("doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        return scratch.keep(out)
