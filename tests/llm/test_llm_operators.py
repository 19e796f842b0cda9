"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import chat, decontam, html, itq, jaccard, licences, mixing, quality, shards, toxicity
from loomdex.llm.labelled import held_out

RND = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def edited(text, k):
    w = text.split(" ")
    for i in RND.sample(range(len(w)), k):
        w[i] = "EDIT" + str(RND.random())
    return " ".join(w)


def corpus():
    base, long_ = prose(150), prose(4000)
    rows = [(i, prose(RND.randint(1, 60)), "a") for i in range(30)]
    rows += [(100 + i, base, "b") for i in range(6)] + [(200 + i, edited(base, 1 + i % 4), "b") for i in range(25)]
    rows += [(300, long_, "c"), (301, edited(long_, 8), "c"), (302, long_.upper(), None), (400, None, None), (401, "", "a"), (402, " \n\t", "a"), (403, "one two", "a"), (404, "One  TWO", "a"), (None, base, "b")]
    rows += [rows[0], rows[0], (500, None, None)]
    return rows


def table(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.withColumns({"n": F.lit(1), "cid": F.lit("x"), "score": F.lit(0.5), "TOKEN": F.lit(2)})


def brute_components(rows, percent=80):
    tr = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(tr))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((r[0], len(s), name[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("cap", [2048, 3])
def test_jaccard(spark, cap):
    rows = corpus()
    got = Counter(map(tuple, jaccard.jaccard_components(table(spark, rows), cap=cap).collect()))
    assert got == brute_components(rows)


@pytest.mark.parametrize("cap", [2048, 40])
def test_jaccard_families(spark, cap):
    """Families of many edited copies, of which some link only with others of their kind."""
    g = np.random.default_rng(11)
    word = lambda: f"w{g.integers(0, 4000)}"
    rows = []
    for family in range(4):
        base = [word() for _ in range(int(g.integers(30, 90)))]
        for _ in range(60):
            t = list(base if g.random() < 0.7 or not rows else rows[int(g.integers(0, len(rows)))][1].split())
            for _ in range(int(g.integers(0, 4))):
                t[int(g.integers(0, len(t)))] = word()
            rows.append((len(rows) + 1, " ".join(t[: max(8, len(t) - int(g.integers(0, 4)))]), "s"))
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 20
    assert Counter(map(tuple, jaccard.jaccard_components(table(spark, rows), cap=cap).collect())) == want


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_itq(spark):
    g = np.random.default_rng(2)
    hot = g.normal(size=16)
    x = [*g.normal(size=(120, 16)), *(hot + 0.03 * g.normal(size=(60, 16))), *[hot] * 5]
    x += [v + 0.12 * np.linalg.norm(v) / 4 * g.normal(size=16) for v in x[:40]]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0]), (905, [float("inf")] * 16), (None, rows[0][1]), (3, rows[3][1])]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "m": F.lit(3), "keys": F.lit(0)})
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in itq.near_duplicates(t, cap=16).collect())
    both = [*rows, (None, rows[0][1]), (3, rows[3][1])]
    m = np.array([np.array(v, dtype=np.float32).astype(float) for _, v in both])
    m /= np.linalg.norm(m, axis=1)[:, None]
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    comp = np.arange(len(m))
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(m))])
        if (new == comp).all():
            break
        comp = new
    want = link.sum(axis=1)
    pairs = sorted(((i is None, i or 0), int(n)) for (i, _), n in zip(both, want))
    found = [(k, n) for k, n, _, _ in got if k[1] < 900 or k[0]]
    assert sum(n for _, n in found) >= 0.9 * sum(n for _, n in pairs) and all(a[1] <= b[1] for a, b in zip(found, pairs))
    hot_ids = {r[2] for r in got if 120 <= r[0][1] < 185}
    assert hot_ids == {120}
    assert all(n == 0 and c == k[1] and kept for k, n, c, kept in got if 900 <= k[1] < 906)
    assert itq.near_duplicates(t.limit(0)).count() == 0


def test_itq_off_centre(spark):
    g = np.random.default_rng(6)
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
    x = unit(0.85 * np.eye(64)[0] + np.sqrt(1 - 0.85**2) * unit(g.normal(size=(1500, 64))))
    to = g.normal(size=(500, 64))
    y = 0.902 * x[:500] + np.sqrt(1 - 0.902**2) * unit(to - (to * x[:500]).sum(axis=1)[:, None] * x[:500])
    m = np.concatenate([x, y])
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    link = unit(m) @ unit(m).T >= 0.9
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(t).collect()}
    assert all(got[i] <= n for i, n in enumerate(link.sum(axis=1))) and sum(got.values()) >= 0.93 * link.sum() >= 900


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).withColumn("h", held_out()).join(labels, "doc_id").where("h").toPandas()
    assert ((got["score"] >= 0.7) == (got["toxic"] == 1)).mean() > 0.95
    rows = [(1, "what an idiot and a moron, a stupid clown", "a"), (2, None, "a"), (3, "", "a"), (4, "x " * 300_000 + "idiot moron stupid scum", "a"), (1, "what an idiot and a moron, a stupid clown", "a")]
    out = toxicity.score(table(spark, rows), model, keep=["doc_id", "score"], passages=True).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 5 and out[0].__fields__ == ["doc_id", "score", "score_", "passages"] and by[2]["score_"] == by[3]["score_"] < 0.5
    assert by[1]["score_"] > 0.7 and "idiot" in by[1]["passages"][0]["text"] and by[4]["passages"][0]["start"] >= 600_000
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(3), none).select("score").distinct().count() == 1


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).withColumn("h", held_out()).join(labels, "doc_id").where("h").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.95
    out = quality.score(table(spark, [(1, None, "a"), (2, "", "a"), (3, "\n\n", "a"), (4, "x" * 2_000_000, "a")]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in out) and out[0]["score"] == out[1]["score"]
    assert quality.score(docs.limit(2), quality.fit(docs, labels.limit(0))).count() == 2


def test_decontamination(spark):
    item = " ".join(f"Q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "..."), (None, "alpha beta gamma delta"), (5, item)], "item_id long, text string")
    rows = [(1, prose(50) + ", " + item.lower().replace("q7", "zz") + " " + prose(9), "a"), (2, prose(80), "a"), (3, None, "a"), (4, "", "a"), (5, "say Alpha BETA gamma; delta!", "b"), (1, item, "b")]
    d = table(spark, rows).withColumn("contaminated", F.lit(7))
    got = {(r["doc_id"], r["item_id"]): r["matches"] for r in decontam.overlaps(d, bench, max_words=8).collect()}
    assert set(got) == {(1, 1), (1, 5), (5, None)} and max(got.values()) == 20
    kept = decontam.clean(d, bench)
    assert kept.columns == d.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [2, 3, 4]
    assert decontam.overlaps(d, bench.limit(0)).count() == 0 and decontam.clean(d, bench.limit(0)).count() == 6


def test_mixing(spark):
    rows = [(i, None, s) for s, n in (("a", 37), ("b", 9), (None, 5), ("c", 22)) for i in range(n)] + [(0, None, "a")]
    weights = {"a": 5, "b": 3, "c": 2}
    got = mixing.mix(table(spark, rows).withColumn("mix_slot", F.lit("x")), weights, block_rows=2).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(len(rows)))
    slots = {}
    for r in got:
        slots[r["mix_slot"]] = (r["mix_phase"], r["source"])
    assert sorted(slots) == list(range(len(slots)))
    left = Counter(s for _, s in slots.values())
    at, order = 0, [slots[i] for i in sorted(slots)]
    for phase in range(len(left)):
        part = [s for p, s in order if p == phase]
        active = {s: weights.get(s, 1) for s in left if left[s] > 0}
        had = Counter()
        for t, s in enumerate(part, 1):
            had[s] += 1
            assert all(abs(had[k] - t * w / sum(active.values())) < 1 for k, w in active.items())
        left -= had
        at += len(part)
    assert at == len(order) and mixing.mix(table(spark, [])).count() == 0


def test_sharding(spark):
    rows = corpus()
    got = shards.minimax_shards(table(spark, rows), 5).collect()
    assert len(got) == len(rows)
    size, first = Counter(), {}
    for d, t, _ in rows:
        size[t] += len((t or "").encode()) + 1
        first[t] = min(first.get(t, (9e9, "")), (-1 if d is None else d, ""))
    # null ids come first in the order of groups only if the group has no other id
    for t in first:
        ids = [d for d, x, _ in rows if x == t and d is not None]
        first[t] = min(ids) if ids else -1
    import hashlib

    order = sorted(size, key=lambda t: (first[t], b"" if t is None else hashlib.sha256(t.encode()).digest()))

    def walk(c):
        out, now = [[]], 0
        for t in order:
            if now + size[t] > c:
                out.append([])
                now = 0
            out[-1].append(t)
            now += size[t]
        return out

    c = next(c for c in range(max(size.values()), sum(size.values()) + 1) if len(walk(c)) <= 5)
    want = {t: i for i, part in enumerate(walk(c)) for t in part}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {r["capacity"] for r in got} == {c}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == Counter((d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()), want[t]) for d, t, _ in rows)
    assert shards.minimax_shards(table(spark, [])).count() == 0


def test_licences(spark):
    mit = licences.TEMPLATES["MIT"]
    rows = [(1, prose(300) + "\nReleased under the MIT License.\n" + prose(40), "a"), (2, prose(30) + " " + mit.upper() + " " + prose(300), "a"), (3, None, "a"), (4, "", "a"), (5, "the license of " + prose(20), "a"), (1, "all rights reserved", "b"), (7, mit.replace("hereby", "now").replace("merge", "fuse"), "a"), (8, mit[: len(mit) // 3], "a")]
    got = {(r["doc_id"], r["licence"]): r["containment"] for r in licences.scan(table(spark, rows)).collect()}
    assert set(got) == {(1, "MIT-notice"), (1, "all-rights-reserved"), (2, "MIT"), (7, "MIT")} and got[(2, "MIT")] == 1.0 and 0.8 <= got[(7, "MIT")] < 1
    assert licences.scan(table(spark, rows), {}).count() == 0
    bands = licences.bands_for(licences.TEMPLATES, 0.8, 0.999999)
    assert all((1 - licences.least_jaccard(licences.words_of(t), 0.8)) ** bands <= 1.01e-6 for t in licences.TEMPLATES.values())


def test_html(spark):
    t = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (3, "u", ""), (1, "u", "<p>a")], "page_id long, url string, html string").withColumn("TEXT", F.lit(1))
    assert sorted((r["page_id"], r["text"]) for r in html.extract(t).collect() if r["page_id"] != 2) == [(1, "a"), (1, "a"), (3, "")]


def brute_links(rows, cosine=0.9):
    """(vec_id, n_links, component_id) by comparing all pairs."""
    def unit(v):
        x = np.array([np.nan if c is None else c for c in v], dtype=float) if v else np.zeros(0)
        return x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None

    u = [unit(v) for _, v in rows]
    near = [[i != j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine for j in range(len(u))] for i in range(len(u))]
    root = list(range(len(u)))
    for _ in root:
        root = [min([root[i]] + [root[j] for j in range(len(u)) if near[i][j]]) for i in range(len(u))]
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root[i]].append(r[0])
    return Counter((r[0], sum(near[i]), min(least[root[i]])) for i, r in enumerate(rows))


def test_itq_lengths(spark):
    """Vectors link with those of their own length, whichever length is the commonest."""
    g = np.random.default_rng(8)
    rows = [g.normal(size=8).tolist() for _ in range(30)] + [[1.0, 0, 0], [1.0, 0.01, 0], [0.0, 0, 1], [1.0, 0, 0, 0, 0], [1.0] * 5, [1.0, 1, 1, 1, 0.9], [2.0], [3.0], [-1.0], [], None, [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [2.0, 0.0], [1.0, 0.0], [1.0, -0.0]]
    rows = list(enumerate([v if v is None else [c if c is None else float(c) for c in v] for v in rows]))
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(tuple(r)[:3] for r in got) == brute_links(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("shared", [0.0, 0.6, 0.8, 0.9])
def test_itq_recall_on_anisotropic_tables(spark, shared):
    """Links found against brute force, with a common direction in all vectors."""
    g = np.random.default_rng(int(shared * 10))
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(np.sqrt(shared) * np.eye(48)[0] + np.sqrt(1 - shared) * unit(g.normal(size=(700, 48))))
    x = np.concatenate([x, unit(x[:300] + 0.45 * np.sqrt(1 - shared) * unit(g.normal(size=(300, 48))))])
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    want = near.sum(axis=1)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.95 * want.sum() and want.sum() > 300


def test_chat_rows_of_their_own(spark):
    """Nulls and repeated rows are messages of their own, whatever their values share."""
    result = '{"tool_call_id":"a","content":"9"}'
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":{}}]}'
    rows = [(1, None, "tool", result), (None, 1, "tool", result), (1, 0, None, "x"), (1, 0, "x", None), (1, 5, "assistant", call), (1, 5, "assistant", call), (1, None, "tool", result)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert (got[1]["n_messages"], got[1]["n_linked"], got[1]["n_orphans"], got[1]["n_calls"]) == (6, 2, 0, 2)
    assert (got[None]["n_messages"], got[None]["n_linked"], got[None]["n_orphans"]) == (1, 0, 1)


@pytest.mark.parametrize("local", [200_000, 1])
def test_chat_declared_tools_and_chains(spark, local):
    """Schemas come from the conversation; chains against the turns are turned round, by either way."""
    call = lambda i, args, name="add": json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args}]})
    schema = {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}
    rows = [(1, 9, "system", json.dumps({"tools": [{"function": {"name": "add", "parameters": schema}}, {"name": "add", "parameters": {"enum": []}}, 5]}))]
    rows += [(1, 0, "assistant", call("a", {"x": 1})), (1, 1, "assistant", call("b", {})), (1, 2, "assistant", call("c", {"x": 1}, "other")), (2, 0, "assistant", call("a", {}, "other"))]
    rows += [(3, 10 - i, "assistant", call(f"c{i}", {"$ref": f"c{i - 1}"} if i else {})) for i in range(6)] + [(4, 0, "assistant", call("s", {"$ref": "s"})), (4, 1, "tool", "plain")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), local=local).collect()}
    assert {k: (r["n_calls"], r["n_invalid"], r["n_cyclic"]) for k, r in got.items()} == {1: (3, 2, 0), 2: (1, 0, 0), 3: (6, 0, 0), 4: (1, 0, 0)}
    assert [m["tool_calls"][0]["id"] for m in json.loads(got[3]["json"])["messages"]] == [f"c{i}" for i in range(6)]


def test_chat(spark):
    call = lambda i, args: json.dumps({"content": None, "tool_calls": [{"id": i, "name": "add", "arguments": args}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id":"b","content":"9"}'), (1, 2, "tool", '{"tool_call_id":"a","content":"7"}'), (1, 3, "assistant", call("b", {"x": {"$ref": "a"}, "y": 1})), (1, 4, "assistant", call("a", '{"y":2,"x":"no"}')), (1, 5, "tool", '{"tool_call_id":"zz","content":"?"}')]
    rows += [(2, 0, "assistant", call("p", {"x": {"$ref": "q"}, "y": 1})), (2, 0, "assistant", call("q", {"x": {"$ref": "p"}, "y": 1})), (None, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("calls", F.lit(1))
    tools = {"add": {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "number"}}, "required": ["x", "y"]}}
    got = {r["conv_id"]: r for r in chat.format_conversations(t, tools, part_rows=256).collect()}
    said = [m.get("tool_call_id") or (m.get("tool_calls") or [{}])[0].get("id") or m["content"] for m in json.loads(got[1]["json"])["messages"]]
    assert said == ["hi", "a", "a", "b", "b", "zz"]
    assert (got[1]["n_calls"], got[1]["n_invalid"], got[1]["n_linked"], got[1]["n_orphans"]) == (2, 1, 2, 1)
    assert got[2]["n_cyclic"] == 2 and got[3]["n_messages"] == 2 and json.loads(got[None]["json"])["messages"] == [{"content": None, "role": None}]
    parts = chat.format_conversations(t.where("conv_id = 1").drop("calls"), part_rows=4).collect()
    assert sorted((r["part"], r["n_messages"]) for r in parts) == [(0, 4), (1, 2)]
    assert math.isclose(sum(r["n_messages"] for r in parts), 6)
