"""Context packs choose among all files that match, not among those that each term finds first."""

import random

import duckdb
import pytest

from loomdex import oracle, queries
from loomdex.functions.text import BUGFIX_TERMS
from loomdex.operators import index as ix, pack, search as se, segments
from test_operators import docs, live

WORDS = ["alpha", "Alpha", "bet", "beta", "gamma", "delta", "error", "zeta", "eta", "theta", "none", "of", "these", "é", "unit"]


def _rows(n, seed=3):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 1, 2, 9, 60])))
    where = lambda i: rnd.choice(["src/", "tests/", "config/", "src/fixtures/", "src/error/", "tests/unit_", "a/Unit/test_"]) + f"{rnd.choice(WORDS[:4])}{i}.txt"
    return [(i, where(i), rnd.choice([None, ""]) if rnd.random() < 0.1 else rnd.choice(["\n", "\r\n"]).join(line() for _ in range(rnd.randint(1, 7)))) for i in range(n)]


def _low(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def _want(rows, goal, intent, changed=()):
    """path, score, reasons and snippets of all files, one after another."""
    terms, out = pack.goal_terms(goal), {}
    texts = {p: (t or "").replace("\r\n", "\n").split("\n") for _, p, t in rows}
    cut = lambda s: s if len(s) <= 180 else s[:179] + "…"
    entry = lambda p: out.setdefault(p, [0.0, set(), []])
    for t in terms:
        for p, ls in texts.items():
            hits = [(i + 1, len(x[: _low(x).index(t)].encode()) + 1, cut(x)) for i, x in enumerate(ls) if t in _low(x)]
            if hits:
                entry(p)[0] += 12.0 if t in BUGFIX_TERMS else 4.0
                entry(p)[1].add("content_match")
                entry(p)[2] = (entry(p)[2] + hits[:2])[:3]
            if t in _low(p):
                entry(p)[0] += 2.0
                entry(p)[1].add("path_match")
    for p in changed:
        entry(p)[0] += 12.0 if intent == "review" else 8.0
        entry(p)[1].add("changed_file")
    for p, e in out.items():
        low = _low(p)
        test = any(x in low for x in ("/test", "tests/", "_test.", ".test.", "_spec.", ".spec."))
        for is_, n, tag in ((test, 3, "test_adjacent"), ("config" in low, 2, "config_like"), ("fixture" in low, 2, "fixture_like")):
            if is_:
                e[0] += n
                e[1].add(tag)
        if intent == "bugfix":
            e[0] += 2 * any(t in BUGFIX_TERMS for t in terms) + 8 * (not test) + 2 * any(x in low for x in ("panic", "error", "fail"))
        else:
            e[0] += 2 * test
        near = sum(test and len(t) >= 4 and t in low for t in terms)
        e[0] += 4 * near
        if near and not e[2]:
            e[2] = [(i + 1, 1, cut(x)) for i, x in enumerate(texts[p]) if x.strip()][:1]
    return sorted(((p, s, sorted(r), x) for p, (s, r, x) in out.items()), key=lambda r: (-r[1], r[0]))


def _stored(spark, path, rows):
    """An index of several segments, some of whose rows are gone."""
    old = docs(spark, [(i, p, "alpha beta gamma of before" if i % 9 == 0 else t) for i, p, t in rows] + [(10**6, "tests/gone_alpha.txt", "alpha beta gamma delta error")])
    ix.build(old, path)
    segments.change(spark, path, docs(spark, [r for r in rows if r[0] % 9 == 0]), old.where("doc_id = 1000000").select("relative_path"))
    return ix.load(spark, path)


def test_a_file_behind_many_others_can_be_the_best(spark):
    rows = [(i, f"src/f{i:03}.txt", "alpha and alpha") for i in range(60)] + [(99, "src/z.txt", "alpha\nbeta")]
    p = pack.pack(live(spark, rows), "alpha beta", max_files=2)
    assert [(x["path"], x["score"], len(x["snippets"])) for x in p["items"]] == [("src/z.txt", 16.0, 2), ("src/f000.txt", 12.0, 1)] and p["truncated"]
    many = [(i, f"src/unit{i:03}.txt", None) for i in range(30)] + [(99, "tests/unit.txt", "\n the first ")]
    first = pack.pack(live(spark, many), "read a unit", "review")["items"][0]
    assert (first["path"], first["score"], first["snippets"]) == ("tests/unit.txt", 11.0, [{"line": 2, "column": 1, "preview": " the first "}])


LONG = "Bet delta gamma theta none these zeta eta ALPHA"  # more than six terms


@pytest.mark.parametrize("kind,intent,goals", [("memory", "bugfix", [LONG, "the fix"]), ("stored", "review", ["alpha error unit"]), ("asked", "bugfix", ["alpha error unit"])])
def test_a_pack_is_the_head_of_all_files(spark, tmp_path, monkeypatch, kind, intent, goals):
    rows = _rows(150)
    if kind == "asked":  # as an index of much text is
        monkeypatch.setattr(se, "JOB_BYTES", 0)
    i = live(spark, rows) if kind == "memory" else _stored(spark, str(tmp_path / "index"), rows)
    changed = ("./src/new.txt", rows[7][1], "")
    for goal in goals:
        want = _want(rows, goal, intent, ("src/new.txt", rows[7][1]))
        got = [(r["path"], r["score"], r["reasons"], [tuple(s) for s in r["snippets"]]) for r in pack.rank(i, goal, intent, changed, limit=None).collect()]
        assert got == want
        p = pack.pack(i, goal, intent, 4000, 12, changed)
        assert [(x["path"], x["score"], x["reasons"]) for x in p["items"]] == [r[:3] for r in want[: len(p["items"])]] and p["items"]
        assert [[tuple(s.values()) for s in x["snippets"]] for x in p["items"][:3]] == [r[3] for r in want[: len(p["items"])][:3]]
        assert p["truncated"] == (len(want) > len(p["items"]))


def test_scores_shuffle_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(se, "JOB_BYTES", 0)
    i = _stored(spark, str(tmp_path / "index"), _rows(60))
    plan = pack.scores(i, "alpha error unit")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert all("contents" not in x and "line_text" not in x for x in plan.split("\n") if "Exchange" in x)


def test_context_pack_budget_takes_all_files(spark, tmp_path):
    """Its ranks and scores by SQL, over many more files than each search was cut to."""
    path = f"{tmp_path}/documents.parquet"
    duckdb.sql(f"""COPY (SELECT i::BIGINT AS doc_id, 'src' || (i % 3 + 1) AS source, 'en' AS lang,
      'under a license' || CASE WHEN i % 7 = 0 THEN chr(10) || 'Heit' ELSE '' END || CASE WHEN i IN (433, 434) THEN ' error of onion' ELSE '' END AS text FROM range(480) t(i)) TO '{path}'""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    parts = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {12 if t == 'error' else 4} ELSE 0 END" for t in pack.goal_terms(queries.PACK_GOAL))
    want = con.execute(f"WITH {oracle._DOCS}, s AS (SELECT relative_path, {parts} AS s FROM docs) SELECT relative_path, s + 10.0 FROM s WHERE s > 0 ORDER BY s DESC, relative_path").fetchall()
    got = queries.context_pack_budget(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r["path"], r["score"]) for r in got] == [(p, float(s)) for p, s in want[: len(got)]] and len(got) == 6
    assert got[0]["path"] == "src3/en/doc_434.txt" and got[0]["score"] == 34.0 and all(r["truncated"] for r in got)
