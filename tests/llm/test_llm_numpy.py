"""Parts that need no Spark, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import chat, decontam, html, itq, lexer, mixing, sigtree, toxicity
from loomdex.llm.lexer import ALNUM, BLANK_SEPARATED, LETTERS


@pytest.mark.parametrize("lx,pattern", [(BLANK_SEPARATED, r"[^\x20\x09-\x0D]+"), (LETTERS, "[a-z\x80-\U0010ffff]+"), (ALNUM, "[a-z0-9\x80-\U0010ffff]+")])
def test_words(monkeypatch, lx, pattern):
    monkeypatch.setattr(lexer, "PIECE", 16)  # so that long rows are cut
    texts = ["Ab cD  ef", None, "", "Éa éA x1,y2", "word" * 40 + " a b " * 30, "\n\t", "😀 z\x0b\x0cq"]
    low = str.maketrans({c: c + 32 for c in range(65, 91)} | ({c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7} if lx.latin1 else {}))
    want = [[m for m in re.findall(pattern, (t or "").translate(low))] for t in texts]
    got, seen = [[] for _ in texts], {}
    for _, _, w in lexer.words(pa.array(texts), lx):
        for h, r, s, e in zip(w.hash, w.row, w.start, w.end):
            word = texts[r].encode()[s:e].decode().translate(low)
            got[r].append(word)
            assert seen.setdefault(int(h), word) == word
    assert got == want and len(set(seen.values())) == len(seen)


def test_segments_against_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 25)
        place = sorted(rnd.sample(range(n), rnd.randint(1, n)))
        score = [rnd.uniform(0.2, 2.0) for _ in place]  # no ties
        seq = np.full(n, -0.3)
        seq[place] = score
        # the best segment is taken, then the best ones left and right of it
        def best(lo, hi):
            found = max(((seq[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if found[0] <= 1e-12:
                return []
            a, b = found[3], found[4]
            return best(lo, a) + [(a, b)] + best(b, hi)

        got = [(place[f], place[e] + 1) for f, e, _ in toxicity.maximal_segments(np.array(place), np.array(score), 0.3)]
        total = lambda s: round(sum(seq[a:b].sum() for a, b in s), 6)
        assert total(got) == total(best(0, n)) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_signature_tree_loses_nothing():
    rnd = np.random.default_rng(5)
    base = [lexer.mix64(rnd.integers(0, 1 << 60, 40).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[i % 6][: 40 - rnd.integers(0, 7)], lexer.mix64(rnd.integers(0, 1 << 60, rnd.integers(0, 5)).astype(np.uint64))])) for i in range(70)]
    sizes, maps, comp = np.array([len(s) for s in sets]), np.stack([sigtree.bitmap(s) for s in sets]), np.arange(70) // 2
    true = {(i, j) for i in range(70) for j in range(i) if comp[i] != comp[j] and (c := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    tree = lambda at: sigtree.SignatureTree(sizes[at], maps[at], comp[at])
    i, j = sigtree.dual(tree(np.arange(70)), None, 80)
    got = list(zip(np.maximum(i, j).tolist(), np.minimum(i, j).tolist()))
    assert true and true <= set(got) and len(set(got)) == len(got) and len(got) < 70 * 69 / 4
    i, j = sigtree.dual(tree(np.arange(9)), tree(np.arange(9, 70)), 80)
    assert {(b, a) for a, b in true if b < 9 <= a} <= {(a, b + 9) for a, b in zip(i.tolist(), j.tolist())}
    assert len(sigtree.dual(tree(np.arange(1)), None, 80)[0]) == 0


def test_spaced_seeds():
    item = lexer.mix64(np.arange(1, 25, dtype=np.uint64))
    block = decontam.TestBlock([(7, item), (8, item[:5])])
    noise = lexer.mix64(np.arange(1000, 1100, dtype=np.uint64))
    text = np.concatenate([noise[:30], item, noise[30:]])
    text[[30 + 4, 30 + 9, 30 + 15]] = 1  # substitutions
    row = np.zeros(len(text), dtype=np.int64)
    (hit,) = [x for x in block.overlaps(text, row, 0, 1) if x[1] == 0]
    assert hit[2] >= 12 and hit[4] >= 30
    assert block.overlaps(noise, np.zeros(100, dtype=np.int64), 0, 1) == []
    assert [x[1:4] for x in block.overlaps(item[:5], np.zeros(5, dtype=np.int64), 0, 1)] == [(1, 5, 5)]
    assert decontam.best_run(np.array([1, 0, 1, 1, 1, 1, 0, 1], dtype=bool)) == (2, 6, 4)


def test_tempered_weights():
    w = mixing.tempered_weights([100, 400], 0.5, 300)
    assert w == [101, 201]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a<p>b <i>c</i>  d", "a\n\nb c d"),
        ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>", "- x\n- y\n  3. q\n  4. r"),
        ("<table><tr><th>A<th>Long head<tr><td>1<td colspan=2>2<td>z</table>", "A  Long head\n1  2            z"),
        ("<div hidden>n</div><div style='display:none'>n</div><style>.z{display:none}</style><b class='z'>n</b>v<template>n</template><script>var a='</p>';</script>", "v"),
        ("<p style='visibility:hidden'>n<span style='visibility:visible'>y</span></p>", "y"),
        ("<pre>  k\n   l</pre>", "  k\n   l"),
        ("a<br>b</p>c &lt;&amp;&copy; <!-- x -->d", "a\nb\n\nc <&© d"),
        ("<details><summary>S</summary>h</details><details open>i<summary>T</summary></details>", "S\niT" if False else "S\ni\nT"),
        ("", ""),
        ("just < text & more <unclosed", "just < text & more <unclosed"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>x<td><ul><li>p<li>q</ul><td>z<br>y</table>", "x  - p  z\n   - q  y"),
        ("<table><tr><td colspan=\u00b2>a<td colspan=0>b<td rowspan=x>c</table>", "a  b  c"),
        ("<table><tr><td>a<table><tr><td>in<td>ner<tr><td>r2</table><td>b</table>", "a        b\nin  ner\nr2"),
        ("<math><mi>x</mi><annotation>n</annotation></math> <svg><desc>n</desc><text>s</text><text>t</text></svg><map>m</map>", "x\ns\nt\nm"),
        ("<style>@media print{p{display:none}} /* .a{display:none} */ .b{display:none}</style><p class=b>n<p class=a>y", "y"),
        ("<a \"'>one</a> <a title='x>y'>two</a> <![CDATA[ c <b>", "one two"),
    ],
)
def test_render(page, want):
    assert html.render(page) == want


@pytest.mark.parametrize(
    "part",
    ["<div>", "<ul>", "<ul><li>x", "</i>", '<a "', "<a \"'>", "<a '>", "<![CDATA[", "<![CDATA[>", "<!-", "<style>", "/*", "@media ", "a{", "<p><table><tr><td>", "<td rowspan=9 colspan=1000>x", "<table><tr><td>", "<blockquote>x", "<b><p>", "&", "<svg>", "<style>p{display:none}</style><p class=c>"],
)
def test_time_grows_with_the_page(part):
    import time

    took = []
    for size in (100_000, 400_000):
        page = part * (size // len(part))
        t = time.perf_counter()
        html.render(page)
        html.render("<style>" + page)
        took.append(time.perf_counter() - t)
    assert took[1] < 1.0 or took[1] < 10 * took[0], took


def test_visible_words_against_the_standard_parser():
    """The words of well-formed pages, by the standard library's tokenizer."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            gone = tag in html.NEVER or "hidden" in a or "none" in (a.get("style") or "")
            if tag not in html.VOID:
                self.open.append((tag, gone))
            self.out.append(" ")

        def handle_endtag(self, tag):
            while any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
                pass
            self.out.append(" ")

        def handle_data(self, data):
            if not any(g for _, g in self.open):
                self.out.append(data)

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    assert pages
    for page in pages:
        w = Words()
        w.feed(page)
        w.close()
        letters = lambda t: re.findall(r"[^\W\d_]+", t)
        assert letters("".join(w.out)) == letters(html.render(page))



def test_schema_and_references():
    schema = {"type": "object", "properties": {"x": {"type": "integer", "minimum": 1}, "y": {"enum": ["a"]}}, "required": ["x"], "additionalProperties": False}
    assert chat.problems({"x": 1, "y": "a"}, schema) == [] and chat.problems({"x": {"$ref": "c"}}, schema) == []
    assert len(chat.problems({"y": "b", "z": 0}, schema)) == 3 and chat.problems({"x": True}, schema) == ["$.x: not integer"]
    assert chat.references({"a": [{"$ref": "i"}], "b": {"$ref": "j"}}) in (["i", "j"], ["j", "i"])
    assert chat.parse_message("user", "{not json")["json"] == '{"content":"{not json","role":"user"}'


def test_strict_json():
    bad = ['{"tool_calls":[{"id":"a","arguments":NaN}]}', '{"tool_calls":[{"id":"a","arguments":1e999}]}', '{"tool_calls":' + "[" * 100_000, '{"tool_call_id":"x","content":' + "[" * 900 + "]" * 900 + "}"]
    for text in bad[:3]:
        assert chat.parse_message("assistant", text)["json"] == chat.canonical({"content": text, "role": "assistant"})
    assert "NaN" not in chat.parse_message("a", bad[0])["calls"] and chat.parse_message("a", bad[3])["json"]
    odd = chat.parse_message("assistant", '{"tool_calls":[{"id":"\\ud800","name":"n\\udc00","arguments":{"x":"\\ud83d\\ude00 \\udfff"}}]}')
    assert odd["calls"][0]["id"] == "\ufffd" and "\U0001f600 \ufffd" in odd["json"]
    odd["json"].encode()


def test_topological_chain():
    n = 10_000
    p = np.arange(n - 1)
    got = {a: (b, c) for a, b, c in chat.topological(p, p + 1, n - p, n - p - 1)}
    assert got[n - 1] == (n, n - 1) and len(got) == n
    cycle = {a: b for a, b, _ in chat.topological(np.array([1, 2, 2]), np.array([2, 1, 3]), np.array([5, 6, 6]), np.array([6, 5, 7]))}
    assert cycle == {1: None, 2: None, 3: None}


@pytest.mark.parametrize("shared", [0.0, 0.25, 0.5, 0.72])
def test_itq_recall_at_the_threshold_off_centre(shared):
    g = np.random.default_rng(4)
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
    x = unit(np.sqrt(shared) * np.eye(64)[0] + np.sqrt(1 - shared) * unit(g.normal(size=(8000, 64))))
    to = g.normal(size=(1500, 64))
    y = 0.9 * x[:1500] + np.sqrt(0.19) * unit(to - (to * x[:1500]).sum(axis=1)[:, None] * x[:1500])
    model = itq.fit(x, len(x), 0.9, 0.95)
    a, b = model.codes(x[:1500]), model.codes(y)
    near = (a[:, : model.bits] != b[:, : model.bits]).sum(axis=1) <= model.differ
    assert (near & (model.keys(a) == model.keys(b)).any(axis=1)).mean() >= 0.93


@pytest.mark.parametrize("x", [np.eye(4)[:1], np.eye(4)[:2], np.array([[1.0, 0, 0], [-1.0, 0, 0]]), np.ones((1, 1)), np.eye(16)])
def test_itq_fits_few_vectors(x):
    model = itq.fit(x, len(x), 0.9, 0.95)
    assert model.keys(model.codes(x)).shape == (len(x), model.tables)


@pytest.mark.parametrize("n", range(1, 17))
def test_masks_meet_all_that_is_verified(n):
    """Every pattern of agreeing words that verification accepts holds a whole mask."""
    match = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
    accepted = np.concatenate([decontam.best_runs(m)[2] >= decontam.needed(n) for m in np.array_split(match, 1 + len(match) // 4096)])
    met = np.zeros(len(match), dtype=bool)
    for _, mask in decontam._masks_for(n):
        for at in range(n - len(mask) + 1):
            met |= match[:, [at + i for i, bit in enumerate(mask) if bit == "1"]].all(axis=1)
    assert accepted.any() and not (accepted & ~met).any()


@pytest.mark.parametrize("n", range(1, 12))
def test_short_items_have_a_seed_for_all_that_is_verified(n):
    item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    block = decontam.TestBlock([(0, item)])
    for bits in range(1 << n):
        match = np.array([bits >> i & 1 for i in range(n)], dtype=bool)
        for cut in (0, 1):  # the text may begin within the item
            text = np.where(match, item, np.uint64(7) + np.arange(n, dtype=np.uint64))[cut:]
            if len(text) and decontam.best_run(match[cut:])[2] >= decontam.needed(n):
                assert block.overlaps(text, np.zeros(len(text), dtype=np.int64), 0, 1), (n, match, cut)


def brute_overlaps(items, texts):
    out = {}
    for r, text in enumerate(texts):
        for k, want in enumerate(items):
            best = None
            for d in range(-len(want) + 1, len(text)):
                s, e = max(0, -d), min(len(want), len(text) - d)
                match = [text[d + i] == want[i] for i in range(s, e)]
                run, top = (0, 0, 0), 0
                for i in range(len(match)):
                    score = 0
                    for j in range(i, len(match)):
                        score += 1 if match[j] else -decontam.MISMATCH
                        if score > top:
                            top, run = score, (i, j + 1, sum(match[i : j + 1]))
                if best is None or run[2] > best:
                    best = run[2]
            if best is not None and best >= decontam.needed(len(want)):
                out[(r, k)] = best
    return out


@pytest.mark.parametrize("heavy", [0, 20, 1 << 16])
def test_repeated_words_against_brute_force(monkeypatch, heavy):
    monkeypatch.setattr(decontam, "HEAVY", heavy)
    rnd = random.Random(heavy)
    items = [["a"] * 20, ["a", "b"] * 9, ["a"] * 12 + ["c"] + ["a"] * 8, [rnd.choice("abcd") for _ in range(16)]]
    texts = [["a"] * 45, ["b", "a"] * 20 + ["c"] * 5, ["x"] * 30, ["a"] * 9 + ["c"] + ["a"] * 20, [rnd.choice("ab") for _ in range(50)], items[3] + ["a"] * 20, ["a"]]
    lex = lambda t: np.concatenate([w.hash for _, _, w in lexer.words(pa.array([" ".join(t)]), ALNUM)])
    block = decontam.TestBlock([(k, lex(t)) for k, t in enumerate(items)])
    h, row = np.concatenate([lex(t) for t in texts]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = {(r, k): m for r, k, m, *_ in block.overlaps(h, row, 0, len(texts))}
    want = brute_overlaps(items, texts)
    assert all(want[key] == m for key, m in got.items()) and got
    assert {key for key in want if key not in got} <= {key for key, m in want.items() if m < 16}  # seeds have six words in thirteen
    assert {r for r, *_ in block.overlaps(h, row, 0, len(texts), any_=True)} == {r for r, _ in got}


def test_repeated_words_take_little(monkeypatch):
    import time

    block = decontam.TestBlock([(1, np.full(100, 7, dtype=np.uint64)), (2, np.concatenate([np.full(99, 7), [8]]).astype(np.uint64))])
    h = np.full(300_000, 7, dtype=np.uint64)
    t = time.perf_counter()
    got = block.overlaps(h, np.zeros(len(h), dtype=np.int64), 0, 1)
    assert [(k, m) for _, k, m, *_ in got] == [(0, 100), (1, 99)] and time.perf_counter() - t < 20


def test_discriminant_against_plain_densities():
    """Scores from the cached factors against log-densities solved row by row."""
    from loomdex.llm import quality

    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(size=(60, 5)) * [1, 2, 3, 1, 1], g.normal(size=(40, 5)) + 1]) * [1, 10, 0.1, 5, 1]
    y = np.array([0] * 60 + [1] * 40)
    for alpha, gamma in ((0.0, 0.01), (0.3, 0.2)):
        model = quality.discriminant(x, y, alpha, gamma)
        z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
        cov = []
        for c in (0, 1):
            part = z[y == c] - z[y == c].mean(axis=0)
            cov.append(sum(np.outer(r, r) for r in part) / len(part))
        pooled = 0.6 * cov[0] + 0.4 * cov[1]
        want = []
        for row in z:
            density = []
            for c in (0, 1):
                s = (1 - alpha) * cov[c] + alpha * pooled
                s = (1 - gamma) * s + gamma * np.trace(s) / 5 * np.eye(5) + 1e-6 * np.eye(5)
                d = row - z[y == c].mean(axis=0)
                density.append(-0.5 * d @ np.linalg.solve(s, d) - 0.5 * np.linalg.slogdet(s)[1])
            want.append(density[1] - density[0])
        assert np.allclose(model.difference(x), want, atol=1e-8)
        model.slope, model.bias = 0.7, -0.2
        assert np.allclose(model.score(x), 1 / (1 + np.exp(-(0.7 * np.array(want) - 0.2))))


def test_toxicity_parts_against_brute_force():
    """Token choice by strings, lambda and K by their definitions, scores by all segments."""
    import math

    rnd = random.Random(9)
    bad, good = ["scumbag", "scummy", "idiot", "idiotic", "trash"], ["table", "chair", "river", "mount", "scuba", "ideal", "light"]
    text = lambda y: [rnd.choice(bad if y and rnd.random() < 0.3 else good) for _ in range(rnd.randint(5, 40))]
    docs = [(1, text(1)) for _ in range(30)] + [(0, text(0)) for _ in range(30)]
    hashes = {}

    def lex(words_):
        (_, _, w), = lexer.words(pa.array([" ".join(words_)]), LETTERS, toxicity.PREFIXES)
        for i, word in enumerate(words_):
            hashes[word, 99] = int(w.hash[i])
            hashes.update({(word[:p], p): int(w.prefix[p][i]) for p in toxicity.PREFIXES if p < len(word)})
        return w

    columns = {c: [] for c in toxicity._COUNTS}
    count = {0: {}, 1: {}}
    seen, ups, total = {}, {}, {0: 0, 1: 0}
    for y, words_ in docs:
        lex(words_)
        total[y] += len(words_)
        mine = {}
        for word in words_:
            for token in [(word, 99)] + [(word[:p], p) for p in toxicity.PREFIXES if p < len(word)]:
                mine[token] = mine.get(token, 0) + 1
                ups[token] = [(token[0][:p], p) for p in toxicity.PREFIXES if p < len(token[0]) and p < token[1]]
        for token, n in mine.items():
            count[y][token] = count[y].get(token, 0) + min(n, toxicity.BURST)
            if y:
                seen[token] = seen.get(token, 0) + 1
    tokens = sorted((t for t in seen if seen[t] >= toxicity.MIN_DOCS), key=lambda t: hashes[t])
    for t in tokens:
        columns["h"].append(hashes[t])
        columns["level"].append(t[1])
        columns["n"].append(count[1][t])
        columns["docs"].append(seen[t])
        for p in toxicity.PREFIXES:
            columns[f"up{p}"].append(next((hashes[u] for u in ups[t] if u[1] == p), 0))
    given = {c: np.array(v, dtype=np.uint64).view(np.int64) if c in ("h", *toxicity._COUNTS[4:]) else np.array(v, dtype=np.int64) for c, v in columns.items()}
    got = toxicity._select(given, total[1], np.array([count[0].get(t, 0) for t in tokens], dtype=float), total[0])
    n, expected, left, want = {t: float(count[1][t]) for t in tokens}, {t: count[0].get(t, 0) * total[1] / total[0] for t in tokens}, {t: float(seen[t]) for t in tokens}, {}
    for t in sorted(tokens, key=lambda t: -t[1]):
        if left[t] < toxicity.MIN_DOCS or n[t] <= expected[t]:
            continue
        s = math.log((n[t] + toxicity.PRIOR) / (expected[t] + toxicity.PRIOR)) - 1 / math.sqrt(left[t] + toxicity.PRIOR)
        if s >= toxicity.MIN_SCORE:
            want[hashes[t]] = s
            for u in ups[t]:
                if u in n:
                    n[u], expected[u] = n[u] - n[t], max(0.0, expected[u] - expected[t])
                    left[u] = min(left[u], n[u])
    assert dict(zip(got[0].tolist(), got[1].tolist())) == pytest.approx(want) and want

    model = toxicity.ToxicityModel(*got)
    rows = []
    for y, words_ in docs:
        w = lex(words_)
        s = toxicity.word_scores(model, model.seen(), w)
        p = np.flatnonzero(s)
        rows.append((y, len(w), [x for _, _, x in toxicity.maximal_segments(p, s[p])], s[p].tolist() if not y else []))
        whole = np.where(s > 0, s, -toxicity.DRIFT)
        best = max([whole[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert max(rows[-1][2], default=0.0) == pytest.approx(max(best, 0.0))
    toxicity._extreme_value(model, rows)
    clean = [r for r in rows if not r[0]]
    assert model.k == pytest.approx(len(clean) / sum(r[1] * math.exp(-model.lam * max(r[2], default=0.0)) for r in clean))
    toxicity._calibrate(model, rows, {0: 30, 1: 30})
    t = [sum(max(0.0, model.lam * s - math.log(model.k * n)) for s in seg) for _, n, seg, _ in rows]
    score = [toxicity.probability(model, x) for x in t]
    assert t == pytest.approx([toxicity.statistic(model, n, [(0, 0, s) for s in seg])[0] for _, n, seg, _ in rows])
    assert np.mean(score[:30]) > 0.6 > 0.4 > np.mean(score[30:])
