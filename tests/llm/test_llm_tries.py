"""Prefix trie, byte BPE and filter audit against brute force and another encoder."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomdex.llm import audit, bpe, prefixes, ranks

RND = random.Random(5)
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EXTRA = {"n": 1, "node": "x", "depth": 0, "ids": "i", "decoded": 2, "__work": 3, "MASK": 4, "part": "p", "first": 0, "pos": 5, "__b": 6}


def extra(df):
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- trie


def plain_trie(rows):
    said = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(hashlib.sha256(role.encode()).digest() + hashlib.sha256(text.encode()).digest()).digest()
            said[c].append((t is not None, t or 0, role, tie, text))
    said = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in said.items()}
    trunc = lambda c: c - int(np.fmod(c, 5))
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = said.get(trunc(c), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(str(c) for c in m if len(built[c]) == len(n))))
        for n, m in members.items()
    )


def conversations():
    say = lambda k: f"{'é' * (k % 3)}said {k}"
    rows = []
    for c in range(-7, 60):
        opening = [say(k) for k in range(c % 3)]
        own = [say(RND.randint(0, 4)) for _ in range(RND.randint(1, 11))]
        rows += [(c, t, RND.choice(["user", "assistant"]) if t else "system", x) for t, x in enumerate(opening + own)]
    rows += [(100 + i, t, "user", f"same {t}") for i in range(40) for t in range(12)]  # copies
    rows += [(200, t, "user", f"same {t}") for t in range(3 * prefixes.PIECE)] + [(201, t, "user", f"same {t}") for t in range(2 * prefixes.PIECE + 9)]
    rows += [(205 + i, t, "user", f"long {t}") for i in range(2) for t in range(5 * prefixes.PIECE + i)]
    rows += [(300, None, None, None), (300, None, "", "x"), (300, 4, "user", None), (300, 4, "user", "b"), (300, 4, "assistant", "c"), (300, 4, "user", "b"), (None, 1, "user", "lost"), (301, 0, "user", "z" * 300_000)]
    rows += [(306, 0, "ab", "c"), (307, 0, "a", "bc"), (311, 1, "user", "only one"), (316, 1, "user", "only one")]
    RND.shuffle(rows)
    return rows


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bucket", [20_000, 50])
def test_trie_equals_plain(spark, monkeypatch, bucket):
    """Also where conversations and lists of members are cut into many buckets."""
    monkeypatch.setattr(prefixes, "ROWS_A_BUCKET", bucket)
    rows = conversations()
    got = prefixes.prefix_trie(extra(spark.createDataFrame(rows, KIND).repartition(3))).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))


def test_trie_of_little(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], KIND)).collect() == []
    for c in (1, 2, 3, 4, 6):  # without the first of their group; some end up without a turn
        rows = [(c, 0, "user", "hello")]
        assert [tuple(r) for r in prefixes.prefix_trie(spark.createDataFrame(rows, KIND)).orderBy("depth").collect()] == sorted(plain_trie(rows), key=lambda r: r[1])


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(VOCABULARY, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other():
    ranks_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_, special_tokens={})


def odd_texts():
    letters = "ab éßñ漢字🙂\n\t1٣'sx  ​\u0085क्"
    texts = ["".join(RND.choice(letters) for _ in range(RND.randint(0, 200))) for _ in range(300)]
    texts += ["a" * 3000, "ab" * 400 + "é" * 300, " " * 700, "", "x", "<|endoftext|>", "'ll're'S", "é" * 50]
    return texts + ["".join(RND.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n)) for n in (*range(1, 60), 255, 256, 257, 258, 700)]


def test_bpe_equals_another_encoder(spark, sf, vocabulary, other):
    texts = odd_texts() + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = extra(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = bpe.decode(bpe.encode(docs, vocabulary, keep=docs.columns), vocabulary, "ids_").collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["ids_"] == other.encode_ordinary(text) and bytes(r["decoded_"]) == text.encode()
        assert (r["ids"], r["decoded"], r["__work"]) == ("i", 2, 3)


def test_bpe_heap_and_matrix_merge_alike(vocabulary, other):
    for _ in range(200):
        piece = "".join(RND.choice("abcdeéß ") for _ in range(RND.randint(2, 120))).encode()
        ids = vocabulary.single[np.frombuffer(piece, dtype=np.uint8)]
        padded = np.concatenate([ids, [-1] * RND.randint(0, 9)]).astype(np.int32)
        assert bpe.merge_rows(padded[None, :], vocabulary.pairs)[0].tolist() == bpe.merge_long(piece, vocabulary).tolist()


def test_bpe_nulls_and_errors(spark, vocabulary, tmp_path):
    docs = spark.sql("select * from values (1, null), (2, ''), (2, ''), (3, cast(X'61FF62' as string)) t(doc_id, text)")
    got = {(r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()}
    assert {(1, (), b""), (2, (), b"")} < got and [d for i, _, d in got if i == 3] == ["a�b".encode()]
    assert bpe.encode(docs.limit(0), vocabulary).collect() == []
    assert bpe.decode(spark.sql("select cast(null as array<int>) as ids"), vocabulary).first()["decoded"] == b""
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.sql("select array(50256) as ids"), vocabulary).collect()
    small = tmp_path / "v"
    small.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no tokens"):
        bpe.read_vocabulary(str(small), ".")


def test_bpe_keeps_no_more_than_its_bound(vocabulary, other, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    encoder = bpe.Encoder(vocabulary)
    for text in odd_texts()[:100]:
        ids, begin = encoder.encode([text, text])
        assert ids[: begin[1]].tolist() == ids[begin[1] :].tolist() == other.encode_ordinary(text)


# ---------------------------------------------------------------- audit


def plain_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, q, t in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if t == 1 else set()
    rows = []
    for d, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), d is not None and d > first[text]]
        rows.append((source or "", {c for c, t in zip("ABCDE", tests) if t}, d in good and d is not None, d in toxic and d is not None))
    out, removed = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            alive = [r for r in rows if r[0] == part]
            for step, c in enumerate(order, 1):
                gone, here = [r for r in rows if r[0] == part and r[1] & set(order[: step - 1])], [r for r in alive if c in r[1]]
                alive = [r for r in alive if c not in r[1]]
                removed[part, c] += len(here)
                out[part, order, step] = (len(alive), len(here), sum(c in r[1] for r in gone), sum(r[0] == part and r[1] == {c} for r in rows), sum(r[2] for r in here), sum(r[3] for r in here))
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_running_every_order(spark):
    texts = [None, "", "one two", "Shout OUT LOUD now", "w " * 60, " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(80)) + " 5%", "x" * 200_000, "É é ABC" * 30]
    docs = [(i, RND.choice(texts), RND.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [docs[3], docs[3], (0, "one two", "c"), (None, "one two", "c"), (None, None, None), (7, "w " * 60, "a")]
    labels = [(i, RND.choice([0, 1, None]), RND.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    d = extra(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    lab = extra(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(d, lab).collect()}
    assert got == plain_audit(docs, labels)
    assert audit.audit(d.limit(0), lab).collect() == []
    assert audit.audit(d, lab.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_running_sums_of_pieces(spark):
    rows = [(k, i) for k in (1, None) for i in range(30)]
    d = spark.createDataFrame(rows, "k long, i long").withColumn("b", F.expr("i div 7"))
    got = {(r["k"], r["i"]): r["s"] for r in ranks.running(d, ["k"], "b", ["i"], {"s": F.col("i")}).collect()}
    assert got == {(k, i): i * (i - 1) // 2 for k, i in rows}
