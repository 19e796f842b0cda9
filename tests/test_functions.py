from loomdex.functions import hooks
from loomdex.functions.trigrams import decode, encode, of_bytes
from loomdex.plans import globs, seeds
from loomdex.plans.planner import classify, plan, route
from loomdex.plans.request import InvalidQuery, SearchRequest
from loomdex.sources.ignore import rule

import re

import pytest
from pyspark.sql import functions as F


def test_trigrams():
    assert decode(encode(b"abc")) == b"abc"
    assert [decode(int(t)) for t in of_bytes(b"ABCab")] == [b"abc", b"bca", b"cab"]
    assert len(of_bytes(b"ab")) == 0


@pytest.mark.parametrize(
    "pattern,insensitive,want",
    [
        ("(foo)?bar", False, b"bar"),
        ("(?:abc)", False, b"abc"),
        ("(?P<n>abc)", False, b"abc"),
        (r"\x41BC", False, b"abc"),
        ("foo|ab", False, None),
        ("foo|bar", False, ("or", [b"foo", b"bar"])),
        ("abc.*def", False, ("and", [b"abc", b"def"])),
        ("(?:abcd){0,2}", False, None),
        ("(abc)+", False, b"abc"),
        ("[a-z]+", False, None),
        ("éab", True, None),
        (r"\bHeit\w*", False, b"heit"),
    ],
)
def test_seeds(pattern, insensitive, want):
    assert seeds.of_regex(pattern, insensitive) == want


def test_seeds_refuse_look_around():
    for p in ("(?=a)b", r"(a)\1", "(?<!a)b"):
        with pytest.raises(ValueError):
            seeds.of_regex(p)
    assert seeds.of_regex(r"\p{L}abc") is None


def test_planner():
    assert plan(SearchRequest(pattern="ab")).strategy == "direct_scan"
    assert plan(SearchRequest(pattern="abc")).selectivity == "medium"
    assert plan(SearchRequest(pattern="abcdef")).selectivity == "high"
    assert plan(SearchRequest(pattern="é", kind="literal")).selectivity == "low"
    assert plan(SearchRequest(kind="path", exact_names=("a",))).selectivity == "high"
    assert classify(500_001, 0) == "very_large" and classify(500_000, 0) == "large" and classify(0, 200 << 20) == "medium" and classify(4999, 0) == "small"
    r = SearchRequest(pattern="abcdef")
    assert route(r, plan(r), None, True)[0] == "indexed"
    assert route(r, plan(r), "small", True)[0] == "direct_scan"
    assert route(r, plan(r), "small", True, True)[0] == "indexed"
    assert route(SearchRequest(pattern="abcdef", engine="indexed", exact_paths=("a",)), plan(r), None, True)[0] == "direct_scan"
    with pytest.raises(InvalidQuery):
        SearchRequest(pattern="  ").checked()
    assert SearchRequest(pattern="a", extensions=(".RS",)).checked().extensions == ("rs",)


def test_globs():
    m = lambda g, p: bool(re.search(globs.to_regex(g), p))
    assert m("src/**/*.rs", "src/a.rs") and m("src/**/*.rs", "src/b/c/a.rs") and not m("src/**/*.rs", "lib/a.rs")
    assert m("*.rs", "a/b.rs") and m("{a,b}?.txt", "ax.txt") and not m("[!a].txt", "a.txt") and m("[!a].txt", "b.txt")


def test_ignore_rules():
    m = lambda line, p: bool(re.search(rule(line)[1], p))
    assert m("*.log", "a/b.log") and m("/build", "build/x") and not m("/build", "a/build") and m("target/", "a/target/x") and not m("target/", "target")
    assert rule("# x") is None and rule("!keep")[0]


def test_shell_words():
    assert hooks.split_words("cat 'a b' c\\ d \"e\\\"f\"") == ["cat", "a b", "c d", 'e"f']
    assert hooks.split_words("cat 'a") is None
    assert hooks.read_path("head -n 5 x.rs") == "x.rs" and hooks.read_path("sed -n '1,5p' y.rs") == "y.rs" and hooks.read_path("tail -- z") == "z"
    assert hooks.read_path("printf x\ncat q") == "q" and hooks.read_path("ls a") is None and hooks.read_path(None) is None


def test_shell_operands():
    assert hooks.read_path("head -- -n x") == "-n" and hooks.read_path("head -n -- x") == "x" and hooks.read_path("sed -e s/a/b/ one two") == "two" and hooks.read_path("cat -- a") == "a"
    assert hooks.read_path("head -n") is None and hooks.read_path("cat 'a b") is None and hooks.read_path("  \n") is None and hooks.read_path("tail -c 5 - f") == "f"
    assert hooks.split_words("a '' b") == ["a", "b"] and hooks.split_words("x\\") is None and hooks.split_words("p'q'\"r s\"t") == ["pqr st"]


def test_payloads(spark):
    import json

    rows = [
        {"tool_name": "Bash", "tool_input": {"command": ["bash", "-lc", "cat 'a b.txt'"]}},
        {"tool": "View", "path": "p"},
        {"tool": {"name": "Write"}, "tool_response": "12345678"},
        {"name": "x", "result": {"parsed_cmd": [{"type": "list"}, {"type": "READ"}, {"type": "read", "path": "q"}]}},
        {"tool_name": "mcp__fs__open_file", "command": ["ls"], "tokens": 7, "session": {"id": "s"}},
        {"tool_name": "Bash", "command": "[ -f x ] && cat y", "tokens": "7"},
    ]
    texts = [json.dumps(r) for r in rows] + ["not json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    p = F.col("p")
    got = df.select("i", hooks.event_kind(p), hooks.path(p), hooks.tokens(p), hooks.session_id(p), hooks.command(p)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("read", "a b.txt", None, None, "cat 'a b.txt'"), ("read", "p", None, None, None), ("edit", None, 3, None, None), ("read", "q", None, None, None),
        ("read", None, 7, "s", None), (None, None, None, None, "[ -f x ] && cat y"), (None, None, None, None, None), (None, None, None, None, None),
    ]
