"""Searching: path filters, candidates, exact line matches, limits and summaries."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, lines, literal_column, regex_column
from ..plans.globs import to_regex
from ..plans.planner import plan, route
from ..plans.request import InvalidQuery, SearchRequest
from ..plans.seeds import Condition, PathSeed, check_dialect, fold, join_and, join_or, literals, named_groups
from .index import Index, candidates, most
from .lookup import LOOKUP, ranges
from .segments import KEY

#: Only a newline ends a line; classes and word boundaries know all letters; case is that of A-Z.
DIALECT = "(?dU-u)"
#: A condition met by at most so many times LOOKUP documents, by its frequencies, is counted
#: before it is decided whether to look its candidates up or to join them.
COUNTED = 64
#: What can be read in about the time that one more job takes: an index on disk is asked for
#: candidates only if it may spare more than that. Path searches read about PATH_BYTES a document.
JOB_BYTES, PATH_BYTES = 64 << 20, 64
#: Documents that a search with a limit over all files verifies first, and how that number grows.
FIRST, GROWTH = 32, 4
#: Candidates up to this bound (8 bytes each) are broadcast.
SENT = 1_000_000


def _any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def path_predicate(request: SearchRequest, with_pattern: bool = False, path: Column | None = None, name: Column | None = None, extension: Column | None = None) -> Column:
    """All path filters of a request on relative_path, file_name and extension, or the columns
    given. Names and path parts ignore the case of A-Z; exact paths and prefixes do not."""
    path = F.col("relative_path") if path is None else path
    name = F.col("file_name") if name is None else name
    extension = F.col("extension") if extension is None else extension
    low = ascii_lower(path)
    fold = lambda s: s.translate({c: c + 32 for c in range(65, 91)})
    tests = []
    if request.exact_paths:
        tests.append(path.isin(*request.exact_paths))
    if request.exact_names:
        tests.append(ascii_lower(name).isin(*map(fold, request.exact_names)))
    if request.extensions:
        tests.append(F.coalesce(ascii_lower(extension).isin(*request.extensions), F.lit(False)))
    if request.path_prefixes:
        tests.append(_any_of([path.startswith(p) for p in request.path_prefixes]))
    if request.path_substrings:
        tests.append(_any_of([low.contains(fold(p)) for p in request.path_substrings]))
    if request.globs:
        tests.append(_any_of([path.rlike(to_regex(g)) for g in request.globs]))
    if with_pattern and request.pattern:
        tests.append(low.contains(fold(request.pattern)))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def in_scope(request: SearchRequest, path: Column) -> Column:
    """Whether a path falls under the filters of a request, its pattern too if paths are sought."""
    name = F.element_at(F.split(path, "/"), -1)
    return path_predicate(request, request.kind == "path", path, name, F.regexp_extract(name, r".\.([^.]+)$", 1))


def compiled(spark, request: SearchRequest) -> SearchRequest:
    """The checked request, of whose pattern the engine that matches can make sense."""
    request = request.checked()
    if request.kind != "path" and request.effective_kind == "regex":
        check_dialect(request.pattern)
        try:
            spark._jvm.java.util.regex.Pattern.compile(named_groups(request.pattern, "(?<"))
        except IllegalArgumentException as e:
            raise InvalidQuery(str(e).split("\n")[0]) from e
    return request


def _matcher(request: SearchRequest) -> tuple[Column, Column]:
    """(matches, byte column) on a column ``line_text``."""
    line = F.col("line_text")
    if request.effective_kind == "literal" and request.case == "sensitive":
        return line.contains(request.pattern), literal_column(line, request.pattern)
    pattern = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", request.pattern) if request.effective_kind == "literal" else request.pattern
    if request.effective_kind == "regex":
        check_dialect(pattern)
        pattern = named_groups(pattern, "(?<")
    pattern = f"{DIALECT}{'(?i)' if request.case == 'insensitive' else ''}(?:{pattern})"
    return line.rlike(pattern), regex_column(line, pattern)


def verify(docs: DataFrame, request: SearchRequest) -> DataFrame:
    """relative_path, line_number, column and line_text of every matching line."""
    split = docs.where(F.col("contents").isNotNull()).select("relative_path", F.posexplode(lines(F.col("contents").cast("string"))).alias("n", "line_text"))
    hit, column = _matcher(request)
    return split.where(hit).select("relative_path", (F.col("n") + 1).alias("line_number"), column.alias("column"), "line_text")


def limited(hits: DataFrame, request: SearchRequest) -> DataFrame:
    """The first max_results lines, by path and line: of all files or of each file."""
    if request.max_results is None:
        return hits
    if request.limit_mode == "per_file":
        w = Window.partitionBy("relative_path").orderBy("line_number")
        return hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= request.max_results).drop("__n")
    return hits.orderBy("relative_path", "line_number").limit(request.max_results)


def path_condition(request: SearchRequest, with_pattern: bool = False) -> Condition:
    """Literals that the path of every hit holds, of at least three bytes each, or None. A file's
    name is the last part of its path; its extension need not be (a table may have its own)."""
    seed = lambda text: PathSeed(fold(text.encode())) if len(text.encode()) >= 3 else None
    any_of = [request.exact_paths, request.exact_names, request.path_prefixes, request.path_substrings]
    parts = [join_or([seed(t) for t in texts]) for texts in any_of if texts]
    return join_and([*parts, seed(request.pattern) if with_pattern else None])


def _condition(index: Index, request: SearchRequest, engine: str | None) -> Condition:
    """What an index can tell of a request's documents: seeds of the pattern, and of the path
    where there are postings of paths. A direct scan that was asked for uses none."""
    found = plan(request)
    chosen = engine or route(request, found, None, True)[0]
    path = path_condition(request, request.kind == "path") if index.stored and engine != "direct_scan" and request.engine != "direct_scan" else None
    return join_and([found.condition if chosen == "indexed" else None, path])


def _narrowed(index: Index, condition: Condition, probe: bool) -> DataFrame:
    """The live documents that may meet a condition. Few candidates are looked up by ranges of
    their keys, which folders and pages are pruned by; more are joined. The frequencies tell
    whether counting them first can pay."""
    stored, frequency = index.stored, index.frequency() if probe else None
    wanted = candidates(stored.postings() if stored else index.postings, condition, frequency)
    if wanted is None:
        return index.docs.where(F.lit(False))
    if stored is None:
        return index.docs.join(wanted, "doc_id", "left_semi")
    wanted = stored.live(wanted)
    bound = most(condition, frequency) if frequency else None
    if bound is not None and bound <= COUNTED * LOOKUP:
        keys = [tuple(r) for r in wanted.limit(LOOKUP + 1).collect()]
        if len(keys) <= LOOKUP:
            return stored.docs().where(ranges(keys)).drop("segment")
    return stored.docs().join(F.broadcast(wanted) if bound is not None and bound <= SENT else wanted, KEY, "left_semi").drop("segment")


def _keys(index: Index, condition: Condition) -> DataFrame:
    """segment, doc_id and the columns of paths of the live documents that may meet a
    condition; contents are not read."""
    stored = index.stored
    docs = stored.live(stored.docs().select(*KEY, "relative_path", "file_name", "extension"))
    if condition is None:
        return docs
    wanted = candidates(stored.postings(), condition, index.frequency())
    if wanted is None:
        return docs.where(F.lit(False))
    small = most(condition, index.frequency()) <= SENT
    return docs.join(F.broadcast(wanted) if small else wanted, KEY, "left_semi")


def _leading(index: Index, request: SearchRequest, condition: Condition) -> DataFrame | None:
    """The first documents in order of path that fill a limit over all files, or all that there
    are; None if LOOKUP of them do not. Only they are read: candidates are ordered by path
    without their texts, and verified in runs that grow until the limit is full."""
    keys = _keys(index, condition).where(path_predicate(request)).select("relative_path", *KEY)
    at = lambda path, *key: F.struct(path, *[k.cast("long") for k in key])
    taken, hits, n, order = [], 0, FIRST, at(F.col("relative_path"), *map(F.col, KEY))
    while len(taken) + n <= LOOKUP:
        rest = keys.where(order > at(*map(F.lit, taken[-1]))) if taken else keys
        run = [tuple(r) for r in rest.orderBy("relative_path", *KEY).limit(n).collect()]
        taken += run
        if len(run) == n:
            hits += verify(index.stored.docs().where(ranges([r[1:] for r in run])), request).limit(request.max_results).count()
        if len(run) < n or hits >= request.max_results:
            return index.stored.docs().where(ranges([r[1:] for r in taken])).drop("segment")
        n *= GROWTH
    return None


def _pays(index: Index, request: SearchRequest, engine: str | None) -> bool:
    """Whether an index may spare more than asking it costs; an engine that is named decides."""
    if index.stored is None or engine is not None or request.engine != "auto":
        return True
    m = index.stored.manifest
    return (m.docs * PATH_BYTES if request.kind == "path" else m.bytes) > JOB_BYTES


def _meeting(index: Index, condition: Condition, pays: bool, probe: bool = True) -> DataFrame:
    """The live documents that may meet a condition, or all where the index cannot serve."""
    if condition is None:
        return index.docs
    if probe and index.stored and most(condition, index.frequency()) > SENT:
        return index.docs  # read where they are; to join so many would shuffle every text
    if pays:
        return _narrowed(index, condition, probe)
    return index.docs if most(condition, index.frequency()) else index.docs.where(F.lit(False))


def candidate_docs(index: Index, request: SearchRequest, engine: str | None = None, probe: bool = True) -> DataFrame:
    """Documents to verify: path filters, and the index's candidates where it can serve.
    ``probe``: the rarest trigrams of each literal are enough; otherwise the candidates hold
    all of them. Of a small index only the frequencies are asked, whether there can be any."""
    docs = _meeting(index, _condition(index, request, engine), _pays(index, request, engine), probe)
    return docs.where(path_predicate(request, request.kind == "path"))


def holding(index: Index, terms: list[str]) -> DataFrame:
    """relative_path, ``texts`` and ``paths``: the numbers of the terms (without line ends) that
    a file's text and its path hold, whatever the case of A-Z. All files with any, without a
    limit, a row for the text and one for the path: texts are read once for all terms, and not
    split into lines; paths are read without them."""
    spark, none = index.docs.sparkSession, F.array().cast("array<int>")
    texts = [compiled(spark, SearchRequest(pattern=t, case="insensitive")) for t in terms]
    paths = [compiled(spark, SearchRequest(pattern=t, kind="path", case="insensitive")) for t in terms]
    which = lambda tests: F.filter(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]), lambda x: x.isNotNull())
    docs = lambda some: _meeting(index, join_or([_condition(index, r, None) for r in some]), _pays(index, some[0], None))
    held = docs(texts).where(F.col("contents").isNotNull()).select("relative_path", F.col("contents").cast("string").alias("line_text"))
    held = held.select("relative_path", which([_matcher(r)[0] for r in texts]).alias("texts"), none.alias("paths")).where("size(texts) > 0")
    named = docs(paths).select("relative_path", none.alias("texts"), which([path_predicate(r, True) for r in paths]).alias("paths")).where("size(paths) > 0")
    return held.unionByName(named)


def documents_at(index: Index, paths: list[str]) -> DataFrame:
    """The documents of a few paths. Of an index on disk paths are read to find their keys, and
    texts only by ranges of these."""
    here = F.col("relative_path").isin(*paths)
    if index.stored is None:
        return index.docs.where(here)
    keys = [tuple(r) for r in _keys(index, None).where(here).select(*KEY).collect()]
    return index.stored.docs().where(ranges(keys)).drop("segment")


def candidate_paths(index: Index, request: SearchRequest) -> DataFrame:
    """relative_path, file_name and extension of the documents whose paths hold all trigrams
    of what a request asks of them, before any path is compared; no text is read."""
    condition = path_condition(request, request.kind == "path")
    docs = index.docs if condition is None or index.stored is None else _narrowed(index, condition, True)
    return docs.select("relative_path", "file_name", "extension")


def search(index: Index, request: SearchRequest, engine: str | None = None) -> DataFrame:
    """Hits of a request. ``engine`` (indexed, direct_scan) overrides the route; both give
    the same rows. A path search returns relative_path only and ignores max_results."""
    request = compiled(index.docs.sparkSession, request)
    if request.kind == "path":
        return candidate_docs(index, request, engine).select("relative_path")
    docs = None
    if engine is None and index.stored and request.max_results is not None and request.limit_mode == "global" and _pays(index, request, engine):
        docs = _leading(index, request, _condition(index, request, engine))
    return limited(verify(candidate_docs(index, request, engine) if docs is None else docs, request), request)


def search_many(index: Index, requests: dict[str, SearchRequest]) -> DataFrame:
    """Hits of many requests in one plan: query (its name), relative_path, line_number, column
    and line_text. The same rows as a search for each, limits included.

    Requests without a limit, with one over all files and with one for each file are a pass each.
    In a pass the trigrams of all requests are read from the postings in one scan, documents
    that any of them may match are read once and split into lines once, and every line meets the
    matchers of those requests that its document is a candidate of. Where one request has no
    seed, or candidates are too many to be sent to each task, the pass reads all documents where
    they are: to join them would shuffle every text. Path searches are not for this.
    """
    asked = {name: compiled(index.docs.sparkSession, r) for name, r in requests.items()}
    if any(r.kind == "path" for r in asked.values()):
        raise InvalidQuery("a batch takes searches of contents")
    spark = index.docs.sparkSession
    shape = "query string, relative_path string, line_number int, column int, line_text string"
    frequency, stored = index.frequency(), index.stored
    conditions = {name: _condition(index, r, "indexed" if plan(r).condition is not None else None) for name, r in asked.items()}
    if frequency is not None:  # requests that cannot match cost nothing
        asked = {name: r for name, r in asked.items() if conditions[name] is None or most(conditions[name], frequency)}
    if not asked:
        return spark.createDataFrame([], shape)
    kind = lambda r: r.limit_mode if r.max_results is not None else None
    out = None
    for mode, by in ((None, []), ("global", ["query"]), ("per_file", ["query", "relative_path"])):
        some = {n: r for n, r in asked.items() if kind(r) == mode}
        if not some:
            continue
        hits = _hits_of(index, some, {n: conditions[n] for n in some}, frequency)
        if mode:
            most_ = {n: r.max_results for n, r in some.items()}
            w = Window.partitionBy(*by).orderBy("relative_path", "line_number")
            cap = F.element_at(F.create_map(*[F.lit(x) for p in most_.items() for x in p]), F.col("query"))
            # the constant bound lets each task drop what is beyond it before the shuffle
            hits = hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(most_.values())).where(F.col("__n") <= cap).drop("__n")
        out = hits if out is None else out.union(hits)
    return out


def _hits_of(index: Index, asked: dict[str, SearchRequest], conditions: dict[str, Condition], frequency) -> DataFrame:
    """Hits of the requests of one pass, before their limits."""
    stored, names = index.stored, list(asked)
    docs = stored.docs() if stored else index.docs
    may = {n: F.lit(True) for n in names}
    bound = None if frequency is None or None in conditions.values() else sum(most(c, frequency) for c in conditions.values())
    if None not in conditions.values() and (bound is None or bound <= SENT):
        found = _met_by(stored.postings() if stored else index.postings, conditions, frequency)
        found = stored.live(found) if stored else found
        docs = docs.join(found if bound is None else F.broadcast(found), [c for c in KEY if c in docs.columns], "inner")
        may = {n: F.array_contains("met", i) for i, n in enumerate(names)}
    elif stored:
        docs = stored.live(docs)
    wanted = F.filter(F.array(*[F.when(may[n] & path_predicate(r), F.lit(i)) for i, (n, r) in enumerate(asked.items())]), lambda x: x.isNotNull())
    split = docs.where("contents is not null").select("relative_path", wanted.alias("wanted"), "contents").where("size(wanted) > 0")
    split = split.select("relative_path", "wanted", F.posexplode(lines(F.col("contents").cast("string"))).alias("n", "line_text"))
    hits = []
    for i, r in enumerate(asked.values()):
        hit, column = _matcher(r)
        hits.append(F.when(F.array_contains("wanted", i) & hit, F.struct(F.lit(i).alias("i"), column.alias("column"))))
    each = split.select("relative_path", (F.col("n") + 1).alias("line_number"), "line_text", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("hit"))
    return each.select(F.element_at(F.array(*map(F.lit, names)), F.col("hit.i") + 1).alias("query"), "relative_path", "line_number", F.col("hit.column").alias("column"), "line_text")


def _met_by(postings: DataFrame, conditions: dict[str, Condition], frequency) -> DataFrame:
    """Keys and ``met``, the numbers of the conditions that a document may meet: one scan."""
    from .index import PROBES, SPREAD, _grams, _met

    key = [c for c in KEY if c in postings.columns]
    grams = {s: _grams(s) for c in conditions.values() for s in literals(c)}
    if frequency is not None:
        grams = {s: sorted(gs, key=lambda g: (frequency.of(g), g))[:PROBES] for s, gs in grams.items()}
        grams = {s: [g for g in gs if frequency.of(g) <= SPREAD * frequency.of(gs[0])] for s, gs in grams.items()}
    rows = postings.where(F.col("trigram").isin(sorted({g for gs in grams.values() for g in gs})))
    names = {s: f"s{i}" for i, s in enumerate(grams)}
    counted = rows.groupBy(*key).agg(*[F.count_if(F.col("trigram").isin(gs)).alias(names[s]) for s, gs in grams.items()])
    flag = {s: F.col(names[s]) >= len(gs) for s, gs in grams.items()}
    met = F.filter(F.array(*[F.when(_met(c, flag), F.lit(i)) for i, c in enumerate(conditions.values())]), lambda x: x.isNotNull())
    return counted.select(*key, met.alias("met")).where("size(met) > 0")


def summary(hits: DataFrame) -> DataFrame:
    """files_with_matches, total_line_matches and matches_returned (the larger one)."""
    per = hits.groupBy("relative_path").agg(F.count("*").alias("n"))
    both = per.agg(F.count("*").alias("files_with_matches"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_line_matches"))
    return both.withColumn("matches_returned", F.greatest("files_with_matches", "total_line_matches"))


def metrics(index: Index, request: SearchRequest, engine: str) -> DataFrame:
    """candidate_docs, verified_docs and bytes_scanned: of matched files with the index, of all
    verified ones in a scan."""
    docs = candidate_docs(index, request.checked(), engine, probe=False)
    hit = verify(docs, request).select("relative_path").distinct().withColumn("hit", F.lit(True))
    joined = docs.select("relative_path", "size").join(hit, "relative_path", "left")
    size = F.when(F.col("hit") | F.lit(engine == "direct_scan"), F.col("size")).otherwise(0)
    return joined.agg(F.count("*").alias("candidate_docs"), F.count("hit").alias("verified_docs"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_scanned"))


def grouped(hits: DataFrame) -> DataFrame:
    """One row a file: relative_path and its lines in order."""
    line = F.struct("line_number", "column", "line_text")
    return hits.groupBy("relative_path").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def token_frequency(docs: DataFrame, least: int = 4, most: int = 64) -> DataFrame:
    """In how many documents each identifier-like token occurs."""
    found = F.array_distinct(F.regexp_extract_all(F.col("contents"), F.lit(r"([A-Za-z_][A-Za-z0-9_]{%d,})" % (least - 1)), 1))
    return docs.select(F.explode(found).alias("token")).where(F.char_length("token") <= most).groupBy("token").agg(F.count("*").alias("docs"))


def pick_token(frequency: DataFrame, low: int, high: int, least: int) -> DataFrame:
    """The token with most documents among those within a band and long enough."""
    return frequency.where(F.col("docs").between(low, high) & (F.char_length("token") >= least)).orderBy(F.desc("docs"), "token").limit(1)
