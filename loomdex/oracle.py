"""DuckDB SQL with the same rows and columns as the registered queries."""

from __future__ import annotations

_DOCS = """docs AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path, 'doc_' || doc_id || '.txt' AS file_name, lang AS extension, strlen(text) AS size, text FROM documents)"""
_LINES = """lines AS (
  SELECT relative_path, file_name, extension, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS line_text FROM (
    SELECT relative_path, file_name, extension, CASE WHEN text = '' THEN [] WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts
    FROM (SELECT *, string_split_regex(text, '\\r?\\n') AS p FROM docs WHERE text IS NOT NULL)))"""
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _hits(test: str, pattern: str, where: str = "true") -> str:
    return f"""WITH {_DOCS}, {_LINES}, hits AS (
      SELECT relative_path, line_number::INTEGER AS line_number, (strlen(regexp_extract(line_text, '(?s)^(.*?)(?:{pattern})', 1)) + 1)::INTEGER AS "column", line_text
      FROM lines WHERE {test} AND {where})"""


def _literal(p: str, where: str = "true") -> str:
    return _hits(f"contains(line_text, '{p}')", p, where)


def _regex(p: str, where: str = "true") -> str:
    return _hits(f"regexp_matches(line_text, '{p}')", p, where)


_ALL = " SELECT * FROM hits"
_EVENTS = """ev AS (
  SELECT user_id AS session_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'pre_compact' WHEN 'signup' THEN 'session_start' ELSE 'select' END AS event,
         'k/' || json_extract_string(props, '$.k') AS path, coalesce(floor(value)::BIGINT, 0) % 2 AS content_hash, floor(value)::BIGINT AS tokens FROM events)"""


def _lives(idle: int) -> str:
    return f"""{_EVENTS}, gaps AS (
      SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER s)) > {idle} OR lag(event) OVER s = 'session_end' THEN 1 ELSE 0 END AS st FROM ev WINDOW s AS (PARTITION BY session_id ORDER BY ts, seq)
    ), lives AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY ts, seq)::BIGINT AS life FROM gaps),
    segs AS (SELECT *, count(*) FILTER (event = 'pre_compact') OVER (PARTITION BY session_id, life ORDER BY ts, seq) AS segment FROM lives),
    touched AS (SELECT * FROM segs WHERE event IN ('read', 'edit') AND path IS NOT NULL),
    marked AS (SELECT *, event = 'read' AND coalesce(lag(event) OVER p = 'read' AND lag(content_hash) OVER p IS NOT DISTINCT FROM content_hash, false) AS redundant, CASE WHEN event = 'read' THEN coalesce(tokens, 0) ELSE 0 END AS observed
      FROM touched WINDOW p AS (PARTITION BY session_id, life, segment, path ORDER BY ts, seq)),
    runs AS (SELECT *, sum(CASE WHEN redundant AND observed > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, life, segment, path ORDER BY ts, seq) AS run FROM marked),
    known AS (SELECT *, max(observed) OVER (PARTITION BY session_id, life, segment, path, run ORDER BY ts, seq) AS known_tokens FROM runs),
    reads AS (SELECT *, CASE WHEN redundant THEN greatest(known_tokens, observed) ELSE 0 END AS tokens_saved FROM known WHERE event = 'read')"""


_TRACKED = f"""{_lives(30 * 86400)}, newest AS (SELECT session_id, max({{'l': life, 's': segment}}) AS at FROM segs GROUP BY 1),
  lastread AS (SELECT r.*, row_number() OVER (PARTITION BY r.session_id, path ORDER BY ts DESC, seq DESC) AS k, count(*) OVER (PARTITION BY r.session_id, path) AS read_count
    FROM reads r JOIN newest n ON n.session_id = r.session_id AND r.life = n.at.l AND r.segment = n.at.s),
  tracked AS (SELECT session_id, path, content_hash, known_tokens AS tokens, read_count FROM lastread WHERE k = 1)"""
_ACCESS = f"""{_EVENTS}, access AS (SELECT path, CASE WHEN event = 'select' THEN 'select' ELSE 'result' END AS kind, floor(epoch(ts))::BIGINT AS ts FROM ev),
  raw AS (SELECT path, sum(CASE WHEN kind = 'select' THEN 3.0 ELSE 1.0 END * pow(2.0, -greatest(1706745600 - ts, 0) / 604800.0)) AS score, max(ts) AS last_access_secs,
    count(*) FILTER (kind = 'result') AS result_count, count(*) FILTER (kind = 'select') AS select_count FROM access GROUP BY path)"""
_BYTES = f"list_transform(regexp_extract_all(hex(encode({_LOW.format('text')})), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)"
_GRAMS = f"""b AS (SELECT doc_id, {_BYTES} AS b FROM documents WHERE text IS NOT NULL), grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(b) - 1), lambda i: b[i::INTEGER] * 65536 + b[(i + 1)::INTEGER] * 256 + b[(i + 2)::INTEGER])) AS trigram FROM b WHERE len(b) > 2)"""
_DF = f"WITH {_GRAMS} SELECT trigram::INTEGER AS trigram, count(*) AS docs FROM grams GROUP BY trigram"


def _grams_of(p: str) -> str:
    b = p.encode()
    return ", ".join(str(b[i] << 16 | b[i + 1] << 8 | b[i + 2]) for i in range(len(b) - 2))


_COUNTS = " UNION ALL ".join(
    f"""SELECT '{p}' AS pattern, (SELECT count(*) FROM (SELECT doc_id FROM grams WHERE trigram IN ({_grams_of(p)}) GROUP BY doc_id HAVING count(*) = {len(set(_grams_of(p).split(', ')))})) AS candidate_docs,
    (SELECT count(*) FROM docs WHERE contains(text, '{p}')) AS verified_docs, (SELECT coalesce(sum(size), 0)::BIGINT FROM docs WHERE contains(text, '{p}')) AS bytes_scanned"""
    for p in ("ement", "heit", "license", "zzzz")
)
_VERSIONS = """d AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path, doc_id % 10 AS k, text FROM documents),
  kinds AS (SELECT relative_path, CASE k WHEN 1 THEN 'added' WHEN 2 THEN 'removed' WHEN 3 THEN 'modified' ELSE 'same' END AS change FROM d)"""


def _now(every: int) -> str:
    """Documents after the changes of ``queries._versions``, and their trigrams."""
    return f"""now AS (SELECT doc_id, CASE doc_id % {every} WHEN 3 THEN text || chr(10) || 'replacement_token' ELSE text END AS text FROM documents WHERE doc_id % {every} <> 2),
      {_GRAMS.replace('FROM documents', 'FROM now')}"""


_EDITED = "SELECT doc_id, CASE doc_id % 40 WHEN 3 THEN text || chr(10) || 'replacement_token' ELSE text END AS text, source, lang FROM documents WHERE doc_id % 40 <> 2"


def _path_counts() -> str:
    out = []
    for p in ("src1/", "doc_12", "/fr/doc_", "c7/FR/D", "nowhere"):
        low = p.lower()
        path = _LOW.format("relative_path")
        grams = " AND ".join(f"contains({path}, '{low[i:i + 3]}')" for i in range(len(low) - 2))
        out.append(f"SELECT '{p}' AS pattern, count(*) FILTER ({grams}) AS candidates, count(*) FILTER (contains({path}, '{low}')) AS matches FROM docs")
    return " UNION ALL ".join(out)


_PATHS = _path_counts()


def _batch() -> str:
    """Each search of ``queries.BATCH``, by itself."""
    parts = [("literal", _literal("ement"), "true"), ("short", _literal("qu", "starts_with(relative_path, 'src1')"), "true"), ("regex", _regex("license|heit|réeaux"), "true")]
    parts += [("capped", _literal("tion"), "n <= 25"), ("per_file", _literal("tion"), "k <= 2"), ("none", _literal("zzqqxx"), "true")]
    rows = "row_number() OVER (ORDER BY relative_path, line_number) AS n, row_number() OVER (PARTITION BY relative_path ORDER BY line_number) AS k"
    return " UNION ALL ".join(f"""SELECT '{name}' AS query, relative_path, line_number, "column", line_text FROM (SELECT *, {rows} FROM ({sql} SELECT * FROM hits)) WHERE {cut}""" for name, sql, cut in parts)


_LOG = """log AS (SELECT conv_id * 1000 + turn AS entry_id, conv_id::VARCHAR AS session_id, turn AS ts, CASE WHEN role = 'user' THEN 'search' ELSE 'read' END AS kind, text AS query, 'f/' || (turn % 3) AS path, md5(text) AS sha FROM conversations)"""
_FILES = f"""{_LOG}, files AS (SELECT session_id, path, arg_min(sha, entry_id) AS sha, arg_min(ts, entry_id) AS last_read_at FROM log WHERE kind = 'read' GROUP BY 1, 2)"""


def _size(units: list[str]) -> str:
    out = "strlen(text) || ' B'"
    for i, u in enumerate(units, 1):
        out = f"CASE WHEN strlen(text) >= {1024**i} THEN printf('%.1f {u}', strlen(text) / {float(1024**i)}) ELSE {out} END"
    return out


_TERMS = ("license", "error", "onion", "heit", "documents")
_STOP = "'the','and','for','with','from','into','this','that','what','where','when','why','how','can','our','your','their','fix','add','make','use','using'"


def _pack() -> str:
    hits, paths, near = [], [], []
    for n, t in enumerate(_TERMS):
        score = 12.0 if t == "error" else 4.0
        hits.append(f"(SELECT {n} AS term, {score} AS s, relative_path AS path, line_number FROM lines WHERE contains({_LOW.format('line_text')}, '{t}') ORDER BY relative_path, line_number LIMIT 20)")
        paths.append(f"(SELECT relative_path AS path FROM docs WHERE contains({_LOW.format('relative_path')}, '{t}') ORDER BY relative_path LIMIT 20)")
        near.append(paths[-1])
    return f"""WITH {_DOCS}, {_LINES}, h AS ({' UNION ALL '.join(hits)}), p AS ({' UNION ALL '.join(paths)}),
    signals AS (SELECT DISTINCT path, term, s, 'content_match' AS reason FROM h UNION ALL SELECT path, 0, 2.0, 'path_match' FROM p UNION ALL SELECT 'src1/en/doc_1.txt', 0, 8.0, 'changed_file'),
    shown AS (SELECT path, least(3, count(*)) AS n FROM (SELECT path, term, row_number() OVER (PARTITION BY path, term ORDER BY line_number) AS k FROM h) WHERE k <= 2 GROUP BY path)
    SELECT s.path, round(sum(s) + 2 + 8, 1)::DOUBLE AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, coalesce(any_value(n), 0)::INTEGER AS n_snippets
    FROM signals s LEFT JOIN shown ON shown.path = s.path GROUP BY s.path"""


def _review() -> str:
    hits, paths = [], []
    for n, t in enumerate(("review", "tests", "license", "src1", "error")):
        score = 12.0 if t == "error" else 4.0
        hits.append(f"(SELECT {n} AS term, {score} AS s, relative_path AS path, line_number FROM lines WHERE contains({_LOW.format('line_text')}, '{t}') ORDER BY relative_path, line_number LIMIT 20)")
        paths.append(f"(SELECT relative_path AS path FROM docs WHERE contains({_LOW.format('relative_path')}, '{t}') ORDER BY relative_path LIMIT 20)")
    docs = _DOCS.replace("SELECT doc_id, source ||", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'tests/' ELSE '' END || source ||")
    return f"""WITH {docs}, {_LINES}, h AS ({' UNION ALL '.join(hits)}), p AS ({' UNION ALL '.join(paths)}),
    signals AS (SELECT DISTINCT path, term, s, 'content_match' AS reason FROM h UNION ALL SELECT path, 0, 2.0, 'path_match' FROM p
      UNION ALL SELECT path, 0, 4.0, 'test_adjacent' FROM p WHERE starts_with(path, 'tests/') UNION ALL SELECT 'src2/en/doc_2.txt', 0, 12.0, 'changed_file'
      UNION ALL SELECT DISTINCT path, 0, 5.0, 'test_adjacent' FROM (FROM (SELECT path FROM h) UNION ALL FROM p) WHERE starts_with(path, 'tests/')),
    shown AS (SELECT path, least(3, count(*)) AS n FROM (SELECT path, term, row_number() OVER (PARTITION BY path, term ORDER BY line_number) AS k FROM h) WHERE k <= 2 GROUP BY path)
    SELECT s.path, round(sum(s), 1)::DOUBLE AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons,
      coalesce(any_value(n), CASE WHEN bool_or(reason = 'path_match') AND starts_with(s.path, 'tests/') THEN 1 ELSE 0 END)::INTEGER AS n_snippets
    FROM signals s LEFT JOIN shown ON shown.path = s.path GROUP BY s.path"""


SQL: dict[str, str] = {
    "literal_search": _literal("ement") + _ALL,
    "literal_search_ci": _hits(f"contains({_LOW.format('line_text')}, 'the')", "(?i:the)") + _ALL,
    "literal_short_scan": _literal("qu") + _ALL,
    # a word boundary here knows all letters, in DuckDB only ASCII ones
    "regex_anchor": _hits(r"regexp_matches(line_text, '(?:^|[^\p{L}\p{M}\p{N}_])heit')", "x").replace("^(.*?)(?:x)", r"^(.*?(?:^|[^\p{L}\p{M}\p{N}_]))heit") + _ALL,
    "regex_alternation": _regex("license|heit|réeaux") + _ALL,
    "regex_ci": _regex("(?i:licens(ed|e)\\b)") + _ALL,
    "regex_weak_scan": _regex("[0-9]+[.]") + _ALL,
    "path_search": f"WITH {_DOCS} SELECT relative_path FROM docs WHERE contains({_LOW.format('relative_path')}, 'src1/')",
    "path_filters_combo": _literal("the", "extension IN ('en', 'de') AND (starts_with(relative_path, 'src1') OR starts_with(relative_path, 'src2'))") + _ALL,
    "path_exact": _literal("a", "relative_path IN ('src1/en/doc_1.txt', 'src6/en/doc_6.txt') AND file_name IN ('doc_1.txt', 'doc_6.txt')") + _ALL,
    "glob_filter": f"WITH {_DOCS} SELECT relative_path FROM docs WHERE regexp_full_match(relative_path, '(?s)src1.*/(?:.*/)?doc_.1\\.txt|src(?:2|3)/fr/.*')",
    "path_plus_content": _literal("tion", f"contains({_LOW.format('relative_path')}, 'src7/fr')") + _ALL,
    "max_results_global": _literal("tion") + " SELECT * FROM hits ORDER BY relative_path, line_number LIMIT 25",
    "max_results_per_file": _literal("tion") + " SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY line_number) <= 2",
    "scan_repo_stats": "SELECT count(*) AS tracked_files, count(text) AS searchable_files, sum(strlen(text))::BIGINT AS searchable_bytes, 0::BIGINT AS skipped_binary_files FROM documents",
    "language_histogram": "SELECT coalesce(lang, '<none>') AS language, count(*) AS files FROM documents GROUP BY 1",
    "repo_category": "SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS size, CASE WHEN count(*) > 500000 OR sum(strlen(text)) > 21474836480 THEN 'very_large' WHEN count(*) >= 50000 OR sum(strlen(text)) >= 2147483648 THEN 'large' WHEN count(*) >= 5000 OR sum(strlen(text)) >= 209715200 THEN 'medium' ELSE 'small' END AS category FROM documents GROUP BY source",
    "hidden_paths": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '.github/workflows/ci.yml' WHEN 1 THEN '.gitignore' WHEN 2 THEN '.venv/secret.txt' WHEN 3 THEN 'src/.hidden/a.rs' WHEN 4 THEN '.env.example' ELSE 'src/' || source || '.rs' END AS path, doc_id % 6 NOT IN (2, 3) AS searchable FROM documents",
    "trigram_df": _DF,
    "trigram_postings_topn": _DF + " ORDER BY docs DESC, trigram LIMIT 50",
    "total_postings": f"WITH {_GRAMS} SELECT count(*) AS total_postings FROM grams",
    "candidate_counts": f"WITH {_GRAMS}, {_DOCS} {_COUNTS}",
    "search_summary": _literal("tion") + " SELECT count(DISTINCT relative_path) AS files_with_matches, count(*) AS total_line_matches, greatest(count(DISTINCT relative_path), count(*)) AS matches_returned FROM hits",
    "grouped_hits": _hits(f"contains({_LOW.format('line_text')}, 'license')", "(?i:license)") + " SELECT relative_path, count(*)::INTEGER AS n_lines, min(line_number) AS first_line FROM hits GROUP BY 1",
    "session_rollup": f"WITH {_DOCS}, {_LINES}, m AS (" + " UNION ALL ".join(f"SELECT '{'indexed' if len(p) > 2 else 'direct_scan'}' AS engine, count(*) AS matches FROM lines WHERE contains(line_text, '{p}')" for p in ("ement", "qu", "heit", "license")) + ") SELECT engine, count(*) AS queries, sum(matches)::BIGINT AS total_matches FROM m GROUP BY engine",
    "index_change_classify": f"WITH {_VERSIONS} SELECT * FROM kinds",
    "index_change_ratio": f"WITH {_VERSIONS}, n AS (SELECT sum(CASE change WHEN 'modified' THEN 2 WHEN 'same' THEN 0 ELSE 1 END)::BIGINT AS changed, count(*) FILTER (change <> 'added') AS base_docs FROM kinds) SELECT changed, base_docs, changed / base_docs AS ratio, changed / base_docs >= 0.25 AS rebuild FROM n",
    "index_overlay_search": f"WITH {_VERSIONS} SELECT relative_path, len(string_split_regex(text, '\\r?\\n'))::INTEGER + 1 AS line_number, 1::INTEGER AS \"column\", 'replacement_token' AS line_text FROM d WHERE k = 3",
    "overlay_document_frequency": f"WITH {_now(40)} SELECT trigram::INTEGER AS trigram, count(*) AS docs FROM grams GROUP BY trigram",
    "index_segments": f"WITH {_now(40)} SELECT trigram::INTEGER AS trigram, count(*) AS docs FROM grams GROUP BY trigram",
    "index_compaction": f"WITH {_now(40)} SELECT trigram::INTEGER AS trigram, count(*) AS docs FROM grams GROUP BY trigram",
    "index_segments_search": _literal("replacement_token").replace("FROM documents)", f"FROM ({_EDITED}))") + _ALL + " UNION ALL SELECT * FROM (" + _literal("license").replace("FROM documents)", f"FROM ({_EDITED}))") + _ALL + ")",
    "path_candidates": f"WITH {_DOCS} {_PATHS}",
    "session_batch": _batch(),
    "session_batch_rollup": f"WITH batch AS ({_batch()}) SELECT q AS query, count(b.query) AS matches, count(DISTINCT b.relative_path) AS files, 2.0::DOUBLE AS amortised FROM unnest(['literal', 'short', 'regex', 'capped', 'per_file', 'none']) u(q) LEFT JOIN batch b ON b.query = q GROUP BY q",
    "tool_search_reuse": f"""WITH {_DOCS}, k AS (SELECT relative_path, doc_id % 40 AS k FROM docs WHERE contains(text, 'license')),
      p AS (SELECT relative_path, k FROM k WHERE contains({_LOW.format('relative_path')}, 'src1/')), o AS (SELECT relative_path, k FROM k WHERE contains({_LOW.format('relative_path')}, 'src2/')),
      n AS (SELECT count(*) FILTER (k <> 1) AS before, count(*) FILTER (k <> 2) AS after FROM p)
      SELECT step, reused, (CASE step WHEN 'another path' THEN least(100, (SELECT count(*) FROM o WHERE k <> 1)) WHEN 'another limit' THEN least(1, n.before) WHEN 'the limit again' THEN least(1, n.before)
        WHEN 'this path changed' THEN n.after WHEN 'settled' THEN n.after WHEN 'compacted' THEN n.after ELSE n.before END)::INTEGER AS files
      FROM n, (VALUES ('first', false), ('again', true), ('another path', false), ('another limit', false), ('the limit again', true), ('forced', false), ('another path changed', true), ('this path changed', false), ('settled', true), ('compacted', false)) v(step, reused)""",
    "index_apply_changes": f"WITH {_now(40)} SELECT (SELECT sum(CASE doc_id % 40 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END)::BIGINT FROM documents) AS changed, false AS rebuild, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes FROM now",
    "index_rebuild": f"WITH {_now(10)} SELECT true AS rebuild, (SELECT count(*) FROM now) AS docs, (SELECT sum(strlen(text))::BIGINT FROM now) AS bytes, count(*) AS postings, count(DISTINCT trigram) AS trigrams FROM grams",
    "context_pack_review": _review(),
    "change_log_latest": "SELECT json_extract_string(props, '$.k') AS relative_path, CASE WHEN event_type <> 'error' THEN user_id END AS doc_id FROM events QUALIFY row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY event_id DESC) = 1",
    "frecency_scores": f"WITH {_ACCESS} SELECT path, round(score, 6) AS score, last_access_secs, result_count, select_count FROM raw",
    "frecency_top": f"WITH {_ACCESS} SELECT path, round(score, 6) AS score FROM raw ORDER BY raw.score DESC, path LIMIT 20",
    "frecency_rerank": f"WITH {_ACCESS}, hits AS (SELECT path, row_number() OVER (ORDER BY path)::INTEGER AS ordinal FROM (SELECT DISTINCT path FROM access UNION ALL SELECT 'k/none')) SELECT path, ordinal, row_number() OVER (ORDER BY coalesce(score, 0) DESC, ordinal)::INTEGER AS new_rank FROM hits LEFT JOIN raw USING (path)",
    "frecency_restore": f"WITH {_ACCESS}, saved AS (SELECT CASE WHEN select_count % 2 = 0 THEN path ELSE path || '-old' END AS path, 5.0::DOUBLE AS b FROM raw) SELECT path, round(greatest(coalesce(score, 0), coalesce(b, 0)), 6) AS score, CASE WHEN b IS NOT NULL THEN 1706745600 ELSE last_access_secs END AS last_access_secs, coalesce(result_count, 0) AS result_count, coalesce(select_count, 0) AS select_count FROM raw FULL JOIN saved USING (path)",
    "query_ring_buffer": "SELECT floor(epoch(ts))::BIGINT AS timestamp_secs, event_id AS seq, user_id FROM events ORDER BY floor(epoch(ts)) DESC, event_id DESC LIMIT 500",
    "memo_redundant_reads": f"WITH {_lives(43200)} SELECT session_id, seq, path, life, segment, redundant, known_tokens, tokens_saved FROM reads",
    "memo_session_totals": f"WITH {_lives(43200)}, r AS (SELECT session_id, life, count(*) AS a, count(*) FILTER (redundant) AS b, sum(tokens_saved)::BIGINT AS c FROM reads GROUP BY 1, 2), c AS (SELECT session_id, life, count(*) FILTER (event = 'pre_compact') AS compaction_count FROM segs GROUP BY 1, 2) SELECT session_id, life, coalesce(a, 0) AS total_reads, coalesce(b, 0) AS redundant_reads_prevented, coalesce(c.compaction_count, 0) AS compaction_count, coalesce(r.c, 0) AS tokens_saved FROM c LEFT JOIN r USING (session_id, life)",
    "memo_idle_sessions": f"WITH {_EVENTS} SELECT session_id, max(floor(epoch(ts)))::BIGINT AS last_activity, epoch(TIMESTAMP '2024-01-30 20:00:00') - floor(epoch(max(ts))) > 600 AS idle FROM ev GROUP BY 1",
    "memo_check_recommendation": f"WITH {_TRACKED}, disk AS (SELECT path, arg_max(content_hash, seq) AS h, arg_max(tokens, seq) AS t FROM ev GROUP BY path), j AS (SELECT k.*, d.t, d.h IS NULL OR d.h <> k.content_hash AS stale FROM tracked k LEFT JOIN disk d USING (path)) SELECT session_id, path, CASE WHEN stale THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN NOT stale THEN 'skip_reread' WHEN t IS NOT NULL AND tokens > 0 AND abs(t - tokens) / tokens < 0.10 THEN 'reread_with_diff' ELSE 'reread' END AS recommendation, tokens AS tokens_at_last_read, CASE WHEN stale THEN t END AS current_tokens FROM j",
    "memo_broadcast": f"WITH {_TRACKED} SELECT session_id, path, 'edit' AS event FROM tracked WHERE path IN (SELECT path FROM ev WHERE event = 'edit')",
    "memo_stream": f"WITH {_lives(43200)}, n AS (SELECT session_id, max(life) AS life FROM lives GROUP BY 1), r AS (SELECT session_id, life, count(*) AS a, count(*) FILTER (redundant) AS b, sum(tokens_saved)::BIGINT AS c FROM reads GROUP BY 1, 2), k AS (SELECT session_id, life, count(*) FILTER (event = 'pre_compact') AS m FROM segs GROUP BY 1, 2) SELECT n.session_id, n.life, coalesce(a, 0) AS total_reads, coalesce(b, 0) AS redundant_reads_prevented, coalesce(r.c, 0) AS tokens_saved, coalesce(m, 0) AS compaction_count FROM n LEFT JOIN r USING (session_id, life) LEFT JOIN k USING (session_id, life)",
    "search_epochs": f"WITH {_EVENTS}, e AS (SELECT session_id, count(*) FILTER (event IN ('session_start', 'pre_compact')) OVER (ORDER BY ts, seq) AS epoch FROM ev) SELECT session_id, max(epoch) AS epoch FROM e GROUP BY 1",
    "reuse_check": f"WITH {_EVENTS}, edits AS (SELECT row_number() OVER (ORDER BY ts, seq) AS generation, path FROM ev WHERE event = 'edit'), journal AS (SELECT * FROM edits ORDER BY generation DESC LIMIT 256), g AS (SELECT max(generation) AS g FROM edits), q AS (SELECT seq AS request_id, g.g - seq % 90 + CASE WHEN seq % 17 = 0 THEN 200 ELSE 0 END AS rec, (seq % 11 = 0)::INT AS ep, path, left(path, 4) AS scope, g.g AS cur FROM ev, g WHERE event = 'read'), hit AS (SELECT request_id, min({{'g': j.generation, 'w': CASE WHEN j.path = q.path THEN 'changed_matched_path' ELSE 'changed_search_scope' END, 'p': j.path}}) AS c FROM q JOIN journal j ON j.generation > q.rec AND (j.path = q.path OR starts_with(j.path, q.scope)) GROUP BY 1), o AS (SELECT q.request_id, CASE WHEN ep <> 0 THEN 'context_invalidated' WHEN cur < rec THEN 'generation_reset' WHEN cur = rec THEN 'unchanged' WHEN (SELECT min(generation) FROM journal) > rec + 1 THEN 'journal_overflow' WHEN c IS NOT NULL THEN c.w ELSE 'unchanged' END AS reason, c.p AS p FROM q LEFT JOIN hit USING (request_id)) SELECT request_id, reason = 'unchanged' AS fresh, reason, CASE WHEN starts_with(reason, 'changed') THEN p END AS changed_path FROM o",
    "context_terms": f"WITH w AS (SELECT item_id, list_filter(string_split_regex({_LOW.format('text')}, '[^a-z0-9_]+'), lambda x: len(x) >= 3 AND x NOT IN ({_STOP})) AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM w), f AS (SELECT item_id, term, min(p) AS p FROM u GROUP BY 1, 2) SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY p) - 1)::INTEGER AS n, term FROM f",
    "context_pack_rank": _pack(),
    "working_set": f"WITH {_FILES} SELECT * FROM files",
    "searches_run": f"WITH {_LOG} SELECT session_id, 'action-' || entry_id AS search_id, query, 'search' AS search_kind FROM log WHERE kind = 'search'",
    "snapshot_diff": f"WITH {_FILES}, a AS (SELECT path, max(sha) AS x FROM files WHERE session_id::BIGINT % 2 = 0 GROUP BY 1), b AS (SELECT path, max(sha) AS y FROM files WHERE session_id::BIGINT % 2 = 1 GROUP BY 1) SELECT path, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE x IS DISTINCT FROM y",
    "snapshot_diff_searches": f"WITH {_LOG}, a AS (SELECT DISTINCT query AS search_id FROM log WHERE kind = 'search' AND session_id::BIGINT % 2 = 0), b AS (SELECT DISTINCT query AS search_id FROM log WHERE kind = 'search' AND session_id::BIGINT % 2 = 1) SELECT search_id, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT search_id, 'removed' FROM (FROM a EXCEPT FROM b)",
    "sessions_newest_open": "SELECT conv_id::VARCHAR AS session_id, 'open' AS status, max(turn) AS updated_at FROM conversations GROUP BY conv_id HAVING count(*) % 2 = 0 ORDER BY updated_at DESC, session_id LIMIT 1",
    "pinned_snippets": "WITH d AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, 2::INTEGER AS line_start, (doc_id % 3 + 2)::INTEGER AS line_end, string_split_regex(text, '\\r?\\n') AS p FROM documents), l AS (SELECT path, line_start, line_end, coalesce(array_to_string((CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END)[line_start:line_end], chr(10)), '') AS content FROM d) SELECT *, sha256(content) AS sha FROM l",
    "binary_sniff": "WITH b AS (SELECT doc_id, doc_id % 4 AS k, least(4096, strlen(text) + 1) AS n, list_transform(regexp_extract_all(left(hex(encode(text)) || 'FF', 8192), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1) AS b FROM documents), c AS (SELECT *, len(list_filter(b, lambda x: (x >= 32 AND x <= 126) OR x IN (9, 10, 13))) AS t, len(list_filter(b, lambda x: x <= 8 OR x IN (11, 12) OR (x >= 14 AND x <= 31))) AS c FROM b) SELECT doc_id, CASE k WHEN 2 THEN true WHEN 1 THEN c * 200 >= n OR (c > 0 AND t / n < 0.95) OR t / n < 0.85 ELSE false END AS is_binary, k <> 1 AS valid FROM c",
    "pack_checksums": f"WITH {_DOCS} SELECT relative_path AS path, sha256(text) AS sha256, sha256('x') AS found FROM docs WHERE doc_id % 5 = 0 AND text <> 'x'",
    "session_brief": f"WITH {_LOG}, f AS (SELECT session_id, entry_id, CASE kind WHEN 'search' THEN '- Ran search `' || query || '`' ELSE '- Recorded ' || kind END || ' [action_log:' || entry_id || ']' AS t FROM log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY entry_id) <= 12), m AS (SELECT session_id, '## Goal' || chr(10) || 'Continue' || chr(10, 10) || '## Current hypothesis' || chr(10) || '(none)' || chr(10, 10) || '## Established facts' || chr(10) || string_agg(t, chr(10) ORDER BY entry_id) || chr(10, 10) || '## Ruled out' || chr(10) || '(none identified)' || chr(10, 10) || '## Open questions' || chr(10) || '- What should be verified first?' || chr(10, 10) || '## Next planned action' || chr(10) || 'Check one captured fact before editing.' || chr(10) AS markdown FROM f GROUP BY 1) SELECT session_id, markdown, strlen(markdown)::INTEGER AS bytes FROM m".replace("chr(10, 10)", "chr(10) || chr(10)"),
    "bench_percentiles": "WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem) SELECT l_returnflag, l_linestatus, round(max(v) FILTER (r = floor(0.5 * (n - 1) + 0.5)), 6) AS p50, round(max(v) FILTER (r = floor(0.95 * (n - 1) + 0.5)), 6) AS p95, round(max(v) FILTER (r = floor(0.99 * (n - 1) + 0.5)), 6) AS p99, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM r GROUP BY 1, 2",
    "bench_result_diff": f"WITH {_DOCS}, {_LINES}, a AS (SELECT DISTINCT relative_path, line_number::INTEGER AS line_number FROM lines WHERE contains(line_text, 'license')), b AS (SELECT DISTINCT relative_path, line_number::INTEGER AS line_number FROM lines WHERE contains({_LOW.format('line_text')}, 'licensed')) SELECT *, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a)",
    "ir_metrics": "WITH j AS (SELECT source AS scenario, doc_id::VARCHAR AS path, doc_id, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 AND doc_id % 2 = 0 THEN 'required' WHEN quality = 1 THEN 'helpful' END AS label FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY doc_id) AS rank FROM j), w AS (SELECT scenario, count(*) AS wanted FROM j WHERE label IN ('required', 'helpful') GROUP BY 1) SELECT scenario, bool_or(rank = 1 AND coalesce(label = 'required', false)) AS hit_at_1, bool_or(rank <= 4 AND coalesce(label = 'required', false)) AS hit_at_4, round(coalesce(1.0::DOUBLE / min(rank) FILTER (label = 'required'), 0), 6) AS mrr, round(count(*) FILTER (label IN ('required', 'helpful')) / greatest(coalesce(any_value(wanted), 0), 1), 6) AS coverage, round(count(*) FILTER (label IN ('required', 'helpful')) / count(*), 6) AS precision, bool_or(rank = 1 AND coalesce(label = 'bad', false)) AS misleading_top1 FROM r LEFT JOIN w USING (scenario) GROUP BY scenario",
    "reusable_searches": f"WITH {_EVENTS}, s AS (SELECT session_id, seq AS turn, path AS key, lag(seq) OVER (PARTITION BY session_id, path ORDER BY seq) AS previous_turn FROM ev WHERE event = 'read') SELECT session_id, turn, key, previous_turn, NOT EXISTS (SELECT 1 FROM ev e WHERE e.event = 'edit' AND e.session_id = s.session_id AND e.path = s.key AND e.seq > s.previous_turn AND e.seq < s.turn) AS reusable FROM s WHERE previous_turn IS NOT NULL",
    "token_estimates": "SELECT doc_id, ceil(strlen(text) / 3.5)::BIGINT AS read_tokens, greatest(1, ceil(length(text) / 4.0))::BIGINT AS pack_tokens, ceil(strlen(text) / 4.0)::BIGINT AS hydration_tokens FROM documents",
    "preview_trim": f"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[\\r\\n]+$', '')) <= 40 THEN regexp_replace(text, '[\\r\\n]+$', '') ELSE left(regexp_replace(text, '[\\r\\n]+$', ''), 39) || '…' END AS preview, CASE WHEN length(text) <= 21 THEN text ELSE left(text, 10) || '…' || right(text, 10) END AS middle, regexp_replace(regexp_replace({_LOW.format('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, {_size(['KB', 'MB', 'GB'])} AS size, {_size(['KiB', 'MiB', 'GiB', 'TiB'])} AS isize, format('{{:,}}', strlen(text)) AS bytes, CASE WHEN n_chars >= 1000 THEN ((n_chars + 5) // 10) // 100 || '.' || lpad((((n_chars + 5) // 10) % 100)::VARCHAR, 2, '0') || ' s' ELSE n_chars || ' ms' END AS duration FROM documents",
    "path_heuristics": "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, contains(path, '/test') OR contains(path, 'tests/') OR contains(path, '_test.') OR contains(path, '.test.') OR contains(path, '_spec.') OR contains(path, '.spec.') AS is_test, contains(path, 'config') OR ends_with(path, '.toml') OR ends_with(path, '.yaml') OR ends_with(path, '.yml') AS is_config, contains(path, 'fixture') OR contains(path, 'testdata') AS is_fixture, trim(path) AS path FROM p",
    "token_frequency": "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}')) AS token FROM documents) SELECT token, count(*) AS docs FROM t WHERE length(token) <= 64 GROUP BY 1",
    "pick_tokens": "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}')) AS token FROM documents), f AS (SELECT token, count(*) AS docs FROM t WHERE length(token) <= 64 GROUP BY 1) SELECT * FROM (SELECT 'selective' AS band, token, docs FROM f WHERE docs BETWEEN 1 AND 3 AND length(token) >= 6 ORDER BY docs DESC, token LIMIT 1) UNION ALL SELECT * FROM (SELECT 'moderate', token, docs FROM f WHERE docs BETWEEN 5 AND 50 ORDER BY docs DESC, token LIMIT 1) UNION ALL SELECT * FROM (SELECT 'high', token, docs FROM f WHERE docs >= 100 ORDER BY docs DESC, token LIMIT 1)",
    "hook_events": "SELECT event_id, user_id::VARCHAR AS session_id, CASE WHEN event_type IN ('view', 'signup', 'error') THEN 'read' WHEN event_type = 'purchase' THEN 'edit' END AS kind, coalesce(json_extract_string(props, '$.k'), CASE WHEN event_type = 'error' THEN 'src/' || user_id || ' x.rs' END) AS path, CASE WHEN event_type = 'error' THEN 'src/' || user_id || ' x.rs' END AS shell_path, floor(value)::BIGINT AS tokens FROM events",
    "change_coalesce": "WITH e AS (SELECT json_extract_string(props, '$.k') AS path, event_type = 'error' AS d, ts FROM events), s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS st FROM e), g AS (SELECT *, sum(st) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT path, floor(epoch(min(ts)))::BIGINT AS start, bool_or(d) AS deleted, count(*) AS events FROM g GROUP BY path, g",
    "search_memo": f"WITH {_EVENTS}, p AS (SELECT session_id, path AS key, min(seq) AS first_use, max(seq) AS last_use FROM ev WHERE event = 'read' AND path IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_use, key) AS i, row_number() OVER (PARTITION BY session_id ORDER BY last_use DESC, key) AS r FROM p) SELECT session_id, printf('search-%06d', i) AS search_id, key, last_use FROM n WHERE r <= 256",
    "change_renames": f"WITH {_EVENTS}, r AS (SELECT path, CASE event WHEN 'edit' THEN 'deleted' WHEN 'pre_compact' THEN 'deleted' ELSE 'changed' END AS kind FROM ev UNION ALL SELECT path || '.new', 'created' FROM ev WHERE event = 'edit') SELECT path, kind, count(*) AS events FROM r GROUP BY 1, 2",
    "replay_totals": f"WITH {_lives(43200)}, t AS (SELECT sum(CASE WHEN redundant THEN known_tokens ELSE 0 END)::BIGINT AS eligible, sum(tokens_saved)::BIGINT AS saved, count(*) FILTER (redundant AND tokens_saved = 0) AS false_negatives FROM reads) SELECT *, round(CASE WHEN eligible > 0 THEN saved / eligible ELSE 0 END, 6)::DOUBLE AS saved_ratio FROM t",
    "verdict_counts": "SELECT l_returnflag, CASE WHEN l_tax >= 0.08 THEN 'hurts' WHEN l_linestatus = 'O' AND (l_discount * 2 > 0.15 OR l_linenumber - 3 >= 1) THEN 'helps' WHEN l_linestatus <> 'O' AND l_quantity > 25 THEN 'hurts' ELSE 'neutral' END AS verdict, count(*) AS runs FROM lineitem GROUP BY 1, 2",
    "session_upsert": "WITH c AS (SELECT conv_id::VARCHAR AS session_id, count(*) AS n, max(turn) AS u FROM conversations GROUP BY conv_id) SELECT session_id, CASE WHEN n % 2 = 1 AND u > 3 THEN 'new goal' ELSE 'goal ' || n END AS goal, 'open' AS status, 0::INTEGER AS created_at, CASE WHEN n % 2 = 1 THEN 1706745600 ELSE u END AS updated_at FROM c UNION ALL SELECT 'fresh', 'first goal', 'open', 1706745600, 1706745600",
    "session_resume": f"WITH {_FILES} SELECT session_id, path, CASE WHEN path IN (SELECT path FROM files WHERE last_read_at > 1) THEN 'primed' ELSE 'stale' END AS state FROM files",
}
# Files of traces call by call: what each holds after a call is found by recursion.
_REPLAY = """c AS (SELECT conv_id AS run_id, turn AS t, coalesce(text, '') AS text FROM conversations WHERE turn IS NOT NULL),
  ev AS (SELECT run_id, t * 3 + 1 AS turn, 'read' AS kind, t % 2 AS file, text AS data FROM c WHERE text <> ''
    UNION ALL SELECT run_id, t * 3 + 2, CASE t % 3 WHEN 0 THEN 'edit' WHEN 1 THEN 'read' ELSE 'write' END, t % 2, text FROM c WHERE t % 3 <> 1 OR text <> ''
    UNION ALL SELECT run_id, t * 3 + 3, 'read', (t + 1) % 2, text FROM c WHERE text <> ''),
  o AS (SELECT *, row_number() OVER (PARTITION BY run_id, file ORDER BY turn) AS n FROM ev),
  d AS (SELECT *, CASE WHEN kind <> 'edit' THEN data END AS disk FROM o WHERE n = 1
    UNION ALL SELECT o.*, CASE WHEN o.kind = 'read' THEN coalesce(d.disk, o.data) WHEN o.kind = 'write' THEN o.data
      WHEN contains(d.disk, 'ion') THEN left(d.disk, instr(d.disk, 'ion') - 1) || 'ION' || substr(d.disk, instr(d.disk, 'ion') + 3) ELSE d.disk END
    FROM d JOIN o ON o.run_id = d.run_id AND o.file = d.file AND o.n = d.n + 1),
  s AS (SELECT run_id, turn, CASE kind WHEN 'read' THEN kind ELSE 'edit' END AS kind, 'f' || file AS path, ceil(strlen(data) / 3.5)::BIGINT AS tokens, disk, turn > 10 AS segment FROM d),
  w AS (SELECT *, last_value(CASE WHEN disk IS NOT NULL THEN kind END IGNORE NULLS) OVER p AS last_kind, last_value(disk IGNORE NULLS) OVER p AS last_disk,
      last_value(CASE WHEN kind = 'read' THEN disk END IGNORE NULLS) OVER p AS read_disk, lag(kind) OVER q AS k, lag(disk) OVER q AS x
    FROM s WINDOW q AS (PARTITION BY run_id, path, segment ORDER BY turn), p AS (PARTITION BY run_id, path, segment ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r AS (SELECT run_id, turn, path, tokens, CASE WHEN read_disk IS NULL THEN 'unknown' WHEN read_disk = disk THEN 'fresh' ELSE 'stale' END AS memo_status, last_kind IS NOT NULL AS seen,
      coalesce(last_kind = 'read', false) AS eligible, coalesce(read_disk = disk AND disk <> last_disk, false) AS wrong, coalesce(k = 'read' AND x = disk, false) AS redundant FROM w WHERE kind = 'read')"""
SQL |= {
    "trace_replay_reads": f"WITH RECURSIVE {_REPLAY} SELECT *, CASE WHEN redundant THEN tokens ELSE 0 END AS tokens_saved FROM r",
    "trace_replay": f"WITH RECURSIVE {_REPLAY} SELECT run_id, count(*) AS total_reads, count(*) FILTER (redundant) AS redundant_reads_prevented, coalesce(sum(tokens) FILTER (redundant), 0)::BIGINT AS tokens_saved, count(*) FILTER (wrong) AS false_negatives, 0::BIGINT AS post_compact_false_negatives, sum(tokens)::BIGINT AS actual_navigation_tokens, coalesce(sum(tokens) FILTER (NOT (seen AND memo_status = 'fresh')), 0)::BIGINT AS memo_navigation_tokens, coalesce(sum(tokens) FILTER (eligible), 0)::BIGINT AS memo_eligible_redundant_tokens FROM r GROUP BY run_id",
    "validation_groups": "WITH v AS (SELECT *, CASE WHEN l_tax >= 0.08 THEN 'hurts' WHEN l_linestatus = 'O' AND (l_discount * 2 > 0.15 OR l_linenumber - 3 >= 1) THEN 'helps' WHEN l_linestatus <> 'O' AND l_quantity > 25 THEN 'hurts' ELSE 'neutral' END AS verdict FROM lineitem) SELECT l_returnflag, grouping(l_returnflag) = 1 AS total, count(*) AS total_runs, count(*) FILTER (verdict = 'helps') AS helps, count(*) FILTER (verdict = 'neutral') AS neutral, count(*) FILTER (verdict = 'hurts') AS hurts, round(avg((l_linenumber = 1)::DOUBLE), 6) AS hit_at_1_rate, round(avg((l_linestatus = 'O')::DOUBLE), 6) AS hit_at_4_rate, round(avg((l_discount * 2)::DOUBLE), 6) AS avg_token_reduction_ratio, round(avg((l_linenumber - 3)::DOUBLE), 6) AS avg_tool_call_reduction FROM v GROUP BY ROLLUP (l_returnflag)",
    "bundle_roundtrip": f"WITH {_FILES} SELECT 'snapshot-1' AS snapshot, session_id, 'action' AS what, entry_id::VARCHAR AS name, sha256(CASE WHEN kind = 'search' THEN query ELSE sha END) AS digest FROM log UNION ALL SELECT 'snapshot-1', session_id, 'file', path, sha256(sha) FROM files",
}
SQL = {k: v for k, v in SQL.items() if v}
