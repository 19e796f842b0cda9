"""DuckDB SQL for the operators that SQL can express.

Operators 4 and 8 fit models, operator 3 walks trees and operator 12 merges by rank; their
tests use held-out labels, brute force and another encoder instead.
"""

_MIX = r"""
WITH RECURSIVE ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents
), counts AS (
  SELECT source, count(*) AS n, (count(*) + 3) // 4 AS blocks FROM documents GROUP BY source
), weighted AS (
  SELECT source, n, blocks, 1 + floor(1000 * pow(n, 0.5) / sum(pow(n, 0.5)) OVER ())::BIGINT AS e,
         row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM counts
), lists AS (
  SELECT list(e ORDER BY i) AS e, list(blocks ORDER BY i) AS blocks, list(source ORDER BY i) AS names, sum(blocks)::BIGINT AS total FROM weighted
), walk AS (
  SELECT 0::BIGINT AS slot, 0::BIGINT AS t, 0 AS phase, blocks AS rest, list_transform(blocks, lambda x: 0::BIGINT) AS had,
         list_transform(blocks, lambda x: 0::BIGINT) AS used, 0::BIGINT AS pick, e, names, total, list_transform(blocks, lambda x: x > 0) AS active FROM lists
  UNION ALL
  SELECT slot + 1,
         CASE WHEN list_extract(rest, p) = 1 THEN 0 ELSE t + 1 END,
         CASE WHEN list_extract(rest, p) = 1 THEN phase + 1 ELSE phase END,
         list_transform(rest, lambda x, i: CASE WHEN i = p THEN x - 1 ELSE x END),
         CASE WHEN list_extract(rest, p) = 1 THEN list_transform(had, lambda x: 0::BIGINT)
              ELSE list_transform(had, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END) END,
         list_transform(used, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END),
         p, e, names, total,
         CASE WHEN list_extract(rest, p) = 1 THEN list_transform(active, lambda x, i: x AND i <> p) ELSE active END
  FROM (
    SELECT *, list_extract(list_sort(list_filter(list_transform(e, lambda x, i:
        CASE WHEN active[i] AND (had[i] * w) // x <= t THEN (((had[i] + 1) * w + x - 1) // x) * 100000 + i END), lambda v: v IS NOT NULL)), 1) % 100000 AS p
    FROM (SELECT *, list_sum(list_transform(e, lambda x, i: CASE WHEN active[i] THEN x ELSE 0 END))::BIGINT AS w FROM walk WHERE slot < total)
  )
), placed AS (
  SELECT slot - 1 AS mix_slot, names[pick] AS source, used[pick] - 1 AS mix_block,
         CASE WHEN lag(phase, 1, 0) OVER (ORDER BY slot) < phase THEN phase - 1 ELSE phase END AS mix_phase FROM walk WHERE slot > 0
)
SELECT r.doc_id, r.source, p.mix_block, p.mix_phase::INTEGER AS mix_phase, p.mix_slot,
       row_number() OVER (ORDER BY p.mix_slot, r.r) - 1 AS mix_position
FROM ranked r JOIN placed p ON r.source IS NOT DISTINCT FROM p.source AND r.r // 4 = p.mix_block
"""

_CHAT = r"""
WITH said AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
plain AS (
  SELECT conv_id, turn AS pos, 0 AS depth, turn, role, to_json({'content': text, 'role': role})::VARCHAR AS json, 0 AS calls, 0 AS invalid, 0 AS linked, 0 AS orphans FROM conversations
), called AS (
  SELECT conv_id, turn AS pos, 0 AS depth, turn, 'assistant' AS role,
         '{"content":null,"role":"assistant","tool_calls":[{"arguments":{' || CASE WHEN conv_id % 5 = 0 AND turn > 2 THEN '"after":{"$ref":"call-' || (turn - 2) || '"},' ELSE '' END
         || '"chars":' || length(text) || ',"query":' || to_json(text)::VARCHAR || '},"id":"call-' || turn || '","name":"' || CASE WHEN turn % 4 = 1 THEN 'lookup' ELSE 'measure' END || '"}]}' AS json,
         1 AS calls, CASE WHEN conv_id % 3 = 2 THEN 0 WHEN turn % 4 <> 1 OR length(text) > 300 THEN 1 ELSE 0 END AS invalid, 0 AS linked, 0 AS orphans FROM said
), answered AS (
  SELECT conv_id, turn AS pos, 1 AS depth, turn - (conv_id % 7 = 0)::BIGINT AS turn, 'tool' AS role,
         '{"content":"' || md5(text) || '","role":"tool","tool_call_id":"call-' || turn || '"}' AS json, 0 AS calls, 0 AS invalid, 1 AS linked, 0 AS orphans FROM said
), stray AS (
  SELECT conv_id, turn AS pos, 0 AS depth, turn, 'tool' AS role, '{"content":null,"role":"tool","tool_call_id":"lost-' || turn || '"}' AS json, 0, 0, 0, 1
  FROM conversations WHERE role = 'user' AND turn % 4 = 2
), declared AS (
  SELECT DISTINCT conv_id, -1::BIGINT AS pos, 0 AS depth, -1::BIGINT AS turn, 'system' AS role,
         '{"content":null,"role":"system","tools":[{"name":"lookup","parameters":{"properties":{"chars":{"maximum":300,"type":"integer"}},"required":["query"],"type":"object"}}]}' AS json, 0, 0, 0, 0
  FROM conversations WHERE conv_id % 3 <> 2
), m AS (FROM plain UNION ALL FROM called UNION ALL FROM answered UNION ALL FROM stray UNION ALL FROM declared)
SELECT conv_id, 0::INTEGER AS part, count(*) AS n_messages, sum(calls)::BIGINT AS n_calls, sum(invalid)::BIGINT AS n_invalid, sum(linked)::BIGINT AS n_linked, sum(orphans)::BIGINT AS n_orphans, 0::BIGINT AS n_cyclic,
       '{"conv_id":' || conv_id || ',"messages":[' || string_agg(json, ',' ORDER BY pos, depth, turn, role, sha256(json)) || '],"part":0}' AS json
FROM m GROUP BY conv_id
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ')"
_WORDS = f"regexp_extract_all({_LOWER}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"

_LEAKS = rf"""
WITH masks(mask) AS (VALUES ('111010011'), ('1101100011'), ('11001010011'), ('110100010101'), ('1010011000111')),
offsets AS (SELECT mask, len(mask) AS span, list_filter(range(len(mask)), lambda i: mask[(i + 1)::INTEGER] = '1') AS at FROM masks),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM b),
-- a window must agree on its first word, so only places of such words are looked at
ds AS (SELECT d.doc_id, o.mask, p.p, list_transform(o.at, lambda i: d.w[(p.p + i + 1)::INTEGER]) AS key FROM d, offsets o, (SELECT DISTINCT doc_id, p FROM dw) p WHERE p.doc_id = d.doc_id AND p.p + o.span <= len(d.w)),
bs AS (SELECT b.item_id, o.mask, p.p, list_transform(o.at, lambda i: b.w[(p.p + i + 1)::INTEGER]) AS key FROM b, offsets o, (SELECT DISTINCT item_id, p FROM bw) p WHERE p.item_id = b.item_id AND p.p + o.span <= len(b.w)),
diag AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.p - bs.p AS g FROM ds JOIN bs ON ds.mask = bs.mask AND ds.key = bs.key),
cells AS (
  SELECT g.doc_id, g.item_id, g.g, bw.n AS item_words, bw.p, CASE WHEN bw.word = dw.word THEN 1 ELSE -3 END AS s
  FROM diag g JOIN bw ON bw.item_id = g.item_id JOIN dw ON dw.doc_id = g.doc_id AND dw.p = g.g + bw.p
),
sums AS (SELECT *, sum(s) OVER l AS t, sum(s) OVER l - s AS t0, (sum((s > 0)::INT) OVER l) AS m, (sum((s > 0)::INT) OVER l) - (s > 0)::INT AS m0 FROM cells WINDOW l AS (PARTITION BY doc_id, item_id, g ORDER BY p)),
-- the best start for an end is the last place with the lowest sum before it
lows AS (SELECT *, min_by({{'t0': t0, 'p': p, 'm0': m0}}, (t0, -p)) OVER (PARTITION BY doc_id, item_id, g ORDER BY p) AS a FROM sums),
ends AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY t - a.t0 DESC, p) AS k FROM lows),
best AS (SELECT doc_id, item_id, item_words, (m - a.m0)::BIGINT AS matches, p - a.p + 1 AS length, g + a.p AS doc_word, a.p AS item_word, g FROM ends WHERE k = 1),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matches DESC, g) AS k FROM best WHERE matches >= least(12, ceil(0.7 * item_words)))
SELECT doc_id, item_id, item_words::BIGINT AS item_words, matches, length::BIGINT AS length, doc_word::BIGINT AS doc_word, item_word::BIGINT AS item_word FROM one WHERE k = 1
"""

_LINKS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL
), u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v WHERE list_sum(list_transform(e, lambda y: y * y)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, min(r.y) AS component_id, e.vec_id = min(r.y) AS kept
FROM embeddings e JOIN reach r ON r.x = e.vec_id GROUP BY e.vec_id
"""

_SHARDS = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(sha256(text), '') AS g, coalesce(strlen(text), 0) + 1 AS size, text FROM documents
), groups AS (
  SELECT g, min(doc_id) AS first, sum(size)::BIGINT AS bytes FROM docs GROUP BY g
), placed AS (
  SELECT *, (sum(bytes) OVER (ORDER BY first, g) - bytes)::BIGINT AS start FROM groups
), sizes AS (
  SELECT list({'k': 0::BIGINT, 'c': bytes} ORDER BY start) AS s, greatest(max(bytes), (sum(bytes)::BIGINT + 15) // 16)::BIGINT AS lo, max(bytes)::BIGINT AS m FROM placed
), search AS (
  SELECT lo - 1 AS lo, lo + m AS hi, s FROM sizes
  UNION ALL
  SELECT CASE WHEN n <= 16 THEN lo ELSE mid END, CASE WHEN n <= 16 THEN mid ELSE hi END, s FROM (
    SELECT lo, hi, mid, s, list_reduce(s, lambda a, x: CASE WHEN a.c + x.c <= mid THEN {'k': a.k, 'c': a.c + x.c} ELSE {'k': a.k + 1, 'c': x.c} END).k + 1 AS n
    FROM (SELECT *, (lo + hi) // 2 AS mid FROM search WHERE hi - lo > 1)
  )
), capacity AS (
  SELECT min(hi) AS c FROM search
), cuts AS (
  SELECT 0 AS shard, 0::BIGINT AS at
  UNION ALL
  SELECT shard + 1, (SELECT max(p.start + p.bytes) FROM placed p WHERE p.start + p.bytes <= cuts.at + (SELECT c FROM capacity)) FROM cuts
  WHERE shard < 15 AND cuts.at < (SELECT sum(bytes) FROM groups)
), table_(i, v) AS (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM range(256) r(i)
), steps AS (
  SELECT list(v ORDER BY i) AS v FROM table_
), hex AS (
  SELECT doc_id, g, steps.v AS v, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)) AS bytes
  FROM docs, steps WHERE text IS NOT NULL
), crc AS (
  SELECT doc_id, g, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, v[xor(a & 255, x) + 1])), 4294967295) AS text_crc32 FROM hex
), assigned AS (
  SELECT d.doc_id, d.g, d.size, (SELECT max(shard) FROM cuts WHERE cuts.at <= p.start) AS shard FROM docs d JOIN placed p USING (g)
)
SELECT a.doc_id, a.size::BIGINT AS size, c.text_crc32, 'bytes' AS law, a.shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY a.doc_id, a.g) - 1 AS slot, NULL::INTEGER AS grown_shard, (SELECT c FROM capacity) AS capacity
FROM assigned a LEFT JOIN crc c ON a.doc_id = c.doc_id AND a.g = c.g
"""


def _licences() -> str:
    """Every window on the grid of every text, without bands or anchors."""
    from .licences import TEMPLATES, scale_of, shingle_list, words_of

    rows = []
    for name, text in TEMPLATES.items():
        w = words_of(text)
        s = shingle_list(w)
        rows += [f"('{name}', {scale_of(len(w))}, {len(s)}, '{x}')" for x in s]
    return rf"""
    WITH t(licence, scale, m, shingle) AS (VALUES {', '.join(rows)}),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    s AS (SELECT doc_id, len(w) AS n, unnest(range(len(w) - 2)) AS p, unnest(list_transform(range(len(w) - 2), lambda i: array_to_string(w[(i + 1)::INTEGER:(i + 3)::INTEGER], ' '))) AS shingle FROM d WHERE len(w) > 2),
    h AS (SELECT DISTINCT s.doc_id, s.n, s.p, t.licence, t.scale, t.m, s.shingle FROM s JOIN t USING (shingle)),
    w AS (SELECT doc_id, licence, scale, m, shingle, (p // (scale // 4) - q) * (scale // 4) AS start, p FROM h, range(4) r(q)),
    c AS (SELECT doc_id, licence, scale, m, start, count(DISTINCT shingle) AS hits FROM w WHERE start >= 0 AND p + 3 <= start + scale GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, licence ORDER BY hits DESC, start) AS k FROM c WHERE hits >= ceil(0.8 * m - 1e-9))
    SELECT doc_id, licence, hits::INTEGER AS shingles_found, m::INTEGER AS shingles, hits / m AS containment, start::INTEGER AS window_start, scale::INTEGER AS window_words FROM k WHERE k = 1
    """


_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[(i + 1)::INTEGER:(i + 5)::INTEGER], ' ')) END) AS x FROM w
), n AS (
  SELECT d.doc_id, count(s.x) AS n FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), half AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), links AS (
  SELECT a AS x, b AS y FROM half UNION ALL SELECT b, a FROM half
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = n.doc_id) AS component_id FROM n
"""

_CRC_TABLE = r"""
table_(i, v) AS (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM range(256) r(i)
), steps AS (
  SELECT list(v ORDER BY i) AS v FROM table_
)"""

_TRIE = rf"""
WITH {_CRC_TABLE}, digits AS (
  SELECT conv_id, v, list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)) AS bytes
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), steps
), h AS (
  SELECT conv_id, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, v[xor(a & 255, x) + 1])), 4294967295) % 9 AS h FROM digits
), said AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(from_hex(sha256(coalesce(role, ''))) || from_hex(sha256(coalesce(text, ''))))) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), r AS (
  SELECT s.conv_id, list_concat(coalesce(b.w, [])[1:h.h], s.w[h.h + 1:]) AS w FROM said s JOIN h USING (conv_id) LEFT JOIN said b ON b.conv_id = s.conv_id - s.conv_id % 5
), p AS (
  SELECT conv_id, unnest(range(len(w) + 1)) AS depth, w FROM r
), node AS (
  SELECT depth, w[1:depth] AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(w) = depth), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(strlen(w[1:depth][-1][2]), 0) AS saved
  FROM p GROUP BY depth, w[1:depth]
), kids AS (
  SELECT a.depth, a.w, count(b.w) AS n_children FROM node a LEFT JOIN node b ON b.depth = a.depth + 1 AND b.w[1:a.depth] = a.w GROUP BY a.depth, a.w
), below AS (
  SELECT a.depth, a.w, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM (SELECT n.*, unnest(range(n.depth + 1)) AS up FROM node n) b JOIN node a ON a.depth = b.up AND a.w = b.w[1:b.up] JOIN kids k ON k.depth = b.depth AND k.w = b.w GROUP BY a.depth, a.w
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, k.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM node n JOIN kids k ON k.depth = n.depth AND k.w = n.w JOIN below b ON b.depth = n.depth AND b.w = n.w LEFT JOIN node u ON u.depth = n.depth - 1 AND u.w = n.w[1:n.depth - 1]
"""

_AUDIT = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT t.doc_id, part, concat(
      CASE WHEN len(w) < 50 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id
), o(filter_order) AS (
  SELECT '' UNION ALL SELECT o.filter_order || c FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(c) WHERE NOT contains(o.filter_order, c)
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS c, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step) WHERE len(filter_order) = 5
), d AS (
  SELECT part, filter_order, step, c, contains(fails, c) AS hit, length(translate(fails, before, '')) < length(fails) AS gone, fails, good, toxic FROM f, s
), n AS (
  SELECT part, filter_order, step, c, count(*) FILTER (NOT hit AND NOT gone) AS kept, count(*) FILTER (hit AND NOT gone) AS removed, count(*) FILTER (hit AND gone) AS redundant,
         count(*) FILTER (fails = c) AS unique_fails, count(*) FILTER (hit AND NOT gone AND good) AS good_lost, count(*) FILTER (hit AND NOT gone AND toxic) AS toxic_lost
  FROM d GROUP BY part, filter_order, step, c
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM n
"""

SQL: dict[str, str] = {
    "op1_pfair_mixing": _MIX,
    "op2_chat_tool_links": _CHAT,
    "op5_spaced_seed_decontamination": _LEAKS,
    "op6_itq_near_duplicates": _LINKS,
    "op7_minimax_shards": _SHARDS,
    "op9_licence_windows": _licences(),
    "op10_signature_tree_jaccard": _JACCARD,
    "op11_conversation_prefix_trie": _TRIE,
    "op13_filter_interactions": _AUDIT,
}
