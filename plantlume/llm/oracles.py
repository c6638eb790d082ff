"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH doc AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
item AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT item_id, least(13, len(w)) AS n, w[i : i + least(13, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)
),
hit AS (SELECT p.doc_id, p.i, p.n, b.item_id FROM pos p JOIN win b ON p.n = b.n AND p.g = b.g),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
keyed AS (SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS key FROM sized),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
),
ordered AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight,
    coalesce(sum(2 * source_size) OVER prior, 0)::DOUBLE AS full_before, coalesce(sum(weight) OVER prior, 0) AS weight_before
  FROM per WINDOW prior AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levelled AS (SELECT *, (budget - full_before) / (all_weight - weight_before) AS lev FROM ordered),
final AS (SELECT max(lev) FILTER (WHERE 2 * source_size > lev * weight) AS lev FROM levelled),
targets AS (
  SELECT source, source_size, CASE WHEN 2 * source_size <= l.lev * weight THEN (2 * source_size)::DOUBLE ELSE f.lev * weight END AS target
  FROM levelled l, final f
),
queued AS (
  SELECT k.doc_id, k.source, k.key, k.size, t.source_size, t.target,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS UNBOUNDED PRECEDING) AS run
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
),
entries AS (
  SELECT q.*, turn, (run + turn * source_size)::DOUBLE / target AS due
  FROM queued q, (VALUES (0), (1)) v(turn) WHERE size > 0 AND target > 0
),
mixed AS (
  SELECT *, sum(size) OVER (ORDER BY due, source NULLS LAST, key, doc_id NULLS LAST, turn ROWS UNBOUNDED PRECEDING) AS total FROM entries
),
bounded AS (SELECT m.*, bool_or(total > 1.5 * (SELECT sum(size) FROM sized)) OVER (
  ORDER BY due, source NULLS LAST, key, doc_id NULLS LAST, turn ROWS UNBOUNDED PRECEDING) AS beyond FROM mixed m),
taken AS (SELECT doc_id, source, key, sum(size) AS taken FROM bounded WHERE NOT beyond GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.source IS NOT DISTINCT FROM t.source
"""

# Pairs come from all shingles here, not from a prefix; groups of repeated texts are joined by their least id first.
OP6 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_distinct([w[i : i + 4] FOR i IN range(1, len(w) - 3)]) END AS s
  FROM doc
),
sizes AS (SELECT doc_id, list_sort(s) AS s, len(s)::BIGINT AS n FROM shingled),
same AS (SELECT s, n, min(doc_id) AS rep FROM sizes WHERE n > 0 GROUP BY s, n),
term AS (SELECT rep, n, unnest(s) AS g FROM same),
pair AS (
  SELECT x.rep AS a, y.rep AS b FROM term x JOIN term y ON x.g = y.g AND x.rep < y.rep
  WHERE 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach AS (SELECT rep AS a, rep AS b FROM same UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
label AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM sizes d LEFT JOIN same USING (s, n) LEFT JOIN label l ON l.a = same.rep
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents
),
best AS (SELECT c, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY c)
SELECT d.doc_id, keep_id, group_size, d.doc_id = keep_id AS kept, sha256(c) AS text_sha256 FROM d JOIN best USING (c)
"""

OP12 = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS family,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, byte: list_reduce(
        list_prepend(xor(acc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, unused: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h
  FROM ids
),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
rebuilt AS (
  SELECT h.conv_id, o.pos, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.family AND o.pos <= h.h
  UNION ALL
  SELECT h.conv_id, o.pos, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h
),
lists AS (
  SELECT i.conv_id, coalesce(l.turns, []) AS turns FROM ids i
  LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM rebuilt GROUP BY conv_id) l USING (conv_id)
),
prefixes AS (
  SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS path, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM lists)
),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[-1]['text'], '[^\x20\x09-\x0D]+')) END AS words
  FROM prefixes GROUP BY path, depth
),
kids AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
below AS (
  SELECT list_slice(path, 1, d) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT path, n_children, n_convs, words, unnest(range(depth + 1)) AS d FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1) AND p.depth = n.depth - 1
"""

OP13 = r"""
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""

ORACLES = {
    "op2_benchmark_decontamination": OP2, "op3_mixing": OP3, "op6_ngram_jaccard": OP6, "op8_exact_dedup": OP8,
    "op12_prefix_trie": OP12, "op13_hard_negatives": OP13,
}
