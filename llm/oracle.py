"""SQL of the contract queries that SQL can express, for checking in another engine.

Not here: trained scores (op1, op6), an external vocabulary's pieces (op2) and merges (op12), approximate search (op4), the
hash-ordered schedule (op8) and spans added by a trained classifier (op10); tests hold these against brute force.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, k, w[k : k + 19] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS k FROM w WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS nth FROM starts),
gone AS (SELECT DISTINCT doc_id, k + o AS p FROM (SELECT doc_id, k, unnest(generate_series(0, 19)) AS o FROM ranked WHERE nth > 1)),
per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
flat AS (SELECT w.doc_id, unnest(generate_series(1, len(w.w))) AS p, unnest(w.w) AS x FROM w),
kept AS (SELECT f.doc_id, string_agg(x, ' ' ORDER BY f.p) AS t FROM flat f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.p = f.p WHERE g.p IS NULL GROUP BY f.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(per.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w[k : k + 4] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS k FROM w WHERE len(w) >= 5) UNION ALL SELECT doc_id, w FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, row_number() OVER () AS id FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT doc_id, id FROM s JOIN df USING (g)),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM t a JOIN t b ON a.id = b.id AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(a, b) AS (SELECT u, u FROM edges UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.b)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id)"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, g, len(g) AS n FROM (SELECT item, w[k : k + 9] AS g FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, n, k, w[k : k + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, starts.n, item FROM starts JOIN win ON starts.n = win.n AND starts.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, k + unnest(generate_series(0, n - 1)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_SPECIAL = r"len(regexp_extract_all({}, '[\\<\[\]]'))"

OP9 = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(10 + length(role) + length(text) + {_SPECIAL.format('role')} + {_SPECIAL.format('text')}) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM r GROUP BY conv_id"""

#: CRC-32 of a string, by bytes, and its table of 256, by the polynomial's rule.
_CRC = r"""crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, generate_series(1, 8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 255)) AS i)))"""


def _crc(value: str) -> str:
    """SQL of the CRC-32 of a string; crc_table must be in scope."""
    bytes_ = rf"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = "lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), {step}), 4294967295)"


def _leaf(text: str) -> str:
    """SQL of a row's leaf."""
    part = lambda c: (
        f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    )
    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_RUN_CRC = _crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")
_ID_CRC = _crc("CAST(doc_id AS VARCHAR)")
_LEAF, _LOW_LEAF = _leaf("text"), _leaf(_LOWER.replace("coalesce(text, '')", "text"))


OP11 = rf"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS
  r FROM documents) WHERE length(r) >= 6 GROUP BY doc_id, r),
summed AS (SELECT r, n, {_RUN_CRC} AS h FROM runs, crc_table),
words AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substring(r, 1, h % length(r))
  || substring(r, h % length(r) + 2) ELSE r END AS w, n FROM summed) WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >=
  5),
dels AS (SELECT w, n, i, substring(w, 1, i) || substring(w, i + 2) AS s FROM (SELECT w, n, unnest(generate_series(0,
  length(w) - 1)) AS i FROM words)),
near AS (
  SELECT a.w, b.w AS v, b.n AS m FROM dels a JOIN dels b ON a.s = b.s AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM dels a JOIN words b ON a.s = b.w UNION SELECT b.w, a.w, a.n FROM dels a JOIN words b
    ON a.s = b.w),
best AS (SELECT w, count(*) AS k, min(struct_pack(less := -m, v := v)) AS b FROM near GROUP BY w),
form AS (SELECT w, n, coalesce(k, 0) AS k, CASE WHEN -b.less >= 5 * n THEN b.v END AS form, CASE WHEN -b.less >= 5 * n
  THEN -b.less END AS form_n FROM words LEFT JOIN best USING (w)),
up(w, root, d) AS (SELECT w, w, 0 FROM form UNION ALL SELECT u.w, f.form, d + 1 FROM up u JOIN form f ON f.w = u.root
  WHERE f.form IS NOT NULL),
roots AS (SELECT w, arg_max(root, d) AS root FROM up GROUP BY w)
SELECT w AS word, form, root, n, CAST(k AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM form JOIN roots
  USING (w)"""


OP13 = rf"""
WITH RECURSIVE {_CRC},
made AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF} AS leaf, {_LOW_LEAF} AS low, {_ID_CRC} % 3 = 0 AS
  hit FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, CASE WHEN hit
  THEN low ELSE leaf END AS given FROM made),
nodes(tree, lvl, k, d) AS (SELECT tree, 0, k, leaf FROM leaves UNION ALL SELECT tree, lvl + 1, k // 8,
  sha256(string_agg(d, '' ORDER BY k)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM nodes) WHERE
  size > 1 GROUP BY tree, lvl, k // 8),
subs AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS k FROM (SELECT tree, arg_max(d, lvl) AS d FROM nodes
  GROUP BY tree)),
tops(lvl, k, d) AS (SELECT 0, k, d FROM subs UNION ALL SELECT lvl + 1, k // 8, sha256(string_agg(d, '' ORDER BY k))
  FROM (SELECT *, count(*) OVER () AS size FROM tops) WHERE size > 1 GROUP BY lvl, k // 8),
height AS (SELECT n.tree, max(lvl) AS h, any_value(s.k) AS nth FROM nodes n JOIN subs s USING (tree) GROUP BY n.tree),
every AS (SELECT n.tree AS t, n.lvl, n.k, n.d, h, nth FROM nodes n JOIN height USING (tree) WHERE n.lvl < h UNION ALL
  SELECT '/', lvl, k, d, NULL, NULL FROM tops WHERE lvl < (SELECT max(lvl) FROM tops)),
hop AS (SELECT DISTINCT t, lvl, k // 8 AS g, CASE WHEN lvl + 1 = h THEN '/' ELSE t END AS nt, CASE WHEN lvl + 1 = h
  THEN 0 ELSE lvl + 1 END AS nl, CASE WHEN lvl + 1 = h THEN nth ELSE k // 8 END AS nk FROM every),
steps(tree, place, t, lvl, k, cur, path, n) AS (
  SELECT tree, k, CASE h WHEN 0 THEN '/' ELSE tree END, 0, CASE h WHEN 0 THEN nth ELSE k END, given, '', 0 FROM leaves
    JOIN height USING (tree)
  UNION ALL
  SELECT s.tree, s.place, p.nt, p.nl, p.nk, sha256(string_agg(CASE WHEN e.k = s.k THEN s.cur ELSE e.d END, '' ORDER BY
    e.k)), s.path || coalesce(string_agg(e.d, '' ORDER BY e.k) FILTER (e.k <> s.k), ''), s.n + 1
  FROM steps s JOIN every e ON e.t = s.t AND e.lvl = s.lvl AND e.k // 8 = s.k // 8 JOIN hop p ON p.t = s.t AND p.lvl =
    s.lvl AND p.g = s.k // 8
  GROUP BY s.tree, s.place, p.nt, p.nl, p.nk, s.cur, s.path, s.n),
done AS (SELECT tree, place, arg_max(cur, n) AS cur, arg_max(path, n) AS path FROM steps GROUP BY tree, place)
SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, sha256(g.path) AS proof_sha256, g.cur AS folded_root, g.cur =
  r.d AS verified
FROM leaves l JOIN done g ON g.tree = l.tree AND g.place = l.k JOIN subs s ON s.tree = l.tree, (SELECT arg_max(d, lvl)
  AS d FROM tops) r"""

ORACLE_SQL = {
    "op3_substring_dedup": OP3, "op5_ngram_join": OP5, "op7_decontamination": OP7, "op9_chat_format": OP9,
    "op11_spelling_variants": OP11, "op13_merkle_manifest": OP13,
}
