"""SQL twins (DuckDB) of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION
  SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.other = both_ways.x),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN sizes USING (doc_id)
"""

EXACT_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

SUBSTRING_DEDUP = rf"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?])[ \t]', '\1' || chr(10), 'g'), chr(10)) AS u FROM docs),
place AS (SELECT doc_id, t, unnest(u) AS unit, generate_subscripts(u, 1) AS i FROM cut),
placed AS (
  SELECT doc_id, t, unit, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM place),
worded AS (
  SELECT doc_id, t, begins + length(unit) AS stop,
    begins + length(unit) - length(regexp_replace(unit, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '')) AS start,
    regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM placed),
units AS (SELECT doc_id, t, start, stop, array_to_string(w, ' ') AS d FROM worded WHERE len(w) >= 6),
ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY doc_id, start) AS n FROM units),
per_doc AS (
  SELECT doc_id, t, count(*) AS n_units, count(*) FILTER (n > 1) AS n_removed,
    coalesce(sum(stop - start) FILTER (n > 1), 0)::BIGINT AS removed_chars,
    coalesce(string_agg(start || '-' || stop, ',' ORDER BY start) FILTER (n > 1), '') AS spans
  FROM ranked GROUP BY doc_id, t)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(removed_chars, 0)::BIGINT AS removed_chars, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_doc USING (doc_id, t)
"""


def license_scan_sql() -> str:
    from rankloom.llm.license_scan import LicenseScan, template_grams, template_words

    how = LicenseScan()
    rows = ", ".join(f"({k}, '{label}', {base}, {n}, {t}, '{gram}')" for k, label, base, n, t, gram in template_grams(how))
    known = ", ".join(
        f"('{label}', {n}, {marks}, {'NULL' if t is None else t}, '{word}', {told})" for label, n, marks, t, word, told in template_words()
    )
    return rf"""
WITH templates(k, label, base, n, t, gram) AS (VALUES {rows}),
notice_words(label, n, n_marks, t, word, told) AS (VALUES {known}),
words AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
grams AS (
  SELECT doc_id, x, k, unnest(range(0, len(w) - k + 1)) AS p,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram
  FROM words, (SELECT DISTINCT k FROM templates) WHERE len(w) >= k),
votes AS (
  SELECT DISTINCT doc_id, x, label, base, n, p - t AS diagonal, t FROM grams JOIN templates USING (k, gram)),
diagonals AS (SELECT DISTINCT doc_id, x, label, base, diagonal FROM votes),
stepped AS (
  SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER w > {how.drift}, true) THEN 1 ELSE 0 END AS new
  FROM diagonals WINDOW w AS (PARTITION BY doc_id, x, label, base ORDER BY diagonal)),
banded AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, x, label, base ORDER BY diagonal) AS band FROM stepped),
spans AS (
  SELECT doc_id, x, label, base, band, min(diagonal) AS low, max(diagonal) AS high, count(DISTINCT t) AS covered, max(n) AS n
  FROM votes JOIN banded USING (doc_id, x, label, base, diagonal) GROUP BY ALL),
near AS (
  SELECT s.doc_id, s.x, s.label, band, low, high, unnest(range(greatest(low - 40, 0), least(high + 80, len(w)))) AS p,
    w[greatest(low - 40, 0) + 1:least(high + 80, len(w))] AS v, greatest(low - 40, 0) AS v0
  FROM spans s JOIN words USING (doc_id, x) WHERE NOT base AND covered >= {how.least_votes}),
held AS (
  SELECT doc_id, x, label, band, low, max(k.n) + max(high - low) AS n, max(n_marks) AS n_marks, count(DISTINCT t) AS found,
    count(DISTINCT t) FILTER (told) AS marks, count(*) FILTER (t IS NULL) AS rivals
  FROM near JOIN notice_words k USING (label)
  WHERE v[p - v0 + 1] = word AND CASE WHEN t IS NULL THEN p BETWEEN low AND high + k.n - 1
    ELSE p - t BETWEEN low - {how.drift} AND high + {how.drift} END
  GROUP BY ALL),
good AS (
  SELECT doc_id, x, label, base, low AS start, 1.0::DOUBLE AS cover FROM spans WHERE base AND covered = n
  UNION ALL SELECT doc_id, x, label, false, low, found / n FROM held
  WHERE marks = n_marks AND rivals = 0 AND found / n >= {how.least_words}),
per_doc AS (
  SELECT doc_id, x, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(cover) AS score
  FROM good GROUP BY doc_id, x)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN per_doc USING (doc_id, x)
"""


#: Of the byte-wise CRC-32: ``tab`` is its table, ``crc('x')`` the checksum of the decimal form of x.
_CRC_TABLE = """
bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)"""


def _crc(number: str) -> str:
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _fold_sql(name: str, depth: int) -> str:
    """``{name}0`` (tree, pos, n, d) folded by 8, level by level, and the siblings of every node."""
    out = []
    for k in range(depth):
        run = "PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"""
{name}{k + 1} AS MATERIALIZED (
  SELECT tree, pos // 8 AS pos, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d
  FROM {name}{k} GROUP BY tree, pos // 8),
{name}_side{k} AS MATERIALIZED (
  SELECT tree, pos, n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k})""")
    return ",".join(out)


def _climb_sql(name: str, tree: str, depth: int) -> str:
    """``{name}0`` (row, tree, pos, d, proof) led up to the root of its tree."""
    return ",".join(f"""
{name}{k + 1} AS (
  SELECT row, f.tree, f.pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(l || d || r) ELSE d END AS d, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof
  FROM {name}{k} f JOIN {tree}_side{k} s ON f.tree = s.tree AND f.pos = s.pos)""" for k in range(depth))


def manifest_sql(depth: int = 8) -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS MATERIALIZED (
  SELECT doc_id, lang, {digest('text')} AS leaf, CASE WHEN {_crc('doc_id')} % 3 = 0 THEN {digest(lowered)} END AS changed
  FROM documents, crc_table),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
t0 AS MATERIALIZED (SELECT tree, pos, n, leaf AS d FROM placed),{_fold_sql('t', depth)},
u0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, d FROM t{depth}),{_fold_sql('u', depth)},
f0 AS (SELECT row, tree, pos, coalesce(changed, leaf) AS d, '' AS proof FROM placed),{_climb_sql('f', 't', depth)},
g0 AS (SELECT row, 0 AS tree, tree AS pos, d, proof FROM f{depth}),{_climb_sql('g', 'u', depth)}
SELECT doc_id, leaf, t{depth}.d AS subroot, u{depth}.d AS root, sha256(proof) AS proof_sha256, g{depth}.d AS folded_root,
  g{depth}.d = u{depth}.d AS verified
FROM placed JOIN g{depth} USING (row) JOIN t{depth} ON placed.tree = t{depth}.tree CROSS JOIN u{depth}
"""


PREFIX_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
turns AS (
  SELECT c, r, t, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, t) AS p
  FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, {_crc('c')} % 6 AS h FROM (SELECT DISTINCT c FROM turns), crc_table),
rebuilt AS (
  SELECT v.c, 0 AS part, p, r, t FROM convs v JOIN turns b ON b.c = v.c - v.c % 100 AND p <= h
  UNION ALL SELECT c, 1, p, r, t FROM convs JOIN turns USING (c) WHERE p > h),
steps AS (
  SELECT c, length(t) AS chars, sha256(length(r) || ':' || r || t) AS step, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d,
    count(*) OVER (PARTITION BY c) AS n_turns
  FROM rebuilt),
members AS (
  SELECT c, d, string_agg(step, '') OVER (PARTITION BY c ORDER BY d) AS path, chars, d = n_turns AS is_end FROM steps
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM rebuilt) FROM convs),
nodes AS (
  SELECT d, path, min(c) AS c, count(*) AS n, max(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '') AS ends
  FROM members GROUP BY d, path),
children AS (SELECT d - 1 AS d, left(path, 64 * (d - 1)) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, path)),
below AS (
  SELECT m.d, m.path, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n - 1) * y.chars)::BIGINT AS saved
  FROM counted y JOIN members m ON m.c = y.c AND m.d <= y.d GROUP BY m.d, m.path)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, up.c AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved AS saved_tokens,
  sha256(x.ends) AS ends_sha256
FROM counted x JOIN below USING (d, path) LEFT JOIN nodes up ON up.d = x.d - 1 AND up.path = left(x.path, 64 * (x.d - 1))
"""
