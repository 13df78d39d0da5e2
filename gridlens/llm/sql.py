"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT d.part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce((d.doc_id > min(d.doc_id) OVER (PARTITION BY t))::INT, 0) AS mask,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.a || q.a || r.a || s.a || u.a AS filter_order FROM x p, x q, x r, x s, x u
  WHERE p.a <> q.a AND p.a <> r.a AND p.a <> s.a AND p.a <> u.a AND q.a <> r.a AND q.a <> s.a AND q.a <> u.a
    AND r.a <> s.a AND r.a <> u.a AND s.a <> u.a),
s AS (
  SELECT filter_order, step, filter_order[step] AS letter, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS state
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
e AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (mask & (state | bit) = 0) AS kept, sum(n) FILTER (mask & state = 0 AND mask & bit <> 0) AS removed,
         sum(n) FILTER (mask & state <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & state = 0 AND mask & bit <> 0) AS good_lost,
         sum(toxic) FILTER (mask & state = 0 AND mask & bit <> 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM e
"""

DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""

#: Of a tree with nodes (k, pos, node, n): its levels, then the runs of three.
_TREE = """
{t}(k, lvl, pos, node, n) AS (
  SELECT k, 0, pos, node, n FROM {base}
  UNION ALL
  SELECT k, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM {t} WHERE n > 1 GROUP BY k, lvl, pos // 3),
{t}_run AS (SELECT k, lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM {t} WHERE n > 1 GROUP BY k, lvl, pos // 3),
{t}_root AS (SELECT k, node AS root FROM {t} WHERE n = 1)"""

_WALK = """
{w}(row, k, lvl, pos, node, proof) AS (
  SELECT row, k, 0, pos, node, proof FROM {base}
  UNION ALL
  SELECT row, {w}.k, {w}.lvl + 1, pos // 3,
         sha256(array_to_string(list_concat(nodes[:pos % 3], [{w}.node], nodes[pos % 3 + 2:]), '')),
         proof || array_to_string(list_concat(nodes[:pos % 3], nodes[pos % 3 + 2:]), '')
  FROM {w} JOIN {t}_run r ON r.k = {w}.k AND r.lvl = {w}.lvl AND r.run = {w}.pos // 3),
{w}_end AS (SELECT row, arg_max(node, lvl) AS node, arg_max(proof, lvl) AS proof FROM {w} GROUP BY row)"""

MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND ({_CRC}) % 2 = 1 THEN {_leaf("replace(text, chr(10), '')")} END AS other
  FROM documents),
b AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY k) AS n FROM d),
base AS (SELECT row, k, pos, leaf AS node, n FROM b),
{_TREE.format(t="t", base="base")},
tops AS (SELECT '' AS k, k AS name, root AS node, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t_root),
{_TREE.format(t="u", base="tops")},
start AS (SELECT row, k, pos, coalesce(other, leaf) AS node, '' AS proof FROM b),
{_WALK.format(w="w", t="t", base="start")},
upper AS (SELECT w_end.row, '' AS k, tops.pos, w_end.node, w_end.proof FROM w_end JOIN b ON b.row = w_end.row JOIN tops ON tops.name = b.k),
{_WALK.format(w="v", t="u", base="upper")}
SELECT doc_id, leaf, t_root.root AS subroot, u_root.root AS root, sha256(v_end.proof) AS proof_sha256,
       v_end.node AS folded_root, v_end.node = u_root.root AS verified
FROM b JOIN v_end ON v_end.row = b.row JOIN t_root ON t_root.k = b.k JOIN u_root ON u_root.k = ''
"""
