"""DuckDB SQL that the queries must equal."""

from __future__ import annotations

from pageloom.llm import containment, maglev, mixing, rule_ledger

# No page of the tables names a canonical link or a refresh; 'alias' would show one that does.
OP1 = r"""
WITH p AS (
  SELECT page_id, html,
    CASE WHEN contains(coalesce(url, ''), '://')
      THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END AS raw_host,
    CASE WHEN contains(coalesce(url, ''), '://')
      THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), h AS (
  SELECT page_id, html, path,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM p
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, rv)
), m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
)
SELECT h.page_id, host, path, rule,
  coalesce(rv, CASE WHEN regexp_matches(html, '(?i)rel=.?canonical|http-equiv=.?refresh') THEN 'alias' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id
"""

_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_SHARDS = ", ".join(f"({k}, '{s}')" for k, s in enumerate(maglev.SHARDS))
_N, _M = len(maglev.SHARDS), maglev.TABLE_SIZE

# One recursion step is one turn: the shard whose turn it is takes the first free slot of its order.
OP2 = f"""
WITH RECURSIVE prefs AS (
  SELECT k, shard, {_HASH.format("shard || ':offset'")} % {_M} AS o, {_HASH.format("shard || ':skip'")} % {_M - 1} + 1 AS s
  FROM (VALUES {_SHARDS}) t(k, shard)
), turns AS (
  SELECT 0 AS n, []::BIGINT[] AS taken, NULL::BIGINT AS slot, NULL::INT AS k
  UNION ALL
  SELECT n + 1, list_append(taken, free), free, pk
  FROM (
    SELECT n, taken, p.k AS pk,
      list_filter([(p.o + j * p.s) % {_M} FOR j IN range({_M})], lambda x: NOT list_contains(taken, x))[1] AS free
    FROM turns JOIN prefs p ON p.k = n % {_N} WHERE n < {_M}
  )
), owners AS (SELECT slot, shard FROM turns JOIN prefs USING (k))
SELECT doc_id, source, n_chars, slot::INT AS slot, shard
FROM (SELECT doc_id, source, n_chars, {_HASH.format("doc_id::VARCHAR")} % {_M} AS slot FROM documents)
JOIN owners USING (slot)
"""

_BITS = " | ".join(f"(CASE WHEN {c} THEN {1 << k} ELSE 0 END)" for k, c in enumerate(rule_ledger.RULES.values()))
_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP10 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p,
    unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) AS five
  FROM w WHERE len(ws) >= 5
), twice AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, p + unnest([0, 1, 2, 3, 4]) FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_latin
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
), b AS (SELECT *, {_BITS} AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & {rule_ledger.mask(rule_ledger.POLICIES["base"])} <> 0 AS base_failed, fail_bits = 0 AS kept,
  n_lines, n_upper, n_latin, fail_bits
FROM b
"""

_N5, _SHARE = containment.WORDS, containment.SHARE


def _shingles(id_: str, table: str) -> str:
    """Distinct word shingles; the whole sequence if there are fewer words."""
    return rf"""
  SELECT DISTINCT {id_}, unnest([array_to_string(ws[i:i + {_N5 - 1}], ' ')
    FOR i IN range(1, greatest(2, len(ws) - {_N5 - 2}))]) AS s
  FROM (SELECT {id_}, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table})
  WHERE len(ws) > 0"""


OP6 = f"""
WITH i AS ({_shingles("item_id", "benchmark")}), d AS ({_shingles("doc_id", "documents")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= {_SHARE} * any_value(n_item) - 1e-9
"""

_STEP = mixing.PARTS**-mixing.PASSES
_TARGET = mixing.Target(entropy=0.99, repeats=4.0)

# Plain bisection on the grid that the operator's passes end on.
OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens,
    CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS key,
    {_HASH.format("coalesce(doc_id::VARCHAR, '')")} % {mixing.BLOCKS} AS block
  FROM documents
), b AS (SELECT key, block, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), t AS (SELECT key, sum(tokens)::BIGINT AS whole FROM b GROUP BY key HAVING sum(tokens) > 0
), ps AS (SELECT list(whole / (SELECT sum(whole) FROM t)) AS p FROM t
), h AS (
  SELECT 0::BIGINT AS lo, {round(1 / _STEP)}::BIGINT AS hi
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, mid, ln(list_sum([pow(x, a) FOR x IN p])) - list_sum([pow(x, a) * a * ln(x) FOR x IN p])
      / list_sum([pow(x, a) FOR x IN p]) >= {_TARGET.entropy} * ln(len(p)) AS ok
    FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, (lo + hi) // 2 * {_STEP!r} AS a, p FROM h, ps WHERE hi - lo > 1))
), r AS (
  SELECT 0::BIGINT AS lo, {round(1 / _STEP)}::BIGINT AS hi
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, mid, list_max([pow(x, a - 1) FOR x IN p]) / list_min([pow(x, a - 1) FOR x IN p]) > {_TARGET.repeats} AS ok
    FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, (lo + hi) // 2 * {_STEP!r} AS a, p FROM r, ps WHERE hi - lo > 1))
), a AS (
  -- at its ends a bisection may not have moved: all alike, or nothing to flatten
  SELECT greatest(
    (SELECT lo FROM h WHERE hi - lo = 1),
    (SELECT CASE WHEN list_max(p) / list_min(p) <= {_TARGET.repeats} THEN 0 ELSE hi END FROM r, ps WHERE hi - lo = 1)
  ) * {_STEP!r} AS a
), w AS (SELECT key, whole, pow(whole / (SELECT sum(whole) FROM t), a) AS w FROM t, a
), g AS (SELECT key, whole, round(w * (1 / (SELECT min(w / whole) FROM w)))::BIGINT AS goal FROM w
), c AS (
  SELECT b.key, b.block, CASE WHEN goal IS NULL THEN 0 ELSE goal // whole + (sum(tokens) OVER (PARTITION BY b.key
    ORDER BY {_HASH.format(f"concat_ws(':', '{mixing.SEED}', b.key, b.block)")}, b.block
    ROWS UNBOUNDED PRECEDING) <= goal % whole)::BIGINT END AS copies
  FROM b LEFT JOIN g ON b.key = g.key
)
SELECT doc_id, source, n_tokens, block::INT AS block, copies FROM d JOIN c USING (key, block)
"""

# The text itself is what must come back.
OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT doc_id, t, length(t) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d
), c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS p, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS q,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN p END AS prefix_chars,
  CASE WHEN form != 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || t[:p] || '<S>' || t[q + 1:] || '<M>' || t[p + 1:q]
    ELSE '<S>' || t[q + 1:] || '<P>' || t[:p] || '<M>' || t[p + 1:q] END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""

ORACLE = {
    "op1_url_blocks": OP1,
    "op2_sharding": OP2,
    "op6_decontamination": OP6,
    "op7_mixing": OP7,
    "op10_quality_rules": OP10,
    "op12_fill_in_middle": OP12,
}
