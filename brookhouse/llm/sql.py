"""The operators that SQL can express, for DuckDB."""

from __future__ import annotations

from .quality import BOILERPLATE, MENU

_boiler = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)
_menu = "|".join(MENU)
_word = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_word}') AS w
  FROM documents
), lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d
), judged AS (
  SELECT *, regexp_matches(line, '{_word}') AS word,
    regexp_matches(line, '{_word}') AND (
      2 * len(regexp_extract_all(line, '[#*$%&<>{{}}=~^_\\]|[!?][!?]+')) >= len(regexp_extract_all(line, '{_word}'))
      OR regexp_matches(line, '^[^\p{{L}}\p{{N}}]*$')
      OR len(regexp_extract_all(line, '[|»›•→]')) >= 3
      OR regexp_matches(line, '(?i)^\W*(?:{_menu})(?:\W+(?:{_menu}))+\W*$')
      OR regexp_matches(line, '(?i){_boiler}')) AS bad
  FROM lines
), by_doc AS (
  SELECT r, count(*) FILTER (word) AS n_lines, count(*) FILTER (bad) AS n_bad_lines,
    count(*) FILTER (word) - count(DISTINCT line) FILTER (word) AS n_dup_lines,
    coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (bad), 0) AS lost_chars,
    md5(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT bad), '')) AS clean_md5
  FROM judged GROUP BY r
), grams AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, generate_series(1, len(w) - 2) AS g(i)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM repeated, (VALUES (0), (1), (2)) AS x(o) GROUP BY r
), base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_lines, n_bad_lines, lost_chars, clean_md5
  FROM d LEFT JOIN by_doc USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 40 * word_chars AS kept,
  n_lines::BIGINT AS n_lines, n_bad_lines::BIGINT AS n_bad_lines, lost_chars::BIGINT AS lost_chars, clean_md5
FROM base
"""


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


MIX_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS s,
    {_hash("'7'", "coalesce(doc_id::VARCHAR, '')", "md5(coalesce(text, ''))")} AS h,
    len(regexp_extract_all(coalesce(text, ''), '{_word}'))::BIGINT AS n
  FROM documents
), blocks AS (
  SELECT s, h % 256 AS b, sum(n)::BIGINT AS n FROM keyed GROUP BY ALL
), sources AS (
  SELECT s, sum(n)::BIGINT AS tokens FROM blocks GROUP BY s HAVING sum(n) > 0
), whole AS (
  SELECT list(tokens / corpus ORDER BY s) AS p, any_value(corpus) AS corpus
  FROM (SELECT s, tokens, sum(tokens) OVER ()::DOUBLE AS corpus FROM sources)
), by_entropy AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN (lo + hi) / 2 ELSE lo END, CASE WHEN good THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi,
          list_sum(list_transform(q, lambda x: -(x / list_sum(q)) * ln(x / list_sum(q)))) >= 0.97 * ln(len(q)) AS good
        FROM (SELECT i, lo, hi, list_transform(p, lambda x: x ** ((lo + hi) / 2)) AS q FROM by_entropy, whole WHERE i < 60))
), by_repeats AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN lo ELSE (lo + hi) / 2 END, CASE WHEN good THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, list_max(list_transform(list_zip(q, p), lambda x: x[1] / list_sum(q) / x[2])) <= 4.0 AS good
        FROM (SELECT i, lo, hi, p, list_transform(p, lambda x: x ** ((lo + hi) / 2)) AS q FROM by_repeats, whole WHERE i < 60))
), exponent AS (
  SELECT greatest(
    CASE WHEN list_sum(list_transform(p, lambda x: -x * ln(x))) >= 0.97 * ln(len(p)) THEN 1.0
         ELSE (SELECT lo FROM by_entropy WHERE i = 60) END,
    CASE WHEN list_max(list_transform(p, lambda x: 1.0 / len(p) / x)) <= 4.0 THEN 0.0
         ELSE (SELECT hi FROM by_repeats WHERE i = 60) END) AS a, p, corpus
  FROM whole
), plan AS (
  SELECT s, weight, take // tokens AS epochs, take % tokens AS rest
  FROM (SELECT s, tokens, (tokens / corpus) ** a / list_sum(list_transform(p, lambda x: x ** a)) AS weight,
          floor((tokens / corpus) ** a / list_sum(list_transform(p, lambda x: x ** a)) * corpus)::BIGINT AS take
        FROM sources, exponent)
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY s ORDER BY o, b) AS upto
  FROM (SELECT s, b, n, rest, {_hash("'7'", "epochs::VARCHAR", "s", "b::VARCHAR")} AS o FROM blocks JOIN plan USING (s))
), cut AS (
  SELECT s, o AS cut_o, b AS cut_b, rest - upto + n AS room
  FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o, b) AS k FROM ranked WHERE upto > rest) WHERE k = 1
), last AS (
  SELECT s, max(h) AS cut_h
  FROM (SELECT keyed.s, h, room, sum(n) OVER (PARTITION BY keyed.s ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto
        FROM keyed JOIN cut ON keyed.s = cut.s AND keyed.h % 256 = cut_b) WHERE upto <= room GROUP BY s
), drawn AS (
  SELECT keyed.*, weight,
    epochs + CASE WHEN o < cut_o OR (o = cut_o AND b < cut_b) OR (b = cut_b AND h <= coalesce(cut_h, -1)) THEN 1 ELSE 0 END AS copies,
    b
  FROM (SELECT keyed.*, h % 256 AS b, weight, epochs, {_hash("'7'", "epochs::VARCHAR", "s", "(h % 256)::VARCHAR")} AS o
        FROM keyed JOIN plan USING (s) WHERE n > 0) AS keyed LEFT JOIN cut USING (s) LEFT JOIN last USING (s)
)
SELECT doc_id, source, n AS n_tokens, round(weight, 9) AS weight, epoch::BIGINT AS epoch,
  {_hash("'7'", "epoch::VARCHAR", "s", "b::VARCHAR")} AS block_order, h AS doc_order
FROM drawn, generate_series(0, copies - 1) AS g(epoch)
"""

# crc32 of ASCII texts: a table of 256 remainders, then one step per character.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
)"""


def _crc(text: str) -> str:
    return (f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT), "
            "lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)")


TRIE_SQL = rf"""
WITH {_CRC_TABLE}, turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("conv_id::VARCHAR")} % 6 AS head
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.head
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.head
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM rebuilt
), paths AS (
  SELECT conv_id, depth, length(text) AS n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
    OVER (PARTITION BY conv_id ORDER BY depth) AS name FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), linked AS (
  SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS up,
    depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths
), nodes AS (
  SELECT name, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM linked GROUP BY name, depth
), children AS (
  SELECT up AS name, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), sums AS (
  SELECT p.name, count(*) FILTER (c.name IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.n) AS saved
  FROM nodes v LEFT JOIN children c USING (name) JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.name
)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN sums USING (name) LEFT JOIN children USING (name) LEFT JOIN nodes u ON u.name = v.up
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(changed: dict[str, str]) -> str:
    texts = [f"({changed.get(c, c)})::VARCHAR" for c in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({t})) || ':' || {t}, '-')" for t in texts) + ")"


MERKLE_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS tree, {_leaf({})} AS leaf,
    CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf({"n_chars": "n_chars + 1"})} ELSE {_leaf({})} END AS now
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM leaves
), levels AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS l FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], '')))
  FROM levels WHERE len(l) > 1
), subroots AS (
  SELECT tree, l[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS turn FROM levels WHERE len(l) = 1
), tops AS (
  SELECT 1000 AS level, list(subroot ORDER BY turn) AS l FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], '')))
  FROM tops WHERE len(l) > 1
), steps AS (
  SELECT r, level, l[xor(pos >> level, 1) + 1] AS sibling, (pos >> level) & 1 AS turned
  FROM placed JOIN levels USING (tree) WHERE len(l) > 1
  UNION ALL
  SELECT r, level, l[xor(turn >> (level - 1000), 1) + 1], (turn >> (level - 1000)) & 1
  FROM placed JOIN subroots USING (tree), tops WHERE len(l) > 1
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS step FROM steps
), folded AS (
  SELECT r, 0 AS step, now AS h FROM placed
  UNION ALL
  SELECT f.r, n.step, sha256(CASE WHEN turned = 1 THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END)
  FROM folded f JOIN numbered n ON n.r = f.r AND n.step = f.step + 1
), done AS (
  SELECT r, arg_max(h, step) AS folded_root FROM folded GROUP BY r
), proofs AS (
  SELECT r, string_agg(sibling, '' ORDER BY step) AS joined FROM numbered GROUP BY r
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(joined, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN done USING (r) LEFT JOIN proofs USING (r),
  (SELECT l[1] AS root FROM tops WHERE len(l) = 1)
"""
