"""DuckDB SQL twins of the text queries, where SQL can express them."""

from .quality import RULES, STOP_WORDS
from .urls import BLOCKED_PATHS, BLOCKED_WORDS, PREFIX_RULES

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _rule(r) -> str:
    whole = "1" if r.whole == "one" else r.whole
    parts = [f"{r.part} >= {whole} * {r.least}"] if r.least is not None else []
    parts += [f"{r.part} <= {whole} * {r.most}"] if r.most is not None else []
    return f"(n_words < {r.from_words} OR ({' AND '.join(parts)}))"


OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(5, i - coalesce(p, -9))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM t) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN c ON d.r = c.r),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {" AND ".join(map(_rule, RULES))}) AS kept FROM b
"""

_fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in sorted(PREFIX_RULES, key=lambda r: -len(r[1] + r[2]))]
_sorted = sorted(PREFIX_RULES, key=lambda r: -len(r[1] + r[2]))
OP10 = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {" ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(_fits, _sorted, strict=True))} END AS rule,
  CASE {" ".join(f"{f} '{v}'" for f, (v, _, _) in zip(_fits, _sorted, strict=True))}
  WHEN regexp_matches(host, '(^|[^0-9a-z_])({"|".join(BLOCKED_WORDS)})($|[^0-9a-z_])') THEN 'block'
  WHEN len(list_intersect(regexp_split_to_array(path, '[^0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+'), {list(BLOCKED_PATHS)!r})) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM h
"""

OP2 = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT dg.doc_id, dg.i, dg.k, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hw.n > 0 AND 20 * hw.n >= len(w), false) AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""

ORACLES = {"op2_decontaminate": OP2, "op6_quality": OP6, "op10_url_rules": OP10}
