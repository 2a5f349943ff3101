"""DuckDB SQL for the operators that SQL can express, written independently of them.

The rest (fuzzy lines, token counts, trained scorers, iterated splitters) is tested against brute
force, the library itself or held-out labels.
"""

from __future__ import annotations

from .secrets import RULES

_FOLD = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_BENCH_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda z: COALESCE(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(nth AS INT) AS rank, vec_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM p) WHERE nth <= 20
"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY ALL),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.at)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, MIN(r.at) AS component_id FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY ALL
"""


def _found(nth: int, pattern: str, group: int, least: int, kind: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {nth} AS nth, '{kind}' AS kind, m, s, i, {'g[i]' if group else 'm[i]'} AS counted, {least} AS least
 FROM (SELECT *, UNNEST(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s{f", regexp_extract_all(t, '{p}', {group}) AS g" if group else ""} FROM docs))"""


_BASE = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
_SECRETS = f"""
WITH docs AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(_found(i, r.pattern, r.group, r.least, r.kind) for i, r in enumerate(RULES))}),
spans AS (SELECT doc_id, nth, kind, CAST(e - length(m[i]) AS INT) AS b, CAST(e AS INT) AS e FROM (
  SELECT *, list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e FROM hits WHERE length(counted) >= least)),
per AS (SELECT doc_id, {", ".join(f"COUNT(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)},
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, nth) FILTER (kind IN ({_BASE})) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, nth) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"COALESCE(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM docs LEFT JOIN per USING (doc_id)
"""

_MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(SUM(size) AS BIGINT) AS s, (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, SUM(s) OVER () - COALESCE(SUM(3 * s) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, SUM(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM t WINDOW q AS (ORDER BY s * CASE w WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 2 END, source NULLS LAST)),
f AS (SELECT MAX(rest) AS rest, MAX(ws) AS ws FROM o WHERE NOT rest * w > 3 * s * ws),
aim AS (SELECT source, s, w, CASE WHEN o.rest * w > 3 * s * o.ws THEN CAST(3 * s AS DOUBLE) ELSE COALESCE(CAST(w * f.rest AS DOUBLE) / CAST(f.ws AS DOUBLE), 0.0) END AS target FROM o, f),
c AS (SELECT d.*, CAST(COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS upto FROM d),
h AS (SELECT c.doc_id, c.size, aim.s AS source_size, aim.target, (aim.w - 2) * 0.5::DOUBLE AS slope, upto FROM c JOIN aim ON c.source IS NOT DISTINCT FROM aim.source),
k AS (SELECT *, (CASE WHEN CAST(upto * 2 + size AS DOUBLE) < target * 2 THEN 1 ELSE 0 END) + (CASE WHEN CAST((source_size + upto) * 2 + size AS DOUBLE) < target * 2 THEN 1 ELSE 0 END)
  + (CASE WHEN CAST((2 * source_size + upto) * 2 + size AS DOUBLE) < target * 2 THEN 1 ELSE 0 END) AS passes, CAST(upto * 2 + size AS DOUBLE) / (target * 2) AS part FROM h)
SELECT doc_id, size, source_size, target, CAST(size * passes AS BIGINT) AS taken, CASE WHEN passes = 0 THEN 2.0::DOUBLE ELSE part * 2 / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + slope * 4 * part)) END AS position FROM k
"""

_LEAKS = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(w[j:j + m - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS m, UNNEST(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, m, j, array_to_string(w[j:j + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, UNNEST(range(1, len(w) - m + 2)) AS j FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, j, dw.m, item FROM dw JOIN iw ON dw.g = iw.g AND dw.m = iw.m),
words AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, UNNEST(range(j, j + m)) AS p FROM hit) GROUP BY ALL),
items AS (SELECT doc_id, COUNT(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY ALL)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(words.n, 0) AS n_hit, COALESCE(items.n, 0) AS n_items, sha256(COALESCE(names, '')) AS items_sha256, COALESCE(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_REPEATS = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("COALESCE(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, j, array_to_string(w[j:j + 19], ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 18)) AS j FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, j FROM (SELECT doc_id, j, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id, j) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, UNNEST(range(j, j + 20)) AS p FROM late) GROUP BY ALL),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT d.doc_id, UNNEST(w) AS x, UNNEST(range(1, len(w) + 1)) AS p FROM d) k LEFT JOIN (SELECT doc_id, UNNEST(ps) AS p FROM gone) g USING (doc_id, p) WHERE g.p IS NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(len(ps), 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_topk_search": _TOP_K,
    "op4_ngram_jaccard": _NEAR,
    "op5_secret_scan": _SECRETS,
    "op6_mixing": _MIX,
    "op7_decontamination": _LEAKS,
    "op9_substring_dedup": _REPEATS,
}
