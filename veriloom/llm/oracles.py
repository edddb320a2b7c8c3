"""SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT l.x, r.m FROM l JOIN r ON l.y = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.m) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

_CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|/?SYS>>|\|[A-Za-z0-9_]+\|>|bos>|eos>|start_of_turn>|end_of_turn>)"
OP4 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS prior,
    length(regexp_replace(replace(text, '\', '\\'), '{_CONTROL}', '\1\\\2', 'g')) AS body,
    length(regexp_replace(replace(role, '\', '\\'), '{_CONTROL}', '\1\\\2', 'g')) AS head
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN prior IS NULL OR prior <> role THEN 34 + head ELSE 11 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
gg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM gg WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
s AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN dl ON dl.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines THEN 1 ELSE 0 END) AS bad FROM f GROUP BY source),
m AS (SELECT sum(n) AS n, sum(bad) AS f, sum(n * (bad / n) * (bad / n)) AS q, count(*) AS k, least(greatest(sum(bad) / sum(n), 0.001), 0.999) AS mean FROM h),
a AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(q / n - (f / n) * (f / n) - mean * (1 - mean) * k / n, 0.000001) - 1, 1), 10000) AS strength FROM m),
b AS (SELECT source, (bad + mean * strength) / (n + strength) > 0.6 AS out FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT b.out AS kept
FROM f JOIN b ON b.source IS NOT DISTINCT FROM f.source
"""


def _spans(kind: str, rank: int, regex: str, group: int, least: int) -> str:
    """Rows (doc_id, start, rank, kind, end) of one rule."""
    q = regex.replace("'", "''")
    return rf"""
SELECT doc_id, before + gap AS a, {rank} AS rank, '{kind}' AS kind, before + gap + length(m) AS z, g FROM (
  SELECT doc_id, ms[i] AS m, gs[i] AS g, length(ps[i]) AS gap,
    coalesce(list_sum(list_transform(ps[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS before
  FROM (SELECT doc_id, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{q}', 0) AS ms, regexp_extract_all(t, '{q}', {group}) AS gs, string_split_regex(t, '{q}') AS ps
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))) ) WHERE length(g) >= {least}"""


def _op7() -> str:
    from veriloom.llm.secrets import BASE, RULES

    parts = " UNION ALL ".join(_spans(r.kind, k, r.regex, r.group, r.least) for k, r in enumerate(RULES))
    text = "kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(z AS BIGINT) AS VARCHAR)"
    n = lambda k: f"count(*) FILTER (kind = '{k}') AS n_{k}"
    return rf"""
WITH s AS ({parts}), g AS (
  SELECT doc_id, {n("assign")}, {n("access")}, {n("hex")},
    coalesce(string_agg({text}, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}), '') AS base,
    string_agg({text}, ',' ORDER BY a, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""


OP11 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT r, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_contains(list_transform(e, lambda x: x <> 0), true)),
l AS (SELECT a.r AS x, b.r AS y FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
m AS (SELECT r, vec_id AS m FROM v UNION SELECT l.x, m.m FROM l JOIN m ON l.y = m.r),
c AS (SELECT r, min(m) AS m FROM m GROUP BY r)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, vec_id IS NOT DISTINCT FROM c.m AS kept
FROM v JOIN c ON c.r = v.r LEFT JOIN n ON n.x = v.r
"""

ORACLES = {"op1_ngram_jaccard_join": OP1, "op4_chat_formatting": OP4, "op7_secret_scans": _op7(), "op8_quality_rules": OP8, "op11_embedding_near_dedup": OP11}
