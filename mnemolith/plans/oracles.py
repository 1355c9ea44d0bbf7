"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

TERMS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"
MESSAGES = f"m AS (SELECT conv_id AS session_id, turn, turn + 1 AS position, role, text, CAST({TOKENS.format('text')} AS BIGINT) AS tokens FROM conversations)"
ITEMS = """items AS (SELECT d.doc_id AS item_id, CASE WHEN d.doc_id % 10 = 0 THEN 'correction' WHEN d.doc_id % 10 = 1 THEN 'contradiction' ELSE 'rlm_chunk' END AS source_type,
 d.source AS agent_id, CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' ELSE 'medium' END AS confidence, coalesce(l.toxic = 1, false) AS controller_ignored,
 CASE WHEN d.doc_id % 7 = 0 THEN d.doc_id + 1 END AS superseded_by, CASE WHEN d.doc_id % 7 = 1 THEN d.doc_id - 1 END AS supersedes, d.doc_id * 10 AS indexed_at, d.text
 FROM documents d LEFT JOIN labels l USING (doc_id))"""
HOOKS = """h AS (SELECT event_id, user_id AS session_id, ts, value, props, CASE event_type WHEN 'signup' THEN 'prompt' WHEN 'view' THEN 'tool' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'stop' WHEN 'error' THEN 'discard' ELSE 'other' END AS kind FROM events)"""


def values(rows) -> str:
    return "(VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{q}')" for i, q in rows) + ")"


def bm25_ctes(table: str, key: str, queries, where: str = "TRUE", text: str = "text") -> str:
    """CTEs that end in scored(query_id, <key columns>, score)."""
    return f"""q AS (SELECT DISTINCT query_id, unnest({TERMS.format('query')}) AS term FROM {values(queries)} t(query_id, query)),
c AS (SELECT {key}, {TERMS.format(text)} AS t FROM {table} WHERE {where}),
s AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM c),
e AS (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM c),
tf AS (SELECT {key}, dl, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, {key}, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY query_id, {key})"""


def top(source: str, group: str, key: str, k: int, score: str = "score", cols: str = "*") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {score} DESC, {key}) AS rank FROM {source}) WHERE rank <= {k}"


def chunk_ctes(size: int, overlap: int, table: str = "documents") -> str:
    """A recursive walk that ends in chunks(doc_id, chunk_index, char_start, char_end, text)."""
    last = "CASE WHEN strpos(reverse(win), reverse('{0}')) = 0 THEN -1 ELSE lo + length(win) - strpos(reverse(win), reverse('{0}')) - length('{0}') + 1 END"
    nn = "(CASE WHEN strpos(reverse(win), chr(10) || chr(10)) = 0 THEN -1 ELSE lo + length(win) - strpos(reverse(win), chr(10) || chr(10)) - 1 END)"
    n1 = "(CASE WHEN strpos(reverse(win), chr(10)) = 0 THEN -1 ELSE lo + length(win) - strpos(reverse(win), chr(10)) END)"
    dot = f"({last.format('. ')})"
    step = f"""SELECT doc_id, text, i, s, CASE WHEN tg = length(text) THEN tg WHEN tg - s < 400 OR b <= s THEN tg
 WHEN substr(text, b + 1, 2) = chr(10) || chr(10) THEN b + 2 WHEN substr(text, b + 1, 1) = chr(10) THEN b + 1 ELSE b + 2 END AS e
 FROM (SELECT *, greatest({nn}, {n1}, {dot}) AS b FROM (SELECT *, substr(text, lo + 1, tg - lo) AS win FROM (SELECT *, s + greatest(200, (tg - s) // 2) AS lo FROM (SELECT *, least(length(text), s + {size}) AS tg FROM src))))"""
    return f"""chunks_raw AS ({step.replace('FROM src', f"FROM (SELECT doc_id, text, 0 AS i, 0 AS s FROM {table} WHERE length(text) > 0) src")}
 UNION ALL {step.replace('FROM src', f"FROM (SELECT doc_id, text, i + 1 AS i, CASE WHEN e - {overlap} > s THEN e - {overlap} ELSE s + {max(100, size // 10)} END AS s FROM chunks_raw WHERE e < length(text)) src")}),
chunks AS (SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, s AS char_start, e AS char_end, text FROM chunks_raw)"""


def compaction_ctes(rounds: int, soft: int) -> str:
    """CTEs from v1(session_id, position, kind, id, role, text, tokens, level, a, b), a context of messages and summaries, to v<rounds + 1> and all new summaries."""
    cost = lambda x: f"({TOKENS.format('p')}".replace("p", f"('[LCM summary node preview]' || chr(10) || {x})") + " + 5)"
    fixed = "CASE WHEN c > 2 THEN 3 WHEN c = 2 THEN 2 ELSE 1 END"
    out = [f"b0 AS (SELECT session_id, CAST(sum(tokens + 5) AS BIGINT) AS before FROM v1 GROUP BY 1), live1 AS (SELECT session_id FROM b0 WHERE before >= {soft})"]
    for r in range(1, rounds + 1):
        out.append(f"""t{r} AS (SELECT session_id, count(*) FILTER (kind = 'summary') AS sums FROM v{r} WHERE session_id IN (SELECT session_id FROM live{r}) GROUP BY 1 HAVING sum(tokens + 5) > {soft}),
m{r} AS (SELECT v.*, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY v.session_id) AS c FROM v{r} v JOIN t{r} USING (session_id) WHERE kind = 'message' WINDOW w AS (PARTITION BY v.session_id ORDER BY position)),
u{r} AS (SELECT session_id, i, row_number() OVER (PARTITION BY session_id ORDER BY i DESC) AS k FROM m{r} WHERE role = 'user'),
cand{r} AS (SELECT * FROM m{r} n WHERE c > 2 AND i < least(c - 2, coalesce((SELECT max(i) FROM u{r} u WHERE u.session_id = n.session_id AND k = 2), c))),
x{r} AS (SELECT session_id, position, kind, id, role, text, tokens, level, a, b FROM cand{r} UNION ALL SELECT v.session_id, position, kind, id, role, text, tokens, level, a, b FROM v{r} v JOIN t{r} USING (session_id) WHERE kind = 'summary' AND sums > 1 AND v.session_id NOT IN (SELECT session_id FROM cand{r})),
n{r} AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS c FROM x{r}),
an{r} AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS k FROM n{r} WHERE i = 0 OR i = c - 1 OR (c > 2 AND i = c // 2) OR i >= greatest(0, c - 8 + {fixed})),
li{r} AS (SELECT session_id, string_agg('- #' || i || ' ' || role || ': ' || substr(text, 1, 300), chr(10) ORDER BY i) AS lines FROM an{r} WHERE k <= 8 GROUP BY 1),
z{r} AS (SELECT session_id, count(*) AS n, CAST(sum(CASE kind WHEN 'message' THEN tokens + 5 ELSE {cost('text')} END) AS BIGINT) AS raw, min(position) AS position, max(level) + 1 AS level, min_by(a, position) AS a, max_by(b, position) AS b, bool_or(kind = 'summary') AS nodes FROM x{r} GROUP BY 1),
y{r} AS (SELECT z.*, '[L3 DETERMINISTIC COMPACTION — ' || n || ' messages]' || chr(10) || chr(10) || chr(10) || 'Context Anchors:' || chr(10) || lines AS l3,
 CASE WHEN nodes THEN '[LCM deterministic condensation: ' || n || ' summary nodes. Raw sources preserved from ' || a || ' to ' || b || '.]' ELSE '[LCM deterministic compaction: ' || n || ' messages. Raw sources preserved from ' || a || ' to ' || b || '.]' END AS ref FROM z{r} z JOIN li{r} USING (session_id)),
q{r} AS (SELECT *, CASE WHEN n = 1 OR {cost('l3')} < raw THEN l3 WHEN {cost('ref')} < raw THEN ref END AS content, 'sum_' || substr(sha256(session_id || chr(31) || level || chr(31) || a || chr(31) || b), 1, 32) AS id FROM y{r}),
new{r} AS (SELECT {r} AS round, session_id, position, level, a, b, content, id, nodes, {TOKENS.format("('[LCM summary node ' || id || ']' || chr(10) || content)")} AS tokens FROM q{r} WHERE content IS NOT NULL),
v{r + 1} AS (SELECT v.session_id, v.position, v.kind, v.id, v.role, v.text, v.tokens, v.level, v.a, v.b FROM v{r} v LEFT JOIN (SELECT x.session_id, x.kind, x.id FROM x{r} x JOIN new{r} USING (session_id)) g ON v.session_id = g.session_id AND v.kind = g.kind AND v.id = g.id WHERE g.id IS NULL
 UNION ALL SELECT session_id, position, 'summary', id, 'assistant', content, tokens, level, a, b FROM new{r}), live{r + 1} AS (SELECT session_id FROM new{r})""")
    return ", ".join(out)


def fitted(text: str, marker: str, most: str) -> str:
    """A text cut to most tokens with a marker; NULL if there is no room for the marker."""
    room = f"greatest(1, length({marker}) // 4)"
    body = f"rtrim(substr({text}, 1, CAST(greatest(0, ({most} - {room}) * 4) AS BIGINT)), ' ')"
    return f"(CASE WHEN {room} > {most} THEN NULL WHEN {body} = '' THEN trim({marker}, ' ' || chr(10)) ELSE {body} || {marker} END)"
