"""DuckDB SQL for the corpus queries that SQL can say, written independently of the operators."""

from __future__ import annotations

from .licenses import TEMPLATES

WORD = r"'[^\x20\x09-\x0D]+'"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = rf"""WITH b AS (SELECT doc_id, coalesce('a' || source, 'b') AS key, CAST(coalesce(len(regexp_extract_all(text, {WORD})), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 5) AS BIGINT) % 1024 AS salt FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY key),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY key) - 1) % 3 AS BIGINT) + 1] AS weight, 3 * CAST(source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, greatest(CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0), 0) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
  WINDOW o AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, (ratio, key)) AS level FROM l WHERE ratio >= level),
t AS (SELECT l.key, source_size, least(cap, coalesce(weight * f.level, cap)) AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0 END AS rate, CAST(('0x' || substr(md5('0:' || key), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS u FROM t),
k AS (SELECT b.*, source_size, target, rate, u, row_number() OVER (PARTITION BY key ORDER BY size, salt, doc_id) AS i FROM b JOIN r USING (key))
SELECT doc_id, size, source_size, target, CAST(least(floor(i * rate + u) - floor((i - 1) * rate + u), 3) AS BIGINT) * size AS taken FROM k"""

LINES = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {LOWER.format(f'trim(line, {SPACE})')} AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM c)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM c)), '')) AS kept_sha256 FROM k GROUP BY doc_id"""

SUBSTRINGS = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM t WHERE len(w) >= 20),
v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS n FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM v WHERE n > 1),
a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
k AS (SELECT a.doc_id, a.i, word, g.i IS NOT NULL AS gone FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.i = g.i),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

JACCARD = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORD}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
c AS (SELECT u AS doc_id, u AS label FROM (SELECT DISTINCT u FROM e) UNION SELECT e.v, c.label FROM c JOIN e ON e.u = c.doc_id),
m AS (SELECT doc_id, min(label) AS label FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.label, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

_CLASSES = [r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"[.,;:'’\-]", r"[#*$%&|<>]", r"\p{Nd}", r"(?:\p{Lt}|\p{Lm}|\p{Lo})"]
_COUNTS = ", ".join("length(t) - length(regexp_replace(t, '" + c.replace("'", "''") + "', '', 'g'))" for c in _CLASSES)
_PART = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
_JS = f"sqrt(greatest(0, sum({_PART.format('p', 'q')} + {_PART.format('q', 'p')}) / 2))"

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
c7 AS (SELECT doc_id, lang, t, CAST(length(t) AS BIGINT) AS n, [{_COUNTS}] AS k7 FROM d),
c AS (SELECT doc_id, lang, n, k7[2] AS n_space, k7[5] AS n_symbols, unnest(list_append(k7, n - list_sum(k7))) AS k, unnest(range(1, 9)) AS j FROM c7),
lc AS (SELECT lang, j, sum(k) / sum(sum(k)) OVER (PARTITION BY lang) AS q FROM c GROUP BY lang, j),
jc AS (SELECT doc_id, {_JS} AS js FROM (SELECT doc_id, k / n AS p, q FROM c JOIN lc USING (lang, j) WHERE n >= 150) GROUP BY doc_id),
w AS (SELECT doc_id, lang, regexp_extract_all(t, {WORD}) AS w FROM d),
a AS (SELECT doc_id, lang, len(w) AS m, lower(unnest(w)) AS x, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
r AS (SELECT lang, x, count(*) AS k, sum(count(*)) OVER (PARTITION BY lang) AS al FROM a GROUP BY lang, x),
top AS (SELECT * FROM (SELECT lang, x, k / al AS q, row_number() OVER (PARTITION BY lang ORDER BY k DESC, x) AS j FROM r WHERE length(x) <= 5) WHERE j <= 24),
q AS (SELECT lang, x, j, q FROM top UNION ALL SELECT lang, NULL, 0, 1 - sum(q) FROM top GROUP BY lang),
h AS (SELECT a.doc_id, coalesce(top.j, 0) AS j, count(*) / any_value(m) AS p FROM a LEFT JOIN top ON top.lang = a.lang AND top.x = a.x AND length(a.word) <= 5 WHERE m >= 40 GROUP BY ALL),
jw AS (SELECT doc_id, {_JS} AS js FROM (SELECT b.doc_id, coalesce(h.p, 0) AS p, q.q FROM (SELECT doc_id, lang FROM w WHERE len(w) >= 40) b JOIN q ON q.lang = b.lang LEFT JOIN h ON h.doc_id = b.doc_id AND h.j = q.j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {WORD}) GROUP BY doc_id),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 7], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT z) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS z FROM v WHERE k > 1) GROUP BY doc_id),
b AS (SELECT c7.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(c7.n - k7[2] AS BIGINT) AS word_chars, CAST(k7[5] AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM c7 JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT f.*, NOT base_failed AND coalesce(jc.js <= 0.2, true) AND coalesce(jw.js <= 0.35, true) AS kept FROM f LEFT JOIN jc USING (doc_id) LEFT JOIN jw USING (doc_id)"""

_TEMPLATES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES.items())
_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"

LICENSES = f"""WITH tw AS (SELECT license, {_WORDS.format('text')} AS w FROM (VALUES {_TEMPLATES}) t(license, text)),
tq AS (SELECT license, w, least(5, len(w)) AS q, greatest(8, CAST(pow(2, ceil(log2(len(w)))) AS BIGINT)) AS size FROM tw),
ts AS (SELECT DISTINCT license, q, size, array_to_string(w[i : i + q - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - q + 2)) AS i FROM tq)),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
ds AS (SELECT doc_id, q, i - 1 AS i, array_to_string(w[i : i + q - 1], ' ') AS s FROM (SELECT doc_id, w, q, unnest(range(1, len(w) - q + 2)) AS i FROM dw, (SELECT DISTINCT q FROM ts) WHERE len(w) >= q)),
h AS (SELECT doc_id, license, s, size // 2 AS step, unnest(range(greatest(0, CAST(ceil((i - (3 * size // 2 - q)) / (size // 2)) AS BIGINT)), i // (size // 2) + 1)) AS j FROM ds JOIN ts USING (q, s)),
c AS (SELECT doc_id, license, j * step AS place, count(DISTINCT s) / any_value(n) AS c FROM h JOIN tn USING (license) GROUP BY ALL)
SELECT doc_id, license, max(c) AS containment, CAST(min(place) AS BIGINT) AS first_word FROM c WHERE c >= 0.8 GROUP BY ALL"""

#: Each operator to its SQL.
ORACLE = {"op3_mixing": MIXING, "op5_quality": QUALITY, "op6_lines": LINES, "op7_substrings": SUBSTRINGS, "op8_licenses": LICENSES, "op9_topk": TOP_K, "op10_jaccard": JACCARD}
