"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from terrapanel.llm.secrets import BASE, MORE

WORDS = r"""w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""

NGRAM_JOIN = f"""WITH RECURSIVE {WORDS},
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY 1"""

BACKOFF = f"""WITH {WORDS},
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
b AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM t),
c1 AS (SELECT word, count(*) AS c FROM b GROUP BY 1), o1 AS (SELECT doc_id, word, count(*) AS c FROM b GROUP BY ALL),
c2 AS (SELECT prev, word, count(*) AS c FROM b WHERE prev IS NOT NULL GROUP BY ALL), o2 AS (SELECT doc_id, prev, word, count(*) AS c FROM b WHERE prev IS NOT NULL GROUP BY ALL),
u AS (SELECT o1.doc_id, o1.word, c1.c - o1.c AS c FROM o1 JOIN c1 ON o1.word = c1.word),
v AS (SELECT o2.doc_id, o2.prev, o2.word, c2.c - o2.c AS c FROM o2 JOIN c2 ON o2.prev = c2.prev AND o2.word = c2.word),
g AS (SELECT b.doc_id, b.prev IS NOT NULL AND v.c = 0 AS backed,
 CASE WHEN v.c > 0 THEN ln(v.c / before.c) ELSE ln((CASE WHEN b.prev IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END)
  * ((CASE WHEN u.c > 0 THEN u.c ELSE 0.4::DOUBLE END) / greatest((SELECT count(*) FROM b) - count(*) OVER (PARTITION BY b.doc_id), 1))) END AS score
 FROM b JOIN u ON b.doc_id = u.doc_id AND b.word = u.word LEFT JOIN v ON b.doc_id = v.doc_id AND b.prev = v.prev AND b.word = v.word
 LEFT JOIN u before ON b.doc_id = before.doc_id AND b.prev = before.word)
SELECT d.doc_id, count(g.doc_id) AS n_words, count(*) FILTER (WHERE backed) AS n_backed_off, round(coalesce(sum(score), 0.0), 4) AS log_score
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY 1"""


def _spans(number: int, kind: str, pattern: str, value: int, least: int) -> str:
    text = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {number} AS number, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{
 'start': list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0), 'size': length(hits[i]), 'value': length(vals[i])}}),
 lambda h: h.value >= {least})) AS h FROM (SELECT doc_id, string_split_regex(text, '{text}') AS gaps, regexp_extract_all(text, '{text}') AS hits, regexp_extract_all(text, '{text}', {value}) AS vals
 FROM d WHERE regexp_matches(text, '{text}'))"""


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(_spans(i, r.kind, r.pattern, r.value, r.least) for i, r in enumerate(BASE + MORE))}),
g AS (SELECT doc_id, number, kind || ':' || CAST(h.start AS BIGINT) || ':' || CAST(h.start + h.size AS BIGINT) AS span, h.start AS start FROM f)
SELECT d.doc_id, {', '.join(f"count(*) FILTER (WHERE number = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
 sha256(coalesce(string_agg(span, ',' ORDER BY start, number) FILTER (WHERE number < {len(BASE)}), '')) AS base_sha256,
 coalesce(string_agg(span, ',' ORDER BY start, number), '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY 1"""


SOURCE_AUDIT = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 5) // (n.n + 5 * v.v) AS p
 FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 5)::HUGEINT // (any_value(n) + 5 * any_value(v)) AS q
 FROM p JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY 1) USING (lang) JOIN v USING (lang) GROUP BY ALL),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS s FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT * FROM y WHERE part = 'pair' OR rank <= 50"""

HARD_NEGATIVES = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.r, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
 CAST(row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
 FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

_LENGTH = r"""(length({0}) + length({0}) - length(replace({0}, chr(92), '')) + len(regexp_extract_all({0}, '</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]|\[TURN\]')))"""

CHATS = f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT conv_id, i, role, text, {_LENGTH.format("text")} + CASE WHEN role = before THEN 6 WHEN role = 'user' THEN 15 WHEN role = 'system' THEN 18
 WHEN role = 'assistant' THEN 7 ELSE 19 + {_LENGTH.format("role")} END AS size FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(size)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""
