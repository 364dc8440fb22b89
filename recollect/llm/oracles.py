"""DuckDB SQL for the queries that SQL can express, written from the definitions, not from the Spark code."""

from __future__ import annotations


def spans(source: str, keep: str, text: str, pattern: str, group: int = 0) -> str:
    """A subquery with a row for each match of an RE2 pattern: ``keep``, start ``s`` (code points), match ``m``, its group ``v``.

    ``rid`` identifies a row of ``source``, and ``part`` a text of that row.
    """
    p = pattern.replace("'", "''")
    inner = f"""SELECT {keep}, regexp_extract_all({text}, '{p}') AS ms, string_split_regex({text}, '{p}') AS gs, regexp_extract_all({text}, '{p}', {group}) AS vs FROM {source}"""
    each = f"""SELECT {keep}, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i FROM ({inner}) WHERE len(ms) > 0"""
    return f"""(SELECT {keep}, m, v, (sum(length(g) + length(m)) OVER (PARTITION BY {keep} ORDER BY i) - length(m))::BIGINT AS s FROM ({each}))"""


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


WORD_LIST = "CASE WHEN b = '' THEN []::VARCHAR[] ELSE string_split_regex(b, '[^\\p{L}\\p{N}]+') END"
BARE = "regexp_replace(lower(coalesce(text, '')), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"
SHINGLES = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"

DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {BARE} AS b FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), 5)::BIGINT AS k FROM (SELECT item_id, {WORD_LIST} AS w FROM i) WHERE len(w) > 0),
gs AS (SELECT item_id, k, {SHINGLES} AS gs FROM iw),
ig AS (SELECT item_id, k, len(gs) AS n_item, unnest(gs) AS g FROM gs),
d AS (SELECT row_number() OVER () AS rid, doc_id, {BARE} AS b FROM documents),
dw AS (SELECT rid, doc_id, w, k FROM (SELECT rid, doc_id, {WORD_LIST} AS w FROM d), (SELECT DISTINCT k FROM iw)),
ds AS (SELECT rid, doc_id, k, unnest({SHINGLES}) AS g FROM dw WHERE len(w) >= k)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_item::BIGINT AS n_item, count(*) / n_item::DOUBLE AS containment
FROM ds JOIN ig USING (k, g) GROUP BY rid, doc_id, item_id, n_item HAVING count(*) >= ceil(round(0.8 * n_item, 9))
"""

ASSIGN = "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
MARKED = "(?:gh[pousr]_|glpat-|xox[abprs]-|[rs]k_live_|AIza)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{16,}\\.[A-Za-z0-9_.-]{16,}"

SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS o, concat_ws('/', source, doc_id) AS r, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT rid, o, r, 0 AS k, s, s + length(m) AS e, v FROM {spans('d', 'rid, o, r', 't', ASSIGN, 2)} WHERE length(v) >= 6
  UNION ALL SELECT rid, o, r, 1, s, s + length(m), m FROM {spans('d', 'rid, o, r', 't', 'AKIA[A-Z0-9]+')} WHERE length(m) >= 20
  UNION ALL SELECT rid, o, r, 2, s, s + length(m), m FROM {spans('d', 'rid, o, r', 't', '[0-9a-f]+')} WHERE length(m) >= 24
  UNION ALL SELECT rid, o, r, 3, s, s + length(m), m FROM {spans('d', 'rid, o, r', 't', MARKED)}
),
own AS (SELECT v, count(DISTINCT o) AS owners, count(DISTINCT (o, r)) AS repositories FROM f GROUP BY v),
judged AS (
  SELECT rid, s, e, v, CASE WHEN owners >= 3 OR (owners = 2 AND repositories >= 5) THEN 4
    WHEN owners = 1 AND length(v) >= 16 AND len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') THEN 5 END AS k
  FROM f JOIN own USING (v)
),
a AS (SELECT rid, k, s, e FROM f UNION SELECT rid, k, e - length(v), e FROM judged WHERE k IS NOT NULL),
n AS (SELECT rid, k, s, e, ['assign', 'access', 'hex', 'token', 'copied', 'live'][k + 1] || ':' || s || ':' || e AS txt FROM a),
g AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    count(*) FILTER (k = 4) AS n_copied, count(*) FILTER (k = 5) AS n_live,
    string_agg(txt, ',' ORDER BY s, k, e) FILTER (k <= 2) AS base, string_agg(txt, ',' ORDER BY s, k, e) AS spans
  FROM n GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN g USING (rid)
"""

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"
IP = "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)"
CARD = "[0-9]([\\x20-]?[0-9])+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = "list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(n), i, 1)::INT WHEN substr(reverse(n), i, 1)::INT >= 5 THEN 2 * substr(reverse(n), i, 1)::INT - 9 ELSE 2 * substr(reverse(n), i, 1)::INT END)) % 10 = 0"

PII = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT rid, 0 AS k, s, m, lower(m) AS val FROM {spans('d', 'rid', 't', EMAIL)}
  UNION ALL SELECT rid, 1, s, m, lower(m) FROM {spans('d', 'rid', 't', IP)}
    WHERE len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS BIGINT), 999) > 255)) = 0
  UNION ALL SELECT rid, 2, s, m, n FROM (SELECT *, {DIGITS} AS n FROM {spans('d', 'rid', 't', CARD)})
    WHERE CASE WHEN length(n) BETWEEN 16 AND 19 THEN {LUHN} ELSE FALSE END
  UNION ALL SELECT rid, 3, s, m, n FROM (SELECT *, {DIGITS} AS n FROM {spans('d', 'rid', 't', PHONE)}) WHERE length(n) BETWEEN 8 AND 15
),
b AS (SELECT rid, k, s, s + length(m) AS e, k || ':' || val AS val FROM f),
letters AS (SELECT rid, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS p FROM d WHERE rid IN (SELECT rid FROM b)),
masked AS (
  SELECT rid, string_agg(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.rid = l.rid AND b.s <= l.p AND l.p < b.e) THEN ' ' ELSE c END, '' ORDER BY p) AS t FROM letters l GROUP BY rid
),
held AS (SELECT DISTINCT rid, val FROM b),
w AS (SELECT rid, lower(m) AS term, s AS ts, s + length(m) AS te FROM {spans('masked', 'rid', 't', '\\p{L}+')}),
pairs AS (SELECT val, term, count(*) AS n_both FROM held JOIN (SELECT DISTINCT rid, term FROM w) USING (rid) GROUP BY ALL HAVING count(*) >= 2),
words AS (SELECT rid, unnest(list_distinct(list_transform(string_split_regex(t, '[^\\p{{L}}]+'), lambda x: lower(x)))) AS term FROM d),
nt AS (SELECT term, count(*) AS n_term FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY term),
nv AS (SELECT val, count(DISTINCT rid) AS n_value FROM b GROUP BY val),
tot AS (SELECT count(*)::DOUBLE AS n FROM d),
told AS (
  SELECT val, term FROM pairs JOIN nt USING (term) JOIN nv USING (val), tot
  WHERE CASE WHEN ln(n / n_value) > 0 THEN round(ln(n * n_both / (n_term * n_value)) / ln(n / n_value), 9) ELSE 0 END >= 0.8
),
t AS (SELECT DISTINCT rid, 4 AS k, ts AS s, te AS e FROM w JOIN held USING (rid) JOIN told USING (val, term)),
a AS (SELECT rid, k, s, e FROM b UNION ALL SELECT * FROM t),
n AS (SELECT *, ['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || s || ':' || e AS txt FROM a),
g AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    count(*) FILTER (k = 4) AS n_term, string_agg(txt, ',' ORDER BY k, s, e) FILTER (k < 4) AS base, string_agg(txt, ',' ORDER BY k, s, e) AS spans
  FROM n GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0)::BIGINT AS n_term
FROM d LEFT JOIN g USING (rid)
"""

RANKED_SEARCH = """
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
),
totals AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS nd, sum(len(terms))::BIGINT AS l FROM cut),
q AS (
  SELECT row_number() OVER () AS qid, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark
),
want AS (SELECT qid, item_id, unnest(terms) AS term FROM q),
tf AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM cut) GROUP BY ALL),
held AS (SELECT * FROM tf WHERE term IN (SELECT term FROM want)),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY term, nd),
part AS (
  SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l)))) AS part FROM held JOIN w USING (term), totals
),
s AS (SELECT qid, item_id, rid, doc_id, sum(part)::BIGINT AS score FROM want JOIN part USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
"""

HARD_NEGATIVES = """
WITH good AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0
),
p AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id NULLS LAST) AS rank, n.id AS negative_id,
    p.score AS positive_score, n.score AS negative_score
  FROM p JOIN pairs n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
