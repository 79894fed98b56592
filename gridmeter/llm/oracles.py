"""DuckDB SQL for the queries that SQL can express on whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

OP6 = rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, list_slice(w, s, s + 19) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM later, range(0, 20) AS t(o)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT docs.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM docs),
token AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i
  FROM token a JOIN token b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
link AS (SELECT x, y FROM pair WHERE 100 * i >= 90 * (nx + ny - i)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT reach.x, way.y FROM reach JOIN way ON reach.y = way.x)
SELECT sets.doc_id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id
FROM sets JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = sets.doc_id
"""

OP3 = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM documents"

OP4 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
flat AS (SELECT vec_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v),
norm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM flat GROUP BY vec_id HAVING count(x) = count(*) AND bool_and(isfinite(x)) AND sum(x * x) > 0),
pair AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x) AS dot
         FROM flat q JOIN flat c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
scored AS (SELECT query_id, pair.vec_id AS vec_id, dot / (a.n * b.n) AS score
           FROM pair JOIN norm a ON a.vec_id = query_id JOIN norm b ON b.vec_id = pair.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 5
"""

OP5 = rf"""
WITH docs AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(concat_ws(' ', CAST(doc_id AS VARCHAR), text)) AS place, row_number() OVER () AS n FROM documents),
named AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM docs GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][i % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS most FROM named),
filled AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_ones,
                  sum(weight) OVER (ORDER BY most / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed),
tried AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM named) - full_ones) / open_weight AS l FROM filled),
level AS (SELECT (SELECT l FROM tried WHERE l <= most / weight ORDER BY most / weight, i LIMIT 1) AS l),
target AS (SELECT i, source, source_size, CASE WHEN l IS NULL THEN most ELSE least(most, l * weight) END AS target FROM weighed, level),
goal AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal, CAST(ceil(floor(target) / 1024) AS BIGINT) AS quota FROM target WHERE floor(target) > 0),
cut AS (SELECT *, coalesce(sum(quota) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(quota) OVER () AS n FROM goal),
point AS (SELECT id, ((id + 1) * CAST(0.6180339887498949 AS DOUBLE) - floor((id + 1) * CAST(0.6180339887498949 AS DOUBLE))) * n AS y
          FROM (SELECT unnest(range(0, CAST(m AS BIGINT))) AS id, CAST(m AS DOUBLE) AS n FROM (SELECT max(n) AS m FROM cut))),
hit AS (SELECT id, i, goal, quota, row_number() OVER (PARTITION BY i ORDER BY id) - 1 AS rank FROM point JOIN cut ON y >= low AND y < low + quota),
had AS (SELECT i, count(*) AS c FROM hit WHERE rank < quota GROUP BY i),
missed AS (SELECT i, goal, quota, n, m, coalesce(sum(m) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM (SELECT cut.i AS i, goal, quota, n, quota - coalesce(c, 0) AS m FROM cut LEFT JOIN had ON had.i = cut.i)),
late AS (SELECT n + before + k AS id, i, goal, quota - m + k AS rank FROM (SELECT *, unnest(range(0, CAST(m AS BIGINT))) AS k FROM missed)),
slot AS (SELECT id, i, rank, least(1024, goal - rank * 1024) AS words FROM (SELECT id, i, goal, rank FROM hit WHERE rank < quota UNION ALL SELECT id, i, goal, rank FROM late)),
placed AS (SELECT docs.n AS n, t.i AS i, size, coalesce(sum(size) OVER (PARTITION BY t.i ORDER BY place, docs.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stands, t.source_size AS source_size, target
           FROM docs JOIN target t ON docs.source IS NOT DISTINCT FROM t.source WHERE size > 0),
passed AS (SELECT n, i, size, stands + k * source_size AS low FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(target / source_size) AS BIGINT)))) AS k FROM placed)),
piece AS (SELECT *, unnest(range(CAST(floor(low / 1024) AS BIGINT), CAST(floor((low + size - 1) / 1024) AS BIGINT) + 1)) AS rank FROM passed),
got AS (SELECT n, sum(least(low + size, p.rank * 1024 + words) - greatest(low, p.rank * 1024)) AS taken, min(id) AS first_slot
        FROM piece p JOIN slot s ON s.i = p.i AND s.rank = p.rank WHERE least(low + size, p.rank * 1024 + words) > greatest(low, p.rank * 1024) GROUP BY n)
SELECT doc_id, size, CAST(t.source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot
FROM docs JOIN target t ON docs.source IS NOT DISTINCT FROM t.source LEFT JOIN got ON got.n = docs.n
"""

#: The exact windows and similarities; SimHash can lose one in ten thousand at the very threshold.
OP8 = r"""
WITH item AS (SELECT row_number() OVER () AS item, item_id, w, len(w) AS n, least(len(w), 5) AS k
              FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\x0B\f\r]+') AS w FROM benchmark) WHERE len(w) > 0),
own AS (SELECT DISTINCT item, item_id, n - k + 1 AS length, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
        FROM (SELECT *, unnest(range(1, n - k + 2)) AS s FROM item)),
weight AS (SELECT k, g, CAST(round(100 * ln(1 + CAST((SELECT count(*) FROM item) AS DOUBLE) / count(*))) AS BIGINT) AS weight FROM own GROUP BY k, g),
total AS (SELECT item, sum(weight) AS total FROM own JOIN weight USING (k, g) GROUP BY item),
doc AS (SELECT row_number() OVER () AS d, doc_id, w FROM (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\x0B\f\r]+') AS w FROM documents)),
place AS (SELECT d, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
          FROM (SELECT d, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, (SELECT DISTINCT k FROM item) WHERE len(w) >= k)),
mark AS (SELECT d, k, s, g, weight FROM place JOIN weight USING (k, g)),
win AS (SELECT DISTINCT d, k, s, length FROM mark JOIN (SELECT DISTINCT k, g, length FROM own) USING (k, g)),
held AS (SELECT DISTINCT win.d AS d, win.k AS k, win.s AS s, length, g, weight FROM win JOIN mark ON mark.d = win.d AND mark.k = win.k AND mark.s BETWEEN win.s AND win.s + length - 1),
hit AS (SELECT d, held.s AS s, item, item_id, sum(weight) AS shared FROM held JOIN own USING (k, length, g) GROUP BY ALL),
good AS (SELECT doc_id, item_id, s, shared / CAST(total AS DOUBLE) AS similarity FROM hit JOIN total USING (item) JOIN doc USING (d) WHERE shared / CAST(total AS DOUBLE) >= 0.8)
SELECT doc_id, item_id, CAST(s - 1 AS INTEGER) AS start, similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM good) WHERE r = 1
"""

OP11 = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
mark AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
least AS (SELECT md5(text) AS h, min(doc_id) AS first FROM docs GROUP BY h),
fails AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS c,
          regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < docs.doc_id, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
          FROM docs JOIN least ON h = md5(text) LEFT JOIN mark ON mark.doc_id = docs.doc_id),
cell AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letter AS (SELECT unnest(range(5)) AS i),
perm AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM letter p, letter q, letter r, letter s, letter t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
step AS (SELECT array_to_string([substr('ABCDE', CAST(x + 1 AS INT), 1) for x in o], '') AS filter_order, CAST(k AS INTEGER) AS step, CAST(1 << o[k] AS INT) AS bit,
         CAST(list_sum([1 << x for x in list_slice(o, 1, k - 1)]) AS INT) AS before FROM perm, (SELECT unnest(range(1, 6)) AS k)),
each AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (bit | coalesce(before, 0)) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS removed,
         sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS toxic_lost
         FROM cell, step GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM each
"""

ORACLES: dict[str, str] = {"op2_ngram_join": OP2, "op3_sharding": OP3, "op4_stable_projection": OP4, "op5_source_mixing": OP5, "op6_substring_dedup": OP6, "op8_decontamination": OP8, "op11_filter_audit": OP11}
