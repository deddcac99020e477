"""DuckDB SQL for those queries that SQL can express on whole tables."""

_MIXING = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
counts AS (SELECT key, count(*) AS n_rows FROM docs GROUP BY key),
shares AS (SELECT key, n_rows, pow(n_rows::DOUBLE, 0.5) / sum(pow(n_rows::DOUBLE, 0.5)) OVER () AS w FROM counts),
tried AS (SELECT 1000 * m AS len, max(abs(w * 1000 * m - round(w * 1000 * m))) AS off, round(min(w) * 1000 * m, 6) >= 1 AS full_
          FROM shares, range(1, 17) AS t(m) GROUP BY m),
span AS (SELECT greatest(coalesce((SELECT min(len) FROM tried WHERE off < 1e-6 AND full_), (SELECT min(len) FROM tried WHERE full_), 16000),
                         (SELECT 2 * count(*) FROM shares))::BIGINT AS len),
marked AS (SELECT *, round(min(w) OVER () * len, 6) < 1 AND round(w * len, 6) < 2 AS small FROM shares, span),
exacts AS (
  SELECT *, CASE WHEN small THEN 1.0::DOUBLE ELSE round(w / sum(w) FILTER (WHERE NOT small) OVER () * (len - count(*) FILTER (WHERE small) OVER ()), 6) END AS exact
  FROM marked),
units AS (
  SELECT key, n_rows, len, (floor(exact) + CASE WHEN row_number() OVER (ORDER BY small, floor(exact) - exact, key)
           <= len - sum(floor(exact)) OVER () THEN 1 ELSE 0 END)::BIGINT AS n FROM exacts),
lists AS (SELECT list(n ORDER BY key) AS ns, list(key ORDER BY key) AS keys FROM units),
edf(t, len, ns, done, pick) AS (
  SELECT 0::BIGINT, len, ns, list_transform(ns, lambda x: 0::BIGINT), NULL::BIGINT FROM lists, span
  UNION ALL
  SELECT t + 1, len, ns, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), p FROM (
    SELECT t, len, ns, done, list_min(list_transform(ns, lambda n, i: CASE
        WHEN done[i] < n AND (done[i] * len) // n <= t THEN ((done[i] + 1) * len + n - 1) // n * 10000 + i ELSE 999999999 END)) % 10000 AS p
    FROM edf WHERE t < len)),
slots AS (
  SELECT keys[pick] AS key, t - 1 AS t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS i FROM edf, lists WHERE pick IS NOT NULL),
ranked AS (
  SELECT doc_id, source, d.key, h % ceil(n_rows / 4096)::BIGINT AS salt, n, len,
         row_number() OVER (PARTITION BY d.key, h % ceil(n_rows / 4096)::BIGINT ORDER BY doc_id NULLS FIRST) - 1 AS nth
  FROM docs d JOIN units USING (key)),
bases AS (
  SELECT key, salt, coalesce(sum(blocks) OVER (PARTITION BY key ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT key, salt, ceil(count(*) / 64)::BIGINT AS blocks FROM ranked GROUP BY key, salt)),
placed AS (SELECT r.*, (base + nth // 64)::BIGINT AS b FROM ranked r JOIN bases USING (key, salt))
SELECT doc_id, source, b AS block_no, (nth % 64)::BIGINT AS block_seq, (b * len // n)::BIGINT AS release_slot,
       (((b + 1) * len + n - 1) // n)::BIGINT AS deadline_slot, ((b // n) * len + t)::BIGINT AS mix_slot
FROM placed p JOIN slots s ON s.key = p.key AND s.i = p.b % p.n
"""

_SUBSTRING = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, p, array_to_string(ws[p : p + 34], ' ') AS k FROM base, range(1, len(ws) - 33) AS t(p)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
starts AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM win JOIN twice USING (k)),
runs AS (SELECT r, p, sum(CASE WHEN gap <= 35 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM starts),
spans AS (SELECT r, run, min(p) AS lo, max(p) + 35 AS hi FROM runs GROUP BY r, run),
cuts AS (SELECT r, lo AS upto, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS since FROM spans
         UNION ALL SELECT b.r, len(ws) + 1, coalesce(max(hi), 1) FROM base b LEFT JOIN spans s ON s.r = b.r GROUP BY b.r, len(ws)),
kept AS (SELECT c.r, string_agg(array_to_string(ws[since : upto - 1], ' '), ' ' ORDER BY since) FILTER (WHERE upto > since) AS txt,
                sum(upto - since) AS n FROM cuts c JOIN base b USING (r) GROUP BY c.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - n)::BIGINT AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM base JOIN kept USING (r)
"""

_SUFFIX = """
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, hex(encode(coalesce(text, ''))) AS h,
         octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT r, d, p, substring(h, 2 * p + 1, 100) AS k FROM base, range(0, n - 49) AS t(p)),
least AS (SELECT k, min(d) AS m FROM win GROUP BY k HAVING min(d) < max(d)),
starts AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM win JOIN least USING (k) WHERE d > m),
runs AS (SELECT r, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM starts),
spans AS (SELECT r, run, min(p) AS lo, max(p) + 50 AS hi FROM runs GROUP BY r, run),
cuts AS (SELECT r, lo AS upto, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM spans
         UNION ALL SELECT b.r, n, coalesce(max(hi), 0) FROM base b LEFT JOIN spans s ON s.r = b.r GROUP BY b.r, n),
kept AS (SELECT c.r, string_agg(substring(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS txt,
                sum(upto - since) AS n_kept, count(*) - 1 AS n_spans FROM cuts c JOIN base b USING (r) GROUP BY c.r)
SELECT doc_id, n::BIGINT AS n_bytes, (n - n_kept)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(coalesce(txt, ''))) AS kept_sha256
FROM base JOIN kept USING (r)
"""

_FOREST = """
WITH RECURSIVE vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT * FROM vecs WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id,
       vec_id <= coalesce(m, vec_id) AS kept
FROM vecs LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""

ORACLES: dict[str, str] = {"op2_substring_dedup": _SUBSTRING, "op6_embedding_forest": _FOREST, "op7_suffix_array_dedup": _SUFFIX, "op9_pfair_mixing": _MIXING}
