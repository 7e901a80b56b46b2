"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

POISSON_MIX = """
WITH RECURSIVE n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS total_n, sum(pow(n, 0.5)) AS total_w FROM n),
rate AS (SELECT source, pow(n, 0.5) / total_w * total_n / n AS rate FROM n, t),
piece AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 8.0) AS INT)) AS pieces FROM rate),
cdf AS (
  SELECT source, pieces, rate / pieces AS mean, 0 AS k, exp(-(rate / pieces)) AS p, exp(-(rate / pieces)) AS c FROM piece
  UNION ALL
  SELECT source, pieces, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 59),
steps AS (SELECT source, pieces, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, pieces),
draws AS (
  SELECT d.doc_id, d.source, d.text,
         list_sum(list_transform(range(1, pieces + 1), lambda i: len(list_filter(cs, lambda c: c <=
           CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i || ':17'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))) AS n
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, unnest(range(0, CAST(n AS BIGINT))) AS replica, text FROM draws
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
m AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT i, j FROM m JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * m >= 80 * (x.n + y.n - m)),
ways AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
r AS (SELECT DISTINCT i, i AS j FROM ways UNION SELECT r.i, b.j FROM r JOIN ways b ON b.i = r.j),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.i = doc_id
"""

SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lc FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c,
         1 + (1000000000 * (coalesce(c, 0) + 2)::HUGEINT) // (n + 2 * v)::HUGEINT AS p,
         1 + (1000000000 * (lc + 2)::HUGEINT) // (ln + 2 * v)::HUGEINT AS q
  FROM n JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM n a JOIN n b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op5_poisson_mix": POISSON_MIX, "op8_minmax_near_duplicates": NEAR_DUPLICATES, "op11_source_divergence": SOURCE_DIVERGENCE}
