WITH bits AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
hashed AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM documents, bits),
docs AS (SELECT k, doc_id, w, h, len(w) AS n, h // 10 AS g FROM hashed),
tails AS (SELECT k, doc_id, n, w, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, g FROM docs),
shaped AS (SELECT k, doc_id, n, w, a, 1 + (n - a) // (3 + g % 8) AS p FROM tails),
given AS (SELECT k, n, a, p, unnest(w) AS word, unnest(range(n)) AS i FROM shaped WHERE n > 0),
words AS (
  SELECT x.k, x.n, x.i, y.word FROM given x
  JOIN given y ON y.k = x.k AND y.i = CASE WHEN x.a IS NOT NULL AND x.i >= x.a THEN x.a + (x.i - x.a) % x.p ELSE x.i END),
same AS (SELECT x.k, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 2 <= x.n),
islands AS (SELECT k, p, min(i) AS start, count(*) + p AS length FROM (SELECT k, p, i, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS g FROM same) GROUP BY k, p, g),
runs AS (SELECT k, start, length, min(p) AS period FROM islands WHERE length >= 2 * p AND length >= 12 GROUP BY k, start, length),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (k, i) GROUP BY k),
best AS (
  SELECT k, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS r,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, r.start::BIGINT AS start, r.length::BIGINT AS length, r.period::BIGINT AS period,
       (1000 * r.length // r.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
