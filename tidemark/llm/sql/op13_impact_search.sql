WITH found AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
docs AS (SELECT k, doc_id, t, len(t)::BIGINT AS n FROM found WHERE len(t) > 0),
corpus AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
tf AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(t) AS term FROM docs) GROUP BY k, term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), corpus),
lengths AS (SELECT k, doc_id, 10 + (90 * n * nn) // ll AS m FROM docs, corpus),
scores AS (
  SELECT item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (k) GROUP BY item_id, k),
placed AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN lengths USING (k) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 10
