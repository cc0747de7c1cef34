WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50),
windows AS (SELECT k, doc_id, s, array_to_string(w[s:s + 49], ' ') AS t FROM starts),
least AS (SELECT t, min(doc_id) AS least FROM windows GROUP BY t),
gone AS (SELECT DISTINCT k, unnest(range(s, s + 50)) AS i FROM windows JOIN least USING (t) WHERE doc_id > least),
words AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE len(w) > 0),
kept AS (SELECT k, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (k)
