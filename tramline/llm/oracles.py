"""DuckDB SQL for the operators that SQL can express, written from the contract alone."""

QUALITY = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM base WHERE len(w) >= 3)),
twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT base.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM base LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, (n_words < 50)::BIGINT AS f0, (100 * n_repeat_words > 50 * n_words)::BIGINT AS f1,
         (100 * n_symbols > 30 * n_words)::BIGINT AS f2, (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT AS f3,
         (word_chars < 2 * n_words)::BIGINT AS f4, (word_chars > 15 * n_words)::BIGINT AS f5,
         (100 * n_upper > 40 * word_chars)::BIGINT AS f6
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f5 + 64 * f6 AS failed,
       f0 + f1 > 0 AS base_failed, f0 + f1 + f2 + f3 + f4 + f5 + f6 = 0 AS kept, f0 + f1 = 0 AS kept_base, f0 + f1 + f2 + f3 + f4 + f5 + f6 = 0 AS kept_2,
       CASE WHEN f0 + f1 + f2 + f3 + f4 + f5 + f6 = 1 THEN CASE WHEN f0 = 1 THEN 'few_words' WHEN f1 = 1 THEN 'repeated_words' WHEN f2 = 1 THEN 'symbols' WHEN f3 = 1 THEN 'duplicate_lines'
         WHEN f4 = 1 THEN 'short_words' WHEN f5 = 1 THEN 'long_words' ELSE 'shouting' END END AS only_failure
FROM f
"""

SQL = {"op10_quality_rules": QUALITY}

WARC = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target, coalesce(html, '') AS body,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' ||
         octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) AS headers, chr(13) || chr(10) AS nl,
         sha256('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '') || '|' || sha256(coalesce(html, ''))) AS h
  FROM pages),
i AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] || '>' AS refers_to FROM r),
t AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
      '(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g'),
      '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|aside|main|title|head|body|html)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS plain FROM i),
d AS (
  SELECT page_id, target, refers_to, nl, 'conversion' AS type, 'text/plain; charset=utf-8' AS content_type,
         regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(plain, '&lt;', '<'), '&gt;', '>'),
         '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
         ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS block FROM t
  UNION ALL
  SELECT page_id, target, refers_to, nl, 'metadata', 'application/warc-fields',
         'source-record: ' || refers_to || nl || 'source-block-digest: sha256:' || sha256(headers || nl || body) || nl ||
         'source-payload-digest: sha256:' || sha256(body) || nl || 'source-payload-length: ' || octet_length(encode(body)) || nl ||
         'source-http: HTTP/1.1 200 OK' || nl || 'source-http: Content-Type: text/html; charset=utf-8' || nl ||
         'source-http: Content-Length: ' || octet_length(encode(body)) || nl FROM i),
k AS (
  SELECT *, sha256(type || '|' || refers_to) AS g, 'sha256:' || sha256(block) AS block_digest, octet_length(encode(block))::BIGINT AS content_length FROM d),
e AS (
  SELECT *, '<urn:uuid:' || g[1:8] || '-' || g[9:12] || '-5' || g[14:16] || '-a' || g[18:20] || '-' || g[21:32] || '>' AS record_id FROM k),
w AS (
  SELECT *, 'WARC/1.1' || nl || 'WARC-Type: ' || type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Date: 2024-01-01T00:00:00Z' ||
         CASE WHEN target <> '' THEN nl || 'WARC-Target-URI: ' || target ELSE '' END || nl || 'WARC-Refers-To: ' || refers_to || nl ||
         'WARC-Block-Digest: ' || block_digest || nl || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || content_length || nl || nl ||
         block || nl || nl AS record FROM e)
SELECT page_id, type, record_id, refers_to, target AS target_uri, content_type, content_length, block_digest,
       octet_length(encode(record))::BIGINT AS record_length, sha256(record) AS record_sha256
FROM w
"""

SQL["op6_warc"] = WARC

LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(generate_series(1, len(x))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (
  SELECT doc_id, i, line, coalesce(holder <> doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

SQL["op12_line_dedup"] = LINES

PHRASES = r"""
WITH p AS (
  SELECT lang, d, unnest(generate_series(1, len(x))) AS j, unnest(x) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
alone AS (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.a >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (
  SELECT lang, phrase, a, j, array_to_string(x[1:j], ' ') AS one, array_to_string(x[j + 1:], ' ') AS two
  FROM (SELECT lang, phrase, a, string_split(phrase, ' ') AS x, unnest(generate_series(1, k - 1)) AS j FROM alone)),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, n, j, 1000 * cut.a * n // (l.a * r.a) AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = one JOIN f AS r ON r.lang = cut.lang AND r.phrase = two JOIN n ON n.lang = cut.lang
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM s QUALIFY rank <= 2000
"""

SQL["op11_phrase_collocations"] = PHRASES
