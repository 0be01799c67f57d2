"""The detection of cut texts in DuckDB SQL, stated on its own: lines by window functions, rates by joins, numbers written out."""

SQL = r"""
WITH body AS (
  SELECT call_id, source, regexp_replace(regexp_replace(content, '\p{Cf}+', '', 'g'), '\s+$', '') AS text FROM llm_ocr
  WHERE content IS NOT NULL AND NOT regexp_matches(content, '^\s*(\[[^\]\n]*\]\s*)*$')
), lined AS (
  SELECT call_id, source, ends_with(text, '�') AS broken_end,
         regexp_replace(regexp_replace(lower(rtrim(text, '�')), '[ \t\r]*\n\s*?\n\s*', '¶¶', 'g'), '[ \t\r]*\n[ \t]*', '¶', 'g') AS text FROM body
), tok AS (
  SELECT call_id, source, broken_end, regexp_extract_all(regexp_replace(text, '[\p{Nd}一二三四五六七八九十百千]+', '0', 'g'), '[\p{L}\p{M}]+|0|¶|\.{4,}|\.{2,3}|…+|[^\s\p{L}\p{M}0]') AS w0 FROM lined
), marks AS (
  SELECT m AS mark FROM (SELECT unnest(w0[:-2]) AS m, 0 AS e FROM tok UNION ALL SELECT w0[-1], 1 FROM tok) WHERE m IN ('..', '...', '…', '……') GROUP BY m HAVING sum(e) >= 0.9 * count(*)
), calls AS (
  SELECT call_id, source, broken_end, mark IS NOT NULL AS marked, CASE WHEN mark IS NULL THEN w0 ELSE w0[:-2] END AS body, list_concat(['^', '^'], CASE WHEN mark IS NULL THEN w0 ELSE w0[:-2] END) AS w
  FROM tok LEFT JOIN marks ON mark = w0[-1]
), trigrams AS (
  SELECT hash(w) AS h, unnest(list_transform(range(1, len(w) - 1), lambda i: {'a': w[i], 'b': w[i + 1], 'c': w[i + 2], 'e': i = len(w) - 2})) AS x FROM calls WHERE len(w) > 2
), counts AS (
  SELECT *, CASE WHEN regexp_matches(a, '^\p{L}') THEN 'w' ELSE a END AS ca, CASE WHEN regexp_matches(b, '^\p{L}') THEN 'w' ELSE b END AS cb, CASE WHEN regexp_matches(c, '^\p{L}') THEN 'w' ELSE c END AS cc
  FROM (SELECT x.a AS a, x.b AS b, x.c AS c, count(*) FILTER (NOT x.e) AS inside, count(DISTINCT h) FILTER (x.e) AS ended FROM trigrams GROUP BY ALL)
), lasts AS (SELECT cc, sum(inside) AS inside, sum(ended) AS ended FROM counts GROUP BY cc
), classes AS (SELECT ca, cb, cc, sum(inside) AS inside, sum(ended) AS ended FROM counts GROUP BY ca, cb, cc
), class_rates AS (
  SELECT ca, cb, cc, CASE WHEN l.inside < 20 THEN 1.0 ELSE (k.ended - 1 + 100 * (l.ended - 1) / greatest(1, l.inside + l.ended - 1)) / (k.inside + k.ended - 1 + 100) END AS rate FROM classes k JOIN lasts l USING (cc) WHERE k.ended > 0
), scored AS (
  SELECT a, b, c, CASE WHEN inside >= 20 THEN (ended - 1 + 100 * rate) / (inside + ended - 1 + 100) ELSE (100 * rate) / 100 END AS terminal_rate FROM counts JOIN class_rates USING (ca, cb, cc) WHERE ended > 0
), lines AS (
  SELECT call_id, trim(unnest(string_split(array_to_string(body, ' '), '¶'))) AS line, unnest(range(len(string_split(array_to_string(body, ' '), '¶')))) AS i FROM calls
), around AS (
  SELECT call_id, line, i, lead(i) OVER w IS NULL AS is_last, lag(line) OVER w = '' AS after_gap, lead(line) OVER w = '' AS before_gap FROM lines WINDOW w AS (PARTITION BY call_id ORDER BY i)
), shaped AS (
  SELECT *, list_transform(string_split(line, ' ')[1:3], lambda x: CASE WHEN regexp_matches(line, '^[^\p{L}0]') AND regexp_matches(x, '^\p{L}') THEN 'w' ELSE x END) AS opening, len(string_split(line, ' ')) <= 4 AS few, regexp_matches(line, '^[^\p{L}0]') AS odd FROM around WHERE line <> ''
), whole AS (SELECT line FROM shaped WHERE NOT is_last AND few GROUP BY line HAVING count(*) >= 3
), openings AS (
  SELECT opening FROM shaped WHERE NOT is_last AND ((i = 0 OR after_gap) AND before_gap OR odd) GROUP BY opening
  HAVING count(*) >= 5 AND count(*) FILTER (WHERE NOT regexp_matches(line, '[.。!?！？…;；:：]( ["”»’」』)）\]])*$')) >= 0.9 * count(*)
), closings AS (
  SELECT DISTINCT call_id FROM shaped WHERE is_last AND (few AND line IN (FROM whole) OR opening IN (FROM openings))
)
SELECT c.call_id, c.source, s.terminal_rate, coalesce(s.terminal_rate < 0.01, false) AND NOT c.marked AND g.call_id IS NOT NULL AS closing,
  c.broken_end OR coalesce(s.terminal_rate < 0.01 AND (c.marked OR g.call_id IS NULL), false) AS is_cut
FROM calls c LEFT JOIN scored s ON s.a = c.w[-3] AND s.b = c.w[-2] AND s.c = c.w[-1] LEFT JOIN closings g USING (call_id)
"""
