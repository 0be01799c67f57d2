"""The same queries in DuckDB SQL, stated independently of the Spark plans.

The SQL dialect has no look-around, so rules on neighbours capture them and run twice where matches may overlap.
"""

from __future__ import annotations

from quirefold.functions.patterns import BATCH_MARKER, BATCH_SPLIT, BLANK, FULL_WIDTH, GROUNDING, HAN, INLINE_WS, MASK, OTHER_DIGITS, PAGE_HEADER, PAGE_MARKER, WIDE, WS


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'^{WS}+|{WS}+$')}, '', 'g')"


def grounding(x: str) -> str:
    return f"regexp_replace({x}, {q(GROUNDING.replace('(?md)', '(?m)'))}, '', 'g')"


def page_markers(x: str) -> str:
    return f"regexp_replace({x}, {q(PAGE_MARKER)}, chr(10) || chr(10), 'g')"


def batch_markers(x: str) -> str:
    return f"regexp_replace({x}, {q(BATCH_MARKER.replace('(?md)', '(?m)'))}, '', 'g')"


def empty_lines(x: str) -> str:
    return f"CASE WHEN contains({x}, chr(13) || chr(10)) THEN regexp_replace({x}, '(\\r\\n){{2,}}', chr(13) || chr(10), 'g') ELSE regexp_replace({x}, '\\n{{2,}}', chr(10), 'g') END"


def line_ends(x: str) -> str:
    crlf = f"array_to_string(list_transform(string_split({x}, chr(13) || chr(10)), lambda l: regexp_replace(l, {q(WS + '+$')}, '')), chr(13) || chr(10))"
    lf = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, {q(WS + '+$')}, '')), chr(10))"
    return f"CASE WHEN contains({x}, chr(13) || chr(10)) THEN {crlf} ELSE {lf} END"


def spaces(x: str) -> str:
    out = f"trim({x}, ' ')"
    out = f"regexp_replace({out}, {q(f'([{WIDE}]) +')}, '\\1', 'g')"
    out = f"regexp_replace({out}, {q(f' +([{WIDE}])')}, '\\1', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '([0-9]) +([0-9])', '\\1\\2', 'g')"
    return out


def single(x: str) -> str:
    quote = "''"
    out = x
    for _ in range(2):
        out = f"regexp_replace({out}, '([A-Za-z]){quote}([A-Za-z])', '\\1{MASK}\\2', 'g')"
    out = f"regexp_replace({out}, {q('([A-Za-z])' + chr(39) + '(' + INLINE_WS + ')')}, '\\1{MASK}\\2', 'g')"
    out = f"regexp_replace({out}, '{quote}([^{quote}\\n]*){quote}', '‘\\1’', 'g')"
    return f"replace(replace({out}, '{quote}', '‘'), '{MASK}', '{quote}')"


def double(x: str) -> str:
    return f"""replace(regexp_replace({x}, '"([^"\\n]*)"', '“\\1”', 'g'), '"', '“')"""


def basic(x: str) -> str:
    out = x
    for mark, wide in FULL_WIDTH.items():
        before = f"[^A-Za-z\\p{{Nd}}{OTHER_DIGITS}]" if mark == "." else "[^A-Za-z]"
        for _ in range(2):
            out = f"regexp_replace({out}, {q(f'(^|{before})' + chr(92) + mark)}, '\\1{wide}', 'g')"
    return out


def paragraphs(source: str, key: str, text: str) -> str:
    """CTEs ``pl`` .. ``pm``: (key, merged) by running windows over the lines."""
    end = "[。！？；….!?;”’\"》\\])]$"
    return f"""
pl AS (SELECT {key}, CASE WHEN len(ls) > 1 AND ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls
       FROM (SELECT {key}, regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM {source} WHERE {text} IS NOT NULL)),
pu AS (SELECT {key}, unnest(list_transform(ls, lambda x: {strip('x')})) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM pl),
pk AS (SELECT {key}, line, i, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k, CAST(regexp_matches(line, {q(end)}) AS INT) AS e FROM pu WHERE line <> '' OR i = n - 1),
ps AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, lag(line) OVER (PARTITION BY {key} ORDER BY i) AS before FROM pk),
pc AS (SELECT *, coalesce(max(CASE WHEN length(line) > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carry FROM ps),
pm AS (SELECT {key}, regexp_replace(string_agg(CASE WHEN k = 1 THEN '' WHEN carry = 0 THEN chr(10)
         WHEN line = '' OR regexp_matches(before, {q(f'[{HAN}]$')}) OR regexp_matches(line, {q(f'^[{HAN}]')}) THEN '' ELSE ' ' END || line, '' ORDER BY i), ' {{2,}}', ' ', 'g') AS merged
       FROM pc GROUP BY {key})"""


def overlaps(x: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({x}, {q(BATCH_SPLIT)}), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"""(SELECT array_to_string(list_transform(a, lambda p, i: CASE WHEN i < len(a) AND instr(p, substring(a[i + 1], 1, 30)) > 0
        THEN substring(p, 1, instr(p, substring(a[i + 1], 1, 30)) - 1) ELSE p END), chr(10) || chr(10)) FROM (SELECT {parts} AS a))"""


def _calls(expression) -> str:
    return f"SELECT call_id, {expression('content')} AS text_out FROM llm_ocr"


def _docs(expression) -> str:
    return f"SELECT doc_id, {expression('text')} AS text_out FROM documents"


def _refine(table: str, key: str, text: str) -> str:
    return f"""WITH a AS (SELECT {key}, {grounding(text)} AS t FROM {table}),
b AS (SELECT {key}, {overlaps('t')} AS t FROM a), c AS (SELECT {key}, {batch_markers('t')} AS t FROM b), d AS (SELECT {key}, {page_markers('t')} AS t FROM c),
e AS (SELECT {key}, {empty_lines('t')} AS t FROM d), f AS (SELECT {key}, {line_ends('t')} AS t FROM e),
{paragraphs('f', key, 't')},
g AS (SELECT f.{key}, CASE WHEN f.t IS NULL THEN NULL ELSE coalesce(pm.merged, '') END AS t FROM f LEFT JOIN pm USING ({key})),
h AS (SELECT {key}, {double(single('t'))} AS t FROM g), j AS (SELECT {key}, {basic('t')} AS t FROM h)
SELECT {key}, {spaces('t')} AS text_out FROM j"""


_LATEST = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, batch_no ORDER BY call_id DESC) AS rn FROM llm_ocr) WHERE rn = 1)"
_TRIMMED = f"""{_LATEST}, s AS (SELECT job_id, batch_no, {strip('content')} AS x FROM d WHERE content IS NOT NULL),
l AS (SELECT job_id, batch_no, x, substring(lead(x) OVER (PARTITION BY job_id ORDER BY batch_no), 1, 30) AS nx FROM s WHERE x <> ''),
t AS (SELECT job_id, batch_no, CASE WHEN nx IS NOT NULL AND instr(x, nx) > 0 THEN substring(x, 1, instr(x, nx) - 1) ELSE x END AS trimmed FROM l)"""
_LABELS = "('number','footer','header','header_image','footer_image','footnote','aside_text','image')"
_BLOCKS = f"""bb AS (SELECT * FROM (SELECT job_id, page_index, block_id, block_label, {strip("regexp_replace(" + strip('block_content') + ", '<[^>]+>', '', 'g')")} AS content,
  block_bbox[2] AS y1, block_bbox[4] AS y2 FROM parsing_res_list
  WHERE coalesce(block_label, 'text') NOT IN {_LABELS} AND len(block_bbox) >= 4) WHERE content <> '' AND y1 IS NOT NULL AND y2 IS NOT NULL)"""


def _pairs(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1) + 1), lambda i: substring({x}, i, 2)))"


def _alike(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE (1 + 2 * len(list_intersect({_pairs(a)}, {_pairs(b)})) / (len({_pairs(a)}) + len({_pairs(b)}))) / 2 END"


# places of block ends in refined texts: grams of six characters give diagonals, all diagonals with two grams are scored
_BREAKS = f"""{_BLOCKS}, tb AS (SELECT * FROM bb WHERE coalesce(block_label, 'text') = 'text'),
jt AS (SELECT job_id, string_agg(content, ' ' ORDER BY page_index, y1, block_id) AS t FROM tb GROUP BY job_id),
r1 AS (SELECT job_id, {page_markers(batch_markers(grounding('t')))} AS t FROM jt), r2 AS (SELECT job_id, {empty_lines('t')} AS t FROM r1), r3 AS (SELECT job_id, {line_ends('t')} AS t FROM r2),
{paragraphs('r3', 'job_id', 't')},
r4 AS (SELECT job_id, {double(single('merged'))} AS t FROM pm), r5 AS (SELECT job_id, {basic('t')} AS t FROM r4), proof AS (SELECT job_id, {spaces('t')} AS refined FROM r5),
an AS (SELECT job_id, block_id, right(content, 80) AS tail, left(lead(content) OVER (PARTITION BY job_id, page_index ORDER BY y1, block_id), 80) AS head FROM tb),
ak AS (SELECT * FROM an WHERE head IS NOT NULL),
tc AS (SELECT job_id, string_split(refined, '') AS cs FROM proof WHERE refined <> ''),
tg AS (SELECT job_id, unnest(list_transform(range(1, len(cs) + 1), lambda i: {{'p': i, 'g': array_to_string(cs[i:i + 5], '')}})) AS x FROM tc),
ag AS (SELECT job_id, block_id, unnest(list_transform(range(1, length(tail) - 4, greatest(1, length(tail) // 24)), lambda i: {{'o': i, 'g': substring(tail, i, 6)}})) AS x,
  len(range(1, length(tail) - 4, greatest(1, length(tail) // 24))) AS n FROM ak WHERE length(tail) >= 6),
vo AS (SELECT ag.job_id, block_id, greatest(tg.x.p - ag.x.o, 0) AS start FROM ag JOIN tg ON ag.job_id = tg.job_id AND ag.x.g = tg.x.g GROUP BY ag.job_id, block_id, greatest(tg.x.p - ag.x.o, 0), n HAVING count(*) >= least(2, n)
  UNION ALL SELECT k.job_id, block_id, unnest(list_filter(range(0, length(refined)), lambda i: substring(refined, i + 1, length(tail)) = tail)) FROM ak k JOIN proof USING (job_id) WHERE length(tail) < 6),
sc AS (SELECT job_id, block_id, start + length(tail) AS e, {_alike('tail', 'substring(refined, start + 1, length(tail))')} AS score, head, substring(refined, start + length(tail) + 1, 400) AS rest
  FROM vo JOIN ak USING (job_id, block_id) JOIN proof USING (job_id)),
hd AS (SELECT *, {strip('rest')[:-len(", '', 'g')")].replace("|" + WS + "+$", "")}, '') AS follows FROM sc WHERE score >= 0.75),
ft AS (SELECT job_id, block_id, e, score, {_alike('head', 'left(follows, length(head))')} AS fit FROM hd WHERE follows <> '' AND instr(rest, left(head, 20)) <= 201),
bp AS (SELECT job_id, block_id, arg_max(e, (fit, score, -e)) AS place FROM ft WHERE fit >= 0.85 GROUP BY job_id, block_id),
br AS (SELECT k.job_id, k.block_id, CAST(coalesce(place, -1) AS INT) AS place FROM ak k LEFT JOIN bp USING (job_id, block_id))"""

ORACLE = {
    "break_places": f"WITH {_BREAKS} SELECT job_id, block_id, place FROM br",
    "aligned_breaks": f"""WITH {_BREAKS}, li AS (SELECT job_id, list_sort(list_distinct(list(place) FILTER (WHERE place >= 0))) AS ps FROM br GROUP BY job_id)
SELECT job_id, CAST(coalesce(len(ps), 0) AS INT) AS inserted, array_to_string(list_transform(list_concat([0], coalesce(ps, [])), lambda p, i: substring(refined, p + 1, coalesce(ps[i], length(refined)) - p)), chr(10)) AS text_out
FROM li JOIN proof USING (job_id)""",
    "refine": _refine("documents", "doc_id", "text"),
    "refine_calls": _refine("llm_ocr", "call_id", "content"),
    "refine_skipping": f"""WITH a AS (SELECT doc_id, {grounding('text')} AS t FROM documents), b AS (SELECT doc_id, {overlaps('t')} AS t FROM a),
c AS (SELECT doc_id, {page_markers(batch_markers('t'))} AS t FROM b), d AS (SELECT doc_id, {empty_lines('t')} AS t FROM c), e AS (SELECT doc_id, {line_ends('t')} AS t FROM d)
SELECT doc_id, {spaces('t')} AS text_out FROM e""",
    "remove_grounding": _calls(grounding),
    "remove_page_markers": _calls(page_markers),
    "remove_batch_markers": _docs(batch_markers),
    "merge_empty_lines": _calls(empty_lines),
    "strip_line_ends": _calls(line_ends),
    "remove_interspersed_spaces": _calls(spaces),
    "single_quotes": _docs(single),
    "double_quotes": _docs(double),
    "basic_punctuation": _docs(basic),
    "full_width_punctuation": _calls(lambda x: basic(double(single(x)))),
    "merge_paragraphs": f"WITH {paragraphs('llm_ocr', 'call_id', 'content')} SELECT call_id, CASE WHEN content IS NULL THEN NULL ELSE coalesce(merged, '') END AS text_out FROM llm_ocr LEFT JOIN pm USING (call_id)",
    "remove_overlaps": _docs(overlaps),
    "strip_tags": _calls(lambda x: strip(f"regexp_replace({strip(x)}, '<[^>]+>', '', 'g')")),
    "dedup_batches": f"WITH {_TRIMMED} SELECT job_id, batch_no, trimmed FROM t",
    "full_texts": f"WITH {_TRIMMED} SELECT job_id, string_agg(trimmed, chr(10) || chr(10) ORDER BY batch_no) AS full_text FROM t GROUP BY job_id",
    "raw_texts": f"""WITH {_LATEST} SELECT job_id, string_agg(chr(10) || repeat('=', 60) || chr(10) || '批次 ' || batch_no || ' (共 ' || batch_total || ' 批)' || chr(10) || repeat('=', 60) || chr(10) || chr(10)
  || coalesce(content, '') || chr(10) || chr(10), '' ORDER BY batch_no) AS raw_text FROM d GROUP BY job_id""",
    "batch_failures": """SELECT call_id, coalesce(content, chr(10) || chr(10) || '[第' || coalesce(TRY_CAST(regexp_extract(batch_info, '第([0-9]+)-', 1) AS INT), batch_no) || '-'
  || coalesce(TRY_CAST(regexp_extract(batch_info, '-([0-9]+)页', 1) AS INT), batch_no) || '页识别失败]' || chr(10) || chr(10)) AS text_out FROM llm_ocr""",
    "batch_plan": """WITH p AS (SELECT DISTINCT job_id, page_index FROM parsing_res_list), n AS (SELECT job_id, CAST(count(*) AS INT) AS total FROM p GROUP BY job_id),
b AS (SELECT job_id, CAST(floor(page_index / 5) AS INT) AS batch, min(page_index) AS first, max(page_index) AS last, count(*) AS pages FROM p GROUP BY 1, 2)
SELECT job_id, batch, first, last, pages, total, '第' || (first + 1) || '-' || (last + 1) || '页 (共' || total || '页)' AS label FROM b JOIN n USING (job_id)""",
    "raw_pages": f"""WITH w AS (SELECT call_id, regexp_replace(content, '(?m)^={{10,}}[ \\t]*$', repeat('=', 60), 'g') AS t FROM llm_ocr WHERE content IS NOT NULL),
x AS (SELECT call_id, regexp_split_to_array(t, {q(PAGE_HEADER)})[2:] AS bodies, regexp_extract_all(t, {q(PAGE_HEADER)}, 1) AS nums FROM w)
SELECT call_id, page_ix, TRY_CAST(translate(num, '０１２３４５６７８９', '0123456789') AS INT) AS num, regexp_replace(body, '\\n+$', '') AS content FROM (
  SELECT call_id, unnest(bodies) AS body, unnest(nums) AS num, CAST(unnest(range(len(nums))) AS INT) AS page_ix FROM x)""",
    "page_anchors": f"""WITH c AS (SELECT call_id, array_to_string(list_filter(string_split(content, chr(10)), lambda l: {strip('l')} NOT IN ('风眼','风眠','风眸','风语','风起','风云','风铃','风语者')), chr(10)) AS t FROM llm_ocr)
SELECT call_id, left({strip('t')}, 30) AS head, right({strip('t')}, 30) AS tail, CAST(length(replace(t, chr(10), '')) AS INT) AS flat_chars FROM c""",
    "flat_positions": """WITH p AS (SELECT doc_id, text, unnest(list_filter(range(length(text)), lambda i: substring(text, i + 1, 1) = chr(10))) AS position FROM documents)
SELECT doc_id, CAST(position AS INT) AS position, CAST(length(replace(left(text, position), chr(10), '')) AS INT) AS flat_position FROM p""",
    "layout_blocks": f"WITH {_BLOCKS} SELECT block_id, content, y1, y2 FROM bb",
    "layout_gaps": f"""WITH {_BLOCKS}, g AS (SELECT *, lead(y1) OVER w - y2 AS gap, lead(content) OVER w AS nc FROM bb WINDOW w AS (PARTITION BY job_id, page_index ORDER BY y1, block_id)),
u AS (SELECT *, coalesce(nullif(median(gap) OVER p, 0), nullif(avg(gap) OVER p, 0), 10.0) AS usual FROM g WINDOW p AS (PARTITION BY job_id, page_index))
SELECT job_id, page_index, block_id, gap, usual, right(content, 80) AS prev_tail, left(nc, 80) AS next_head FROM u WHERE gap > usual * 1.5""",
    "exact_breaks": f"""WITH {_BLOCKS}, tb AS (SELECT * FROM bb WHERE coalesce(block_label, 'text') = 'text'),
pr AS (SELECT job_id, string_agg(content, ' ' ORDER BY page_index, y1, block_id) AS proof FROM tb GROUP BY job_id),
an AS (SELECT job_id, block_id, right(content, 80) AS pt, left(lead(content) OVER (PARTITION BY job_id, page_index ORDER BY y1, block_id), 80) AS nh FROM tb),
x AS (SELECT job_id, block_id, pt, nh, proof, instr(proof, pt) AS pos FROM an JOIN pr USING (job_id) WHERE nh IS NOT NULL)
SELECT job_id, block_id, CAST(CASE WHEN pos > 0 AND starts_with(regexp_replace(substring(proof, pos + length(pt), length(nh) + 20), '^\\s+', ''), nh) THEN pos + length(pt) - 1 ELSE -1 END AS INT) AS place FROM x""",
    "page_marks": """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(ps, lambda x, i: '<span id="page' || i || '" class="page-break" epub:type="pagebreak" role="doc-pagebreak" aria-label="' || i || '"></span>' || x), chr(10)) AS text_out FROM p""",
    "layout_lines": """WITH r AS (SELECT record_id, job_id, line_no, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM layout_results),
k AS (SELECT record_id, job_id, line_no, coalesce(json_extract(j, '$.result.layoutParsingResults[*].markdown.text'), []) AS found, coalesce(json_array_length(j, '$.result.layoutParsingResults'), 0) AS n, j FROM r
  WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.result') = 'OBJECT'),
e AS (SELECT record_id, job_id, line_no, list_transform(range(CAST(n AS BIGINT)), lambda i: json_extract_string(j, '$.result.layoutParsingResults[' || i || '].markdown.text')) AS ts FROM k),
f AS (SELECT record_id, job_id, line_no, CASE WHEN list_position(list_transform(ts, lambda x: x IS NULL), true) > 0 THEN ts[1:list_position(list_transform(ts, lambda x: x IS NULL), true) - 1] ELSE ts END AS ts FROM e)
SELECT job_id, record_id, CAST(coalesce(sum(len(ts)) OVER (PARTITION BY job_id ORDER BY line_no, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS page_index,
  CAST(len(ts) AS INT) AS n_texts, coalesce(array_to_string(ts, chr(10) || chr(10)), '') AS text FROM f""",
    "text_lines": f"""WITH r AS (SELECT record_id, job_id, line_no, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM layout_results),
k AS (SELECT *, json_array_length(j, '$.result.ocrResults') AS n FROM r WHERE json_type(j, '$.result.ocrResults') = 'ARRAY'),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY job_id ORDER BY line_no, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
p AS (SELECT job_id, before, unnest(json_extract(j, '$.result.ocrResults[*]')) AS page, unnest(range(CAST(n AS BIGINT))) AS i FROM b),
x AS (SELECT job_id, before + i AS page_index, coalesce(json_extract(page, '$.prunedResult.rec_texts[*]'), []) AS items FROM p),
t AS (SELECT job_id, CAST(page_index AS INT) AS page_index, coalesce(array_to_string(list_transform(list_filter(items, lambda v: json_type(v) = 'VARCHAR'), lambda v: json_extract_string(v, '$')), chr(10)), '') AS text FROM x)
SELECT job_id, page_index, text FROM t WHERE {strip('text')} <> ''""",
    "envelope_pages": """WITH r AS (SELECT record_id, payload::JSON AS j FROM layout_results WHERE payload IS NOT NULL AND json_valid(payload)),
c AS (SELECT record_id, CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.pages') THEN 'envelope' WHEN json_type(j) = 'ARRAY' THEN 'list' WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.parsing_res_list') THEN 'single page' END AS form, j FROM r),
p AS (SELECT record_id, form, CASE form
  WHEN 'envelope' THEN list_filter(json_extract(j, '$.pages[*].result.layoutParsingResults[*].prunedResult'), lambda x: json_type(x) <> 'NULL' AND CAST(x AS VARCHAR) NOT IN ('{}', '[]', '0', 'false', '""'))
  WHEN 'list' THEN list_transform(json_extract(j, '$[*]'), lambda x: CASE WHEN json_exists(x, '$.prunedResult') THEN json_extract(x, '$.prunedResult') ELSE x END)
  WHEN 'single page' THEN [j] END AS ps FROM c)
SELECT record_id, form, page_ix, TRY_CAST(json_extract_string(x, '$.width') AS INT) AS width FROM (SELECT record_id, form, unnest(ps) AS x, CAST(unnest(range(len(ps))) AS INT) AS page_ix FROM p)""",
    "stream_texts": "SELECT call_id, content AS text FROM llm_ocr WHERE content <> ''",
    "metadata_replies": f"""WITH h AS (SELECT doc_id, text, '---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || '# note' || chr(10) || 'source: ' || source || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'author: x' || chr(10) ELSE '' END AS head FROM documents),
r AS (SELECT doc_id, {strip("CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN 'note' || chr(10) || head ELSE head || '---' || chr(10) || chr(10) || ' ' || text END")} AS t FROM h),
m AS (SELECT doc_id, t, instr(t, '---') AS a, substring(t, instr(t, '---') + 3) AS rest FROM r), n AS (SELECT *, instr(rest, '---') AS b FROM m),
s AS (SELECT doc_id, CASE WHEN a = 0 THEN '' WHEN b = 0 THEN substring(t, a) ELSE substring(t, a, b + 5) END AS yaml,
  CASE WHEN a = 0 THEN t WHEN b = 0 THEN '' ELSE regexp_replace(substring(rest, b + 3), '^[\\n\\r ]+', '') END AS copyright FROM n),
v AS (SELECT *, CASE WHEN yaml IS NULL THEN NULL WHEN yaml = '' THEN 'empty' WHEN NOT contains(yaml, 'title:') THEN 'no title' WHEN NOT contains(yaml, 'author:') AND NOT contains(yaml, 'creator:') THEN 'no author' ELSE '' END AS hint FROM s)
SELECT doc_id, yaml, copyright, hint NOT IN ('empty', 'no title') AS valid, hint,
  CAST(len(list_filter(string_split(yaml, chr(10)), lambda l: {strip('l')} <> '' AND NOT starts_with({strip('l')}, '#') AND contains(l, ': '))) AS INT) AS fields,
  '---' || chr(10) || '# 元数据由识别结果自动生成' || chr(10) || '# 请在出版前人工核对' || chr(10) || CASE WHEN starts_with(yaml, '---' || chr(10)) THEN substring(yaml, 5) ELSE yaml END AS completed FROM v""",
    "job_progress": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY polled_at DESC NULLS LAST, poll_id DESC) AS rn, count(*) OVER (PARTITION BY job_id) AS polls FROM ocr_jobs)
SELECT job_id, polls, CASE lower(trim(job_state)) WHEN 'pending' THEN 'waiting' WHEN 'waiting-file' THEN 'waiting' WHEN 'running' THEN 'running' WHEN 'converting' THEN 'running' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'other' END AS state,
  total_pages, CASE WHEN total_pages > 0 THEN coalesce(extracted_pages, 0) / total_pages END AS progress, poll_id AS last_poll FROM s WHERE rn = 1""",
    "file_kinds": """SELECT poll_id, CASE WHEN lower(regexp_extract(file_name, '(\\.[^./\\\\]*)$', 1)) = '.pdf' THEN 'pages' WHEN lower(regexp_extract(file_name, '(\\.[^./\\\\]*)$', 1)) IN ('.png','.jpg','.jpeg','.webp','.bmp','.tiff','.tif') THEN 'image' END AS kind,
  CASE WHEN starts_with(json_url, 'http') THEN 'url' ELSE 'multipart' END AS submit FROM ocr_jobs""",
    "page_ranges": """SELECT poll_id, CAST(CASE WHEN poll_id % 3 = 0 THEN 0 WHEN poll_id % 3 = 1 THEN least(greatest(poll_id % 7 - 1, 0), total_pages) ELSE least(greatest(poll_id % 4 - 1, 0), total_pages) END AS INT) AS first,
  CAST(CASE WHEN poll_id % 3 = 0 THEN total_pages WHEN poll_id % 3 = 1 THEN least(greatest(poll_id % 7 - 1, 0) + 1, total_pages) ELSE least(poll_id % 40, total_pages) END AS INT) AS last FROM ocr_jobs WHERE total_pages IS NOT NULL""",
    "archive_members": """WITH n AS (SELECT job_id, poll_id, CASE WHEN poll_id % 2 = 0 THEN 'content/full' ELSE file_name END || ['.md', '.json', '.png'][poll_id % 3 + 1] AS name FROM ocr_jobs WHERE file_name IS NOT NULL)
SELECT job_id, coalesce(arg_min(name, poll_id) FILTER (WHERE ends_with(name, 'full.md')), arg_min(name, poll_id) FILTER (WHERE ends_with(name, '.md'))) AS md,
  coalesce(arg_min(name, poll_id) FILTER (WHERE ends_with(name, '.json') AND regexp_matches(name, 'content|structure|middle')), arg_min(name, poll_id) FILTER (WHERE ends_with(name, '.json'))) AS json FROM n GROUP BY job_id""",
    "model_requests": """WITH k AS (SELECT *, json_keys(payload_template) AS ks FROM model_configs)
SELECT model_key, lower(trim(coalesce(api_key_env, ''))) IN ('', 'none', 'no', 'optional', 'false') AS no_auth, CAST(coalesce(cardinality(headers), 0) AS INT) AS n_headers, coalesce(prompt_text, '') AS prompt,
  replace(api_url, '/chat/completions', '') AS base_url,
  array_to_string(list_sort(list_filter(ks, lambda x: x IN ('model','messages','stream','max_tokens','temperature','top_p','n','stop','frequency_penalty','presence_penalty','logit_bias','user','response_format','seed','logprobs','top_logprobs','modalities','tools','tool_choice','parallel_tool_calls'))), ',') AS arguments,
  array_to_string(list_sort(list_filter(ks, lambda x: x NOT IN ('model','messages','stream','max_tokens','temperature','top_p','n','stop','frequency_penalty','presence_penalty','logit_bias','user','response_format','seed','logprobs','top_logprobs','modalities','tools','tool_choice','parallel_tool_calls'))), ',') AS body FROM k""",
    "request_bodies": """SELECT model_key, array_to_string(list_sort(list_distinct(list_concat(['messages', 'model'], json_keys(payload_template)))), ',') AS members, model_id AS model, coalesce(prompt_text, '') AS prompt,
  TRY_CAST(json_extract_string(payload_template, '$.max_tokens') AS INT) AS max_tokens FROM model_configs""",
    "model_layers": "SELECT model_key, CASE WHEN batch_size > 1 THEN 'external ' || display_name ELSE display_name END AS display_name, batch_size, timeout_s FROM model_configs",
    "model_of_documents": "SELECT d.model_key, any_value(m.content_format) AS content_format, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents d LEFT JOIN model_configs m ON m.model_key = d.model_key GROUP BY d.model_key",
    "text_report": f"""WITH r AS ({_refine('llm_ocr', 'call_id', 'content')})
SELECT source, count(*) AS calls, count(DISTINCT job_id) AS jobs, count(*) FILTER (WHERE content IS NULL) AS missing, CAST(sum(length(content)) AS BIGINT) AS chars_in,
  CAST(sum(length(text_out)) AS BIGINT) AS chars_out, max(replace(left(content, 30), chr(10), '\\n')) AS preview FROM llm_ocr JOIN r USING (call_id) GROUP BY source""",
    "sql_functions": f"SELECT call_id, {double(empty_lines(batch_markers('content')))} AS text_out, regexp_matches(content, {q(f'[{HAN}]')}) AS has_han FROM llm_ocr",
}
