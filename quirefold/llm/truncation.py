"""Detect texts that were cut off, and report how often each source cuts.

Pure SQL.  Texts become tokens: words in lower case (a run of letters of any script), numbers as ``0``, line ends as ``¶``,
dot leaders, ellipses and single punctuation marks.

1. Word trigrams are counted inside texts and at their ends; the ends of equal texts count once.
2. The final trigram of each text is joined with the counts.  Its rate at ends is the exact one if it stands often inside
   texts, drawn towards the rate of its class (any word ``w``, the marks themselves), and that towards the rate of the class of its
   last token.  A trigram with a rate under ``TERMINAL_RATE`` is frequent inside and almost never terminal: the text is suspect.  An ellipsis that
   hardly occurs but at ends is the mark of whoever cut the text; such texts are judged by the trigram before it.
3. An exact check follows, with what the corpus itself says of lines that are no sentences (headings, page numbers, signatures,
   list entries, table rows): a suspect is no case if its last line stands as a whole line inside texts, or begins like lines
   that end without a closing mark there.  There are no word lists.

A broken last character is always a cut.  Failure placeholders and null or blank contents are no cases.

Scale: tokens and trigram counts are materialised once; trigrams are built in the row and combined map-side.  Classes are a few thousand
rows and broadcast after a count.  A trigram that ends more than a thousandth of all texts is joined by broadcast (there are
at most a thousand), the others by shuffle, so a hot ending loads no task.

Defined results: repeated rows are judged each; texts of one or two tokens are padded with ``^``; very long texts
are read whole; null sources are reported as one source ``''``; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.runtime import broadcast_if_small, cut

#: a trigram seen at least so often inside texts is judged by itself
FREQUENT = 20
#: almost never terminal
TERMINAL_RATE = 0.01
#: weight of the class in the rate of a trigram, in occurrences
SMOOTH = 100
#: an ellipsis with this share at ends is no punctuation
MARK_AT_ENDS = 0.9
#: lines of so few tokens are compared whole, beginnings are so many tokens
LINE_TOKENS, OPENING = 4, 3
LEAST_LINES, LEAST_OPENINGS, OPEN_SHARE = 3, 5, 0.9

TOKENS = r"""
WITH body AS (
  SELECT call_id, source, regexp_replace(regexp_replace(content, r'\p{Cf}+', ''), r'\s+\z', '') AS text FROM {calls}
  WHERE content IS NOT NULL AND NOT rlike(content, r'\A\s*(\[[^\]\n]*\]\s*)*\z')
), lined AS (
  SELECT call_id, source, endswith(text, '�') AS broken_end,
         translate(regexp_replace(lower(rtrim('�', text)), r'\n\s*\n\s*', '¶¶'), '\n', '¶') AS text FROM body
)
SELECT call_id, source, broken_end,
       regexp_extract_all(regexp_replace(text, r'[\p{Nd}一二三四五六七八九十百千]+', '0'), r'[\p{L}\p{M}]+|0|¶|\.{4,}|\.{2,3}|…+|[^\s\p{L}\p{M}0]', 0) AS w
FROM lined
"""

#: ellipses that end texts and hardly stand inside them
MARKS = """
SELECT m AS mark FROM (
  SELECT explode(filter(slice(w, 1, greatest(size(w) - 1, 0)), x -> x IN ('..', '...', '…', '……'))) AS m, 0 AS at_end FROM {tokens}
  UNION ALL SELECT element_at(w, -1), 1 FROM {tokens} WHERE size(w) > 0 AND element_at(w, -1) IN ('..', '...', '…', '……')
) GROUP BY m HAVING sum(at_end) >= MARK_AT_ENDS * count(*)
"""

#: tokens padded, the foreign mark at the end taken off
CALLS = """
SELECT call_id, source, broken_end, mark IS NOT NULL AS marked,
       concat(array('^', '^'), CASE WHEN mark IS NULL THEN w ELSE slice(w, 1, size(w) - 1) END) AS w
FROM {tokens} LEFT JOIN {marks} ON mark = try_element_at(w, -1)
"""

#: the final trigram and the last line of each text
ENDS = r"""
WITH x AS (
  SELECT *, split(array_join(slice(w, 3, size(w)), ' '), ' ?¶ ?') AS lines FROM {calls} WHERE size(w) > 2
), y AS (
  SELECT *, element_at(lines, -1) AS line FROM x
)
SELECT call_id, marked, w[size(w) - 3] AS a, w[size(w) - 2] AS b, w[size(w) - 1] AS c, xxhash64(w) AS h,
       CASE WHEN size(split(line, ' ')) <= LINE_TOKENS THEN line END AS whole_line,
       BEGINNING AS opening
FROM y
"""

#: every trigram with its numbers inside and at ends of texts, and its class
COUNTS = r"""
WITH inner_trigrams AS (
  SELECT inline(transform(sequence(0, size(w) - 4), i -> struct(w[i] AS a, w[i + 1] AS b, w[i + 2] AS c))) FROM {calls} WHERE size(w) > 3
), counted AS (
  SELECT a, b, c, count(*) AS inside, 0L AS ended, 0L AS texts FROM inner_trigrams GROUP BY a, b, c
  UNION ALL SELECT a, b, c, 0L, count(DISTINCT h), count(*) FROM {ends} GROUP BY a, b, c
), summed AS (
  SELECT a, b, c, sum(inside) AS inside, sum(ended) AS ended, sum(texts) AS texts FROM counted GROUP BY a, b, c
)
SELECT *, CASE WHEN rlike(a, r'^\p{L}') THEN 'w' ELSE a END AS ca, CASE WHEN rlike(b, r'^\p{L}') THEN 'w' ELSE b END AS cb, CASE WHEN rlike(c, r'^\p{L}') THEN 'w' ELSE c END AS cc
FROM summed
"""

#: rate at ends of each class, drawn towards that of its last token; a text's own end does not count, and a token that is rare inside
#: texts proves nothing
CLASSES = """
WITH k AS (SELECT ca, cb, cc, sum(inside) AS inside, sum(ended) AS ended FROM {counts} GROUP BY ca, cb, cc),
l AS (SELECT cc, sum(inside) AS inside, sum(ended) AS ended FROM k GROUP BY cc)
SELECT ca, cb, cc, CASE WHEN l.inside < FREQUENT THEN 1.0D
       ELSE (k.ended - 1 + SMOOTH * (l.ended - 1) / greatest(1, l.inside + l.ended - 1)) / (k.inside + k.ended - 1 + SMOOTH) END AS class_rate
FROM k JOIN l USING (cc) WHERE k.ended > 0
"""

RATES = """
SELECT a, b, c, texts, (CASE WHEN inside >= FREQUENT THEN ended - 1 ELSE 0 END + SMOOTH * class_rate)
       / (CASE WHEN inside >= FREQUENT THEN inside + ended - 1 ELSE 0 END + SMOOTH) AS terminal_rate
FROM {counts} JOIN {classes} USING (ca, cb, cc) WHERE ended > 0
"""

#: lines inside texts, few tokens whole, others by their beginning: whether they stand alone or begin with a mark, and end openly
LINES = r"""
WITH x AS (SELECT split(array_join(slice(w, 3, size(w)), ' '), ' ?¶ ?') AS lines FROM {calls} WHERE size(w) > 2 AND array_contains(w, '¶')),
y AS (SELECT inline(transform(sequence(0, size(lines) - 2), i -> struct(lines[i] AS line, (i = 0 OR lines[greatest(i - 1, 0)] = '') AND lines[i + 1] = '' AS alone))) FROM x),
z AS (
  SELECT CASE WHEN size(split(line, ' ')) <= LINE_TOKENS THEN line END AS line, CASE WHEN alone OR rlike(line, r'^[^\p{L}0]') THEN BEGINNING END AS opening,
         NOT rlike(right(line, 20), r'[.。!?！？…;；:：]( ["”»’」』)）\]])*$') AS open
  FROM y WHERE line <> ''
)
SELECT line, opening, open, count(*) AS n FROM z WHERE line IS NOT NULL OR opening IS NOT NULL GROUP BY line, opening, open
"""
WHOLE = "SELECT line FROM {lines} WHERE line IS NOT NULL GROUP BY line HAVING sum(n) >= LEAST_LINES"
OPENINGS = "SELECT opening FROM {lines} WHERE opening IS NOT NULL GROUP BY opening HAVING sum(n) >= LEAST_OPENINGS AND sum(CASE WHEN open THEN n ELSE 0 END) >= OPEN_SHARE * sum(n)"

#: first tokens of a line; after a mark words count as words only
BEGINNING = r"CASE WHEN rlike(line, r'^[\p{L}0]') THEN substring_index(line, ' ', OPENING) ELSE regexp_replace(substring_index(line, ' ', OPENING), r'[\p{L}\p{M}]+', 'w') END"

_NAMES = ("BEGINNING", "MARK_AT_ENDS", "TERMINAL_RATE", "FREQUENT", "SMOOTH", "LINE_TOKENS", "LEAST_LINES", "LEAST_OPENINGS", "OPENING", "OPEN_SHARE")


def _run(sql: str, **tables: DataFrame) -> DataFrame:
    for name in _NAMES:
        sql = sql.replace(name, str(globals()[name]))
    # braces of patterns are not parameters
    query = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        query = query.replace("{{" + name + "}}", "{" + name + "}")
    return next(iter(tables.values())).sparkSession.sql(query, **tables)


def rates(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls with their tokens, ends, rate of each final trigram); ``df`` has call_id, source, content."""
    tokens = cut(_run(TOKENS, calls=df.select("call_id", "source", "content")))
    # four rows at most
    calls = _run(CALLS, tokens=tokens, marks=F.broadcast(_run(MARKS, tokens=tokens)))
    calls = cut(calls)
    ends = _run(ENDS, calls=calls)
    counts = cut(_run(COUNTS, calls=calls, ends=ends))
    classes = broadcast_if_small(cut(_run(CLASSES, counts=counts)))
    return calls, ends, cut(_run(RATES, counts=counts, classes=classes))


def judge(df: DataFrame) -> DataFrame:
    """(call_id, source, terminal_rate, closing, is_cut) of every text; ``closing``: a suspect whose last line is no sentence."""
    calls, ends, rated = rates(df)
    hot = F.broadcast(rated.where(F.col("texts") * 1000 >= calls.count()))  # at most 1,000 rows
    key = ["a", "b", "c"]
    of_text = ends.join(hot, key).unionByName(ends.join(hot, key, "left_anti").join(rated, key))
    suspect = of_text.where(F.col("terminal_rate") < TERMINAL_RATE)
    lines = cut(_run(LINES, calls=calls))
    whole = broadcast_if_small(cut(_run(WHOLE, lines=lines)))
    openings = broadcast_if_small(cut(_run(OPENINGS, lines=lines)))
    plain = suspect.where(~F.col("marked"))
    closing = plain.join(whole, plain["whole_line"] == whole["line"], "left_semi").select("call_id")
    closing = closing.unionByName(plain.join(openings, "opening", "left_semi").select("call_id")).distinct().withColumn("closing", F.lit(True))
    rate = of_text.select("call_id", "terminal_rate")
    judged = calls.select("call_id", "source", "broken_end").join(rate, "call_id", "left").join(closing, "call_id", "left")
    closing, low = F.coalesce("closing", F.lit(False)), F.coalesce(F.col("terminal_rate") < TERMINAL_RATE, F.lit(False))
    return judged.select("call_id", "source", "terminal_rate", closing.alias("closing"), (F.col("broken_end") | (low & ~closing)).alias("is_cut"))


def per_source(judged: DataFrame) -> DataFrame:
    return judged.sparkSession.sql(
        """SELECT coalesce(source, '') AS source, count(*) AS calls, count_if(is_cut) AS cut_calls, count_if(is_cut) / count(*) AS cut_share
        FROM {judged} GROUP BY 1""",
        judged=judged,
    )
