"""Exact cases, then random strings against plain statements of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.plans import pipeline


@pytest.fixture(scope="module")
def apply(spark):
    def run(step, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r[0] for r in rows.orderBy("i").select(step(F.col("t"))).collect()]

    return run


CASES = [
    (T.merge_empty_lines, "a\n\n\n\nb", "a\nb"),
    (T.merge_empty_lines, "a\r\n\r\n\r\nb", "a\r\nb"),
    (T.merge_empty_lines, "", ""),
    (T.strip_line_ends, "a  \nb  ", "a\nb"),
    (T.strip_line_ends, "  a\n  b", "  a\n  b"),
    (T.strip_line_ends, "a  \r\nb  ", "a\r\nb"),
    (T.strip_line_ends, "\n\n", "\n\n"),
    (T.strip_line_ends, "a　 \nb", "a\nb"),
    (T.remove_interspersed_spaces, "中文 空格", "中文空格"),
    (T.remove_interspersed_spaces, "hello world", "hello world"),
    (T.remove_interspersed_spaces, "123 456", "123456"),
    (T.remove_interspersed_spaces, "  hello ", "hello"),
    (T.remove_grounding, "text", "text"),
    (T.remove_grounding, "a\n<|ref|>text<|/ref|> <|det|>[[1,2,3,4]]<|/det|>\nb", "a\n\nb"),
    (T.remove_page_markers, "正文1\n\n====================\n第 1 页 (共 3 页)\n====================\n\n正文2", "正文1\n\n\n正文2"),
    (T.remove_batch_markers, "==========\n批次 1 (共 2 批)\n==========", ""),
    (T.remove_overlaps, "", ""),
    (T.remove_overlaps, " no banner \n", "no banner"),
    (T.merge_paragraphs, "这是一行没有结束标点的长文字内容\n接着的一行文字内容也很长没有标点", "这是一行没有结束标点的长文字内容接着的一行文字内容也很长没有标点"),
    (T.merge_paragraphs, "", ""),
    (T.merge_paragraphs, "\n\n", ""),
    (T.basic_punctuation, "3.14", "3.14"),
    (T.basic_punctuation, "Dr. Smith", "Dr. Smith"),
    (T.basic_punctuation, "example.com", "example.com"),
    (T.basic_punctuation, "12:30 (abc)", "12：30 （abc)"),
    (T.double_quotes, '"a" "b"', "“a” “b”"),
    (T.double_quotes, '"a\n"b"', "“a\n“b”"),
    (T.single_quotes, "John's 'x'", "John's ‘x’"),
    (T.strip_artifacts, "a\n 风眠 \nb", "a\nb"),
    (T.strip_tags, " <b>x</b> ", "x"),
]


@pytest.mark.parametrize("step,value,expected", CASES)
def test_exact(apply, step, value, expected):
    assert apply(step, value) == [expected]


def test_identical_batches_appear_once(apply):
    rule = "=" * 40
    text = "".join(f"{rule}\n批次 {i} (共 2 批)\n{rule}\nsame content of both batches, longer than a print" for i in (1, 2))
    assert apply(T.remove_overlaps, text)[0].count("same content") == 1


def test_null_stays_null(apply):
    for step in pipeline.STEPS.values():
        assert apply(step, None) == [None]


def _merge(text):
    """Line by line with the text carried so far."""
    han = lambda c: "一" <= c <= "鿿"
    lines, out, held = text.splitlines(), [], ""
    for i, line in enumerate(lines):
        line = line.strip()
        glue = " " if held and line and not han(held[-1]) and not han(line[0]) else ""
        line = held + glue + line
        held = ""
        if i == len(lines) - 1:
            out.append(line)
        elif line and line[-1] not in "。！？；….!?;”’\"》])" and len(line) > 10:
            held = line
        elif line:
            out.append(line)
    return re.sub(" {2,}", " ", "\n".join(out))


def _spaces(text):
    wide = lambda c: "一" <= c <= "鿿" or "　" <= c <= "〿" or "＀" <= c <= "￯"
    runs = re.split("( +)", text)
    for i in range(1, len(runs), 2):
        left, right = runs[i - 1][-1:], runs[i + 1][:1]
        if not left or not right or wide(left) or wide(right) or (left in "0123456789" and right in "0123456789"):
            runs[i] = ""
    return "".join(runs)


def _basic(text):
    full = dict(zip(",.!?:;()[]{}<>", "，。！？：；（）［］｛｝《》"))
    return "".join(
        c if c not in full or i and (text[i - 1].isascii() and text[i - 1].isalpha() or c == "." and text[i - 1].isdigit()) else full[c]
        for i, c in enumerate(text)
    )


def _strings(alphabet, n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_random_merge(apply):
    pieces = ["\n", "\n", "中文字", "abcdef ghij", ".", "。", " ", "x", "\r\n", "　", "长长长长长长长长", "12"]
    values = _strings(pieces, 600, 14, 1)
    assert apply(T.merge_paragraphs, *values) == [_merge(v) for v in values]


def test_random_spaces(apply):
    values = _strings("a1 中，　 b2", 600, 16, 2)
    assert apply(T.remove_interspersed_spaces, *values) == [_spaces(v) for v in values]


def test_random_punctuation(apply):
    values = _strings("aé1²٣中 ,.!?:;()[]{}<>'\n", 600, 16, 3)
    assert apply(T.basic_punctuation, *values) == [_basic(v) for v in values]


def test_random_line_ends(apply):
    values = _strings("a \t　\xa0\x1c\n", 500, 10, 4)
    assert apply(T.strip_line_ends, *values) == ["\n".join(x.rstrip() for x in v.split("\n")) for v in values]


def test_split_lines(apply):
    values = _strings("ab\n\r\x0b\x0c\x1c\x85  ", 500, 10, 5)
    assert apply(T.split_lines, *values) == [v.splitlines() for v in values]


def test_find_all_counts_overlaps(spark):
    rows = spark.createDataFrame([("aaaa", "aa"), ("xaxa", "xa"), ("", "a"), ("abc", "c"), ("a.b.", ".")], "t string, x string")
    assert [r[0] for r in rows.select(T.find_all(F.col("t"), F.col("x"))).collect()] == [[0, 1, 2], [0, 2], [], [2], [1, 3]]


def test_page_range(spark):
    rows = spark.createDataFrame([(None, 5), ("2", 5), ("2-4", 5), ("0-9", 5), ("9", 5)], "s string, n int")
    assert [tuple(r[0]) for r in rows.select(T.page_range(F.col("s"), F.col("n"))).collect()] == [(0, 5), (1, 2), (1, 4), (0, 5), (5, 5)]


def test_pipeline_skip_and_order(spark):
    df = spark.createDataFrame([("a  b\n\n\nc",)], "t string")
    everything = ",".join(pipeline.STEPS)
    assert pipeline.refine(df, "t", skip=everything).first().text_out == "a  b\n\n\nc"
    assert pipeline.refine(df, "t", skip="nonsense").first().text_out == "a b\nc"
    assert list(pipeline.STEPS) == ["ocr_grounding", "dedup", "batch_markers", "page_markers", "empty_lines", "whitespace", "paragraph_merge", "fullwidth_punct", "interspaced_spaces"]


def test_pipeline_needs_no_exchange_and_no_python(spark):
    plan = pipeline.refine(spark.createDataFrame([("a",)], "t string"), "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_very_long_text(apply):
    long = ("short\n" * 30_000) + ("a line that is long enough to go on\n" * 30_000)
    out = apply(T.merge_paragraphs, long)[0]
    assert out.count("\n") == 30_000
    assert len(apply(T.full_width_punctuation, long)[0]) == len(long)
