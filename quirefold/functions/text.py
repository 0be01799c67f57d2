"""Text refinement as Catalyst expressions: Column in, Column out, no Python in the plan.

Null stays null in every function; empty text stays empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.patterns import (
    BATCH_MARKER,
    BATCH_SPLIT,
    BLANK,
    END_MARKS,
    FINGERPRINT,
    FULL_WIDTH,
    GROUNDING,
    HAN,
    INLINE_WS,
    MASK,
    NEWLINE,
    OTHER_DIGITS,
    PAGE_MARKER,
    SHORT_LINE,
    WATERMARKS,
    WIDE,
    WS,
)

_END_CLASS = "".join(re.escape(c) for c in END_MARKS)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+\z", "")


def remove_grounding(text: Column) -> Column:
    """Delete whole lines of grounding tags, with the blank lines around them."""
    return F.when(F.contains(text, F.lit("<|ref|>")), F.regexp_replace(text, GROUNDING, "")).otherwise(text)


def remove_page_markers(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("页")), F.regexp_replace(text, PAGE_MARKER, "\n\n")).otherwise(text)


def remove_batch_markers(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("批次")), F.regexp_replace(text, BATCH_MARKER, "")).otherwise(text)


def merge_empty_lines(text: Column) -> Column:
    """Runs of line ends to one; texts with any CRLF count CRLF pairs only."""
    return F.when(F.contains(text, F.lit("\r\n")), F.regexp_replace(text, r"(\r\n){2,}", "\r\n")).otherwise(F.regexp_replace(text, r"\n{2,}", "\n"))


def strip_line_ends(text: Column) -> Column:
    """Trailing white space off every line; the line end is CRLF in texts that hold one."""
    crlf = F.array_join(F.transform(F.split(text, "\r\n"), rstrip), "\r\n")
    return F.when(F.contains(text, F.lit("\r\n")), crlf).otherwise(F.regexp_replace(text, rf"{INLINE_WS}+(?=\n|\z)", ""))


def remove_interspersed_spaces(text: Column) -> Column:
    """Spaces at either end of the text, next to a wide character, or between two ASCII digits."""
    return F.regexp_replace(text, rf"\A +| +\z|(?<=[{WIDE}]) +| +(?=[{WIDE}])|(?<=[0-9]) +(?=[0-9])", "")


def single_quotes(text: Column) -> Column:
    """Straight single quotes in pairs per line; apostrophes after a letter stay."""
    masked = F.regexp_replace(text, rf"(?<=[A-Za-z])'(?=[A-Za-z]|{INLINE_WS})", MASK)
    paired = F.regexp_replace(F.regexp_replace(masked, r"'([^'\n]*)'", "‘$1’"), "'", "‘")
    return F.when(F.contains(text, F.lit("'")), F.translate(paired, MASK, "'")).otherwise(text)


def double_quotes(text: Column) -> Column:
    paired = F.regexp_replace(F.regexp_replace(text, r'"([^"\n]*)"', "“$1”"), '"', "“")
    return F.when(F.contains(text, F.lit('"')), paired).otherwise(text)


def basic_punctuation(text: Column) -> Column:
    """Half-width marks to full width, unless after an ASCII letter (full stops: or a digit).

    The text falls into letter runs with the mark that they keep, digit runs with the full stop that they keep, and all
    else, whose marks are translated; one scan instead of one for each mark.
    """
    marks, wide = "".join(FULL_WIDTH), "".join(FULL_WIDTH.values())
    of_marks = "".join(re.escape(c) for c in marks)
    digits = rf"\p{{Nd}}{OTHER_DIGITS}"
    pieces = F.regexp_extract_all(text, F.lit(rf"[A-Za-z]+[{of_marks}]?|[{digits}]+\.?|[^A-Za-z{digits}]+"), 0)
    kept = rf"^[A-Za-z{digits}]"
    converted = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(kept), x).otherwise(F.translate(x, marks, wide))), "")
    return F.when(text.rlike(f"[{of_marks}]"), converted).otherwise(text)


def full_width_punctuation(text: Column) -> Column:
    return basic_punctuation(double_quotes(single_quotes(text)))


def split_lines(text: Column) -> Column:
    """Lines at any line separator; a final separator makes no empty line."""
    lines = F.split(text, NEWLINE, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def merge_paragraphs(text: Column) -> Column:
    """Join lines that were broken inside a paragraph.

    A line goes on in the next one unless it ends in an end mark or is short; what was joined before counts as long.
    So text falls into stretches after each end mark; in a stretch the lines before the first long one stay, and all
    from there on are joined.  Three linear passes inside the row: no exchange, no accumulator.
    """
    lines = F.regexp_replace(strip(text), NEWLINE, "\n")
    body = F.regexp_replace(F.regexp_replace(lines, rf"\n{WS}+", "\n"), rf"{BLANK}+\n", "\n")
    # a blank last line is a line of its own
    blank_end = F.when(text.rlike(rf"(?:^|[^\r]|\r(?!\n))(?>{NEWLINE})(?:{BLANK}*(?>{NEWLINE})|{BLANK}+)\z"), F.lit("\n")).otherwise(F.lit(""))
    stretches = F.split(F.concat(body, blank_end), rf"(?<=[{_END_CLASS}])\n", -1)
    long_line = rf"(?md)^[^\n]{{{SHORT_LINE + 1}}}"
    placed = F.transform(stretches, lambda x: F.struct(x.alias("x"), F.when(F.contains(x, F.lit("\n")), F.regexp_instr(x, F.lit(long_line))).otherwise(F.lit(0)).alias("at")))

    def join(part: Column) -> Column:
        x, at = part["x"], part["at"]
        tail = F.regexp_replace(F.substring(x, at, F.char_length(x)), rf"\n\z|\n(?=[{HAN}])|(?<=[{HAN}])\n", "")
        return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.replace(tail, F.lit("\n"), F.lit(" ")))).otherwise(x)

    merged = F.array_join(F.transform(placed, join), "\n")
    return F.regexp_replace(F.when(merged == "\n", F.lit("")).otherwise(merged), " {2,}", " ")


def chunks(text: Column) -> Column:
    """Stripped, non-blank parts between batch banners."""
    parts = F.transform(F.split(text, BATCH_SPLIT, -1), strip)
    return F.filter(parts, lambda x: x != "")


def cut_overlap(chunk: Column, following: Column) -> Column:
    """A chunk up to the first place where the beginning of the following chunk occurs in it."""
    at = F.instr(chunk, F.left(following, F.lit(FINGERPRINT)))
    return F.when(following.isNull() | (at == 0), chunk).otherwise(F.substring(chunk, F.lit(1), at - 1))


def remove_overlaps(text: Column) -> Column:
    """Cut what a batch repeats from the start of the next one; banners go, parts are joined by a blank line."""
    parts = chunks(text)
    cut = F.transform(parts, lambda x, i: cut_overlap(x, F.get(parts, i + 1)))
    return F.when(F.contains(text, F.lit("批次")), F.array_join(cut, "\n\n")).otherwise(strip(text))


def strip_artifacts(text: Column) -> Column:
    """Lines that hold nothing but a watermark word are dropped."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~strip(x).isin(*WATERMARKS)), "\n")


def anchors(text: Column, size: int = 30) -> Column:
    """struct(head, tail): first and last characters of the stripped text."""
    s = strip(text)
    return F.struct(F.left(s, F.lit(size)).alias("head"), F.right(s, F.lit(size)).alias("tail"))


def flat(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def flat_position(text: Column, position: Column) -> Column:
    """Characters other than line feeds before a 0-based position."""
    return F.char_length(flat(F.left(text, position)))


def find_all(text: Column, target: Column) -> Column:
    """0-based positions of all occurrences, overlapping ones too.

    The text is split before every occurrence; positions are the running lengths of the pieces.
    """
    pieces = F.transform(F.split(text, F.concat(F.lit("(?=\\Q"), target, F.lit("\\E)")), F.lit(-1)), F.char_length)
    none = F.array().cast("array<int>")
    running = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("sum"), none.alias("xs")),
        lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["xs"], acc["sum"] + x).alias("xs")),
        lambda acc: F.slice(acc["xs"], F.lit(1), F.size(acc["xs"]) - 1),
    )
    first = F.when(F.startswith(text, target), F.array(F.lit(0))).otherwise(none)
    return F.when((target == "") | (text == ""), none).otherwise(F.concat(first, running))


def strip_tags(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"<[^>]+>", ""))


def page_break(number: Column) -> Column:
    n = number.cast("string")
    return F.concat(F.lit('<span id="page'), n, F.lit('" class="page-break" epub:type="pagebreak" role="doc-pagebreak" aria-label="'), n, F.lit('"></span>'))


def one_line(text: Column) -> Column:
    """Line feeds shown as ``\\n``, for previews."""
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def data_uri(mime: str, content: Column) -> Column:
    """Binary content as a data URI without line breaks."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def batch_label(first: Column, last: Column, total: Column) -> Column:
    return F.format_string("第%d-%d页 (共%d页)", first, last, total)


def failure_placeholder(first: Column, last: Column) -> Column:
    return F.format_string("\n\n[第%d-%d页识别失败]\n\n", first, last)


def banner(title: Column, text: Column, width: int = 60) -> Column:
    rule = F.repeat(F.lit("="), F.lit(width))
    return F.concat(F.lit("\n"), rule, F.lit("\n"), title, F.lit("\n"), rule, F.lit("\n\n"), text, F.lit("\n\n"))


def page_range(spec: Column, total: Column) -> Column:
    """struct(first, last): 0-based half-open range of a page specification ``a``, ``a-b`` or null for all.

    Both ends are clamped to the document (a single page beyond the end gives an empty range).
    """
    parts = F.split(spec, "-", 2)
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    first = F.when(spec.isNull(), F.lit(0)).otherwise(F.least(F.greatest(a - 1, F.lit(0)), total))
    last = F.when(spec.isNull(), total).when(F.contains(spec, F.lit("-")), F.least(b, total)).otherwise(F.least(F.greatest(a - 1, F.lit(0)) + 1, total))
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))


def input_kind(path: Column) -> Column:
    """``pages`` for PDF, ``image`` for pictures, null for anything else."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.when(extension == ".pdf", F.lit("pages")).when(extension.isin(".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif"), F.lit("image"))


def submit_kind(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("http")), F.lit("url")).otherwise(F.lit("multipart"))


def needs_no_key(key: Column) -> Column:
    return F.lower(strip(F.coalesce(key, F.lit("")))).isin("", "none", "no", "optional", "false")
