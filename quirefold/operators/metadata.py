"""Replies that hold a YAML header and a copyright part: split, check, complete."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import text as T

HEADER = "# 元数据由识别结果自动生成\n# 请在出版前人工核对\n"


def split_reply(reply: Column) -> Column:
    """struct(yaml, copyright): before and after the second ``---``; no mark: all copyright, one mark: all YAML from it."""
    return split_stripped(T.strip(reply))


def split_stripped(text: Column) -> Column:
    """The same for a reply without white space at either end."""
    first = F.locate("---", text)
    rest = F.substring(text, first + 3, F.char_length(text))
    second = F.locate("---", rest)
    yaml = F.when(first == 0, F.lit("")).when(second == 0, F.substring(text, first, F.char_length(text))).otherwise(F.substring(text, first, second + 5))
    after = F.regexp_replace(F.substring(rest, second + 3, F.char_length(rest)), r"\A[\n\r ]+", "")
    other = F.when(first == 0, text).when(second == 0, F.lit("")).otherwise(after)
    return F.struct(yaml.alias("yaml"), other.alias("copyright"))


def validate(yaml: Column) -> Column:
    """struct(valid, hint)."""
    no_author = ~F.contains(yaml, F.lit("author:")) & ~F.contains(yaml, F.lit("creator:"))
    hint = F.when(yaml.isNull(), F.lit(None)).when(yaml == "", F.lit("empty")).when(~F.contains(yaml, F.lit("title:")), F.lit("no title")).when(no_author, F.lit("no author")).otherwise(F.lit(""))
    return F.struct((~hint.isin("empty", "no title")).alias("valid"), hint.alias("hint"))


def with_header(yaml: Column, header: str = HEADER) -> Column:
    return F.when(F.startswith(yaml, F.lit("---\n")), F.concat(F.lit("---\n" + header), F.substring(yaml, F.lit(5), F.char_length(yaml)))).otherwise(F.concat(F.lit("---\n" + header), yaml))


def field_count(yaml: Column) -> Column:
    """Lines ``key: value`` that are no comments."""
    return F.size(F.filter(F.split(yaml, "\n", -1), lambda x: (T.strip(x) != "") & ~F.startswith(T.strip(x), F.lit("#")) & F.contains(x, F.lit(": "))))
