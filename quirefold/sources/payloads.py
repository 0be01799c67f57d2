"""Result payloads to rows: layout lines, text lines, envelopes, event streams.

Schemas are fixed; payloads that are no JSON, or whose ``result`` is null or missing, are skipped and never stop a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

_RESULT = (
    "struct<result:struct<layoutParsingResults:array<struct<markdown:struct<text:string>,prunedResult:string>>,"
    "ocrResults:array<struct<prunedResult:struct<rec_texts:array<variant>>>>>>"
)


def result_lines(df: DataFrame, key: str, line: str, payload: str) -> DataFrame:
    """(key, line, layout, ocr) of the payload lines that hold a result."""
    parsed = F.from_json(F.col(payload), _RESULT, {"mode": "PERMISSIVE"})
    rows = df.select(key, line, F.when(F.try_parse_json(F.col(payload)).isNotNull(), parsed).alias("p"))
    return rows.where(F.col("p.result").isNotNull()).select(key, line, F.col("p.result.layoutParsingResults").alias("layout"), F.col("p.result.ocrResults").alias("ocr"))


def _before(key: str, line: str, n: Column) -> Column:
    """Results counted before a line, which is the page index of the line."""
    earlier = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast("int")


def _usable(layout: Column) -> Column:
    """Texts of a line up to the first result without one."""
    texts = F.transform(F.coalesce(layout, F.array()), lambda x: x["markdown"]["text"])
    first_null = F.array_position(F.transform(texts, lambda x: x.isNull()), F.lit(True))
    return F.when(first_null > 0, F.slice(texts, F.lit(1), (first_null - 1).cast("int"))).otherwise(texts)


def layout_pages(df: DataFrame, key: str, line: str, payload: str) -> DataFrame:
    """(key, line, page_index, texts) of layout results: one page row a line, with the texts read from it."""
    rows = result_lines(df, key, line, payload).withColumn("texts", _usable(F.col("layout")))
    return rows.withColumn("page_index", _before(key, line, F.size("texts"))).select(key, line, "page_index", F.size("texts").alias("n_texts"), F.array_join("texts", "\n\n").alias("text"))


def line_pages(df: DataFrame, key: str, line: str, payload: str) -> DataFrame:
    """(key, page_index, text) of text-line results; blank pages count but give no row, items that are no strings are dropped."""
    rows = result_lines(df, key, line, payload).where(F.col("ocr").isNotNull())
    strings = lambda xs: F.filter(F.transform(xs, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))), lambda x: x.isNotNull())
    texts = F.transform("ocr", lambda r: F.array_join(strings(F.coalesce(r["prunedResult"]["rec_texts"], F.array().cast("array<variant>"))), "\n"))
    pages = rows.withColumn("before", _before(key, line, F.size("ocr"))).select(key, "before", F.posexplode(texts).alias("at", "text"))
    return pages.where(T.strip(F.col("text")) != "").select(key, (F.col("before") + F.col("at")).cast("int").alias("page_index"), "text")


_LAYOUT_LIST = "array<struct<prunedResult:string>>"


def envelope_pages(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, form, page_ix, page): layout pages of envelopes, bare lists and single pages, in this order of tests."""
    text = F.col(payload)
    keys = F.json_object_keys(text)
    is_list = F.startswith(T.strip(text), F.lit("["))
    pages = F.from_json(F.get_json_object(text, "$.pages"), f"array<struct<result:struct<layoutParsingResults:{_LAYOUT_LIST}>>>")
    nested = F.flatten(F.transform(pages, lambda p: F.coalesce(p["result"]["layoutParsingResults"], F.array().cast(_LAYOUT_LIST))))
    truthy = lambda x: x.isNotNull() & ~x.isin("", "{}", "[]", "0", "false", '""')
    of_envelope = F.filter(F.transform(nested, lambda x: x["prunedResult"]), truthy)
    items = F.from_json(text, "array<string>")
    of_list = F.transform(items, lambda x: F.when(F.array_contains(F.json_object_keys(x), "prunedResult"), F.get_json_object(x, "$.prunedResult")).otherwise(x))
    form = (
        F.when(F.array_contains(keys, "pages"), F.lit("envelope"))
        .when(is_list, F.lit("list"))
        .when(F.array_contains(keys, "parsing_res_list"), F.lit("single page"))
    )
    rows = df.where(F.try_parse_json(text).isNotNull()).select(key, payload, form.alias("form"))
    found = F.when(F.col("form") == "envelope", of_envelope).when(F.col("form") == "list", of_list).when(F.col("form") == "single page", F.array(text))
    return rows.select(key, "form", F.posexplode(found).alias("page_ix", "page"))


def envelope(df: DataFrame, doc: str, source: str, model: str, page_index: str, result: str) -> DataFrame:
    """One result envelope a document as JSON."""
    pages = F.array_sort(F.collect_list(F.struct(F.col(page_index).alias("page_index"), F.col(result).alias("result"))))
    grouped = df.groupBy(doc).agg(F.max(source).alias("source"), F.max(model).alias("model"), pages.alias("pages"))
    return grouped.select(doc, F.to_json(F.struct("source", "model", F.size("pages").alias("total_pages"), "pages")).alias("envelope"))


def stream_deltas(df: DataFrame, call: str, seq: str, line: str) -> DataFrame:
    """(call, text): text pieces of event-stream lines joined in order, up to the end mark.

    Reads both chunk forms: ``choices[0].delta.content`` and ``content_block_delta`` events.
    """
    body = F.substring(F.col(line), F.lit(7), F.char_length(line))
    events = df.where(F.startswith(F.col(line), F.lit("data: "))).select(call, seq, body.alias("body"))
    ends = F.min(F.when(F.trim("body") == "[DONE]", F.col(seq))).over(Window.partitionBy(call))
    live = events.withColumn("end", ends).where(F.col("end").isNull() | (F.col(seq) < F.col("end")))
    typed = F.when(F.get_json_object("body", "$.type") == "content_block_delta", F.when(F.get_json_object("body", "$.delta.type") == "text_delta", F.get_json_object("body", "$.delta.text")))
    piece = F.coalesce(F.get_json_object("body", "$.choices[0].delta.content"), typed)
    pieces = live.select(call, seq, piece.alias("piece")).where("piece IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct(seq, "piece")))
    return pieces.groupBy(call).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))
