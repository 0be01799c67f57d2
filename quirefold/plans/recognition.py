"""From page images to refined texts: batches, calls, placeholders, raw texts, refinement, files.

One row a page comes in.  Pages are grouped to batches of the model's size (never more), each batch is one call in an Arrow step, and
everything after it are expressions.  A call that fails leaves the placeholder of its pages and its error; it stops no document.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import batches
from quirefold.plans.pipeline import refine
from quirefold.runtime import cut
from quirefold.sources import connectors, files


def call_batches(pages: DataFrame, doc: str, page: str, image: str, size: int, prompt: str | None) -> DataFrame:
    """(doc, batch, batch_total, call_id, prompt, images, placeholder); ``image`` holds data URIs, pages count from 0."""
    totals = pages.groupBy(doc).agg(F.count("*").cast("int").alias("pages"))
    number = F.floor(F.col(page) / size).cast("int")
    grouped = pages.groupBy(doc, number.alias("batch")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(image).alias("i")))), lambda x: x["i"]).alias("images"),
        F.min(page).cast("int").alias("first"), F.max(page).cast("int").alias("last"),
    ).join(totals, doc)
    label = T.batch_label(F.col("first") + 1, F.col("last") + 1, F.col("pages"))
    return grouped.select(
        doc, "batch", F.ceil(F.col("pages") / size).cast("int").alias("batch_total"), F.xxhash64(doc, "batch").alias("call_id"),
        F.concat(F.lit(prompt or ""), F.lit("\n\n【当前批次: "), label, F.lit("】")).alias("prompt"), "images", T.failure_placeholder(F.col("first") + 1, F.col("last") + 1).alias("placeholder"),
    )


def recognise(pages: DataFrame, doc: str, page: str, image: str, config: dict, transport: connectors.Transport, key: str | None = None, skip: Iterable[str] | str | None = None, **options) -> DataFrame:
    """(doc, raw_text, text_out, failed): ``failed`` batches left their placeholder.  Calls are made once: their replies are materialised."""
    if connectors.result_form(config) != "chat":
        raise ValueError("services with jobs are submitted and polled, not called")
    planned = cut(call_batches(pages, doc, page, image, config.get("batch_size") or 1, config.get("prompt_text")))
    replies = cut(connectors.call_model(planned, config, transport, key, **options))
    called = planned.select(doc, "batch", "batch_total", "call_id").join(replies, "call_id").withColumn("number", F.col("batch") + 1)
    raw = batches.raw_text(called, doc, "number", "batch_total", "text")
    joined = batches.join_texts(called, doc, "number", "text")
    failed = called.groupBy(doc).agg(F.count("error").alias("failed"))
    return refine(joined.join(raw, doc).join(failed, doc), "full_text", skip=skip).select(doc, "raw_text", "text_out", "failed")


def save(recognised: DataFrame, doc: str, model_key: str, folder: str) -> int:
    """``{base}_{model}_raw.txt`` and ``{base}_{model}.txt`` of each document; the number of files."""
    done = cut(recognised)
    return files.write_texts(done, doc, "raw_text", folder, f"{model_key}_raw") + files.write_texts(done, doc, "text_out", folder, model_key)
