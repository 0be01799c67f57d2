"""Queries of the refinement, layout, payload, alignment, metadata and registry operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import sqlfuncs
from quirefold.functions import text as T
from quirefold.operators import align, batches, jobs, layout, metadata, registry
from quirefold.plans import pipeline
from quirefold.runtime import broadcast_if_small, cut, read_table, spread
from quirefold.sources import files, payloads


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "llm_ocr").select("call_id", "job_id", "batch_no", "batch_total", "content", "received_at"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "parsing_res_list"))


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each batch of each job."""
    rows = read_table(spark, sf_dir, "llm_ocr").select("call_id", "job_id", "batch_no", "batch_total", "content")
    return batches.latest(rows, ["job_id", "batch_no"], ["call_id"])


def _on_calls(step):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return calls(spark, sf_dir).select("call_id", step(F.col("content")).alias("text_out"))

    return query


def _on_docs(step):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", step(F.col("text")).alias("text_out"))

    return query


def refine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.refine(docs(spark, sf_dir), "text").select("doc_id", "text_out")


def refine_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = pipeline.refine(docs(spark, sf_dir), "text", skip="paragraph_merge, fullwidth_punct, unknown")
    return skipped.select("doc_id", "text_out")


def refine_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.refine(calls(spark, sf_dir), "content").select("call_id", "text_out")


def dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.trim_overlaps(delivered(spark, sf_dir).where("content IS NOT NULL"), "job_id", "batch_no", "content").select("job_id", "batch_no", "trimmed")


def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = batches.trim_overlaps(delivered(spark, sf_dir).where("content IS NOT NULL"), "job_id", "batch_no", "content")
    return batches.join_texts(trimmed, "job_id", "batch_no", "trimmed")


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.raw_text(delivered(spark, sf_dir), "job_id", "batch_no", "batch_total", "content")


def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing replies replaced by the placeholder of their pages."""
    rows = read_table(spark, sf_dir, "llm_ocr")
    first = F.regexp_extract("batch_info", r"第([0-9]+)-", 1).try_cast("int")
    last = F.regexp_extract("batch_info", r"-([0-9]+)页", 1).try_cast("int")
    return rows.select("call_id", F.coalesce("content", T.failure_placeholder(F.coalesce(first, "batch_no"), F.coalesce(last, "batch_no"))).alias("text_out"))


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each job in batches of five, with their labels."""
    pages = read_table(spark, sf_dir, "parsing_res_list").select("job_id", "page_index").distinct()
    return batches.batch_pages(pages, "job_id", "page_index", 5)


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of raw texts whose page headers have rules of full width."""
    wide = F.regexp_replace("content", r"(?md)^={10,}[ \t]*$", "=" * 60)
    return batches.raw_pages(calls(spark, sf_dir).where("content IS NOT NULL").select("call_id", wide.alias("content")), "call_id", "content")


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).select("call_id", T.strip_artifacts(F.col("content")).alias("clean"))
    a = T.anchors(F.col("clean"))
    return rows.select("call_id", a["head"].alias("head"), a["tail"].alias("tail"), F.char_length(T.flat(F.col("clean"))).alias("flat_chars"))


def flat_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every full stop of a document with its position in the text without line feeds."""
    rows = docs(spark, sf_dir).select("doc_id", "text", F.explode(T.find_all(F.col("text"), F.lit("\n"))).alias("position"))
    return rows.select("doc_id", "position", T.flat_position(F.col("text"), F.col("position")).alias("flat_position"))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_blocks(layout_rows(spark, sf_dir)).select("block_id", "content", "y1", "y2")


def layout_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiplier 1.5: boxes of these records are set evenly, so that the usual 4 would find little."""
    return layout.gaps(layout_rows(spark, sf_dir), ["job_id", "page_index"], "block_id", 1.5)


def _anchors_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of each block of running text, and the beginning of the next one on its page."""
    rows = layout.body_blocks(layout_rows(spark, sf_dir)).where("coalesce(block_label, 'text') = 'text'")
    order = Window.partitionBy("job_id", "page_index").orderBy("y1", "block_id")
    narrow = rows.select("job_id", "page_index", "block_id", "y1", F.right("content", F.lit(80)).alias("prev_tail"), F.left("content", F.lit(80)).alias("head"))
    return narrow.withColumn("next_head", F.lead("head").over(order)).where("next_head IS NOT NULL").select("job_id", "page_index", "block_id", "prev_tail", "next_head")


def _joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of jobs from their blocks of running text."""
    rows = layout.body_blocks(layout_rows(spark, sf_dir)).where("coalesce(block_label, 'text') = 'text'")
    return batches.join_texts(rows.withColumn("k", F.struct("page_index", "y1", "block_id")), "job_id", "k", "content", " ", "proof")


def exact_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that stand exactly in the text of their job, with the place between them."""
    pairs = _anchors_of_jobs(spark, sf_dir).join(_joined_blocks(spark, sf_dir), "job_id")
    place = align.exact_position(F.col("proof"), F.col("prev_tail"), F.col("next_head"))
    return pairs.select("job_id", "block_id", place.cast("int").alias("place"))


def _proof_breaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Refined texts of jobs, and the places in them of the ends of the raw blocks."""
    proof = cut(pipeline.refine(spread(_joined_blocks(spark, sf_dir)), "proof", "refined", skip="dedup").select("job_id", "refined"))
    return proof, align.place_breaks(proof, _anchors_of_jobs(spark, sf_dir), "job_id", "refined", "block_id")


def break_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the end of each raw block in the refined text of its job, exact or similar; -1 where none fits."""
    return _proof_breaks(spark, sf_dir)[1]


def aligned_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined texts of jobs with a line break at the end of each raw block."""
    proof, found = _proof_breaks(spark, sf_dir)
    listed = found.groupBy("job_id").agg(F.array_sort(F.collect_set(F.when(F.col("place") >= 0, F.col("place")))).alias("places"))
    return proof.join(listed, "job_id").select("job_id", F.size("places").alias("inserted"), align.insert_breaks(F.col("refined"), F.col("places")).alias("text_out"))


def aligned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of raw replies in the refined text of their job."""
    pages = delivered(spark, sf_dir).where("content IS NOT NULL").select("job_id", "batch_no", "content")
    texts = pipeline.refine(spread(batches.join_texts(pages, "job_id", "batch_no", "content")), "full_text", "refined")
    return align.page_spans(texts.select("job_id", "refined"), pages, "job_id", "refined", "batch_no", "content")


def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page break element at the start of every line."""
    starts = F.concat(F.array(F.lit(0)), F.transform(T.find_all(F.col("text"), F.lit("\n")), lambda p: p + 1))
    found = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", starts.alias("starts"))
    return found.select("doc_id", align.insert_page_marks(F.col("text"), F.col("starts")).alias("text_out"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "layout_results").select("record_id", "job_id", "line_no", "payload")


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page index and texts of each layout line of a job, in the order of lines and records."""
    rows = _records(spark, sf_dir).withColumn("line", F.struct("line_no", "record_id"))
    return payloads.layout_pages(rows, "job_id", "line", "payload").select("job_id", F.col("line.record_id").alias("record_id"), "page_index", "n_texts", "text")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("line", F.struct("line_no", "record_id"))
    return payloads.line_pages(rows, "job_id", "line", "payload")


def envelope_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.envelope_pages(_records(spark, sf_dir), "record_id", "payload").select("record_id", "form", "page_ix", F.get_json_object("page", "$.width").try_cast("int").alias("width"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delivered(spark, sf_dir).where("content IS NOT NULL").join(jobs_models(spark, sf_dir), "job_id", "left")
    return payloads.envelope(rows, "job_id", "file_name", "model_key", "batch_no", "content")


def jobs_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "ocr_jobs").groupBy("job_id").agg(F.max("file_name").alias("file_name"), F.max("model_key").alias("model_key"))


def stream_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as event streams of one line a piece, put together again."""
    words = F.split("content", "(?<= )")
    delta = lambda x: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))))
    lines = F.concat(F.array(F.lit(": keep-alive"), F.lit("data: no json")), F.transform(words, delta), F.array(F.lit("data: [DONE]"), delta(F.lit("after the end"))))
    events = calls(spark, sf_dir).where("content <> ''").select("call_id", F.posexplode(lines).alias("seq", "line"))
    return payloads.stream_deltas(events, "call_id", "seq", "line")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata replies with none, one or two marks, made from the documents."""
    head = F.concat(F.lit("---\ntitle: "), F.coalesce("title", F.lit("")), F.lit("\n# note\nsource: "), F.col("source"), F.lit("\n"), F.when(F.col("doc_id") % 5 == 0, F.lit("author: x\n")).otherwise(F.lit("")))
    reply = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("note\n"), head)).otherwise(F.concat(head, F.lit("---\n\n "), F.col("text")))
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "title", "source")).select("doc_id", T.strip(reply).alias("reply"))


def metadata_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _replies(spark, sf_dir).withColumn("x", metadata.split_stripped(F.col("reply"))).select("doc_id", F.col("x.yaml").alias("yaml"), F.col("x.copyright").alias("copyright"))
    checked = split.withColumn("v", metadata.validate(F.col("yaml")))
    return checked.select("doc_id", "yaml", "copyright", F.col("v.valid").alias("valid"), F.col("v.hint").alias("hint"), metadata.field_count(F.col("yaml")).alias("fields"), metadata.with_header(F.col("yaml")).alias("completed"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_polls(read_table(spark, sf_dir, "ocr_jobs"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "ocr_jobs").select("poll_id", "file_name", "json_url")
    return rows.select("poll_id", T.input_kind(F.col("file_name")).alias("kind"), T.submit_kind(F.col("json_url")).alias("submit"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page specifications of three forms against the pages of each poll."""
    rows = read_table(spark, sf_dir, "ocr_jobs").where("total_pages IS NOT NULL").select("poll_id", "total_pages")
    n = F.col("poll_id")
    spec = F.when(n % 3 == 0, F.lit(None).cast("string")).when(n % 3 == 1, (n % 7).cast("string")).otherwise(F.concat((n % 4).cast("string"), F.lit("-"), (n % 40).cast("string")))
    x = T.page_range(spec, F.col("total_pages"))
    return rows.select("poll_id", x["first"].alias("first"), x["last"].alias("last"))


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members to read of archives whose names are those of the files of each job."""
    names = read_table(spark, sf_dir, "ocr_jobs").where("file_name IS NOT NULL").select("job_id", "poll_id", F.concat(F.when(F.col("poll_id") % 2 == 0, F.lit("content/full")).otherwise(F.col("file_name")), F.element_at(F.array(F.lit(".md"), F.lit(".json"), F.lit(".png")), (F.col("poll_id") % 3 + 1).cast("int"))).alias("name"))
    listed = names.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("poll_id", "name"))), lambda x: x["name"]).alias("names"))
    x = files.choose_members(F.col("names"))
    return listed.select("job_id", x["md"].alias("md"), x["json"].alias("json"))


def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.auth(read_table(spark, sf_dir, "model_configs"))
    split = registry.split_parameters(F.col("payload_template"))
    return rows.select(
        "model_key", "no_auth", "n_headers", F.coalesce("prompt_text", F.lit("")).alias("prompt"), registry.base_url(F.col("api_url")).alias("base_url"),
        F.array_join(F.array_sort(F.map_keys(split["arguments"])), ",").alias("arguments"), F.array_join(F.array_sort(F.map_keys(split["body"])), ",").alias("body"),
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies of one message a model, read again: members, model, and the text of the message."""
    text = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("prompt_text", F.lit("")).alias("content"))))
    rows = read_table(spark, sf_dir, "model_configs").select("model_key", registry.request_body(F.col("model_id"), F.col("payload_template"), text).alias("body"))
    return rows.select(
        "model_key", F.array_join(F.array_sort(F.json_object_keys("body")), ",").alias("members"), F.get_json_object("body", "$.model").alias("model"),
        F.get_json_object("body", "$.messages[0].content").alias("prompt"), F.get_json_object("body", "$.max_tokens").try_cast("int").alias("max_tokens"),
    )


def model_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in configurations overridden by external ones of the same key."""
    rows = read_table(spark, sf_dir, "model_configs").select("model_key", "display_name", "batch_size", "timeout_s")
    external = rows.where("batch_size > 1").withColumn("display_name", F.concat(F.lit("external "), "display_name"))
    return registry.layered(rows, external)


def model_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters per model configuration; unknown keys under their own name."""
    totals = read_table(spark, sf_dir, "documents").groupBy("model_key").agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("chars"))
    configs = broadcast_if_small(read_table(spark, sf_dir, "model_configs").select("model_key", "content_format"))
    return totals.join(configs, "model_key", "left").select("model_key", "content_format", "documents", "chars")


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies, batches, pages, missing replies and characters of each source, before and after refinement."""
    rows = spread(read_table(spark, sf_dir, "llm_ocr").select("call_id", "source", "job_id", "content"))
    refined = pipeline.refine(rows, "content")
    return refined.groupBy("source").agg(
        F.count("*").alias("calls"), F.count_distinct("job_id").alias("jobs"), F.count_if(F.col("content").isNull()).alias("missing"),
        F.sum(F.char_length("content")).alias("chars_in"), F.sum(F.char_length("text_out")).alias("chars_out"), F.max(T.one_line(F.left("content", F.lit(30)))).alias("preview"),
    )


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfuncs.register(spark)
    read_table(spark, sf_dir, "llm_ocr").createOrReplaceTempView("qf_llm_ocr")
    return spark.sql("SELECT call_id, qf_double_quotes(qf_merge_empty_lines(qf_remove_batch_markers(content))) AS text_out, qf_has_han(content) AS has_han FROM qf_llm_ocr")


QUERIES = {
    "refine": refine_documents,
    "refine_skipping": refine_skipping,
    "refine_calls": refine_calls,
    "remove_grounding": _on_calls(T.remove_grounding),
    "remove_page_markers": _on_calls(T.remove_page_markers),
    "remove_batch_markers": _on_docs(T.remove_batch_markers),
    "merge_empty_lines": _on_calls(T.merge_empty_lines),
    "strip_line_ends": _on_calls(T.strip_line_ends),
    "remove_interspersed_spaces": _on_calls(T.remove_interspersed_spaces),
    "single_quotes": _on_docs(T.single_quotes),
    "double_quotes": _on_docs(T.double_quotes),
    "basic_punctuation": _on_docs(T.basic_punctuation),
    "full_width_punctuation": _on_calls(T.full_width_punctuation),
    "merge_paragraphs": _on_calls(T.merge_paragraphs),
    "remove_overlaps": _on_docs(T.remove_overlaps),
    "strip_tags": _on_calls(T.strip_tags),
    "dedup_batches": dedup_batches,
    "full_texts": full_texts,
    "raw_texts": raw_texts,
    "batch_failures": batch_failures,
    "batch_plan": batch_plan,
    "raw_pages": raw_pages,
    "page_anchors": page_anchors,
    "flat_positions": flat_positions,
    "layout_blocks": layout_blocks,
    "layout_gaps": layout_gaps,
    "exact_breaks": exact_breaks,
    "break_places": break_places,
    "aligned_breaks": aligned_breaks,
    "aligned_pages": aligned_pages,
    "page_marks": page_marks,
    "layout_lines": layout_lines,
    "text_lines": text_lines,
    "envelope_pages": envelope_pages,
    "envelopes": envelopes,
    "stream_texts": stream_texts,
    "metadata_replies": metadata_replies,
    "job_progress": job_progress,
    "file_kinds": file_kinds,
    "page_ranges": page_ranges,
    "archive_members": archive_members,
    "model_requests": model_requests,
    "request_bodies": request_bodies,
    "model_layers": model_layers,
    "model_of_documents": model_of_documents,
    "text_report": text_report,
    "sql_functions": sql_functions,
}
