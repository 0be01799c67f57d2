"""Queries of the problems of this package and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import language, leakage, lines, markup, mixture, repetition, scan_noise, truncation, truncation_oracle, twins
from quirefold.runtime import read_table, spread


def language_samples(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The fixed table of labelled samples; the dictionaries of problem 10 are fitted on at most ``MAX_SAMPLES`` rows."""
    rows = read_table(spark, sf_dir, "lang_samples").select("lang", "text").orderBy("sample_id").limit(MAX_SAMPLES).collect()
    return [(r[0], r[1]) for r in rows]


#: documented bound of the labelled rows that language dictionaries are fitted on
MAX_SAMPLES = 20_000


def p1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spread(read_table(spark, sf_dir, "llm_ocr"))
    references = repetition.references(read_table(spark, sf_dir, "lang_samples"))
    return repetition.measure(calls, F.col("call_id"), F.col("content"), references).withColumnRenamed("row_id", "call_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the distances decide nothing here (README, problem 1)
    calls = spread(read_table(spark, sf_dir, "llm_ocr"))
    return repetition.measure(calls, F.col("call_id"), F.col("content")).where(F.col("share") >= 0.3).select(F.col("row_id").alias("call_id"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(spread(read_table(spark, sf_dir, "documents")), F.col("doc_id"), F.col("text"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, job_id, label, text) of both text tables."""
    calls = read_table(spark, sf_dir, "llm_ocr").select(F.lit("llm_ocr").alias("src_table"), F.col("call_id").alias("row_id"), "source", "job_id", F.lit("text").alias("label"), F.col("content").alias("text"))
    blocks = read_table(spark, sf_dir, "parsing_res_list").select(
        F.lit("parsing_res_list").alias("src_table"), F.col("block_id").alias("row_id"), "source", "job_id", F.coalesce("block_label", F.lit("text")).alias("label"), F.col("block_content").alias("text")
    )
    return spread(calls.unionByName(blocks))


KEYS = ["src_table", "row_id"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.pieces_of_markup(texts(spark, sf_dir), KEYS, "source", "text").select(*KEYS).distinct()


def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.templates(texts(spark, sf_dir), KEYS, "source", "text")


def p2_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.slots(texts(spark, sf_dir), KEYS, "source", "text")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(texts(spark, sf_dir), KEYS, "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.twins(texts(spark, sf_dir), "src_table", "row_id", "text")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.twin_classes(texts(spark, sf_dir), "src_table", "row_id", "text")


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.canonical(texts(spark, sf_dir), ["src_table", "row_id"], "text")


def p5_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judge(spread(read_table(spark, sf_dir, "llm_ocr")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_calls(spark, sf_dir).where("is_cut").select("call_id")


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.per_source(p5_calls(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str):
    blocks = spread(read_table(spark, sf_dir, "parsing_res_list"))
    return blocks, *lines.excessive(blocks, F.col("block_id"), F.col("source"), F.col("job_id"), F.col("block_content"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)[2].select(F.col("row_id").alias("block_id"), "line_no")


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)[1]


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, confirmed, _ = _lines(spark, sf_dir)
    return lines.remove(blocks.select("block_id", "source", "block_content"), "source", "block_content", confirmed).select("block_id", "clean_text")


def _scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls and body-text blocks, jobs, blocks."""
    body = texts(spark, sf_dir).where("label = 'text'").select("src_table", "row_id", "job_id", "text")
    jobs, blocks = read_table(spark, sf_dir, "ocr_jobs"), read_table(spark, sf_dir, "parsing_res_list")
    return body, jobs.select("job_id", "title"), blocks.select("job_id", "block_label", "block_content")


def p7_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.inspected(*_scanned(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_noise(spark, sf_dir).where("broken + blots + misread + heads + numbers > 0").select("src_table", "row_id")


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired(*_scanned(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return mixture.mix(docs, F.col("doc_id"), F.col("text"), F.col("source"), read_table(spark, sf_dir, "source_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return language.documents(docs, F.col("doc_id"), F.col("text"), F.col("lang"), language_samples(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.relabelled(p10_documents(spark, sf_dir))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(spread(read_table(spark, sf_dir, "documents")), F.col("doc_id"), F.col("text"), language_samples(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_repetition": p1_repetition,
    "p2_found": p2_found,
    "p2_templates": p2_templates,
    "p2_slots": p2_slots,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p3_canonical": p3_canonical,
    "p5_found": p5_found,
    "p5_calls": p5_calls,
    "p5_sources": p5_sources,
    "p6_found": p6_found,
    "p6_lines": p6_lines,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p7_noise": p7_noise,
    "p7_repaired": p7_repaired,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_documents": p10_documents,
    "p10_segments": p10_segments,
}
_LINES = r"""
WITH l AS (
  SELECT block_id, source, job_id, unnest(string_split(block_content, chr(10))) AS line,
         CAST(unnest(range(1, len(string_split(block_content, chr(10))) + 1)) AS INT) AS line_no
  FROM parsing_res_list WHERE block_content IS NOT NULL
), n AS (
  SELECT block_id, source, job_id, line_no,
         regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS norm
  FROM l WHERE length(regexp_replace(line, '\r$', '')) >= 20
), j AS (SELECT source, count(DISTINCT job_id) AS jobs FROM parsing_res_list GROUP BY source
), c AS (
  SELECT source, norm, count(DISTINCT job_id) AS in_jobs, count(*) AS occurrences FROM n WHERE norm <> '' GROUP BY source, norm
), k AS (
  SELECT source, norm, in_jobs, jobs, occurrences FROM c JOIN j USING (source) WHERE in_jobs >= 4 AND in_jobs * 20 >= jobs
)
""".replace("\\\\", "\\")
_JUDGED = truncation_oracle.SQL
ORACLE: dict[str, str] = {
    "p5_found": f"SELECT call_id FROM ({_JUDGED}) WHERE is_cut",
    "p5_calls": _JUDGED,
    "p5_sources": f"SELECT coalesce(source, '') AS source, count(*) AS calls, count(*) FILTER (WHERE is_cut) AS cut_calls, count(*) FILTER (WHERE is_cut) / count(*) AS cut_share FROM ({_JUDGED}) GROUP BY 1",
    "p6_found": _LINES + "SELECT block_id, line_no FROM n JOIN k USING (source, norm)",
    "p6_clean": _LINES.rstrip().rstrip("\n") + r"""
, a AS (SELECT block_id, unnest(string_split(block_content, chr(10))) AS line, unnest(range(1, len(string_split(block_content, chr(10))) + 1)) AS line_no FROM parsing_res_list WHERE block_content IS NOT NULL
), gone AS (SELECT DISTINCT block_id, line_no FROM n JOIN k ON n.source IS NOT DISTINCT FROM k.source AND n.norm = k.norm
), kept AS (SELECT block_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM a ANTI JOIN gone USING (block_id, line_no) GROUP BY block_id)
SELECT p.block_id, CASE WHEN block_content IS NOT NULL THEN coalesce(t, '') END AS clean_text FROM parsing_res_list p LEFT JOIN kept USING (block_id)""",
    "p6_lines": _LINES + "SELECT source, norm, in_jobs, jobs, occurrences FROM k",
}
