"""Queries of problem 4: nested records to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import nesting
from quirefold.runtime import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.block_positions(read_table(spark, sf_dir, "layout_results"), F.col("record_id"), F.col("payload"))


def _table(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nesting.flat_tables(read_table(spark, sf_dir, "layout_results"), F.col("record_id"), F.col("payload"))[name]

    return query


QUERIES = {"p4_found": p4_found, "p4_records": _table("records"), "p4_pages": _table("pages"), "p4_blocks": _table("blocks"), "p4_boxes": _table("boxes")}

_PAGES = """
WITH r AS (
  SELECT record_id, payload::JSON AS j FROM layout_results WHERE payload IS NOT NULL AND json_valid(payload)
), lists AS (
  SELECT record_id,
         CASE
           WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]')
           WHEN json_type(j, '$.pages') = 'ARRAY' THEN json_extract(j, '$.pages[*].result.layoutParsingResults[*]')
           WHEN json_type(j, '$.result.layoutParsingResults') = 'ARRAY' THEN json_extract(j, '$.result.layoutParsingResults[*]')
           WHEN json_type(j, '$.layoutParsingResults') = 'ARRAY' THEN json_extract(j, '$.layoutParsingResults[*]')
           ELSE [j]
         END AS entries
  FROM r
), p AS (
  SELECT record_id, unnest(entries) AS e, CAST(unnest(range(len(entries))) AS INT) AS page_no FROM lists
), b AS (
  SELECT record_id, page_no,
         COALESCE(json_extract(e, '$.prunedResult.parsing_res_list[*]'), []) || COALESCE(json_extract(e, '$.parsing_res_list[*]'), []) AS bs
  FROM p
)
"""
ORACLE = {
    "p4_found": _PAGES
    + """SELECT record_id, page_no, block_no FROM (
  SELECT record_id, page_no, unnest(bs) AS x, CAST(unnest(range(len(bs))) AS INT) AS block_no FROM b)
WHERE x IS NOT NULL AND json_type(x) <> 'NULL'"""
}
