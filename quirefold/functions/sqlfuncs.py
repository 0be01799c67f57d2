"""The text operators as functions of the SQL language.

They are SQL-bodied temporary functions: calls are inlined into the plan, no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quirefold.functions.patterns import BATCH_MARKER, GROUNDING, HAN, PAGE_MARKER, WIDE, WS


def _raw(pattern: str) -> str:
    return "r'" + pattern + "'"


#: name -> (parameters, result type, body)
FUNCTIONS = {
    "qf_strip": ("t STRING", "STRING", f"regexp_replace(t, {_raw(rf'\A{WS}+|{WS}+\z')}, '')"),
    "qf_remove_grounding": ("t STRING", "STRING", f"regexp_replace(t, {_raw(GROUNDING)}, '')"),
    "qf_remove_page_markers": ("t STRING", "STRING", f"regexp_replace(t, {_raw(PAGE_MARKER)}, '\\n\\n')"),
    "qf_remove_batch_markers": ("t STRING", "STRING", f"regexp_replace(t, {_raw(BATCH_MARKER)}, '')"),
    "qf_merge_empty_lines": ("t STRING", "STRING", "CASE WHEN contains(t, '\\r\\n') THEN regexp_replace(t, '(\\r\\n){2,}', '\\r\\n') ELSE regexp_replace(t, '\\n{2,}', '\\n') END"),
    "qf_remove_interspersed_spaces": ("t STRING", "STRING", f"regexp_replace(t, {_raw(rf'\A +| +\z|(?<=[{WIDE}]) +| +(?=[{WIDE}])|(?<=[0-9]) +(?=[0-9])')}, '')"),
    "qf_double_quotes": ("t STRING", "STRING", "replace(regexp_replace(t, '\"([^\"\\n]*)\"', '“$1”'), '\"', '“')"),
    "qf_has_han": ("t STRING", "BOOLEAN", f"rlike(t, {_raw(f'[{HAN}]')})"),
    "qf_flat_position": ("t STRING, p INT", "INT", "char_length(replace(left(t, p), '\\n', ''))"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
