"""The refinement pipeline: nine steps in a fixed order, each of which can be left out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T

#: step names in the order in which they apply; the order is part of the result
STEPS = {
    "ocr_grounding": T.remove_grounding,
    "dedup": T.remove_overlaps,
    "batch_markers": T.remove_batch_markers,
    "page_markers": T.remove_page_markers,
    "empty_lines": T.merge_empty_lines,
    "whitespace": T.strip_line_ends,
    "paragraph_merge": T.merge_paragraphs,
    "fullwidth_punct": T.full_width_punctuation,
    "interspaced_spaces": T.remove_interspersed_spaces,
}


def skip_list(names: str | Iterable[str] | None) -> set[str]:
    """Step names from a comma-separated list; unknown names are ignored."""
    parts = names.split(",") if isinstance(names, str) else list(names or ())
    return {p.strip() for p in parts} & set(STEPS)


def refine(df: DataFrame, text: str, out: str = "text_out", skip: str | Iterable[str] | None = None) -> DataFrame:
    """Adds the refined text.

    Every step is a projection of its own: steps use their input more than once, and nesting them in one expression would
    work out each input again for every use.
    """
    left_out = skip_list(skip)
    df = df.withColumn(out, F.col(text))
    for name, step in STEPS.items():
        if name not in left_out:
            df = df.withColumn(out, step(F.col(out)))
    return df
