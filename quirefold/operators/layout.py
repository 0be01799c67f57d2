"""Layout blocks: filters, gaps between blocks, anchors of gaps.

Gaps are windows over one page (document and page index), so no window grows with the document.  Defined results: blocks
with an ignored label, a short or null box or blank content don't count; a missing label means ``text``; pages with one block
have no gap; a median of 0 falls back to the mean, and a mean of 0 to 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions.patterns import IGNORED_LABELS

MULTIPLIER, FALLBACK_GAP, ANCHOR = 4.0, 10.0, 80


def body_blocks(df: DataFrame) -> DataFrame:
    """Blocks that count, with ``content``, ``y1`` and ``y2``.  ``df`` has block_label, block_bbox, block_content."""
    label = F.coalesce("block_label", F.lit("text"))
    # blank content has nothing left after its tags are stripped either
    kept = df.where(~label.isin(*IGNORED_LABELS) & (F.size("block_bbox") >= 4) & F.col("block_content").isNotNull())
    placed = kept.withColumn("content", T.strip_tags(F.col("block_content"))).withColumn("y1", F.col("block_bbox")[1]).withColumn("y2", F.col("block_bbox")[3])
    return placed.where("content <> '' AND y1 IS NOT NULL AND y2 IS NOT NULL")


def gaps(df: DataFrame, page: list[str], order: str, multiplier: float = MULTIPLIER) -> DataFrame:
    """Gaps larger than ``multiplier`` times the median gap of their page, with the anchors on both sides."""
    down = Window.partitionBy(*page).orderBy("y1", order)
    on_page = Window.partitionBy(*page)
    spaced = (
        body_blocks(df)
        .select(*page, order, "content", "y1", "y2")
        .withColumn("gap", F.lead("y1").over(down) - F.col("y2"))
        .withColumn("next_content", F.lead("content").over(down))
        .withColumn("usual", F.coalesce(F.nullif(F.median("gap").over(on_page), F.lit(0.0)), F.nullif(F.avg("gap").over(on_page), F.lit(0.0)), F.lit(FALLBACK_GAP)))
    )
    return spaced.where(F.col("gap") > F.col("usual") * multiplier).select(
        *page, order, "gap", "usual", F.right("content", F.lit(ANCHOR)).alias("prev_tail"), F.left("next_content", F.lit(ANCHOR)).alias("next_head")
    )
