"""Flatten deeply nested JSON records into related tables linked by interval labels.

Every node of a payload gets a pre-order and a post-order number from one depth-first
traversal.  Node ``a`` lies inside node ``b`` of the same record exactly when
``b.pre < a.pre and a.post < b.post``, so parent-child links at any distance are range
conditions on numbers; no path strings are needed.

The traversal is row-local (Arrow batches, no shuffle).  Linking pages to blocks is one
window over the record, which costs one exchange on the record key.

Defined results for odd input
-----------------------------
* null, empty or broken payload: one ``record`` node with ``valid = false``, nothing else;
  ``NaN``/``Infinity`` are not JSON and count as broken;
* null list elements keep their position but make no node in the per-type tables;
* duplicate keys in one object: the last one counts;
* repeated rows with one key keep apart only if the key is unique, as for any key;
* extra columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "record_id bigint, kind string, name string, ordinal int, pre bigint, post bigint, "
    "parent_pre bigint, depth int, valid boolean, value string"
)
#: node types that become tables of their own; all other nodes are ``field``
TYPES = ("record", "page", "block", "box")
PAGE_LIST, BLOCK_LIST = "layoutParsingResults", "parsing_res_list"
BOX_NAMES = ("block_bbox", "coordinate", "bbox")


def _reject(token: str):
    raise ValueError(f"{token} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_reject)


def traverse(payload: str | None) -> list[tuple]:
    """All nodes of one payload: (kind, name, ordinal, pre, post, parent_pre, depth, valid, node)."""
    try:
        root = _DECODER.decode(payload)
    except (ValueError, TypeError, RecursionError):
        return [("record", None, None, 0, 0, None, 0, False, None)]
    out: list[list] = []
    post = 0
    # a frame: node, kind, name, ordinal, parent row, depth; closed frames come back as the row number
    stack: list = [(root, "record", None, None, None, 0)]
    while stack:
        frame = stack.pop()
        if isinstance(frame, int):
            out[frame][4] = post
            post += 1
            continue
        node, kind, name, ordinal, parent, depth = frame
        row = len(out)
        out.append([kind, name, ordinal, row, -1, parent, depth, True, node])
        stack.append(row)
        if isinstance(node, dict):
            for key in reversed(node):
                value = node[key]
                child = "box" if key in BOX_NAMES and isinstance(value, list) and value else "field"
                stack.append((value, child, key, None, row, depth + 1))
        elif isinstance(node, list):
            if name == PAGE_LIST:
                child = "page"
            elif name == BLOCK_LIST:
                child = "block"
            else:
                child = "entry" if parent is None else "field"
            for i in range(len(node) - 1, -1, -1):
                stack.append((node[i], child, name, i, row, depth + 1))
    # entries of a top-level list are the pages of a record that has no page list
    fallback = not any(r[0] == "page" for r in out)
    for r in out:
        if r[0] == "entry":
            r[0] = "page" if fallback else "field"
    return [tuple(r) for r in out]


def _text(node) -> str | None:
    if node is None or isinstance(node, str):
        return node
    return json.dumps(node, ensure_ascii=False, separators=(",", ":"))


def label_nodes(df: DataFrame, key: Column, payload: Column, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Node table of all records.  ``kinds`` restricts which node types leave the traversal."""
    keep = None if kinds is None else frozenset(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for record_id, text in zip(batch["record_id"], batch["payload"]):
                for kind, name, ordinal, pre, post, parent, depth, valid, node in traverse(text):
                    if kind == "block" and node is None:
                        continue
                    if keep is None or kind in keep:
                        inner = kind == "record" or (kind == "field" and isinstance(node, (dict, list)))
                        rows.append((record_id, kind, name, ordinal, pre, post, parent, depth, valid, None if inner else _text(node)))
            yield pd.DataFrame(rows, columns=columns).astype({"ordinal": "Int32", "parent_pre": "Int64", "depth": "Int32"})

    return df.select(key.cast("bigint").alias("record_id"), payload.alias("payload")).mapInPandas(run, NODE_SCHEMA)


def with_pages(nodes: DataFrame) -> DataFrame:
    """Blocks and boxes with the number of the page that contains them (interval containment).

    Pages nested in another page are part of the outer one.  A block outside any page
    belongs to page 0: the record is then itself one page.
    """
    by_pre = Window.partitionBy("record_id").orderBy("pre")
    before = by_pre.rowsBetween(Window.unboundedPreceding, -1)
    is_page = F.col("kind") == "page"
    outer = is_page & (F.coalesce(F.max(F.when(is_page, F.col("post"))).over(before), F.lit(-1)) < F.col("post"))
    marked = nodes.where(F.col("kind").isin("page", "block", "box")).withColumn("is_outer", outer)
    seen = by_pre.rowsBetween(Window.unboundedPreceding, 0)
    open_page = F.last(F.when(F.col("is_outer"), F.struct("pre", "post")), ignorenulls=True).over(seen)
    number = F.sum(F.col("is_outer").cast("int")).over(seen) - 1
    inside = (F.col("open_page.pre") <= F.col("pre")) & (F.col("post") <= F.col("open_page.post"))
    return (
        marked.withColumn("open_page", open_page)
        .withColumn("page_no", F.when(inside, number).otherwise(F.lit(0)).cast("int"))
        .withColumn("page_pre", F.when(inside, F.col("open_page.pre")))
        .drop("open_page")
    )


def block_positions(df: DataFrame, key: Column, payload: Column) -> DataFrame:
    """(record_id, page_no, block_no) of every non-null block of every valid payload."""
    paged = with_pages(label_nodes(df, key, payload, ("page", "block")))
    return paged.where(F.col("kind") == "block").select("record_id", "page_no", F.col("ordinal").alias("block_no"))


def flat_tables(df: DataFrame, key: Column, payload: Column) -> dict[str, DataFrame]:
    """The four related tables; every child row carries its record, page and block keys."""
    nodes = label_nodes(df, key, payload, TYPES)
    paged = with_pages(nodes)
    records = nodes.where(F.col("kind") == "record").select("record_id", "pre", "post", "valid")
    pages = paged.where(F.col("is_outer")).select("record_id", "page_no", "pre", "post", F.length("value").alias("page_chars"))
    blocks = paged.where(F.col("kind") == "block").select(
        "record_id",
        "page_no",
        F.col("ordinal").alias("block_no"),
        "pre",
        "post",
        F.get_json_object("value", "$.block_label").alias("block_label"),
        F.get_json_object("value", "$.block_content").alias("block_content"),
    )
    by_pre = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    holder = F.last(F.when(F.col("kind") == "block", F.struct("pre", "post", "ordinal")), ignorenulls=True).over(by_pre)
    boxes = (
        paged.where(F.col("kind").isin("block", "box"))
        .withColumn("holder", holder)
        .where(F.col("kind") == "box")
        .select(
            "record_id",
            "page_no",
            F.when(F.col("post") < F.col("holder.post"), F.col("holder.ordinal")).alias("block_no"),
            F.col("name").alias("box_name"),
            "pre",
            "post",
            F.from_json("value", "array<double>").alias("coordinates"),
        )
    )
    return {"records": records, "pages": pages, "blocks": blocks, "boxes": boxes}
