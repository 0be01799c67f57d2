"""Files to rows and rows to files: texts, scans, result archives, refined texts."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T

SCAN_PATTERN = "*.{pdf,jpg,jpeg,png,bmp,tif,tiff,webp}"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files, line ends as line feeds."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content) of the scans of a folder; kind is null for files that are none."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", SCAN_PATTERN).load(path)
    return rows.select("path", T.input_kind(F.col("path")).alias("kind"), "length", "content")


def render_pages(scans: DataFrame, renderer: Callable[[bytes, str, int, int], Iterator[bytes]], dpi: int = 300, max_width: int = 1600) -> DataFrame:
    """(path, page_no, content, error): one row a page.

    ``renderer(content, kind, dpi, max_width)`` yields the pages of a file; it is a parameter because rasterising needs a
    library of the site's choice.  A file that fails gives one row with its error and stops nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
                try:
                    rows = [(path, i, page, None) for i, page in enumerate(renderer(content, kind, dpi, max_width))]
                except Exception as e:  # noqa: BLE001 - any failure of a file becomes its row
                    rows = [(path, -1, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "page_no", "content", "error"])

    return scans.select("path", "kind", "content").mapInPandas(run, "path string, page_no int, content binary, error string")


def choose_members(names: Column) -> Column:
    """struct(md, json): members of a result archive to read, by name and order.

    Text: the first that ends in ``full.md``, else the first ``.md``.  Structure: the first ``.json`` whose full name holds
    ``content``, ``structure`` or ``middle``, else the first ``.json``.
    """
    first = lambda keep: F.get(F.filter(names, keep), F.lit(0))
    md = F.coalesce(first(lambda x: F.endswith(x, F.lit("full.md"))), first(lambda x: F.endswith(x, F.lit(".md"))))
    named = first(lambda x: F.endswith(x, F.lit(".json")) & x.rlike("content|structure|middle"))
    return F.struct(md.alias("md"), F.coalesce(named, first(lambda x: F.endswith(x, F.lit(".json")))).alias("json"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, md, json, error) of result archives; without a text member the error says so, without structure json is ``{}``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    names = archive.namelist()
                    md = next((n for n in names if n.endswith("full.md")), None) or next((n for n in names if n.endswith(".md")), None)
                    js = [n for n in names if n.endswith(".json")]
                    structure = next((n for n in js if any(k in n for k in ("content", "structure", "middle"))), js[0] if js else None)
                    if md is None:
                        raise FileNotFoundError("no text member")
                    rows.append((name, archive.read(md).decode("utf-8"), archive.read(structure).decode("utf-8") if structure else "{}", None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "md", "json", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, md string, json string, error string")


def write_files(df: DataFrame, name: str, text: str, folder: str) -> int:
    """One file a row under ``folder``, which all executors share; returns the number of files.

    A file is written beside its place and moved there, so a task that runs again leaves the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target, value in zip(batch["name"], batch["value"]):
                path = os.path.join(folder, target)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                draft = f"{path}.{uuid.uuid4().hex}"
                with open(draft, "w", encoding="utf-8", newline="") as f:
                    f.write(value)
                os.replace(draft, path)
            yield pd.DataFrame({"n": [len(batch)]})

    rows = df.select(F.col(name).alias("name"), F.col(text).alias("value")).where(F.col("name").isNotNull() & F.col("value").isNotNull())
    return rows.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def base_name(path: Column) -> Column:
    """The name of a file without its folder and extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def write_texts(df: DataFrame, doc: str, text: str, folder: str, model_key: str | None = None) -> int:
    """``{base}_{model}.txt`` for each document."""
    name = F.concat(base_name(F.col(doc).cast("string")), F.lit(f"_{model_key}.txt" if model_key else ".txt"))
    return write_files(df.withColumn("_name", name), "_name", text, folder)


#: fixed values: name endings of the other outputs
BREAKS_SUFFIX, PAGES_SUFFIX = ".with_br", "_div"


def output_name(path: Column, suffix: str) -> Column:
    """The name of an input file with a suffix before its extension."""
    return F.concat(F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1), F.lit(suffix), F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def write_metadata(df: DataFrame, doc: str, yaml: str, other: str, folder: str) -> int:
    """``meta.yaml`` in the folder of each document, ``COPYRIGHT.md`` beside it for those that have one."""
    key = base_name(F.col(doc).cast("string"))
    both = df.select(F.concat(key, F.lit("/meta.yaml")).alias("name"), F.col(yaml).alias("value"))
    rest = df.where(F.col(other) != "").select(F.concat(key, F.lit("/COPYRIGHT.md")).alias("name"), F.col(other).alias("value"))
    return write_files(both.unionByName(rest), "name", "value", folder)


def write_marked(df: DataFrame, path: str, text: str, suffix: str, folder: str) -> int:
    """Texts with page marks or line breaks under the name of their input with a suffix."""
    return write_files(df.withColumn("_name", output_name(F.col(path), suffix)), "_name", text, folder)
