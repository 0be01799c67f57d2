"""Command line: ``python -m quirefold refine IN OUT``, ``python -m quirefold gaps IN OUT``, ``python -m quirefold version``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

VERSION = "1.0.0"


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quirefold")
    commands = parser.add_subparsers(dest="command", required=True)
    refine = commands.add_parser("refine", help="refine all texts of a file or folder")
    refine.add_argument("source")
    refine.add_argument("target")
    refine.add_argument("-s", "--skip", default="", help="steps to leave out, separated by commas")
    gaps = commands.add_parser("gaps", help="large gaps of the layout records of a folder of JSON files")
    gaps.add_argument("source")
    gaps.add_argument("target")
    gaps.add_argument("--multiplier", type=float, default=4.0)
    commands.add_parser("version")
    options = parser.parse_args(arguments)
    if options.command == "version":
        print(VERSION)
        return
    spark = spark or SparkSession.builder.appName("quirefold").getOrCreate()
    if options.command == "refine":
        from quirefold.plans.pipeline import refine as run
        from quirefold.sources.files import read_texts

        run(read_texts(spark, options.source), "text", skip=options.skip).select("path", F.col("text_out").alias("text")).write.mode("overwrite").parquet(options.target)
    else:
        from quirefold.operators.layout import gaps as run
        from quirefold.sources.files import read_texts
        from quirefold.sources.payloads import envelope_pages

        pages = envelope_pages(read_texts(spark, options.source), "path", "text")
        block = "array<struct<block_label:string,block_bbox:array<double>,block_content:string>>"
        blocks = pages.select("path", "page_ix", F.posexplode(F.from_json(F.get_json_object("page", "$.parsing_res_list"), block)).alias("block_ix", "b")).select("path", "page_ix", "block_ix", "b.*")
        run(blocks, ["path", "page_ix"], "block_ix", options.multiplier).write.mode("overwrite").parquet(options.target)


if __name__ == "__main__":
    main()
