"""Combine documents of several sources so that each reaches its target share of all tokens.

1. Sizes are tokens of a public byte-level tokenizer whose rank file is a parameter.  Sizes are written to
   the checkpoint folder once; all later steps read (key, source, size) only.
2. A source needs ``target_share * total`` tokens.  With ``r`` = need / size of the source, every document is
   taken ``min(floor(r), max_repeats)`` times for certain.
3. If repeats are left, the rest comes from Pareto order sampling: documents have inclusion
   probabilities ``p = min(P_MOST, c * size ** SIZE_POWER)`` with ``c`` such that the expected tokens are the rest;
   they are ranked by the random odds ``u/(1-u)`` divided by the inclusion odds ``p/(1-p)`` and taken in that order
   until the rest is reached (to half a document).  ``u`` is a hash of key and seed, so that a lost task
   draws the same numbers again.

The cut in the order is found without sorting a source in one task: token sums per source and bucket of the
rank key (65,536 buckets, aggregated map-side) give the bucket in which the rest is reached; only that bucket
is ordered exactly.  A source that holds a third of all rows costs no more per task than any other.

Defined results: null, empty or unknown sources and null texts take no part but count in the total as they are;
an empty document has size 0 and is never drawn; a source without documents is reported with 0 reached; a row
that occurs twice is two documents; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.runtime import broadcast_if_small, cut

#: fixed value: the pattern that splits text before the merges of these rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SIZE_POWER, P_MOST = 0.5, 0.98
BUCKETS = 65_536


def token_counts(df: DataFrame, text: Column, rank_file: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens.  The vocabulary (some 50,000 entries) is sent to the executors once."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for texts in batches:
            yield pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return df.withColumn(name, count(text))


def mix(
    df: DataFrame, key: Column, text: Column, source: Column, targets: DataFrame, rank_file: str = TOKENIZER, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with their copies, report per source).  ``targets``: source, target_share, max_repeats."""
    docs = df.select(key.alias("doc_id"), source.alias("source"), text.alias("text"))
    sized = cut(token_counts(docs, F.col("text"), rank_file).drop("text"))
    sums = sized.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.sum(F.pow(F.col("n_tokens"), F.lit(1 + SIZE_POWER))).alias("moment")
    )
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rate = F.when(F.col("tokens") > 0, F.col("target_tokens") / F.col("tokens")).otherwise(0.0)
    plan = (
        targets.select("source", "target_share", "max_repeats")
        .join(sums, "source", "left")
        .fillna({"tokens": 0, "documents": 0, "moment": 0.0})
        .withColumn("target_tokens", F.col("target_share") * F.lit(total))
        .withColumn("whole", F.least(F.floor(rate), F.col("max_repeats")).cast("int"))
        .withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.col("target_tokens") - F.col("whole") * F.col("tokens")).otherwise(0.0))
        .withColumn("c", F.when(F.col("moment") > 0, F.col("rest") / F.col("moment")).otherwise(0.0))
    )
    plan = broadcast_if_small(cut(plan))

    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    p = F.least(F.lit(P_MOST), F.col("c") * F.pow(F.col("n_tokens"), F.lit(SIZE_POWER)))
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    drawn = (
        sized.join(plan.select("source", "whole", "rest", "c"), "source")
        .withColumn("u", u)
        .withColumn("p", p)
        .withColumn("rank", F.when((F.col("rest") > 0) & (F.col("p") > 0), rank))
        .withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS))
    )
    per_bucket = drawn.where("bucket is not null").groupBy("source", "rest", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = (
        per_bucket.withColumn("before", before)
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
        .select("source", F.col("bucket").alias("last_bucket"), "before")
    )
    marked = drawn.join(broadcast_if_small(cut(reach)), "source", "left")
    clear = marked.withColumn("extra", F.when(F.col("bucket").isNull(), 0).when(F.col("last_bucket").isNull() | (F.col("bucket") < F.col("last_bucket")), 1).otherwise(0))
    at_cut = F.col("bucket").eqNullSafe(F.col("last_bucket")) & F.col("bucket").isNotNull()
    inside = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    exact = clear.where(at_cut).withColumn(
        "extra", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("n_tokens") / 2 < F.col("rest")).cast("int")
    )
    chosen = (
        clear.where(~at_cut)
        .unionByName(exact)
        .withColumn("copies", F.col("whole") + F.col("extra"))
        .where((F.col("copies") > 0) & (F.col("n_tokens") > 0))
        .select("doc_id", "source", "copies", "n_tokens")
    )
    reached = chosen.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"), F.count("*").alias("chosen"), F.max("copies").alias("most_copies")
    )
    report = (
        plan.join(reached, "source", "left")
        .fillna({"reached_tokens": 0, "chosen": 0, "most_copies": 0})
        .select(
            "source", "target_share", "max_repeats", "documents", "tokens", F.round("target_tokens").cast("bigint").alias("target_tokens"), "chosen", "most_copies", "reached_tokens",
            (F.col("reached_tokens") / F.lit(max(1, total))).alias("reached_share"),
            # one row a source of the targets
            F.coalesce(F.try_divide(F.col("reached_tokens"), F.sum("reached_tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)).alias("mix_share"),
        )
    )
    return chosen, report
