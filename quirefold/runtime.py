"""Session-level helpers shared by all operators: table access, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was measured and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (unit tests, local runs) is a folder of our own made.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quirefold-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder; lost executors do not lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a materialised side whose rows and bytes were checked; else left to a shuffle join."""
    kinds = dict(df.dtypes)
    width = lambda c: F.octet_length(c) if kinds[c] == "string" else F.octet_length(F.to_json(c)) if "<" in kinds[c] else F.lit(8)
    size = sum((F.coalesce(width(c), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over the cores.

    Inputs that already come in at least as many splits as there are cores, which is every large one, stay as they are:
    no exchange is added to them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
