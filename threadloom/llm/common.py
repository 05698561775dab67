"""Shared pieces of the operators: tables in the shared folder, tables of a scale folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session without the setting, as in a test, gets one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="threadloom-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows reads files that outlive a lost executor,
    and values that depend on the order of evaluation are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Only matters where neither the working folder nor PYTHONPATH has it; a
    cluster that ships the package with the job is not affected.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most 8 MB, unless the session names another bound.

    A batch exists in the executor, in its Python worker and on the way between
    them; rows that are long texts make Spark's own bound of 64 MB heavy.
    """
    spark = on_workers(df.sparkSession)
    if spark.conf.get(BATCH_BYTES, None) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    return df.mapInArrow(function, schema)
