"""Session helpers: defaults for local runs and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "threadloom", checkpoints: str | None = None) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own settings, the checkpoint folder among them."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores).replace("*", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", checkpoints or tempfile.mkdtemp(prefix="threadloom-checkpoint-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives a lost executor.

    It runs at once, so it is for iterations and for results that many plans
    read. The folder is the one the cluster names in ``spark.checkpoint.dir``;
    only a session on one machine that names none gets a folder of its own.
    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files of past
    rounds go when nothing refers to them.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="threadloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
