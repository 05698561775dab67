"""Keyed tables fed by streams: each micro-batch is merged into the buckets it touches, once.

A table is a folder. ``data/batch=<n>/bucket=<k>`` holds the whole bucket as
batch n left it, ``commits/batch=<n>`` one small file with the buckets that
batch wrote. A bucket's rows are those of its last committed batch; a batch
without its commit file is not seen, and one that has it is not merged again.
Only Spark's readers and writers touch the folder, so it may stand in any
store they reach. Older bucket versions stay until the folder is tidied, so
readers of an earlier state are not disturbed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter

BUCKETS = 64


def _commits(spark: SparkSession, path: str) -> dict[int, int]:
    """Last committed batch of each bucket; at most one row per bucket reaches the driver."""
    try:
        rows = spark.read.schema("bucket int, batch long").parquet(f"{path}/commits")
    except AnalysisException:
        return {}
    return {r["bucket"]: r["batch"] for r in rows.filter("bucket >= 0").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def _done(spark: SparkSession, path: str, batch: int) -> bool:
    try:
        return not spark.read.schema("bucket int, batch long").parquet(f"{path}/commits").filter(F.col("batch") == batch).isEmpty()
    except AnalysisException:
        return False


def table_rows(spark: SparkSession, path: str, schema: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table's rows, of some buckets if asked for."""
    last = _commits(spark, path)
    paths = [f"{path}/data/batch={b}/bucket={k}" for k, b in sorted(last.items()) if buckets is None or k in set(buckets)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merged(current: DataFrame, fresh: DataFrame, keys: Sequence[str], newest: Column | None = None, keep: str = "new", ties: Sequence[str] = ()) -> DataFrame:
    """One row per key of stored and arriving rows.

    ``keep`` "new": an arriving row replaces the stored one (H2, S17); "old":
    a stored row stays (S18); "all": every arriving row of a key stays and the
    stored ones of that key go (S24). With ``newest`` the row with the largest
    value stays, stored or arriving, which makes the result independent of
    how rows fall into batches. Among equals the first by ``ties`` stays.
    """
    if keep == "all":
        return current.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)
    both = current.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    side = F.desc("__new") if keep == "new" else F.asc("__new")
    order = [*([newest.desc_nulls_last()] if newest is not None else []), side, *[F.asc_nulls_last(c) for c in ties]]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return both.withColumn("__r", first).filter("__r = 1").drop("__r", "__new")


def merge_batch(
    fresh: DataFrame, batch: int, path: str, keys: Sequence[str], buckets: int = BUCKETS, newest: Column | None = None, keep: str = "new", ties: Sequence[str] = ()
) -> bool:
    """Merge one micro-batch into the table; False if it was merged before.

    Rows with a null in a key are left out, as an index leaves them out. The
    batch is read once for its buckets and once for its rows; both come from
    the source's files of this batch.
    """
    spark = fresh.sparkSession
    if _done(spark, path, batch):
        return False
    named = fresh
    for k in keys:
        named = named.filter(F.col(k).isNotNull())
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
    touched = sorted(r["b"] for r in named.select(bucket.alias("b")).distinct().collect())
    if touched:
        out = merged(table_rows(spark, path, schema, touched), named, keys, newest, keep, ties).withColumn("bucket", bucket)
        # a bucket is one shuffle partition and one file at least; a large one is more of both
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch}")
    rows = [(b, batch) for b in touched] or [(-1, batch)]
    spark.createDataFrame(rows, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/of={batch}")
    return True


def merge_stream(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **how) -> DataStreamWriter:
    """A writer, ready to start, that merges every micro-batch of ``stream`` into the table at ``path``.

    ``prepare`` turns a batch into rows first, such as dropping failed
    fetches. A batch that is run again after a failure changes nothing if its
    commit stands, and is merged anew from the same state if not.
    """

    def each(batch: DataFrame, number: int) -> None:
        merge_batch(prepare(batch) if prepare else batch, number, path, keys, **how)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def video_merge(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Fetched videos replace stored ones; failed fetches (null video_info) keep them."""
    return merge_stream(stream, path, ["video_id"], checkpoint, lambda b: b.filter(F.col("video_info").isNotNull()), newest=F.col("video_info.download_time"))


def index_merge(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Found (reel_pk, asset_id) rows that the index lacks."""
    return merge_stream(stream, path, ["reel_pk", "asset_id"], checkpoint, lambda b: b.filter(F.col("reel_pk") != ""), keep="old")


def seen_merge(stream: DataFrame, path: str, checkpoint: str, newest: Column) -> DataStreamWriter:
    """H2: sightings by crawl, reel and asset; the latest stays."""
    return merge_stream(stream, path, ["crawl_id", "reel_pk", "asset_id"], checkpoint, newest=newest)


def source_merge(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """All stored annotations of a source are replaced by those that arrive for it together."""
    return merge_stream(stream, path, ["source"], checkpoint, keep="all")
