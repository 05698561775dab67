"""Registry of queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# text tables with much work per row, and their unique keys
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


class Tables:
    """Lazy parquet tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # a table in fewer splits than there are cores, such as one small file, is dealt out; a large one is read as it lies
        small = name in TEXT_KEYS and df.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism
        return df.repartition(TEXT_KEYS[name]) if small else df


def six_places(c: Column) -> Column:
    """A double rounded half up to six places, the same value as ``round``.

    ``round`` goes through decimal text for every row. Where a value is well
    away from a half the nearest whole number of millionths is the same; the
    others, large ones and NaN take ``round``.
    """
    y = c * 1e6
    clear = (F.abs(c) < 1e5) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(clear, F.rint(y) / 1e6).otherwise(F.round(c, 6)) + F.lit(0.0)


def presentable(df: DataFrame) -> DataFrame:
    """Plain result columns for comparison with SQL: longs, doubles rounded to 6 places, text and booleans.

    Only registered queries are rounded; the operators return full precision.
    """
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = six_places(c.cast("double"))
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return presentable(fn(Tables(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
