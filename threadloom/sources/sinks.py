"""Table sinks, exports of views, and reading exports back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by '; ' and nulls as empty text, for CSV."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.array_join(c.cast("array<string>"), "; ") if isinstance(f.dataType, T.ArrayType) else c.cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, quote_all: bool = True) -> None:
    """CSV folder with a header; Spark's commit protocol makes the replacement all or nothing."""
    flat(df).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """JSON lines; with ``metadata`` a folder of two parts: ``items`` with the rows and ``metadata`` with one object.

    The object carries the given fields and the number of rows written, so an
    export tells what it holds. Rows are written by all tasks, never as one
    document.
    """
    if metadata is None:
        df.write.mode("overwrite").json(path)
        return
    df.write.mode("overwrite").json(f"{path}/items")
    spark = df.sparkSession
    count = spark.read.schema(df.schema).json(f"{path}/items").count()
    fields = {**metadata, "row_count": count, "columns": df.columns}
    spark.range(1).select(F.lit(json.dumps(fields, ensure_ascii=False, default=str)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def export_view(records: DataFrame, view: DataFrame, path: str, key: str = "reel_pk", form: str = "json", metadata: dict | None = None) -> DataFrame:
    """write the records of a saved view (rows with ``key``) and return them."""
    rows = records.join(view.select(key).distinct(), key, "left_semi")
    if form == "csv":
        write_csv(rows, path)
    else:
        write_json(rows, path, {"key": key, **(metadata or {})})
    return rows


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Exported records from CSV, JSON lines, a JSON list or an object with ``items``."""
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    wrapped = T.StructType([*schema.fields, T.StructField("items", T.ArrayType(schema))])
    rows = spark.read.schema(wrapped).option("multiLine", path.endswith(".json")).json(path)
    direct = rows.filter(F.col("items").isNull()).drop("items")
    return direct.unionByName(rows.filter(F.col("items").isNotNull()).select(F.explode("items").alias("r")).select("r.*"))
