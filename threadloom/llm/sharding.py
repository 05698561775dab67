"""Sharding by sampled splitters: size-weighted keys, quantile boundaries, overfull ranges subdivided."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored


def _hex(c):
    return F.lpad(F.hex(c), 16, "0")


def _range_of(splitters: list[str]):
    """Column function: the number of splitters at or below a key."""
    bounds = np.array(sorted(splitters), dtype="S32")

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(dtype="S32"), side="right").astype(np.int32))

    return place


def _drawn(rows: DataFrame, weight) -> list[str]:
    """Keys drawn with a chance of ``weight`` each, by a hash of the key."""
    chance = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    return [r["key"] for r in rows.filter(chance < weight).select("key").collect()]


def _quantiles(sample: list[str], parts: int) -> list[str]:
    sample = sorted(sample)
    return [sample[i * len(sample) // parts] for i in range(1, parts)] if len(sample) >= parts else sample


def shards(docs: DataFrame, count: int = 40, overhead: int = 16, range_bytes: int = 1 << 30, per_range: int = 32) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``bytes``: shard sizes near equal.

    Rows stand in the order of a key: hash of the text, then a hash unique to
    the row, so equal texts are neighbours and a group that holds a third of
    all rows can still be cut. A sample weighted by size (about ``per_range``
    keys for each range, bounded by the number of ranges) gives quantile
    splitters; rows are dealt by range, and a range with over twice its share
    of bytes gets splitters of its own until none is left. Exact running sums
    inside the ranges then place the shard boundaries, so sizes differ by less
    than one record and no task sees more than a range. Only keys and sizes are
    stored and shuffled, never texts; the number of ranges follows the bytes.

    Size is the UTF-8 bytes of the text (0 for null) plus ``overhead``; slots
    count from 0 without gaps inside a shard; text_crc32 of a null text is that
    of the empty one; grown_shard is null under this law. Repeated rows are
    dealt each, a null ``doc_id`` stays null, an empty table gives no rows,
    other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.concat(_hex(F.xxhash64(text)), _hex(F.xxhash64(F.monotonically_increasing_id()))).alias("key"),
        ),
        "shard-keys",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(4 * count, math.ceil(total / range_bytes))
    target = max(total / ranges, 1)
    splitters = _quantiles(_drawn(rows, F.col("size") * (per_range / target)), ranges)
    while True:
        dealt = rows.withColumn("range", _range_of(splitters)("key"))
        loads = {r["range"]: r for r in dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        over = {k: r for k, r in loads.items() if r["bytes"] > 2 * target and r["n"] > 1}
        bounds = sorted(splitters)
        fresh = set(_drawn(dealt.filter(F.col("range").isin(list(over))), F.col("size") * (per_range / target))) if over else set()
        places = np.searchsorted(np.array(bounds, dtype="S32"), np.array(sorted(fresh), dtype="S32"), side="right") if fresh else []
        own: dict[int, list[str]] = {}
        for key, place in zip(sorted(fresh), places):
            own.setdefault(int(place), []).append(key)
        more = {q for k, keys in own.items() if k in over for q in _quantiles(keys, math.ceil(over[k]["bytes"] / target))} - set(bounds)
        if not more:
            break
        splitters = bounds + list(more)
    offset, bases = 0, []
    for k in sorted(loads):
        bases.append((k, offset))
        offset += loads[k]["bytes"]
    inside = Window.partitionBy("range").orderBy("key")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.broadcast(spark.createDataFrame(bases, "range int, base long"))
    placed = (
        dealt.withColumn("upto", F.sum("size").over(upto)).withColumn("nth", F.row_number().over(inside)).join(base, "range")
        .withColumn("shard", F.floor((F.col("base") + F.col("upto") - F.col("size")) * count / F.lit(max(total, 1))).cast("int"))
    )
    narrow = stored(placed.select("doc_id", "size", "text_crc32", "range", "shard", "nth"), "shard-rows")
    runs = narrow.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "range", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return narrow.join(starts, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - F.col("first") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
