"""Exact grouped percentiles that never gather a whole group.

``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer. Here values fall into cells of a fixed, order-preserving
grid (65,536 to each power of two). Cells are counted with a map-side combine,
so only (group, cell) counts are shuffled; they show in which cell each wanted
rank lies, and only a cell that holds different values is looked into again,
through counts by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_CELLS = 65536


def grid_cell(x: Column) -> Column:
    """Number of the grid cell of a double; it never falls where x rises.

    A logarithm that is off by one at a power of two gives the same number.
    """
    a = F.abs(x)
    power = F.floor(F.log2(a))
    inside = F.floor((a / F.pow(F.lit(2.0), power) - 1) * _CELLS)
    size = F.when(a < 1e-300, F.lit(0)).when(a > 1e300, F.lit(2200 * _CELLS)).otherwise((power + 1100) * _CELLS + inside).cast("long")
    return F.when(a == 0, F.lit(0)).when(x < 0, -1 - size).otherwise(size + 1).cast("long")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], times: Column | None = None
) -> DataFrame:
    """One row per key with linear-interpolated percentiles; without keys at most one row.

    ``wanted`` maps an output name to ``(value column, fraction)``. A row stands
    for ``times`` equal ones. Nulls are
    ignored; keys may be null; a key without values is absent from the result.
    """
    names = list(wanted)
    ids = [f"__k{i}" for i in range(len(keys))]
    measures = F.array(
        *[
            F.struct(F.lit(n).alias("m"), F.lit(float(wanted[n][1])).alias("p"), wanted[n][0].cast("double").alias("x"))
            for n in names
        ]
    )
    long = (
        df.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], (F.lit(1) if times is None else times).cast("long").alias("t"), F.explode(measures).alias("e"))
        .select(*ids, "t", "e.m", "e.p", "e.x")
        .filter(F.col("x").isNotNull() & ~F.isnan("x"))
        .withColumn("cell", grid_cell(F.col("x")))
    )
    cells = long.groupBy(*ids, "m", "p", "cell").agg(F.sum("t").alias("c"), F.min("x").alias("first"), F.max("x").alias("last"))
    group = Window.partitionBy(*ids, "m")
    ranked = (
        cells.withColumn("end", F.sum("c").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("c"))
        .withColumn("position", (F.sum("c").over(group) - 1) * F.col("p"))
    )
    ends = F.array(*[F.struct(F.lit(w).alias("w"), rank.cast("long").alias("rank")) for w, rank in (("a", F.floor("position")), ("z", F.ceil("position")))])
    hits = (
        ranked.select("*", F.explode(ends).alias("e")).filter((F.col("start") <= F.col("e.rank")) & (F.col("e.rank") < F.col("end")))
        .select(*ids, "m", "position", "cell", "first", "last", "e.w", (F.col("e.rank") - F.col("start")).alias("nth"), "c")
    )
    known = F.when(F.col("nth") == 0, F.col("first")).when(F.col("nth") == F.col("c") - 1, F.col("last")).when(F.col("first") == F.col("last"), F.col("first"))
    told = hits.withColumn("x", known)
    mixed = told.filter(F.col("x").isNull()).select(*[F.col(i).alias(i + "s") for i in ids], F.col("m").alias("ms"), F.col("cell").alias("cs"), "position", "w", "nth")
    on = (F.col("m") == F.col("ms")) & (F.col("cell") == F.col("cs"))
    for i in ids:
        on = on & F.col(i).eqNullSafe(F.col(i + "s"))
    inner = Window.partitionBy(*ids, "m", "w").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    # Spark takes the exploded rows for as small as their files: they are only on the streamed side of the joins, never broadcast
    values = long.join(mixed.drop("position", "w", "nth"), on, "left_semi").groupBy(*ids, "m", "cell", "x").agg(F.sum("t").alias("c"))
    looked = (
        values.join(mixed.hint("shuffle_hash"), on).select(*ids, "m", "position", "w", "nth", "x", "c")
        .withColumn("upto", F.sum("c").over(inner)).filter((F.col("upto") > F.col("nth")) & (F.col("upto") - F.col("c") <= F.col("nth")))
    )
    found = told.filter(F.col("x").isNotNull()).select(*ids, "m", "position", "w", "x").unionByName(looked.select(*ids, "m", "position", "w", "x"))
    low, high, weight = (
        {n: F.max(F.when((F.col("m") == n) & (F.col("w") == w), value)) for n in names}
        for w, value in (("a", F.col("x")), ("z", F.col("x")), ("a", F.col("position") - F.floor("position")))
    )
    return found.groupBy(*ids).agg(*[(low[n] + weight[n] * (high[n] - low[n])).alias(n) for n in names]).select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], *names)


def with_percentiles(
    grouped: DataFrame, df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]]
) -> DataFrame:
    """Left-join exact percentiles of ``df`` onto an aggregate with the same keys."""
    found = exact_percentiles(df, keys, wanted)
    if not keys:
        one = found.agg(F.struct(*[F.max(n).alias(n) for n in wanted]).alias("s")).scalar()
        return grouped.select("*", *[one[n].alias(n) for n in wanted])
    renamed = found.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *wanted)
    on = None
    for i, k in enumerate(keys):
        test = grouped[k].eqNullSafe(renamed[f"__j{i}"])
        on = test if on is None else on & test
    return grouped.join(renamed, on, "left").drop(*[f"__j{i}" for i in range(len(keys))])
