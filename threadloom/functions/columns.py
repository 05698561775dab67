"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, null when b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def exact(c: Column | str) -> Column:
    """A double as a decimal, so that sums do not depend on the order of the rows."""
    return col(c).cast("decimal(28,10)")


def exact_mean(c: Column | str) -> Column:
    """Mean of doubles from an exact sum."""
    return F.sum(exact(c)).cast("double") / F.count(c)


def filled(c: Column | str) -> Column:
    """True for a non-empty string."""
    return col(c).isNotNull() & (col(c) != "")


def parse_timestamp(c: Column | str) -> Column:
    """ISO text to a UTC timestamp; unreadable fractions are dropped, bad text is null."""
    text = col(c).cast("string")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.split_part(text, F.lit("."), F.lit(1))))


def impact_metric() -> Column:
    """First positive of plays and views, else likes (0 when missing)."""
    return (
        F.when(F.col("play_count") > 0, F.col("play_count"))
        .when(F.col("view_count") > 0, F.col("view_count"))
        .otherwise(F.coalesce(F.col("like_count"), F.lit(0)))
        .cast("double")
    )


def impact_sum() -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("like_count", "comment_count")), F.coalesce(F.col("play_count"), F.lit(0)))


def engagement_rate() -> Column:
    return F.least(ratio(F.coalesce("like_count", F.lit(0)), F.nullif(F.col("play_count"), F.lit(0))), F.lit(1.0))


def song_label(song: str = "song_id", title: str = "song_title", artist: str = "artist") -> Column:
    t, a = F.trim(F.coalesce(F.col(title), F.lit(""))), F.trim(F.coalesce(F.col(artist), F.lit("")))
    return (
        F.when((a != "") & (t != ""), F.concat(a, F.lit(" – "), t))
        .when(t != "", t)
        .otherwise(F.coalesce(F.nullif(F.col(song), F.lit("")), F.lit("unknown")))
    )


def asset_label(asset: str = "asset_id", variant: str = "variant_label") -> Column:
    v, a = F.trim(F.coalesce(F.col(variant), F.lit(""))), F.trim(F.coalesce(F.col(asset), F.lit("")))
    return (
        F.when((v != "") & (a != ""), F.concat(v, F.lit(" ("), a, F.lit(")")))
        .when(v != "", v)
        .otherwise(F.coalesce(F.nullif(a, F.lit("")), F.lit("unknown")))
    )


def clean_tag(c: Column | str) -> Column:
    """Trim, lower, drop one leading '#', remove all white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"^#", ""), r"\s+", "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no built-in normaliser."""
    return s.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in normaliser."""
    return s.str.normalize("NFKC")


def top_n(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    return df.orderBy(*order) if n is None else df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def ranked_top(df: DataFrame, n: int, *order: Column, name: str = "rank") -> DataFrame:
    """Global top ``n`` with a rank: top-k first, so the window sees n rows only."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def scalar(df: DataFrame, *aggs: Column) -> Column:
    """One-row aggregate as a scalar subquery struct."""
    return df.agg(F.struct(*aggs).alias("s")).scalar()


def with_facts(df: DataFrame, source: DataFrame, *aggs: Column, name: str = "__f") -> DataFrame:
    """Attach a one-row aggregate once as a struct column, so long expressions share one subquery."""
    return df.select("*", scalar(source, *aggs).alias(name))


def rolling_mean(daily: DataFrame, day: str, value: str, name: str, span: Column | None = None) -> DataFrame:
    """Mean over the last max(3, span // 50) existing rows of a daily table."""
    if span is None:
        span = F.datediff(F.max(day), F.min(day))
    width = daily.agg(F.greatest(F.lit(3), F.floor(span / 50)).alias("w")).scalar()
    order = Window.orderBy(day)
    history = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = daily.withColumn("__i", F.row_number().over(order)).withColumn("__sum", F.sum(exact(value)).over(history))
    n = F.least(width, F.col("__i"))
    # the frame width is data-dependent, so subtract the running sum of the row before the frame
    earlier = numbered.select((F.col("__i") + width).alias("__i"), F.col("__sum").alias("__old"))
    return (
        numbered.join(earlier, "__i", "left")
        .withColumn(name, (F.col("__sum") - F.coalesce(F.col("__old"), F.lit(0))).cast("double") / n)
        .drop("__i", "__sum", "__old")
    )
