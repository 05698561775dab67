"""Corpus statistics and time series of discussions and reels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import asset_label, exact_mean, impact_sum, ranked_top, ratio, rolling_mean, scalar, song_label, top_n, with_facts
from ..functions.quantiles import with_percentiles
from ..session import durable

# fixed values: weekday names, Monday first
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def _replies_per_comment(comments: DataFrame, replies: DataFrame) -> DataFrame:
    n = replies.groupBy("comment_id").agg(F.count("*").alias("n_replies"))
    return comments.join(n, "comment_id", "left").withColumn("n_replies", F.coalesce("n_replies", F.lit(0)))


def _comments_per_video(videos: DataFrame, comments: DataFrame) -> DataFrame:
    n = comments.groupBy("video_id").agg(F.count("*").alias("n_comments"))
    return videos.join(n, "video_id", "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0)))


def corpus_counts(videos: DataFrame, comments: DataFrame, replies: DataFrame) -> DataFrame:
    """Totals, videos with and without comments, spread of comments and replies.

    All of it comes from one histogram of the counts.
    """
    per_video = _comments_per_video(videos, comments).select(F.lit("v").alias("kind"), F.col("n_comments").alias("n"))
    per_comment = _replies_per_comment(comments, replies).select(F.lit("c").alias("kind"), F.col("n_replies").alias("n"))
    hist = per_video.unionByName(per_comment).groupBy("kind", "n").agg(F.count("*").alias("c"))
    kind = Window.partitionBy("kind")
    run = hist.withColumn("end", F.sum("c").over(kind.orderBy("n"))).withColumn("all", F.sum("c").over(kind))
    n, c = F.col("n"), F.col("c")

    def of(k: str, value: Column) -> Column:
        return F.when(F.col("kind") == k, value)

    def median(k: str) -> Column:
        ends = [F.max(of(k, F.when((F.col("end") - c <= at) & (at < F.col("end")), n))) for at in (F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2))]
        return (ends[0] + ends[1]) / 2

    total, size, squares = F.sum(of("v", n * c)), F.sum(of("v", c)), F.sum(of("v", (n * n * c).cast("decimal(38,0)"))).cast("double")
    variance = F.try_divide(squares - total * total / size, size - 1)
    return run.agg(
        F.coalesce(size, F.lit(0)).alias("total_videos"),
        F.coalesce(total, F.lit(0)).alias("total_comments"),
        F.coalesce(F.sum(of("v", F.when(n > 0, c))), F.lit(0)).alias("videos_with_comments"),
        F.coalesce(F.sum(of("v", F.when(n == 0, c))), F.lit(0)).alias("videos_without_comments"),
        (total / size).alias("comments_per_video_mean"),
        F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("comments_per_video_std"),
        F.min(of("v", n)).alias("comments_per_video_min"),
        F.max(of("v", n)).alias("comments_per_video_max"),
        median("v").alias("comments_per_video_median"),
        F.coalesce(F.sum(of("c", n * c)), F.lit(0)).alias("total_replies"),
        (F.sum(of("c", n * c)) / F.sum(of("c", c))).alias("replies_per_comment_mean"),
        median("c").alias("replies_per_comment_median"),
    )


def summary_kpis(videos: DataFrame, comments: DataFrame, replies: DataFrame) -> DataFrame:
    """Totals, mean sentiment and the share of comments that got a reply."""
    answered = replies.select("comment_id").distinct().withColumn("hit", F.lit(1))
    total = scalar(videos, F.count("*").alias("n"))
    return comments.join(answered, "comment_id", "left").agg(
        F.count("*").alias("total_comments"),
        F.round(exact_mean("sentiment"), 3).alias("average_sentiment"),
        F.round(F.avg(F.when(F.col("hit").isNotNull(), 100.0).otherwise(0.0)), 2).alias("reply_percentage"),
    ).select(total["n"].alias("total_videos"), "*")


def most_liked(comments: DataFrame, n: int = 5) -> DataFrame:
    """Comments with most likes, id breaks ties."""
    return ranked_top(comments, n, F.desc_nulls_last("likes"), F.asc("comment_id"))


def interaction_density(videos: DataFrame, comments: DataFrame, replies: DataFrame) -> DataFrame:
    """T4: reply density per video; videos with no or undated comments are skipped."""
    per_video = (
        _replies_per_comment(comments, replies)
        .groupBy("video_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("n_replies").alias("r"),
            F.count_if(F.col("n_replies") > 0).alias("answered"),
            F.bool_and(F.col("date").isNotNull()).alias("dated"),
        )
        .filter("dated")
    )
    views = F.coalesce("views", F.lit(1))
    return (
        per_video.join(videos.select("video_id", "title", "views"), "video_id")
        .select(
            "video_id", "title",
            (F.col("r") / F.col("n")).alias("replies_per_comment"),
            (F.col("answered") / F.col("n")).alias("comments_with_replies_ratio"),
            F.coalesce(ratio(F.col("r"), views), F.lit(0.0)).alias("replies_per_view"),
        )
        .withColumn(
            "interaction_density_score",
            0.4 * F.col("replies_per_comment") + 0.4 * F.col("comments_with_replies_ratio") + 0.2 * F.col("replies_per_view"),
        )
    )


def interaction_density_summary(density: DataFrame, n: int = 5) -> DataFrame:
    """T4: mean and median score beside the top videos."""
    score = F.col("interaction_density_score")
    mid = scalar(density, F.avg(score).alias("mean"))
    top = ranked_top(density, n, score.desc(), F.asc("video_id")).select("rank", "video_id", "interaction_density_score")
    return with_percentiles(top.select("*", mid["mean"].alias("mean_score")), density, [], {"median_score": (score, 0.5)})


def daily_comments(comments: DataFrame, top: int = 10) -> DataFrame:
    """T5: comments per day, rolling mean and a flag for the busiest days."""
    daily = comments.filter(F.col("date").isNotNull()).groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("comments"))
    best = daily.orderBy(F.desc("comments"), "day").limit(top).select("day", F.lit(True).alias("top_day"))
    return rolling_mean(daily, "day", "comments", "rolling").join(best, "day", "left").withColumn("top_day", F.coalesce("top_day", F.lit(False)))


def daily_sentiment(comments: DataFrame) -> DataFrame:
    """Mean sentiment per day with rolling mean and the mean and median of the daily values."""
    daily = (
        comments.filter(F.col("date").isNotNull() & F.col("sentiment").isNotNull())
        .groupBy(F.to_date("date").alias("day"))
        .agg(exact_mean("sentiment").alias("sentiment"))
    )
    overall = scalar(daily, exact_mean("sentiment").alias("mean"))
    out = rolling_mean(daily, "day", "sentiment", "rolling").select("*", overall["mean"].alias("overall_mean"))
    return with_percentiles(out, daily, [], {"overall_median": (F.col("sentiment"), 0.5)})


def sentiment_distribution(comments: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of the scores with count, missing share, mean and median."""
    s, f = F.col("sentiment"), F.col("__f")
    facts = [F.count("*").alias("n"), F.count(s).alias("valid"), exact_mean(s).alias("mean"), F.min(s).alias("lo"), F.max(s).alias("hi")]
    width = (f["hi"] - f["lo"]) / bins
    slot = F.coalesce(F.least(F.floor(F.try_divide(s - f["lo"], width)), F.lit(bins - 1)), F.lit(0)).cast("long")
    rows = with_facts(comments.filter(s.isNotNull()).select("sentiment"), comments, *facts)
    hist = rows.groupBy(slot.alias("bin")).agg(F.count("*").alias("count"), F.first("__f").alias("__f"))
    out = hist.select(
        "bin", "count",
        (f["lo"] + F.col("bin") * width).alias("bin_start"),
        f["n"].alias("n_total"),
        (f["n"] - f["valid"]).alias("n_missing"),
        F.try_divide((f["n"] - f["valid"]) * 100.0, f["n"]).alias("missing_pct"),
        f["mean"].alias("mean"),
    )
    return with_percentiles(out, comments, [], {"median": (s, 0.5)})


def right_closed_histogram(df: DataFrame, value: str, bins: int = 30, lo: float | None = None, hi: float | None = None, cap: int = 100) -> DataFrame:
    """Right-closed equal-width bins of positive values; the lowest edge itself falls out."""
    v, f = F.col("v"), F.col("__f")
    values = df.select(F.col(value).alias("v"))
    facts = [
        F.count("*").alias("n"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("pos"),
        F.min(F.when(v > 0, v)).alias("min"), F.max(F.when(v > 0, v)).alias("max"),
    ]
    a = F.greatest(F.lit(1), f["min"]).cast("double") if lo is None else F.lit(float(lo))
    z = f["max"].cast("double") if hi is None else F.lit(float(hi))
    width = (z - a) / bins
    slot = F.least(F.ceil(F.try_divide(v - a, width)), F.lit(bins)).cast("long")
    rows = with_facts(values.filter(v > 0), values, *facts).filter((v > a) & (v <= z))
    hist = rows.groupBy(slot.alias("bin")).agg(F.count("*").alias("count"), F.first("__f").alias("__f"))
    return hist.select(
        "bin",
        (a + (F.col("bin") - 1) * width).alias("left"),
        (a + F.col("bin") * width).alias("right"),
        "count",
        (F.col("count") > cap).alias("over_cap"),
        (f["zero"] * 100.0 / f["n"]).alias("zero_pct"),
        (f["pos"] * 100.0 / f["n"]).alias("nonzero_pct"),
    )


def participation_timeline(edges: DataFrame) -> DataFrame:
    """Active channels per day, rolling mean, and channels seen so far on a full calendar.

    ``edges`` has channel_id and event_at.
    """
    seen = edges.filter(F.col("event_at").isNotNull() & (F.coalesce("channel_id", F.lit("")) != "")).select(
        "channel_id", F.to_date("event_at").alias("day")
    )
    daily = seen.groupBy("day").agg(F.countDistinct("channel_id").alias("active"))
    fresh = seen.groupBy("channel_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("fresh"))
    calendar = daily.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    rolled = rolling_mean(daily, "day", "active", "rolling")
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        calendar.join(fresh, "day", "left")
        .select("day", F.sum(F.coalesce("fresh", F.lit(0))).over(so_far).alias("cumulative"))
        .join(rolled, "day", "left")
    )


def weekday_counts(edges: DataFrame, normalize: bool = False) -> DataFrame:
    """Uploads, comments, replies and total by weekday, Monday first, zero-filled."""
    counted = (
        edges.filter(F.col("event_at").isNotNull())
        .groupBy(F.weekday("event_at").alias("weekday"))
        .agg(*[F.count_if(F.col("role") == r).alias(n) for r, n in (("uploader", "uploads"), ("commenter", "comments"), ("replier", "replies"))])
    )
    names = edges.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "weekday int, name string")
    kinds = ["uploads", "comments", "replies"]
    out = names.join(counted, "weekday", "left").select("weekday", "name", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
    out = out.withColumn("total", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))
    if normalize:
        total = scalar(out, *[F.sum(k).alias(k) for k in kinds + ["total"]])
        out = out.select("weekday", "name", *[F.coalesce(ratio(k, total[k]), F.lit(0.0)).alias(k) for k in kinds + ["total"]])
    return out


def views_vs_discussion(videos: DataFrame, comments: DataFrame, replies: DataFrame, include_replies: bool = True) -> DataFrame:
    """Discussion against views per video with marker size, year and the log-log fit."""
    c = comments.groupBy("video_id").agg(F.count("*").alias("c"))
    out = videos.filter(F.col("views").isNotNull()).join(c, "video_id", "left")
    volume = F.coalesce("c", F.lit(0))
    if include_replies:
        out = out.join(replies.groupBy("video_id").agg(F.count("*").alias("r")), "video_id", "left")
        volume = volume + F.coalesce("r", F.lit(0))
    out = out.select(
        "video_id", "views", volume.alias("discussion"), F.year("published_at").alias("year"),
        (volume / (F.col("views") + 1e-9)).alias("ratio"),
    )
    x, y = F.log10("views"), F.log10("discussion")
    positive = out.filter((F.col("views") > 0) & (F.col("discussion") > 0))
    fit = scalar(positive, F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    with_q = with_percentiles(out, out, [], {"q90": (F.col("discussion"), 0.9)})
    scale = F.coalesce(F.nullif(F.col("q90"), F.lit(0.0)), F.lit(1.0))
    return with_q.select(
        "video_id", "views", "discussion", "year", "ratio",
        (20 + 120 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("discussion") / scale))).alias("size"),
        fit["slope"].alias("slope"), fit["intercept"].alias("intercept"),
    )


def period_start(c: Column | str, freq: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.date_trunc({"D": "DAY", "W": "WEEK", "M": "MONTH", "Y": "YEAR"}[freq], c))


def period_label(c: Column | str, freq: str) -> Column:
    """Day, "Monday/Sunday" range, month or year label."""
    d = period_start(c, freq)
    if freq == "W":
        return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(d, 6), "yyyy-MM-dd"))
    return F.date_format(d, {"D": "yyyy-MM-dd", "M": "yyyy-MM", "Y": "yyyy"}[freq])


# fixed values: calendar step per frequency
STEPS = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH", "Y": "INTERVAL 1 YEAR"}


def uploads_over_time(videos: DataFrame, freq: str = "M", top: int = 10) -> DataFrame:
    """Uploads per period without gaps, rolling mean, flag for the top periods."""
    counts = (
        videos.filter(F.col("published_at").isNotNull())
        .groupBy(period_start("published_at", freq).alias("period"))
        .agg(F.count("*").alias("n"))
    )
    calendar = counts.agg(F.explode(F.sequence(F.min("period"), F.max("period"), F.expr(STEPS[freq]))).alias("period"))
    full = calendar.join(counts, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("uploads"))
    last = {"D": F.col("period"), "W": F.date_add("period", 6), "M": F.last_day("period"), "Y": F.last_day(F.add_months("period", 11))}[freq]
    full = full.withColumn("period_end", last)
    span = F.greatest(F.lit(1), F.datediff(F.max("period_end"), F.min("period_end")))
    best = full.orderBy(F.desc("uploads"), "period").limit(top).select("period", F.lit(True).alias("top"))
    return (
        rolling_mean(full, "period", "uploads", "rolling", span)
        .join(best, "period", "left")
        .withColumn("top", F.coalesce("top", F.lit(False)))
    )


def views_table(videos: DataFrame, n: int | None = 15) -> DataFrame:
    """Videos by views."""
    return top_n(videos.filter(F.col("views").isNotNull()).select("video_id", F.coalesce("title", F.lit("[No Title]")).alias("title"), "views"), n, F.desc("views"), F.asc("video_id"))


def views_distribution(videos: DataFrame) -> DataFrame:
    """log10 mean, median and quartiles of positive views, back in plain units."""
    v = videos.filter(F.col("views") > 0).select(F.log10("views").alias("lv"))
    base = v.agg(F.count("*").alias("n"), F.pow(F.lit(10.0), F.avg("lv")).alias("log_mean"))
    out = with_percentiles(base, v, [], {"m": (F.col("lv"), 0.5), "a": (F.col("lv"), 0.25), "z": (F.col("lv"), 0.75)})
    ten = F.lit(10.0)
    return out.select("n", "log_mean", F.pow(ten, "m").alias("log_median"), F.pow(ten, "a").alias("log_q1"), F.pow(ten, "z").alias("log_q3"))


def entity_rows(reels: DataFrame, entity: str, tags: DataFrame | None = None) -> DataFrame:
    """Add entity_type, entity_id and entity_label; rows without an id drop out."""
    if entity == "hashtags":
        tagged = tags.select("reel_pk", F.trim("hashtag").alias("entity_id")).filter(F.col("entity_id") != "")
        return reels.join(tagged, "reel_pk").withColumn("entity_label", F.col("entity_id")).withColumn("entity_type", F.lit(entity))
    ids = {"songs": ("song_id", song_label()), "assets": ("asset_id", asset_label()), "creators": ("creator_pseudo", F.col("creator_pseudo"))}
    key, label = ids[entity]
    named = reels.withColumn("entity_id", F.trim(F.coalesce(F.col(key), F.lit("")))).filter(F.col("entity_id") != "")
    return named.withColumn("entity_label", label).withColumn("entity_type", F.lit(entity))


def timeline(reels: DataFrame, entity: str = "songs", freq: str = "M", tags: DataFrame | None = None) -> DataFrame:
    """Reels per period and entity."""
    rows = entity_rows(reels.filter(F.col("taken_at").isNotNull()), entity, tags)
    return rows.groupBy(period_label("taken_at", freq).alias("period"), "entity_type", "entity_id", "entity_label").agg(F.count("*").alias("count"))


def describe_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Count, missing, mean, std, min, quartiles, max of each numeric field."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("e")).select("e.field", "e.x")
    base = long.groupBy("field").agg(
        F.count("x").alias("count"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"),
        F.when(F.count("x") == 1, 0.0).otherwise(F.stddev_samp("x")).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    return with_percentiles(base, long, ["field"], {n: (F.col("x"), p) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))})


def top_reels(reels: DataFrame, by: str = "likes", n: int = 20) -> DataFrame:
    """Ranked reels by likes, plays, views, comments, duration or impact."""
    measure = {
        "likes": F.col("like_count"), "plays": F.col("play_count"), "views": F.col("view_count"),
        "comments": F.col("comment_count"), "duration": F.col("video_duration"), "impact": impact_sum(),
    }[by]
    rows = reels.withColumn("metric", measure.cast("double")).filter(F.col("metric").isNotNull())
    return ranked_top(rows, n, F.desc("metric"), F.asc("reel_pk"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of each distinct value, from a distributed count per value.

    The distinct values are numbered by a range sort, so no single task orders
    the whole column; the running count is added up per partition first.
    """
    counts = durable(df.groupBy(value).agg(F.count("*").alias("__c")).repartitionByRange(value).withColumn("__s", F.spark_partition_id()))
    earlier = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.groupBy("__s").agg(F.sum("__c").alias("__n")).select("__s", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__s").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("__c").over(inside) + F.col("__off")
    return counts.join(before, "__s").select(value, (end - (F.col("__c") - 1) / 2).alias(name))


def correlate(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman of two fields; a note explains missing values."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    ranked = both.join(average_ranks(both, "x", "rx"), "x").join(average_ranks(both, "y", "ry"), "y")
    note = (
        F.when(F.count("*") < 2, "not enough paired observations")
        .when((F.min("x") == F.max("x")) | (F.min("y") == F.max("y")), "constant input")
        .otherwise("ok")
    )
    fits = note == "ok"
    return ranked.agg(
        F.count("*").alias("n"),
        F.when(fits, F.corr("x", "y")).alias("pearson"),
        F.when(fits, F.corr("rx", "ry")).alias("spearman"),
        note.alias("method_note"),
    )


def weekday_hour_grid(reels: DataFrame, at: str = "taken_at") -> DataFrame:
    """Reels by weekday and hour."""
    return reels.filter(F.col(at).isNotNull()).groupBy(F.weekday(at).alias("weekday"), F.date_format(at, "EEEE").alias("weekday_name"), F.hour(at).alias("hour")).agg(F.count("*").alias("count"))


def impact_by_entity(reels: DataFrame, entity: str = "songs", tags: DataFrame | None = None) -> DataFrame:
    """Count and sum, mean, max of plays, likes, comments and impact by entity."""
    rows = entity_rows(reels.withColumn("impact", impact_sum()), entity, tags)
    aggs = []
    for out in ("play_count", "like_count", "comment_count", "impact"):
        v = F.coalesce(out, F.lit(0))
        aggs += [F.sum(v).alias(f"{out}_sum"), F.avg(v).alias(f"{out}_mean"), F.max(v).alias(f"{out}_max")]
    return rows.groupBy("entity_type", "entity_id", "entity_label").agg(F.count("*").alias("count"), *aggs)


def song_trend(reels: DataFrame, freq: str = "W") -> DataFrame:
    """Gap-filled reel counts per song and period."""
    counts = reels.filter(F.col("taken_at").isNotNull()).groupBy("song_id", period_start("taken_at", freq).alias("period")).agg(F.count("*").alias("n"))
    calendar = counts.groupBy("song_id").agg(F.min("period").alias("a"), F.max("period").alias("z")).select(
        "song_id", F.explode(F.sequence("a", "z", F.expr(STEPS[freq]))).alias("period")
    )
    return calendar.join(counts, ["song_id", "period"], "left").select("song_id", "period", F.coalesce("n", F.lit(0)).alias("n"))


def song_summary(reels: DataFrame) -> DataFrame:
    """Size, span and median plays, likes and engagement per song."""
    base = reels.groupBy("song_id").agg(
        F.count("*").alias("n_reels"), F.to_date(F.min("taken_at")).alias("from"), F.to_date(F.max("taken_at")).alias("to")
    )
    out = with_percentiles(
        base, reels, ["song_id"],
        {"median_plays": (F.col("play_count"), 0.5), "median_likes": (F.col("like_count"), 0.5), "er": (F.col("engagement_rate"), 0.5)},
    )
    return out.withColumn("median_engagement", F.round("er", 4)).drop("er")


def source_overview(reels: DataFrame) -> DataFrame:
    """Count and first and last day by song."""
    return reels.groupBy("song_id").agg(F.count("*").alias("n"), F.min("taken_at").alias("first"), F.max("taken_at").alias("last"))
