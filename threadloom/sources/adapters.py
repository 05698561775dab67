"""Driver tables viewed as discussion and reel corpora.

Each adapter is row-local or joins on a unique key, so it adds no hot group of
its own. ``plans.views`` holds the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import engagement_rate, impact_metric
from ..operators.media import KEY_NAMES


def whole(c, divisor: float = 1.0):
    return F.floor(F.col(c) / divisor).cast("long")


def event_edges(events: DataFrame) -> DataFrame:
    """events as channel-video role edges: one video per key and day."""
    k = F.get_json_object("props", "$.k")
    role = F.when(F.col("event_type") == "signup", "uploader").when(F.col("event_type") == "purchase", "replier").otherwise("commenter")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("channel_id"),
        F.concat(F.lit("v"), k, F.lit("@"), F.date_format("ts", "yyyyMMdd")).alias("video_id"),
        role.alias("role"),
        F.col("ts").cast("timestamp").alias("event_at"),
        F.concat(F.lit("corpus"), k.cast("long") % 3).alias("corpus"),
        "event_id",
    )


def thread_comments(orders: DataFrame) -> DataFrame:
    """orders as comments: one video per month and priority."""
    return orders.select(
        F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("/"), F.substring("o_orderpriority", 1, 1)).alias("video_id"),
        F.col("o_orderkey").alias("comment_id"),
        F.concat(F.lit("u"), F.col("o_custkey")).alias("author_channel_id"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        whole("o_totalprice", 10000).alias("likes"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 250000 - 1).alias("sentiment"),
        F.col("o_orderpriority").alias("corpus"),
        F.when(F.col("o_orderstatus") == "F", whole("o_totalprice", 1000)).alias("view_part"),
    )


def thread_replies(lineitem: DataFrame, comments: DataFrame) -> DataFrame:
    """lineitem rows as replies to their order."""
    return lineitem.join(comments.select("video_id", "comment_id", "corpus"), F.col("l_orderkey") == F.col("comment_id")).select(
        "video_id",
        "comment_id",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("reply_id"),
        F.concat(F.lit("u"), F.col("l_suppkey")).alias("author_channel_id"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
        whole("l_quantity").alias("likes"),
        "corpus",
    )


def thread_videos(comments: DataFrame) -> DataFrame:
    """Videos of the thread corpus: the first author uploads, views may be missing."""
    return comments.groupBy("video_id").agg(
        F.min("date").alias("published_at"),
        F.min_by("author_channel_id", "comment_id").alias("channel_id"),
        F.sum("view_part").alias("views"),
        F.min("corpus").alias("corpus"),
    ).withColumn("title", F.concat(F.lit("title "), F.col("video_id")))


def reels(orders: DataFrame) -> DataFrame:
    """orders as reels: priority is the song, priority and status the asset."""
    price = F.col("o_totalprice")
    return orders.select(
        F.col("o_orderkey").alias("reel_pk"),
        F.col("o_orderpriority").alias("song_id"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")).alias("asset_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("creator_pseudo"),
        F.col("o_orderdate").cast("timestamp").alias("taken_at"),
        F.when(price < 50000, 0).when(price >= 80000, whole("o_totalprice", 100)).cast("long").alias("play_count"),
        F.when(price >= 30000, whole("o_totalprice", 50)).alias("view_count"),
        whole("o_totalprice", 70).alias("like_count"),
        F.when(price >= 20000, whole("o_totalprice", 9000)).alias("comment_count"),
        (price / 10000).alias("video_duration"),
        F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("variant_label"),
    ).withColumn("impact_metric", impact_metric()).withColumn("engagement_rate", engagement_rate())


def songs(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderpriority").alias("song_id")).distinct().select(
        "song_id",
        F.expr("substring(song_id, 3)").alias("song_title"),
        F.when(F.substring("song_id", 1, 1) != "3", F.concat(F.lit("artist "), F.substring("song_id", 1, 1))).alias("artist"),
    )


def reel_hashtags(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """(reel, tag) pairs: brand and type of every ordered part."""
    tags = F.array(F.regexp_replace(F.lower("p_brand"), "#", ""), F.lower("p_type"))
    return (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("reel_pk"), F.explode(tags).alias("hashtag"))
        .distinct()
    )


def caption_reels(documents: DataFrame) -> DataFrame:
    """documents as captioned reels: source is the song, source and language the asset."""
    return documents.select(
        F.col("doc_id").alias("reel_pk"),
        F.col("source").alias("song_id"),
        F.concat_ws("-", "source", "lang").alias("asset_id"),
        F.col("lang").alias("variant_label"),
        F.col("text").alias("caption_text"),
        F.col("n_chars").alias("play_count"),
        F.col("n_chars").cast("double").alias("impact_metric"),
        F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 180).cast("int"))).alias("taken_at"),
        F.concat(F.lit("c"), F.col("n_chars") % 97).alias("creator_pseudo"),
    )


def annotations(labels: DataFrame) -> DataFrame:
    """labels as stored tags: quality as context of two sources, toxic as a format."""
    tag = F.array(
        F.struct(F.lit("context").alias("dimension"), F.when(F.col("quality") == 1, "nature").otherwise("home").alias("category"), F.lit("vision").alias("source"), ((F.col("doc_id") % 101) / 100).alias("confidence")),
        F.struct(F.lit("format").alias("dimension"), F.when(F.col("toxic") == 1, "dance").alias("category"), F.lit("vision").alias("source"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit("context").alias("dimension"), F.when(F.col("quality") == 0, "city").alias("category"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence")),
    )
    return labels.select(F.col("doc_id").alias("reel_pk"), F.explode(tag).alias("t")).select("reel_pk", "t.*").filter(F.col("category").isNotNull())


def vision_state(labels: DataFrame) -> DataFrame:
    """labels as tagging states: toxic reels are blocked, poor ones failed."""
    status = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "failed").otherwise("done")
    return labels.select(F.col("doc_id").alias("reel_pk"), status.alias("status"))


def crawl_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events as (runs, seen): ISO week is the crawl, user the reel, event type the asset."""
    crawl = F.concat(F.date_format(F.date_trunc("WEEK", "ts"), "yyyyMMdd"), F.lit("T000000Z"))
    seen = events.groupBy(crawl.alias("crawl_id"), F.col("user_id").alias("reel_pk"), F.col("event_type").alias("asset_id")).agg(
        F.max("ts").cast("timestamp").alias("seen_at"), F.count("*").alias("play_count")
    ).withColumn("song_id", F.substring("asset_id", 1, 1))
    runs = events.groupBy(crawl.alias("crawl_id")).agg(F.min("ts").cast("timestamp").alias("started_at")).select(
        "crawl_id", "started_at", F.lit("refresh").alias("mode"), F.lit("done").alias("status")
    )
    return runs, seen


def folded(vector, bins: int):
    """A vector of any length folded into ``bins`` sums, element i into bin i mod ``bins``."""
    def own(b):
        return F.aggregate(F.filter(vector, lambda _x, i: i % bins == b), F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    return [own(b) for b in range(bins)]


def acoustics(embeddings: DataFrame) -> DataFrame:
    """embeddings as acoustic features: label is the song, the folded vector the measures."""
    e = [x / 4 for x in folded(F.col("embedding"), 6)]
    key = F.concat(F.element_at(F.array(*[F.lit(k) for k in KEY_NAMES]), (F.floor(F.abs(e[5]) * 40) % 12 + 1).cast("int")), F.when(e[0] > 0, " Major").otherwise(" Minor"))
    return embeddings.select(
        F.format_string("a%06d", "vec_id").alias("asset_id"), F.concat(F.lit("s"), "label").alias("song_id"),
        F.round(120 + 200 * e[0], 3).alias("tempo"), F.round(2000 + 4000 * e[1], 3).alias("spectral_centroid"),
        F.round(e[2] * 10, 4).alias("loudness_lufs"), F.round(0.5 + e[3], 4).alias("spectral_flatness"), key.alias("est_key"),
    )


def alignments(events: DataFrame) -> DataFrame:
    """events as used audio spans: the JSON key is the asset, the value the start."""
    v = F.col("value")
    return events.select(
        F.col("event_id").alias("reel_pk"), F.format_string("a%03d", F.get_json_object("props", "$.k").cast("int")).alias("asset_id"),
        F.when(v >= 1, v).alias("used_segment_start"), (v + 15).alias("used_segment_end"), F.when(F.col("event_type") != "view", v / 100).alias("align_confidence"),
        F.when(F.col("event_type") == "view", (v > 50).cast("int")).otherwise(0).alias("has_overlay"),
    )


def edits(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """lineitem quantities as the few cut times of their order; the customer is the asset."""
    cuts = lineitem.groupBy(F.col("l_orderkey").alias("reel_pk")).agg(
        F.array_sort(F.collect_list(F.col("l_quantity") / 4)).alias("cut_times"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") / 4))).alias("soft_times")
    )
    asset = F.concat(F.lit("c"), "o_custkey")
    return cuts.join(orders.select(F.col("o_orderkey").alias("reel_pk"), asset.alias("asset_id"), (F.col("o_totalprice") / 1000).alias("duration"), "o_orderstatus"), "reel_pk").withColumn("cut_times_aligned", F.col("cut_times"))


def doc_comments(documents: DataFrame) -> DataFrame:
    """documents as comments of one video per source, with a language."""
    return documents.select(
        F.col("source").alias("video_id"), F.col("doc_id").alias("comment_id"), "text", F.col("lang").alias("language"),
        F.lit("comment").alias("kind"),
    )


def page_replies(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages as replies to the document with the same id; the URL names the language."""
    d = documents.select(F.col("doc_id").alias("comment_id"), F.col("source").alias("video_id"), F.col("lang").alias("comment_language"))
    return pages.join(d, F.col("page_id") == F.col("comment_id")).select(
        "video_id", "comment_id", F.col("page_id").alias("reply_id"), F.col("html").alias("text"), "comment_language",
        F.nullif(F.regexp_extract("url", r"//[^/]+/(en|fr|de|es)/", 1), F.lit("")).alias("language"),
    )


def conversation_comments(conversations: DataFrame) -> DataFrame:
    """User and system turns as comments; date and author follow from the turn."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("conv_id"), F.col("turn"))
    return conversations.select(
        F.concat(F.lit("conv"), F.col("conv_id")).alias("video_id"), "turn", "role",
        F.concat_ws("-", "conv_id", "turn").alias("item_id"),
        F.concat(F.substring("role", 1, 1), F.length("text") % 40).alias("author_channel_id"),
        "text", at.alias("date"), F.length("text").cast("long").alias("likes"),
    )
