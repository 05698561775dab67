"""Nested discussion corpora: reading, flattening, merging, upserting, exporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.columns import filled, parse_timestamp
from ..session import durable

# fixed values: field names of the corpus file format
REPLY = T.StructType([
    T.StructField("youtube_reply_id", T.StringType()), T.StructField("youtube_parent_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("likes", T.LongType()), T.StructField("author_name", T.StringType()),
    T.StructField("author_channel_id", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("blob_sentiment", T.StringType()), T.StructField("vader_sentiment", T.StringType()),
])
COMMENT = T.StructType([
    T.StructField("youtube_comment_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("likes", T.LongType()), T.StructField("author_name", T.StringType()), T.StructField("author_channel_id", T.StringType()),
    T.StructField("author_subscribers", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("blob_sentiment", T.StringType()), T.StructField("vader_sentiment", T.StringType()),
    T.StructField("replies", T.ArrayType(REPLY)),
])
VIDEO_INFO = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("title", "description", "published_at", "channel_name", "channel_id", "duration")],
    *[T.StructField(n, T.LongType()) for n in ("likes", "dislikes", "views")],
    T.StructField("download_time", T.StringType()), T.StructField("manual_review", T.BooleanType()),
    T.StructField("title_language", T.StringType()), T.StructField("description_language", T.StringType()),
])
ENTRY = T.StructType([T.StructField("video_info", VIDEO_INFO), T.StructField("comments", T.ArrayType(COMMENT))])
LINE = T.StructType([T.StructField("video_id", T.StringType()), *ENTRY.fields])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One file holding an object keyed by video id, as rows (video_id, video_info, comments).

    For import only: such a file is one JSON value and one task reads it whole.
    Many files are read side by side; a large corpus is kept as lines
    (``import_corpus``, ``read_lines``).
    """
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", T.MapType(T.StringType(), ENTRY)).alias("m"))
    return parsed.select(F.explode("m").alias("video_id", "e")).select("video_id", "e.video_info", "e.comments")


# the last characters of a piece in which the next key stands; keys are ids
_KEY_ROOM = 4096
_NEXT_KEY = r'\}\s*,\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:\s*\{\s*$'
_FIRST_KEY = r'^[\s\x{FEFF}]*\{\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:\s*\{\s*$'
_END = r"\}\s*\}\s*$"


def read_corpus_slices(spark: SparkSession, path: str) -> DataFrame:
    """One large file holding an object keyed by video id, read in slices; rows as of ``read_corpus``.

    The text reader splits the file by bytes, wherever ``"video_info"`` stands
    with plain quotes: inside a JSON string the closing quote would be escaped,
    so it only stands where an entry begins. A piece then holds one entry and,
    at its end, the key of the next; pieces are numbered by file, slice and
    place, and keys move on by one. Each entry must begin with its
    ``video_info``, as the writer of such files has it; a piece of another form
    raises an error rather than being skipped (``read_corpus`` takes such
    files). No task holds more than a slice and an entry.
    """
    place = ("file", "block")
    raw = spark.read.option("lineSep", '"video_info"').text(path).select(
        "value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("seq")
    )
    pieces = durable(raw)
    blocks = pieces.groupBy(*place).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(*place, "first", before.alias("before"), F.sum("n").over(Window.partitionBy("file")).alias("all"))
    room = F.expr(f"right(value, {_KEY_ROOM})")
    numbered = pieces.join(F.broadcast(starts), list(place)).withColumn("k", F.col("before") + F.col("seq") - F.col("first")).withColumn("room", room)
    key = F.when(F.col("k") == 0, F.regexp_extract("value", _FIRST_KEY, 1)).otherwise(F.regexp_extract("room", _NEXT_KEY, 1))
    told = numbered.filter(F.col("k") < F.col("all") - 1).select("file", (F.col("k") + 1).alias("k"), key.alias("key"))
    last = F.col("k") == F.col("all") - 1
    tail = F.when(last, F.length(F.regexp_extract("room", _END, 0))).otherwise(F.length(F.regexp_extract("room", _NEXT_KEY, 0)))
    entry = F.concat(F.lit('{"video_info"'), F.expr("left(value, length(value) - tail)"), F.lit("}"))
    bodies = numbered.filter("k > 0").withColumn("tail", tail).select("file", "k", F.from_json(entry, ENTRY).alias("e"), F.col("tail"))
    joined = bodies.join(told, ["file", "k"])
    name = F.get(F.from_json(F.concat(F.lit("["), "key", F.lit("]")), "array<string>"), 0)
    sound = (F.col("key") != "") & (F.col("tail") > 0) & F.col("e").isNotNull() & name.isNotNull()
    wrong = F.raise_error(F.concat(F.lit("not an entry that begins with its video_info: piece "), F.col("k").cast("string"), F.lit(" of "), F.col("file")))
    checked = joined.select(F.when(sound, name).otherwise(wrong.cast("string")).alias("video_id"), "e.video_info", "e.comments")
    return checked


def import_corpus(spark: SparkSession, path: str, lines: str, slices: bool = False) -> DataFrame:
    """Rewrite object files as the scalable layout and read that back; ``slices`` for large files."""
    (read_corpus_slices if slices else read_corpus)(spark, path).repartition("video_id").write.mode("overwrite").json(lines)
    return read_lines(spark, lines)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The scalable layout, one video per JSON line."""
    return spark.read.schema(LINE).json(path)


def videos(nested: DataFrame) -> DataFrame:
    """Video rows with typed timestamp."""
    info = [f.name for f in nested.schema["video_info"].dataType.fields]
    out = nested.select("video_id", *[F.col(f"video_info.{n}").alias(n) for n in info])
    return out.withColumn("published_at", parse_timestamp("published_at"))


def _sentiment(c: str):
    return F.col(c).cast("string").try_cast("double")


def comments(nested: DataFrame) -> DataFrame:
    """Comment rows with position; bad dates and 'N/A' sentiments are null."""
    rows = nested.select("video_id", F.posexplode("comments").alias("pos", "c")).select("video_id", "pos", "c.*")
    out = rows.drop("replies").withColumnRenamed("youtube_comment_id", "comment_id")
    return out.withColumn("date", parse_timestamp("date")).withColumn("sentiment", _sentiment("vader_sentiment"))


def replies(nested: DataFrame) -> DataFrame:
    """Reply rows with the id and position of their comment."""
    c = nested.select("video_id", F.posexplode("comments").alias("comment_pos", "c"))
    rows = c.select("video_id", "comment_pos", F.col("c.youtube_comment_id").alias("comment_id"), F.posexplode("c.replies").alias("pos", "r")).select(
        "video_id", "comment_id", "comment_pos", "pos", "r.*"
    )
    out = rows.withColumnRenamed("youtube_reply_id", "reply_id")
    return out.withColumn("date", parse_timestamp("date")).withColumn("sentiment", _sentiment("vader_sentiment"))


def messages(comment_rows: DataFrame, reply_rows: DataFrame) -> DataFrame:
    """S3: comments and replies as (video_id, date, text, language, kind)."""
    cols = ["video_id", "date", "text", "language"]
    return comment_rows.select(*cols, F.lit("comment").alias("kind")).unionByName(reply_rows.select(*cols, F.lit("reply").alias("kind")))


EXPORT_VIDEO = ["title", "description", "title_language", "description_language", "duration", "views", "likes", "dislikes"]


def export_rows(nested: DataFrame) -> DataFrame:
    """27 columns per comment or reply with the video's metadata repeated."""
    empty, zero = F.lit(""), F.lit(0)

    def text(c):
        return F.coalesce(F.col(c).cast("string"), empty)

    video = [F.coalesce(F.col(f"video_info.{n}"), zero if n in ("views", "likes", "dislikes") else empty).alias(f"video_{n}") for n in EXPORT_VIDEO]
    video += [text(f"video_info.{n}").alias(n) for n in ("published_at", "channel_name", "channel_id")]
    base = nested.select("video_id", *video, F.explode("comments").alias("c"))
    meta = [c for c in base.columns if c != "c"]

    def body(r: str, subscribers):
        return [
            text(f"{r}.author_name").alias("author_name"), text(f"{r}.author_channel_id").alias("author_channel_id"), subscribers.alias("author_subscribers"),
            text(f"{r}.text").alias("text"), text(f"{r}.date").alias("date"), F.coalesce(F.col(f"{r}.likes"), zero).alias("likes"), text(f"{r}.language").alias("language"),
            F.coalesce(F.col(f"{r}.blob_sentiment"), F.lit("0")).alias("blob_sentiment"), F.coalesce(F.col(f"{r}.vader_sentiment"), F.lit("0")).alias("vader_sentiment"),
        ]

    c = base.select(
        *meta, F.lit("comment").alias("comment_type"), text("c.youtube_comment_id").alias("comment_id"), empty.alias("reply_to_comment_id"),
        text("c.youtube_comment_id").alias("youtube_comment_id"), empty.alias("youtube_reply_id"), empty.alias("youtube_parent_id"),
        *body("c", F.coalesce(F.col("c.author_subscribers"), F.lit("N/A"))),
    )
    r = base.select(*meta, F.explode("c.replies").alias("r")).select(
        *meta, F.lit("reply").alias("comment_type"), text("r.youtube_reply_id").alias("comment_id"), text("r.youtube_parent_id").alias("reply_to_comment_id"),
        empty.alias("youtube_comment_id"), text("r.youtube_reply_id").alias("youtube_reply_id"), text("r.youtube_parent_id").alias("youtube_parent_id"),
        *body("r", F.lit("N/A")),
    )
    return c.unionByName(r)


def merge_corpora(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of corpora; the last one that holds a video wins.

    An earlier entry is dropped by an anti join on the later ids, so no large
    nested row is sorted.
    """
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = out.unionByName(p.join(out.select("video_id").distinct(), "video_id", "left_anti"), allowMissingColumns=True)
    return out


def upsert_videos(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fetched entries replace old ones, failed fetches (null video_info) keep them; by publication date, undated last."""
    good = fresh.filter(F.col("video_info").isNotNull())
    out = merge_corpora([current, good])
    return out.orderBy(F.asc_nulls_last("video_info.published_at"), "video_id")


def title_matches(candidates: DataFrame, year: int, terms: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """Distinct ids of videos of a year whose title has all terms and no excluded one."""
    title = F.lower("title")
    keep = F.year("published_at") == year
    for t in terms:
        keep = keep & title.contains(t.lower())
    for t in excluded:
        keep = keep & ~title.contains(t)
    return candidates.filter(keep).select("video_id").distinct()


def preview(nested: DataFrame, n: int = 10) -> DataFrame:
    """First videos with their comment counts."""
    size = F.coalesce(F.array_size("comments"), F.lit(0))
    return nested.select("video_id", "video_info.title", size.alias("n_comments")).orderBy("video_id").limit(n)


def corpus_totals(nested: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Videos and comments per corpus."""
    return nested.groupBy(corpus).agg(F.count("*").alias("videos"), F.sum(F.coalesce(F.array_size("comments"), F.lit(0))).alias("comments"))


def video_payloads(payloads: DataFrame) -> DataFrame:
    """Stored video payloads as video_info columns; counts default to 0."""
    s = "struct<items:array<struct<id:string,snippet:struct<title:string,description:string,publishedAt:string,channelTitle:string,channelId:string>,statistics:struct<likeCount:string,dislikeCount:string,viewCount:string>,contentDetails:struct<duration:string>>>>"
    v = payloads.withColumn("i", F.from_json("payload", s)["items"][0]).filter(F.col("i").isNotNull())

    def text(c):
        return F.coalesce(F.col(f"i.{c}"), F.lit(""))

    def number(c):
        return F.coalesce(F.col(f"i.statistics.{c}").try_cast("long"), F.lit(0))

    return v.select(
        F.coalesce("video_id", F.col("i.id")).alias("video_id") if "video_id" in payloads.columns else F.col("i.id").alias("video_id"),
        text("snippet.title").alias("title"), text("snippet.description").alias("description"), parse_timestamp("i.snippet.publishedAt").alias("published_at"),
        text("snippet.channelTitle").alias("channel_name"), text("snippet.channelId").alias("channel_id"), text("contentDetails.duration").alias("duration"),
        number("likeCount").alias("likes"), number("dislikeCount").alias("dislikes"), number("viewCount").alias("views"), F.lit(False).alias("manual_review"),
    )


def thread_payloads(payloads: DataFrame) -> DataFrame:
    """Stored comment-thread payloads (video_id, payload) as nested comments with replies."""
    author = "authorDisplayName:string,authorChannelId:struct<value:string>,textDisplay:string,publishedAt:string,likeCount:long,parentId:string"
    s = (
        f"struct<items:array<struct<id:string,snippet:struct<topLevelComment:struct<snippet:struct<{author}>>,totalReplyCount:long>,"
        f"replies:struct<comments:array<struct<id:string,snippet:struct<{author}>>>>>>>"
    )
    usable = F.filter(F.from_json("payload", s)["items"], lambda i: i["snippet"]["topLevelComment"]["snippet"].isNotNull())

    def fields(x):
        return [
            F.coalesce(x["textDisplay"], F.lit("")).alias("text"), F.coalesce(x["publishedAt"], F.lit("")).alias("date"), F.coalesce(x["likeCount"], F.lit(0)).alias("likes"),
            F.coalesce(x["authorDisplayName"], F.lit("")).alias("author_name"), F.coalesce(x["authorChannelId"]["value"], F.lit("")).alias("author_channel_id"),
        ]

    def reply(r):
        return F.struct(F.coalesce(r["id"], F.lit("")).alias("youtube_reply_id"), F.coalesce(r["snippet"]["parentId"], F.lit("")).alias("youtube_parent_id"), *fields(r["snippet"]))

    def comment(i):
        found = F.transform(i["replies"]["comments"], reply)
        return F.struct(F.coalesce(i["id"], F.lit("")).alias("youtube_comment_id"), *fields(i["snippet"]["topLevelComment"]["snippet"]), F.coalesce(found, F.filter(F.array(reply(i["replies"]["comments"][0])), lambda _: F.lit(False))).alias("replies"))

    return payloads.select("video_id", F.transform(usable, comment).alias("comments"))


def nest(video_rows: DataFrame, comment_rows: DataFrame, reply_rows: DataFrame) -> DataFrame:
    """Nested rows from flat tables with the file format's field names; a video's thread becomes one row."""
    rf = [f.name for f in REPLY.fields if f.name in reply_rows.columns]
    r = reply_rows.groupBy("video_id", "comment_id").agg(F.array_sort(F.collect_list(F.struct("pos", *rf))).alias("r"))
    r = r.select("video_id", "comment_id", F.transform("r", lambda x: x.dropFields("pos")).alias("replies"))
    cf = [f.name for f in COMMENT.fields if f.name in comment_rows.columns]
    c = comment_rows.join(r, ["video_id", "comment_id"], "left").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", *cf, "replies"))).alias("c"))
    c = c.select("video_id", F.transform("c", lambda x: x.dropFields("pos")).alias("comments"))
    vf = [f.name for f in VIDEO_INFO.fields if f.name in video_rows.columns]
    return video_rows.select("video_id", F.struct(*vf).alias("video_info")).join(c, "video_id", "left")
