"""Scans, loads and status counts of the relational reel corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import engagement_rate, filled, impact_metric
from ..operators import media

# fixed values: known annotation sources in display order, work states
SOURCE_ORDER = ["keyword", "vision", "acoustic", "manual"]
STATES = ["pending", "done", "failed"]
HASHTAG = r"(?U)#(\w+)"


def ensure_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Add missing columns as typed nulls, so older tables read like new ones."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in spec.items() if c not in df.columns])


def tag_lists(tags: DataFrame, clean: Column | None = None) -> DataFrame:
    """Sorted distinct tags per reel; a caption holds few tags, so the lists stay short."""
    value = clean if clean is not None else F.col("hashtag")
    return tags.select("reel_pk", value.alias("h")).filter(filled("h")).groupBy("reel_pk").agg(F.array_sort(F.collect_set("h")).alias("hashtags"))


def _with_tags(reels: DataFrame, lists: DataFrame) -> DataFrame:
    return reels.join(lists, "reel_pk", "left").withColumn("hashtags", F.coalesce("hashtags", F.array().cast("array<string>")))


def scan_reels(reels: DataFrame, songs: DataFrame, tags: DataFrame, exclude_spam: bool = True) -> DataFrame:
    """Dated reels with song, tags, impact, engagement and URL, spam left out."""
    r = ensure_columns(reels, {"is_spam": "int", "code": "string", "caption_text": "string"})
    if exclude_spam:
        r = r.filter(F.coalesce("is_spam", F.lit(0)) == 0)
    r = r.filter(F.col("taken_at").isNotNull()).join(songs, "song_id", "left")
    out = r.withColumn("song_title", F.coalesce("song_title", "song_id")).withColumn("caption_text", F.coalesce("caption_text", F.lit("")))
    out = out.withColumn("impact_metric", impact_metric()).withColumn("engagement_rate", engagement_rate())
    return _with_tags(out.withColumn("instagram_url", F.concat(F.lit("https://www.instagram.com/reel/"), F.coalesce("code", F.lit("")))), tag_lists(tags))


# fixed values: the base columns of the scope scan
SCOPE_COLUMNS = {
    "reel_pk": "string", "code": "string", "creator_pseudo": "string", "song_id": "string", "song_title": "string", "artist": "string", "asset_id": "string",
    "variant_label": "string", "taken_at": "timestamp", "ingested_at": "timestamp", "like_count": "long", "play_count": "long", "view_count": "long",
    "comment_count": "long", "video_duration": "double", "caption_text": "string",
}


def scope_scan(reels: DataFrame, songs: DataFrame, tags: DataFrame) -> DataFrame:
    """The 16 base columns and the tag list."""
    r = ensure_columns(reels.join(songs, "song_id", "left"), SCOPE_COLUMNS)
    return _with_tags(r.select(*SCOPE_COLUMNS), tag_lists(tags, F.trim("hashtag")))


def caption_scan(reels: DataFrame, songs: DataFrame, tags: DataFrame) -> DataFrame:
    """Captions with song, creator and lower-cased tags without '#'."""
    r = ensure_columns(reels.join(songs, "song_id", "left"), {"caption_text": "string", "creator_pseudo": "string"})
    cols = ["reel_pk", "caption_text", "song_id", "song_title", "asset_id", "creator_pseudo"]
    return _with_tags(r.select(*cols), tag_lists(tags, F.lower(F.ltrim(F.trim("hashtag"), F.lit("#")))))


def label_lists(annotations: DataFrame, prefix: str | None = "vision") -> DataFrame:
    """Sorted distinct labels and "dimension:category" entries per reel, of sources that start with ``prefix``."""
    use = annotations if prefix is None else annotations.filter(F.col("source").startswith(prefix))
    return use.filter(filled("category")).groupBy("reel_pk").agg(
        F.array_sort(F.collect_set("category")).alias("vision_labels"),
        F.array_sort(F.collect_set(F.when(filled("dimension"), F.concat_ws(":", "dimension", "category")))).alias("vision_categories"),
        F.array_sort(F.collect_set("dimension")).alias("vision_dimensions"),
    )


def _with_labels(df: DataFrame, lists: DataFrame, names: Sequence[str]) -> DataFrame:
    out = df.join(lists.select("reel_pk", *names), "reel_pk", "left")
    for n in names:
        out = out.withColumn(n, F.coalesce(n, F.array().cast("array<string>")))
    return out


def graph_records(reels: DataFrame, songs: DataFrame, tags: DataFrame, annotations: DataFrame) -> DataFrame:
    """Reels with song, tags, vision labels and label entries."""
    return _with_labels(_with_tags(reels.join(songs, "song_id", "left"), tag_lists(tags, F.trim("hashtag"))), label_lists(annotations), ["vision_labels", "vision_categories"])


def explorer_records(reels: DataFrame, songs: DataFrame, tags: DataFrame, annotations: DataFrame) -> DataFrame:
    """Reels with song names, tags, labels, dimensions of any source and URL."""
    r = ensure_columns(reels.join(songs, "song_id", "left"), {"code": "string", "caption_text": "string"})
    r = r.withColumn("song_title", F.coalesce("song_title", "song_id")).withColumn("artist", F.coalesce("artist", F.lit("")))
    r = r.withColumn("url", F.when(filled("code"), F.concat(F.lit("https://www.instagram.com/reel/"), "code", F.lit("/"))))
    return _with_labels(_with_tags(r, tag_lists(tags)), label_lists(annotations, None), ["vision_labels", "vision_dimensions"])


def annotation_sets(annotations: DataFrame, sources: Sequence[str], min_confidence: float = 0.0) -> DataFrame:
    """Category set per reel and dimension of the chosen sources."""
    use = annotations.filter(F.col("source").isin(*sources) & (F.col("confidence") >= min_confidence))
    return use.groupBy("reel_pk", "dimension").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def available_sources(annotations: DataFrame) -> DataFrame:
    """Present sources, keyword always first, then the known order, then by name."""
    known = F.array(*[F.lit(s) for s in SOURCE_ORDER])
    found = annotations.filter(filled("source")).select("source").distinct()
    keyword = annotations.sparkSession.createDataFrame([("keyword",)], "source string")
    place = F.array_position(known, F.col("source"))
    return found.unionByName(keyword).distinct().select("source", F.when(place > 0, place).otherwise(len(SOURCE_ORDER) + 1).alias("ord")).orderBy("ord", "source")


def snapshots(runs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs in time order and the seen rows."""
    return runs.orderBy("started_at", "crawl_id"), seen


def variant_features(variants: DataFrame, acoustics: DataFrame) -> DataFrame:
    """Variants that have acoustic features."""
    return variants.join(acoustics.drop("song_id"), "asset_id")


def asset_master(music: DataFrame, acoustics: DataFrame, variants: DataFrame, songs: DataFrame, external: DataFrame, reels: DataFrame) -> DataFrame:
    """One row per asset: metadata, acoustics, variant, song, catalogue facts, impact and reach."""
    impact = media.impact_by_asset(reels)
    reach = media.variant_reach(variant_features(variants, acoustics), impact).select("asset_id", "reach_rank", "ratio_to_song_median")
    out = (
        music.join(acoustics.drop("song_id").withColumnRenamed("duration", "acoustic_duration"), "asset_id", "left")
        .join(variants.select("asset_id", "song_id", "variant_label"), "asset_id", "left")
        .join(songs, "song_id", "left").join(external, "asset_id", "left").join(impact, "asset_id", "left").join(reach, "asset_id", "left")
    )
    if "highlight_start_ms" in music.columns:
        out = out.withColumn("highlight_start_s", media.first_highlight("highlight_start_ms"))
    if "spotify_track_metadata" in music.columns:
        out = out.withColumn("spotify_url", media.catalog_track_url("spotify_track_metadata"))
    return out.orderBy(F.desc_nulls_last("median_impact"), "asset_id")


def new_index_rows(index: DataFrame, found: DataFrame) -> DataFrame:
    """Found (reel_pk, asset_id) rows that the index lacks."""
    return found.filter(filled("reel_pk")).dropDuplicates(["reel_pk", "asset_id"]).join(index.select("reel_pk", "asset_id"), ["reel_pk", "asset_id"], "left_anti")


def stream_media(pages: DataFrame) -> DataFrame:
    """Media of stored stream payloads (page_id, payload): previews skipped, one row per page and pk."""
    m = "struct<pk:string,id:string,code:string,play_count:long,taken_at:long>"
    j = F.from_json("payload", f"struct<stream_rows:array<struct<is_media_preview:boolean,items:array<struct<media:{m}>>>>>")
    rows = pages.select("page_id", F.posexplode(j["stream_rows"]).alias("r", "row")).filter(~F.coalesce("row.is_media_preview", F.lit(False)))
    items = rows.select("page_id", "r", F.posexplode("row.items").alias("i", "item")).filter(F.col("item.media").isNotNull())
    pk = F.coalesce(F.nullif("item.media.pk", F.lit("")), F.nullif("item.media.id", F.lit("")))
    flat = items.select("page_id", "r", "i", pk.alias("reel_pk"), "item.media").filter(F.col("reel_pk").isNotNull())
    return flat.groupBy("page_id", "reel_pk").agg(F.min_by("media", F.struct("r", "i")).alias("media")).select("page_id", "reel_pk", "media.code", "media.play_count")


def caption_tags(details: DataFrame) -> DataFrame:
    """Distinct lower-cased hashtags of captions."""
    found = F.regexp_extract_all(F.coalesce("caption_text", F.lit("")), F.lit(HASHTAG), F.lit(1))
    return details.select("reel_pk", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("hashtag")).distinct()


def detail_rows(details: DataFrame, salt: str) -> DataFrame:
    """Stored detail payload columns as reel rows: pseudonymous creator, time from epoch seconds."""
    from ..operators.quality import keyed_pseudonym

    at = F.coalesce(F.timestamp_seconds("taken_at_ts"), F.to_timestamp("taken_at"))
    return details.select(
        "reel_pk", "song_id", "asset_id", "variant_label", "code", keyed_pseudonym(F.coalesce("user_pk", F.lit("?")), salt).alias("creator_pseudo"), at.alias("taken_at"),
        F.coalesce("caption_text", F.lit("")).alias("caption_text"), "like_count", "play_count", "view_count", "comment_count", "video_duration",
    )


def work_queue(targets: DataFrame, state: DataFrame, key: str = "reel_pk", n: int | None = None, include_failed: bool = False) -> DataFrame:
    """Targets whose state is missing or pending, in key order."""
    closed = state.filter(~F.coalesce(F.col("status").isin("pending", *(["failed"] if include_failed else [])), F.lit(True))).select(key)
    out = targets.join(closed, key, "left_anti").orderBy(key)
    return out if n is None else out.limit(n)


def status_counts(state: DataFrame, states: Sequence[str] = tuple(STATES)) -> DataFrame:
    """Rows per state, missing states as zero."""
    n = state.groupBy("status").agg(F.count("*").alias("n"))
    names = state.sparkSession.createDataFrame([(s,) for s in states], "status string")
    return names.join(n, "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def replace_source(annotations: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Stored annotations with all rows of one source replaced."""
    return annotations.filter(F.col("source") != source).unionByName(fresh.withColumn("source", F.lit(source)), allowMissingColumns=True)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per corpus table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def distinct_counts(reels: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct non-empty creators, songs, assets and tags, each as its own small aggregation."""
    out = None
    for name, df, c in (("creators", reels, "creator_pseudo"), ("songs", reels, "song_id"), ("assets", reels, "asset_id"), ("hashtags", tags, "hashtag")):
        row = df.filter(filled(c)).agg(F.countDistinct(c).alias("n")).select(F.lit(name).alias("item"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def music_payloads(payloads: DataFrame) -> DataFrame:
    """Stored music payloads (asset_id, payload) as metadata rows; the asset block may sit at several depths."""
    p = F.col("payload")
    paths = [f"{r}{c}.music_info.music_asset_info" for r in ("$.response.", "$.") for c in ("metadata", "clips_metadata")] + ["$.response.music_asset_info", "$.music_asset_info"]
    bare = F.when(F.get_json_object(p, "$.audio_asset_id").isNotNull() | F.get_json_object(p, "$.progressive_download_url").isNotNull(), p)
    block = F.coalesce(*[F.get_json_object(p, x) for x in paths], bare)

    def get(k):
        return F.get_json_object("b", f"$.{k}")

    def flag(k):
        return F.when(get(k).isNotNull(), get(k).isin("true", "1").cast("int"))

    return payloads.select("asset_id", block.alias("b")).filter(F.col("b").isNotNull()).select(
        "asset_id", *[get(k).alias(k) for k in ("audio_asset_id", "audio_cluster_id", "title", "sanitized_title", "subtitle", "display_artist", "artist_id", "ig_username")],
        get("duration_in_ms").try_cast("long").alias("duration_ms"), flag("is_explicit").alias("is_explicit"), flag("has_lyrics").alias("has_lyrics"), get("lyrics").alias("lyrics"),
        get("highlight_start_times_in_ms").alias("highlight_start_ms"), get("spotify_track_metadata").alias("spotify_track_metadata"), get("licensed_music_subtype").alias("licensed_music_subtype"),
        flag("allows_saving").alias("allows_saving"), F.coalesce(get("cover_artwork_uri"), get("cover_artwork_thumbnail_uri")).alias("cover_artwork_uri"),
    )
