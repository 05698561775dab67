"""Queries for ingestion, data quality, privacy, enrichment, spam and exploration."""

from pyspark.sql import functions as F

from ..operators import explore, longitudinal as lo, media, quality, talk
from ..sources import adapters as a, discussions as d, reel_tables as rt
from .classify_queries import RULES, classified
from .registry import query
from .scope_queries import reels_with_songs
from .views import ACOUSTICS, ANNOTATIONS, CAPTIONS, CRAWLS, DOC_COMMENTS, REELS, SONGS, TAGS, THREADS, TURNS, VISION_STATE

TS = "'%Y-%m-%d %H:%M:%S'"

# conversations as threads: user and system turns are comments, an assistant turn answers the turn before it
CONV = f"""{TURNS}, cc AS (SELECT video_id, item_id AS comment_id, turn AS pos, author_channel_id, text, date, likes, role FROM turns WHERE role<>'assistant'),
cr AS (SELECT t.video_id, conv_id||'-'||(turn-1) AS comment_id, turn-1 AS comment_pos, 0 AS pos, item_id AS reply_id, t.author_channel_id, t.text, t.date, t.likes FROM turns t JOIN cc ON cc.comment_id=conv_id||'-'||(turn-1) WHERE t.role='assistant'),
cv AS (SELECT DISTINCT video_id FROM turns)"""


def conv(t):
    turns = a.conversation_comments(t.conversations)
    c = turns.filter("role <> 'assistant'").select("video_id", F.col("item_id").alias("comment_id"), F.col("turn").alias("pos"), "author_channel_id", "text", "date", "likes", "role")
    parent = F.concat_ws("-", F.substring_index("item_id", "-", 1), F.col("turn") - 1)
    r = turns.filter("role = 'assistant'").select(
        "video_id", parent.alias("comment_id"), (F.col("turn") - 1).alias("comment_pos"), F.lit(0).alias("pos"), F.col("item_id").alias("reply_id"), "author_channel_id", "text", "date", "likes"
    ).join(c.select("comment_id"), "comment_id", "left_semi")
    return turns.select("video_id").distinct(), c, r


def nested(t):
    """Conversations in the nested file format."""
    v, c, r = conv(t)
    v = v.withColumn("title", F.concat(F.lit("title "), "video_id")).withColumn("published_at", F.lit("2024-01-01T00:00:00Z")).withColumn("views", F.length("video_id").cast("long"))
    iso = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    c = c.withColumn("youtube_comment_id", F.col("comment_id")).withColumn("date", iso).withColumn("vader_sentiment", F.when(F.col("role") == "system", "N/A").otherwise((F.col("likes") % 7 / 10).cast("string")))
    r = r.withColumn("youtube_reply_id", F.col("reply_id")).withColumn("youtube_parent_id", F.col("comment_id")).withColumn("date", iso)
    return d.nest(v, c, r)


def through_json(t):
    """The nested corpus written to JSON text and parsed again with the file schema."""
    text = nested(t).select("video_id", F.to_json(F.struct("video_info", "comments")).alias("j"))
    return text.select("video_id", F.from_json("j", d.ENTRY).alias("e")).select("video_id", "e.*")


@query("flat_comments", f"""WITH {CONV} SELECT video_id, comment_id, row_number() OVER (PARTITION BY video_id ORDER BY pos)-1 AS pos, author_channel_id, text, strftime(date,{TS}) AS date, likes, CASE WHEN role<>'system' THEN (likes%7)/10 END AS sentiment FROM cc""")
def _(t):
    return d.comments(through_json(t)).select("video_id", "comment_id", "pos", "author_channel_id", "text", "date", "likes", "sentiment")


@query("flat_replies", f"WITH {CONV} SELECT video_id, comment_id, reply_id, author_channel_id, text, strftime(date,{TS}) AS date, likes FROM cr")
def _(t):
    return d.replies(through_json(t)).select("video_id", "comment_id", "reply_id", "author_channel_id", "text", "date", "likes")


@query("messages", f"WITH {CONV} SELECT video_id, strftime(date,{TS}) AS date, text, NULL::VARCHAR AS language, 'comment' AS kind FROM cc UNION ALL SELECT video_id, strftime(date,{TS}), text, NULL, 'reply' FROM cr")
def _(t):
    n = through_json(t)
    return d.messages(d.comments(n), d.replies(n))


_EMPTY = ["video_description", "video_title_language", "video_description_language", "video_duration", "channel_name", "channel_id", "author_name", "language"]
_ISO = "strftime(date,'%Y-%m-%dT%H:%M:%SZ')"


@query("export_rows", f"""WITH {CONV}, e AS (SELECT video_id, 'comment' AS comment_type, comment_id, '' AS reply_to_comment_id, comment_id AS youtube_comment_id, '' AS youtube_reply_id, '' AS youtube_parent_id, author_channel_id, 'N/A' AS author_subscribers, text, {_ISO} AS date, likes,
  '0' AS blob_sentiment, CASE WHEN role='system' THEN 'N/A' ELSE printf('%.1f', (likes%7)/10) END AS vader_sentiment FROM cc
 UNION ALL SELECT video_id, 'reply', reply_id, comment_id, '', reply_id, comment_id, author_channel_id, 'N/A', text, {_ISO}, likes, '0', '0' FROM cr)
SELECT e.*, 'title '||video_id AS video_title, length(video_id) AS video_views, 0::BIGINT AS video_likes, 0::BIGINT AS video_dislikes, '2024-01-01T00:00:00Z' AS published_at, {', '.join(f"'' AS {c}" for c in _EMPTY)} FROM e""")
def _(t):
    return d.export_rows(through_json(t))


@query("corpus_preview", f"WITH {CONV} SELECT video_id, 'title '||video_id AS title, count(comment_id) AS n_comments FROM cv LEFT JOIN cc USING (video_id) GROUP BY 1 ORDER BY video_id LIMIT 10")
def _(t):
    return d.preview(nested(t))


@query("corpus_totals", f"WITH {CONV} SELECT corpus, count(*) AS videos, CAST(sum(n) AS BIGINT) AS comments FROM (SELECT 'k'||length(video_id) AS corpus, video_id, count(comment_id) AS n FROM cv LEFT JOIN cc USING (video_id) GROUP BY 1,2) GROUP BY 1")
def _(t):
    return d.corpus_totals(nested(t).withColumn("corpus", F.concat(F.lit("k"), F.length("video_id"))))


@query("merged_corpora", """SELECT 'd'||doc_id AS video_id, CASE WHEN doc_id IN (SELECT page_id FROM pages) THEN 'page' WHEN lang='en' THEN 'second' ELSE 'first' END AS origin FROM documents WHERE true
 UNION SELECT 'd'||page_id, 'page' FROM pages""")
def _(t):
    ids = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("video_id"), "lang")
    first = ids.select("video_id", F.lit("first").alias("origin"))
    second = ids.filter("lang = 'en'").select("video_id", F.lit("second").alias("origin"))
    return d.merge_corpora([first, second, t.pages.select(F.concat(F.lit("d"), "page_id").alias("video_id"), F.lit("page").alias("origin"))])


@query("upserted_videos", """SELECT 'd'||doc_id AS video_id, CASE WHEN l.quality=1 THEN 'new' ELSE 'old' END AS title FROM documents LEFT JOIN labels l USING (doc_id)""")
def _(t):
    vid = F.concat(F.lit("d"), "doc_id").alias("video_id")

    def info(title, at):
        return F.struct(F.lit(title).alias("title"), at.alias("published_at")).alias("video_info")

    old = t.documents.select(vid, info("old", F.col("n_chars").cast("string")))
    fresh = t.labels.select(vid, F.when(F.col("quality") == 1, F.struct(F.lit("new").alias("title"), F.lit("0").alias("published_at"))).alias("video_info"))
    return d.upsert_videos(old, fresh).select("video_id", "video_info.title")


@query("title_search", f"WITH {THREADS} SELECT video_id FROM videos WHERE year(published_at)=1997 AND contains(title,'1997') AND contains(title,'title') AND NOT contains(title,'/3')")
def _(t):
    c = a.thread_comments(t.orders)
    return d.title_matches(a.thread_videos(c), 1997, ["Title", "1997"], ["/3"])


@query("video_payloads", """SELECT 'p'||p_partkey AS video_id, p_name AS title, '' AS description, '2024-03-01 12:00:00' AS published_at, p_brand AS channel_name, '' AS channel_id, 'PT'||p_size||'S' AS duration,
 p_size::BIGINT AS likes, 0::BIGINT AS dislikes, CASE WHEN p_type='PROMO' THEN 0 ELSE p_partkey END AS views, false AS manual_review FROM part""")
def _(t):
    raw = """to_json(named_struct('items', array(named_struct('id', concat('p', p_partkey), 'snippet', named_struct('title', p_name, 'publishedAt', '2024-03-01T13:00:00+01:00', 'channelTitle', p_brand),
     'statistics', named_struct('likeCount', cast(p_size as string), 'viewCount', if(p_type = 'PROMO', 'hidden', cast(p_partkey as string))), 'contentDetails', named_struct('duration', concat('PT', p_size, 'S'))))))"""
    return d.video_payloads(t.part.select(F.expr(raw).alias("payload")))


@query("thread_payloads", """SELECT 'c'||o_custkey AS video_id, 't'||o_orderkey AS youtube_comment_id, o_orderpriority AS text, floor(o_totalprice/1000)::BIGINT AS likes, 'u'||o_custkey AS author_channel_id, (o_orderstatus='F')::BIGINT AS n_replies,
 CASE WHEN o_orderstatus='F' THEN 'r'||o_orderkey ELSE '' END AS reply_ids FROM orders""")
def _(t):
    raw = """to_json(named_struct('items', array(named_struct('id', concat('t', o_orderkey), 'snippet', named_struct('topLevelComment', named_struct('snippet', named_struct('textDisplay', o_orderpriority, 'publishedAt', '2024-01-01T00:00:00Z',
     'likeCount', floor(o_totalprice / 1000), 'authorChannelId', named_struct('value', concat('u', o_custkey)))), 'totalReplyCount', 1),
     'replies', if(o_orderstatus = 'F', named_struct('comments', array(named_struct('id', concat('r', o_orderkey), 'snippet', named_struct('textDisplay', 'ok', 'parentId', concat('t', o_orderkey))))), null)),
     named_struct('id', 'broken', 'snippet', named_struct('topLevelComment', null, 'totalReplyCount', 0), 'replies', null))))"""
    n = d.thread_payloads(t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("video_id"), F.expr(raw).alias("payload")))
    return n.select("video_id", F.explode("comments").alias("c")).select(
        "video_id", "c.youtube_comment_id", "c.text", "c.likes", "c.author_channel_id", F.size("c.replies").alias("n_replies"), F.transform("c.replies", lambda r: r["youtube_reply_id"]).alias("reply_ids")
    )


# reel tables -----------------------------------------------------------------

RT = f"{REELS}, {SONGS}, {TAGS}, lists AS (SELECT reel_pk, array_to_string(list(DISTINCT hashtag ORDER BY hashtag),'|') AS hashtags FROM reel_hashtags GROUP BY 1)"


def plain_reels(t):
    return a.reels(t.orders).drop("impact_metric", "engagement_rate")


def tags(t):
    return a.reel_hashtags(t.lineitem, t.part)


@query("reel_scan", f"""WITH {RT} SELECT reel_pk, coalesce(song_title, song_id) AS song_title, artist, coalesce(hashtags,'') AS hashtags, impact_metric, round(engagement_rate,6) AS engagement_rate FROM reels LEFT JOIN songs USING (song_id) LEFT JOIN lists USING (reel_pk)
 WHERE NOT (view_count IS NULL)""")
def _(t):
    r = plain_reels(t).withColumn("is_spam", F.col("view_count").isNull().cast("int"))
    return rt.scan_reels(r, a.songs(t.orders), tags(t)).select("reel_pk", "song_title", "artist", "hashtags", "impact_metric", "engagement_rate")


@query("scope_scan", f"""WITH {RT} SELECT reel_pk, NULL::VARCHAR AS code, creator_pseudo, song_id, song_title, artist, asset_id, variant_label, strftime(taken_at,{TS}) AS taken_at, NULL::VARCHAR AS ingested_at, like_count, play_count, view_count, comment_count,
 round(video_duration,6) AS video_duration, NULL::VARCHAR AS caption_text, coalesce(hashtags,'') AS hashtags FROM reels LEFT JOIN songs USING (song_id) LEFT JOIN lists USING (reel_pk)""")
def _(t):
    return rt.scope_scan(plain_reels(t), a.songs(t.orders), tags(t))


@query("caption_scan", f"WITH {RT} SELECT reel_pk, NULL::VARCHAR AS caption_text, song_id, song_title, asset_id, creator_pseudo, coalesce(hashtags,'') AS hashtags FROM reels LEFT JOIN songs USING (song_id) LEFT JOIN lists USING (reel_pk)")
def _(t):
    return rt.caption_scan(plain_reels(t), a.songs(t.orders), tags(t))


LISTS = """lab AS (SELECT reel_pk, list(DISTINCT category ORDER BY category) AS l, list(DISTINCT dimension||':'||category ORDER BY dimension||':'||category) AS c, list(DISTINCT dimension ORDER BY dimension) AS d FROM annotations {where} GROUP BY 1)"""


@query("graph_records", f"WITH {RT}, {ANNOTATIONS}, {LISTS.format(where=chr(87)+'HERE starts_with(source, ' + repr('vision') + ')')} SELECT reel_pk, song_title, coalesce(hashtags,'') AS hashtags, coalesce(array_to_string(l,'|'),'') AS vision_labels, coalesce(array_to_string(c,'|'),'') AS vision_categories FROM reels LEFT JOIN songs USING (song_id) LEFT JOIN lists USING (reel_pk) LEFT JOIN lab USING (reel_pk)")
def _(t):
    return rt.graph_records(plain_reels(t), a.songs(t.orders), tags(t), a.annotations(t.labels)).select("reel_pk", "song_title", "hashtags", "vision_labels", "vision_categories")


def records(t):
    return rt.explorer_records(a.reels(t.orders), a.songs(t.orders), tags(t), a.annotations(t.labels))


REC = f"{RT}, {ANNOTATIONS}, {LISTS.format(where='')}, rec AS (SELECT r.*, coalesce(song_title, r.song_id) AS song_title, coalesce(artist,'') AS artist, coalesce(hashtags,'') AS hashtags, coalesce(array_to_string(l,'|'),'') AS vision_labels, coalesce(array_to_string(d,'|'),'') AS vision_dimensions FROM reels r LEFT JOIN songs s ON s.song_id=r.song_id LEFT JOIN lists USING (reel_pk) LEFT JOIN lab USING (reel_pk))"


@query("explorer_records", f"WITH {REC} SELECT reel_pk, song_title, artist, hashtags, vision_labels, vision_dimensions FROM rec")
def _(t):
    return records(t).select("reel_pk", "song_title", "artist", "hashtags", "vision_labels", "vision_dimensions")


@query("annotation_sets", f"WITH {ANNOTATIONS} SELECT reel_pk, dimension, array_to_string(list(DISTINCT category ORDER BY category),'|') AS categories FROM annotations WHERE source IN ('vision','manual') AND confidence>=0.3 GROUP BY 1,2")
def _(t):
    return rt.annotation_sets(a.annotations(t.labels), ["vision", "manual"], 0.3)


@query("available_sources", f"WITH {ANNOTATIONS} SELECT source, list_position(['keyword','vision','acoustic','manual'], source)::BIGINT AS ord FROM (SELECT DISTINCT source FROM annotations UNION SELECT 'keyword')")
def _(t):
    return rt.available_sources(a.annotations(t.labels))


@query("snapshot_scan", f"WITH {CRAWLS} SELECT crawl_id, reel_pk, asset_id, play_count FROM seen JOIN runs USING (crawl_id)")
def _(t):
    runs, seen = rt.snapshots(*a.crawl_rows(t.events))
    return seen.join(runs.select("crawl_id"), "crawl_id", "left_semi").select("crawl_id", "reel_pk", "asset_id", "play_count")


@query("variant_features", f"WITH {ACOUSTICS}, v AS (SELECT DISTINCT printf('a%06d', doc_id) AS asset_id, source AS song_id FROM documents) SELECT asset_id, v.song_id, tempo, est_key FROM v JOIN acoustics USING (asset_id)")
def _(t):
    v = t.documents.select(F.format_string("a%06d", "doc_id").alias("asset_id"), F.col("source").alias("song_id"))
    return rt.variant_features(v, a.acoustics(t.embeddings)).select("asset_id", "song_id", "tempo", "est_key")


@query("asset_master", f"""WITH {ACOUSTICS}, r AS (SELECT printf('a%06d', doc_id%400) AS asset_id, n_chars::DOUBLE AS m FROM documents), i AS (SELECT asset_id, count(*) AS n_reels, quantile_cont(m,0.5) AS median_impact FROM r GROUP BY 1), s AS (SELECT song_id, quantile_cont(median_impact,0.5) AS mid FROM acoustics LEFT JOIN i USING (asset_id) GROUP BY 1)
SELECT asset_id, a.song_id, 'song '||a.song_id AS song_title, tempo, n_reels, median_impact, row_number() OVER (PARTITION BY a.song_id ORDER BY median_impact DESC NULLS LAST, asset_id) AS reach_rank, round(median_impact/mid,6) AS ratio_to_song_median, round(pc/2.0,2) AS highlight_start_s,
 'https://open.spotify.com/track/'||asset_id AS spotify_url, CASE WHEN q='Major' THEN 'done' END AS external_state FROM acoustics a LEFT JOIN i USING (asset_id) JOIN s ON s.song_id=a.song_id""")
def _(t):
    ac = a.acoustics(t.embeddings)
    pc = media.key_class("est_key")
    music = ac.select("asset_id", F.to_json(F.array(pc * 500)).alias("highlight_start_ms"), F.to_json(F.struct(F.col("asset_id").alias("id"))).alias("spotify_track_metadata"))
    variants = ac.select("asset_id", "song_id", F.lit("v").alias("variant_label"))
    songs = ac.select("song_id").distinct().withColumn("song_title", F.concat(F.lit("song "), "song_id"))
    external = ac.select("asset_id", F.when(F.col("est_key").endswith("Major"), "done").alias("external_state"))
    reels = t.documents.select(F.format_string("a%06d", F.col("doc_id") % 400).alias("asset_id"), F.col("n_chars").cast("double").alias("impact_metric"))
    out = rt.asset_master(music, ac, variants, songs, external, reels)
    return out.select("asset_id", "song_id", "song_title", "tempo", "n_reels", "median_impact", "reach_rank", "ratio_to_song_median", "highlight_start_s", "spotify_url", "external_state")


@query("new_index_rows", "SELECT DISTINCT l_orderkey AS reel_pk, l_partkey AS asset_id FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag='R')")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("reel_pk"), F.col("l_partkey").alias("asset_id"), "l_returnflag")
    return rt.new_index_rows(rows.filter("l_returnflag = 'R'"), rows).select(F.col("reel_pk").cast("long").alias("reel_pk"), "asset_id")


@query("stream_media", "SELECT p_partkey AS page_id, 'm'||p_partkey AS reel_pk, p_name AS code, p_size::BIGINT AS play_count FROM part UNION ALL SELECT p_partkey, 'x', p_brand, NULL FROM part")
def _(t):
    raw = """to_json(named_struct('stream_rows', array(
      named_struct('is_media_preview', true, 'items', array(named_struct('media', named_struct('pk', 'preview', 'id', null, 'code', 'c', 'play_count', 1L)))),
      named_struct('is_media_preview', false, 'items', array(named_struct('media', named_struct('pk', concat('m', p_partkey), 'id', null, 'code', p_name, 'play_count', cast(p_size as bigint))), named_struct('media', named_struct('pk', null, 'id', 'x', 'code', p_brand, 'play_count', null)))),
      named_struct('is_media_preview', null, 'items', array(named_struct('media', named_struct('pk', concat('m', p_partkey), 'id', null, 'code', 'again', 'play_count', 0L)), named_struct('media', null))))))"""
    return rt.stream_media(t.part.select(F.col("p_partkey").alias("page_id"), F.expr(raw).alias("payload")))


@query("detail_rows", f"WITH {REELS} SELECT reel_pk, strftime(taken_at,{TS}) AS taken_at, like_count, '' AS caption_text FROM reels")
def _(t):
    r = plain_reels(t).withColumn("taken_at_ts", F.unix_seconds("taken_at")).withColumn("taken_at", F.lit(None).cast("string")).withColumn("user_pk", F.col("creator_pseudo")).withColumn("code", F.lit(None).cast("string")).withColumn("caption_text", F.lit(None).cast("string"))
    return rt.detail_rows(r, "salt").select("reel_pk", "taken_at", "like_count", "caption_text")


@query("caption_hashtags", r"SELECT DISTINCT page_id AS reel_pk, unnest(list_transform(regexp_extract_all(url||' '||html, '#([\p{L}\p{M}\p{N}_]+)', 1), lambda x: lower(x))) AS hashtag FROM pages")
def _(t):
    return rt.caption_tags(t.pages.select(F.col("page_id").alias("reel_pk"), F.concat_ws(" ", "url", "html").alias("caption_text")))


@query("work_queue", f"WITH {VISION_STATE} SELECT doc_id AS reel_pk FROM documents WHERE doc_id NOT IN (SELECT reel_pk FROM vision_state WHERE status NOT IN ('pending','failed')) ORDER BY 1 LIMIT 300")
def _(t):
    return rt.work_queue(t.documents.select(F.col("doc_id").alias("reel_pk")), a.vision_state(t.labels), n=300, include_failed=True)


@query("status_counts", f"WITH {VISION_STATE} SELECT s AS status, (SELECT count(*) FROM vision_state WHERE status=s) AS n FROM (SELECT unnest(['pending','done','failed']) AS s)")
def _(t):
    return rt.status_counts(a.vision_state(t.labels))


@query("replaced_source", f"WITH {ANNOTATIONS} SELECT reel_pk, dimension, category, source FROM annotations WHERE source<>'vision' UNION ALL SELECT doc_id, 'sonic', lang, 'vision' FROM documents")
def _(t):
    fresh = t.documents.select(F.col("doc_id").alias("reel_pk"), F.lit("sonic").alias("dimension"), F.col("lang").alias("category"))
    return rt.replace_source(a.annotations(t.labels), fresh, "vision").select("reel_pk", "dimension", "category", "source")


@query("corpus_status", f"""WITH {RT}, {ANNOTATIONS} SELECT 'reels' AS item, count(*) AS n FROM reels UNION ALL SELECT 'songs', count(*) FROM songs UNION ALL SELECT 'reel_hashtags', count(*) FROM reel_hashtags UNION ALL SELECT 'annotations', count(*) FROM annotations
 UNION ALL SELECT 'distinct creators', count(DISTINCT creator_pseudo) FROM reels UNION ALL SELECT 'distinct songs', count(DISTINCT song_id) FROM reels UNION ALL SELECT 'distinct assets', count(DISTINCT asset_id) FROM reels UNION ALL SELECT 'distinct hashtags', count(DISTINCT hashtag) FROM reel_hashtags""")
def _(t):
    r, h = a.reels(t.orders), tags(t)
    counts = rt.table_counts({"reels": r, "songs": a.songs(t.orders), "reel_hashtags": h, "annotations": a.annotations(t.labels)})
    return counts.unionByName(rt.distinct_counts(r, h).withColumn("item", F.concat(F.lit("distinct "), "item")))


@query("music_payloads", """SELECT 'p'||p_partkey AS asset_id, p_name AS title, p_brand AS display_artist, p_size::BIGINT AS duration_ms, (p_type='PROMO')::BIGINT AS is_explicit, '['||p_size||',2]' AS highlight_start_ms, p_type AS cover_artwork_uri FROM part""")
def _(t):
    block = "named_struct('title', p_name, 'display_artist', p_brand, 'duration_in_ms', p_size, 'is_explicit', p_type = 'PROMO', 'highlight_start_times_in_ms', array(p_size, 2), 'cover_artwork_thumbnail_uri', p_type, 'audio_asset_id', '1')"
    raw = f"CASE WHEN p_size % 3 = 0 THEN to_json({block}) WHEN p_size % 3 = 1 THEN to_json(named_struct('response', named_struct('metadata', named_struct('music_info', named_struct('music_asset_info', {block}))))) ELSE to_json(named_struct('clips_metadata', named_struct('music_info', named_struct('music_asset_info', {block})))) END"
    out = rt.music_payloads(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("asset_id"), F.expr(raw).alias("payload")))
    return out.select("asset_id", "title", "display_artist", "duration_ms", "is_explicit", "highlight_start_ms", "cover_artwork_uri")


# quality ---------------------------------------------------------------------


@query("record_structure", "SELECT DISTINCT unnest(json_keys(props)) AS path, CASE json_type(props, '$.' || unnest(json_keys(props))) WHEN 'UBIGINT' THEN 'bigint' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM events")
def _(t):
    return quality.infer_structure(t.events, "props")


NESTED_PATHS = {
    "comments": "list", "comments[].author_channel_id": "string", "comments[].date": "string", "comments[].likes": "bigint", "comments[].replies": "list", "comments[].replies[].author_channel_id": "string",
    "comments[].replies[].date": "string", "comments[].replies[].likes": "bigint", "comments[].replies[].text": "string", "comments[].replies[].youtube_parent_id": "string",
    "comments[].replies[].youtube_reply_id": "string", "comments[].text": "string", "comments[].vader_sentiment": "string", "comments[].youtube_comment_id": "string",
    "video_info.published_at": "string", "video_info.title": "string", "video_info.views": "bigint",
}


@query("nested_structure", f"SELECT * FROM (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in NESTED_PATHS.items())}) AS s(path, type) WHERE EXISTS (SELECT 1 FROM conversations)")
def _(t):
    return quality.infer_structure(nested(t).select(F.to_json(F.struct("video_info", "comments")).alias("j")), "j")


DUPES = f"""{CONV}, dc AS (SELECT video_id, author_channel_id AS comment_id, pos, text, role FROM cc), dr AS (SELECT video_id, comment_pos, pos, author_channel_id AS reply_id, text FROM cr)"""


def duplicated(t):
    """Threads whose ids are the short author ids, so many of them repeat."""
    v, c, r = conv(t)
    return v, c.select("video_id", F.col("author_channel_id").alias("comment_id"), "pos", "text", "role"), r.select("video_id", "comment_pos", "pos", F.col("author_channel_id").alias("reply_id"), "text")


@query("duplicate_ids", f"""WITH {DUPES}, p AS (SELECT 'video_id' AS bucket, video_id AS id, '/'||video_id AS path FROM cv UNION ALL SELECT 'comment_id', comment_id, '/'||video_id||'/comments['||pos||']' FROM dc UNION ALL SELECT 'reply_id', reply_id, '/'||video_id||'/comments['||comment_pos||']/replies['||pos||']' FROM dr)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY bucket, id) AS n FROM p) WHERE n>1""")
def _(t):
    return quality.duplicate_ids(*duplicated(t))


PURGE = f"""{DUPES}, sr AS (SELECT *, 2+length(reply_id)+1+length(text)+1 AS score FROM dr), th AS (SELECT video_id, comment_pos AS pos, sum(score) AS rs, count(*) AS rn FROM sr GROUP BY 1,2),
sc AS (SELECT dc.*, 3+length(comment_id)+1+length(text)+1+length(role)+1+coalesce(rs,0)+3*coalesce(rn,0) AS score FROM dc LEFT JOIN th USING (video_id, pos)),
mc AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY score DESC, video_id, pos)=1 AS kept FROM sc), mr AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY score DESC, video_id, comment_pos, pos)=1 AS kept FROM sr)"""


@query("purged_comments", f"WITH {PURGE} SELECT video_id, comment_id, pos, CAST(score AS BIGINT) AS score, kept FROM mc")
def _(t):
    _v, c, r = duplicated(t)
    return quality.purge_duplicates(c, r, ["comment_id", "text", "role"], ["reply_id", "text"])[0].select("video_id", "comment_id", "pos", "score", "kept")


@query("purge_report", f"WITH {PURGE} SELECT 'comment_id' AS bucket, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS removed FROM mc UNION ALL SELECT 'reply_id', count(*) FILTER (kept), count(*) FILTER (NOT kept) FROM mr")
def _(t):
    _v, c, r = duplicated(t)
    mc, mr = quality.purge_duplicates(c, r, ["comment_id", "text", "role"], ["reply_id", "text"])
    return quality.purge_report(mc, "comment_id").unionByName(quality.purge_report(mr, "reply_id"))


@query("pseudonym_map", "SELECT 'u'||o_custkey AS id, 'User'||row_number() OVER (ORDER BY 'u'||o_custkey) AS token FROM (SELECT DISTINCT o_custkey FROM orders)")
def _(t):
    return quality.extend_pseudonyms(t.orders.select(F.concat(F.lit("u"), "o_custkey").alias("id")))


@query("pseudonym_map_extended", """WITH old AS (SELECT 'u'||s_suppkey AS id, 'Old'||s_suppkey AS token FROM supplier), n AS (SELECT DISTINCT 'u'||o_custkey AS id FROM orders WHERE 'u'||o_custkey NOT IN (SELECT id FROM old))
SELECT * FROM old UNION ALL SELECT id, 'User'||(row_number() OVER (ORDER BY id)+(SELECT count(*) FROM old)) FROM n""")
def _(t):
    old = t.supplier.select(F.concat(F.lit("u"), "s_suppkey").alias("id"), F.concat(F.lit("Old"), "s_suppkey").alias("token"))
    return quality.extend_pseudonyms(t.orders.select(F.concat(F.lit("u"), "o_custkey").alias("id")), old)


@query("pseudonymised_comments", f"WITH {CONV}, m AS (SELECT a AS id, 'User'||row_number() OVER (ORDER BY a) AS token FROM (SELECT DISTINCT author_channel_id AS a FROM cc)) SELECT comment_id, author_channel_id, token AS anonymized_author_channel_id, token AS anonymized_author_name FROM cc JOIN m ON id=author_channel_id")
def _(t):
    _v, c, _r = conv(t)
    out = quality.pseudonymise(c, quality.extend_pseudonyms(c.select("author_channel_id")), "author_channel_id", "author_name")
    return out.select("comment_id", "author_channel_id", "anonymized_author_channel_id", "anonymized_author_name")


@query("depseudonymised_report", f"WITH {CONV} SELECT count(*) AS anonymized_author_channel_id, count(*) AS anonymized_author_name FROM cc")
def _(t):
    _v, c, _r = conv(t)
    out = quality.pseudonymise(c, quality.extend_pseudonyms(c.select("author_channel_id")), "author_channel_id", "author_name")
    return quality.depseudonymise_report(out)


def _hmac_sql(c: str, salt: str) -> str:
    key = salt.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))
    return f"substr(sha256(unhex('{outer}')||unhex(sha256(unhex('{inner}')||encode({c})))),1,24)"


@query("keyed_pseudonyms", f"SELECT DISTINCT o_custkey, {_hmac_sql('o_custkey::VARCHAR', 'a salt')} AS pseudonym FROM orders")
def _(t):
    return t.orders.select("o_custkey").distinct().select("o_custkey", quality.keyed_pseudonym(F.col("o_custkey"), "a salt").alias("pseudonym"))


@query("reviewed_videos", "SELECT 'd'||doc_id AS video_id, coalesce(quality=1, false) AS manual_review FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality,1)=1")
def _(t):
    vid = F.concat(F.lit("d"), "doc_id").alias("video_id")
    return quality.drop_rejected(t.documents.select(vid), t.labels.select(vid, (F.col("quality") == 1).alias("keep")))


GRAMS = r"""w AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x<>'')) AS w FROM documents), wc AS (SELECT doc_id, lang, ' '||w||' ' AS w, count(*) AS k FROM w GROUP BY ALL),
g AS (SELECT doc_id, lang, k, unnest(list_transform(range(1, length(w)-1), lambda i: substr(w, i, 3))) AS trigram FROM wc),
gc AS (SELECT doc_id, lang, trigram, sum(k) AS n FROM g GROUP BY doc_id, lang, trigram), pc AS (SELECT lang AS language, trigram, sum(n) AS n FROM gc WHERE lang IS NOT NULL GROUP BY 1,2), pf AS (SELECT language, trigram, CAST(round(ln(1+n*1e6/sum(n) OVER (PARTITION BY language)),6) AS DECIMAL(18,6)) AS weight FROM pc)"""


@query("language_profiles", f"WITH {GRAMS} SELECT language, trigram, round(weight::DOUBLE,6) AS weight FROM pf")
def _(t):
    return quality.language_profiles(a.doc_comments(t.documents))


@query("detected_languages", f"""WITH {GRAMS}, s AS (SELECT doc_id, language, sum(n*weight) AS score FROM gc JOIN pf USING (trigram) GROUP BY 1,2), b AS (SELECT DISTINCT ON (doc_id) doc_id, language FROM s ORDER BY doc_id, score DESC, language)
SELECT doc_id, coalesce(language,'unknown') AS detected FROM documents LEFT JOIN b USING (doc_id)""")
def _(t):
    return quality.detect_language(t.documents, quality.language_profiles(a.doc_comments(t.documents)), "doc_id")


LEXICON = [("the", 0.5), ("and", -0.25), ("for", 1.5), ("tion", 2.0), ("that", -1.0), ("who", 0.75), ("on", -0.5), ("in", 0.25)]


@query("lexicon_sentiment", f"""WITH lex(term, valence) AS (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON)}), k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')) AS term FROM documents WHERE lang='en' AND trim(text)<>''),
s AS (SELECT doc_id, sum(valence) AS s FROM k JOIN lex USING (term) GROUP BY 1) SELECT doc_id, CASE WHEN lang='en' AND trim(text)<>'' THEN round(coalesce(s,0)/sqrt(coalesce(s,0)*coalesce(s,0)+15),2) END AS sentiment FROM documents LEFT JOIN s USING (doc_id)""")
def _(t):
    m = t.documents.withColumn("language", F.col("lang"))
    quality.require_languages(m)
    return quality.lexicon_sentiment(m, t.spark.createDataFrame(LEXICON, "term string, valence double"), "doc_id")


@query("caption_languages", """WITH s AS (SELECT 'song' AS scope, source AS song_id, lang AS language, count(*) AS count FROM documents GROUP BY 2,3), r AS (SELECT * FROM s UNION ALL SELECT 'overall', NULL, language, CAST(sum(count) AS BIGINT) FROM s GROUP BY 3)
SELECT *, round(count/sum(count) OVER (PARTITION BY scope, song_id),4) AS share FROM r""")
def _(t):
    return quality.caption_languages(t.documents.select(F.col("source").alias("song_id"), F.col("lang").alias("language")))


# spam ------------------------------------------------------------------------

SPAM_TERMS = ["license", "zz", "schen"]
SPAM = f"""{CAPTIONS}, {VISION_STATE}, fl AS (SELECT c.*, (n_/7)::BIGINT AS like_count, status AS vstatus, contains(lower(caption_text),'license') OR contains(lower(caption_text),'zz') OR contains(lower(caption_text),'schen') AS is_term, coalesce(status='blocked', false) AS is_blocked
 FROM (SELECT *, play_count AS n_ FROM captions) c LEFT JOIN vision_state USING (reel_pk)), f AS (SELECT *, is_term OR is_blocked AS is_spam FROM fl)"""


def flagged(t):
    r = a.caption_reels(t.documents).withColumn("like_count", F.round(F.col("play_count") / 7, 0).cast("long"))
    return quality.flag_spam(r, SPAM_TERMS, a.vision_state(t.labels))


@query("spam_flags", f"WITH {SPAM} SELECT reel_pk, is_term, is_blocked, is_spam FROM f")
def _(t):
    return flagged(t).select("reel_pk", "is_term", "is_blocked", "is_spam")


@query("spam_diff", f"WITH {SPAM}, o AS (SELECT *, play_count>2000 AS old FROM f) SELECT count(*) FILTER (is_spam AND NOT old) AS newly_flagged, count(*) FILTER (NOT is_spam AND old) AS unflagged, count(*) FILTER (is_spam) AS flagged FROM o")
def _(t):
    before = a.caption_reels(t.documents).select("reel_pk", (F.col("play_count") > 2000).alias("is_spam"))
    return quality.spam_diff(before, flagged(t))


_BY = "SELECT {k}, count(*) FILTER (is_spam) AS spam, count(*) AS total, round(count(*) FILTER (is_spam)/count(*),6) AS rate FROM f GROUP BY 1 HAVING count(*) FILTER (is_spam)>0 ORDER BY spam DESC, {k} LIMIT 15"
SPAM_SQL = {
    "kpis": "SELECT count(*) AS total, count(*) FILTER (is_spam) AS flagged, count(*) FILTER (is_term) AS by_term, count(*) FILTER (is_blocked) AS by_block, count(*) FILTER (is_term AND is_blocked) AS both_reasons, count(DISTINCT creator_pseudo) FILTER (is_spam) AS creators FROM f",
    "terms": "SELECT term, count(*) AS reels FROM f, (SELECT unnest(['license','zz','schen']) AS term) WHERE contains(lower(caption_text), term) GROUP BY 1",
    "states": "SELECT coalesce(vstatus,'(no vision record)') AS state, count(*) AS reels FROM f GROUP BY 1",
    "songs": _BY.format(k="song_id"),
    "variants": _BY.format(k="variant_label"),
    "daily": "SELECT strftime(day,'%Y-%m-%d') AS day, spam, spam>=greatest(m+2*s,2) AND spam>m AS spike FROM (SELECT *, avg(spam) OVER () AS m, stddev_pop(spam) OVER () AS s FROM (SELECT taken_at::DATE AS day, count(*) AS spam FROM f WHERE is_spam GROUP BY 1))",
    "concentration": "SELECT count(*) AS creators, count(*) FILTER (spam>=3) AS repeaters, round(100.0*(SELECT sum(spam) FROM (SELECT spam FROM c ORDER BY spam DESC, creator_pseudo LIMIT 5))/(SELECT count(*) FROM f WHERE is_spam),6) AS top5_share_pct FROM c",
    "creators": "SELECT creator_pseudo, spam FROM c ORDER BY spam DESC, creator_pseudo LIMIT 15",
    "captions": "SELECT lower(trim(caption_text)) AS caption, count(*) AS reels FROM f WHERE is_spam GROUP BY 1 HAVING count(*)>1 AND caption<>'' ORDER BY reels DESC, caption LIMIT 12",
    "engagement": "SELECT 'like_count' AS metric, round(avg(like_count) FILTER (is_spam),6) AS spam_mean, round(avg(like_count) FILTER (NOT is_spam),6) AS other_mean FROM f UNION ALL SELECT 'play_count', round(avg(play_count) FILTER (is_spam),6), round(avg(play_count) FILTER (NOT is_spam),6) FROM f",
}
for _name, _sql in SPAM_SQL.items():
    @query(f"spam_report_{_name}", f"WITH {SPAM}, c AS (SELECT creator_pseudo, count(*) AS spam FROM f WHERE is_spam GROUP BY 1) {_sql}")
    def _(t, name=_name):
        return quality.spam_report(flagged(t))[name]


@query("blocked_list", f"WITH {CAPTIONS}, {VISION_STATE}, {ANNOTATIONS}, g AS (SELECT reel_pk, string_agg(DISTINCT dimension||':'||category, ', ' ORDER BY dimension||':'||category) AS tags FROM annotations WHERE source<>'vision' GROUP BY 1) SELECT reel_pk, song_id, coalesce(tags,'') AS tags FROM vision_state JOIN captions USING (reel_pk) LEFT JOIN g USING (reel_pk) WHERE status='blocked'")
def _(t):
    return quality.blocked_list(a.vision_state(t.labels), a.caption_reels(t.documents), a.annotations(t.labels)).select("reel_pk", "song_id", "tags")


@query("tagging_coverage", f"""WITH {VISION_STATE} SELECT count(*) AS total, count(*) FILTER (status='done') AS done, round(100.0*count(*) FILTER (status='done')/count(*),6) AS done_pct, count(*) FILTER (status IS DISTINCT FROM 'done') AS open, count(*) FILTER (status='pending') AS pending,
 count(*) FILTER (status='no_media') AS no_media, count(*) FILTER (status='blocked') AS blocked, count(*) FILTER (status='failed') AS failed, count(*) FILTER (status IS NULL) AS no_record FROM documents LEFT JOIN vision_state ON doc_id=reel_pk""")
def _(t):
    return quality.tagging_coverage(a.caption_reels(t.documents), a.vision_state(t.labels))


@query("models_used", "SELECT DISTINCT lang AS model FROM documents WHERE lang<>'es'")
def _(t):
    return quality.models_used(t.documents.select(F.lit("vision").alias("source"), F.when(F.col("lang") != "es", F.col("lang")).alias("model")))


@query("coverage_by_state", "SELECT coalesce(nullif(o_orderstatus,'P'),'(unset)') AS audio_source, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return quality.coverage_by(t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("audio_source")), "audio_source")


# exploration -----------------------------------------------------------------

HIT = "(contains(lower(text),'tion') OR contains(lower(text),'eau'))"


@query("filtered_comments", f"WITH {CONV}, hr AS (SELECT * FROM cr WHERE {HIT}) SELECT comment_id, video_id FROM cc WHERE {HIT} OR comment_id IN (SELECT comment_id FROM hr)")
def _(t):
    return explore.filter_threads(*conv(t), ["tion", "EAU"])[1].select("comment_id", "video_id")


@query("filtered_videos_all_terms", f"WITH {CONV}, m AS (SELECT video_id, text FROM cc UNION ALL SELECT video_id, text FROM cr) SELECT DISTINCT video_id FROM m WHERE contains(lower(text),'tion') AND contains(lower(text),'eau')")
def _(t):
    return explore.filter_threads(*conv(t), ["tion", "eau"], mode="and")[0].select("video_id")


@query("keyword_snippets", r"""WITH c AS (SELECT doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS t FROM documents), p AS (SELECT doc_id, t, string_split(lower(t), 'license') AS s FROM c WHERE contains(lower(t),'license')),
h AS (SELECT doc_id, t, i, list_sum(list_transform(s[1:i], lambda x: length(x)))+7*(i-1) AS pos FROM p, LATERAL (SELECT unnest(range(1, len(s))) AS i))
SELECT doc_id, 'license' AS term, i-1 AS n, pos::BIGINT AS position, '...'||trim(substr(t, greatest(0,pos-50)::BIGINT+1, (pos-greatest(0,pos-50)+7+50)::BIGINT))||'...' AS snippet FROM h""")
def _(t):
    return explore.snippets(t.documents, "doc_id", ["license"])


@query("text_filter", f"WITH {CAPTIONS} SELECT reel_pk FROM captions WHERE contains(lower(caption_text)||' '||lower(song_id),'tion') AND contains(lower(caption_text)||' '||lower(song_id),'src1')")
def _(t):
    return explore.filter_records(a.caption_reels(t.documents), ["TION", "src1"], "and", ["caption_text", "song_id"]).select("reel_pk")


@query("where_filter", f"WITH {REELS} SELECT reel_pk FROM reels WHERE play_count BETWEEN 1000 AND 3000 AND song_id<>'5-LOW' AND contains(lower(asset_id),'f')")
def _(t):
    r = explore.where(a.reels(t.orders), "play_count", "between", "1000", "3000")
    return explore.where(explore.where(r, "song_id", "!=", "5-Low"), "asset_id", "contains", "F").select("reel_pk")


@query("first_hits", r"""WITH x AS (SELECT doc_id, text, least(coalesce(nullif(instr(lower(text),'license'),0),1000000000), coalesce(nullif(instr(lower(text),'zz'),0),1000000000))-1 AS p FROM documents), y AS (SELECT *, greatest(0,p-36) AS s, least(length(text),p+36) AS e FROM x WHERE p<999999999)
SELECT doc_id, 'text' AS field, regexp_replace(regexp_replace(CASE WHEN s>0 THEN '…' ELSE '' END||replace(substr(text,s+1,e-s),chr(10),' ')||CASE WHEN e<length(text) THEN '…' ELSE '' END, '(?i)(license)', '[\1]', 'g'), '(?i)(zz)', '[\1]', 'g') AS snippet FROM y""")
def _(t):
    return explore.first_hits(t.documents, "doc_id", ["license", "zz"], ["text"])


@query("top_tags", f"WITH {TAGS} SELECT hashtag AS value, count(*) AS count FROM reel_hashtags JOIN orders ON o_orderkey=reel_pk GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def _(t):
    return explore.top_values(records(t), "hashtags")


@query("compare_tags", f"""WITH {TAGS}, al AS (SELECT reel_pk, hashtag, o_orderpriority='1-URGENT' AS act FROM reel_hashtags JOIN orders ON o_orderkey=reel_pk), n AS (SELECT count(*) AS nt, count(*) FILTER (o_orderpriority='1-URGENT') AS na FROM orders),
v AS (SELECT hashtag AS value, count(*) FILTER (act) AS active, count(*) AS total FROM al GROUP BY 1)
SELECT value, active, total, round(active/na,6) AS active_share, round(total/nt,6) AS total_share, round((active/na)/(total/nt),6) AS lift, round(active/na-total/nt,6) AS delta FROM v, n WHERE active>0 ORDER BY (active/na)/(total/nt) DESC, active DESC, value LIMIT 10""")
def _(t):
    r = records(t)
    return explore.compare_sets(r.filter("song_id = '1-URGENT'"), r, "hashtags")


@query("record_sample", "SELECT doc_id AS reel_pk FROM documents ORDER BY md5('42:'||doc_id) LIMIT 25")
def _(t):
    return explore.sample(a.caption_reels(t.documents), 25).select("reel_pk")


@query("restored_view", "SELECT doc_id AS reel_pk FROM documents JOIN labels USING (doc_id) WHERE quality=1")
def _(t):
    views = explore.view_ids(t.labels.filter("quality = 1").select(F.col("doc_id").alias("reel_pk")), "good")
    return explore.restore_view(a.caption_reels(t.documents), views, "good").select("reel_pk")


@query("missing_view_ids", "SELECT doc_id AS reel_pk FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def _(t):
    views = explore.view_ids(a.caption_reels(t.documents), "all")
    return explore.missing_ids(t.pages.select(F.col("page_id").alias("reel_pk")), views, "all")


@query("views_of_record", "SELECT lang AS view FROM documents WHERE source='src3' GROUP BY 1")
def _(t):
    return explore.views_of(t.documents.select(F.col("lang").alias("view"), F.col("source").alias("reel_pk")), "src3")


def manual(t):
    key = F.col("doc_id").alias("reel_pk")
    tag = t.documents.select(key, F.explode(F.array("lang", "source")).alias("tag"))
    notes = t.labels.select(key, F.lit("2024-01-01").alias("created_at"), F.concat(F.lit("q"), "quality").alias("note"))
    flags = t.labels.select(key, (F.col("quality") == 1).alias("keep"), (F.col("toxic") == 1).alias("spam"), F.lit(False).alias("exclude"), F.lit(True).alias("reviewed"))
    return tag, notes, flags


@query("manual_annotations", """SELECT doc_id AS reel_pk, least(lang,source)||'|'||greatest(lang,source) AS manual_tags, CASE WHEN quality IS NULL THEN '' ELSE '2024-01-01: q'||quality END AS manual_notes, (quality IS NOT NULL)::BIGINT AS manual_notes_count,
 coalesce(quality=1,false) AS manual_keep, coalesce(toxic=1,false) AS manual_spam, false AS manual_exclude, quality IS NOT NULL AS manual_reviewed FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    return explore.with_manual(a.caption_reels(t.documents).select("reel_pk"), *manual(t))


@query("manual_tag_counts", "SELECT tag, count(*) AS count FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1")
def _(t):
    return explore.manual_tag_counts(manual(t)[0])


@query("review_counts", "SELECT 'keep' AS flag, count(*) FILTER (quality=1) AS count FROM labels UNION ALL SELECT 'spam', count(*) FILTER (toxic=1) FROM labels UNION ALL SELECT 'exclude', 0 FROM labels GROUP BY 1 UNION ALL SELECT 'reviewed', count(*) FROM labels")
def _(t):
    return explore.review_counts(manual(t)[2])


@query("note_summary", "SELECT doc_id AS reel_pk, count(*) AS notes, '2024-01-01' AS latest FROM labels GROUP BY 1")
def _(t):
    return explore.note_summary(manual(t)[1])


@query("processed_only", f"WITH {VISION_STATE} SELECT reel_pk FROM vision_state WHERE status='done'")
def _(t):
    return explore.only_processed(a.caption_reels(t.documents), a.vision_state(t.labels)).select("reel_pk")


@query("robustness_tables", f"WITH {CAPTIONS} SELECT reel_pk, (contains(lower(caption_text),'tion')::INT+(contains(lower(caption_text),'eau') OR contains(lower(caption_text),'schen'))::INT+(contains(lower(caption_text),'hand') OR contains(lower(caption_text),'ado'))::INT)::BIGINT AS n_categories FROM captions WHERE n_categories>=3 ORDER BY reel_pk LIMIT 100")
def _(t):
    from ..operators import classify

    df = classify.classify(a.caption_reels(t.documents), RULES, tags=None)
    tag = t.documents.select(F.col("doc_id").alias("reel_pk"), F.col("lang").alias("hashtag"))
    return lo.robustness_tables(df, tag, RULES)["multicategory_context_reels"].select("reel_pk", "n_categories")
