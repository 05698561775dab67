"""SQL twins of the driver-table adapters, as WITH-list members."""

EDGES = """edges AS (
 SELECT 'u'||user_id AS channel_id, 'v'||json_extract_string(props,'$.k')||'@'||strftime(ts,'%Y%m%d') AS video_id,
  CASE event_type WHEN 'signup' THEN 'uploader' WHEN 'purchase' THEN 'replier' ELSE 'commenter' END AS role,
  ts AS event_at, 'corpus'||(CAST(json_extract_string(props,'$.k') AS BIGINT)%3) AS corpus, event_id FROM events)"""

COMMENTS = """comments AS (
 SELECT strftime(o_orderdate,'%Y-%m')||'/'||substr(o_orderpriority,1,1) AS video_id, o_orderkey AS comment_id,
  'u'||o_custkey AS author_channel_id, o_orderdate AS date, CAST(floor(o_totalprice/10000) AS BIGINT) AS likes,
  CASE WHEN o_orderstatus<>'P' THEN o_totalprice/250000-1 END AS sentiment, o_orderpriority AS corpus,
  CASE WHEN o_orderstatus='F' THEN CAST(floor(o_totalprice/1000) AS BIGINT) END AS view_part FROM orders)"""

REPLIES = """replies AS (
 SELECT c.video_id, c.comment_id, l_orderkey||'-'||l_linenumber||'-'||l_partkey AS reply_id, 'u'||l_suppkey AS author_channel_id,
  l_shipdate AS date, CAST(floor(l_quantity) AS BIGINT) AS likes, c.corpus FROM lineitem JOIN comments c ON l_orderkey=c.comment_id)"""

VIDEOS = """videos AS (
 SELECT video_id, min(date) AS published_at, arg_min(author_channel_id, comment_id) AS channel_id,
  CAST(sum(view_part) AS BIGINT) AS views, min(corpus) AS corpus, 'title '||video_id AS title FROM comments GROUP BY video_id)"""

THREADS = f"{COMMENTS}, {REPLIES}, {VIDEOS}"

REELS = """reels AS (
 SELECT *, CAST(CASE WHEN play_count>0 THEN play_count WHEN view_count>0 THEN view_count ELSE coalesce(like_count,0) END AS DOUBLE) AS impact_metric,
  least(coalesce(like_count,0)/nullif(play_count,0), 1.0) AS engagement_rate FROM (
 SELECT o_orderkey AS reel_pk, o_orderpriority AS song_id, substr(o_orderpriority,1,1)||o_orderstatus AS asset_id, 'c'||o_custkey AS creator_pseudo,
  o_orderdate AS taken_at,
  CASE WHEN o_totalprice<50000 THEN 0 WHEN o_totalprice>=80000 THEN CAST(floor(o_totalprice/100) AS BIGINT) END AS play_count,
  CASE WHEN o_totalprice>=30000 THEN CAST(floor(o_totalprice/50) AS BIGINT) END AS view_count,
  CAST(floor(o_totalprice/70) AS BIGINT) AS like_count,
  CASE WHEN o_totalprice>=20000 THEN CAST(floor(o_totalprice/9000) AS BIGINT) END AS comment_count,
  o_totalprice/10000 AS video_duration, CASE WHEN o_orderstatus='P' THEN 'F' ELSE o_orderstatus END AS variant_label FROM orders))"""

SONGS = """songs AS (
 SELECT DISTINCT o_orderpriority AS song_id, substr(o_orderpriority,3) AS song_title,
  CASE WHEN substr(o_orderpriority,1,1)<>'3' THEN 'artist '||substr(o_orderpriority,1,1) END AS artist FROM orders)"""

SONG_LABEL = """CASE WHEN coalesce(artist,'')<>'' AND coalesce(song_title,'')<>'' THEN artist||' – '||song_title
 WHEN coalesce(song_title,'')<>'' THEN song_title ELSE song_id END"""

ASSET_LABEL = "variant_label||' ('||asset_id||')'"

TAGS = """reel_hashtags AS (
 SELECT DISTINCT reel_pk, hashtag FROM (
  SELECT l_orderkey AS reel_pk, unnest([replace(lower(p_brand),'#',''), lower(p_type)]) AS hashtag
  FROM lineitem JOIN part ON l_partkey=p_partkey))"""

CAPTIONS = """captions AS (
 SELECT doc_id AS reel_pk, source AS song_id, source||'-'||lang AS asset_id, lang AS variant_label, text AS caption_text, n_chars AS play_count,
  CAST(n_chars AS DOUBLE) AS impact_metric, TIMESTAMP '2024-01-01' + to_days(CAST(n_chars%180 AS INTEGER)) AS taken_at, 'c'||(n_chars%97) AS creator_pseudo FROM documents)"""

DOC_COMMENTS = """doc_comments AS (
 SELECT source AS video_id, doc_id AS comment_id, text, lang AS language, 'comment' AS kind FROM documents)"""

PAGE_REPLIES = r"""page_replies AS (
 SELECT source AS video_id, doc_id AS comment_id, page_id AS reply_id, html AS text, lang AS comment_language,
  nullif(regexp_extract(url, '//[^/]+/(en|fr|de|es)/', 1), '') AS language FROM pages JOIN documents ON page_id=doc_id)"""

TURNS = """turns AS (
 SELECT 'conv'||conv_id AS video_id, conv_id, turn, role, conv_id||'-'||turn AS item_id, substr(role,1,1)||(length(text)%40) AS author_channel_id, text,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS date, CAST(length(text) AS BIGINT) AS likes FROM conversations)"""


ANNOTATIONS = """annotations AS (
 SELECT doc_id AS reel_pk, 'context' AS dimension, CASE WHEN quality=1 THEN 'nature' ELSE 'home' END AS category, 'vision' AS source, (doc_id%101)/100 AS confidence FROM labels
 UNION ALL SELECT doc_id, 'format', 'dance', 'vision', 0.9 FROM labels WHERE toxic=1
 UNION ALL SELECT doc_id, 'context', 'city', 'manual', 1.0 FROM labels WHERE quality=0)"""

VISION_STATE = """vision_state AS (SELECT doc_id AS reel_pk, CASE WHEN toxic=1 THEN 'blocked' WHEN quality=0 THEN 'failed' ELSE 'done' END AS status FROM labels)"""

CRAWLS = """seen AS (SELECT strftime(date_trunc('week',ts),'%Y%m%d')||'T000000Z' AS crawl_id, user_id AS reel_pk, event_type AS asset_id, max(ts) AS seen_at, count(*) AS play_count, substr(event_type,1,1) AS song_id FROM events GROUP BY ALL),
runs AS (SELECT strftime(date_trunc('week',ts),'%Y%m%d')||'T000000Z' AS crawl_id, min(ts) AS started_at, 'refresh' AS mode, 'done' AS status FROM events GROUP BY 1)"""

def fold_sql(bins: int, b: int, vector: str = "embedding", element: str = "x::DOUBLE") -> str:
    """Sum of the elements i of a vector with i mod ``bins`` = ``b``, in their order."""
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_filter({vector}, lambda x, i: (i-1)%{bins}={b}), lambda x: {element})), lambda p, q: p+q)"


ACOUSTICS = f"""acoustics AS (SELECT printf('a%06d', vec_id) AS asset_id, 's'||label AS song_id, round(120+200*e[1],3) AS tempo, round(2000+4000*e[2],3) AS spectral_centroid,
 round(e[3]*10,4) AS loudness_lufs, round(0.5+e[4],4) AS spectral_flatness, CAST(floor(abs(e[6])*40) AS INTEGER)%12 AS pc, CASE WHEN e[1]>0 THEN 'Major' ELSE 'Minor' END AS q,
 ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(floor(abs(e[6])*40) AS INTEGER)%12+1]||CASE WHEN e[1]>0 THEN ' Major' ELSE ' Minor' END AS est_key
 FROM (SELECT vec_id, label, [{', '.join(fold_sql(6, b) + '/4' for b in range(6))}] AS e FROM embeddings))"""

ALIGNMENTS = """aligned AS (SELECT event_id AS reel_pk, printf('a%03d', CAST(json_extract_string(props,'$.k') AS INTEGER)) AS asset_id, CASE WHEN value>=1 THEN value END AS used_segment_start, value+15 AS used_segment_end,
 CASE WHEN event_type<>'view' THEN value/100 END AS align_confidence, CASE WHEN event_type='view' THEN (value>50)::INTEGER ELSE 0 END AS has_overlay FROM events)"""

EDITS = """edits AS (SELECT reel_pk, cut_times, soft_times, 'c'||o_custkey AS asset_id, o_totalprice/1000 AS duration, o_orderstatus FROM
 (SELECT l_orderkey AS reel_pk, list_sort(list(l_quantity/4)) AS cut_times, list_sort(coalesce(list(l_quantity/4) FILTER (l_returnflag='R'),[])) AS soft_times FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey=reel_pk)"""
