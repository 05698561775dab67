"""Queries for corpus statistics and time series."""

from ..operators import scope
from ..sources import adapters as a
from .registry import query
from .views import ASSET_LABEL, EDGES, REELS, SONG_LABEL, SONGS, TAGS, THREADS


def threads(t):
    c = a.thread_comments(t.orders)
    return a.thread_videos(c), c, a.thread_replies(t.lineitem, c)


def reels_with_songs(t):
    return a.reels(t.orders).join(a.songs(t.orders), "song_id", "left")


@query("corpus_counts", f"""WITH {THREADS},
pv AS (SELECT v.video_id, count(c.comment_id) AS n FROM videos v LEFT JOIN comments c USING (video_id) GROUP BY 1),
pc AS (SELECT c.comment_id, count(r.reply_id) AS n FROM comments c LEFT JOIN replies r USING (comment_id) GROUP BY 1)
SELECT (SELECT count(*) FROM pv) AS total_videos, CAST((SELECT sum(n) FROM pv) AS BIGINT) AS total_comments,
 (SELECT count(*) FROM pv WHERE n>0) AS videos_with_comments, (SELECT count(*) FROM pv WHERE n=0) AS videos_without_comments,
 (SELECT round(avg(n),6) FROM pv) AS comments_per_video_mean, (SELECT round(stddev_samp(n),6) FROM pv) AS comments_per_video_std,
 (SELECT min(n) FROM pv) AS comments_per_video_min, (SELECT max(n) FROM pv) AS comments_per_video_max,
 (SELECT quantile_cont(n,0.5) FROM pv) AS comments_per_video_median, CAST((SELECT sum(n) FROM pc) AS BIGINT) AS total_replies,
 (SELECT round(avg(n),6) FROM pc) AS replies_per_comment_mean, (SELECT quantile_cont(n,0.5) FROM pc) AS replies_per_comment_median""")
def _(t):
    return scope.corpus_counts(*threads(t))


@query("discussion_summary", f"""WITH {THREADS}
SELECT (SELECT count(*) FROM videos) AS total_videos, count(*) AS total_comments, round(sum(CAST(sentiment AS DECIMAL(28,10)))::DOUBLE/count(sentiment),3) AS average_sentiment,
 round(100.0*avg(CASE WHEN comment_id IN (SELECT comment_id FROM replies) THEN 1 ELSE 0 END),2) AS reply_percentage FROM comments""")
def _(t):
    return scope.summary_kpis(*threads(t))


@query("most_liked_comments", f"""WITH {THREADS}
SELECT row_number() OVER (ORDER BY likes DESC, comment_id) AS rank, comment_id, video_id, likes FROM comments ORDER BY likes DESC, comment_id LIMIT 20""")
def _(t):
    return scope.most_liked(a.thread_comments(t.orders), 20).select("rank", "comment_id", "video_id", "likes")


DENSITY = """pc AS (SELECT c.video_id, c.comment_id, c.date, count(r.reply_id) AS n FROM comments c LEFT JOIN replies r USING (comment_id) GROUP BY 1,2,3),
pv AS (SELECT video_id, count(*) AS n, sum(n) AS r, count(*) FILTER (n>0) AS answered FROM pc GROUP BY 1 HAVING bool_and(date IS NOT NULL)),
density AS (SELECT video_id, title, r/pv.n AS replies_per_comment, answered/pv.n AS comments_with_replies_ratio,
 coalesce(r/nullif(coalesce(views,1),0),0) AS replies_per_view, 0.4*(r/pv.n)+0.4*(answered/pv.n)+0.2*coalesce(r/nullif(coalesce(views,1),0),0) AS interaction_density_score
 FROM pv JOIN videos USING (video_id))"""


@query("interaction_density", f"""WITH {THREADS}, {DENSITY}
SELECT video_id, title, round(replies_per_comment,6) AS replies_per_comment, round(comments_with_replies_ratio,6) AS comments_with_replies_ratio,
 round(replies_per_view,6) AS replies_per_view, round(interaction_density_score,6) AS interaction_density_score FROM density""")
def _(t):
    return scope.interaction_density(*threads(t))


@query("interaction_density_top", f"""WITH {THREADS}, {DENSITY}
SELECT row_number() OVER (ORDER BY interaction_density_score DESC, video_id) AS rank, video_id, round(interaction_density_score,6) AS interaction_density_score,
 round((SELECT avg(interaction_density_score) FROM density),6) AS mean_score, round((SELECT quantile_cont(interaction_density_score,0.5) FROM density),6) AS median_score
FROM density ORDER BY interaction_density_score DESC, video_id LIMIT 5""")
def _(t):
    return scope.interaction_density_summary(scope.interaction_density(*threads(t)))


def rolling_sql(base: str, day: str, value: str, span: str) -> str:
    """Rolling mean over the last max(3, span // 50) existing rows of ``base``."""
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY {day}) AS i FROM {base}),
width AS (SELECT greatest(3, ({span})//50) AS w FROM {base}),
rolled AS (SELECT x.*, (SELECT avg(y.{value}) FROM numbered y WHERE y.i<=x.i AND y.i>x.i-(SELECT w FROM width)) AS rolling FROM numbered x)"""


@query("comments_per_day", f"""WITH {THREADS}, daily AS (SELECT CAST(date AS DATE) AS day, count(*) AS comments FROM comments WHERE date IS NOT NULL GROUP BY 1),
{rolling_sql('daily','day','comments',"date_diff('day',min(day),max(day))")}
SELECT strftime(day,'%Y-%m-%d') AS day, comments, round(rolling,6) AS rolling,
 day IN (SELECT day FROM daily ORDER BY comments DESC, day LIMIT 10) AS top_day FROM rolled""")
def _(t):
    return scope.daily_comments(a.thread_comments(t.orders))


@query("sentiment_per_day", f"""WITH {THREADS}, daily AS (SELECT CAST(date AS DATE) AS day, sum(CAST(sentiment AS DECIMAL(28,10)))::DOUBLE/count(sentiment) AS sentiment FROM comments WHERE date IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1),
{rolling_sql('daily','day','sentiment',"date_diff('day',min(day),max(day))")}
SELECT strftime(day,'%Y-%m-%d') AS day, round(sentiment,6) AS sentiment, round(rolling,6) AS rolling,
 round((SELECT sum(CAST(sentiment AS DECIMAL(28,10)))::DOUBLE/count(sentiment) FROM daily),6) AS overall_mean, round((SELECT quantile_cont(sentiment,0.5) FROM daily),6) AS overall_median FROM rolled""")
def _(t):
    return scope.daily_sentiment(a.thread_comments(t.orders))


@query("sentiment_distribution", f"""WITH {THREADS}, f AS (SELECT count(*) AS n, count(sentiment) AS v, sum(CAST(sentiment AS DECIMAL(28,10)))::DOUBLE/count(sentiment) AS mean, min(sentiment) AS lo, max(sentiment) AS hi,
 quantile_cont(sentiment,0.5) AS median FROM comments)
SELECT CAST(least(floor((sentiment-lo)/((hi-lo)/20)),19) AS BIGINT) AS bin, count(*) AS count, round(min(lo)+least(floor((sentiment-lo)/((hi-lo)/20)),19)*min((hi-lo)/20),6) AS bin_start,
 min(n) AS n_total, min(n-v) AS n_missing, round(min((n-v)*100.0/n),6) AS missing_pct, round(min(mean),6) AS mean, round(min(median),6) AS median
FROM comments, f WHERE sentiment IS NOT NULL GROUP BY least(floor((sentiment-lo)/((hi-lo)/20)),19)""")
def _(t):
    return scope.sentiment_distribution(a.thread_comments(t.orders))


def histogram_sql(base: str, v: str, bins: int, cap: int) -> str:
    return f"""f AS (SELECT count(*) AS n, count(*) FILTER ({v}=0) AS zero, count(*) FILTER ({v}>0) AS pos,
 CAST(greatest(1,min(CASE WHEN {v}>0 THEN {v} END)) AS DOUBLE) AS a, CAST(max(CASE WHEN {v}>0 THEN {v} END) AS DOUBLE) AS z FROM {base}),
h AS (SELECT CAST(least(ceil(({v}-a)/((z-a)/{bins})),{bins}) AS BIGINT) AS bin, count(*) AS count FROM {base}, f WHERE {v}>a AND {v}<=z GROUP BY 1)
SELECT bin, round(a+(bin-1)*((z-a)/{bins}),6) AS "left", round(a+bin*((z-a)/{bins}),6) AS "right", count, count>{cap} AS over_cap,
 round(zero*100.0/n,6) AS zero_pct, round(pos*100.0/n,6) AS nonzero_pct FROM h, f"""


@query("comment_likes_histogram", f"WITH {THREADS}, {histogram_sql('comments', 'likes', 30, 100)}")
def _(t):
    return scope.right_closed_histogram(a.thread_comments(t.orders), "likes")


@query("participation_timeline", f"""WITH {EDGES}, daily AS (SELECT CAST(event_at AS DATE) AS day, count(DISTINCT channel_id) AS active FROM edges GROUP BY 1),
firsts AS (SELECT channel_id, min(CAST(event_at AS DATE)) AS day FROM edges GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
{rolling_sql('daily','day','active',"date_diff('day',min(day),max(day))")}
SELECT strftime(cal.day,'%Y-%m-%d') AS day, (SELECT count(*) FROM firsts f WHERE f.day<=cal.day) AS cumulative, active, round(rolling,6) AS rolling
FROM cal LEFT JOIN rolled ON rolled.day=cal.day""")
def _(t):
    return scope.participation_timeline(a.event_edges(t.events))


@query("interactions_by_weekday", f"""WITH {EDGES}, names AS (SELECT unnest([0,1,2,3,4,5,6])::BIGINT AS weekday, unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun']) AS name),
c AS (SELECT isodow(event_at)-1 AS weekday, count(*) FILTER (role='uploader') AS uploads, count(*) FILTER (role='commenter') AS comments, count(*) FILTER (role='replier') AS replies FROM edges GROUP BY 1)
SELECT weekday, name, coalesce(uploads,0) AS uploads, coalesce(comments,0) AS comments, coalesce(replies,0) AS replies,
 coalesce(uploads,0)+coalesce(comments,0)+coalesce(replies,0) AS total FROM names LEFT JOIN c USING (weekday)""")
def _(t):
    return scope.weekday_counts(a.event_edges(t.events))


@query("interactions_by_weekday_share", f"""WITH {EDGES}
SELECT isodow(event_at)-1 AS weekday, min(strftime(event_at,'%a')) AS name, round(count(*) FILTER (role='uploader')/(SELECT count(*) FROM edges WHERE role='uploader'),6) AS uploads,
 round(count(*) FILTER (role='commenter')/(SELECT count(*) FROM edges WHERE role='commenter'),6) AS comments,
 round(count(*) FILTER (role='replier')/(SELECT count(*) FROM edges WHERE role='replier'),6) AS replies, round(count(*)/(SELECT count(*) FROM edges),6) AS total FROM edges GROUP BY 1""")
def _(t):
    return scope.weekday_counts(a.event_edges(t.events), normalize=True)


@query("views_vs_discussion", f"""WITH {THREADS}, d AS (SELECT video_id, views, year(published_at) AS year,
 (SELECT count(*) FROM comments c WHERE c.video_id=v.video_id)+(SELECT count(*) FROM replies r WHERE r.video_id=v.video_id) AS discussion FROM videos v WHERE views IS NOT NULL),
f AS (SELECT regr_slope(log10(discussion),log10(views)) AS slope, regr_intercept(log10(discussion),log10(views)) AS intercept FROM d WHERE views>0 AND discussion>0),
q AS (SELECT coalesce(nullif(quantile_cont(discussion,0.9),0),1) AS q90 FROM d)
SELECT video_id, views, discussion, year, round(discussion/(views+1e-9),6) AS ratio, round(20+120*greatest(0,least(1,discussion/q90)),6) AS size,
 round(slope,6) AS slope, round(intercept,6) AS intercept FROM d, f, q""")
def _(t):
    return scope.views_vs_discussion(*threads(t))


UPLOADS = """counts AS (SELECT date_trunc('{unit}', published_at)::DATE AS period, count(*) AS n FROM videos GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT min(period)::TIMESTAMP FROM counts),(SELECT max(period)::TIMESTAMP FROM counts), INTERVAL 1 {unit}))::DATE AS period),
full_ AS (SELECT period, coalesce(n,0) AS uploads, {end} AS period_end FROM cal LEFT JOIN counts USING (period)),"""


@query("uploads_per_month", f"""WITH {THREADS}, {UPLOADS.format(unit='month', end='last_day(period)')}
{rolling_sql('full_','period','uploads',"greatest(1,date_diff('day',min(period_end),max(period_end)))")}
SELECT strftime(period,'%Y-%m-%d') AS period, strftime(period_end,'%Y-%m-%d') AS period_end, uploads, round(rolling,6) AS rolling,
 period IN (SELECT period FROM full_ ORDER BY uploads DESC, period LIMIT 10) AS top FROM rolled""")
def _(t):
    return scope.uploads_over_time(threads(t)[0])


@query("uploads_per_week", f"""WITH {THREADS}, {UPLOADS.format(unit='week', end='period+6')}
{rolling_sql('full_','period','uploads',"greatest(1,date_diff('day',min(period_end),max(period_end)))")}
SELECT strftime(period,'%Y-%m-%d') AS period, strftime(period_end,'%Y-%m-%d') AS period_end, uploads, round(rolling,6) AS rolling,
 period IN (SELECT period FROM full_ ORDER BY uploads DESC, period LIMIT 10) AS top FROM rolled""")
def _(t):
    return scope.uploads_over_time(threads(t)[0], "W")


@query("top_viewed_videos", f"WITH {THREADS} SELECT video_id, title, views FROM videos WHERE views IS NOT NULL ORDER BY views DESC, video_id LIMIT 15")
def _(t):
    return scope.views_table(threads(t)[0])


@query("views_distribution", f"""WITH {THREADS} SELECT count(*) AS n, round(pow(10,avg(log10(views))),6) AS log_mean, round(pow(10,quantile_cont(log10(views),0.5)),6) AS log_median,
 round(pow(10,quantile_cont(log10(views),0.25)),6) AS log_q1, round(pow(10,quantile_cont(log10(views),0.75)),6) AS log_q3 FROM videos WHERE views>0""")
def _(t):
    return scope.views_distribution(threads(t)[0])


R = f"{REELS}, {SONGS}, rs AS (SELECT * FROM reels LEFT JOIN songs USING (song_id))"


@query("timeline_songs_month", f"""WITH {R} SELECT strftime(taken_at,'%Y-%m') AS period, 'songs' AS entity_type, song_id AS entity_id, {SONG_LABEL} AS entity_label, count(*) AS count FROM rs GROUP BY ALL""")
def _(t):
    return scope.timeline(reels_with_songs(t), "songs", "M")


@query("timeline_assets_week", f"""WITH {R} SELECT strftime(date_trunc('week',taken_at),'%Y-%m-%d')||'/'||strftime(date_trunc('week',taken_at)+INTERVAL 6 DAY,'%Y-%m-%d') AS period,
 'assets' AS entity_type, asset_id AS entity_id, {ASSET_LABEL} AS entity_label, count(*) AS count FROM rs GROUP BY ALL""")
def _(t):
    return scope.timeline(reels_with_songs(t), "assets", "W")


@query("timeline_hashtags_month", f"""WITH {R}, {TAGS} SELECT strftime(taken_at,'%Y-%m') AS period, 'hashtags' AS entity_type, hashtag AS entity_id, hashtag AS entity_label, count(*) AS count
 FROM rs JOIN reel_hashtags USING (reel_pk) GROUP BY ALL""")
def _(t):
    return scope.timeline(reels_with_songs(t), "hashtags", "M", a.reel_hashtags(t.lineitem, t.part))


@query("timeline_creators_day", f"""WITH {R} SELECT strftime(taken_at,'%Y-%m-%d') AS period, 'creators' AS entity_type, creator_pseudo AS entity_id, creator_pseudo AS entity_label, count(*) AS count FROM rs GROUP BY ALL""")
def _(t):
    return scope.timeline(reels_with_songs(t), "creators", "D")


@query("describe_reel_fields", f"""WITH {REELS}, long AS (UNPIVOT (SELECT like_count::DOUBLE AS like_count, play_count::DOUBLE AS play_count, view_count::DOUBLE AS view_count, comment_count::DOUBLE AS comment_count,
  video_duration::DOUBLE AS video_duration FROM reels) ON COLUMNS(*) INTO NAME field VALUE x)
SELECT field, count(x) AS count, (SELECT count(*) FROM reels)-count(x) AS missing, round(avg(x),6) AS mean, round(stddev_samp(x),6) AS std, min(x) AS min, max(x) AS max,
 round(quantile_cont(x,0.25),6) AS p25, round(quantile_cont(x,0.5),6) AS median, round(quantile_cont(x,0.75),6) AS p75 FROM long GROUP BY 1""")
def _(t):
    return scope.describe_fields(a.reels(t.orders), ["like_count", "play_count", "view_count", "comment_count", "video_duration"])


@query("top_reels_by_impact", f"""WITH {REELS} SELECT row_number() OVER (ORDER BY m DESC, reel_pk) AS rank, reel_pk, song_id, m AS metric FROM
 (SELECT *, (coalesce(play_count,0)+coalesce(like_count,0)+coalesce(comment_count,0))::DOUBLE AS m FROM reels) ORDER BY m DESC, reel_pk LIMIT 20""")
def _(t):
    return scope.top_reels(a.reels(t.orders), "impact").select("rank", "reel_pk", "song_id", "metric")


@query("top_reels_by_plays", f"""WITH {REELS} SELECT row_number() OVER (ORDER BY play_count DESC NULLS LAST, reel_pk) AS rank, reel_pk, play_count::DOUBLE AS metric FROM reels
 WHERE play_count IS NOT NULL ORDER BY play_count DESC, reel_pk LIMIT 20""")
def _(t):
    return scope.top_reels(a.reels(t.orders), "plays").select("rank", "reel_pk", "metric")


@query("correlate_views_comments", f"""WITH {REELS}, p AS (SELECT view_count AS x, comment_count AS y FROM reels WHERE view_count IS NOT NULL AND comment_count IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2 AS rx, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2 AS ry FROM p)
SELECT count(*) AS n, round(corr(x,y),6) AS pearson, round(corr(rx,ry),6) AS spearman, 'ok' AS method_note FROM r""")
def _(t):
    return scope.correlate(a.reels(t.orders), "view_count", "comment_count")


@query("weekday_hour_grid", """SELECT isodow(ts)-1 AS weekday, dayname(ts) AS weekday_name, hour(ts) AS hour, count(*) AS count FROM events GROUP BY ALL""")
def _(t):
    return scope.weekday_hour_grid(t.events, "ts")


def impact_sql(key: str, kind: str, label: str, source: str) -> str:
    cols = ", ".join(
        f"CAST(sum(coalesce({c},0)) AS BIGINT) AS {c}_sum, round(avg(coalesce({c},0)),6) AS {c}_mean, max(coalesce({c},0)) AS {c}_max"
        for c in ("play_count", "like_count", "comment_count", "impact")
    )
    return f"""SELECT '{kind}' AS entity_type, {key} AS entity_id, {label} AS entity_label, count(*) AS count, {cols}
FROM (SELECT *, coalesce(play_count,0)+coalesce(like_count,0)+coalesce(comment_count,0) AS impact FROM {source}) GROUP BY 1,2,3"""


for _kind, _key, _label, _src in (
    ("songs", "song_id", SONG_LABEL, "rs"),
    ("assets", "asset_id", ASSET_LABEL, "rs"),
    ("hashtags", "hashtag", "hashtag", "rs JOIN reel_hashtags USING (reel_pk)"),
    ("creators", "creator_pseudo", "creator_pseudo", "rs"),
):
    @query(f"impact_by_{_kind}", f"WITH {R}, {TAGS} {impact_sql(_key, _kind, _label, _src)}")
    def _(t, kind=_kind):
        tags = a.reel_hashtags(t.lineitem, t.part) if kind == "hashtags" else None
        return scope.impact_by_entity(reels_with_songs(t), kind, tags)


@query("song_weekly_trend", f"""WITH {REELS}, c AS (SELECT song_id, date_trunc('week',taken_at)::DATE AS period, count(*) AS n FROM reels GROUP BY 1,2),
cal AS (SELECT song_id, unnest(generate_series(min(period)::TIMESTAMP,max(period)::TIMESTAMP,INTERVAL 7 DAY))::DATE AS period FROM c GROUP BY song_id)
SELECT song_id, strftime(period,'%Y-%m-%d') AS period, coalesce(n,0) AS n FROM cal LEFT JOIN c USING (song_id, period)""")
def _(t):
    return scope.song_trend(a.reels(t.orders))


@query("song_summary", f"""WITH {REELS} SELECT song_id, count(*) AS n_reels, strftime(min(taken_at),'%Y-%m-%d') AS "from", strftime(max(taken_at),'%Y-%m-%d') AS "to",
 quantile_cont(play_count,0.5) AS median_plays, quantile_cont(like_count,0.5) AS median_likes, round(quantile_cont(engagement_rate,0.5),4) AS median_engagement FROM reels GROUP BY 1""")
def _(t):
    return scope.song_summary(a.reels(t.orders))


@query("source_overview", f"""WITH {REELS} SELECT song_id, count(*) AS n, strftime(min(taken_at),'%Y-%m-%d %H:%M:%S') AS "first", strftime(max(taken_at),'%Y-%m-%d %H:%M:%S') AS "last" FROM reels GROUP BY 1""")
def _(t):
    return scope.source_overview(a.reels(t.orders))
