"""Queries for the overlap of labelled corpora."""

from ..operators import overlap
from ..sources import adapters as a
from .registry import query
from .scope_queries import threads
from .views import EDGES, THREADS

TE = """te AS (SELECT channel_id, video_id, 'uploader' AS role, corpus, NULL AS comment_id, NULL AS reply_id, published_at AS event_at FROM videos
 UNION ALL SELECT author_channel_id, video_id, 'commenter', corpus, comment_id::VARCHAR, NULL, date FROM comments
 UNION ALL SELECT author_channel_id, video_id, 'replier', corpus, comment_id::VARCHAR, reply_id, date FROM replies)"""
X = f"WITH {THREADS}, {TE}"
WIN = """spans AS (SELECT corpus, min(event_at) AS a, max(event_at) AS z FROM te WHERE role<>'uploader' GROUP BY 1),
win AS (SELECT max(a) AS s, min(z) AS e FROM spans)"""
VWIN = "vspans AS (SELECT corpus, min(published_at) AS a, max(published_at) AS z FROM videos GROUP BY 1), win AS (SELECT max(a) AS s, min(z) AS e FROM vspans)"
SETS = """sets AS (SELECT DISTINCT corpus, role, channel_id FROM te UNION ALL SELECT DISTINCT corpus, 'all', channel_id FROM te)"""
MATRIX = """labels AS (SELECT DISTINCT channel_id, corpus AS source FROM te), mr AS (SELECT source, corpus AS target, role, count(*) AS weight FROM te JOIN labels USING (channel_id) GROUP BY ALL),
matrix AS (SELECT * FROM mr UNION ALL SELECT source, target, 'all', CAST(sum(weight) AS BIGINT) FROM mr GROUP BY 1,2)"""
TS = "'%Y-%m-%d %H:%M:%S'"


def edges_videos(t):
    v, c, r = threads(t)
    return overlap.corpus_edges(v, c, r), v


@query("corpus_edges", f"{X} SELECT channel_id, video_id, role, 1::BIGINT AS weight, corpus, comment_id, reply_id, strftime(event_at,{TS}) AS event_at FROM te")
def _(t):
    return edges_videos(t)[0]


@query("overlap_window", f"{X}, {WIN} SELECT strftime(s,{TS}) AS start, strftime(e,{TS}) AS end FROM win")
def _(t):
    return overlap.overlap_window(*edges_videos(t))


@query("overlap_window_by_video", f"{X}, {VWIN} SELECT strftime(s,{TS}) AS start, strftime(e,{TS}) AS end FROM win")
def _(t):
    return overlap.overlap_window(*edges_videos(t), basis="video")


@query("capped_edges", f"""{X}, {WIN}, talk AS (SELECT te.* FROM te, win WHERE role<>'uploader' AND event_at BETWEEN s AND e),
k AS (SELECT * FROM talk UNION ALL SELECT te.* FROM te, win WHERE role='uploader' AND (event_at BETWEEN s AND e OR (corpus,video_id) IN (SELECT (corpus,video_id) FROM talk)))
SELECT corpus, role, count(*) AS n, count(DISTINCT channel_id) AS channels FROM k GROUP BY 1,2""")
def _(t):
    from pyspark.sql import functions as F

    e, _v = overlap.cap_to_window(*edges_videos(t))
    return e.groupBy("corpus", "role").agg(F.count("*").alias("n"), F.countDistinct("channel_id").alias("channels"))


@query("capped_edges_by_video", f"""{X}, {VWIN}, kv AS (SELECT videos.* FROM videos, win WHERE published_at BETWEEN s AND e)
SELECT corpus, role, count(*) AS n, count(DISTINCT channel_id) AS channels FROM te WHERE (corpus,video_id) IN (SELECT (corpus,video_id) FROM kv) GROUP BY 1,2""")
def _(t):
    from pyspark.sql import functions as F

    e, _v = overlap.cap_to_window(*edges_videos(t), basis="video")
    return e.groupBy("corpus", "role").agg(F.count("*").alias("n"), F.countDistinct("channel_id").alias("channels"))


@query("pairwise_overlap", f"""{X}, {SETS}, n AS (SELECT corpus, role, count(*) AS n FROM sets GROUP BY 1,2), c AS (SELECT DISTINCT corpus FROM te), r AS (SELECT unnest(['all','uploader','commenter','replier']) AS role),
k AS (SELECT x.corpus AS corpus_a, y.corpus AS corpus_b, role, count(*) AS k FROM sets x JOIN sets y USING (role, channel_id) WHERE x.corpus<y.corpus GROUP BY 1,2,3),
g AS (SELECT x.corpus AS corpus_a, y.corpus AS corpus_b, role FROM c x JOIN c y ON x.corpus<y.corpus, r)
SELECT corpus_a, corpus_b, role, coalesce(na.n,0) AS a_count, coalesce(nb.n,0) AS b_count, coalesce(k,0) AS overlap_count,
 round(coalesce(coalesce(k,0)/nullif(coalesce(na.n,0)+coalesce(nb.n,0)-coalesce(k,0),0),0),6) AS jaccard
FROM g LEFT JOIN k USING (corpus_a, corpus_b, role) LEFT JOIN n na ON na.corpus=corpus_a AND na.role=g.role LEFT JOIN n nb ON nb.corpus=corpus_b AND nb.role=g.role""")
def _(t):
    return overlap.pairwise_overlap(edges_videos(t)[0])


@query("interaction_matrix", f"{X}, {MATRIX} SELECT source, target, role, weight FROM matrix")
def _(t):
    return overlap.interaction_matrix(edges_videos(t)[0])


@query("interaction_matrix_wide", f"""WITH {EDGES}, labels AS (SELECT DISTINCT channel_id, corpus AS source FROM edges)
SELECT source, count(*) FILTER (corpus='corpus0') AS corpus0, count(*) FILTER (corpus='corpus1') AS corpus1, count(*) FILTER (corpus='corpus2') AS corpus2 FROM edges JOIN labels USING (channel_id) GROUP BY 1""")
def _(t):
    return overlap.interaction_matrix_wide(overlap.interaction_matrix(a.event_edges(t.events)), ["corpus0", "corpus1", "corpus2"])


@query("cross_share", f"""{X}, {MATRIX} SELECT source, role, CAST(sum(weight) AS BIGINT) AS out_total, CAST(coalesce(sum(weight) FILTER (source<>target),0) AS BIGINT) AS out_cross,
 round(coalesce(sum(weight) FILTER (source<>target),0)/sum(weight),6) AS cross_share FROM matrix GROUP BY 1,2""")
def _(t):
    return overlap.cross_share(overlap.interaction_matrix(edges_videos(t)[0]))


@query("cross_channels", f"""{X}, {SETS}, labels AS (SELECT DISTINCT channel_id, corpus AS source FROM te)
SELECT source, role, count(DISTINCT channel_id) AS channels FROM sets JOIN labels USING (channel_id) WHERE source<>corpus GROUP BY 1,2""")
def _(t):
    return overlap.cross_channels(edges_videos(t)[0])


@query("edges_per_video", f"""{X}, n AS (SELECT v.corpus, v.video_id, count(te.channel_id) AS n FROM videos v LEFT JOIN te ON te.corpus=v.corpus AND te.video_id=v.video_id GROUP BY 1,2)
SELECT corpus, round(avg(n),6) AS mean, count(*) AS n_videos, quantile_cont(n,0.5) AS median FROM n GROUP BY 1""")
def _(t):
    return overlap.edges_per_video(*edges_videos(t))


@query("corpus_overlap_summary", f"""{X}, {WIN}, talk AS (SELECT te.* FROM te, win WHERE role<>'uploader' AND event_at BETWEEN s AND e),
k AS (SELECT * FROM talk UNION ALL SELECT te.* FROM te, win WHERE role='uploader' AND (event_at BETWEEN s AND e OR (corpus,video_id) IN (SELECT (corpus,video_id) FROM talk)))
SELECT corpus, (SELECT count(*) FROM videos v WHERE v.corpus=k.corpus) AS n_videos, count(DISTINCT channel_id) AS n_channels, 'comment' AS basis,
 strftime(min(s),{TS}) AS start, strftime(min(e),{TS}) AS end, CAST(floor((epoch(min(e))-epoch(min(s)))/86400) AS BIGINT) AS days FROM k, win GROUP BY 1""")
def _(t):
    return overlap.corpus_summary(*edges_videos(t))


@query("overlap_graph_nodes", f"""{X}, nodes AS (SELECT channel_id AS id, 'channel' AS node_type, string_agg(DISTINCT corpus, ',' ORDER BY corpus) AS corpora, string_agg(DISTINCT role, ',' ORDER BY role) AS roles,
 count(DISTINCT corpus) AS corpus_count, count(*) AS degree_est FROM te GROUP BY 1
 UNION ALL SELECT video_id, 'video', min(corpus), '', 1, (SELECT count(*) FROM te WHERE te.video_id=v.video_id) FROM videos v GROUP BY 1)
SELECT id, node_type, corpora, roles, corpus_count, corpus_count>=2 AS in_multiple, degree_est FROM nodes""")
def _(t):
    return overlap.overlap_graph(*edges_videos(t))[0]


@query("jaccard_over_years", f"""{X}, d AS (SELECT *, date_trunc('year', event_at)::DATE AS period FROM te), s AS (SELECT DISTINCT corpus, period, role, channel_id FROM d UNION ALL SELECT DISTINCT corpus, period, 'all', channel_id FROM d),
n AS (SELECT corpus, period, role, count(*) AS n FROM s GROUP BY 1,2,3), c AS (SELECT DISTINCT corpus FROM te),
g AS (SELECT DISTINCT x.corpus AS corpus_a, y.corpus AS corpus_b, period, role FROM c x JOIN c y ON x.corpus<y.corpus JOIN n ON n.corpus IN (x.corpus, y.corpus)),
k AS (SELECT x.corpus AS corpus_a, y.corpus AS corpus_b, period, role, count(*) AS k FROM s x JOIN s y USING (period, role, channel_id) WHERE x.corpus<y.corpus GROUP BY ALL),
j AS (SELECT g.*, coalesce(k,0) AS k, coalesce(na.n,0) AS na, coalesce(nb.n,0) AS nb FROM g LEFT JOIN k USING (corpus_a, corpus_b, period, role)
 LEFT JOIN n na ON na.corpus=corpus_a AND na.period=g.period AND na.role=g.role LEFT JOIN n nb ON nb.corpus=corpus_b AND nb.period=g.period AND nb.role=g.role)
SELECT corpus_a, corpus_b, strftime(period,'%Y-%m-%d') AS period, role, k AS both, na-k AS a_only, nb-k AS b_only, round(k/(na+nb-k),6) AS jaccard FROM j""")
def _(t):
    return overlap.jaccard_over_time(edges_videos(t)[0])


@query("jaccard_members", f"""{X}, d AS (SELECT *, date_trunc('year', event_at)::DATE AS period FROM te WHERE corpus IN ('1-URGENT','5-LOW')),
s AS (SELECT corpus, period, role, channel_id FROM d UNION ALL SELECT corpus, period, 'all', channel_id FROM d)
SELECT strftime(period,'%Y-%m-%d') AS period, role, channel_id, CASE WHEN count(DISTINCT corpus)=2 THEN 'both' WHEN min(corpus)='1-URGENT' THEN 'a_only' ELSE 'b_only' END AS part FROM s GROUP BY 1,2,3""")
def _(t):
    return overlap.jaccard_members(edges_videos(t)[0], "1-URGENT", "5-LOW")
