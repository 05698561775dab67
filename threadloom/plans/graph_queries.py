"""Queries for networks of channels, creators and hashtags."""

from pyspark.sql import functions as F

from ..functions.components import betweenness, connected_components, eigenvector_centrality
from ..operators import graph
from ..sources import adapters as a
from .registry import query
from .scope_queries import histogram_sql, reels_with_songs, threads
from .views import ASSET_LABEL, EDGES, REELS, SONG_LABEL, SONGS, TAGS, THREADS

PART = "part_ AS (SELECT DISTINCT video_id, channel_id FROM edges)"


def ev(t):
    return a.event_edges(t.events)


def tags(t):
    return a.reel_hashtags(t.lineitem, t.part)


@query("participants", f"WITH {EDGES} SELECT DISTINCT video_id, channel_id FROM edges WHERE role IN ('commenter','replier')")
def _(t):
    return graph.participants(ev(t), ["commenter", "replier"])


STATS = """stats AS (SELECT channel_id, count(*) FILTER (role='uploader') AS as_uploader, count(*) FILTER (role='commenter') AS as_commenter,
 count(*) FILTER (role='replier') AS as_replier, count(*) AS total_activity, count(DISTINCT video_id) AS videos_active_in FROM edges GROUP BY 1)"""


@query("channel_occurrence_stats", f"WITH {EDGES}, {STATS} SELECT * FROM stats")
def _(t):
    return graph.channel_stats(ev(t))


@query("top_channels_by_commenting", f"""WITH {EDGES}, {STATS} SELECT row_number() OVER (ORDER BY as_commenter DESC, channel_id) AS rank, channel_id, as_commenter AS count
 FROM stats ORDER BY as_commenter DESC, channel_id LIMIT 20""")
def _(t):
    return graph.top_channels(graph.channel_stats(ev(t)), "as_commenter")


@query("channel_role_proportions", f"""WITH {EDGES}, {STATS}, s AS (SELECT channel_id, as_uploader/total_activity AS as_uploader, as_commenter/total_activity AS as_commenter, as_replier/total_activity AS as_replier FROM stats)
SELECT channel_id, role, round(count,6) AS count FROM s UNPIVOT (count FOR role IN (as_uploader, as_commenter, as_replier))""")
def _(t):
    return graph.role_proportions(graph.channel_stats(ev(t)), normalize=True)


REPLYNET = """net AS (SELECT r.author_channel_id AS src, c.author_channel_id AS dst, count(*) AS weight FROM replies r JOIN comments c USING (comment_id)
 WHERE r.author_channel_id<>c.author_channel_id GROUP BY 1,2)"""


@query("reply_network", f"WITH {THREADS}, {REPLYNET} SELECT * FROM net")
def _(t):
    _, c, r = threads(t)
    return graph.reply_network(c, r)


@query("reply_network_heavy", f"""WITH {THREADS} SELECT r.author_channel_id AS src, c.author_channel_id AS dst, count(*) AS weight FROM replies r JOIN comments c USING (comment_id)
 GROUP BY 1,2 HAVING count(*)>=3""")
def _(t):
    _, c, r = threads(t)
    return graph.reply_network(c, r, include_self=True, min_weight=3)


@query("reply_network_top_nodes", f"""WITH {THREADS}, {REPLYNET}, deg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM net UNION ALL SELECT dst FROM net) GROUP BY 1 ORDER BY d DESC, node LIMIT 60)
SELECT * FROM net WHERE src IN (SELECT node FROM deg) AND dst IN (SELECT node FROM deg)""")
def _(t):
    _, c, r = threads(t)
    return graph.induced_subgraph(graph.reply_network(c, r), 60).select("src", "dst", "weight")


@query("pairwise_interactions", f"""WITH {EDGES}, {PART} SELECT x.channel_id AS src, y.channel_id AS dst, count(*) AS weight FROM part_ x JOIN part_ y USING (video_id)
 WHERE x.channel_id<y.channel_id GROUP BY 1,2 HAVING count(*)>=2""")
def _(t):
    return graph.pairwise_interactions(ev(t), 2)


ELIGIBLE = """p AS (SELECT video_id, channel_id FROM part_ WHERE (video_id, channel_id) NOT IN (SELECT (video_id, channel_id) FROM edges WHERE role='uploader')),
keep AS (SELECT *, row_number() OVER (ORDER BY videos DESC, channel_id) AS rank FROM (SELECT channel_id, count(*) AS videos FROM p GROUP BY 1)),
pairs AS (SELECT x.channel_id AS a, y.channel_id AS b, count(*) AS weight FROM p x JOIN p y USING (video_id) WHERE x.channel_id<>y.channel_id GROUP BY 1,2 HAVING count(*)>={w}),
rp AS (SELECT pairs.*, ka.rank AS ra, kb.rank AS rb FROM pairs JOIN keep ka ON ka.channel_id=a JOIN keep kb ON kb.channel_id=b)"""


INTERACTION = f"""WITH {EDGES}, {PART}, {ELIGIBLE.format(w=2)},
g AS (SELECT a AS src, b AS dst, weight FROM rp WHERE ra<rb)"""

THINNED = f"""WITH {EDGES}, {PART}, {ELIGIBLE.format(w=2)},
g AS (SELECT a AS src, b AS dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, rb) AS k FROM rp) WHERE k<=20 AND ra<rb)"""


@query("interaction_graph_thinned", f"{THINNED} SELECT * FROM g")
def _(t):
    return graph.interaction_graph(ev(t), top_k_per_node=20)


@query("interaction_graph", f"{INTERACTION} SELECT * FROM g")
def _(t):
    return graph.interaction_graph(ev(t))


@query("participation_matrix_top", f"""WITH {EDGES}, {PART} SELECT channel_id, video_id FROM part_
 WHERE channel_id IN (SELECT channel_id FROM part_ GROUP BY 1 ORDER BY count(*) DESC, channel_id LIMIT 50)
 AND video_id IN (SELECT video_id FROM part_ GROUP BY 1 ORDER BY count(*) DESC, video_id LIMIT 200)""")
def _(t):
    return graph.participation_matrix(ev(t), top_channels=50, top_videos=200)


@query("similarity_settings", f"""WITH {EDGES}, {PART}, r AS (SELECT channel_id, count(*) AS n FROM part_ GROUP BY 1),
s AS (SELECT count(*) AS channels, (SELECT count(DISTINCT video_id) FROM part_) AS videos, sum(n)/(count(*)*(SELECT count(DISTINCT video_id) FROM part_)) AS density, skewness(n) AS skew FROM r)
SELECT channels, videos, round(density,6) AS density, round(skew,6) AS skew, CASE WHEN skew>1 THEN 'log1p' ELSE 'none' END AS transform,
 CASE WHEN density<0.1 THEN 'cosine' ELSE 'corr' END AS similarity, CASE WHEN density<0.1 THEN 'p99' ELSE 'p995' END AS clip FROM s""")
def _(t):
    return graph.similarity_settings(graph.participation_matrix(ev(t)))


SIM = f"""WITH {EDGES}, {PART}, v AS (SELECT count(DISTINCT video_id) AS v FROM part_), best AS (SELECT channel_id, count(*) AS n FROM part_ GROUP BY 1),
w AS (SELECT x.channel_id AS channel_1, y.channel_id AS channel_2, count(*) AS w FROM part_ x JOIN part_ y USING (video_id) WHERE x.channel_id<y.channel_id
  AND x.channel_id IN (SELECT channel_id FROM best) AND y.channel_id IN (SELECT channel_id FROM best) GROUP BY 1,2),
s AS (SELECT channel_1, channel_2, w AS shared_videos, {{}} AS similarity FROM w JOIN best p ON p.channel_id=channel_1 JOIN best q ON q.channel_id=channel_2, v)
SELECT channel_1, channel_2, shared_videos, round(similarity,6) AS similarity, round(least(similarity,(SELECT quantile_cont(similarity,0.99) FROM s WHERE similarity>0)),6) AS clipped FROM s"""


@query("channel_similarity_cosine", SIM.format("w/sqrt(p.n*q.n)"))
def _(t):
    return graph.channel_similarity(graph.participation_matrix(ev(t)))


@query("channel_similarity_pearson", SIM.format("(v*w-p.n*q.n)/sqrt((v*p.n-p.n*p.n)*(v*q.n-q.n*q.n)*1.0)"))
def _(t):
    return graph.channel_similarity(graph.participation_matrix(ev(t)), "corr")


@query("channel_similarity_dot", SIM.format("CAST(w AS DOUBLE)"))
def _(t):
    return graph.channel_similarity(graph.participation_matrix(ev(t)), "dot")


@query("channel_similarity_pearson_dense", f"""WITH {EDGES}, {PART}, v AS (SELECT count(DISTINCT video_id) AS v FROM part_), best AS (SELECT channel_id, count(*) AS n FROM part_ GROUP BY 1 ORDER BY n DESC, channel_id LIMIT 60),
w AS (SELECT x.channel_id AS c1, y.channel_id AS c2, count(*) AS w FROM part_ x JOIN part_ y USING (video_id) WHERE x.channel_id<y.channel_id GROUP BY 1,2),
s AS (SELECT p.channel_id AS channel_1, q.channel_id AS channel_2, coalesce(w,0) AS shared_videos, (v*coalesce(w,0)-p.n*q.n)/sqrt((v*p.n-p.n*p.n)*(v*q.n-q.n*q.n)*1.0) AS similarity FROM best p JOIN best q ON p.channel_id<q.channel_id LEFT JOIN w ON c1=p.channel_id AND c2=q.channel_id, v)
SELECT channel_1, channel_2, shared_videos, round(similarity,6) AS similarity, round(least(similarity,(SELECT quantile_cont(similarity,0.99) FROM s WHERE similarity>0)),6) AS clipped FROM s""")
def _(t):
    return graph.channel_similarity(graph.participation_matrix(ev(t)), "corr", max_channels=60, dense=True)


DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY 1)"


@query("top_connected_channels", f"{INTERACTION}, {DEG} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 10")
def _(t):
    return graph.top_connected(graph.interaction_degrees(ev(t)))


@query("degree_histogram", f"{INTERACTION}, {DEG}, {histogram_sql('deg', 'degree', 30, 100)}")
def _(t):
    return graph.degree_histogram(graph.interaction_degrees(ev(t)))


@query("degree_centrality", f"{INTERACTION}, {DEG} SELECT node, degree, round(degree/((SELECT count(*) FROM deg)-1),6) AS degree_centrality FROM deg")
def _(t):
    return graph.degree_centrality(graph.interaction_degrees(ev(t)))


SYMMETRIC = "sym AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g), nd AS (SELECT DISTINCT x AS node FROM sym)"

# power iteration on A + I, far beyond the rounds that six places need
EIGEN = """pw AS (WITH RECURSIVE it(k, node, x) AS (SELECT 0, node, 1.0::DOUBLE/count(*) OVER () FROM nd
 UNION ALL SELECT k, node, y/sqrt(sum(y*y) OVER ()) FROM (SELECT k+1 AS k, node, sum(x) AS y FROM (SELECT k, sym.y AS node, it.x AS x FROM it JOIN sym ON sym.x=it.node UNION ALL SELECT k, node, x FROM it) WHERE k<80 GROUP BY 1,2)) SELECT * FROM it),
eg AS (SELECT node, round(x,6) AS eigenvector, true AS converged FROM pw WHERE k=80)"""


def betweenness_sql(levels: int = 6) -> str:
    """Shortest path counts by level, then the share of each pair's paths through a node."""
    parts, seen = ["b0 AS (SELECT node AS s, node, 0 AS d, 1.0::DOUBLE AS paths FROM nd)"], "SELECT s, node FROM b0"
    for k in range(1, levels + 1):
        parts.append(f"b{k} AS (SELECT s, y AS node, {k} AS d, sum(paths) AS paths FROM b{k - 1} JOIN sym ON x=node WHERE (s, y) NOT IN ({seen}) GROUP BY 1,2)")
        seen += f" UNION ALL SELECT s, node FROM b{k}"
    parts.append(f"sp AS ({' UNION ALL '.join(f'SELECT * FROM b{k}' for k in range(levels + 1))})")
    return f"""{', '.join(parts)},
bt AS (SELECT a.node, sum(a.paths*b.paths/e.paths) AS r FROM sp a JOIN sp b ON b.s=a.node JOIN sp e ON e.s=a.s AND e.node=b.node AND e.d=a.d+b.d WHERE a.d>0 AND b.d>0 GROUP BY 1),
bw AS (SELECT node, round(coalesce(r,0)/((count(*) OVER ()-1)*(count(*) OVER ()-2)),6) AS betweenness, count(*) OVER () AS k, count(*) OVER () AS n FROM nd LEFT JOIN bt USING (node))"""


@query("eigenvector_centrality", f"{INTERACTION}, {SYMMETRIC}, {EIGEN} SELECT * FROM eg")
def _(t):
    return eigenvector_centrality(graph.interaction_graph(ev(t), as_rows=False), tol=1e-12)


@query("betweenness_centrality", f"{INTERACTION}, {SYMMETRIC}, {betweenness_sql()} SELECT * FROM bw")
def _(t):
    return betweenness(graph.interaction_graph(ev(t), as_rows=False))


@query("centrality_table", f"""{INTERACTION}, {DEG}, {SYMMETRIC}, {EIGEN}, {betweenness_sql()}
SELECT node, degree, round(degree/((SELECT count(*) FROM deg)-1),6) AS degree_centrality, betweenness, k, n, eigenvector, converged FROM deg JOIN eg USING (node) JOIN bw USING (node) ORDER BY degree DESC, node LIMIT 20""")
def _(t):
    return graph.centrality_table(graph.interaction_graph(ev(t), as_rows=False), tol=1e-12)


@query("frequent_channel_pairs", f"""WITH {EDGES}, {PART}, {ELIGIBLE.format(w=3)} SELECT a AS channel_1, b AS channel_2, weight AS co_occurrence FROM rp WHERE ra<rb""")
def _(t):
    return graph.frequent_pairs(ev(t))


@query("frequent_channel_pairs_unlimited", f"""WITH {EDGES}, {PART} SELECT x.channel_id AS channel_1, y.channel_id AS channel_2, count(*) AS co_occurrence FROM part_ x JOIN part_ y USING (video_id)
 WHERE x.channel_id<y.channel_id GROUP BY 1,2 HAVING count(*)>=3""")
def _(t):
    return graph.frequent_pairs_all(ev(t))


COMMUNITIES = f"""WITH {EDGES}, {PART}, {ELIGIBLE.format(w=3)}, pr AS (SELECT a AS src, b AS dst, weight::DOUBLE AS weight FROM rp WHERE ra<rb), arcs AS (SELECT * FROM pr UNION ALL SELECT dst, src, weight FROM pr),
own AS (SELECT src AS node, avg(weight) AS own FROM arcs GROUP BY 1),
lp AS (WITH RECURSIVE it(k, node, community) AS (SELECT 0, node, node FROM own
 UNION ALL SELECT k, node, community FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, community) AS rn FROM (SELECT k+1 AS k, node, community, round(sum(w),9) AS w FROM
  (SELECT it.k, arcs.src AS node, it.community, arcs.weight AS w FROM it JOIN arcs ON arcs.dst=it.node UNION ALL SELECT it.k, it.node, it.community, own FROM it JOIN own USING (node)) WHERE k<60 GROUP BY 1,2,3)) WHERE rn=1) SELECT node, community FROM it WHERE k=60)"""
MODULARITY = """tc2 AS (SELECT p.weight, x.community AS ca, y.community AS cb FROM pr p JOIN lp x ON x.node=src JOIN lp y ON y.node=dst), m AS (SELECT sum(weight) AS m FROM pr),
ins AS (SELECT ca AS community, sum(weight) AS weight_inside FROM tc2 WHERE ca=cb GROUP BY 1), tch AS (SELECT community, sum(weight) AS weight_touching FROM arcs JOIN lp ON node=src GROUP BY 1), sz AS (SELECT community, count(*) AS nodes FROM lp GROUP BY 1)"""


@query("channel_pair_communities", f"{COMMUNITIES} SELECT node, community, true AS converged FROM lp")
def _(t):
    return graph.pair_communities(graph.frequent_pairs(ev(t), as_rows=False), method="labels")[0]


@query("channel_pair_modularity", f"""{COMMUNITIES}, {MODULARITY} SELECT community, nodes, weight_touching, coalesce(weight_inside,0.0) AS weight_inside, round(coalesce(weight_inside,0)/m-(weight_touching/(2*m))*(weight_touching/(2*m)),6) AS modularity
 FROM sz JOIN tch USING (community) LEFT JOIN ins USING (community), m""")
def _(t):
    return graph.pair_communities(graph.frequent_pairs(ev(t), as_rows=False), method="labels")[1]


@query("interaction_subgraph_top_nodes", f"""{INTERACTION}, {DEG}, best AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 40)
SELECT * FROM g WHERE src IN (SELECT node FROM best) AND dst IN (SELECT node FROM best)""")
def _(t):
    return graph.induced_subgraph(graph.interaction_graph(ev(t), as_rows=False), 40).select("src", "dst", "weight")


EXPORT = """rows_ AS (SELECT v.channel_id AS src, c.author_channel_id AS dst, 'comment' AS edge_type, c.video_id AS o1, c.comment_id::VARCHAR AS o2, '' AS o3 FROM comments c JOIN videos v USING (video_id)
 UNION ALL SELECT c.author_channel_id, r.author_channel_id, 'reply', c.video_id, c.comment_id::VARCHAR, r.reply_id FROM replies r JOIN comments c USING (comment_id)),
g AS (SELECT src, dst, count(*) AS weight, arg_min(edge_type, o1||chr(1)||o2||chr(1)||o3) AS edge_type FROM rows_ GROUP BY 1,2)"""


@query("channel_export_edges", f"WITH {THREADS}, {EXPORT} SELECT * FROM g")
def _(t):
    return graph.channel_export_graph(*threads(t))[1]


@query("channel_export_nodes", f"WITH {THREADS}, {EXPORT} SELECT src AS node, NULL::VARCHAR AS name FROM g UNION SELECT dst, NULL FROM g")
def _(t):
    return graph.channel_export_graph(*threads(t))[0]


# reel networks ---------------------------------------------------------------

PAIRS = """tc AS (SELECT hashtag, count(*) AS n FROM reel_hashtags GROUP BY 1),
tp AS (SELECT x.hashtag AS a, y.hashtag AS b, count(*) AS w FROM reel_hashtags x JOIN reel_hashtags y USING (reel_pk) WHERE x.hashtag<y.hashtag GROUP BY 1,2)"""


@query("hashtag_cooccurrence_edges", f"WITH {TAGS}, {PAIRS} SELECT 'hashtag:'||a AS source, 'hashtag:'||b AS target, w AS weight, 'cooccurs_in_reel' AS relation FROM tp WHERE w>=40")
def _(t):
    return graph.tag_cooccurrence(tags(t), 40)[1]


@query("hashtag_cooccurrence_nodes", f"WITH {TAGS}, {PAIRS} SELECT 'hashtag:'||hashtag AS id, hashtag AS label, 'hashtag' AS kind, n AS reel_count FROM tc")
def _(t):
    return graph.tag_cooccurrence(tags(t))[0]


R = f"{REELS}, {SONGS}, rs AS (SELECT *, {SONG_LABEL} AS sl, {ASSET_LABEL} AS al FROM reels LEFT JOIN songs USING (song_id))"


def bipartite_sql(src, left, right, relation):
    (lp, lc, ll), (rp, rc, rl) = left, right
    e = f"SELECT '{lp}:'||{lc} AS source, '{rp}:'||{rc} AS target, count(*) AS weight, '{relation}' AS relation FROM {src} GROUP BY 1,2"
    n = f"""SELECT id, kind, min(label) AS label, count(*) AS reel_count FROM (SELECT '{lp}:'||{lc} AS id, '{lp}' AS kind, {ll} AS label FROM {src}
 UNION ALL SELECT '{rp}:'||{rc}, '{rp}', {rl} FROM {src}) GROUP BY 1,2"""
    return f"WITH {R}, {TAGS} {e}", f"WITH {R}, {TAGS} {n}"


_C = ("creator", "creator_pseudo", "creator_pseudo")
_S = ("song", "song_id", "sl")
CREATOR_SONG = bipartite_sql("rs", _C, _S, "creator_uses_song")
CREATOR_ASSET = bipartite_sql("rs", _C, ("asset", "asset_id", "al"), "creator_uses_asset")
SONG_TAG = bipartite_sql("rs JOIN reel_hashtags USING (reel_pk)", _S, ("hashtag", "hashtag", "hashtag"), "song_hashtag")


@query("creator_song_edges", CREATOR_SONG[0])
def _(t):
    return graph.creator_song_graph(reels_with_songs(t))[1]


@query("creator_song_nodes", CREATOR_SONG[1])
def _(t):
    return graph.creator_song_graph(reels_with_songs(t))[0]


@query("creator_asset_edges", CREATOR_ASSET[0])
def _(t):
    return graph.creator_asset_graph(reels_with_songs(t))[1]


@query("creator_asset_nodes", CREATOR_ASSET[1])
def _(t):
    return graph.creator_asset_graph(reels_with_songs(t))[0]


@query("song_hashtag_edges", SONG_TAG[0])
def _(t):
    return graph.song_tag_graph(reels_with_songs(t), tags(t))[1]


@query("song_hashtag_nodes", SONG_TAG[1])
def _(t):
    return graph.song_tag_graph(reels_with_songs(t), tags(t))[0]


COMPONENTS = """reach AS (WITH RECURSIVE sym AS (SELECT {s} AS x, {d} AS y FROM {e} UNION SELECT {d}, {s} FROM {e}),
 walk(node, seen) AS (SELECT x, x FROM sym UNION SELECT y, seen FROM walk JOIN sym ON x=node)
 SELECT node, min(seen) AS component FROM walk GROUP BY 1)"""


@query("creator_song_node_metrics", f"""WITH e AS ({CREATOR_SONG[0]} HAVING count(*)>=6), n AS ({CREATOR_SONG[1]}), {COMPONENTS.format(s='source', d='target', e='e')},
d AS (SELECT id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM (SELECT source AS id, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY 1),
p AS (SELECT n.*, coalesce(degree,0) AS degree, coalesce(weighted_degree,0) AS weighted_degree, coalesce(component, n.id) AS component FROM n LEFT JOIN d USING (id) LEFT JOIN reach ON node=n.id)
SELECT *, count(*) OVER (PARTITION BY component) AS component_size FROM p""")
def _(t):
    n, e = graph.creator_song_graph(reels_with_songs(t), 6)
    return graph.node_metrics(n, e)


NET = """n_ AS (SELECT count(DISTINCT reel_pk) AS n FROM reel_hashtags),
net AS (SELECT a AS source, b AS target, w AS weight, w/(x.n+y.n-w) AS jaccard, log2(w*n_.n/(x.n*y.n)) AS pmi, x.n AS source_count, y.n AS target_count
 FROM tp JOIN tc x ON x.hashtag=a JOIN tc y ON y.hashtag=b, n_ WHERE w>=3 AND x.n>=5 AND y.n>=5),
tn AS (SELECT hashtag, tc.n AS count, tc.n/n_.n AS share FROM tc, n_ WHERE tc.n>=5)"""


@query("hashtag_network_edges", f"WITH {TAGS}, {PAIRS}, {NET} SELECT source, target, weight, round(jaccard,6) AS jaccard, round(pmi,6) AS pmi, source_count, target_count FROM net")
def _(t):
    return graph.tag_network(graph.clean_tags(tags(t)))[1]


@query("hashtag_network_nodes", f"WITH {TAGS}, {PAIRS}, {NET} SELECT hashtag, count, round(share,6) AS share FROM tn")
def _(t):
    return graph.tag_network(graph.clean_tags(tags(t)))[0]


CLUSTERS = f"""strong AS (SELECT * FROM net WHERE jaccard>=0.18), {COMPONENTS.format(s='source', d='target', e='strong')},
m AS (SELECT hashtag, count, coalesce(component, hashtag) AS component FROM tn LEFT JOIN reach ON node=hashtag),
f AS (SELECT component, count(*) AS cluster_size, CAST(sum(count) AS BIGINT) AS total, list_aggregate((list(hashtag ORDER BY count DESC, hashtag))[1:5], 'string_agg', ', ') AS cluster_label_suggestion FROM m GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY total DESC, component) AS cluster_id FROM f),
cl AS (SELECT cluster_id, hashtag, count, cluster_size, cluster_label_suggestion FROM m JOIN o USING (component))"""


@query("hashtag_clusters", f"WITH {TAGS}, {PAIRS}, {NET}, {CLUSTERS} SELECT * FROM cl")
def _(t):
    return graph.tag_clusters(*graph.tag_network(graph.clean_tags(tags(t))), min_jaccard=0.18)


@query("hashtag_cluster_sizes", f"""WITH {TAGS}, {PAIRS}, {NET}, {CLUSTERS} SELECT cluster_id, cluster_label_suggestion AS label, count(*) AS members, CAST(sum(count) AS BIGINT) AS total_count
 FROM cl GROUP BY 1,2 ORDER BY total_count DESC, cluster_id LIMIT 12""")
def _(t):
    return graph.cluster_sizes(graph.tag_clusters(*graph.tag_network(graph.clean_tags(tags(t))), min_jaccard=0.18))


# rules for the driver tags: priority substrings first, then clusters in order
TAG_RULES = [(1, "priority", "promo", "Offers"), (2, "exact", "brand1", "House brand"), (3, "contains", "brand2", "Twenties"), (4, "exact", "large", "Sizes"), (5, "contains", "small", "Sizes"), (6, "contains", "medi", "Sizes")]
SEMANTIC = """sem AS (SELECT hashtag, CASE WHEN contains(hashtag,'promo') THEN 'Offers' WHEN hashtag='brand1' THEN 'House brand' WHEN contains(hashtag,'brand2') THEN 'Twenties'
 WHEN hashtag='large' OR contains(hashtag,'small') OR contains(hashtag,'medi') THEN 'Sizes' ELSE 'Other' END AS semantic_cluster FROM tc)"""


def tag_rules(t):
    return t.spark.createDataFrame(TAG_RULES, "ord int, kind string, term string, label string")


@query("hashtag_semantic_clusters", f"WITH {TAGS}, {PAIRS}, {SEMANTIC} SELECT * FROM sem")
def _(t):
    return graph.semantic_clusters(graph.clean_tags(tags(t)), tag_rules(t))


@query("hashtag_semantic_summary", f"""WITH {TAGS}, {PAIRS}, {NET}, {SEMANTIC} SELECT semantic_cluster, count(*) AS n_tags, CAST(sum(count) AS BIGINT) AS total_count,
 list_aggregate((list(hashtag ORDER BY count DESC, hashtag))[1:12], 'string_agg', ', ') AS top_hashtags FROM tn JOIN sem USING (hashtag) GROUP BY 1""")
def _(t):
    return graph.network_bundle(tags(t), tag_rules(t))["semantic_clusters"]


@query("hashtag_pairs_simple", f"""WITH {TAGS}, {PAIRS} SELECT a AS tag_a, b AS tag_b, w AS shared, x.n AS count_a, y.n AS count_b FROM tp JOIN tc x ON x.hashtag=a JOIN tc y ON y.hashtag=b
 WHERE w>=5 ORDER BY w DESC, a, b LIMIT 25""")
def _(t):
    return graph.simple_cooccurrence(tags(t))


@query("connected_components", f"""WITH {TAGS}, strong AS (SELECT 'c'||o_custkey AS source, 'p'||l_partkey AS target FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1,2 HAVING count(*)>=2),
{COMPONENTS.format(s='source', d='target', e='strong')} SELECT node, component FROM reach""")
def _(t):
    pairs = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")
    ).count().filter("count >= 2")
    return connected_components(pairs, "source", "target")
