"""User, reply and hashtag networks as node and edge tables.

``edges`` below are role edges (channel_id, video_id, role); graphs are tables
(src, dst, weight).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.automaton import groups_found, many, named
from ..functions.columns import asset_label, clean_tag, filled, nfc, ranked_top, scalar, song_label, top_n, top_per_group
from ..functions.communities import modularity_communities
from ..functions.components import betweenness, connected_components, eigenvector_centrality, label_propagation, modularity
from ..functions.numbering import number_rows
from ..functions.packed import MemberGraph, packed_communities
from ..functions.pairs import group_pairs, shared_degrees, shared_group_counts, short_list_pairs, sized_pairs, sized_pairs_and_kinds, strongest_pairs
from ..functions.quantiles import exact_percentiles
from ..session import durable
from .scope import right_closed_histogram

ROLES = ("uploader", "commenter", "replier")


def participants(edges: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """G1: distinct (video_id, channel_id) over the given roles."""
    return edges.filter(F.col("role").isin(*roles) & filled("channel_id")).select("video_id", "channel_id").distinct()


def _guests(edges: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Distinct (video_id, channel_id) over the given roles, without the channels that uploaded the video; edges are read once."""
    known = edges.filter(F.col("role").isin(*roles) & filled("channel_id")).groupBy("video_id", "channel_id").agg(F.max(F.col("role") == "uploader").alias("owner"))
    return known.filter(~F.col("owner") | F.col("video_id").isNull()).select("video_id", "channel_id")


def channel_stats(edges: DataFrame) -> DataFrame:
    """Role counts, total activity and distinct videos per channel."""
    return edges.filter(filled("channel_id")).groupBy("channel_id").agg(
        *[F.count_if(F.col("role") == r).alias(f"as_{r}") for r in ROLES],
        F.count("*").alias("total_activity"),
        F.countDistinct("video_id").alias("videos_active_in"),
    )


def top_channels(stats: DataFrame, role: str, n: int = 20) -> DataFrame:
    """Channels with the highest count in one role."""
    return ranked_top(stats.select("channel_id", F.col(role).alias("count")), n, F.desc("count"), F.asc("channel_id"))


def role_proportions(stats: DataFrame, normalize: bool = False, n: int | None = None) -> DataFrame:
    """Long table (channel_id, role, count), optionally as share of the channel."""
    cols = [f"as_{r}" for r in ROLES]
    whole = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    use = stats.select("channel_id", *[F.col(c).cast("double").alias(c) for c in cols])
    if normalize:
        use = use.select("channel_id", *[(F.col(c) / F.coalesce(F.nullif(whole, F.lit(0)), F.lit(1))).alias(c) for c in cols])
    if n:
        use = use.orderBy(*[F.desc(c) for c in cols], "channel_id").limit(n)
    return use.unpivot("channel_id", cols, "role", "count")


def reply_network(comments: DataFrame, replies: DataFrame, include_self: bool = False, min_weight: int = 1) -> DataFrame:
    """Replier -> comment author with the number of replies."""
    parent = comments.filter(filled("author_channel_id")).select("comment_id", F.col("author_channel_id").alias("dst"))
    rows = replies.filter(filled("author_channel_id")).select("comment_id", F.col("author_channel_id").alias("src")).join(parent, "comment_id")
    if not include_self:
        rows = rows.filter("src <> dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_weight)


def pairwise_interactions(edges: DataFrame, min_weight: int, roles: Sequence[str] = ROLES) -> DataFrame:
    """Unordered channel pairs with at least ``min_weight`` shared videos; the caller states the threshold."""
    return _as_edges(shared_group_counts(participants(edges, roles), "video_id", "channel_id", min_weight))


def _as_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def _eligible(edges: DataFrame, roles, exclude_uploader, max_participants, min_videos, top) -> DataFrame:
    """Participation rows that pass the filters the caller asks for."""
    part = _guests(edges, roles) if exclude_uploader and "uploader" in roles else participants(edges, roles)
    if max_participants is not None:
        small = part.groupBy("video_id").count().filter(F.col("count") <= max_participants).select("video_id")
        part = part.join(small, "video_id", "left_semi")
    busy = part.groupBy("channel_id").agg(F.count("*").alias("videos"))
    if min_videos > 1:
        busy = busy.filter(F.col("videos") >= min_videos)
    if top is not None:
        busy = busy.orderBy(F.desc("videos"), F.asc("channel_id")).limit(top)
    if min_videos > 1 or top is not None:
        part = part.join(busy.select("channel_id"), "channel_id", "left_semi")
    return part


def interaction_graph(
    edges: DataFrame, roles: Sequence[str] = ROLES, exclude_uploader: bool = True, top_channels: int | None = None,
    min_videos_per_channel: int = 1, max_participants_per_video: int | None = None, min_weight: int = 2,
    top_k_per_node: int | None = None, max_edges: int | None = None, as_rows: bool = True,
) -> DataFrame | MemberGraph:
    """Co-participation graph (src, dst, weight), the busier channel first.

    All channels, videos and edges count unless the caller asks for limits. With
    ``top_k_per_node`` an edge stays when the less busy channel is among the
    busier one's strongest neighbours. Without ``as_rows`` the whole graph is
    given by its members, for steps that need no table of edges.
    """
    part = _eligible(edges, roles, exclude_uploader, max_participants_per_video, min_videos_per_channel, top_channels)
    if not as_rows:
        if top_k_per_node is not None or max_edges is not None:
            raise ValueError("limits of edges need rows")
        return MemberGraph(part, "video_id", "channel_id", min_weight)
    if top_k_per_node is None:
        out = sized_pairs(part, "video_id", "channel_id", min_weight, larger_first=True)
    else:
        out = strongest_pairs(part, "video_id", "channel_id", min_weight, top_k_per_node)
    if max_edges is not None:
        out = out.orderBy(F.desc("weight"), F.desc("na"), "a", F.desc("nb"), "b").limit(max_edges)
    return out.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def interaction_degrees(
    edges: DataFrame, roles: Sequence[str] = ROLES, exclude_uploader: bool = True, top_channels: int | None = None,
    min_videos_per_channel: int = 1, max_participants_per_video: int | None = None, min_weight: int = 2,
) -> DataFrame:
    """(node, degree) of the graph of ``interaction_graph`` without its edges."""
    part = _eligible(edges, roles, exclude_uploader, max_participants_per_video, min_videos_per_channel, top_channels)
    return shared_degrees(part, "video_id", "channel_id", min_weight)


def participation_matrix(edges: DataFrame, roles: Sequence[str] = ROLES, top_channels: int | None = None, top_videos: int | None = None) -> DataFrame:
    """Long (channel_id, video_id) matrix of the most active rows and columns."""
    part = participants(edges, roles)
    out = part
    if top_channels:
        best = part.groupBy("channel_id").count().orderBy(F.desc("count"), "channel_id").limit(top_channels)
        out = out.join(best.select("channel_id"), "channel_id", "left_semi")
    if top_videos:
        best = part.groupBy("video_id").count().orderBy(F.desc("count"), "video_id").limit(top_videos)
        out = out.join(best.select("video_id"), "video_id", "left_semi")
    return out.select("channel_id", "video_id")


def similarity_settings(matrix: DataFrame) -> DataFrame:
    """Density, skew of channel totals and the settings they suggest."""
    rows = matrix.groupBy("channel_id").agg(F.count("*").alias("n"))
    size = scalar(matrix, F.countDistinct("video_id").alias("videos"))
    out = rows.agg(F.count("*").alias("channels"), F.sum("n").alias("cells"), F.skewness("n").alias("g")).select(
        "channels", "cells", "g", size["videos"].alias("videos")
    )
    n = F.col("channels")
    skew = F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    return out.withColumn("density", F.col("cells") / (n * F.col("videos"))).withColumn("skew", F.coalesce(F.nanvl(skew, F.lit(0.0)), F.lit(0.0))).select(
        "channels", "videos", "density", "skew",
        F.when(F.col("skew") > 1, "log1p").otherwise("none").alias("transform"),
        F.when(F.col("density") < 0.1, "cosine").otherwise("corr").alias("similarity"),
        F.when(F.col("density") < 0.1, "p99").otherwise("p995").alias("clip"),
    )


def channel_similarity(
    matrix: DataFrame, how: str = "cosine", transform: str = "none", max_channels: int | None = None, clip: float | None = 0.99, min_shared: int = 1, dense: bool = False
) -> DataFrame:
    """Similarity of channel pairs that share a video, with the clip level of the positive values.

    ``max_channels`` keeps the most active channels only, ``min_shared`` the
    pairs with so many shared videos. Pairs without a shared video have dot and
    cosine 0; their Pearson value follows from the row totals and is never
    positive. ``dense`` adds these pairs, so that the result is the whole
    matrix; it needs ``max_channels``, since that matrix is the square of it.
    """
    if dense and max_channels is None:
        raise ValueError("the dense form needs max_channels")
    size = scalar(matrix, F.countDistinct("video_id").alias("v"))
    totals = matrix.groupBy("channel_id").agg(F.count("*").alias("n"))
    if max_channels is not None:
        totals = totals.orderBy(F.desc("n"), "channel_id").limit(max_channels)
        matrix = matrix.join(totals.select("channel_id"), "channel_id", "left_semi")
    if dense:
        # max_channels rows on each side, which the caller bounds
        pairs = shared_group_counts(matrix, "video_id", "channel_id", min_shared)
        one = totals.select(F.lit(1).alias("g"), "channel_id")
        pairs = group_pairs(one, "g", "channel_id").select("a", "b").join(pairs, ["a", "b"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
        pairs = pairs.join(totals.select(F.col("channel_id").alias("a"), F.col("n").alias("na")), "a").join(
            totals.select(F.col("channel_id").alias("b"), F.col("n").alias("nb")), "b"
        )
        kinds = None
    elif clip is None:
        pairs, kinds = sized_pairs(matrix, "video_id", "channel_id", min_shared), None
    else:
        pairs, kinds = sized_pairs_and_kinds(matrix, "video_id", "channel_id", min_shared)
    w, na, nb, v = F.col("weight"), F.col("na"), F.col("nb"), size["v"]
    unit = 0.4804530139182014 if transform == "log1p" else 1.0  # ln(2) squared
    value = {
        "dot": w * unit,
        "cosine": w / F.sqrt(na * nb),
        "corr": F.try_divide(v * w - na * nb, F.sqrt((v * na - na * na) * (v * nb - nb * nb))),
    }[how]
    out = pairs.select(F.col("a").alias("channel_1"), F.col("b").alias("channel_2"), F.col("weight").alias("shared_videos"), value.cast("double").alias("similarity"))
    if clip is None:
        return out
    # pairs of equal counts have equal values, so the level comes from few rows with their number of pairs
    if kinds is None:
        kinds = durable(pairs.groupBy("weight", "na", "nb").agg(F.count("*").alias("times")))
    valued = kinds.select("times", value.cast("double").alias("similarity")).filter("similarity > 0")
    level = exact_percentiles(valued, [], {"q": (F.col("similarity"), clip)}, F.col("times")).agg(F.max("q")).scalar()
    return out.withColumn("clipped", F.least("similarity", level))


def node_degrees(graph: DataFrame | MemberGraph) -> DataFrame:
    """Degree of each node of an undirected edge table; a table of degrees is taken as it is."""
    if isinstance(graph, MemberGraph):
        return graph.degrees()
    if "degree" in graph.columns:
        return graph
    ends = graph.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def top_connected(graph: DataFrame, n: int = 10) -> DataFrame:
    """Nodes with the highest degree."""
    return top_n(node_degrees(graph), n, F.desc("degree"), F.asc("node"))


def degree_histogram(graph: DataFrame, bins: int = 30, cap: int = 100) -> DataFrame:
    """Right-closed degree histogram."""
    return right_closed_histogram(node_degrees(graph), "degree", bins, cap=cap)


def degree_centrality(graph: DataFrame) -> DataFrame:
    """Degree / (n - 1)."""
    deg = durable(node_degrees(graph))
    n = scalar(deg, F.count("*").alias("n"))["n"]
    return deg.withColumn("degree_centrality", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(1.0))


def centrality_table(graph: DataFrame | MemberGraph, n: int = 20, slow: bool = True, tol: float = 1e-6) -> DataFrame:
    """Degree, betweenness and eigenvector centrality of the top nodes."""
    if slow and isinstance(graph, MemberGraph):
        graph.packed  # once for all three
    out = degree_centrality(graph)
    if slow:
        out = out.join(betweenness(graph), "node", "left").join(eigenvector_centrality(graph, tol), "node", "left")
    return top_n(out, n, F.desc("degree_centrality"), F.asc("node"))


def frequent_pairs(
    edges: DataFrame, threshold: int = 3, roles: Sequence[str] = ROLES, exclude_uploader: bool = True, top_channels: int | None = None,
    min_videos_per_channel: int = 1, max_participants_per_video: int | None = None, n: int | None = None, as_rows: bool = True,
) -> DataFrame | MemberGraph:
    """Channel pairs with at least ``threshold`` shared videos, the busier channel first; without ``as_rows`` all of them as a graph given by its members."""
    part = _eligible(edges, roles, exclude_uploader, max_participants_per_video, min_videos_per_channel, top_channels)
    if not as_rows:
        if n is not None:
            raise ValueError("a limit of pairs needs rows")
        return MemberGraph(part, "video_id", "channel_id", threshold)
    pairs = sized_pairs(part, "video_id", "channel_id", threshold, larger_first=True)
    out = pairs.select(F.col("a").alias("channel_1"), F.col("b").alias("channel_2"), F.col("weight").alias("co_occurrence"))
    return out if n is None else top_n(out, n, F.desc("co_occurrence"), F.asc("channel_1"), F.asc("channel_2"))


def frequent_pairs_all(edges: DataFrame, threshold: int = 3, roles: Sequence[str] = ROLES, exclude_uploader: bool = False, n: int | None = None) -> DataFrame:
    """Every pair over the threshold, without participant or channel limits."""
    part = _guests(edges, roles) if exclude_uploader and "uploader" in roles else participants(edges, roles)
    pairs = shared_group_counts(part, "video_id", "channel_id", threshold)
    out = pairs.select(F.col("a").alias("channel_1"), F.col("b").alias("channel_2"), F.col("weight").alias("co_occurrence"))
    return out if n is None else top_n(out, n, F.desc("co_occurrence"), F.asc("channel_1"), F.asc("channel_2"))


def pair_communities(pairs: DataFrame | MemberGraph, n: int | None = None, method: str = "modularity") -> tuple[DataFrame, DataFrame]:
    """Communities of the pairs, of the ``n`` strongest if asked for, and their modularity.

    ``method`` is "modularity" (local moves and contraction) or "labels" (label propagation).
    Labels of a graph given by its members move on packed rows.
    """
    if isinstance(pairs, MemberGraph):
        if n is None and method == "labels":
            return packed_communities(pairs.packed)
        pairs = pairs.edges().select(F.col("a").alias("channel_1"), F.col("b").alias("channel_2"), F.col("weight").alias("co_occurrence"))
    use = pairs if n is None else top_n(pairs, n, F.desc("co_occurrence"), F.asc("channel_1"), F.asc("channel_2"))
    graph = durable(use.select(F.col("channel_1").alias("src"), F.col("channel_2").alias("dst"), F.col("co_occurrence").alias("weight")))
    communities = {"modularity": modularity_communities, "labels": label_propagation}[method](graph)
    return communities, modularity(graph, communities)


def induced_subgraph(graph: DataFrame | MemberGraph, n: int) -> DataFrame:
    """Edges among the ``n`` highest-degree nodes; isolated nodes vanish with them."""
    best = durable(top_connected(graph, n).select("node"))
    if isinstance(graph, MemberGraph):
        return _as_edges(graph.among(best).edges())
    # n rows on the right
    return graph.join(F.broadcast(best.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(best.withColumnRenamed("node", "dst")), "dst", "left_semi")


def clean_name(c: Column | str) -> Column:
    """Unicode NFC without control characters."""
    return F.regexp_replace(nfc(c), r"[\x00-\x1F\x7F]", "")


def channel_export_graph(videos: DataFrame, comments: DataFrame, replies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): channel -> commenter and commenter -> replier with first type kept.

    Names come from optional ``channel_name`` / ``author_name`` columns. Order
    is video, comment, then reply id.
    """
    def named(df, c):
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    v = videos.filter(filled("channel_id")).select("video_id", clean_name("channel_id").alias("owner"), named(videos, "channel_name").alias("owner_name"))
    c = (
        comments.filter(filled("author_channel_id"))
        .select("video_id", "comment_id", clean_name("author_channel_id").alias("author"), named(comments, "author_name").alias("author_name"))
        .join(v, "video_id")
    )
    where = F.struct(F.col("video_id").cast("string"), F.col("comment_id").cast("string"), F.lit("").alias("r"))
    rows = c.select(F.col("owner").alias("src"), F.col("author").alias("dst"), F.lit("comment").alias("edge_type"), where.alias("at"))
    names = v.select(F.col("owner").alias("node"), F.col("owner_name").alias("name")).unionByName(c.select(F.col("author").alias("node"), F.col("author_name").alias("name")))
    if replies is not None:
        r = replies.filter(filled("author_channel_id")).select(
            "comment_id", "reply_id", clean_name("author_channel_id").alias("dst"), named(replies, "author_name").alias("name")
        ).join(c.select("video_id", "comment_id", "author"), "comment_id")
        at = F.struct(F.col("video_id").cast("string"), F.col("comment_id").cast("string"), F.col("reply_id").cast("string").alias("r"))
        rows = rows.unionByName(r.select(F.col("author").alias("src"), "dst", F.lit("reply").alias("edge_type"), at.alias("at")))
        names = names.unionByName(r.select(F.col("dst").alias("node"), "name"))
    edges = rows.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.min_by("edge_type", "at").alias("edge_type"))
    nodes = names.groupBy("node").agg(F.min(clean_name("name")).alias("name"))
    return nodes, edges


# reel networks ---------------------------------------------------------------


def filter_edges(edges: DataFrame, min_weight: int, relation: str) -> DataFrame:
    """Edges at or above a weight, tagged with their relation."""
    return edges.filter(F.col("weight") >= min_weight).withColumn("relation", F.lit(relation))


def tag_cooccurrence(tags: DataFrame, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of hashtags used together in a reel."""
    distinct = tags.filter(filled("hashtag")).select("reel_pk", "hashtag").distinct()
    pairs = short_list_pairs(distinct, "reel_pk", "hashtag")
    edges = filter_edges(
        pairs.select(F.concat(F.lit("hashtag:"), "a").alias("source"), F.concat(F.lit("hashtag:"), "b").alias("target"), "weight"),
        min_weight, "cooccurs_in_reel",
    )
    nodes = distinct.groupBy("hashtag").agg(F.count("*").alias("reel_count")).select(
        F.concat(F.lit("hashtag:"), "hashtag").alias("id"), F.col("hashtag").alias("label"), F.lit("hashtag").alias("kind"), "reel_count"
    )
    return nodes, edges


def bipartite(rows: DataFrame, left: tuple[str, str, Column], right: tuple[str, str, Column], relation: str, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) between two id columns given as (prefix, column, label)."""
    (lp, lc, ll), (rp, rc, rl) = left, right
    use = rows.filter(filled(lc) & filled(rc)).select(
        F.concat(F.lit(lp + ":"), lc).alias("source"), F.concat(F.lit(rp + ":"), rc).alias("target"), ll.alias("ll"), rl.alias("rl")
    )
    edges = filter_edges(use.groupBy("source", "target").agg(F.count("*").alias("weight")), min_weight, relation)
    ends = use.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("ll").alias("label"), F.lit(lp).alias("kind")),
        F.struct(F.col("target").alias("id"), F.col("rl").alias("label"), F.lit(rp).alias("kind")),
    )).alias("n")).select("n.*")
    nodes = ends.groupBy("id", "kind").agg(F.min("label").alias("label"), F.count("*").alias("reel_count"))
    return nodes, edges


def creator_song_graph(reels: DataFrame, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    return bipartite(reels, ("creator", "creator_pseudo", F.col("creator_pseudo")), ("song", "song_id", song_label()), "creator_uses_song", min_weight)


def creator_asset_graph(reels: DataFrame, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    return bipartite(reels, ("creator", "creator_pseudo", F.col("creator_pseudo")), ("asset", "asset_id", asset_label()), "creator_uses_asset", min_weight)


def song_tag_graph(reels: DataFrame, tags: DataFrame, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    rows = reels.join(tags, "reel_pk")
    return bipartite(rows, ("song", "song_id", song_label()), ("hashtag", "hashtag", F.col("hashtag")), "song_hashtag", min_weight)


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, weighted degree, component and component size per node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "weight")
    deg = ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))
    comp = connected_components(edges, "source", "target").withColumnRenamed("node", "id")
    placed = nodes.join(deg, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    size = placed.groupBy("component").agg(F.count("*").alias("component_size"))
    return placed.join(size, "component").select(
        *nodes.columns, F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0)).alias("weighted_degree"), "component", "component_size"
    )


# fixed values: noise prefixes and stop tags of the tag network
NOISE_PREFIXES = ("fyp", "viral")
STOP_TAGS = ()


def clean_tags(tags: DataFrame, stop: Sequence[str] = STOP_TAGS, noise_prefixes: Sequence[str] = NOISE_PREFIXES, min_length: int = 2) -> DataFrame:
    """Normalised distinct (reel_pk, hashtag) without stop words, noise prefixes and short tags."""
    out = tags.select("reel_pk", clean_tag("hashtag").alias("hashtag")).filter(F.length("hashtag") >= max(1, min_length))
    if stop:
        out = out.filter(~F.col("hashtag").isin(*stop))
    for p in noise_prefixes:
        out = out.filter(~F.col("hashtag").startswith(p))
    return out.distinct()


def tag_network(clean: DataFrame, min_tag_count: int = 5, min_edge_count: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with share of reels, Jaccard and PMI (log2)."""
    n = scalar(clean, F.countDistinct("reel_pk").alias("n"))["n"]
    counts = clean.groupBy("hashtag").agg(F.count("*").alias("count")).filter(F.col("count") >= min_tag_count)
    pairs = short_list_pairs(clean, "reel_pk", "hashtag").filter(F.col("weight") >= min_edge_count)
    both = pairs.join(counts.select(F.col("hashtag").alias("a"), F.col("count").alias("ca")), "a").join(
        counts.select(F.col("hashtag").alias("b"), F.col("count").alias("cb")), "b"
    )
    w, ca, cb = F.col("weight"), F.col("ca"), F.col("cb")
    edges = both.select(
        F.col("a").alias("source"), F.col("b").alias("target"), "weight",
        (w / (ca + cb - w)).alias("jaccard"), F.log2(w * n / (ca * cb)).alias("pmi"), ca.alias("source_count"), cb.alias("target_count"),
    )
    return counts.withColumn("share", F.col("count") / n), edges


def tag_clusters(nodes: DataFrame, edges: DataFrame, min_jaccard: float = 0.0, labels: int = 5) -> DataFrame:
    """Components of the edges of at least ``min_jaccard``; tags without such an edge stay alone."""
    comp = connected_components(edges.filter(F.col("jaccard") >= min_jaccard), "source", "target").withColumnRenamed("node", "hashtag")
    return _labelled_clusters(nodes, comp, labels)


def tag_communities(nodes: DataFrame, edges: DataFrame, top_edges: int | None = 400, labels: int = 5) -> DataFrame:
    """Communities of high modularity over the ``top_edges`` strongest edges, all with None; other tags stay alone."""
    use = edges if top_edges is None else edges.orderBy(F.desc("weight"), F.desc("jaccard"), "source", "target").limit(top_edges)
    found = modularity_communities(use.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight"))
    return _labelled_clusters(nodes, found.select(F.col("node").alias("hashtag"), F.col("community").alias("component")), labels)


def _labelled_clusters(nodes: DataFrame, comp: DataFrame, labels: int) -> DataFrame:
    """Numbered clusters, the largest total count first, named by their ``labels`` most used tags."""
    rows = durable(nodes.select("hashtag", "count").join(comp, "hashtag", "left").withColumn("component", F.coalesce("component", "hashtag")))
    lead = top_per_group(rows, ["component"], labels, F.desc("count"), F.asc("hashtag"), name="r")
    words = lead.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("r", "hashtag"))).alias("l"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("cluster_size"), F.sum("count").alias("total_count"))
    facts = sizes.join(words, "component").withColumn("cluster_label_suggestion", F.array_join(F.transform("l", lambda t: t["hashtag"]), ", ")).drop("l")
    ordered = number_rows(facts, F.desc("total_count"), F.asc("component"), name="cluster_id")
    return rows.join(ordered, "component").select("cluster_id", "hashtag", "count", "cluster_size", "cluster_label_suggestion")


def semantic_clusters(tags: DataFrame, rules: DataFrame, other: str = "Other") -> DataFrame:
    """Label of each distinct tag from ordered rules (ord, kind, term, label).

    Priority and contains rules match substrings, exact rules whole tags; the
    lowest ord wins. A short rule list becomes one column expression. In a long
    one exact rules are joined by their term and the substrings of all others
    are looked for by one automaton.
    """
    tag, distinct = F.col("hashtag"), tags.select("hashtag").distinct()
    ordered = rules.orderBy("ord").collect()
    if not many(ordered):
        steps = [F.when(tag == r.term if r.kind == "exact" else tag.contains(r.term), F.lit(r.label)) for r in ordered]
        return distinct.withColumn("semantic_cluster", F.coalesce(*steps, F.lit(other)))
    inside = [(k, r.term) for k, r in enumerate(ordered) if r.kind != "exact"]
    first = F.array_min(named(groups_found(tag, [[t] for _, t in inside]), [k for k, _ in inside])) if inside else F.lit(None).cast("int")
    spark = tags.sparkSession
    whole: dict[str, int] = {}
    for k, r in enumerate(ordered):
        if r.kind == "exact":
            whole.setdefault(r.term, k)
    exact = spark.createDataFrame(list(whole.items()), "hashtag string, whole int")
    labels = spark.createDataFrame([(k, r.label) for k, r in enumerate(ordered)], "rule int, label string")
    placed = distinct.withColumn("inside", first).join(exact, "hashtag", "left").withColumn("rule", F.least("inside", "whole"))
    return placed.join(labels, "rule", "left").select("hashtag", F.coalesce("label", F.lit(other)).alias("semantic_cluster"))


def semantic_summary(nodes: DataFrame, rules: DataFrame, top: int = 12) -> DataFrame:
    """Tags, uses and leading tags per semantic cluster."""
    mapped = nodes.join(semantic_clusters(nodes, rules), "hashtag")
    facts = mapped.groupBy("semantic_cluster").agg(F.count("*").alias("n_tags"), F.sum("count").alias("total_count"))
    lead = top_per_group(mapped, ["semantic_cluster"], top, F.desc("count"), F.asc("hashtag"), name="r")
    words = lead.groupBy("semantic_cluster").agg(F.array_sort(F.collect_list(F.struct("r", "hashtag"))).alias("l")).select(
        "semantic_cluster", F.array_join(F.transform("l", lambda t: t["hashtag"]), ", ").alias("top_hashtags")
    )
    return facts.join(words, "semantic_cluster")


def simple_cooccurrence(tags: DataFrame, n: int | None = 25, min_count: int = 5) -> DataFrame:
    """Tag pairs by count with the counts of both tags."""
    distinct = tags.filter(filled("hashtag")).select("reel_pk", F.lower("hashtag").alias("hashtag")).distinct()
    counts = distinct.groupBy("hashtag").agg(F.count("*").alias("c"))
    pairs = short_list_pairs(distinct, "reel_pk", "hashtag").filter(F.col("weight") >= min_count)
    out = pairs.join(counts.select(F.col("hashtag").alias("a"), F.col("c").alias("count_a")), "a").join(
        counts.select(F.col("hashtag").alias("b"), F.col("c").alias("count_b")), "b"
    ).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), F.col("weight").alias("shared"), "count_a", "count_b")
    return top_n(out, n, F.desc("shared"), F.asc("tag_a"), F.asc("tag_b"))


def cluster_sizes(clusters: DataFrame, n: int = 12) -> DataFrame:
    """Members, total count and label of the largest clusters."""
    out = clusters.groupBy("cluster_id", F.col("cluster_label_suggestion").alias("label")).agg(F.count("*").alias("members"), F.sum("count").alias("total_count"))
    return top_n(out, n, F.desc("total_count"), F.asc("cluster_id"))


def network_bundle(
    tags: DataFrame, rules: DataFrame, min_tag_count: int = 5, min_edge_count: int = 3, stop: Sequence[str] = STOP_TAGS, noise_prefixes: Sequence[str] = NOISE_PREFIXES, cluster_jaccard: float = 0.0,
) -> dict[str, DataFrame]:
    """Nodes, edges, clusters and semantic summary of the tag network.

    ``stop`` is the configured stop list; clusters follow edges of at least
    ``cluster_jaccard``.
    """
    nodes, edges = tag_network(clean_tags(tags, stop, noise_prefixes), min_tag_count, min_edge_count)
    return {"nodes": nodes, "edges": edges, "clusters": tag_clusters(nodes, edges, cluster_jaccard), "semantic_clusters": semantic_summary(nodes, rules)}
