"""Overlap of labelled corpora: shared channels, cross traffic, change over time.

``edges`` are (channel_id, video_id, role, corpus, event_at, ...) rows with the
upload edge dated by its video; ``videos`` are (video_id, corpus, published_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import filled, ratio
from ..functions.quantiles import with_percentiles
from .graph import ROLES


def corpus_edges(videos: DataFrame, comments: DataFrame, replies: DataFrame) -> DataFrame:
    """One row per upload, comment and reply of every corpus."""
    none = F.lit(None)

    def rows(df, channel, role, comment, reply, at):
        return df.filter(filled(channel)).select(
            F.col(channel).alias("channel_id"), "video_id", F.lit(role).alias("role"), F.lit(1).alias("weight"), "corpus",
            comment.cast("string").alias("comment_id"), reply.cast("string").alias("reply_id"), F.col(at).alias("event_at"),
        )

    return (
        rows(videos, "channel_id", "uploader", none, none, "published_at")
        .unionByName(rows(comments, "author_channel_id", "commenter", F.col("comment_id"), none, "date"))
        .unionByName(rows(replies, "author_channel_id", "replier", F.col("comment_id"), F.col("reply_id"), "date"))
    )


def overlap_window(edges: DataFrame, videos: DataFrame, basis: str = "comment") -> DataFrame:
    """Latest start to earliest end over the corpora; nulls when they do not meet."""
    if basis == "none":
        return edges.sparkSession.sql("SELECT CAST(NULL AS timestamp) AS start, CAST(NULL AS timestamp) AS end")
    if basis == "video":
        dated = videos.select("corpus", F.col("published_at").alias("at"))
    else:
        dated = edges.filter(F.col("role") != "uploader").select("corpus", F.col("event_at").alias("at"))
    spans = dated.filter(F.col("at").isNotNull()).groupBy("corpus").agg(F.min("at").alias("a"), F.max("at").alias("z"))
    both = spans.agg(F.max("a").alias("a"), F.min("z").alias("z"))
    meets = F.col("a") <= F.col("z")
    return both.select(F.when(meets, F.col("a")).alias("start"), F.when(meets, F.col("z")).alias("end"))


def cap_to_window(edges: DataFrame, videos: DataFrame, basis: str = "comment") -> tuple[DataFrame, DataFrame]:
    """(edges, videos) inside the overlap window; unchanged when there is none."""
    if basis == "none":
        return edges, videos
    w = overlap_window(edges, videos, basis).agg(F.struct(F.max("start").alias("a"), F.max("end").alias("z")).alias("s")).scalar()

    def inside(c: str) -> Column:
        return F.coalesce(F.col(c).between(w["a"], w["z"]), F.lit(False)) | w["a"].isNull()

    if basis == "video":
        kept = videos.filter(inside("published_at"))
        return edges.join(kept.select("corpus", "video_id"), ["corpus", "video_id"], "left_semi"), kept
    talk = edges.filter((F.col("role") != "uploader") & inside("event_at"))
    uploads = edges.filter(F.col("role") == "uploader")
    alive = talk.select("corpus", "video_id").distinct().withColumn("alive", F.lit(True))
    kept = uploads.join(alive, ["corpus", "video_id"], "left").filter(F.col("alive") | inside("event_at")).drop("alive")
    return talk.unionByName(kept), videos


def role_sets(edges: DataFrame, *extra: str) -> DataFrame:
    """Distinct (corpus, role, channel_id), with role 'all' beside the three roles."""
    cols = ["corpus", *extra, "channel_id"]
    single = edges.filter(filled("channel_id")).select(*cols, "role").distinct()
    return single.unionByName(single.select(*cols).distinct().withColumn("role", F.lit("all")))


def _corpus_pairs(df: DataFrame) -> DataFrame:
    """All label pairs a < b from the handful of corpus labels."""
    labels = df.agg(F.array_sort(F.collect_set("corpus")).alias("l"))
    return labels.select(F.posexplode("l").alias("i", "corpus_a"), "l").select(
        "corpus_a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("corpus_b")
    )


def pairwise_overlap(edges: DataFrame) -> DataFrame:
    """Channel counts, overlap and Jaccard per corpus pair and role; zero rows kept."""
    sets = role_sets(edges)
    sizes = sets.groupBy("corpus", "role").agg(F.count("*").alias("n"))
    x, y = sets.alias("x"), sets.alias("y")
    shared = (
        x.join(y, (F.col("x.role") == F.col("y.role")) & (F.col("x.channel_id") == F.col("y.channel_id")) & (F.col("x.corpus") < F.col("y.corpus")))
        .groupBy(F.col("x.corpus").alias("corpus_a"), F.col("y.corpus").alias("corpus_b"), F.col("x.role").alias("role"))
        .agg(F.count("*").alias("k"))
    )
    grid = _corpus_pairs(edges).withColumn("role", F.explode(F.array(*[F.lit(r) for r in ("all", *ROLES)])))
    out = (
        grid.join(shared, ["corpus_a", "corpus_b", "role"], "left")
        .join(sizes.select(F.col("corpus").alias("corpus_a"), "role", F.col("n").alias("na")), ["corpus_a", "role"], "left")
        .join(sizes.select(F.col("corpus").alias("corpus_b"), "role", F.col("n").alias("nb")), ["corpus_b", "role"], "left")
    )
    k, na, nb = (F.coalesce(c, F.lit(0)) for c in ("k", "na", "nb"))
    return out.select(
        "corpus_a", "corpus_b", "role", na.alias("a_count"), nb.alias("b_count"), k.alias("overlap_count"),
        F.coalesce(ratio(k, na + nb - k), F.lit(0.0)).alias("jaccard"),
    )


def channel_labels(edges: DataFrame) -> DataFrame:
    return edges.filter(filled("channel_id")).select("channel_id", F.col("corpus").alias("source")).distinct()


def interaction_matrix(edges: DataFrame) -> DataFrame:
    """Weight from source corpus to target corpus by role and in total, long form.

    Edges are pre-aggregated per channel, so a hot channel joins as few rows.
    """
    per_channel = edges.filter(filled("channel_id")).groupBy("channel_id", F.col("corpus").alias("target"), "role").agg(F.count("*").alias("w"))
    by_role = per_channel.join(channel_labels(edges), "channel_id").groupBy("source", "target", "role").agg(F.sum("w").alias("weight"))
    total = by_role.groupBy("source", "target").agg(F.sum("weight").alias("weight")).withColumn("role", F.lit("all"))
    return by_role.unionByName(total)


def interaction_matrix_wide(matrix: DataFrame, labels: list[str], role: str = "all") -> DataFrame:
    """Source rows by target columns for one role."""
    return matrix.filter(F.col("role") == role).groupBy("source").pivot("target", labels).agg(F.sum("weight")).fillna(0)


def cross_share(matrix: DataFrame) -> DataFrame:
    """Outgoing weight, cross-corpus weight and share per corpus and role."""
    out = matrix.groupBy("source", "role").agg(
        F.sum("weight").alias("out_total"), F.coalesce(F.sum(F.when(F.col("source") != F.col("target"), F.col("weight"))), F.lit(0)).alias("out_cross")
    )
    return out.withColumn("cross_share", F.coalesce(ratio("out_cross", "out_total"), F.lit(0.0)))


def cross_channels(edges: DataFrame) -> DataFrame:
    """Distinct channels of a corpus active in another one, by role and overall."""
    moves = role_sets(edges).withColumnRenamed("corpus", "target").join(channel_labels(edges), "channel_id").filter("source <> target")
    return moves.groupBy("source", "role").agg(F.countDistinct("channel_id").alias("channels"))


def edges_per_video(edges: DataFrame, videos: DataFrame) -> DataFrame:
    """Mean and median edges per video of each corpus, videos without edges included."""
    n = edges.filter(filled("channel_id")).groupBy("corpus", "video_id").agg(F.count("*").alias("n"))
    per_video = videos.select("corpus", "video_id").join(n, ["corpus", "video_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = per_video.groupBy("corpus").agg(F.avg("n").alias("mean"), F.count("*").alias("n_videos"))
    return with_percentiles(base, per_video, ["corpus"], {"median": (F.col("n"), 0.5)})


def corpus_summary(edges: DataFrame, videos: DataFrame, basis: str = "comment") -> DataFrame:
    """Videos and channels per corpus inside the window, with its bounds and length."""
    e, v = cap_to_window(edges, videos, basis)
    w = overlap_window(edges, videos, basis).agg(F.struct(F.max("start").alias("a"), F.max("end").alias("z")).alias("s")).scalar()
    nv = v.groupBy("corpus").agg(F.count("*").alias("n_videos"))
    nc = e.filter(filled("channel_id")).groupBy("corpus").agg(F.countDistinct("channel_id").alias("n_channels"))
    return nv.join(nc, "corpus", "full").select(
        "corpus", F.coalesce("n_videos", F.lit(0)).alias("n_videos"), F.coalesce("n_channels", F.lit(0)).alias("n_channels"),
        F.lit(basis).alias("basis"), w["a"].alias("start"), w["z"].alias("end"),
        F.floor((F.unix_seconds(w["z"]) - F.unix_seconds(w["a"])) / 86400).alias("days"),
    )


def overlap_graph(edges: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of channels and videos with corpora, roles and degree."""
    e = edges.filter(filled("channel_id"))
    linked = e.join(videos.select("video_id").distinct(), "video_id", "left_semi")
    channels = e.groupBy(F.col("channel_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set("corpus")), ",").alias("corpora"),
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"),
        F.countDistinct("corpus").alias("corpus_count"),
    ).withColumn("node_type", F.lit("channel"))
    vids = videos.groupBy(F.col("video_id").alias("id")).agg(F.min("corpus").alias("corpora")).select(
        "id", "corpora", F.lit("").alias("roles"), F.lit(1).alias("corpus_count"), F.lit("video").alias("node_type")
    )
    ends = linked.select(F.explode(F.array(
        F.struct(F.lit("channel").alias("node_type"), F.col("channel_id").alias("id")),
        F.struct(F.lit("video").alias("node_type"), F.col("video_id").alias("id")),
    )).alias("n")).groupBy("n.node_type", "n.id").agg(F.count("*").alias("degree_est"))
    nodes = channels.unionByName(vids).join(ends, ["node_type", "id"], "left").select(
        "id", "node_type", "corpora", "roles", "corpus_count", (F.col("corpus_count") >= 2).alias("in_multiple"), F.coalesce("degree_est", F.lit(0)).alias("degree_est")
    )
    return nodes, linked


def jaccard_over_time(edges: DataFrame, period: str = "year") -> DataFrame:
    """X11: per period, corpus pair and role the shared, exclusive and joint channel counts.

    Each channel has a short sorted list of its corpora; channels are counted by
    list, and all figures follow from the few different lists.
    """
    dated = edges.filter(F.col("event_at").isNotNull()).withColumn("period", F.date_trunc(period, "event_at"))
    lists = role_sets(dated, "period").groupBy("period", "role", "channel_id").agg(F.array_sort(F.collect_set("corpus")).alias("c"))
    combos = lists.groupBy("period", "role", "c").agg(F.count("*").alias("n"))
    sizes = combos.select("period", "role", F.explode("c").alias("corpus"), "n").groupBy("corpus", "period", "role").agg(F.sum("n").alias("n"))
    firsts = combos.select("period", "role", "n", "c", F.posexplode("c").alias("i", "corpus_a"))
    shared = (
        firsts.select("period", "role", "n", "corpus_a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("corpus_b"))
        .groupBy("corpus_a", "corpus_b", "period", "role").agg(F.sum("n").alias("k"))
    )
    pairs = _corpus_pairs(edges)
    seen = sizes.select("period", "role", "corpus")
    grid = (
        pairs.join(seen.withColumnRenamed("corpus", "corpus_a"), "corpus_a")
        .unionByName(pairs.join(seen.withColumnRenamed("corpus", "corpus_b"), "corpus_b"))
        .distinct()
    )
    out = (
        grid.join(shared, ["corpus_a", "corpus_b", "period", "role"], "left")
        .join(sizes.select(F.col("corpus").alias("corpus_a"), "period", "role", F.col("n").alias("na")), ["corpus_a", "period", "role"], "left")
        .join(sizes.select(F.col("corpus").alias("corpus_b"), "period", "role", F.col("n").alias("nb")), ["corpus_b", "period", "role"], "left")
    )
    k, na, nb = (F.coalesce(c, F.lit(0)) for c in ("k", "na", "nb"))
    return out.select(
        "corpus_a", "corpus_b", F.to_date("period").alias("period"), "role", k.alias("both"), (na - k).alias("a_only"), (nb - k).alias("b_only"),
        ratio(k, na + nb - k).alias("jaccard"),
    )


def jaccard_members(edges: DataFrame, corpus_a: str, corpus_b: str, period: str = "year") -> DataFrame:
    """X11: the channels behind one pair: (period, role, channel_id, part) with part both, a_only or b_only."""
    dated = edges.filter(F.col("event_at").isNotNull() & F.col("corpus").isin(corpus_a, corpus_b)).withColumn("period", F.to_date(F.date_trunc(period, "event_at")))
    sides = role_sets(dated, "period").groupBy("period", "role", "channel_id").agg(
        F.max(F.col("corpus") == corpus_a).alias("a"), F.max(F.col("corpus") == corpus_b).alias("b")
    )
    part = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "a_only").otherwise("b_only")
    return sides.select("period", "role", "channel_id", part.alias("part"))


def cross_bundle(edges: DataFrame, videos: DataFrame) -> dict[str, DataFrame]:
    """Matrices, shares, channel counts and edges per video."""
    matrix = interaction_matrix(edges)
    return {
        "matrix": matrix,
        "cross_share": cross_share(matrix),
        "cross_channels": cross_channels(edges),
        "edges_per_video": edges_per_video(edges, videos),
    }
