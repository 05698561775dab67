"""Queries over the tables of the report, overlap and network bundles; their twins are those of the single operators."""

from pyspark.sql import functions as F

from ..operators import classify, graph, overlap, talk
from ..sources import adapters as a
from . import classify_queries as c, graph_queries as g, overlap_queries as o, talk_queries as k
from .registry import ORACLE, query


def report(t, table):
    """The report over captions, with the tags of orders for the network and events as crawls."""
    runs, seen = a.crawl_rows(t.events)
    base = c.classified(t).join(k.tagged_captions(t).select("reel_pk", "hashtags"), "reel_pk")
    words = t.documents.select(F.col("doc_id").alias("reel_pk"), F.explode(F.array_distinct(talk.tx.find_all(F.lower("text"), r"(\w+ing)\b", 1))).alias("hashtag"))
    return classify.report_tables(
        base, c.RULES, words, music_terms=k.MUSIC, visual_terms=k.VISUAL, contexts=c.CTX, runs=runs, seen=seen, only=[table],
    )[table]


REPORT = {
    "audio_filter_by_song": ("audio_filter_summary_song", None), "audio_filter_by_asset": ("audio_filter_summary_asset", None), "caption_style_summary": ("caption_style_classified", None),
    "close_reading_sample": ("close_reading_sample", ["reel_pk", "song_id", "sample_reason"]), "snapshot_status": ("snapshot_status", None), "snapshot_churn": ("churn_by_asset", None), "snapshot_churn_intervals": ("churn_intervals", None),
    "robustness_unknown_format_hashtags": ("unknown_hashtags", None), "robustness_validation_sample_context": ("validation_sample", ["reel_pk", "validation_category", "validation_dimension"]),
}
for _table, (_twin, _columns) in REPORT.items():
    @query(f"report_{_table}", ORACLE[_twin])
    def _(t, table=_table, columns=_columns):
        df = report(t, table)
        return df.select(*columns) if columns else df


@query("report_close_reading_curated", ORACLE["curated_sample"])
def _(t):
    base = c.classified(t)
    tags = t.documents.select(F.col("doc_id").alias("reel_pk"), F.col("lang").alias("hashtag"))
    found = classify.report_tables(base, c.RULES, tags, music_terms=["tion"], visual_contexts=["home", "nature"], slots=c.SLOTS, only=["close_reading_curated"])
    return found["close_reading_curated"].select("reel_pk", "sample_reason")


for _part in ("nodes", "edges"):
    @query(f"network_bundle_{_part}", ORACLE[f"hashtag_network_{_part}"])
    def _(t, part=_part):
        return graph.network_bundle(g.tags(t), g.tag_rules(t))[part]


@query("network_bundle_clusters", ORACLE["hashtag_clusters"])
def _(t):
    return graph.network_bundle(g.tags(t), g.tag_rules(t), cluster_jaccard=0.18)["clusters"]


CROSS = {"matrix": "interaction_matrix", "cross_share": "cross_share", "cross_channels": "cross_channels", "edges_per_video": "edges_per_video"}
for _table, _twin in CROSS.items():
    @query(f"cross_bundle_{_table}", ORACLE[_twin])
    def _(t, table=_table):
        return overlap.cross_bundle(*o.edges_videos(t))[table]


@query("overlap_graph_edges", f"{o.X} SELECT channel_id, video_id, role, 1::BIGINT AS weight, corpus, comment_id, reply_id, strftime(event_at,{o.TS}) AS event_at FROM te WHERE channel_id<>'' AND video_id IN (SELECT video_id FROM videos)")
def _(t):
    return overlap.overlap_graph(*o.edges_videos(t))[1]


# tags of page titles: words after a mark, with noise prefixes and stop words among them
PAGE_TAGS = r"""pt AS (SELECT DISTINCT page_id AS reel_pk, regexp_replace(lower(trim(w)), '\s+', '', 'g') AS hashtag FROM
 (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[A-Za-z]{4,}')) AS w FROM pages)),
reel_hashtags AS (SELECT * FROM pt WHERE hashtag NOT IN ('this','that','with','from') AND NOT starts_with(hashtag, 'th') AND NOT starts_with(hashtag, 'viral'))"""


@query("noisy_tag_counts", f"WITH {PAGE_TAGS} SELECT hashtag, count(*) AS count FROM reel_hashtags GROUP BY 1 HAVING count(*)>=5")
def _(t):
    text = F.regexp_replace("html", "<[^>]*>", " ")
    words = t.pages.select(F.col("page_id").alias("reel_pk"), F.explode(talk.tx.find_all(text, "([A-Za-z]{4,})", 1)).alias("hashtag"))
    clean = graph.clean_tags(words, stop=("this", "that", "with", "from"), noise_prefixes=("th", "viral"))
    return graph.tag_network(clean)[0].select("hashtag", "count")
