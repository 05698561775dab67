"""Micro-fixtures with answers worked out by hand."""

import json

from pyspark.sql import functions as F

from threadloom.functions.columns import parse_timestamp
from threadloom.operators import explore, graph, longitudinal, media, quality, scope, talk
from threadloom.sources import discussions, sinks

CORPUS = {
    "v1": {
        "video_info": {"title": "One", "published_at": "2024-01-01T00:00:00Z", "channel_id": "c1", "views": 100, "description": "about cats"},
        "comments": [
            {"youtube_comment_id": "k1", "text": "Hello #Tag #tag @bob", "date": "2024-01-02T10:00:00Z", "likes": 3, "author_channel_id": "a", "language": "en", "vader_sentiment": 0.5,
             "replies": [{"youtube_reply_id": "r1", "youtube_parent_id": "k1", "text": "cats", "date": "2024-01-03T10:00:00Z", "likes": 0, "author_channel_id": "a", "language": "de"},
                         {"youtube_reply_id": "r2", "youtube_parent_id": "k1", "text": "no", "date": "bad", "likes": 1, "author_channel_id": "b", "language": "de"}]},
            {"youtube_comment_id": "k2", "text": "see www.site.org/x", "date": "2024-01-02T11:00:00.123", "likes": 0, "author_channel_id": "", "language": "en", "vader_sentiment": "N/A", "replies": []},
        ],
    },
    "v2": {"video_info": {"title": "Two", "channel_id": "c2"}, "comments": []},
}


def corpus(spark, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(CORPUS), encoding="utf-8")
    return discussions.read_corpus(spark, str(path))


def test_corpus_round_trip(spark, tmp_path):
    nested = corpus(spark, tmp_path)
    v, c, r = discussions.videos(nested), discussions.comments(nested), discussions.replies(nested)
    assert [x.comment_id for x in c.orderBy("pos").collect()] == ["k1", "k2"]
    assert [x.sentiment for x in c.orderBy("pos").collect()] == [0.5, None]
    assert {x.reply_id: x.date is None for x in r.collect()} == {"r1": False, "r2": True}
    counts = scope.corpus_counts(v, c, r).first()
    assert (counts.total_videos, counts.total_comments, counts.total_replies, counts.videos_without_comments) == (2, 2, 2, 1)
    assert counts.comments_per_video_median == 1.0 and counts.replies_per_comment_median == 1.0
    rows = discussions.export_rows(nested)
    assert len(rows.columns) == 27 and rows.count() == 4
    lines = tmp_path / "lines"
    nested.write.json(str(lines))
    assert discussions.read_lines(spark, str(lines)).count() == 2
    density = scope.interaction_density(v, c, r).collect()
    assert [round(x.interaction_density_score, 4) for x in density] == [round(0.4 * 1 + 0.4 * 0.5 + 0.2 * 0.02, 4)]


def test_threads_networks_and_markers(spark, tmp_path):
    nested = corpus(spark, tmp_path)
    v, c, r = discussions.videos(nested), discussions.comments(nested), discussions.replies(nested)
    assert [(x.src, x.dst, x.weight) for x in graph.reply_network(c, r).collect()] == [("b", "a", 1)]
    assert graph.reply_network(c, r, include_self=True).count() == 2
    kept_v, kept_c, kept_r = explore.filter_threads(v, c, r, ["CATS"])
    assert [x.video_id for x in kept_v.collect()] == ["v1"] and [x.comment_id for x in kept_c.collect()] == ["k1"] and kept_r.count() == 1
    found = {(x.kind, x.value) for x in talk.social_markers(c).collect()}
    assert found == {("hashtags", "tag"), ("mentions", "bob"), ("links", "www.site.org/x"), ("domains", "site.org")}
    mismatch = {(x.kind, x.pair): x["count"] for x in talk.language_mismatches(c, r).collect()}
    assert mismatch == {("reply_vs_comment", "en > de"): 1}


def test_parse_timestamp(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00.5",), ("nope",)], "s string")
    got = [x[0] for x in df.select(F.date_format(parse_timestamp("s"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-01-01 00:00"] * 3 + [None]


def test_histogram_leaves_lowest_edge_out(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 2, 4, 5)], "likes int")
    got = {r.bin: r["count"] for r in scope.right_closed_histogram(df, "likes", bins=4).collect()}
    assert got == {1: 1, 3: 1, 4: 1}


def test_duplicates_keep_richest(spark):
    c = spark.createDataFrame([("v", "k", 0, "short"), ("v", "k", 1, "a much longer text"), ("w", "z", 0, "x")], "video_id string, comment_id string, pos int, text string")
    r = spark.createDataFrame([], "video_id string, comment_pos int, pos int, reply_id string, text string")
    marked, _ = quality.purge_duplicates(c, r, ["comment_id", "text"], ["reply_id", "text"])
    assert {(x.video_id, x.pos): x.kept for x in marked.collect()} == {("v", 0): False, ("v", 1): True, ("w", 0): True}


def test_soft_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], [("a", 0.5), ("c", 0.4)]), ([], []), (["a"], [])], "k array<string>, v array<struct<category:string,confidence:double>>")
    got = [r.s for r in df.select(longitudinal.pair_concordance(F.col("k"), F.col("v"), {("b", "c"): 0.5}).alias("s")).collect()]
    inter = 0.5 * ((0.5 + 0.2) + (0.5 * 1 + 0.4 * 0.5))
    assert abs(got[0] - inter / (2 + 0.9 - inter)) < 1e-12 and got[1] is None and got[2] == 0.0


def test_churn_balances(spark):
    runs = spark.createDataFrame([("1", 1, "refresh", "done"), ("2", 2, "refresh", "failed"), ("3", 3, "refresh", "done"), ("4", 4, "snapshot", "done")], "crawl_id string, started_at int, mode string, status string")
    seen = spark.createDataFrame([("1", "r1", "a", "s"), ("1", "r2", "a", "s"), ("3", "r2", "a", None), ("3", "r3", "b", "t")], "crawl_id string, reel_pk string, asset_id string, song_id string")
    got = {r.asset_id: (r.song_id, r.n_from, r.n_to, r.retained, r.new, r.lost, r.retention_rate, r.new_rate) for r in longitudinal.churn(runs, seen).collect()}
    assert got == {"a": ("s", 2, 1, 1, 0, 1, 0.5, 0.0), "b": ("t", 0, 1, 0, 1, 0, None, 1.0)}


def test_cut_pattern_clusters(spark):
    e = spark.createDataFrame([("r1", "a", [1.0, 2.0]), ("r2", "a", [1.1, 2.1]), ("r3", "a", [9.0]), ("r4", "a", []), ("r5", "a", [1.0]), ("r6", "b", [4.0]), ("r7", "b", [4.0])], "reel_pk string, asset_id string, cut_times_aligned array<double>")
    al = spark.createDataFrame([(f"r{i}", 0.0 if i != 5 else None, 0) for i in range(1, 8)], "reel_pk string, used_segment_start double, has_overlay int")
    got = {r.reel_pk: r.edit_cluster for r in media.cluster_edits(e, al).collect()}
    assert got == {"r1": 0, "r2": 0, "r3": -1, "r4": None, "r5": None, "r6": 0, "r7": 0}


def test_refrain(spark):
    lines = ["intro words here", "we sing the same old song", "all night long my friend", "verse about something else", "we sing the same old song", "all night long my friends", "outro"]
    rows = [("a", i, x, i * 1000.0, len(x.split())) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "asset_id string, i int, text string, start_ms double, words int")
    assert [(r.start_s, r.lines) for r in media.refrain_starts(df).orderBy("occurrence").collect()] == [(1.0, 2), (4.0, 2)]


def test_peaks(spark):
    n = [0, 1, 9, 1, 0, 0, 5, 5, 0, 0]
    df = spark.createDataFrame([("s", f"2024-01-{i + 1:02d}", v) for i, v in enumerate(n)], "song_id string, period string, n int").withColumn("period", F.col("period").cast("date"))
    rows = media.detect_peaks(df).orderBy("period").collect()
    assert [i for i, r in enumerate(rows) if r.is_peak] == [2, 6]
    assert [i for i, r in enumerate(rows) if r.is_onset] == [1] and [i for i, r in enumerate(rows) if r.is_main_peak] == [2]


def test_where_and_snippets(spark):
    df = spark.createDataFrame([("1", "10", "a b  x a b"), ("2", "abc", None), ("3", None, "none")], "reel_pk string, f string, t string")
    assert [r.reel_pk for r in explore.where(df, "f", ">", "9").collect()] == ["1", "2"]
    assert [r.reel_pk for r in explore.where(df, "f", "!=", "10").collect()] == ["2", "3"]
    got = [(r.n, r.position, r.snippet) for r in explore.snippets(df, "reel_pk", ["A B"], "t", 2).orderBy("n").collect()]
    assert got == [(0, 0, "...a b x..."), (1, 6, "...x a b...")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a", "b"], None)], "reel_pk string, tags array<string>, n string")
    out = str(tmp_path / "rows.csv")
    sinks.write_csv(df, out)
    back = sinks.read_records(spark, out, spark.createDataFrame([], "reel_pk string, tags string, n string").schema).collect()
    assert [(r.reel_pk, r.tags) for r in back] == [("1", "a; b")]
    listed = tmp_path / "view.json"
    listed.write_text(json.dumps({"items": [{"reel_pk": "7"}, {"reel_pk": "8"}]}))
    assert sinks.read_records(spark, str(listed), spark.createDataFrame([], "reel_pk string").schema).count() == 2


def test_large_video_and_many_channels_are_kept(spark):
    """No default cuts videos of many participants, channels, neighbours or edges."""
    rows = [(f"c{i:04d}", v, "commenter") for v in ("v1", "v2") for i in range(250)]
    rows += [(f"d{i:04d}", f"w{i // 2}-{k}", "commenter") for i in range(1100) for k in range(2)]
    edges = spark.createDataFrame(rows, "channel_id string, video_id string, role string")
    got = graph.interaction_graph(edges).cache()
    assert got.count() == 250 * 249 // 2 + 550 and graph.node_degrees(got).count() == 1350
    assert graph.frequent_pairs(edges, threshold=2).count() == 250 * 249 // 2 + 550
    thinned = graph.interaction_graph(edges, top_k_per_node=3, max_participants_per_video=200)
    assert thinned.count() == 550
    communities, _ = graph.pair_communities(graph.frequent_pairs(edges.filter("channel_id < 'c0060' or channel_id > 'd'"), threshold=2))
    assert communities.filter("converged").count() == 60 + 1100


def test_json_export_with_metadata(spark, tmp_path):
    records = spark.createDataFrame([("1", ["a"]), ("2", ["b"]), ("3", [])], "reel_pk string, tags array<string>")
    view = spark.createDataFrame([("3",), ("1",), ("1",), ("9",)], "reel_pk string")
    out = str(tmp_path / "view")
    assert sinks.export_view(records, view, out, metadata={"title": "é"}).count() == 2
    said = json.loads(spark.read.text(f"{out}/metadata").first()[0])
    assert said == {"key": "reel_pk", "title": "é", "row_count": 2, "columns": ["reel_pk", "tags"]}
    assert {r["reel_pk"] for r in spark.read.json(f"{out}/items").collect()} == {"1", "3"}
    sinks.export_view(records, view, str(tmp_path / "flat"), form="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "flat")).count() == 2
