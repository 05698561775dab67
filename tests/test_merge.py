"""Streams merged into keyed tables."""

import json

from pyspark.sql import functions as F

from threadloom.operators import longitudinal
from threadloom.sources import reel_tables
from threadloom.sources.discussions import LINE, merge_corpora, read_lines
from threadloom.streaming import merge

SEEN = "crawl_id string, reel_pk string, asset_id string, seen_at long, play_count long"


def test_seen_rows_streamed_equal_the_batch_and_replays_change_nothing(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    rows = []
    for f in range(5):
        part = [{"crawl_id": f"c{k % 2}", "reel_pk": f"r{(k * 7 + f) % 11}", "asset_id": "a", "seen_at": 10 * f + k, "play_count": f} for k in range(9)]
        rows += part
        (src / f"{f}.json").write_text("\n".join(map(json.dumps, part)))
    stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 2).json(str(src))
    q = merge.seen_merge(stream, table, str(tmp_path / "cp"), F.col("seen_at")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in merge.table_rows(spark, table, SEEN).collect()}
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SEEN)
    empty = frame.limit(0)
    want = {tuple(r) for r in longitudinal.upsert(empty, frame, order=[F.desc("seen_at")]).select("crawl_id", "reel_pk", "asset_id", "seen_at", "play_count").collect()}
    assert got == want
    other = spark.createDataFrame([("c0", "r0", "a", 999, 999)], SEEN)
    assert merge.merge_batch(other, 1, table, longitudinal.SEEN_KEY, newest=F.col("seen_at")) is False
    assert {tuple(r) for r in merge.table_rows(spark, table, SEEN).collect()} == want
    assert merge.merge_batch(other, 99, table, longitudinal.SEEN_KEY, newest=F.col("seen_at")) is True
    assert ("c0", "r0", "a", 999, 999) in {tuple(r) for r in merge.table_rows(spark, table, SEEN).collect()}


def test_a_batch_that_failed_before_its_commit_is_merged_anew(spark, tmp_path, monkeypatch):
    table, schema = str(tmp_path / "t"), "k long, v string"
    one, two = spark.createDataFrame([(k, "a") for k in range(20)], schema), spark.createDataFrame([(k, "b") for k in range(10, 30)], schema)
    merge.merge_batch(one, 0, table, ["k"], buckets=4)
    real = merge.table_rows
    # the data of batch 1 is written, its commit is not
    out = merge.merged(real(spark, table, schema), two.limit(5), ["k"]).withColumn("bucket", F.lit(0))
    out.write.partitionBy("bucket").parquet(f"{table}/data/batch=1")
    assert {r.v for r in real(spark, table, schema).collect()} == {"a"}
    merge.merge_batch(two, 1, table, ["k"], buckets=4)
    assert {(r.k, r.v) for r in real(spark, table, schema).collect()} == {(k, "a" if k < 10 else "b") for k in range(30)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table, schema = str(tmp_path / "t"), "k long, v string"
    merge.merge_batch(spark.createDataFrame([(k, "a") for k in range(200)], schema), 0, table, ["k"], buckets=16)
    merge.merge_batch(spark.createDataFrame([(7, "b")], schema), 1, table, ["k"], buckets=16)
    assert len(list((tmp_path / "t" / "data" / "batch=0").glob("bucket=*"))) == 16
    assert len(list((tmp_path / "t" / "data" / "batch=1").glob("bucket=*"))) == 1
    merge.merge_batch(spark.createDataFrame([(None, "c")], schema), 2, table, ["k"], buckets=16)
    assert merge.table_rows(spark, table, schema).count() == 200
    assert merge.table_rows(spark, table, schema).filter("v = 'b'").count() == 1


def test_index_rows_sources_and_videos(spark, tmp_path):
    index = "reel_pk string, asset_id string, seen_at long"
    old = spark.createDataFrame([("r1", "a", 1)], index)
    found = spark.createDataFrame([("r1", "a", 2), ("r2", "a", 2)], index)
    merge.merge_batch(old, 0, str(tmp_path / "i"), ["reel_pk", "asset_id"], keep="old")
    merge.merge_batch(found, 1, str(tmp_path / "i"), ["reel_pk", "asset_id"], keep="old")
    want = old.unionByName(reel_tables.new_index_rows(old, found))
    assert {tuple(r) for r in merge.table_rows(spark, str(tmp_path / "i"), index).collect()} == {tuple(r) for r in want.collect()}
    notes = "reel_pk string, category string, source string"
    stored = spark.createDataFrame([("r1", "x", "vision"), ("r2", "y", "vision"), ("r1", "z", "manual")], notes)
    fresh = spark.createDataFrame([("r3", "q", "vision"), ("r3", "p", "vision")], notes)
    merge.merge_batch(stored, 0, str(tmp_path / "n"), ["source"], keep="all")
    merge.merge_batch(fresh, 1, str(tmp_path / "n"), ["source"], keep="all")
    want = reel_tables.replace_source(stored, fresh.drop("source"), "vision")
    assert {tuple(r) for r in merge.table_rows(spark, str(tmp_path / "n"), notes).collect()} == {tuple(r) for r in want.collect()}


def test_videos_streamed_equal_the_upsert(spark, tmp_path):
    src = tmp_path / "v"
    src.mkdir()
    entry = lambda v, title, at: {"video_id": v, "video_info": {"title": title, "download_time": at} if title else None, "comments": []}
    (src / "a.json").write_text("\n".join(map(json.dumps, [entry("v1", "one", "2024-01-01"), entry("v2", "two", "2024-01-01")])))
    (src / "b.json").write_text("\n".join(map(json.dumps, [entry("v1", "new one", "2024-02-01"), entry("v2", None, None), entry("v3", "three", "2024-02-01")])))
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(str(src))
    merge.video_merge(stream, str(tmp_path / "t"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LINE.fields)
    got = {(r.video_id, r.video_info.title) for r in merge.table_rows(spark, str(tmp_path / "t"), schema).collect()}
    one, two = read_lines(spark, str(src / "a.json")), read_lines(spark, str(src / "b.json")).filter("video_info IS NOT NULL")
    assert got == {(r.video_id, r.video_info.title) for r in merge_corpora([one, two]).collect()} == {("v1", "new one"), ("v2", "two"), ("v3", "three")}
