import json

from threadloom.sources.discussions import comments, read_lines
from threadloom.streaming.activity import comment_stream, daily_counts


def test_daily_counts_equal_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    days = ["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-04"]
    for i, d in enumerate(days):
        line = {"video_id": f"v{i}", "comments": [{"youtube_comment_id": f"k{i}", "date": f"{d}T10:00:00Z"}]}
        (src / f"{i}.json").write_text(json.dumps(line) + "\n")
    (src / "again.json").write_text(json.dumps({"video_id": "v0", "comments": [{"youtube_comment_id": "k0", "date": "2024-01-01T10:00:00Z"}]}) + "\n")
    q = daily_counts(comment_stream(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {str(r.day): r.comments for r in spark.table("daily").collect()}
    finally:
        q.stop()
    batch = comments(read_lines(spark, str(src))).dropDuplicates(["comment_id"])
    want = {str(r.d): r["count"] for r in batch.selectExpr("to_date(date) AS d").groupBy("d").count().collect()}
    assert got == want
