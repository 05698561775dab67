"""Time the headline queries: one JSON line with seconds per query."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from threadloom.plans import load_all
from threadloom.plans.registry import QUERIES
from threadloom.session import local_session

HEADLINE = [
    "channel_occurrence_stats", "corpus_counts", "interaction_density", "comments_per_day", "participation_timeline", "timeline_hashtags_month",
    "impact_by_hashtags", "song_summary", "word_frequencies", "bigram_frequencies", "caption_terms", "distinctive_caption_terms", "social_markers_pages",
    "language_mismatches", "classified_reels", "combination_summary", "impact_by_theme", "creator_summary", "reply_network", "interaction_graph",
    "frequent_channel_pairs", "hashtag_network_edges", "pairwise_overlap", "jaccard_over_years", "churn_by_asset", "sample_by_song", "concordance_by_dimension",
    "variant_pairs", "segment_usage", "edit_clusters", "detected_languages", "keyword_snippets", "spam_report_kpis", "explorer_records",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    load_all()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "threadloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # warm up: start the workers and compile a scan and a shuffle once
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
