"""Churn between crawls, samples for close reading, agreement between tag sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ratio, scalar, top_n, top_per_group
from ..functions.numbering import number_rows
from ..functions.quantiles import exact_percentiles, with_percentiles
from ..functions.rules import label_of
from ..functions.text import contains_any
from .talk import theme_text


def seeded(key: str = "reel_pk", seed: int = 42) -> Column:
    """Sort key of a reproducible random order: a digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


# churn -----------------------------------------------------------------------

SEEN_KEY = ["crawl_id", "reel_pk", "asset_id"]


def snapshot(reels: DataFrame, crawl_id: str, seen_at: Column) -> DataFrame:
    """H1: current reels as rows of a new crawl, positions in id order."""
    rows = reels.select("reel_pk", "asset_id", "song_id", "play_count", "like_count", "comment_count")
    return number_rows(rows, "reel_pk", name="rank_pos").select(
        F.lit(crawl_id).alias("crawl_id"), "reel_pk", "asset_id", "song_id", seen_at.alias("seen_at"), "rank_pos", "play_count", "like_count", "comment_count"
    )


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str] = tuple(SEEN_KEY), order: Sequence[Column] = ()) -> DataFrame:
    """H2: rows of ``new`` replace rows of ``current`` with the same key; within ``new`` the first in ``order`` wins."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        new = new.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return current.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def churn(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """H3: per asset and pair of consecutive finished refresh runs the kept, new and lost reels."""
    done = runs.filter((F.col("mode") == "refresh") & (F.col("status") == "done"))
    steps = done.select("crawl_id", F.lead("crawl_id").over(Window.orderBy("started_at", "crawl_id")).alias("next")).filter("next is not null")
    rows = seen.filter(F.col("asset_id").isNotNull()).select("crawl_id", "asset_id", "reel_pk", "song_id")
    before = rows.join(steps, "crawl_id").select(F.col("crawl_id").alias("from_crawl"), F.col("next").alias("to_crawl"), "asset_id", "reel_pk", "song_id", F.lit(1).alias("p"), F.lit(0).alias("c"))
    after = rows.join(steps.withColumnRenamed("crawl_id", "from_crawl"), F.col("crawl_id") == F.col("next")).select(
        "from_crawl", F.col("next").alias("to_crawl"), "asset_id", "reel_pk", "song_id", F.lit(0).alias("p"), F.lit(1).alias("c")
    )
    keys = ["from_crawl", "to_crawl", "asset_id"]
    reel = before.unionByName(after).groupBy(*keys, "reel_pk").agg(
        F.max("p").alias("p"), F.max("c").alias("c"),
        F.min(F.when(F.col("c") == 1, F.col("song_id"))).alias("sc"), F.min(F.when(F.col("p") == 1, F.col("song_id"))).alias("sp"),
    )
    out = reel.groupBy(*keys).agg(
        F.coalesce(F.min("sc"), F.min("sp")).alias("song_id"), F.sum("p").alias("n_from"), F.sum("c").alias("n_to"),
        F.sum(F.col("p") * F.col("c")).alias("retained"),
    )
    n_from, n_to, kept = F.col("n_from"), F.col("n_to"), F.col("retained")
    return out.select(*keys, "song_id", "n_from", "n_to", "retained", (n_to - kept).alias("new"), (n_from - kept).alias("lost"), ratio(kept, n_from).alias("retention_rate"), ratio(n_to - kept, n_to).alias("new_rate"))


def crawl_date(c: Column) -> Column:
    return F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))


def churn_intervals(churned: DataFrame) -> DataFrame:
    """H4: pooled and median retention and pooled new rate per interval."""
    keys = ["from_crawl", "to_crawl"]
    base = churned.groupBy(*keys).agg(F.count("*").alias("n_assets"), *[F.sum(c).alias(c) for c in ("n_from", "n_to", "retained", "new", "lost")])
    out = with_percentiles(base, churned, keys, {"retention_median": (F.col("retention_rate"), 0.5)})
    return out.select(
        crawl_date(F.col("from_crawl")).alias("from_date"), crawl_date(F.col("to_crawl")).alias("to_date"), "n_assets",
        ratio("retained", "n_from").alias("retention_pooled"), "retention_median", ratio("new", "n_to").alias("new_rate_pooled"), "retained", "new", "lost",
    )


def churn_headline(intervals: DataFrame) -> DataFrame:
    """The latest interval."""
    return intervals.agg(F.max_by(F.struct(*intervals.columns), "to_date").alias("s")).select("s.*")


def snapshot_status(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """H5: reels, rows, assets and songs per run."""
    facts = seen.groupBy("crawl_id").agg(
        F.countDistinct("reel_pk").alias("n_reels"), F.count("*").alias("n_seen_rows"), F.countDistinct("asset_id").alias("n_assets"), F.countDistinct("song_id").alias("n_songs")
    )
    return runs.join(facts, "crawl_id", "left")


# samples ---------------------------------------------------------------------


def sample_by_song(df: DataFrame, n_top: int = 3, n_median: int = 2, n_random: int = 3, seed: int = 42) -> DataFrame:
    """H6: per song the top reels, the ones nearest to the median and random others."""
    song = F.coalesce("song_id", F.lit("\u0000none"))
    rows = df.select(song.alias("__s"), "reel_pk", F.col("impact_metric").alias("__m"))
    mid = exact_percentiles(rows, ["__s"], {"__mid": (F.col("__m"), 0.5)}).join(rows.groupBy("__s").agg(F.count("*").alias("__n")), "__s")
    top = top_per_group(rows, ["__s"], n_top, F.desc_nulls_last("__m"), F.asc("reel_pk")).select("__s", "reel_pk", F.lit("top_impact").alias("sample_reason"))
    near = rows.join(mid.filter("__n > 2"), "__s").withColumn("__d", F.abs(F.col("__m") - F.col("__mid")))
    near = top_per_group(near, ["__s"], n_median, F.asc_nulls_last("__d"), F.asc("reel_pk")).select("__s", "reel_pk", F.lit("median_impact").alias("sample_reason"))
    near = near.join(top.select("reel_pk"), "reel_pk", "left_anti").select("__s", "reel_pk", "sample_reason")
    picked = top.unionByName(near)
    rest = rows.join(picked.select("reel_pk"), "reel_pk", "left_anti").withColumn("__h", seeded(seed=seed))
    rand = top_per_group(rest, ["__s"], n_random, F.asc("__h")).select("__s", "reel_pk", F.lit("random").alias("sample_reason"))
    return df.join(picked.unionByName(rand).drop("__s"), "reel_pk")


def sample_by_context(df: DataFrame, contexts: Sequence[str], n: int = 5) -> DataFrame:
    """H7: top reels per context; a reel keeps the first context it was picked for."""
    order = F.create_map(*[x for i, c in enumerate(contexts) for x in (F.lit(c), F.lit(i))])
    rows = df.select("reel_pk", "impact_metric", F.explode(F.array_distinct("context_categories")).alias("ctx")).filter(F.col("ctx").isin(*contexts))
    top = top_per_group(rows, ["ctx"], n, F.desc_nulls_last("impact_metric"), F.asc("reel_pk"))
    first = top.groupBy("reel_pk").agg(F.min_by("ctx", order[F.col("ctx")]).alias("ctx"))
    return df.join(first.select("reel_pk", F.concat(F.lit("context:"), "ctx").alias("sample_reason")), "reel_pk")


def close_reading_sample(df: DataFrame, contexts: Sequence[str]) -> DataFrame:
    """H8: song picks, then context picks not among them."""
    a = sample_by_song(df, 2, 1, 1)
    b = sample_by_context(df, contexts, 3)
    return a.unionByName(b.join(a.select("reel_pk"), "reel_pk", "left_anti"))


def curated_sample(df: DataFrame, slots: Sequence[Mapping], music_terms: Sequence[str] = (), visual_contexts: Sequence[str] = (), tags: str | None = "hashtags", seed: int = 42) -> DataFrame:
    """H9: hand-written slots in order; each picks n reels not used by an earlier slot.

    Keywords narrow a slot only when they leave rows. Each slot is one top-n
    query; its at most n ids are all that reaches the driver and are left out of
    the slots after it.
    """
    picks: list[tuple] = []
    text = theme_text(tags=tags)
    for slot in slots:
        sub = df
        mode, n = slot.get("mode", "top"), int(slot.get("n", 3))
        if slot.get("song"):
            sub = sub.filter(F.col("song_id") == slot["song"])
        if mode == "random_visual_no_music":
            visual = F.arrays_overlap("context_categories", F.array(*[F.lit(c) for c in visual_contexts]).cast("array<string>"))
            sub = sub.filter(visual & ~contains_any(text, music_terms))
        else:
            if slot.get("contexts"):
                sub = sub.filter(F.arrays_overlap("context_categories", F.array(*[F.lit(c) for c in slot["contexts"]])))
            if slot.get("keywords"):
                narrowed = sub.filter(contains_any(text, slot["keywords"]))
                if not narrowed.isEmpty():
                    sub = narrowed
        if picks:
            sub = sub.filter(~F.col("reel_pk").isin([p[0] for p in picks]))
        if mode.startswith("random"):
            order = [seeded(seed=seed).asc()]
        elif mode == "median":
            mid = exact_percentiles(sub, [], {"m": (F.col("impact_metric"), 0.5)}).agg(F.max("m")).scalar()
            sub = sub.withColumn("__d", F.abs(F.col("impact_metric") - mid))
            order = [F.asc_nulls_last("__d"), F.asc("reel_pk")]
        else:
            order = [F.desc_nulls_last("impact_metric"), F.asc("reel_pk")]
        picks += [(r["reel_pk"], f"curated:{slot['slot']}") for r in sub.orderBy(*order).limit(n).select("reel_pk").collect()]
    kind = df.schema["reel_pk"].dataType.simpleString()
    return df.join(df.sparkSession.createDataFrame(picks, f"reel_pk {kind}, sample_reason string"), "reel_pk")


def validation_sample(df: DataFrame, dim: str, unknown: str, n: int = 5, seed: int = 42) -> DataFrame:
    """N reproducibly random reels per category of a dimension."""
    rows = df.withColumn("validation_category", F.explode(F.array_distinct(f"{dim}_categories"))).filter(F.col("validation_category") != unknown)
    rows = rows.withColumn("__h", seeded(seed=seed))
    return top_per_group(rows, ["validation_category"], n, F.asc("__h")).withColumn("validation_dimension", F.lit(dim)).drop("__h", "rank")


def annotation_sample(annotations: DataFrame, source: str = "vision", min_confidence: float = 0.0, n: int = 10, seed: int = 42) -> DataFrame:
    """N reproducibly random annotations per dimension and category."""
    rows = annotations.filter((F.col("source") == source) & (F.col("confidence") >= min_confidence)).withColumn("__h", seeded(seed=seed))
    return top_per_group(rows, ["dimension", "category"], n, F.asc("__h")).drop("__h", "rank")


def verdict_precision(verdicts: DataFrame) -> DataFrame:
    """Checked, correct, precision and a weak flag per category beside the overall mean."""
    use = verdicts.filter(F.col("verdict").isNotNull())
    overall = scalar(use, F.round(F.avg("verdict"), 2).alias("m"))["m"]
    return use.groupBy("dimension", "category").agg(F.count("verdict").alias("checked"), F.sum("verdict").alias("correct")).select(
        "*", F.round(F.col("correct") / F.col("checked"), 2).alias("precision"), overall.alias("overall_precision"), (F.round(F.col("correct") / F.col("checked"), 2) < 0.7).alias("weak")
    )


def unknown_hashtags(df: DataFrame, tags: DataFrame, dim: str, unknown: str, n: int = 40) -> DataFrame:
    """Tags of reels without a category."""
    open_ = df.filter(F.array_distinct(f"{dim}_categories") == F.array(F.lit(unknown))).select("reel_pk")
    return top_n(tags.join(open_, "reel_pk", "left_semi").groupBy("hashtag").agg(F.count("*").alias("count")), n, F.desc("count"), F.asc("hashtag"))


def multicategory_reels(df: DataFrame, dim: str, least: int = 3, n: int = 100) -> DataFrame:
    """Reels with many categories in one dimension."""
    out = df.withColumn("n_categories", F.size(F.array_distinct(f"{dim}_categories"))).filter(F.col("n_categories") >= least)
    return top_n(out.withColumn("categories", F.array_join(f"{dim}_categories", ", ")), n, F.desc("n_categories"), F.asc("reel_pk"))


def robustness_tables(df: DataFrame, tags: DataFrame, rules: dict) -> dict[str, DataFrame]:
    """H10, H12 and H13 for every dimension."""
    out = {}
    for d in rules:
        unknown = rules[d]["unknown_id"]
        out[f"unknown_{d}_hashtags"] = unknown_hashtags(df, tags, d, unknown)
        out[f"multicategory_{d}_reels"] = multicategory_reels(df, d)
        out[f"validation_sample_{d}"] = validation_sample(df, d, unknown)
    return out


# agreement -------------------------------------------------------------------


def confidence_scan(annotations: DataFrame, source: str = "vision") -> DataFrame:
    """Highest confidence by reel, dimension and category."""
    return annotations.filter(F.col("source") == source).groupBy("reel_pk", "dimension", "category").agg(F.max("confidence").alias("confidence"))


def _adjacency(adjacency: Mapping[tuple[str, str], float]) -> Column:
    both: dict[str, float] = {}
    for (a, b), w in adjacency.items():
        for k in (f"{a}\t{b}", f"{b}\t{a}"):
            both[k] = max(both.get(k, 0.0), float(w))
    if not both:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[F.lit(x) for kv in both.items() for x in kv])


def pair_concordance(keywords: Column, scored: Column, adjacency: Mapping[tuple[str, str], float] | None = None) -> Column:
    """Soft Jaccard of a category set and an array of (category, confidence); null when both are empty.

    Both sets hold at most the categories of one dimension, so everything stays inside the row.
    """
    near = _adjacency(adjacency or {})

    def s(a: Column, b: Column) -> Column:
        return F.when(a == b, 1.0).otherwise(F.coalesce(F.element_at(near, F.concat_ws("\t", a, b)), F.lit(0.0)))

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)

    from_k = total(F.transform(keywords, lambda k: F.coalesce(F.array_max(F.transform(scored, lambda v: s(k, v["category"]) * v["confidence"])), F.lit(0.0))))
    from_v = total(F.transform(scored, lambda v: v["confidence"] * F.coalesce(F.array_max(F.transform(keywords, lambda k: s(k, v["category"]))), F.lit(0.0))))
    inter = (from_k + from_v) * 0.5
    union = F.size(keywords) + total(F.transform(scored, lambda v: v["confidence"])) - inter
    empty = (F.size(keywords) == 0) & (F.size(scored) == 0)
    return F.when(~empty, F.when(union > 0, inter / union).otherwise(0.0))


def concordance_rows(df: DataFrame, annotations: DataFrame, rules: dict, adjacency: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(reel_pk, dimension, k, v, score) for every reel and dimension."""
    conf = confidence_scan(annotations)
    wide = conf.groupBy("reel_pk").agg(
        *[F.array_sort(F.collect_list(F.when((F.col("dimension") == d) & (F.col("category") != rules[d]["unknown_id"]), F.struct("category", F.col("confidence").cast("double").alias("confidence"))))).alias(f"__{d}") for d in rules]
    )
    joined = df.select("reel_pk", *[f"{d}_keyword" for d in rules]).join(wide, "reel_pk", "left")
    sides = []
    for d in rules:
        k = F.array_except(F.col(f"{d}_keyword"), F.array(F.lit(rules[d]["unknown_id"])))
        v = F.coalesce(F.col(f"__{d}"), F.array().cast("array<struct<category:string,confidence:double>>"))
        sides.append(F.struct(F.lit(d).alias("dimension"), k.alias("k"), v.alias("v")))
    rows = joined.select("reel_pk", F.explode(F.array(*sides)).alias("s")).select("reel_pk", "s.*")
    score = F.lit(None).cast("double")
    for d in rules:
        score = F.when(F.col("dimension") == d, pair_concordance(F.col("k"), F.col("v"), (adjacency or {}).get(d))).otherwise(score)
    return rows.withColumn("score", score)


def concordance_by_dimension(rows: DataFrame) -> DataFrame:
    """Mean and median score, exact and zero shares, unknown counts per dimension."""
    s, k, v = F.col("score"), F.size("k"), F.size("v")
    n = F.count(s)

    def share(cond):
        return F.round(F.coalesce(ratio(F.count_if(cond), n), F.lit(0.0)), 4)

    base = rows.groupBy("dimension").agg(
        n.alias("comparable_reels"), F.round(F.coalesce(F.avg(s), F.lit(0.0)), 4).alias("mean_concordance"),
        share(s >= 0.999).alias("exact_agreement_share"), share(s <= 1e-9).alias("zero_agreement_share"),
        F.count_if((k > 0) & (v == 0)).alias("keyword_only_unknown"), F.count_if((k == 0) & (v > 0)).alias("vision_only_unknown"), F.count_if((k == 0) & (v == 0)).alias("both_unknown"),
    )
    out = with_percentiles(base, rows, ["dimension"], {"m": (s, 0.5)})
    return out.withColumn("median_concordance", F.round(F.coalesce("m", F.lit(0.0)), 4)).drop("m")


def concordance_confusion(rows: DataFrame, rules: dict) -> DataFrame:
    """Reels per keyword and vision category, unknown filling an empty side."""
    unknown = F.create_map(*[F.lit(x) for d in rules for x in (d, rules[d]["unknown_id"])])[F.col("dimension")]
    k = F.when(F.size("k") > 0, F.col("k")).otherwise(F.array(unknown))
    names = F.transform("v", lambda x: x["category"])
    v = F.when(F.size("v") > 0, names).otherwise(F.array(unknown))
    return rows.select("dimension", F.explode(k).alias("keyword_category"), v.alias("v")).select("dimension", "keyword_category", F.explode("v").alias("vision_category")).groupBy(
        "dimension", "keyword_category", "vision_category"
    ).agg(F.count("*").alias("n_reels"))


def concordance_disagreements(rows: DataFrame) -> DataFrame:
    """Per category how often both sources or only one assert it."""
    names = F.transform("v", lambda x: x["category"])
    each = rows.select("dimension", F.col("k"), names.alias("v")).select("dimension", "k", "v", F.explode(F.array_union("k", "v")).alias("category"))
    in_k, in_v = F.array_contains("k", F.col("category")), F.array_contains("v", F.col("category"))
    out = each.groupBy("dimension", "category").agg(
        F.count_if(in_k & in_v).alias("both"), F.count_if(in_k & ~in_v).alias("keyword_only"), F.count_if(~in_k & in_v).alias("vision_only"), F.count("*").alias("n")
    )
    return out.select("dimension", "category", "both", "keyword_only", "vision_only", (F.col("keyword_only") + F.col("vision_only")).alias("divergence"), F.round(F.col("both") / F.col("n"), 4).alias("agreement_rate"))


def tag_averages(annotations: DataFrame, source: str = "vision") -> DataFrame:
    """Tags and mean confidence by dimension and category."""
    return annotations.filter(F.col("source") == source).groupBy("dimension", "category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def map_model_output(outputs: DataFrame, rules: dict, max_per: int = 3) -> DataFrame:
    """(reel_pk, dimension, category, confidence) from raw JSON answers.

    Unknown categories and repeats drop out, confidence is clamped to 0..1, the
    first ``max_per`` valid items of a dimension stay. Each answer is one short
    list, so it is handled inside its row.
    """
    parsed = F.from_json("output", "map<string,array<struct<category:string,confidence:string>>>")
    out = None
    for d in rules:
        known = list(rules[d]["categories"])
        items = F.filter(F.coalesce(F.col("j")[d], F.array().cast("array<struct<category:string,confidence:string>>")), lambda x: x["category"].isin(*known))
        names = F.transform(items, lambda x: x["category"])
        firsts = F.filter(items, lambda x, i: F.array_position(names, x["category"]) == i + 1)
        rows = outputs.select("reel_pk", parsed.alias("j")).select("reel_pk", F.lit(d).alias("dimension"), F.explode(F.slice(firsts, 1, max_per)).alias("e"))
        raw = F.col("e.confidence")
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_cast(raw, "double") if hasattr(F, "try_cast") else raw.try_cast("double"), F.when(raw.isNull(), 1.0).otherwise(0.0))))
        rows = rows.select("reel_pk", "dimension", F.col("e.category").alias("category"), clamped.alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out
