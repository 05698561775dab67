"""Rule-based classification, profiles and distinctiveness of reels.

Classified reels carry one ``<dimension>_categories`` array per dimension.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.automaton import groups_found, many, named
from ..functions.columns import ranked_top, ratio, scalar, top_n, top_per_group, with_facts
from ..functions.numbering import number_rows
from ..functions.quantiles import exact_percentiles, with_percentiles
from ..functions.rules import categories, label_of, labels
from ..functions.text import contains_any
from . import graph, longitudinal, scope, talk


def _cats(dim: str) -> Column:
    return F.col(f"{dim}_categories")


def _unknown_only(rules: dict, dim: str) -> Column:
    return F.array_distinct(_cats(dim)) == F.array(F.lit(rules[dim]["unknown_id"]))


def keyword_categories(text: Column, rules: dict, dim: str) -> Column:
    """Categories with a keyword inside the lower-cased text, in rule order, else the unknown id."""
    spec = rules[dim]["categories"]
    terms = [[str(k).lower() for k in s["keywords"]] for s in spec.values()]
    if many([t for own in terms for t in own]):
        hits = named(groups_found(F.lower(text), terms), list(spec))
        return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(rules[dim]["unknown_id"])))
    hits = F.array_compact(F.array(*[F.when(contains_any(text, [str(k) for k in s["keywords"]]), F.lit(c)) for c, s in spec.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(rules[dim]["unknown_id"])))


def infer_label(context: Column, form: Column, target: Column, unknown: str, inference: Sequence[Mapping]) -> Column:
    """Add labels to an unknown target from any-of conditions on two other dimensions."""
    adds = []
    for r in inference:
        ok = F.lit(True)
        for key, source in (("if_context_any", context), ("and_format_any", form)):
            if key in r:
                ok = ok & F.arrays_overlap(source, F.array(*[F.lit(x) for x in r[key]]))
        adds.append(F.when(ok, F.lit(r["add_aesthetic"])))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*adds)))) if adds else F.array().cast("array<string>")
    open_ = F.array_distinct(target) == F.array(F.lit(unknown))
    return F.when(open_, F.when(F.size(found) > 0, found).otherwise(target)).otherwise(target)


def classify(
    reels: DataFrame, rules: dict, annotations: DataFrame | None = None, sources: Sequence[str] = ("keyword",), min_confidence: float = 0.0,
    inference: Sequence[Mapping] = (), tags: str | None = "hashtags", fuse_all_sources: bool = False,
) -> DataFrame:
    """Keyword and stored categories per dimension, fused and sorted.

    As in the source analysis, stored tags join the fused set only when the
    source 'vision' is asked for; ``fuse_all_sources`` lets every stored source
    take part.
    """
    out = reels.withColumn("__text", talk.theme_text(tags=tags))
    for dim in rules:
        out = out.withColumn(f"{dim}_keyword", keyword_categories(F.col("__text"), rules, dim))
    out = out.drop("__text")
    stored = [s for s in sources if s != "keyword"]
    if stored and annotations is not None:
        use = annotations.filter(F.col("source").isin(*stored) & (F.col("confidence") >= min_confidence))
        wide = use.groupBy("reel_pk").agg(
            *[F.array_sort(F.collect_set(F.when(F.col("dimension") == d, F.col("category")))).alias(f"{d}_vision") for d in rules]
        )
        out = out.join(wide, "reel_pk", "left")
    for dim in rules:
        unknown = rules[dim]["unknown_id"]
        none = F.array().cast("array<string>")
        vision = F.coalesce(F.col(f"{dim}_vision"), none) if stored and annotations is not None else none
        out = out.withColumn(f"{dim}_vision", vision)
        parts = []
        if "keyword" in sources:
            parts.append(F.array_except(F.col(f"{dim}_keyword"), F.array(F.lit(unknown))))
        if "vision" in stored or (fuse_all_sources and stored):
            parts.append(F.col(f"{dim}_vision"))
        fused = F.array_sort(F.array_distinct(F.concat(*parts))) if parts else none
        out = out.withColumn(f"{dim}_categories", F.when(F.size(fused) > 0, fused).otherwise(F.array(F.lit(unknown))))
    if inference and "aesthetic" in rules:
        none = F.array().cast("array<string>")
        ctx = _cats("context") if "context" in rules else none
        fmt = _cats("format") if "format" in rules else none
        out = out.withColumn("aesthetic_categories", infer_label(ctx, fmt, _cats("aesthetic"), rules["aesthetic"]["unknown_id"], inference))
    return out


def explode_dimension(df: DataFrame, dim: str) -> DataFrame:
    """C4: one row per reel and category."""
    return df.withColumn(dim, F.explode(_cats(dim))).drop(f"{dim}_categories")


def dimension_distribution(df: DataFrame, rules: dict, dim: str) -> DataFrame:
    """Category counts and shares by song."""
    n = df.groupBy("song_id").agg(F.count("*").alias("n"))
    hits = df.filter(F.col("song_id").isNotNull()).select("song_id", F.explode(F.array_distinct(_cats(dim))).alias("category")).groupBy("song_id", "category").agg(F.count("*").alias("count"))
    return hits.join(n, "song_id").select(
        "song_id", F.lit(dim).alias("dimension"), "category", label_of(rules, dim, F.col("category")).alias("label"), "count", (F.col("count") / F.col("n")).alias("share")
    )


def _per_dimension(df: DataFrame, rules: dict, name: str) -> DataFrame:
    """(dimension, total, hits) with hits = reels that carry only the unknown category."""
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(_unknown_only(rules, d)).alias(d) for d in rules])
    return wide.select("total", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias(name)) for d in rules])).alias("e")).select("e.dimension", f"e.{name}", "total")


def unknown_share(df: DataFrame, rules: dict) -> DataFrame:
    """Reels without a real category per dimension."""
    return _per_dimension(df, rules, "unknown_only").withColumn("share", F.coalesce(ratio("unknown_only", "total"), F.lit(0.0)))


def classifiable_rate(df: DataFrame, rules: dict) -> DataFrame:
    """Share of reels with a real category per dimension."""
    base = _per_dimension(df, rules, "u")
    return base.select("dimension", F.col("total").alias("n_total"), (F.col("total") - F.col("u")).alias("n_classifiable"), F.coalesce(ratio(F.col("total") - F.col("u"), "total"), F.lit(0.0)).alias("rate"))


def combination_summary(df: DataFrame, rules: dict, primary: str, secondary: str, n: int = 25) -> DataFrame:
    """Category pairs of two dimensions with reels, songs and median impact."""
    rows = df.select("song_id", "reel_pk", "impact_metric", F.explode(_cats(primary)).alias(primary), _cats(secondary)).select(
        "song_id", "reel_pk", "impact_metric", primary, F.explode(f"{secondary}_categories").alias(secondary)
    )
    keys = [primary, secondary]
    base = rows.groupBy(*keys).agg(F.count("*").alias("reels"), F.countDistinct("song_id").alias("songs"))
    out = with_percentiles(base, rows, keys, {"median_impact": (F.col("impact_metric"), 0.5)})
    name = F.concat_ws(" + ", label_of(rules, primary, F.col(primary)), label_of(rules, secondary, F.col(secondary)))
    return top_n(out.withColumn("combo_label", name), n, F.desc("reels"), F.asc(primary), F.asc(secondary))


def distribution_classifiable(df: DataFrame, rules: dict, dim: str) -> DataFrame:
    """Category spread among classifiable reels."""
    unknown = rules[dim]["unknown_id"]
    clf = df.filter(~_unknown_only(rules, dim))
    n = scalar(clf, F.count("*").alias("n"))["n"]
    hits = clf.select(F.explode(F.array_distinct(_cats(dim))).alias("category")).filter(F.col("category") != unknown)
    return hits.groupBy("category").agg(F.count("*").alias("count")).select(
        "category", label_of(rules, dim, F.col("category")).alias("label"), "count", (F.col("count") / n).alias("share_of_classifiable")
    )


def _category_shares(df: DataFrame, rules: dict, dim: str, keys: Sequence[str], *more: Column) -> DataFrame:
    """Group sizes and the share of every category among the classifiable reels, one wide row per key."""
    clf = ~_unknown_only(rules, dim)
    cats = categories(rules, dim)
    wide = df.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count_if(clf).alias("n_classifiable"),
        *[F.count_if(clf & F.array_contains(_cats(dim), c)).alias(f"__{c}") for c in cats], *more,
    )
    rest = [c for c in wide.columns if not c.startswith("__")]
    return wide.select(*rest, *[F.coalesce(ratio(f"__{c}", "n_classifiable"), F.lit(0.0)).alias(c) for c in cats])


def song_profile(df: DataFrame, rules: dict, dim: str) -> DataFrame:
    """Sizes and category shares per song, one column per category."""
    return _category_shares(df.filter(F.col("song_id").isNotNull()), rules, dim, ["song_id"])


def song_distinctiveness(df: DataFrame, rules: dict, dim: str) -> DataFrame:
    """C11: spread of each category over the songs and the strongest song."""
    cats = categories(rules, dim)
    long = song_profile(df, rules, dim).unpivot("song_id", cats, "category", "share")
    low, high = F.min("share"), F.max("share")
    return long.groupBy("category").agg(
        F.round(low, 3).alias("min"), F.round(high, 3).alias("max"), F.round(high - low, 3).alias("range"),
        F.min_by("song_id", F.struct(-F.col("share"), F.col("song_id"))).alias("strongest_song"),
    )


def top_examples(df: DataFrame, dim: str, category: str, n: int = 5) -> DataFrame:
    """Reels of a category with the highest impact."""
    return ranked_top(df.filter(F.array_contains(_cats(dim), category)), n, F.desc("impact_metric"), F.asc("reel_pk"))


ASSET_KEYS = ["song_id", "asset_id", "variant_label"]


def asset_profile(df: DataFrame, rules: dict, dim: str = "context") -> DataFrame:
    """Sizes, creators, medians, span and category shares per asset; null keys stay groups."""
    more = [F.min("taken_at").alias("first_date"), F.max("taken_at").alias("last_date")] if "taken_at" in df.columns else []
    if "creator_pseudo" in df.columns:
        more.append(F.countDistinct("creator_pseudo").alias("creators"))
    out = _category_shares(df, rules, dim, ASSET_KEYS, *more)
    return with_percentiles(out, df, ASSET_KEYS, {"median_plays": (F.col("play_count"), 0.5), "median_impact": (F.col("impact_metric"), 0.5)})


def asset_vs_song(df: DataFrame, rules: dict, dim: str = "context") -> DataFrame:
    """C14: total and strongest difference between an asset's and its song's category mix."""
    cats = categories(rules, dim)
    names = labels(rules, dim)
    assets = _category_shares(df, rules, dim, ASSET_KEYS)
    songs = song_profile(df, rules, dim).select("song_id", *[F.col(c).alias(f"__{c}") for c in cats])
    gaps = [F.abs(F.col(c) - F.col(f"__{c}")) for c in cats]
    best = F.array_max(F.array(*[F.struct(g.alias("gap"), F.lit(-i).alias("i"), F.lit(names[c]).alias("label")) for i, (c, g) in enumerate(zip(cats, gaps))]))
    return assets.join(songs, "song_id", "left").select(
        *ASSET_KEYS, "n_total", sum(gaps[1:], gaps[0]).alias("delta_sum"), best["label"].alias("strongest_difference"), best["gap"].alias("strongest_abs_delta")
    )


def top_quantile_flag(df: DataFrame, group: str = "song_id", metric: str = "impact_metric", q: float = 0.9) -> DataFrame:
    """Flag reels at or above the group's quantile."""
    cut = exact_percentiles(df.filter(F.col(group).isNotNull()), [group], {"__cut": (F.col(metric), q)})
    return df.join(cut, group, "left").withColumn("is_top_quantile", F.coalesce(F.col(metric) >= F.col("__cut"), F.lit(False))).drop("__cut")


def impact_by_theme(df: DataFrame, rules: dict, dim: str = "context", group: str = "song_id", q: float = 0.9) -> DataFrame:
    """Category shares among top reels and the rest of each group, zero rows included."""
    cats = categories(rules, dim)
    flagged = top_quantile_flag(df.filter(F.col(group).isNotNull()), group, q=q)
    top = F.col("is_top_quantile")
    wide = flagged.groupBy(group).agg(
        F.count_if(top).alias("n_top"), F.count_if(~top).alias("n_rest"),
        *[F.count_if(top & F.array_contains(_cats(dim), c)).alias(f"t_{c}") for c in cats],
        *[F.count_if(~top & F.array_contains(_cats(dim), c)).alias(f"r_{c}") for c in cats],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"t_{c}").alias("t"), F.col(f"r_{c}").alias("r")) for c in cats])
    out = wide.select(group, "n_top", "n_rest", F.explode(rows).alias("e"))
    st, sr = F.coalesce(ratio("e.t", "n_top"), F.lit(0.0)), F.coalesce(ratio("e.r", "n_rest"), F.lit(0.0))
    return out.select(
        group, F.lit(dim).alias("dimension"), F.col("e.category").alias("category"), label_of(rules, dim, F.col("e.category")).alias("label"),
        "n_top", "n_rest", st.alias("share_top"), sr.alias("share_rest"), (st - sr).alias("delta"),
    )


def creator_summary(reels: DataFrame) -> DataFrame:
    """C17: reels, songs, assets and plays per creator."""
    use = reels.filter(F.col("creator_pseudo").isNotNull())
    base = use.groupBy("creator_pseudo").agg(
        F.countDistinct("reel_pk").alias("n_reels"), F.countDistinct("song_id").alias("n_songs"), F.countDistinct("asset_id").alias("n_assets"),
        F.coalesce(F.sum("play_count"), F.lit(0)).alias("total_plays"),
    )
    return with_percentiles(base, use, ["creator_pseudo"], {"median_plays": (F.col("play_count"), 0.5)})


def creator_kpis(reels: DataFrame) -> DataFrame:
    """Headline (metric, value) rows of the creator base."""
    base = reels.filter(F.col("creator_pseudo").isNotNull()).groupBy("creator_pseudo").agg(
        F.countDistinct("reel_pk").alias("n_reels"), F.countDistinct("song_id").alias("n_songs"), F.coalesce(F.sum("play_count"), F.lit(0)).alias("plays")
    )
    placed = number_rows(base, F.desc("n_reels"), F.asc("creator_pseudo"), name="place")
    k = scalar(placed, F.greatest(F.lit(1), F.bround(F.count("*") * 0.01)).alias("k"))["k"]
    head = placed.withColumn("__k", k)
    n = scalar(reels, F.countDistinct("reel_pk").alias("n"))["n"]
    in_top = F.col("place") <= F.col("__k")
    one = head.agg(
        F.count("*").cast("double").alias("creators"),
        F.avg((F.col("n_reels") == 1).cast("int")).alias("one_time_creator_share"),
        F.count_if(F.col("n_songs") > 1).cast("double").alias("creators_with_multiple_songs"),
        F.sum(F.when(in_top, F.col("n_reels"))).alias("tr"),
        F.coalesce(ratio(F.sum(F.when(in_top, F.col("plays"))), F.sum("plays")), F.lit(0.0)).alias("top_1pct_share_plays"),
    ).select("*", n.cast("double").alias("reels")).withColumn("top_1pct_share_reels", F.coalesce(ratio("tr", "reels"), F.lit(0.0)))
    names = ["creators", "reels", "one_time_creator_share", "creators_with_multiple_songs", "top_1pct_share_reels", "top_1pct_share_plays"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("e")).select("e.metric", "e.value")


def multi_song_creators(reels: DataFrame, min_songs: int = 2) -> DataFrame:
    """Creators with several songs."""
    return creator_summary(reels).filter(F.col("n_songs") >= min_songs)


def acoustic_families(acoustics: DataFrame) -> DataFrame:
    """C20: bright/warm and fast/slow family of each asset against the corpus medians."""
    use = acoustics.filter(F.col("tempo").isNotNull() & F.col("spectral_centroid").isNotNull()).select("asset_id", "tempo", "spectral_centroid")
    out = with_percentiles(use, use, [], {"tm": (F.col("tempo"), 0.5), "cm": (F.col("spectral_centroid"), 0.5)})
    out = with_facts(out, use, F.coalesce(F.nullif(F.stddev_pop("tempo"), F.lit(0.0)), F.lit(1.0)).alias("ts"), F.coalesce(F.nullif(F.stddev_pop("spectral_centroid"), F.lit(0.0)), F.lit(1.0)).alias("cs"))
    t, c = F.col("tempo"), F.col("spectral_centroid")
    z = (F.abs((t - F.col("tm")) / F.col("__f.ts")) + F.abs((c - F.col("cm")) / F.col("__f.cs"))) / 2
    family = F.concat_ws("-", F.when(c >= F.col("cm"), "bright").otherwise("warm"), F.when(t >= F.col("tm"), "fast").otherwise("slow"))
    return out.select("asset_id", family.alias("family"), F.round(F.greatest(F.lit(0.4), F.least(F.lit(1.0), 0.4 + z / 4)), 3).alias("confidence"))


def family_counts(families: DataFrame, reels: DataFrame) -> DataFrame:
    """Reels per acoustic family."""
    return reels.join(families, "asset_id").groupBy("family").agg(F.count("*").alias("reels"))


def choose_tags(scores: DataFrame, floor: float = 0.15, fraction: float = 0.40, k: int = 2) -> DataFrame:
    """At most ``k`` tags per reel and dimension, above a floor and a fraction of the best score."""
    # fixed values: floor 0.15, fraction of the best 0.40, two tags
    group = ["reel_pk", "dimension"]
    best = F.max("score").over(Window.partitionBy(*group))
    kept = scores.withColumn("__best", best).filter((F.col("score") >= floor) & ((F.col("__best") <= 0) | (F.col("score") >= fraction * F.col("__best"))))
    return top_per_group(kept.drop("__best"), group, k, F.desc("score"), F.asc("category"))


def timeline_matrix(timeline: DataFrame, n: int = 8) -> DataFrame:
    """Period by label counts of the ``n`` strongest labels, gaps as zero."""
    best = timeline.groupBy("entity_label").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "entity_label").limit(n)
    names = [r[0] for r in best.select("entity_label").collect()]  # at most n labels
    return timeline.filter(F.col("entity_label").isin(*names)).groupBy("period").pivot("entity_label", names).agg(F.sum("count")).fillna(0)


def theme_heat(df: DataFrame, rules: dict, dim: str = "context", threshold: float = 0.05) -> DataFrame:
    """(song, category, share) of categories that reach the threshold in some song."""
    long = song_profile(df, rules, dim).unpivot("song_id", categories(rules, dim), "category", "share")
    strong = long.groupBy("category").agg(F.max("share").alias("m")).filter(F.col("m") >= threshold).select("category")
    return long.join(strong, "category", "left_semi").select("song_id", "category", "share")


def report_tables(
    df: DataFrame, rules: dict, tags: DataFrame, *, music_terms: Sequence[str] = (), visual_terms: Sequence[str] = (), visual_contexts: Sequence[str] = (), contexts: Sequence[str] = (),
    slots: Sequence[dict] = (), tag_rules: DataFrame | None = None, stop: Sequence[str] = (), runs: DataFrame | None = None, seen: DataFrame | None = None, text_tags: str | None = None, tagged_only: bool = False,
    only: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The named result tables of a research report over one classified base.

    Tables whose inputs are not given are left out; ``only`` names the tables
    wanted. Every table is a plan of its own; a caller who writes many of them
    persists ``df`` first. With ``tagged_only`` only reels with a hashtag in
    ``tags`` count.
    """
    base = df.join(tags.select("reel_pk").distinct(), "reel_pk", "left_semi") if tagged_only else df
    dims = list(rules)
    scored = talk.audio_filter_scores(base, music_terms, visual_terms, tags=text_tags)
    out = {
        "unknown_share": lambda: unknown_share(base, rules),
        "classifiable_rate": lambda: classifiable_rate(base, rules),
        "song_trend": lambda: scope.song_trend(base),
        "weekday_hours": lambda: scope.weekday_hour_grid(base),
        "hashtag_terms": lambda: talk.hashtag_terms(tags),
        "distinctive_hashtags_song": lambda: talk.distinctive_hashtags(base, tags, "song_id"),
        "distinctive_hashtags_asset": lambda: talk.distinctive_hashtags(base, tags, "asset_id"),
        "top_hashtags": lambda: talk.top_hashtags(base, tags),
        "audio_filter_by_song": lambda: talk.audio_filter_summary(scored, "song_id"),
        "audio_filter_by_asset": lambda: talk.audio_filter_summary(scored, "asset_id"),
    }
    counts = ["play_count", "like_count", "view_count", "comment_count"]
    if set(counts) <= set(base.columns):
        out |= {
            "summary": lambda: scope.song_summary(base),
            "source_overview": lambda: scope.source_overview(base),
            "describe": lambda: scope.describe_fields(base, counts),
            "top_reels": lambda: scope.top_reels(base, "impact"),
            "impact_by_song": lambda: scope.impact_by_entity(base, "songs"),
            "impact_by_asset": lambda: scope.impact_by_entity(base, "assets"),
            "timeline_songs": lambda: scope.timeline(base, "songs"),
            "creator_summary": lambda: creator_summary(base),
            "creator_kpis": lambda: creator_kpis(base),
            "multi_song_creators": lambda: multi_song_creators(base),
        }
    if "hashtags" in base.columns:
        known = {d: F.col(f"{d}_categories") != F.array(F.lit(rules[d]["unknown_id"])) for d in dims}
        out["caption_style_summary"] = lambda: talk.caption_style_summary(talk.caption_features(base), known)
    if tag_rules is not None:
        bundle = lambda k: lambda: graph.network_bundle(tags, tag_rules, stop=stop)[k]
        out |= {f"hashtag_network_{k}": bundle(k) for k in ("nodes", "edges", "clusters", "semantic_clusters")}
    if contexts:
        out["close_reading_sample"] = lambda: longitudinal.close_reading_sample(base, contexts)
    if slots:
        out["close_reading_curated"] = lambda: longitudinal.curated_sample(base, slots, music_terms, visual_contexts, tags=text_tags)
    if runs is not None and seen is not None:
        out |= {
            "snapshot_status": lambda: longitudinal.snapshot_status(runs, seen),
            "snapshot_churn": lambda: longitudinal.churn(runs, seen),
            "snapshot_churn_intervals": lambda: longitudinal.churn_intervals(longitudinal.churn(runs, seen)),
        }
    for d in dims:
        out[f"distribution_{d}"] = partial(dimension_distribution, base, rules, d)
        out[f"distribution_classifiable_{d}"] = partial(distribution_classifiable, base, rules, d)
        out[f"song_profile_{d}"] = partial(song_profile, base, rules, d)
        out[f"song_distinctiveness_{d}"] = partial(song_distinctiveness, base, rules, d)
        out[f"impact_by_theme_{d}"] = partial(impact_by_theme, base, rules, d)
        out[f"asset_profile_{d}"] = partial(asset_profile, base, rules, d)
        out[f"asset_vs_song_{d}"] = partial(asset_vs_song, base, rules, d)
    if len(dims) > 1:
        out["combinations"] = lambda: combination_summary(base, rules, dims[0], dims[1])
    found = {k: make() for k, make in out.items() if only is None or k in only}
    if only is None or any(k.startswith("robustness_") for k in only):
        checks = longitudinal.robustness_tables(base, tags, rules)
        found |= {f"robustness_{k}": v for k, v in checks.items() if only is None or f"robustness_{k}" in only}
    return found
