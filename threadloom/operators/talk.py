"""Language and text analytics of comments and captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.columns import asset_label, clean_tag, filled, ratio, scalar, song_label, top_n, top_per_group, with_facts
from ..functions.quantiles import with_percentiles
from ..session import durable


def video_languages(comments: DataFrame, min_support: int = 5, majority: float = 0.4, known: DataFrame | None = None) -> DataFrame:
    """L1: majority comment language per video, when it is frequent enough.

    ``known`` (video_id, language) overrules the guess. Ties go to the
    language whose first comment has the smaller id.
    """
    use = comments.filter(filled("language") & (F.col("language") != "unknown"))
    counts = use.groupBy("video_id", "language").agg(F.count("*").alias("n"), F.min("comment_id").alias("first"))
    total = Window.partitionBy("video_id")
    best = Window.partitionBy("video_id").orderBy(F.desc("n"), "first")
    guess = (
        counts.withColumn("total", F.sum("n").over(total)).withColumn("r", F.row_number().over(best))
        .filter((F.col("r") == 1) & (F.col("n") >= min_support) & (F.col("n") / F.col("total") >= majority))
        .select("video_id", "language")
    )
    if known is None:
        return guess
    given = known.filter(filled("language")).select("video_id", "language")
    return given.unionByName(guess.join(given, "video_id", "left_anti"))


def language_counts(comments: DataFrame, replies: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """L2: rows per language at video, comment and reply level."""
    parts = (("video", video_languages(comments, known=known)), ("comment", comments), ("reply", replies))
    out = None
    for level, df in parts:
        rows = df.filter(filled("language")).groupBy("language").agg(F.count("*").alias("count")).select(F.lit(level).alias("level"), "language", "count")
        out = rows if out is None else out.unionByName(rows)
    return out


def language_distribution(counts: DataFrame, level: str, n: int | None = 10, normalize: bool = False) -> DataFrame:
    """L3: most frequent languages of one level, shares computed after the cut."""
    top = top_n(counts.filter(F.col("level") == level).select("language", "count"), n, F.desc("count"), F.asc("language"))
    if not normalize:
        return top
    total = scalar(top, F.sum("count").alias("n"))["n"]
    return top.select("language", (F.col("count") / total).alias("count"))


def language_mismatches(comments: DataFrame, replies: DataFrame, n: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """L4: "parent > child" language pairs with counts and percent of all mismatches.

    Replies count once per distinct language of a comment's replies.
    """
    video = video_languages(comments, known=known).select("video_id", F.col("language").alias("parent"))
    c = comments.filter(filled("language")).select("video_id", F.col("language").alias("child")).join(video, "video_id")
    r = (
        replies.filter(filled("language")).select("comment_id", F.col("language").alias("child")).distinct()
        .join(comments.filter(filled("language")).select("comment_id", F.col("language").alias("parent")), "comment_id")
    )
    out = None
    for kind, df in (("comment_vs_video", c), ("reply_vs_comment", r)):
        rows = df.filter("child <> parent").groupBy(F.concat_ws(" > ", "parent", "child").alias("pair")).agg(F.count("*").alias("count"))
        rows = rows.select(F.lit(kind).alias("kind"), "pair", "count")
        out = rows if out is None else out.unionByName(rows)
    whole = Window.partitionBy("kind")
    out = out.withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(whole))
    return out if n is None else top_per_group(out, ["kind"], n, F.desc("count"), F.asc("pair")).drop("rank")


def _term_table(tokens: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, term, count, docs) in one pass: every occurrence and every distinct term of a row are
    emitted together, so the aggregation combines on the map side by term only."""
    t = F.col(column)
    both = F.concat(
        F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d"))),
    )
    rows = tokens.select(*keys, F.explode(both).alias("e"))
    return rows.groupBy(*keys, F.col("e.term").alias("term")).agg(F.sum("e.c").alias("count"), F.sum("e.d").alias("docs"))


def word_frequencies(
    messages: DataFrame, ngram: tuple[int, int] = (1, 1), stopwords: Sequence[str] = (), languages: Sequence[str] | None = None,
    start: str | None = None, end: str | None = None, min_docs: int = 2, max_share: float = 0.95, max_features: int | None = None,
) -> DataFrame:
    """Term and n-gram frequencies with document-frequency limits."""
    use = messages
    if start is not None:
        use = use.filter(F.col("date") >= F.lit(start).cast("timestamp"))
    if end is not None:
        use = use.filter(F.col("date") <= F.lit(end).cast("timestamp"))
    if languages:
        use = use.filter(F.col("language").isin(*languages))
    grams = use.select(tx.words("text", stopwords).alias("w")).select(tx.ngrams(F.col("w"), *ngram).alias("g"))
    n = scalar(use, F.count("*").alias("n"))["n"]
    terms = _term_table(grams, "g").filter((F.col("docs") >= min_docs) & (F.col("docs") <= max_share * n))
    return terms if max_features is None else top_n(terms, max_features, F.desc("count"), F.asc("term"))


def topic_model(messages: DataFrame, topics: int = 8, min_docs: int = 5, max_share: float = 0.5, ngram: tuple[int, int] = (1, 2), stopwords: Sequence[str] = (), seed: int = 42, vocabulary: int = (1 << 31) - 1, rounds: int = 10):
    """Fitted (model, vocabulary, vectors) of an LDA over the messages.

    ``vocabulary`` asks for the most frequent terms only; by default all terms
    within the document limits take part. ``rounds`` are the iterations of the
    fit. The vocabulary reaches the driver; ``topics.fit_topics`` keeps it in
    tables and is exact.
    """
    tokens = messages.withColumn("grams", tx.ngrams(tx.words("text", stopwords), *ngram))
    counter = CountVectorizer(inputCol="grams", outputCol="features", minDF=min_docs, maxDF=max_share, vocabSize=vocabulary).fit(tokens)
    vectors = durable(counter.transform(tokens).drop("grams", "text"))
    model = LDA(k=topics, maxIter=rounds, seed=seed, featuresCol="features").fit(vectors)
    return model, counter.vocabulary, vectors


def topic_terms(model, vocabulary: Sequence[str], spark, n: int = 10) -> DataFrame:
    """The strongest terms of each topic; the vocabulary is bounded by its size limit."""
    words = spark.createDataFrame(list(enumerate(vocabulary)), "i int, term string")
    top = model.describeTopics(n).select((F.col("topic") + 1).alias("topic"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "e"))
    return top.select(F.concat(F.lit("Topic "), "topic").alias("topic"), (F.col("rank") + 1).alias("rank"), F.col("e.termIndices").alias("i"), F.col("e.termWeights").alias("weight")).join(words, "i").drop("i")


def document_topics(model, vectors: DataFrame) -> DataFrame:
    """Dominant topic and its weight per document."""
    mix = vector_to_array("topicDistribution")
    out = model.transform(vectors).withColumn("mix", mix).withColumn("weight", F.array_max("mix"))
    return out.withColumn("topic", F.concat(F.lit("Topic "), F.array_position("mix", F.col("weight")))).drop("mix", "topicDistribution", "features")


def topic_shares(document_topics: DataFrame) -> DataFrame:
    """Share of the corpus per topic in percent."""
    shares = document_topics.groupBy("topic").agg(F.sum("weight").alias("total_weight"))
    total = scalar(shares, F.sum("total_weight").alias("n"))["n"]
    return shares.withColumn("percent", F.col("total_weight") / total * 100)


def monthly_topic_shares(document_topics: DataFrame) -> DataFrame:
    """Topic share of each month in percent."""
    monthly = document_topics.filter(F.col("date").isNotNull()).groupBy(F.to_date(F.date_trunc("MONTH", "date")).alias("month"), "topic").agg(F.sum("weight").alias("weight"))
    return monthly.withColumn("percent", 100 * ratio("weight", F.sum("weight").over(Window.partitionBy("month"))))


def social_markers(messages: DataFrame, text: str = "text") -> DataFrame:
    """Distinct links, e-mails, hashtags, mentions and link domains of the corpus."""
    links = tx.find_all(text, r"(?i)(https?://\S+|www\.\S+)", 1)
    found = {
        "links": links,
        "emails": tx.find_all(text, tx.EMAIL),
        "hashtags": F.transform(tx.find_all(text, tx.HASHTAG, 1), F.lower),
        "mentions": F.transform(tx.find_all(text, tx.MENTION, 1), F.lower),
        "domains": F.filter(F.transform(links, _domain), lambda d: d != ""),
    }
    rows = F.concat(*[_labelled(k, v) for k, v in found.items()])
    return messages.select(F.explode(F.array_distinct(rows)).alias("e")).select("e.kind", "e.value").distinct()


def _labelled(kind: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def _domain(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.regexp_replace(url, r"^https?://", ""), r"^([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


# captions --------------------------------------------------------------------


def caption_terms(reels: DataFrame, n: int | None = 50, min_length: int = 3) -> DataFrame:
    """Frequent caption terms with occurrences and reels."""
    tokens = reels.select(tx.normalize_caption("caption_text").alias("clean")).select(tx.caption_tokens("clean", min_length).alias("t"))
    return top_n(_term_table(tokens, "t").withColumnRenamed("docs", "reel_count"), n, F.desc("count"), F.asc("term"))


def hashtag_terms(tags: DataFrame, n: int | None = 50) -> DataFrame:
    """Frequent hashtags with uses and reels."""
    clean = tags.select("reel_pk", F.lower(F.ltrim(F.trim("hashtag"), F.lit("#"))).alias("hashtag")).filter(F.col("hashtag") != "")
    counts = clean.groupBy("hashtag").agg(F.count("*").alias("count"), F.countDistinct("reel_pk").alias("reel_count"))
    return top_n(counts, n, F.desc("count"), F.asc("hashtag"))


def top_hashtags(reels: DataFrame, tags: DataFrame, song: str | None = None, n: int = 20) -> DataFrame:
    """Most used hashtags, overall or of one song."""
    use = tags if song is None else tags.join(reels.filter(F.col("song_id") == song).select("reel_pk"), "reel_pk", "left_semi")
    return top_n(use.groupBy("hashtag").agg(F.count("*").alias("count")), n, F.desc("count"), F.asc("hashtag"))


def distinctive_terms(reels: DataFrame, by: str = "song", tags: DataFrame | None = None, n: int | None = 30) -> DataFrame:
    """Smoothed term share of an entity over the global share, from captions or, with ``tags``, hashtags."""
    key, label = {"song": ("song_id", song_label()), "asset": ("asset_id", asset_label())}[by]
    use = reels.filter(filled(key)).withColumn("entity_id", F.col(key)).withColumn("entity_label", label)
    if tags is None:
        tokens = use.select("entity_id", "entity_label", tx.normalize_caption("caption_text").alias("clean")).select("entity_id", "entity_label", F.explode(tx.caption_tokens("clean")).alias("term"))
        counts = tokens.groupBy("entity_id", "entity_label", "term").agg(F.count("*").alias("count"))
    else:
        clean = tags.select("reel_pk", F.lower(F.ltrim(F.trim("hashtag"), F.lit("#"))).alias("term")).filter(F.col("term") != "")
        counts = use.select("reel_pk", "entity_id", "entity_label").join(clean, "reel_pk").groupBy("entity_id", "entity_label", "term").agg(F.count("*").alias("count"))
    entity = counts.groupBy("entity_id").agg(F.sum("count").alias("entity_total_terms"))
    overall = counts.groupBy("term").agg(F.sum("count").alias("global_count"))
    joined = counts.join(entity, "entity_id").join(overall, "term")
    joined = with_facts(joined, overall, F.count("*").alias("v"), F.sum("global_count").alias("t"))
    v, t = F.col("__f.v"), F.col("__f.t")
    score = ((F.col("count") + 1) / (F.col("entity_total_terms") + v)) / ((F.col("global_count") + 1) / (t + v))
    out = joined.select("entity_id", "entity_label", "term", "count", "entity_total_terms", "global_count", t.alias("global_total_terms"), F.round(score, 6).alias("score"))
    return out if not n else top_per_group(out, ["entity_id"], n, F.desc("score"), F.desc("count"), F.asc("term"))


def distinctive_hashtags(reels: DataFrame, tags: DataFrame, group: str = "song_id", min_count: int = 3, n: int = 25, stop: Sequence[str] = (), alpha: float = 0.5) -> DataFrame:
    """Log-odds, lift and shares of a tag inside a group against the rest."""
    clean = tags.select("reel_pk", F.ltrim(F.trim(F.lower("hashtag")), F.lit("#")).alias("hashtag")).filter(F.length("hashtag") > 1)
    if stop:
        clean = clean.filter(~F.col("hashtag").isin(*stop))
    tagged = reels.select("reel_pk", group).join(clean, "reel_pk")
    counts = tagged.groupBy(group, "hashtag").agg(F.count("*").alias("n_group"))
    sums = counts.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sum("n_group").alias("gt"))
    overall = counts.groupBy("hashtag").agg(F.sum("n_group").alias("n_total"))
    t = scalar(counts, F.sum("n_group").alias("t"))["t"]
    j = counts.filter(F.col("n_group") >= min_count).join(sums, group).join(overall, "hashtag").withColumn("n_other", F.col("n_total") - F.col("n_group")).withColumn("ot", t - F.col("gt"))
    g, o, gt, ot = (F.col(c) for c in ("n_group", "n_other", "gt", "ot"))
    share_g, share_o = g / gt, F.coalesce(ratio(o, ot), F.lit(0.0))
    out = j.select(
        group, "hashtag", "n_group", "n_other", share_g.alias("share_group"), share_o.alias("share_other"),
        F.when(share_o > 0, share_g / share_o).otherwise(F.lit(float("inf"))).alias("lift"),
        F.ln(((g + alpha) / (gt - g + alpha)) / ((o + alpha) / (ot - o + alpha))).alias("log_odds"),
    )
    return top_per_group(out, [group], n, F.desc("log_odds"), F.desc("n_group"), F.asc("hashtag"))


def caption_markers(reels: DataFrame) -> DataFrame:
    """Link flag, mention, hashtag and emoji counts, length and empty flag."""
    t = F.trim(F.coalesce("caption_text", F.lit("")))
    return reels.select(
        "reel_pk", t.rlike(tx.URL).alias("has_url"), F.regexp_count(t, F.lit(tx.CAPTION_MENTION)).alias("mention_count"),
        F.regexp_count(t, F.lit(tx.CAPTION_HASHTAG)).alias("hashtag_count_in_caption"), F.length(t).alias("caption_length"),
        (t == "").alias("is_empty_caption"), F.regexp_count(t, F.lit(tx.EMOJI)).alias("emoji_count"),
    )


def caption_features(reels: DataFrame) -> DataFrame:
    """Caption length, tag count, emoji, scripts and caption type; needs ``hashtags`` (array)."""
    cap = F.coalesce("caption_text", F.lit(""))
    out = reels.withColumn("caption_len", F.length(cap)).withColumn("n_hashtags", F.coalesce(F.array_size("hashtags"), F.lit(0)))
    out = out.withColumn("emoji_count", F.regexp_count(cap, F.lit(tx.ASTRAL))).withColumn("has_japanese_script", cap.rlike(tx.JAPANESE)).withColumn("has_latin_script", cap.rlike("[A-Za-z]"))
    kind = (
        F.when(F.col("has_japanese_script") & ~F.col("has_latin_script"), "japanese_script")
        .when((F.col("caption_len") > 0) & (F.col("n_hashtags") > 0) & (F.col("caption_len") <= F.col("n_hashtags") * 25), "mostly_hashtags")
        .when(F.col("caption_len") == 0, "no_caption")
        .otherwise("sentence_or_mixed")
    )
    return out.withColumn("has_caption", F.col("caption_len") > 0).withColumn("caption_type", kind)


def caption_style_summary(features: DataFrame, classifiable: dict[str, Column] | None = None) -> DataFrame:
    """Size, medians, script share and classifiable shares per caption type."""
    shares = [F.avg(c.cast("int")).alias(f"{d}_classifiable_share") for d, c in (classifiable or {}).items()]
    base = features.groupBy("caption_type").agg(F.count("*").alias("n_reels"), F.avg(F.col("has_japanese_script").cast("int")).alias("japanese_script_share"), *shares)
    return with_percentiles(base, features, ["caption_type"], {"median_caption_len": (F.col("caption_len"), 0.5), "median_hashtags": (F.col("n_hashtags"), 0.5)})


def theme_text(caption: str = "caption_text", tags: str | None = "hashtags") -> Column:
    """Lower-cased caption and tags in one string."""
    parts = [F.coalesce(F.col(caption), F.lit(""))]
    if tags:
        parts.append(F.array_join(F.coalesce(F.col(tags), F.array().cast("array<string>")), " "))
    return F.lower(F.concat_ws(" ", *parts))


def audio_filter_scores(reels: DataFrame, music_terms: Sequence[str], visual_terms: Sequence[str], tags: str | None = "hashtags") -> DataFrame:
    """Hits of two term lists, flags and the index visual minus music."""
    t = theme_text(tags=tags)
    out = reels.withColumn("music_hits", tx.term_hits(t, music_terms)).withColumn("visual_world_hits", tx.term_hits(t, visual_terms))
    out = out.withColumn("music_discourse_score", F.size("music_hits")).withColumn("visual_world_score", F.size("visual_world_hits"))
    m, v = F.col("music_discourse_score"), F.col("visual_world_score")
    return out.withColumn("has_music_discourse", m > 0).withColumn("has_visual_world", v > 0).withColumn("audio_filter_use", (v > 0) & (m == 0)).withColumn("audio_filter_index", v - m)


def audio_filter_summary(scored: DataFrame, group: str = "song_id") -> DataFrame:
    """Shares, median index and median plays per song or asset."""
    def share(c, name):
        return F.avg(F.col(c).cast("int")).alias(name)

    use = scored.filter(F.col(group).isNotNull())
    base = use.groupBy(group).agg(
        F.count("*").alias("n_reels"), share("has_music_discourse", "music_discourse_share"), share("has_visual_world", "visual_world_share"), share("audio_filter_use", "audio_filter_share")
    )
    return with_percentiles(base, use, [group], {"median_audio_filter_index": (F.col("audio_filter_index"), 0.5), "median_plays": (F.col("play_count"), 0.5)})
