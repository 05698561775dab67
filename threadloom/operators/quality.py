"""Data quality, privacy, enrichment and spam."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import text as tx
from ..functions.columns import filled, ratio, scalar, top_n, top_per_group, with_facts
from ..functions.numbering import number_rows
from ..session import durable


def schema_paths(spark: SparkSession, schema: T.DataType, root: str = "") -> DataFrame:
    """Q1: a nested schema as (path, type) rows."""
    rows: list[tuple[str, str]] = []

    def walk(t: T.DataType, path: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(t, T.ArrayType):
            rows.append((path, "list"))
            walk(t.elementType, f"{path}[]")
        else:
            rows.append((path, t.simpleString()))

    walk(schema, root)
    return spark.createDataFrame(rows, "path string, type string")


def infer_structure(records: DataFrame, column: str) -> DataFrame:
    """Q1: merged schema of a column of JSON records, inferred by a distributed aggregate."""
    merged = records.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
    ddl = (merged or "OBJECT<>").replace("OBJECT<", "STRUCT<")
    return schema_paths(records.sparkSession, T._parse_datatype_string(ddl))


def item_paths(videos: DataFrame, comments: DataFrame, replies: DataFrame) -> DataFrame:
    """(bucket, id, path, ord) of every video, comment (pos) and reply (comment_pos, pos)."""
    v = videos.select(F.lit("video_id").alias("bucket"), F.col("video_id").alias("id"), F.concat(F.lit("/"), "video_id").alias("path"))
    c = comments.select(F.lit("comment_id").alias("bucket"), F.col("comment_id").alias("id"), F.concat(F.lit("/"), "video_id", F.lit("/comments["), "pos", F.lit("]")).alias("path"))
    r = replies.select(
        F.lit("reply_id").alias("bucket"), F.col("reply_id").alias("id"),
        F.concat(F.lit("/"), "video_id", F.lit("/comments["), "comment_pos", F.lit("]/replies["), "pos", F.lit("]")).alias("path"),
    )
    return v.unionByName(c).unionByName(r).withColumn("id", F.col("id").cast("string")).filter(filled("id"))


def duplicate_ids(videos: DataFrame, comments: DataFrame, replies: DataFrame) -> DataFrame:
    """Q2: every place (bucket, id, path, n) of ids that occur more than once."""
    places = item_paths(videos, comments, replies)
    often = places.groupBy("bucket", "id").agg(F.count("*").alias("n")).filter("n > 1")
    return places.join(often, ["bucket", "id"])


def content_score(df: DataFrame, columns: Sequence[str]) -> Column:
    """Q4: richness of a flat record: keys, text lengths and numbers."""
    total = F.lit(len(columns))
    for c in columns:
        t = df.schema[c].dataType
        part = F.length(F.col(c)) + 1 if isinstance(t, T.StringType) else F.lit(1)
        total = total + F.when(F.col(c).isNotNull(), part).otherwise(0)
    return total


def mark_duplicates(rows: DataFrame, id_column: str, order: Sequence[str], score: Column) -> DataFrame:
    """Q3: flag the richest row of each id as kept, ties to the first path.

    The best row is found by an aggregate that combines on the map side, so an
    id with very many copies is no single-task sort.
    """
    scored = rows.withColumn("score", score)
    key = F.struct((-F.col("score")).alias("s"), *order)
    best = scored.filter(filled(id_column)).groupBy(id_column).agg(F.min(key).alias("__best"))
    return scored.join(best, id_column, "left").withColumn("kept", F.col("__best").isNull() | (key == F.col("__best"))).drop("__best")


def purge_duplicates(comments: DataFrame, replies: DataFrame, comment_columns: Sequence[str], reply_columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Q3: comments and replies with a ``kept`` flag; a comment gains 2 per reply and the replies' own scores."""
    r = mark_duplicates(replies, "reply_id", ["video_id", "comment_pos", "pos"], content_score(replies, reply_columns))
    thread = r.groupBy("video_id", "comment_pos").agg(F.sum("score").alias("rs"), F.count("*").alias("rn"))
    c = comments.join(thread.select("video_id", F.col("comment_pos").alias("pos"), "rs", "rn"), ["video_id", "pos"], "left")
    extra = F.coalesce("rs", F.lit(0)) + 3 * F.coalesce("rn", F.lit(0))  # one per list item, two as bonus
    return mark_duplicates(c, "comment_id", ["video_id", "pos"], content_score(comments, comment_columns) + extra).drop("rs", "rn"), r


def purge_report(marked: DataFrame, bucket: str) -> DataFrame:
    """Q3: kept and removed rows of a bucket."""
    return marked.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed")).select(F.lit(bucket).alias("bucket"), "kept", "removed")


def extend_pseudonyms(ids: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Q5: (id, token): stored tokens stay, new ids get User{n} in id order after the stored ones."""
    distinct = ids.select(F.col(ids.columns[0]).alias("id")).filter(filled("id")).distinct()
    if mapping is None:
        return number_rows(distinct, "id").select("id", F.concat(F.lit("User"), "n").alias("token"))
    start = mapping.count() + 1
    new = number_rows(distinct.join(mapping.select("id"), "id", "left_anti"), "id", start=start).select("id", F.concat(F.lit("User"), "n").alias("token"))
    return mapping.select("id", "token").unionByName(new)


def pseudonymise(rows: DataFrame, mapping: DataFrame, id_column: str, name_column: str, channel: bool = False, purge: bool = False) -> DataFrame:
    """Q5: add anonymised id and name columns, or overwrite the real ones."""
    j = rows.join(mapping.withColumnRenamed("id", id_column), id_column, "left")
    name = F.regexp_replace("token", "^User", "Channel") if channel else F.col("token")
    if purge:
        j = j.withColumn(id_column, F.coalesce("token", id_column))
        return (j.withColumn(name_column, F.coalesce(name, F.col(name_column))) if name_column in rows.columns else j).drop("token")
    return j.withColumn(f"anonymized_{id_column}", F.col("token")).withColumn(f"anonymized_{name_column}", name).drop("token")


def depseudonymise(rows: DataFrame) -> DataFrame:
    """Q6: drop the anonymised columns."""
    return rows.drop(*[c for c in rows.columns if c.startswith("anonymized_")])


def depseudonymise_report(rows: DataFrame) -> DataFrame:
    """Q6: how many values each anonymised column held."""
    cols = [c for c in rows.columns if c.startswith("anonymized_")]
    return rows.agg(*[F.count(c).alias(c) for c in cols])


def keyed_pseudonym(c: Column | str, salt: str, length: int = 24) -> Column:
    """Q7: first hex digits of HMAC-SHA256(salt, id), with built-in digests only."""
    key = salt.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in key).hex())) for p in (0x36, 0x5C))
    c = F.col(c) if isinstance(c, str) else c
    first = F.unhex(F.sha2(F.concat(inner, F.encode(c.cast("string"), "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, length)


def drop_rejected(videos: DataFrame, decisions: DataFrame) -> DataFrame:
    """Q8: videos with a review flag, rejected ones left out; ``decisions`` is (video_id, keep)."""
    kept = videos.join(decisions.filter(~F.col("keep")).select("video_id"), "video_id", "left_anti").drop("manual_review")
    seen = decisions.filter("keep").select("video_id").distinct().withColumn("manual_review", F.lit(True))
    return kept.join(seen, "video_id", "left").withColumn("manual_review", F.coalesce("manual_review", F.lit(False)))


def trigrams(c: Column | str) -> Column:
    """Character trigrams of the lower-cased words of a text, each word padded by a blank.

    One pass over the text: words stand between single blanks, and the
    overlapping places of three signs are taken whose middle one is a letter.
    """
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " ")), F.lit(" "))
    return F.regexp_extract_all(spaced, F.lit(r"(?=(.[^ ].))"), F.lit(1))


def language_profiles(labelled: DataFrame) -> DataFrame:
    """Q9: (language, trigram, weight): all trigrams of each language, weighted by the log of their frequency."""
    rows = labelled.filter(F.col("language").isNotNull())
    counts = rows.select("language", F.explode(trigrams("text")).alias("trigram")).groupBy("language", "trigram").agg(F.count("*").alias("n"))
    total = counts.groupBy("language").agg(F.sum("n").alias("total"))
    weight = F.round(F.log1p(F.col("n") * 1e6 / F.col("total")), 6).cast("decimal(18,6)")
    return counts.join(total, "language").select("language", "trigram", weight.alias("weight"))


# a lookup of this many trigrams times languages is sent to all executors; a larger one is joined
LOOKUP_CELLS = 2_000_000


def detect_language(texts: DataFrame, profiles: DataFrame, key: str, text: str = "text", lookup_cells: int = LOOKUP_CELLS) -> DataFrame:
    """Q9: (key, detected): the language whose profile scores highest, 'unknown' without any hit.

    Profiles of up to ``lookup_cells`` weights become one row of weights per
    trigram, whose counted size allows to send it to every executor: texts are
    then scored where they are read, and only sums per text are shuffled.
    Larger profiles are joined like any table, on counted trigrams. Both sum
    millionths as whole numbers and give the same result.
    """
    weights = durable(profiles.select("language", "trigram", F.round(F.col("weight") * 1_000_000).cast("long").alias("w")))
    languages = [r["language"] for r in weights.select("language").distinct().orderBy("language").limit(257).collect()]
    rows = weights.select("trigram").distinct().count()
    if len(languages) <= 256 and rows * len(languages) <= lookup_cells:
        columns = [F.coalesce(F.max(F.when(F.col("language") == x, F.col("w"))), F.lit(0)) for x in languages]
        lookup = weights.groupBy("trigram").agg(*[c.alias(f"w{i}") for i, c in enumerate(columns)])
        hits = texts.select(key, F.explode(trigrams(text)).alias("trigram")).join(F.broadcast(lookup), "trigram")
        sums = hits.groupBy(key).agg(F.count("*").alias("hits"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(languages))])
        order = F.array(*[F.struct((-F.col(f"w{i}")).alias("less"), F.lit(x).alias("language")) for i, x in enumerate(languages)])
        best = sums.select(key, F.array_min(order)["language"].alias("detected")) if languages else sums.select(key, F.lit(None).cast("string").alias("detected"))
    else:
        grams = texts.select(key, F.explode(trigrams(text)).alias("trigram")).groupBy(key, "trigram").agg(F.count("*").alias("times"))
        scores = grams.join(weights, "trigram").groupBy(key, "language").agg(F.sum(F.col("times") * F.col("w")).alias("score"))
        best = scores.groupBy(key).agg(F.min_by("language", F.struct(-F.col("score"), F.col("language"))).alias("detected"))
    return texts.select(key).join(best, key, "left").withColumn("detected", F.coalesce("detected", F.lit("unknown")))


def fill_languages(texts: DataFrame, profiles: DataFrame, key: str, text: str = "text", force: bool = False) -> DataFrame:
    """Q9: language column filled where missing, or everywhere with ``force``."""
    found = detect_language(texts if force else texts.filter(F.col("language").isNull()), profiles, key, text)
    out = texts.join(found, key, "left")
    value = F.coalesce("detected", "language") if force else F.coalesce("language", "detected")
    return out.withColumn("language", value).drop("detected")


def require_languages(messages: DataFrame) -> None:
    """Q10: refuse to go on while a message has no language."""
    if not messages.filter(F.col("language").isNull()).isEmpty():
        raise ValueError("run language detection first: some messages have no language")


def lexicon_sentiment(messages: DataFrame, lexicon: DataFrame, key: str, text: str = "text", language: str = "en") -> DataFrame:
    """Q10: (key, sentiment): summed term valence squashed to -1..1, two places; null for other languages and empty text."""
    use = messages.filter((F.col("language") == language) & filled(F.trim(text)))
    hits = use.select(key, F.explode(tx.words(text)).alias("term")).join(lexicon, "term").groupBy(key).agg(F.sum("valence").alias("s"))
    scored = use.select(key, F.lit(True).alias("ok")).join(hits, key, "left")
    s = F.coalesce("s", F.lit(0.0))
    scored = scored.select(key, F.round(s / F.sqrt(s * s + 15), 2).alias("sentiment"))
    return messages.select(key).join(scored, key, "left")


def caption_languages(captions: DataFrame) -> DataFrame:
    """Q11: captions per language overall and within song, shares to four places."""
    lang = F.coalesce("language", F.lit("unknown"))
    by_song = captions.groupBy("song_id", lang.alias("language")).agg(F.count("*").alias("count"))
    overall = by_song.groupBy("language").agg(F.sum("count").alias("count")).withColumn("song_id", F.lit(None).cast("string")).withColumn("scope", F.lit("overall"))
    rows = by_song.withColumn("scope", F.lit("song")).unionByName(overall)
    share = F.col("count") / F.sum("count").over(Window.partitionBy("scope", "song_id"))
    return rows.select("scope", "song_id", "language", "count", F.round(share, 4).alias("share"))


# spam ------------------------------------------------------------------------


def flag_spam(reels: DataFrame, terms: Sequence[str], vision_state: DataFrame | None = None) -> DataFrame:
    """Q12: matched terms, blocked state and the resulting spam flag."""
    out = reels.withColumn("matched_terms", tx.term_hits(F.coalesce("caption_text", F.lit("")), terms))
    if vision_state is None:
        out = out.withColumn("vstatus", F.lit(None).cast("string"))
    else:
        out = out.join(vision_state.select("reel_pk", F.col("status").alias("vstatus")), "reel_pk", "left")
    out = out.withColumn("is_term", F.size("matched_terms") > 0).withColumn("is_blocked", F.coalesce(F.col("vstatus") == "blocked", F.lit(False)))
    return out.withColumn("is_spam", F.col("is_term") | F.col("is_blocked"))


def spam_diff(before: DataFrame, flagged: DataFrame) -> DataFrame:
    """Q12: newly flagged, unflagged and total; ``before`` is (reel_pk, is_spam)."""
    j = flagged.select("reel_pk", F.col("is_spam").alias("now")).join(before.select("reel_pk", (F.coalesce(F.col("is_spam").cast("int"), F.lit(0)) == 1).alias("old")), "reel_pk", "left")
    old = F.coalesce("old", F.lit(False))
    return j.agg(F.count_if(F.col("now") & ~old).alias("newly_flagged"), F.count_if(~F.col("now") & old).alias("unflagged"), F.count_if("now").alias("flagged"))


def spam_report(flagged: DataFrame, n: int = 15) -> dict[str, DataFrame]:
    """Q13: the tables of a spam report over flagged reels."""
    spam = flagged.filter("is_spam")
    total = F.count("*")

    def by(key):
        g = flagged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_if("is_spam").alias("spam"), total.alias("total")).filter("spam > 0")
        return top_n(g.withColumn("rate", F.col("spam") / F.col("total")), n, F.desc("spam"), F.asc(key))

    daily = spam.filter(F.col("taken_at").isNotNull()).groupBy(F.to_date("taken_at").alias("day")).agg(total.alias("spam"))
    daily = with_facts(daily, daily, F.avg("spam").alias("m"), F.stddev_pop("spam").alias("s"))
    limit = F.greatest(F.col("__f.m") + 2 * F.col("__f.s"), F.lit(2.0))
    daily = daily.select("day", "spam", ((F.col("spam") >= limit) & (F.col("spam") > F.col("__f.m"))).alias("spike"))
    creators = spam.filter(F.col("creator_pseudo").isNotNull()).groupBy("creator_pseudo").agg(total.alias("spam"))
    top5 = scalar(creators.orderBy(F.desc("spam"), "creator_pseudo").limit(5), F.sum("spam").alias("n"))["n"]
    spam_total = scalar(spam, total.alias("n"))["n"]
    engagement = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in ("like_count", "play_count", "comment_count") if c in flagged.columns]
    caption = F.lower(F.trim(F.coalesce("caption_text", F.lit(""))))
    return {
        "kpis": flagged.agg(
            total.alias("total"), F.count_if("is_spam").alias("flagged"), F.count_if("is_term").alias("by_term"), F.count_if("is_blocked").alias("by_block"),
            F.count_if(F.col("is_term") & F.col("is_blocked")).alias("both_reasons"), F.countDistinct(F.when(F.col("is_spam"), F.col("creator_pseudo"))).alias("creators"),
        ),
        "terms": spam.select(F.explode("matched_terms").alias("term")).groupBy("term").agg(total.alias("reels")),
        "states": flagged.groupBy(F.coalesce("vstatus", F.lit("(no vision record)")).alias("state")).agg(total.alias("reels")),
        "songs": by("song_id"),
        "variants": by("variant_label"),
        "daily": daily,
        "concentration": creators.agg(
            total.alias("creators"), F.count_if(F.col("spam") >= 3).alias("repeaters")
        ).select("*", (100.0 * top5 / spam_total).alias("top5_share_pct")),
        "creators": top_n(creators, n, F.desc("spam"), F.asc("creator_pseudo")),
        "captions": top_n(spam.groupBy(caption.alias("caption")).agg(total.alias("reels")).filter((F.col("caption") != "") & (F.col("reels") > 1)), 12, F.desc("reels"), F.asc("caption")),
        "engagement": flagged.select("is_spam", F.explode(F.array(*engagement)).alias("e")).groupBy("e.metric").agg(
            F.avg(F.when(F.col("is_spam"), F.col("e.v"))).alias("spam_mean"), F.avg(F.when(~F.col("is_spam"), F.col("e.v"))).alias("other_mean")
        ),
    }


def blocked_list(vision_state: DataFrame, reels: DataFrame, annotations: DataFrame) -> DataFrame:
    """Q14: blocked reels, newest first when dated, with their other tags in one text."""
    tags = annotations.filter(F.col("source") != "vision").groupBy("reel_pk").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "dimension", "category"))), ", ").alias("tags"))
    out = vision_state.filter("status = 'blocked'").join(reels, "reel_pk").join(tags, "reel_pk", "left").withColumn("tags", F.coalesce("tags", F.lit("")))
    return out.orderBy(*([F.desc_nulls_last("updated_at")] if "updated_at" in out.columns else []), "reel_pk")


def tagging_coverage(reels: DataFrame, vision_state: DataFrame) -> DataFrame:
    """Q17: total, done share, open and the states behind it."""
    j = reels.select("reel_pk").join(vision_state.select("reel_pk", "status"), "reel_pk", "left")
    s = F.col("status")
    return j.agg(
        F.count("*").alias("total"), F.count_if(s == "done").alias("done"), (100.0 * F.count_if(s == "done") / F.nullif(F.count("*"), F.lit(0))).alias("done_pct"),
        F.count_if(~F.coalesce(s == "done", F.lit(False))).alias("open"), *[F.count_if(s == x).alias(x) for x in ("pending", "no_media", "blocked", "failed")],
        F.count_if(s.isNull()).alias("no_record"),
    )


def models_used(annotations: DataFrame) -> DataFrame:
    """Q17: distinct models behind the vision tags."""
    return annotations.filter((F.col("source") == "vision") & F.col("model").isNotNull()).select("model").distinct()


def coverage_by(df: DataFrame, column: str) -> DataFrame:
    """Q18: rows per value of a state column, null as '(unset)'."""
    return df.groupBy(F.coalesce(column, F.lit("(unset)")).alias(column)).agg(F.count("*").alias("n"))
