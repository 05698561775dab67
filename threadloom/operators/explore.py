"""Search, filters and comparison of record sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..functions.columns import filled, scalar, top_n
from .longitudinal import seeded


def _matches(c: Column, terms: Sequence[str], mode: str) -> Column:
    return tx.contains_any(c, terms) if mode == "or" else tx.contains_all(c, terms)


def filter_threads(videos: DataFrame, comments: DataFrame, replies: DataFrame, terms: Sequence[str] | str, mode: str = "or") -> tuple[DataFrame, DataFrame, DataFrame]:
    """matching replies, comments that match or keep a reply, videos that match or keep a comment."""
    terms = [terms] if isinstance(terms, str) else list(terms)
    hit_r = replies.filter(filled("text") & _matches(F.col("text"), terms, mode))
    parents = hit_r.select("video_id", "comment_id").distinct().withColumn("__hit", F.lit(True))
    c = comments.join(parents, ["video_id", "comment_id"], "left").filter(F.col("__hit") | (filled("text") & _matches(F.col("text"), terms, mode))).drop("__hit")
    kept = c.select("video_id").distinct().withColumn("__hit", F.lit(True))
    own = filled("description") & _matches(F.col("description"), terms, mode) if "description" in videos.columns else F.lit(False)
    v = videos.join(kept, "video_id", "left").filter(F.col("__hit") | own).drop("__hit")
    return v, c, hit_r


def snippets(texts: DataFrame, key: str, terms: Sequence[str], text: str = "text", context: int = 50) -> DataFrame:
    """(key, term, n, position, snippet) of every non-overlapping hit, white space collapsed."""
    clean = texts.select(key, F.regexp_replace(F.trim(text), r"\s+", " ").alias("__t"))
    out = None
    for term in terms:
        pieces = F.split("__t", f"(?iu){tx.quoted(term)}", -1)
        lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length)
        spots = F.aggregate(
            lengths, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")),
            lambda acc, n: F.struct((acc["end"] + n + len(term)).alias("end"), F.array_append(acc["at"], acc["end"] + n).alias("at")),
        )["at"]
        rows = clean.filter(tx.contains_any(F.col("__t"), [term])).select(key, "__t", F.posexplode(spots).alias("n", "position"))
        start = F.greatest(F.lit(0), F.col("position") - context)
        piece = F.substring("__t", start + 1, F.col("position") - start + len(term) + context)
        rows = rows.select(key, F.lit(term).alias("term"), "n", "position", F.concat(F.lit("..."), F.trim(piece), F.lit("...")).alias("snippet"))
        out = rows if out is None else out.unionByName(rows)
    return out


def filter_records(df: DataFrame, terms: Sequence[str], mode: str = "and", fields: Sequence[str] = ("caption_text",)) -> DataFrame:
    """records whose joined text fields hold all or any terms."""
    return df.filter(_matches(_joined(df, fields), terms, mode))


def _joined(df: DataFrame, fields: Sequence[str]) -> Column:
    parts = []
    for f in fields:
        c = F.col(f)
        parts.append(F.array_join(c, " ") if isinstance(df.schema[f].dataType, T.ArrayType) else F.coalesce(c.cast("string"), F.lit("")))
    return F.concat_ws(" \n", *parts)


def where(df: DataFrame, field: str, op: str, value: str, upper: str | None = None) -> DataFrame:
    """compare a field with a typed-in value: numbers when both sides are numeric, else lower-cased text."""
    c = F.col(field)
    listed = isinstance(df.schema[field].dataType, T.ArrayType)
    text = F.lower(F.array_join(c, ", ") if listed else c.cast("string"))
    if op == "contains":
        return df.filter(F.coalesce(text, F.lit("")).contains(value.lower()))
    if op == "between":
        return where(where(df, field, ">=", value), field, "<=", upper)
    left_text = F.nullif(F.trim(text), F.lit(""))
    number = left_text.try_cast("double")
    try:
        right = float(value)
    except ValueError:
        right = None
    word = value.strip().lower()
    if op in ("=", "==", "!="):
        same = F.coalesce((number == right) if right is not None else (left_text == word), F.lit(False))
        return df.filter(~same if op == "!=" else same)
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    by_text = compare(left_text, F.lit(word))
    test = by_text if right is None else F.when(number.isNotNull(), compare(number, F.lit(right))).otherwise(by_text)
    return df.filter(F.coalesce(test, F.lit(False)))


def first_hits(df: DataFrame, key: str, terms: Sequence[str], fields: Sequence[str], width: int = 72) -> DataFrame:
    """(key, field, snippet) around the first hit of a field, every term in brackets."""
    terms = [t.lower() for t in terms if t]
    out = None
    for f in fields:
        t = F.col(f).cast("string")
        low = F.lower(t)
        spots = F.array_compact(F.array(*[F.nullif(F.instr(low, x), F.lit(0)) for x in terms]))
        pos = F.array_min(spots) - 1
        rows = df.filter(filled(t)).withColumn("__p", pos).filter(F.col("__p").isNotNull())
        start = F.greatest(F.lit(0), F.col("__p") - width // 2)
        end = F.least(F.length(t), F.col("__p") + width // 2)
        piece = F.translate(F.substring(t, start + 1, end - start), "\n", " ")
        piece = F.concat(F.when(start > 0, "…").otherwise(""), piece, F.when(end < F.length(t), "…").otherwise(""))
        for x in sorted(terms, key=len, reverse=True):
            piece = F.regexp_replace(piece, f"(?i)({tx.quoted(x)})", "[$1]")
        rows = rows.select(key, F.lit(f).alias("field"), piece.alias("snippet"))
        out = rows if out is None else out.unionByName(rows)
    return out


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """(value, count) of a scalar or list field, blanks left out."""
    listed = isinstance(df.schema[field].dataType, T.ArrayType)
    v = F.trim((F.explode(field) if listed else F.col(field)).cast("string")) if not listed else None
    rows = df.select(F.explode(field).alias("v")).select(F.trim(F.col("v").cast("string")).alias("value")) if listed else df.select(v.alias("value"))
    return rows.filter(filled("value")).groupBy("value").agg(F.count("*").alias("count"))


def top_values(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    """most frequent values of a field."""
    return top_n(value_counts(df, field), n, F.desc("count"), F.lower("value"), F.col("value"))


def compare_sets(active: DataFrame, whole: DataFrame, field: str, n: int = 10) -> DataFrame:
    """share of each value in the active set against the whole set, by lift."""
    na = scalar(active, F.greatest(F.lit(1), F.count("*")).alias("n"))["n"]
    nt = scalar(whole, F.greatest(F.lit(1), F.count("*")).alias("n"))["n"]
    j = value_counts(active, field).withColumnRenamed("count", "active").join(value_counts(whole, field).withColumnRenamed("count", "total"), "value", "left")
    j = j.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("active_share", F.col("active") / na).withColumn("total_share", F.col("total") / nt)
    lift = F.when(F.col("total_share") > 0, F.col("active_share") / F.col("total_share")).otherwise(F.lit(float("inf")))
    out = j.withColumn("lift", lift).withColumn("delta", F.col("active_share") - F.col("total_share"))
    return top_n(out, n, F.desc("lift"), F.desc("active"), F.lower("value"), F.col("value"))


def sample(df: DataFrame, n: int, key: str = "reel_pk", seed: int = 42) -> DataFrame:
    """F8: n records in a reproducible random order."""
    return df.orderBy(seeded(key, seed)).limit(n)


def view_ids(df: DataFrame, name: str, key: str = "reel_pk") -> DataFrame:
    """rows (view, key) that save a record set under a name."""
    return df.select(F.lit(name).alias("view"), key).distinct()


def restore_view(whole: DataFrame, views: DataFrame, name: str, key: str = "reel_pk") -> DataFrame:
    """the records of a saved view."""
    return whole.join(views.filter(F.col("view") == name).select(key), key, "left_semi")


def missing_ids(whole: DataFrame, views: DataFrame, name: str, key: str = "reel_pk") -> DataFrame:
    """saved ids that no longer exist."""
    return views.filter(F.col("view") == name).select(key).join(whole.select(key), key, "left_anti")


def views_of(views: DataFrame, record, key: str = "reel_pk") -> DataFrame:
    """names of the views that hold a record."""
    return views.filter(F.col(key) == record).select("view").distinct()


FLAGS = ("keep", "spam", "exclude", "reviewed")


def with_manual(df: DataFrame, tags: DataFrame, notes: DataFrame, flags: DataFrame, key: str = "reel_pk") -> DataFrame:
    """records with manual tags, note texts and review flags."""
    t = tags.filter(filled("tag")).groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("manual_tags"))
    m = notes.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(": ", F.col("created_at").cast("string"), "note"))).alias("manual_notes"))
    g = flags.groupBy(key).agg(*[F.bool_or(F.col(f)).alias(f"manual_{f}") for f in FLAGS])
    none = F.array().cast("array<string>")
    out = df.join(t, key, "left").join(m, key, "left").join(g, key, "left")
    out = out.withColumn("manual_tags", F.coalesce("manual_tags", none)).withColumn("manual_notes", F.coalesce("manual_notes", none)).withColumn("manual_notes_count", F.size("manual_notes"))
    return out.select(*[c for c in out.columns if c not in {f"manual_{f}" for f in FLAGS}], *[F.coalesce(f"manual_{f}", F.lit(False)).alias(f"manual_{f}") for f in FLAGS])


def manual_tag_counts(tags: DataFrame) -> DataFrame:
    """records per manual tag."""
    return tags.filter(filled("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def review_counts(flags: DataFrame) -> DataFrame:
    """records per review flag."""
    wide = flags.agg(*[F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in FLAGS])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("count")) for f in FLAGS])).alias("e")).select("e.flag", "e.count")


def note_summary(notes: DataFrame, key: str = "reel_pk") -> DataFrame:
    """notes per record with the latest time."""
    return notes.groupBy(key).agg(F.count("*").alias("notes"), F.max("created_at").alias("latest"))


def only_processed(df: DataFrame, vision_state: DataFrame, key: str = "reel_pk") -> DataFrame:
    """records whose tagging is done."""
    return df.join(vision_state.filter("status = 'done'").select(key), key, "left_semi")
