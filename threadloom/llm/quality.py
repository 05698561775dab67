"""Quality rules: base measures of a text, and cross-document line frequency per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

def single_spaced(text: Column, line_feeds: bool) -> Column:
    """White space as single spaces, none at the ends; with ``line_feeds`` these stay as they are.

    White space is space, tab, line feed, vertical tab, form feed and carriage
    return. Both patterns match rarely in common text, which keeps this cheap.
    """
    plain = F.regexp_replace(text, r"[\t\x0B\f\r]" if line_feeds else r"[\t\n\x0B\f\r]", " ")
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more; ``words`` is bound by the caller."""
    none = F.array().cast("array<int>")
    windows = F.when(F.size(words) < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    )
    twice = F.transform(F.array(windows), lambda s: F.flatten(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))))
    covered = F.transform(twice, lambda p: F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))
    return F.size(covered[0])


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normalised form has one of the hashes; all other lines stay as they are."""
    tidy = F.split(F.lower(single_spaced(text, True)), "\n")  # as many lines as the text
    pairs = F.zip_with(F.split(text, "\n"), tidy, lambda x, low: F.struct(x.alias("x"), F.xxhash64(F.trim(low)).alias("h")))
    left = F.filter(pairs, lambda p: ~F.array_contains(hashes, p["h"]))
    return F.array_join(F.transform(left, lambda p: p["x"]), "\n")


def measured(docs: DataFrame, host: str = "source", texts: bool = False) -> DataFrame:
    """Base measures of each row, the hash of its text, and its different normalised lines with their words.

    A line is normalised by lower case and single spaces; ``lines`` holds
    (hash, words) of each different line of the text. With ``texts`` the text
    itself, as it is, comes last.
    """
    text = F.coalesce("text", F.lit(""))
    start = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"), F.col("text").alias("given"))
    spaced = start.select("*", single_spaced(F.col("text"), True).alias("lined")).select("*", single_spaced(F.col("lined"), False).alias("flat"))
    words = F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " "))
    # an inner array binds what is used more than once
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated")))[0]
    raw = F.filter(F.split("text", "\n"), lambda x: single_spaced(x, True) != "")
    tidy = F.filter(F.transform(F.split(F.lower("lined"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.transform(tidy, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))
    facts = spaced.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), counts.alias("c"), F.length("flat").cast("long").alias("flat_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(raw), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.array_distinct(lines).alias("lines"), "given",
    )
    return facts.select(
        "doc_id", "host", "text_hash", F.col("c.n").alias("n_words"), (F.col("flat_chars") - F.greatest(F.col("c.n") - 1, F.lit(0))).alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("c.repeated").alias("n_repeat_words"), "lines", *([F.col("given").alias("text")] if texts else []),
    )


def judge_quality(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.005, max_docs: int = 1000, left: float = 0.5, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words, words_left, kept), with ``texts`` and text.

    ``text`` is what the operator is for: the text without its lines above the
    limits, of rejected documents too; a null stays null. Without ``texts`` only
    the measures are made and texts are not stored.

    A line is above its limit on a host where it stands in more different
    documents of that host than ``share`` of them, or in more than ``max_docs``;
    either is enough, but up to ``min_docs`` a line is never common. Copies of a
    text are documents of their own; rows that repeat id and text are one
    document. ``line_words`` are the words of a document's different lines and
    ``words_left`` those of its lines within the limits; a document with less
    than ``left`` of its line words left is depleted and rejected.
    ``base_failed``: under 50 words, or over half of the words in repeated
    three-word windows.

    Texts are read once. Copies on a host are reduced to one list of line
    hashes, weighed by the number of their documents, before lines are counted
    with a map-side combine; lines above limits are joined back to line hashes.
    A null text is an empty one, a null host a host of its own, a null id an id,
    repeated rows get a row each, a very long text is measured whole, an empty
    table gives no rows, other columns are ignored.
    """
    rows = stored(measured(docs, host, texts), "quality")
    weights = rows.select("host", "text_hash", "doc_id").distinct().groupBy("host", "text_hash").agg(F.count("*").alias("docs"))
    copies = rows.groupBy("host", "text_hash").agg(F.any_value("lines").alias("lines"))
    own = stored(copies.join(weights, ["host", "text_hash"]), "quality-texts")
    lines = own.select("host", "text_hash", "docs", F.explode("lines").alias("l")).select("host", "text_hash", "docs", F.col("l.h").alias("line"), F.col("l.n").alias("n"))
    sizes = own.groupBy("host").agg(F.sum("docs").alias("all_docs"))
    shared = lines.groupBy("host", "line").agg(F.sum("docs").alias("docs")).filter(F.col("docs") > min(min_docs, max_docs))
    limit = F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), share * F.col("all_docs")))
    above = stored(shared.join(sizes, "host").filter(F.col("docs") > limit).select("host", "line"), "common-lines")
    gone = lines.join(above, ["host", "line"]).groupBy("host", "text_hash").agg(F.sum("n").alias("gone"), *([F.collect_list("line").alias("cut")] if texts else []))
    cleaned = [F.when(F.col("cut").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("cut"))).alias("text")] if texts else []
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return (
        rows.withColumn("line_words", total).drop("lines").join(gone, ["host", "text_hash"], "left")
        .withColumn("base_failed", failed).withColumn("words_left", F.col("line_words") - F.coalesce("gone", F.lit(0)))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_words", "words_left",
            (~F.col("base_failed") & (F.col("words_left") >= left * F.col("line_words"))).alias("kept"), *cleaned,
        )
    )
