"""Spelling variants: near words found through an index of variable-length grams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, stored
from .encode import texts_of

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = "\x00"  # stands behind a word; no word holds it


def _counted(total: Counter) -> pa.RecordBatch:
    batch = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
    total.clear()
    return batch


def misspelt(doc_id, word: str) -> str:
    """The registered query's change of a run: one of 31 loses a code point. A null doc_id changes nothing."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least: int = 7, prepare: Callable | None = None, held: int = 200_000) -> DataFrame:
    """(word, n): runs of letters of at least ``least`` code points in all whole texts, with their occurrences.

    Letters are A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased.
    ``prepare(doc_id, run)`` may shorten or change a run of a document, no
    longer than it was. Counts are combined in the worker, for up to ``held``
    words at a time, before the shuffle by word.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def gather(batches) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                own = Counter(runs.findall(text.translate(_LOWER).decode("utf-8", "replace")))
                for word, n in own.items():
                    if prepare is not None:
                        word = prepare(name, word)
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) >= held:
                    yield _counted(total)
        yield _counted(total)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_arrow(rows, gather, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, shortest: int = 3, longest: int = 6, share: int = 1 << 16, least: int = 256) -> dict[str, int]:
    """The frequent grams, with their occurrences: those that longer grams take the place of.

    Level by level: a gram is frequent in more than ``least`` places and in
    more than one of ``share`` places of all; only frequent grams are followed
    to one letter more, so the tree of grams is cut below infrequent ones. A
    level has fewer than ``share`` grams whatever the words are, which bounds
    what is sent to the workers.
    """
    places = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    limit = max(least, places // share)
    kept: dict[str, int] = {}
    above: set[str] | None = None
    for q in range(shortest, longest + 1):

        def level(batches, q=q, above=above):
            total: Counter = Counter()
            for batch in batches:
                for word in batch.column("word").to_pylist():
                    ended = word + _END * q
                    for at in range(len(word)):
                        if above is None or ended[at : at + q - 1] in above:
                            total[ended[at : at + q]] += 1
                    if len(total) >= 200_000:
                        yield _counted(total)
            yield _counted(total)

        counts = map_arrow(words.select("word"), level, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        found = {r["word"]: r["n"] for r in counts.filter(F.col("n") > limit).toLocalIterator()}
        kept |= found
        above = set(found)
        if not above:
            break
    return kept


def decompose(word: str, frequent: dict[str, int], shortest: int = 3, longest: int = 6) -> tuple[list[str], int]:
    """(grams, affected): the gram at each place of the word, and how many of them one edit can touch.

    A gram begins with ``shortest`` letters and grows while it is frequent. A
    gram that ends before an edit stopped growing for what it is, so it stays;
    one that begins behind it only moves. So an edit touches the grams that
    cover its place, and the bound is the deepest place of the word, its end
    included.
    """
    ended, n = word + _END * longest, len(word)
    grams, depth = [], [0] * (n + longest + 1)
    for at in range(n):
        q = shortest
        while q < longest and ended[at : at + q] in frequent:
            q += 1
        grams.append(ended[at : at + q])
        depth[at] += 1
        depth[at + q] -= 1
    deepest = here = 0
    for at in range(n + 1):
        here += depth[at]
        deepest = max(deepest, here)
    return grams, deepest


def rare_grams(words: DataFrame, frequent: dict[str, int], shortest: int = 3, longest: int = 6) -> DataFrame:
    """(word, n, size, grams): of each word the rarest grams, one more than an edit can touch, with their places.

    Of two words within one edit, the first gram in the common order that the
    edit leaves alone is among these of both, in the same place or one on.
    """

    def choose(batches):
        for batch in batches:
            sizes, chosen = [], []
            for word in batch.column("word").to_pylist():
                grams, touched = decompose(word, frequent, shortest, longest)
                order = sorted((frequent.get(g, 0), zlib.crc32(g.encode()), g, at) for at, g in enumerate(grams))
                sizes.append(len(word))
                chosen.append([{"gram": g, "at": at} for *_, g, at in order[: touched + 1]])
            kind = pa.list_(pa.struct([("gram", pa.string()), ("at", pa.int32())]))
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(sizes, pa.int32()), pa.array(chosen, kind)], names=["word", "n", "size", "grams"])

    return map_arrow(words.select("word", "n"), choose, "word string, n long, size int, grams array<struct<gram string, at int>>")


def near_words(words: DataFrame, shortest: int = 3, longest: int = 6) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of words, one row each, that differ by one inserted, deleted or replaced code point.

    Every word needs more than ``longest`` code points: then no edit touches
    all its grams, and no pair is lost. Lists are merged by gram, place and
    length, which split those of frequent grams; what meets is verified.
    """
    frequent = gram_dictionary(words, shortest, longest)
    tokens = stored(rare_grams(words, frequent, shortest, longest), "word-grams").select("word", "n", "size", F.explode("grams").alias("g"))
    key = lambda at, size: F.xxhash64(F.col("g.gram"), F.col("g.at") + F.lit(at), F.col("size") + F.lit(size))
    longer = tokens.select(key(0, 0).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    probes = F.explode(F.array(key(0, 0), key(0, 1), key(1, 1))).alias("key")
    shorter = tokens.select(probes, F.col("word").alias("a"), F.col("n").alias("n_a"))
    sizes = F.length("b") - F.length("a")
    near = ((sizes == 1) | ((sizes == 0) & (F.col("a") < F.col("b")))) & (F.levenshtein("a", "b", 1) == 1)
    return shorter.join(longer, "key").filter(near).select("a", "b", "n_a", "n_b").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last, in doubling steps.

    ``forms`` (word, form) may not run in circles; here each form is more
    frequent than its word.
    """
    step = stored(forms.select("word", F.col("form").alias("root")), "word-forms")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = stored(step.join(onward, "root", "left"), "word-forms")
        moved = joined.filter("further IS NOT NULL").limit(1).count()
        step = joined.select("word", F.coalesce("further", "root").alias("root"))
        if not moved:
            return step


def spelling_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = 10, prepare: Callable | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts: its near words and the form it is a variant of.

    Words are those of ``word_counts`` with ``occurrences`` or more. A word's
    form is its near word of largest n, of equals the smallest in code-point
    order, if that n is at least ``ratio`` times the word's own; ``root`` is
    where forms lead. Null, empty and letterless texts add no words, very long
    texts are taken whole, repeated rows count again, an empty table or one
    without such words gives no rows; other columns are ignored.
    """
    if least < 4:
        raise ValueError("words need four code points at least")
    counts = stored(word_counts(docs, least, prepare).filter(F.col("n") >= occurrences), "word-counts")
    longest = min(6, least - 1)
    pairs = stored(near_words(counts, min(3, longest), longest), "near-words")
    ways = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near")).alias("other"))
    )
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("top"))
    told = F.col("top.less") <= -ratio * F.col("n")
    rows = stored(
        counts.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(told, F.col("top.near")).alias("form"), F.when(told, -F.col("top.less")).alias("form_n"),
        ),
        "word-rows",
    )
    roots = last_forms(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
