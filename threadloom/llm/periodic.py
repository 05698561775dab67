"""Periodic runs of words: Lyndon arrays by Baier's grouping under both orders, roots extended into runs."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow
from .encode import texts_of

_ODD = np.uint64(0x9E3779B97F4A7C15)


def lyndon_groups(word: np.ndarray, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(group, span) of each position: the longest Lyndon word that starts there, named and measured.

    Phase one of Baier's suffix sorting. Positions stand in groups by what is
    known of their Lyndon word, at first the letter; groups are taken from the
    greatest down. A member tells the nearest position to its left in a lower
    group; those positions are longer by as many copies of the group's word as
    members told them, and move up to the end of their old group. A group has
    its whole word when its turn comes. ``reverse`` turns the order of letters;
    the end of the text is less than any letter in both orders.
    """
    n = len(word)
    ranks = np.unique(word, return_inverse=True)[1].reshape(-1)
    if reverse:
        ranks = ranks.max(initial=0) - ranks
    order = np.argsort(ranks, kind="stable")
    sizes = np.bincount(ranks) if n else np.empty(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sa, at, group = order.tolist(), place.tolist(), starts[ranks].tolist()
    size, span, lower = [0] * n, [1] * n, [-1] * n
    for g, k in zip(starts.tolist(), sizes.tolist()):
        size[g] = k
    left = n
    while left:
        top = group[sa[left - 1]]
        told: dict[int, int] = {}
        for s in sorted(sa[top:left]) if left - top > 1 else (sa[top],):
            p = s - 1
            while p >= 0 and group[p] >= top:
                p = lower[p]
            lower[s] = p
            if p >= 0:
                told[p] = told.get(p, 0) + 1
        left = top
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in told.items():
            moves.setdefault((-times, group[p]), []).append(p)
        for times, g in sorted(moves):
            members = moves[times, g]
            longer = span[g] - times * span[top]
            if len(members) == size[g]:
                span[g] = longer
                continue
            slot = g + size[g]
            size[g] -= len(members)
            new = g + size[g]
            size[new], span[new] = len(members), longer
            for p in members:
                slot -= 1
                other, old = sa[slot], at[p]
                sa[old], at[other], sa[slot], at[p], group[p] = other, old, p, slot, new
    label = np.array(group, dtype=np.int64)
    return label, np.array(span, dtype=np.int64)[label] if n else label


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, looked for in growing pieces."""
    done, step, n = 0, 16, min(len(a), len(b))
    while done < n:
        other = a[done : done + step][: n - done] != b[done : done + step][: n - done]
        if other.any():
            return done + int(other.argmax())
        done, step = min(done + step, n), 2 * step
    return n


def text_runs(word: np.ndarray, min_length: int, min_exponent: float) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_length`` letters and ``min_exponent`` >= 3 periods.

    Under one of the two orders the Lyndon root of a run is the longest Lyndon
    word wherever it stands in the run, so with three periods a root is
    followed by its equal: two neighbouring positions of one group. A chain of
    such roots is extended both ways by the common extension a period apart.
    """
    n, found = len(word), set()
    if n < min_length:
        return []
    for reverse in (False, True):
        label, span = lyndon_groups(word, reverse)
        at = np.arange(n)
        ahead, back = at + span, at - span
        again = (ahead < n) & (label[np.minimum(ahead, n - 1)] == label)
        first = again & ~((back >= 0) & (label[np.maximum(back, 0)] == label))
        for head in np.flatnonzero(first).tolist():
            p, end = int(span[head]), head
            while again[end]:
                end += p
            end += p
            if end - head + 2 * p < min_length:  # under this order a run reaches less than a root beyond its chain
                continue
            end += _equal_ahead(word[end:], word[end - p : n - p])
            start = head - _equal_ahead(word[:head][::-1], word[p : head + p][::-1])
            if end - start >= min_length and end - start >= min_exponent * p:
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sieve_width(min_length: int, min_exponent: float) -> int:
    """Words of a window that occurs twice in the text wherever it starts inside a run.

    A window of k words inside a run of length L and period q recurs a period
    before or behind when k <= L - 2q + 1; the least of that is at the period
    where the two lower bounds of the length meet.
    """
    meet = int(min_length / min_exponent)
    return max(min(min_length - 2 * meet + 1, int(np.ceil(min_exponent * (meet + 1))) - 2 * (meet + 1) + 1), 1)


def stretches(ids: np.ndarray, doc: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """[from, to) of all stretches of words whose windows of ``width`` words all occur twice in their document.

    Each run lies whole in one stretch, and so would its longer form, so the
    runs of the stretches are the runs of the texts. Windows are compared by
    hash; equal hashes of different windows only make a stretch longer.
    """
    n = len(ids) - width + 1
    if n < 1:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key + mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    key = (key ^ (doc[:n].astype(np.uint64) * _ODD)) * np.uint64(0x94D049BB133111EB)
    inside = doc[:n] == doc[width - 1 :]
    held = np.sort(key[inside])
    again = np.unique(held[1:][held[1:] == held[:-1]])
    if not len(again):
        return []
    spot = np.minimum(np.searchsorted(again, key), len(again) - 1)
    marked = inside & (again[spot] == key)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        # marked starts of two documents never touch: the last width - 1 words of a document start no window
        if b - a + width - 1 >= least:
            out.append((a, b + width - 1))
    return out


def periodic_runs(docs: DataFrame, min_length: int = 24, min_exponent: float = 3, prepare: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every whole text, words being `[^\\x20\\x09-\\x0D]+`.

    ``runs`` lists (start, length, period) by start, then period: stretches of
    at least ``min_length`` words and ``min_exponent`` (3 or more) smallest
    periods that no neighbouring word extends. ``collapsed`` is the text with
    only the first period of each run, words joined by one space.
    ``prepare(doc_id, words)`` may return other words to look at. No shuffle;
    words exist as objects for about 1 MB of text at a time or for one longer
    text. Null, empty and white texts have no words, no runs and an empty
    collapsed text; a very long text is taken whole, in time about
    proportional to its length; repeated rows get a row each, a null doc_id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    if min_exponent < 3 or min_length < 4:
        raise ValueError("runs are found from three periods and four words on")
    width = sieve_width(min_length, min_exponent)

    def search(batches):
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            sizes, runs, texts = [], [], []
            held: list[list[bytes]] = []
            volume = 0

            def flush():
                if not held:
                    return
                number = defaultdict(count().__next__)
                lengths = np.array([len(w) for w in held])
                ids = np.fromiter((number[w] for words in held for w in words), dtype=np.int64, count=int(lengths.sum()))
                doc = np.repeat(np.arange(len(held)), lengths)
                begins = np.cumsum(lengths) - lengths
                found: dict[int, list[tuple[int, int, int]]] = {}
                for a, b in stretches(ids, doc, width, min_length):
                    own = int(doc[a])
                    more = text_runs(ids[a:b], min_length, min_exponent)
                    found.setdefault(own, []).extend((a - int(begins[own]) + s, length, p) for s, length, p in more)
                for k, words in enumerate(held):
                    mine = sorted(found.get(k, ()), key=lambda r: (r[0], r[2]))
                    if mine:
                        kept = np.ones(len(words), bool)
                        for s, length, p in mine:
                            kept[s + p : s + length] = False
                        words = [words[i] for i in np.flatnonzero(kept).tolist()]
                    sizes.append(int(lengths[k]))
                    runs.append(mine)
                    texts.append(b" ".join(words))
                held.clear()

            for name, text in zip(names, texts_of(batch.column("text"))):
                words = text.split()
                held.append(prepare(name, words) if prepare else words)
                volume += len(text)
                if volume >= 1 << 20:
                    flush()
                    volume = 0
            flush()
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(rows, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_arrow(rows, search, f"doc_id {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """The strongest run and the digests of the runs and of the collapsed text, per row of ``periodic_runs``.

    Strongest: greatest exact length / period, then smallest start, then period.
    """
    before = lambda a, b: b["length"] * a["period"] - a["length"] * b["period"]
    ranked = F.array_sort("runs", lambda a, b: F.signum(F.when(before(a, b) != 0, before(a, b)).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("double")).cast("int"))
    best = F.when(F.size("runs") > 0, F.element_at(ranked, 1))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words the registered query looks at: in one of ten documents the rest from a place on is made periodic.

    Fixed by the query: h = crc32 of the decimal doc_id; where h % 10 = 0 and
    there are words, each word i >= a becomes word a + (i - a) % p. A null
    doc_id has no digest and changes nothing.
    """
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return (words[:a] + root * (-(-(n - a) // p)))[:n]
