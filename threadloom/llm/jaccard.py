"""Jaccard join of documents on word shingles: Voronoi regions of pivots with triangle windows, joined recursively."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.components import connected_components
from .common import map_arrow, stored
from .encode import texts_of

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LONGS = 16  # of a signature
_FEW = 100_000  # rows that one task takes rather than all
_PART = 2_000  # documents that meet one pivot in one task


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: Iterable[bytes], width: int = 4) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles; fewer words are one shingle, none give none."""
    hashes = _WordHashes()
    for text in texts:
        words = text.translate(_LOWER).split()
        if len(hashes) > 1 << 18:
            hashes.clear()
        h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        w = min(width, len(h))
        if not w:
            yield h
            continue
        n = len(h) - w + 1
        key = np.full(n, w, np.uint64)
        for k in range(w):
            key = (key + h[k : k + n]) * _ODD
            key ^= key >> np.uint64(32)
        key = key * _MIX
        yield np.unique(key ^ (key >> np.uint64(29)))


def _name(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signature(shingles: np.ndarray) -> list[int]:
    """Parity of the shingles in each of 1,024 slots: as many slots of two sets differ as shingles do, at most."""
    slots = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (64 * _LONGS - 1), minlength=64 * _LONGS) & 1
    return np.packbits(slots.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _first(n: np.ndarray | int, percent: int):
    """Length of the beginning of a set, in any common order, that a linked set's beginning meets."""
    return n + (-n * percent // 100) + 1


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n, name, signature) of each row: the number of its shingles, a name that equal sets share, parities of its shingles."""

    def measure(batches):
        for batch in batches:
            sets = ((len(s), _name(s), _signature(s)) for s in shingle_sets(texts_of(batch.column("text")), width))
            n, name, signature = zip(*sets) if batch.num_rows else ((), (), ())
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(signature, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "key", "n", "name", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "key", "text"), measure, f"doc_id {kind}, key long, n long, name long, signature array<long>")


def counted_shingles(docs: DataFrame, width: int, percent: int, share: int) -> DataFrame:
    """(t, name, n, held, late): the shingles that may stand in the beginning of a set, sets of one name once a task.

    In the common order one of ``share`` hash values come first, rarest first,
    and the others behind them by hash. ``held`` counts the set's shingles of
    the first kind; all of these are given, and of the others (``late``) those
    that a short set needs to fill its beginning.
    """

    def choose(batches):
        seen: set[int] = set()
        for batch in batches:
            t, name, n, held, late = [], [], [], [], []
            for s in shingle_sets(texts_of(batch.column("text")), width):
                own = _name(s)
                if not len(s) or own in seen:
                    continue
                seen.add(own)
                early = (s >> np.uint64(7)) % np.uint64(share) == 0
                # in the order of signed numbers, as the rows are ordered later
                more = np.sort(s[~early].view(np.int64))[: max(_first(len(s), percent) - int(early.sum()), 0)].view(np.uint64)
                t.append(np.concatenate([s[early], more]))
                late.append(np.concatenate([np.zeros(int(early.sum()), bool), np.ones(len(more), bool)]))
                name.append(np.full(len(t[-1]), own))
                n.append(np.full(len(t[-1]), len(s)))
                held.append(np.full(len(t[-1]), int(early.sum())))
            if t:
                yield pa.record_batch(
                    [pa.array(np.concatenate(t).view(np.int64)), pa.array(np.concatenate(name)), pa.array(np.concatenate(n).astype(np.int32)),
                     pa.array(np.concatenate(held).astype(np.int32)), pa.array(np.concatenate(late))],
                    names=["t", "name", "n", "held", "late"],
                )

    return map_arrow(docs.select("text"), choose, "t long, name long, n int, held int, late boolean")


def beginnings(shingles: DataFrame, percent: int) -> DataFrame:
    """(t, name, n, i): the shingles of each set's beginning that stand in other sets too, with their places.

    Shingles of one set only fill places but meet nothing; where they fill the
    whole beginning, the set links with no other.
    """
    everywhere = Window.partitionBy("t")
    shared = shingles.repartition("t").dropDuplicates(["t", "name"]).withColumn("m", F.count("*").over(everywhere)).filter("m > 1")
    own = Window.partitionBy("name")
    ranked = shared.withColumn("early", F.count(F.when(~F.col("late"), 1)).over(own)).withColumn("row", F.row_number().over(own.orderBy("late", "m", "t")) - 1)
    # before the shared early shingles stand those of this set alone; late ones follow all early ones, in the order of hashes
    place = F.when(F.col("late"), F.col("held") + F.col("row") - F.col("early")).otherwise(F.col("held") - F.col("early") + F.col("row")).cast("int")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.select("t", "name", "n", place.alias("i"), first.alias("first")).filter("i < first").drop("first")


def _fits(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can link whose first meeting stands at i and j, or behind."""
    return F.least(n - i, m - j) * (100 + percent) >= percent * (n + m)


def _differ(x: Column, y: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether the parities tell more differing shingles than two linked sets of n and m may have."""
    apart = F.bit_count(x[0].bitwiseXOR(y[0]))
    for k in range(1, _LONGS):
        apart = apart + F.bit_count(x[k].bitwiseXOR(y[k]))
    return apart * (100 + percent) > (100 - percent) * (n + m)


def regions_of_pivots(begun: DataFrame, percent: int) -> DataFrame:
    """(pivot, m, j, name, n, i): the documents that meet each pivot in a rare shingle.

    Of the sets that share a shingle of their beginnings the pivot is the one
    where it stands earliest, thus the one with the least of its own. Two
    linked sets stand in the region of one pivot at least.
    """
    here = Window.partitionBy("t")
    central = F.min(F.struct((F.col("i") / F.col("n")).alias("depth"), "name", F.col("n").alias("m"), F.col("i").alias("j"))).over(here)
    met = begun.withColumn("c", central).withColumn("all", F.count("*").over(here)).filter("all > 1").filter(_fits(F.col("c.m"), F.col("c.j"), F.col("c.m"), F.col("c.j"), percent))
    return met.groupBy(F.col("c.name").alias("pivot"), "name").agg(F.first("c.m").alias("m"), F.min("c.j").alias("j"), F.first("n").alias("n"), F.min("i").alias("i"))


def distances(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, shared) of pairs (a, b): the shingles that both texts have. ``texts`` is (key, text).

    Texts travel to the pivot ``a``, whose set is held while the others pass
    one by one; a pivot with many partners stands in several tasks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / _PART).cast("int").alias("parts"))
    others = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("key"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("key"))
    travel = texts.join(others.unionByName(heads), "key").select("a", "part", "key", "text")

    def meet(batches):
        pivot, held = None, None
        for batch in batches:
            a, b, shared = [], [], []
            keys = zip(batch.column("a").to_pylist(), batch.column("key").to_pylist())
            for (p, key), s in zip(keys, shingle_sets(texts_of(batch.column("text")), width)):
                if p == key:
                    pivot, held = p, s
                    continue
                assert pivot == p, "the pivot comes first"
                spot = np.searchsorted(held, s)
                a.append(p)
                b.append(key)
                shared.append(int((held[np.minimum(spot, len(held) - 1)] == s).sum()))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int64())], names=["a", "b", "shared"])

    dealt = travel.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("key"))
    return map_arrow(dealt.select("a", "key", "text"), meet, "a long, b long, shared long").distinct()


def _perhaps_among(texts: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """``texts`` without most rows whose key is not in ``keys``, told by a bitmap of key remainders.

    The bitmap has eight bits for each of the ``count`` keys, 16 MB at most
    whatever the tables are, so it may go to every executor; where it is full
    it lets all rows pass. It only spares the shuffle of texts: the join decides.
    """
    bits = min(max(1 << 20, 1 << (8 * count).bit_length()), 1 << 27)
    slot = F.pmod("key", F.lit(bits))
    drawn = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    at = F.bitmap_bit_position(slot).cast("int")
    marked = texts.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("at", at).join(F.broadcast(drawn), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, at div 8 + 1, 1)")), 16, 10).cast("int")
    return marked.filter(F.getbit(byte, F.col("at") % 8) == 1).select("key", "text")


def _snug(table: DataFrame) -> DataFrame:
    """A stored table of few rows in one partition, where joins, windows and groups need no shuffle; a larger one as it is."""
    return table.coalesce(1) if table.count() <= _FEW else table


def jaccard_links(texts: DataFrame, names: DataFrame, shingles: DataFrame, width: int, percent: int) -> DataFrame:
    """(src, dst): links that connect all sets with a Jaccard similarity of ``percent`` / 100 or more.

    ``names`` maps a set's name to the key of a text that has it. First each
    document of a region is measured against its pivot; those within reach
    are linked to it. What a pivot cannot tell, two of its documents in
    different components, is left to the next round: documents outside the
    largest component of a region become pivots of the region themselves, the
    nearest of each component first and sixteen times as many each round, and
    meet every document there of another component that the windows leave:
    sizes and places within the similarity, by the triangle inequality
    distances to the first pivot that differ by no more than the reach, and
    parities of shingles that do not differ in more places than shingles may.
    The rounds end when each region's unmeasured rest is one component, so no
    link between components is lost.
    """
    reach = 1 - percent / 100
    keyed = names.select("name", "key")
    found = stored(
        regions_of_pivots(beginnings(shingles, percent), percent)
        .join(keyed, "name").drop("name").withColumnRenamed("key", "b")
        .join(keyed.withColumnRenamed("name", "pivot"), "pivot").drop("pivot").withColumnRenamed("key", "a"),
        "jaccard-regions",
    )
    involved = stored(found.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "jaccard-keys")
    texts = stored(_perhaps_among(texts, involved, involved.count()).join(involved.hint("shuffle_hash"), "key").dropDuplicates(["key"]), "jaccard-texts")
    sized = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent
    measured = stored(distances(texts, found.filter("a <> b").filter(sized(F.col("n"), F.col("m"))).select("a", "b"), width), "jaccard-distances")
    known = measured.join(found, ["a", "b"])
    union = F.col("n") + F.col("m") - F.col("shared")
    links = known.filter(F.col("shared") * 100 >= union * percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    # the distance of a document that was not measured stays null: it is beyond the reach
    regions = _snug(stored(found.join(measured, ["a", "b"], "left").select("a", "b", "n", "i", (1 - F.col("shared") / union).alias("d")).filter("a <> b"), "jaccard-members"))
    links, chosen_now, per_component = _snug(stored(links, "jaccard-links")), 32, 1
    signatures = names.select(F.col("key").alias("b"), "signature")
    while True:
        # from here on a component is a star around its name
        stars = _snug(stored(connected_components(links, one_task=_FEW), "jaccard-stars"))
        placed = regions.join(stars.withColumnRenamed("node", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
        per = Window.partitionBy("a")
        crowd = placed.groupBy("a", "component").agg(F.count("*").alias("members")).withColumn("groups", F.count("*").over(per))
        crowd = crowd.filter("groups > 1").withColumn("largest", F.row_number().over(per.orderBy(F.desc("members"), "component")) == 1)
        open_ = _snug(stored(placed.join(crowd.select("a", "component", "members", "largest"), ["a", "component"]), "jaccard-open"))
        if open_.isEmpty():
            return links
        open_ = _snug(stored(open_.join(signatures, "b"), "jaccard-open"))
        order = [F.coalesce("d", F.lit(1.0)), F.col("b")]
        own = F.row_number().over(Window.partitionBy("a", "component").orderBy(*order))
        turn = F.row_number().over(per.orderBy("members", *order))
        pivots = open_.filter(~F.col("largest")).withColumn("own", own).filter(F.col("own") <= per_component).withColumn("turn", turn).filter(F.col("turn") <= chosen_now)
        q = stored(
            pivots.select("a", F.col("b").alias("q"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("d").alias("e"), F.col("component").alias("other"), F.col("signature").alias("qs")),
            "jaccard-pivots",
        )
        window = sized(F.col("n"), F.col("m")) & _fits(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent)
        triangle = F.coalesce(F.abs(F.col("d") - F.col("e")) <= reach + 1e-9, F.lit(True))
        near = ~_differ(F.col("signature"), F.col("qs"), F.col("n"), F.col("m"), percent)
        meeting = open_.join(q, "a").filter(F.col("component") != F.col("other")).filter(window & triangle & near)
        least, greatest = F.least("q", "b"), F.greatest("q", "b")
        pairs = stored(meeting.groupBy(least.alias("a"), greatest.alias("b")).agg(F.max(F.col("n") + F.col("m")).alias("both")), "jaccard-pairs")
        more = distances(texts, pairs.select("a", "b"), width).join(pairs, ["a", "b"])
        linked = more.filter(F.col("shared") * 100 >= (F.col("both") - F.col("shared")) * percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        # between two components one link is as good as many
        ends = stars.select("node", "component")
        roots = linked
        for end in ("src", "dst"):
            roots = roots.join(ends.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root")), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
        joined = roots.select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).filter("src <> dst").distinct()
        links = _snug(stored(stars.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(joined), "jaccard-links"))
        regions = _snug(stored(open_.select("a", "b", "n", "i", "d").join(q.select("a", F.col("q").alias("b")), ["a", "b"], "left_anti"), "jaccard-members"))
        chosen_now, per_component = chosen_now * 16, per_component * 16


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, share: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable over links of similar shingle sets.

    Two documents link when 100 * shared >= ``percent`` * united distinct
    shingles of ``width`` words (fewer words: the whole sequence is one).
    Documents with equal sets count once until the end; links are exact on
    64-bit hashes of shingles. A text without words, null included, has no
    shingles, is linked with nothing and is its own component; very long texts
    are taken whole; repeated rows get a row each; rows with a null doc_id keep
    it and never name a component that has an id; an empty table gives no
    rows; other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    rows = stored(document_sets(texts, width), "jaccard-sets")
    names = stored(rows.filter("n > 0").groupBy("name").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.first("signature").alias("signature")), "jaccard-names")
    shingles = counted_shingles(texts, width, percent, share)
    links = jaccard_links(texts.select("key", "text"), names, shingles, width, percent)
    of = connected_components(links, one_task=_FEW).withColumnRenamed("node", "key")
    rooted = names.drop("signature").join(of, "key", "left").withColumn("root", F.coalesce("component", "key"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.select("name", "root").join(least, "root").select("name", "component_id"), "jaccard-components")
    return rows.select("doc_id", "n", "name").join(classes, "name", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
