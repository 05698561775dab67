"""Counting item pairs that share groups, without one task owning a large group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import durable
from .columns import top_per_group
from .numbering import number_rows

_BLOCK = 2000
# items on a side of a tile, least number of blocks, meetings from which tiles are thought of, pairs in an Arrow batch
_TILE, _BLOCKS, _TILED_FROM, _BATCH = 4000, 8, 1_000_000, 100_000
# counting all groups at once may form this many times the pairs of the kept groups
_DIRECT = 8


def _ordered(left: str, right: str) -> Column:
    return F.col(left) < F.col(right)


def group_pairs(members: DataFrame, group: str, item: str) -> DataFrame:
    """(group, a, b) with a < b for the items of each group.

    A group larger than a block is cut into blocks on the left side and copied
    once per block on the right, so its pairs spread over many join keys.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("__blocks"))
    sized = members.join(sizes, group)
    left = sized.select(group, F.col(item).alias("a"), F.pmod(F.xxhash64(item), F.col("__blocks")).cast("int").alias("__b"))
    right = sized.select(group, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__b"))
    return left.join(right, [group, "__b"]).filter(_ordered("a", "b")).select(group, "a", "b")


def shared_group_counts(members: DataFrame, group: str, item: str, min_weight: int = 1, max_group: int | None = None) -> DataFrame:
    """(a, b, weight) for pairs sharing at least ``min_weight`` groups; ``members`` is distinct.

    Exact prefix filter: every item orders its groups from the smallest to the
    largest and sets aside its ``min_weight - 1`` largest ones. A qualifying
    pair still meets in a group both have kept, so only those groups give
    candidates, and sets of groups are compared for candidates only. Where the
    groups set aside add few meetings to those of the kept ones, as the counted
    sizes tell, all groups are counted at once, which needs no comparison; both
    ways give the same pairs. Where most items meet, ``tiled_pairs`` counts without
    a shuffle of pairs. Items with the same groups are counted once (``item_classes``).
    With a threshold of 1 every pair that meets is part of the result; ``max_group``
    leaves out larger groups where a caller means that.
    """
    m = members.select(group, item)
    if max_group is not None:
        small = m.groupBy(group).count().filter(F.col("count") <= max_group).select(group)
        m = m.join(small, group, "left_semi")
    m = durable(m)
    places = item_classes(m, group, item)
    if places is not None:
        found = _counts(_representatives(m, places, item), group, item, min_weight)
        return _expanded(found, places, item, min_weight).select("a", "b", "weight")
    return _counts(m, group, item, min_weight)


def _counts(m: DataFrame, group: str, item: str, min_weight: int) -> DataFrame:
    if min_weight > 1:
        often = m.groupBy(item).count().filter(F.col("count") >= min_weight).select(item)
        m = durable(m.join(often, item, "left_semi"))
    every = _meetings(m, group)
    if _tiled(m, item, every):
        return tiled_pairs(m, group, item, min_weight).select("a", "b", "weight")
    if min_weight == 1:
        return group_pairs(m, group, item).groupBy("a", "b").agg(F.count("*").alias("weight"))
    sized = m.join(m.groupBy(group).agg(F.count("*").alias("__n")), group)
    largest_first = Window.partitionBy(item).orderBy(F.desc("__n"), group)
    probe = durable(sized.withColumn("__r", F.row_number().over(largest_first)).filter(F.col("__r") >= min_weight).select(group, item))
    if every <= _DIRECT * _meetings(probe, group):
        return group_pairs(m, group, item).groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_weight)
    candidates = group_pairs(probe, group, item).select("a", "b").distinct()
    left = m.select(F.col(item).alias("a"), group)
    right = m.select(F.col(item).alias("b"), group)
    return (
        candidates.join(left, "a").join(right, ["b", group])
        .groupBy("a", "b").agg(F.count("*").alias("weight"))
        .filter(F.col("weight") >= min_weight)
    )


def sized_pairs(members: DataFrame, group: str, item: str, min_weight: int = 1, larger_first: bool = False) -> DataFrame:
    """(a, b, weight, na, nb): the pairs of ``shared_group_counts`` with the number of groups of both items.

    ``a`` is the smaller item, with ``larger_first`` the one in more groups and
    of equals the smaller one.
    """
    m = durable(members.select(group, item))
    places = item_classes(m, group, item)
    if places is not None:
        found = _sized(_representatives(m, places, item), group, item, min_weight, larger_first)
        return _expanded(found, places, item, min_weight, larger_first)
    return _sized(m, group, item, min_weight, larger_first)


def sized_pairs_and_kinds(members: DataFrame, group: str, item: str, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """``sized_pairs`` and (weight, na, nb, times): how many of the pairs have these numbers.

    Where items have the same groups, kinds are counted from the pairs of
    classes and class sizes, so pairs of items are formed once, for the result.
    """
    m = durable(members.select(group, item))
    places = item_classes(m, group, item)
    if places is None:
        found = _sized(m, group, item, min_weight, False)
        return found, durable(found.groupBy("weight", "na", "nb").agg(F.count("*").alias("times")))
    found = durable(_sized(_representatives(m, places, item), group, item, min_weight, False))
    sizes = places.filter("item = class").select(F.col("class").alias("a"), F.col("size").alias("sa"))
    both = found.join(sizes, "a").join(sizes.select(F.col("a").alias("b"), F.col("sa").alias("sb")), "b").select("weight", "na", "nb", (F.col("sa") * F.col("sb")).alias("times"))
    alike = _within(places, min_weight).join(sizes, "a").select("weight", "na", "nb", (F.col("sa") * (F.col("sa") - 1) / 2).cast("long").alias("times"))
    kinds = durable(both.unionByName(alike).groupBy("weight", "na", "nb").agg(F.sum("times").alias("times")))
    return _expanded(found, places, item, min_weight), kinds


def _sized(m: DataFrame, group: str, item: str, min_weight: int, larger_first: bool) -> DataFrame:
    if _tiled(m, item, _meetings(m, group)):
        return tiled_pairs(m, group, item, min_weight, larger_first)
    n = m.groupBy(item).agg(F.count("*").alias("n"))
    placed = _counts(m, group, item, min_weight).join(n.select(F.col(item).alias("a"), F.col("n").alias("na")), "a").join(
        n.select(F.col(item).alias("b"), F.col("n").alias("nb")), "b"
    )
    # a is the smaller item here
    turn = F.col("nb") > F.col("na") if larger_first else F.lit(False)
    one, two = F.struct(F.col("a").alias("id"), F.col("na").alias("n")), F.struct(F.col("b").alias("id"), F.col("nb").alias("n"))
    ends = placed.select("weight", F.when(turn, two).otherwise(one).alias("x"), F.when(turn, one).otherwise(two).alias("y"))
    return ends.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "weight", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def item_classes(members: DataFrame, group: str, item: str, always: bool = False) -> DataFrame | None:
    """(item, class, n, own, size) of items that have the same groups, or None where classes are not half as many as the items, but for ``always``.

    A class is named by its smallest item; ``n`` counts its rows, ``own`` its
    groups without null, ``size`` its items. Sets are compared by their size and
    two 64-bit digests. Items of a class meet all others alike, so pairs are
    counted between classes and copied to the items only where the result has them.
    """
    g = F.col(group)
    sets = members.groupBy(F.col(item).alias("item")).agg(
        F.count("*").alias("n"), F.count(g).alias("own"), F.bit_xor(F.xxhash64(g)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), g)).alias("y")
    )
    keys = ["n", "own", "x", "y"]
    sets = durable(sets)
    named = sets.groupBy(*keys).agg(F.min("item").alias("class"), F.count("*").alias("size"))
    items, classes = named.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if 2 * classes > items and not always:
        return None
    return durable(sets.join(named, keys).select("item", "class", "n", "own", "size"))


def _representatives(members: DataFrame, places: DataFrame, item: str) -> DataFrame:
    return durable(members.join(places.filter("item = class").select(F.col("item").alias(item)), item, "left_semi"))


def _within(places: DataFrame, min_weight: int) -> DataFrame:
    """Each class of several items that meet each other, as a pair with itself."""
    c = places.filter((F.col("item") == F.col("class")) & (F.col("size") > 1) & (F.col("own") >= max(min_weight, 1)))
    return c.select(F.col("class").alias("a"), F.col("class").alias("b"), F.col("own").alias("weight"), F.col("n").alias("na"), F.col("n").alias("nb"))


def _expanded(pairs: DataFrame, places: DataFrame, item: str, min_weight: int, larger_first: bool = False) -> DataFrame:
    """Pairs of items from those of classes: lists of items are joined and unfolded in the row, so no pair of items is shuffled."""
    sized = {"na", "nb"} <= set(pairs.columns)
    columns = ["a", "b", "weight", *(["na", "nb"] if sized else [])]
    parts = F.pmod(F.xxhash64(F.lit(2), "item"), F.ceil(F.col("size") / _BLOCK))
    lists = places.groupBy("class", parts.alias("part")).agg(F.collect_list("item").alias("items"))
    every = pairs.select(*columns).unionByName(_within(places, min_weight).select(*columns))
    rows = every.join(lists.select(F.col("class").alias("a"), F.col("items").alias("xs")), "a").join(lists.select(F.col("class").alias("b"), F.col("items").alias("ys")), "b")
    rows = rows.select(*columns, F.explode("xs").alias("x"), "ys").select(*columns, "x", F.explode("ys").alias("y")).filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    # the counts of a pair are in the right order, so only equals may be turned
    turn = F.col("y") < F.col("x")
    if larger_first:
        turn = turn & (F.col("na") == F.col("nb"))
    back = turn & F.lit(not larger_first)
    sizes = [F.when(back, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(back, F.col("na")).otherwise(F.col("nb")).alias("nb")] if sized else []
    return rows.select(F.when(turn, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turn, F.col("x")).otherwise(F.col("y")).alias("b"), "weight", *sizes)


def shared_degrees(members: DataFrame, group: str, item: str, min_weight: int = 1) -> DataFrame:
    """(node, degree): how many other items share at least ``min_weight`` groups with each item that has one; pairs are not written out."""
    m = durable(members.select(group, item))
    places = item_classes(m, group, item)
    ends = F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other")), F.struct(F.col("b").alias("class"), F.col("a").alias("other")))).alias("e")
    if places is None:
        return _counted(m, group, item, min_weight).select(ends).groupBy(F.col("e.class").alias("node")).agg(F.count("*").alias("degree"))
    found = _counted(_representatives(m, places, item), group, item, min_weight)
    sizes = places.filter("item = class").select(F.col("class").alias("other"), "size")
    near = found.select(ends).select("e.*").join(sizes, "other").groupBy("class").agg(F.sum("size").alias("near"))
    alike = F.when(F.col("own") >= max(min_weight, 1), F.col("size") - 1).otherwise(0)
    degrees = places.join(near, "class", "left").select(F.col("item").alias("node"), (F.coalesce("near", F.lit(0)) + alike).alias("degree"))
    return degrees.filter("degree > 0")


def _counted(m: DataFrame, group: str, item: str, min_weight: int) -> DataFrame:
    return _counts(m, group, item, min_weight).select("a", "b")


def strongest_pairs(members: DataFrame, group: str, item: str, min_weight: int, k: int) -> DataFrame:
    """(a, b, weight, na, nb) like ``sized_pairs`` with the larger first, where b is among the ``k`` strongest neighbours of a.

    Neighbours are ranked by weight, number of groups and then as items. Between
    classes of items, the first k + 1 of k + 1 classes are enough for all items of a class.
    """
    def turned(pairs):
        return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", F.col("nb").alias("na"), F.col("na").alias("nb")))

    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    order = [F.desc("weight"), F.desc("nb"), F.asc("b")]
    m = durable(members.select(group, item))
    places = item_classes(m, group, item)
    if places is None:
        return top_per_group(turned(_sized(m, group, item, min_weight, True)), ["a"], k, *order, name="k").filter(larger).drop("k")
    found = turned(_sized(_representatives(m, places, item), group, item, min_weight, True)).unionByName(_within(places, min_weight))
    classes = top_per_group(found, ["a"], k + 1, *order, name="k").drop("k")
    first = top_per_group(places.select(F.col("class").alias("c"), "item"), ["c"], k + 1, F.asc("item"), name="k").select(F.col("c").alias("b"), "item")
    ranked = top_per_group(classes.join(first, "b").drop("b").withColumnRenamed("item", "b"), ["a"], k + 1, *order, name="k")
    lists = ranked.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("k", "b", "weight", "nb"))).alias("l"))
    rows = places.join(lists, F.col("class") == F.col("a")).select(F.col("item").alias("a"), F.col("n").alias("na"), F.explode(F.slice(F.expr("filter(l, e -> e.b <> item)"), 1, k)).alias("e"))
    return rows.select("a", F.col("e.b").alias("b"), F.col("e.weight").alias("weight"), "na", F.col("e.nb").alias("nb")).filter(larger)


def _blocks(items: int) -> int:
    return max(_BLOCKS, -(-items // _TILE))


def _tiled(members: DataFrame, item: str, meetings: int) -> bool:
    """Whether the pairs that meet outnumber the copies of the members that tiles need."""
    if meetings <= _TILED_FROM:
        return False
    rows, items = members.agg(F.count("*"), F.count_distinct(item)).first()
    return meetings > rows * _blocks(items)


def tiled_pairs(members: DataFrame, group: str, item: str, min_weight: int = 1, larger_first: bool = False) -> DataFrame:
    """(a, b, weight, na, nb) like ``sized_pairs``, for items that mostly meet: no pair is ever shuffled.

    Items are cut into blocks, and each two blocks are a tile, which gets the
    groups of their items and counts its pairs in one array. So a member is
    copied once per block, and the work is one addition per meeting.
    """
    m = members.select(F.col(group).alias("__group"), F.col(item).alias("__item"))
    n = m.groupBy("__item").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("__item")] if larger_first else [F.asc("__item")]
    items = durable(number_rows(n, *order, name="i", start=0))
    groups = number_rows(m.select("__group").distinct(), F.asc("__group"), name="g", start=0)
    blocks = _blocks(items.count())
    kind = members.schema[item].dataType
    text = "long" if kind == T.LongType() else "string"
    # lists of at most 65,536 groups each
    lists = (
        m.join(items, "__item").join(groups, "__group")
        .groupBy("i", F.col("__item").cast(text).alias("name"), "n", F.expr("shiftright(g, 16)").alias("part")).agg(F.collect_list("g").alias("gs"))
    )
    own, other = F.pmod(F.col("i"), F.lit(blocks)), F.col("other")
    tile = F.least(own, other) * blocks + F.greatest(own, other)
    copies = lists.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other")).select(
        tile.alias("tile"), own.alias("block"), "i", "name", "n", "gs"
    )
    count = blocks * (blocks + 1) // 2
    dealt = copies.repartition(count, "tile").sortWithinPartitions("tile")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            t = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and t[lo] != at:
                    yield from _count_tile(pa.Table.from_batches(held), at // blocks == at % blocks, at // blocks, min_weight)
                    held = []
                at = int(t[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _count_tile(pa.Table.from_batches(held), at // blocks == at % blocks, at // blocks, min_weight)

    found = dealt.mapInArrow(tiles, f"a {text}, b {text}, weight long, na long, nb long")
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "weight", "na", "nb")


def _count_tile(rows: pa.Table, same: bool, first_block: int, min_weight: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the items of two blocks, or of one with itself, each with the lower number first."""
    rows = rows.combine_chunks()
    lists = rows.column("gs").combine_chunks()
    i, left = rows.column("i").to_numpy(), rows.column("block").to_numpy() == first_block
    number, row, item = np.unique(i, return_index=True, return_inverse=True)
    lefts = np.zeros(len(number), bool)
    lefts[item] = left
    # place of an item within its side
    place = np.where(lefts, np.cumsum(lefts), np.cumsum(~lefts)) - 1
    sides = (np.flatnonzero(lefts), np.flatnonzero(lefts if same else ~lefts))
    if not len(sides[0]) or not len(sides[1]):
        return
    member = np.repeat(item, lists.value_lengths().to_numpy())
    group = lists.flatten().to_numpy()
    order = np.argsort(group, kind="stable")
    member, group = member[order], group[order]
    counts = np.zeros((len(sides[0]), len(sides[1])), np.int32)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for of in np.split(member, cuts):
        on_left = lefts[of]
        x = place[of[on_left]]
        y = x if same else place[of[~on_left]]
        if len(x) and len(y):
            counts[np.ix_(x, y)] += 1
    names, n = rows.column("name").combine_chunks().take(pa.array(row)), rows.column("n").to_numpy()[row]
    step = max(1, _BATCH // len(sides[1]))
    for lo in range(0, len(sides[0]), step):
        x, y = np.nonzero(counts[lo : lo + step] >= min_weight)
        w = counts[x + lo, y]
        u, v = sides[0][x + lo], sides[1][y]
        if same:
            keep = u < v
            u, v, w = u[keep], v[keep], w[keep]
        # numbers ascend, so the place among all items of the tile tells the order
        u, v = np.minimum(u, v), np.maximum(u, v)
        if len(u):
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(u)), names.take(pa.array(v)), pa.array(w.astype(np.int64)), pa.array(n[u]), pa.array(n[v])], ["a", "b", "weight", "na", "nb"]
            )


def _meetings(members: DataFrame, group: str) -> int:
    """How many pairs meet in the groups, from their sizes."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n"))
    return int(sizes.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)"))).first()[0] or 0)


def short_list_pairs(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, weight) for groups that are short by nature, such as the tags of one caption.

    One shuffle brings a list together; its pairs are formed in the row and
    counted with map-side combining.
    """
    lists = members.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("l"))
    firsts = lists.select("l", F.posexplode("l").alias("i", "a"))
    return firsts.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("weight"))
