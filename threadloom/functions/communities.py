"""Communities of high modularity: local moves of nodes, then contraction of the graph, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable
from .components import both_ways

_TINY = 1e-9


def _assigned(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, w): the weight between a node and each community around it, itself left out."""
    held = nodes.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    return arcs.join(held, "dst").groupBy(F.col("src").alias("node"), "other").agg(F.round(F.sum("weight"), 9).alias("w"))


def _score(nodes: DataFrame, around: DataFrame, whole: float) -> float:
    """Modularity: the share of weight inside communities less what their degrees would give by chance."""
    own = nodes.join(around, (nodes["node"] == around["node"]) & (nodes["community"] == around["other"]), "left")
    per = own.groupBy("community").agg(F.sum(F.coalesce("w", F.lit(0.0)) + F.col("loop")).alias("inside"), F.sum("degree").alias("degree"))
    return per.agg(F.sum(F.col("inside") / whole - F.pow(F.col("degree") / whole, 2))).first()[0] or 0.0


def _gains(nodes: DataFrame, around: DataFrame, whole: float) -> DataFrame:
    """(node, community, other, gain) of moves that raise the modularity, each taken alone."""
    totals = nodes.groupBy("community").agg(F.sum("degree").alias("total"))
    stay = nodes.join(around.withColumnRenamed("other", "community"), ["node", "community"], "left").join(totals, "community").select(
        "node", "community", "degree", (F.coalesce("w", F.lit(0.0)) - F.col("degree") * (F.col("total") - F.col("degree")) / whole).alias("now")
    )
    to = around.join(totals.select(F.col("community").alias("other"), F.col("total").alias("there")), "other")
    gain = F.col("w") - F.col("degree") * F.col("there") / whole - F.col("now")
    return stay.join(to, "node").filter("other <> community").select("node", "community", "other", (gain / whole).alias("gain")).filter(F.col("gain") > _TINY)


def _best(moves: DataFrame) -> DataFrame:
    """Each node's move of largest gain, of equals to the smallest community."""
    top = F.min(F.struct((-F.round("gain", 12)).alias("loss"), "other", "community", "gain")).alias("m")
    return moves.groupBy("node").agg(top).select("node", "m.community", "m.other", "m.gain")


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch one community, the largest gains first: their gains add up exactly."""
    ends = moves.select("node", "gain", F.explode(F.array("community", "other")).alias("touched"))
    first = F.row_number().over(Window.partitionBy("touched").orderBy(F.desc("gain"), "node"))
    free = ends.withColumn("r", first).groupBy("node").agg(F.max("r").alias("r")).filter("r = 1").select("node")
    return moves.join(free, "node", "left_semi")


def _moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    to = moves.select("node", F.col("other").alias("__to"))
    both = nodes.join(to, "node", "left").withColumn("moved", F.col("__to").isNotNull())
    return both.withColumn("community", F.coalesce("__to", "community")).drop("__to")


def _tried(arcs: DataFrame, nodes: DataFrame, moves: DataFrame, whole: float) -> tuple[DataFrame, DataFrame, float, int]:
    """Nodes after the moves, what is around them, the modularity and how many moved."""
    both = durable(_moved(nodes, moves))
    moved = both.filter("moved").count()
    tried = both.drop("moved")
    if not moved:
        return tried, both, 0.0, 0
    seen = durable(_assigned(arcs, tried))
    return tried, seen, _score(tried, seen, whole), moved


def modularity_communities(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, community, levels, converged): communities named by their smallest node, of locally best modularity.

    Edges (src, dst, weight) are undirected, weights positive, 1 without the
    column; parallel edges add up, a loop counts twice in its node's degree.
    Every node starts alone. In a round all nodes see the gain of moving to
    each community around them. Those that lead up an order of the communities,
    by a hash that changes from round to round, are made together, so two nodes
    cannot swap; the round stands if the modularity rose. Where it did not, or
    no move leads up, only moves that touch different communities are made, whose gains add up, so every round raises the
    modularity. Without a raising move communities become nodes, their inner
    weight loops, and the next level begins; a level without a move is the
    last. Ties go to the larger gain, then the smaller name: the result does
    not depend on partitions. ``max_rounds`` bounds the rounds of all levels;
    where it ends them ``converged`` is false in every row. Rounds run on the
    edge table and are written durably.
    """
    both = both_ways(edges).filter(F.col("weight") > 0)
    arcs = durable(both.filter("src <> dst").groupBy("src", "dst").agg(F.round(F.sum("weight"), 9).alias("weight")))
    loops = both.filter("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("loop"))
    links = arcs.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("links"))
    nodes = links.join(loops, "node", "full").select(
        "node", F.coalesce("loop", F.lit(0.0)).alias("loop"), (F.coalesce("links", F.lit(0.0)) + F.coalesce("loop", F.lit(0.0))).alias("degree"), F.col("node").alias("community")
    )
    nodes = durable(nodes)
    whole = nodes.agg(F.sum("degree")).first()[0] or 1.0
    homes = nodes.select("node", "community")
    rounds, levels, converged = 0, 0, False
    while not converged and (max_rounds is None or rounds < max_rounds):
        around = durable(_assigned(arcs, nodes))
        score, merged = _score(nodes, around, whole), False
        while max_rounds is None or rounds < max_rounds:
            rank = lambda c: F.xxhash64(c, F.lit(rounds))
            better = _gains(nodes, around, whole)
            tried, seen, reached, moved = _tried(arcs, nodes, _best(better.filter(rank("other") > rank("community"))), whole)
            if not moved or reached <= score + _TINY:
                tried, seen, reached, moved = _tried(arcs, nodes, _apart(_best(better)), whole)
                if not moved:
                    break
            rounds, merged = rounds + 1, True
            nodes, around, score = tried, seen, reached
        converged = not merged
        if merged:
            levels += 1
            up = nodes.select("node", "community")
            homes = durable(homes.join(up.select(F.col("node").alias("community"), F.col("community").alias("__up")), "community").select("node", F.col("__up").alias("community")))
            ends = arcs.join(up.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(up.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
            joined = durable(ends.groupBy("a", "b").agg(F.round(F.sum("weight"), 9).alias("weight")))
            inner = joined.filter("a = b").select(F.col("a").alias("community"), F.col("weight").alias("inner"))
            size = nodes.groupBy("community").agg(F.sum("loop").alias("loop"), F.sum("degree").alias("degree"))
            nodes = durable(size.join(inner, "community", "left").select(F.col("community").alias("node"), (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"), "degree", "community"))
            arcs = durable(joined.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"))
    name = homes.groupBy("community").agg(F.min("node").alias("name"))
    return durable(homes.join(name, "community").select("node", F.col("name").alias("community"), F.lit(levels).alias("levels"), F.lit(converged).alias("converged")))
