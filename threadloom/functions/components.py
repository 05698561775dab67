"""Iterative graph primitives on edge tables, each round cut off durably."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .numbering import number_rows
from .packed import _WHOLE, MemberGraph, packed_betweenness, packed_eigenvector


def _signature(df: DataFrame):
    return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = 0) -> DataFrame:
    """(node, component) where the component is its smallest node.

    Alternating large-star and small-star rounds: edges shrink to stars in a
    logarithmic number of rounds even for long chains. Nodes without edges are
    not listed. A table of up to ``one_task`` edges stays in one partition,
    where the rounds need no shuffle.
    """
    a, b = F.col(src), F.col(dst)
    e = durable(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    few = one_task > 0 and e.count() <= one_task
    together = lambda df: df.coalesce(1) if few else df
    e, last = together(e), None
    while True:
        both = together(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(together(small.unionByName(low.withColumnRenamed("m", "v"))).distinct())
        now = _signature(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed copies (src, dst, weight) of an undirected edge table."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1)
    e = edges.select("src", "dst", w.cast("double").alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def eigenvector_centrality(edges: DataFrame | MemberGraph, tol: float = 1e-6, max_rounds: int = 1000) -> DataFrame:
    """(node, eigenvector, converged) by power iteration on A + I, unweighted, unit length.

    ``converged`` is false in every row where ``max_rounds`` ended the iteration.
    A graph given by its members is packed; no edge is written as a row.
    """
    if isinstance(edges, MemberGraph):
        return packed_eigenvector(edges.packed, tol, max_rounds)
    arcs = durable(both_ways(edges).select("src", "dst").filter("src <> dst").distinct())
    nodes = arcs.select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    x = durable(nodes.withColumn("x", F.lit(1.0 / max(n, 1))))
    converged = n == 0
    for _ in range(max_rounds if n else 0):
        pulled = arcs.join(x, arcs["src"] == x["node"]).groupBy("dst").agg(F.sum("x").alias("p"))
        raw = x.join(pulled, x["node"] == pulled["dst"], "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("p", F.lit(0.0))).alias("y"))
        norm = F.sqrt(raw.agg(F.sum(F.col("y") * F.col("y"))).scalar())
        x = durable(raw.select("node", "old", (F.col("y") / norm).alias("x")))
        moved = x.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]
        x = x.drop("old")
        if moved < n * tol:
            converged = True
            break
    return x.select("node", F.col("x").alias("eigenvector"), F.lit(converged).alias("converged"))


# sources in a slice, nodes in a block of a betweenness round
_SLICE, _BLOCK = 256, 1024
_STATE = "s long, node long, copies long, dist binary, paths binary, flow binary, depths array<int>"
_COLUMNS = ["s", "node", "copies", "dist", "paths", "flow", "depths"]


def _held(rows, column: str, kind=np.float64) -> np.ndarray:
    """One row of numbers, one for each source of the slice, per row of the frame."""
    return np.frombuffer(b"".join(rows[column]), kind).reshape(len(rows), -1)


def _state(rows, dist, paths, flow):
    out = rows[["s", "node", "copies"]].copy()
    for column, values in (("dist", dist), ("paths", paths), ("flow", flow)):
        out[column] = [v.tobytes() for v in values]
    out["depths"] = [np.unique(v[v >= 0]) for v in dist]
    return out


def _beginning(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nothing is reached yet but the sources themselves."""
    for rows in frames:
        dist = np.full((len(rows), _SLICE), -1, np.int32)
        paths = np.zeros((len(rows), _SLICE))
        own = np.flatnonzero(rows["place"].notna())
        at = rows["place"].to_numpy()[own].astype(int)
        dist[own, at], paths[own, at] = 0, 1.0
        yield _state(rows, dist, paths, np.zeros_like(paths))


def _pulled(own, near, links, values: np.ndarray) -> np.ndarray:
    """For each row of ``own`` the sum of the ``values`` of the rows of ``near`` it has links from."""
    out = np.zeros((len(own), values.shape[1]))
    order = np.argsort(near["node"].to_numpy(), kind="stable")
    names, values = near["node"].to_numpy()[order], values[order]
    to = np.argsort(own["node"].to_numpy(), kind="stable")
    u, v = links["u"].to_numpy(), links["v"].to_numpy()
    x, y = np.searchsorted(names, u), np.searchsorted(own["node"].to_numpy()[to], v)
    x[x == len(names)] = 0
    here = names[x] == u
    x, y = x[here], to[y[here]]
    for lo in range(0, len(names), _BLOCK):
        part = (x >= lo) & (x < lo + _BLOCK)
        if part.any():
            matrix = np.zeros((len(own), min(_BLOCK, len(names) - lo)))
            matrix[y[part], x[part] - lo] = 1.0
            out += matrix @ values[lo : lo + _BLOCK]
    return out


def _forward(depth: int):
    def reach(own, near, links):
        dist, paths = _held(own, "dist", np.int32).copy(), _held(own, "paths").copy()
        # a path starts from one copy of its source and may pass any copy of the nodes after it
        times = near["copies"].to_numpy(float)[:, None] if depth else 1.0
        found = _pulled(own, near, links, np.where(_held(near, "dist", np.int32) == depth, _held(near, "paths") * times, 0.0))
        new = (dist < 0) & (found > 0)
        dist[new], paths[new] = depth + 1, found[new]
        return _state(own, dist, paths, _held(own, "flow"))

    return reach


def _backward(depth: int):
    def flow_back(own, near, links):
        dist, paths, flow = _held(own, "dist", np.int32), _held(own, "paths"), _held(own, "flow").copy()
        below = _held(near, "dist", np.int32) == depth + 1
        share = near["copies"].to_numpy(float)[:, None] * (1.0 + _held(near, "flow")) / np.where(below, _held(near, "paths"), 1.0)
        gained = _pulled(own, near, links, np.where(below, share, 0.0))
        flow[dist == depth] = (paths * gained)[dist == depth]
        return _state(own, dist, paths, flow)

    return flow_back


def _slices(df: DataFrame, slices: int) -> DataFrame:
    return df.sparkSession.range(slices).select(F.col("id").alias("s"))


def _round(state: DataFrame, links: DataFrame, slices: int, blocks: int, depth: int, work) -> DataFrame:
    """One level for all sources of a batch: a task has the links into a block of nodes and one slice of sources.

    Nodes that ``depth`` concerns are copied to all blocks; the others stay as they are.
    """
    block = F.pmod("node", F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    near = state.filter(F.array_contains("depths", depth)).select("*", every.alias("block"), F.lit(False).alias("own"))
    rows = state.select("*", block.alias("block"), F.lit(True).alias("own")).unionByName(near).groupBy("s", "block")
    arcs = links.crossJoin(_slices(state, slices)).withColumn("block", F.pmod("v", F.lit(blocks))).groupBy("s", "block")

    def step(rows, arcs):
        own, near = rows[rows["own"]], rows[~rows["own"]]
        return work(own, near, arcs) if len(near) and len(arcs) else own[_COLUMNS]

    return durable(rows.cogroup(arcs).applyInPandas(step, _STATE))


def _dependencies(links: DataFrame, nodes: DataFrame, sources: DataFrame, slices: int, blocks: int) -> DataFrame:
    """(i, d): the summed dependencies of a batch of sources on each node.

    All sources of the batch advance one level per round; a row holds a node's
    distances, path counts and dependencies for a slice of sources, so there
    are slices times nodes rows, written durably. Then dependencies flow back.
    """
    placed = nodes.select(F.col("i").alias("node"), "copies").crossJoin(_slices(nodes, slices))
    # at most one slice holds a node as a source
    state = durable(placed.join(sources.select(F.col("i").alias("node"), "s", "place"), ["s", "node"], "left").mapInPandas(_beginning, _STATE))
    depth = 0
    while True:
        state = _round(state, links, slices, blocks, depth, _forward(depth))
        if state.filter(F.array_contains("depths", depth + 1)).isEmpty():
            break
        depth += 1
    for d in range(depth - 1, 0, -1):
        state = _round(state, links, slices, blocks, d + 1, _backward(d))
    # each copy of a source sends the same paths
    weights = sources.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("place", "copies"))).alias("of")).select("s", F.col("of.copies").alias("of"))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            sums = [float(np.dot(np.frombuffer(f)[: len(w)], w)) for f, w in zip(rows["flow"], rows["of"])]
            yield pd.DataFrame({"i": rows["node"], "d": sums})

    return state.join(weights, "s").select("node", "flow", "of").mapInPandas(summed, "i long, d double").groupBy("i").agg(F.sum("d").alias("d"))


def betweenness(edges: DataFrame | MemberGraph, k: int | None = None, batch: int = 1000, copies: DataFrame | None = None) -> DataFrame:
    """(node, betweenness, k, n), normalised: exact from all ``n`` nodes unless ``k`` hash-chosen sources are asked for.

    Sources are processed ``batch`` at a time and only sums by node are kept
    between batches. A level is a product of 0/1 blocks of the graph with slices
    of sources, so no arc is ever joined with single sources: a task holds the
    links into one block and a slice of the frontier. With ``copies`` (node,
    copies) a node stands for so many nodes that are linked with each other and
    have the same other neighbours; all have the value given, ``n`` counts all.
    Of a graph given by its members items with the same groups are such copies;
    while their classes are few, each task has all links as bits.
    """
    if isinstance(edges, MemberGraph):
        if k is not None or copies is not None:
            raise ValueError("a graph given by its members is taken whole")
        g = edges.packed
        if g.classes <= _WHOLE:
            return packed_betweenness(g)
        rows = betweenness(g.class_edges(), batch=batch, copies=g.class_sizes())
        return g.items.join(rows.withColumnRenamed("node", "c"), "c").select(F.col("item").alias("node"), "betweenness", "k", "n")
    if copies is not None and k is not None:
        raise ValueError("k sources are chosen from single nodes")
    arcs = durable(both_ways(edges).select("src", "dst").filter("src <> dst").distinct())
    found = arcs.select(F.col("src").alias("node")).distinct().withColumn("copies", F.lit(1).cast("long")) if copies is None else copies.select("node", F.col("copies").cast("long"))
    nodes = durable(number_rows(found, "node", name="i", start=0))
    size, n = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    taken = size if k is None else min(k, size)
    k = n if k is None else taken
    sources = nodes if taken >= size else nodes.orderBy(F.xxhash64("node"), "node").limit(taken)
    said = [F.lit(k).cast("long").alias("k"), F.lit(n).cast("long").alias("n")]
    numbered = sources.withColumn("turn", F.col("i")) if taken >= size else durable(number_rows(sources, "i", name="turn", start=0))
    ends = nodes.select("node", "i")
    links = durable(arcs.join(ends.select(F.col("node").alias("src"), F.col("i").alias("u")), "src").join(ends.select(F.col("node").alias("dst"), F.col("i").alias("v")), "dst").select("u", "v"))
    sums, blocks = None, -(-size // _BLOCK)
    for first in range(0, taken, batch):
        own, turn = numbered.filter(F.col("turn").between(first, first + batch - 1)), F.col("turn") - first
        own = own.select("i", "copies", F.floor(turn / _SLICE).alias("s"), F.pmod(turn, F.lit(_SLICE)).alias("place"))
        part = _dependencies(links, nodes, own, -(-min(batch, taken - first) // _SLICE), blocks)
        sums = durable(part if sums is None else sums.unionByName(part).groupBy("i").agg(F.sum("d").alias("d")))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / k if 0 < k < n else 1.0)
    if sums is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"), *said)
    return nodes.join(sums, "i", "left").select("node", F.coalesce(F.col("d") * scale, F.lit(0.0)).alias("betweenness"), *said)


def label_propagation(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, community, converged): every round each node takes the heaviest label around it, until none moves.

    A node's own label counts with its mean edge weight, ties go to the
    smallest label, so the result does not depend on partitioning. Labels that
    still swap after ``max_rounds`` are told by ``converged`` false in every row.
    """
    converged = False
    arcs = durable(both_ways(edges))
    labels = durable(arcs.groupBy(F.col("src").alias("node")).agg(F.avg("weight").alias("own")).withColumn("community", F.col("node")))
    for _ in range(max_rounds):
        votes = (
            arcs.join(labels.select("node", "community"), arcs["dst"] == F.col("node"))
            .select(F.col("src").alias("node"), "community", "weight")
            .unionByName(labels.select("node", "community", F.col("own").alias("weight")))
            .groupBy("node", "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        )
        chosen = votes.groupBy("node").agg(F.max("w").alias("w")).join(votes, ["node", "w"]).groupBy("node").agg(F.min("community").alias("next"))
        new = durable(labels.join(chosen, "node").select("node", "own", "community", "next"))
        moved = new.filter("community <> next").count()
        labels = new.select("node", "own", F.col("next").alias("community"))
        if moved == 0:
            converged = True
            break
    return labels.select("node", "community", F.lit(converged).alias("converged"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Per community: nodes, weight inside, weight touching, modularity share; total in every row."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1)
    e = edges.select("src", "dst", w.cast("double").alias("weight"))
    c = communities.select("node", "community")
    tagged = e.join(c.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src").join(
        c.select(F.col("node").alias("dst"), F.col("community").alias("cb")), "dst"
    )
    inside = tagged.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("weight_inside"))
    touching = both_ways(edges).join(c, F.col("src") == F.col("node")).groupBy("community").agg(F.sum("weight").alias("weight_touching"))
    size = c.groupBy("community").agg(F.count("*").alias("nodes"))
    m = e.agg(F.sum("weight")).scalar()
    out = size.join(touching, "community").join(inside, "community", "left").withColumn("weight_inside", F.coalesce("weight_inside", F.lit(0.0)))
    return out.withColumn("modularity", F.col("weight_inside") / m - F.pow(F.col("weight_touching") / (2 * m), 2))
