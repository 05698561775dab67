"""Helpers against brute force on small data."""

import hashlib
import hmac
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import components, pairs
from threadloom.functions.components import betweenness, connected_components, eigenvector_centrality
from threadloom.functions.numbering import number_rows
from threadloom.functions.pairs import shared_group_counts
from threadloom.functions.quantiles import exact_percentiles, grid_cell
from threadloom.operators.quality import keyed_pseudonym
from threadloom.plans.registry import six_places


def test_percentiles_match_linear_interpolation(spark):
    rng = random.Random(1)
    groups = {"big": [rng.choice([0, 1, 5, rng.random() * 100]) for _ in range(30000)], "tiny": [3.0], "three": [1.0, 2.0, 10.0], None: [4.0, 8.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("tiny", None)], "g string, v double")
    got = {r.g: (r.q1, r.q9) for r in exact_percentiles(df, ["g"], {"q1": (F.col("v"), 0.25), "q9": (F.col("v"), 0.9)}).collect()}
    for g, vs in groups.items():
        assert np.allclose(got[g], np.percentile(vs, [25, 90])), g


def test_percentiles_broadcast_no_exploded_rows(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v")).write.parquet(str(tmp_path / "t"))
    wanted = {f"q{k}": (F.col("v"), k / 10) for k in range(1, 4)}
    plan = exact_percentiles(spark.read.parquet(str(tmp_path / "t")), ["g"], wanted)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    # the rows are the left side; a broadcast of the left would gather them in the driver
    assert len(joins) == 2 and not any("BuildLeft" in line for line in joins), joins


def test_shared_groups_with_a_hot_group(spark):
    rng = random.Random(2)
    members = {("hot", f"u{i}") for i in range(40)} | {(f"g{rng.randrange(15)}", f"u{rng.randrange(40)}") for _ in range(120)}
    df = spark.createDataFrame(sorted(members), "g string, u string")
    by_user = {}
    for g, u in members:
        by_user.setdefault(u, set()).add(g)
    for w in (1, 2, 3):
        want = {(a, b): len(by_user[a] & by_user[b]) for a, b in itertools.combinations(sorted(by_user), 2) if len(by_user[a] & by_user[b]) >= w}
        got = {(r.a, r.b): r.weight for r in shared_group_counts(df, "g", "u", w).collect()}
        assert got == want, w


def test_components_of_a_long_chain(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x2", "x1"), ("x3", "x2")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert len(got) == 64
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and {got[x] for x in ("x1", "x2", "x3")} == {"x1"}


def brute_betweenness(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        paths, frontier = [], [[s]]
        while frontier and not paths:
            frontier = [p + [n] for p in frontier for n in near[p[-1]] if n not in p]
            paths = [p for p in frontier if p[-1] == t]
        for p in paths:
            for v in p[1:-1]:
                score[v] += 1 / len(paths)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_centralities(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "f"), ("c", "f")]
    nodes = sorted({x for e in edges for x in e})
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.betweenness for r in betweenness(df).collect()}
    want = brute_betweenness(nodes, edges)
    assert all(abs(got[n] - want[n]) < 1e-9 for n in nodes)
    m = np.zeros((6, 6))
    for a, b in edges:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = 1
    vec = np.abs(np.linalg.eigh(m)[1][:, -1])
    eig = {r.node: r.eigenvector for r in eigenvector_centrality(df).collect()}
    assert np.allclose([eig[n] for n in nodes], vec, atol=1e-4)


def test_numbering_and_keyed_digest(spark):
    ids = [f"id{i * 7 % 500:03d}" for i in range(500)]
    got = {r.id: r.n for r in number_rows(spark.createDataFrame([(i,) for i in ids], "id string"), "id").collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids), 1)}
    for salt in ("pepper", "x" * 90):
        row = spark.createDataFrame([("ünï",)], "id string").select(keyed_pseudonym("id", salt).alias("p")).first()
        assert row.p == hmac.new(salt.encode(), "ünï".encode(), hashlib.sha256).hexdigest()[:24]


@pytest.mark.parametrize("hot", [False, True])
def test_percentiles_of_a_hot_group(spark, hot):
    """One group with 90 % of the rows, broadcasts off, against numpy."""
    r = random.Random(4)
    values = [r.choice([0.0, -1.5, 1e-310, 1e301, 7.0, r.gauss(0, 1), r.expovariate(1e-4), 2.0 ** r.randrange(-9, 9), -(2.0 ** r.randrange(5))]) for _ in range(3000)]
    rows = [("big" if i % 10 else "small", v, i % 7 or None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if hot else "10485760")
    try:
        wanted = {"q10": (F.col("x"), 0.1), "median": (F.col("x"), 0.5), "q99": (F.col("x"), 0.99), "y": (F.col("y"), 0.5)}
        got = {r["g"]: r for r in exact_percentiles(df, ["g"], wanted).collect()}
        whole = exact_percentiles(df, [], wanted).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for g in ("big", "small", None):
        own = [(x, y) for k, x, y in rows if g in (k, None)]
        row = got[g] if g else whole[0]
        for name, p in (("q10", 0.1), ("median", 0.5), ("q99", 0.99)):
            assert np.isclose(row[name], np.quantile([x for x, _ in own], p), rtol=1e-12), (g, name)
        assert row["y"] == np.median([y for _, y in own if y])
    assert len(whole) == 1


def test_grid_cells_never_fall(spark):
    r = random.Random(1)
    xs = sorted({0.0, 1e-320, 1e308, -1e308, *(s * 2.0**k * (1 + d) for s in (1, -1) for k in range(-40, 60) for d in (-1e-15, 0.0, 1e-15, r.random()))})
    cells = [c for _, c in sorted((r["x"], r["c"]) for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", grid_cell(F.col("x")).alias("c")).collect())]
    assert cells == sorted(cells)


@pytest.mark.parametrize("min_weight", [1, 2, 3])
def test_tiles_count_dense_pairs_without_a_shuffle_of_pairs(spark, monkeypatch, min_weight):
    monkeypatch.setattr(pairs, "_TILED_FROM", 0)
    monkeypatch.setattr(pairs, "_BLOCKS", 3)
    rng = random.Random(4)
    members = {(f"v{rng.randrange(12)}", f"u{rng.randrange(40)}") for _ in range(300)}
    of = {u: {g for g, x in members if x == u} for _, u in members}
    df = spark.createDataFrame(sorted(members), "g string, u string")
    want = {(a, b): len(of[a] & of[b]) for a, b in itertools.combinations(sorted(of), 2) if len(of[a] & of[b]) >= min_weight}
    found = shared_group_counts(df, "g", "u", min_weight)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert {(r.a, r.b): r.weight for r in found.collect()} == want
    busier = lambda a, b: (a, b) if (-len(of[a]), a) < (-len(of[b]), b) else (b, a)
    turned = {(*busier(a, b), w, *[len(of[x]) for x in busier(a, b)]) for (a, b), w in want.items()}
    assert {tuple(r) for r in pairs.sized_pairs(df, "g", "u", min_weight, larger_first=True).collect()} == turned
    monkeypatch.setattr(pairs, "_TILED_FROM", 10**9)
    assert {tuple(r) for r in pairs.sized_pairs(df, "g", "u", min_weight, larger_first=True).collect()} == turned


def test_betweenness_rows_and_copies(spark, monkeypatch):
    # blocks of nodes and slices of sources smaller than the graph; no frame has a row per source and node
    edges = [(f"n{i}", f"n{j}") for i in range(24) for j in range(i + 1, 24) if (i * j + i + j) % 5 < 2]
    nodes = sorted({x for e in edges for x in e})
    # n3~1 is a twin of n3: linked with it and with all its neighbours
    twice = edges + [("n3", "n3~1")] + [(x, "n3~1") for e in edges if "n3" in e for x in e if x != "n3"]
    want = brute_betweenness(nodes + ["n3~1"], twice)
    frames, held = [], components.durable

    def counting(frame):
        out = held(frame)
        if {"s", "node", "paths"} <= set(out.columns):
            frames.append(out.count())
        return out

    monkeypatch.setattr(components, "durable", counting)
    monkeypatch.setattr(components, "_BLOCK", 10)
    df = spark.createDataFrame(edges, "src string, dst string")
    copies = spark.createDataFrame([(x, 2 if x == "n3" else 1) for x in nodes], "node string, copies long")
    got = betweenness(df, copies=copies).collect()
    assert {r.node for r in got} == set(nodes) and {r.n for r in got} == {len(nodes) + 1}
    assert all(abs(r.betweenness - want[r.node]) < 1e-12 for r in got) and abs(want["n3"] - want["n3~1"]) < 1e-12
    assert max(frames) == len(nodes)


@pytest.mark.parametrize("min_weight", [1, 2, 3])
def test_items_with_the_same_groups(spark, min_weight, monkeypatch):
    r = random.Random(min_weight)
    sets = [frozenset(r.sample(range(9), r.randrange(1, 6))) for _ in range(7)]
    items = {f"u{i}": sets[i % 7] for i in range(40)}
    counts = {(a, b): len(items[a] & items[b]) for a, b in itertools.combinations(sorted(items), 2)}
    want = {(a, b, w) for (a, b), w in counts.items() if w >= min_weight}
    larger = {((a, b) if (-len(items[a]), a) < (-len(items[b]), b) else (b, a)) + (w,) for a, b, w in want}
    near = {x: sorted(((w, len(items[y]), y) for a, b, w in want if x in (a, b) for y in (a, b) if y != x), key=lambda e: (-e[0], -e[1], e[2])) for x in items}
    df = spark.createDataFrame([(g, u) for u, s in items.items() for g in s], "g long, u string")
    assert pairs.item_classes(df, "g", "u").select("class").distinct().count() == len(set(sets))
    seen, counting = [], pairs._counts
    monkeypatch.setattr(pairs, "_counts", lambda m, *a: seen.append(m.select("u").distinct().count()) or counting(m, *a))
    assert {tuple(x) for x in shared_group_counts(df, "g", "u", min_weight).collect()} == want
    got = pairs.sized_pairs(df, "g", "u", min_weight, larger_first=True).collect()
    assert {(x.a, x.b, x.weight) for x in got} == larger and len(got) == len(larger) and all((x.na, x.nb) == (len(items[x.a]), len(items[x.b])) for x in got)
    got = pairs.sized_pairs(df, "g", "u", min_weight).collect()
    assert {(x.a, x.b, x.weight) for x in got} == want and all((x.na, x.nb) == (len(items[x.a]), len(items[x.b])) for x in got)
    assert {x.node: x.degree for x in pairs.shared_degrees(df, "g", "u", min_weight).collect()} == {x: len(l) for x, l in near.items() if l}
    top = {(a, b, w) for a, b, w in larger if (w, len(items[b]), b) in near[a][:4]}
    assert {(x.a, x.b, x.weight) for x in pairs.strongest_pairs(df, "g", "u", min_weight, 4).collect()} == top
    # only one item of each class is counted
    assert set(seen) == {len(set(sets))}


def test_six_places_are_those_of_round(spark):
    r = random.Random(5)
    xs = [0.0, -0.0, float("nan"), float("inf"), -1e-9, 0.5e-6, 1.5e-6, 2.5e-6, -0.5e-6, 0.0000005000001, 1234567.1234565, 99999.9999995, 1e300, None]
    xs += [s * r.choice([r.random(), r.randrange(1, 10**6) / 2e6, 10 ** r.uniform(-8, 8), 1 / r.randrange(1, 500)]) for _ in range(4000) for s in (1, -1)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(six_places(F.col("x")).alias("a"), (F.round("x", 6) + F.lit(0.0)).alias("b"))
    assert df.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_kinds_of_pairs_of_classes_need_no_pairs_of_items(spark, monkeypatch):
    r = random.Random(9)
    sets = [r.sample(range(9), r.randrange(1, 6)) for _ in range(7)]
    df = spark.createDataFrame([(g, f"u{i}") for i in range(40) for g in sets[i % 7]], "g long, u string")
    want = Counter(tuple(x) for x in pairs.sized_pairs(df, "g", "u").select("weight", "na", "nb").collect())
    got, kinds = pairs.sized_pairs_and_kinds(df, "g", "u")
    unordered = lambda c: Counter({k: n for k, n in ((k, sum(m for o, m in c.items() if (o[0], *sorted(o[1:])) == k)) for k in {(o[0], *sorted(o[1:])) for o in c})})
    assert unordered(Counter({tuple(x)[:3]: x.times for x in kinds.collect()})) == unordered(want)
    assert Counter(tuple(x) for x in got.select("weight", "na", "nb").collect()) == want
