"""Iterative and search algorithms against plain versions on small inputs."""

import itertools
import json
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.functions import automaton, components, pairs, text
from threadloom.functions.communities import modularity_communities
from threadloom.functions.components import betweenness, label_propagation, modularity
from threadloom.operators import classify, graph, media, quality, topics
from threadloom.sources import discussions


# communities


def plain_modularity(edges, home):
    whole = 2 * sum(w for *_, w in edges)
    inside, degree = Counter(), Counter()
    for a, b, w in edges:
        degree[home[a]] += w
        degree[home[b]] += w
        if home[a] == home[b]:
            inside[home[a]] += 2 * w
    return sum(inside[c] / whole - (degree[c] / whole) ** 2 for c in degree)


def planted(seed, groups, size, inner, outer):
    r = random.Random(seed)
    nodes = [f"n{g}-{i}" for g in range(groups) for i in range(size)]
    edges = []
    for a, b in itertools.combinations(nodes, 2):
        if r.random() < (inner if a.split("-")[0] == b.split("-")[0] else outer):
            edges.append((a, b, float(r.randrange(1, 4))))
    return edges


def test_communities_are_planted_ones_and_locally_best(spark):
    edges = planted(3, 3, 8, 0.8, 0.05)
    df = spark.createDataFrame(edges, "src string, dst string, weight double").repartition(5)
    rows = modularity_communities(df).collect()
    home = {r.node: r.community for r in rows}
    assert all(r.converged for r in rows) and len(rows) == len(home)
    together = defaultdict(set)
    for node, c in home.items():
        together[c].add(node)
    assert sorted(map(sorted, together.values())) == sorted(sorted(f"n{g}-{i}" for i in range(8)) for g in range(3))
    assert all(c == min(members) for c, members in together.items())
    found = plain_modularity(edges, home)
    told = modularity(df, spark.createDataFrame(list(home.items()), "node string, community string")).agg(F.sum("modularity")).first()[0]
    assert abs(found - told) < 1e-9


def test_modularity_is_no_less_than_that_of_label_propagation(spark):
    edges = planted(1, 3, 5, 0.6, 0.15)
    df = spark.createDataFrame(edges, "src string, dst string, weight double").coalesce(1)
    home = {r.node: r.community for r in modularity_communities(df).collect()}
    found = plain_modularity(edges, home)
    labels = {r.node: r.community for r in label_propagation(df).collect()}
    assert found >= plain_modularity(edges, labels) - 1e-9
    # joining two communities never raises the modularity
    for a, b in itertools.combinations(sorted(set(home.values())), 2):
        assert plain_modularity(edges, {n: (a if c == b else c) for n, c in home.items()}) <= found + 1e-9
    assert {r.converged for r in modularity_communities(df, max_rounds=1).collect()} == {False}


def test_communities_of_loops_and_of_nothing(spark):
    loops = spark.createDataFrame([("a", "a", 2.0), ("a", "b", 1.0), ("b", "a", 1.0), ("c", "c", 1.0)], "src string, dst string, weight double")
    assert {(r.node, r.community) for r in modularity_communities(loops).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert modularity_communities(loops.limit(0)).collect() == []


def test_tag_communities_use_the_strongest_edges(spark):
    nodes = spark.createDataFrame([(t, n) for n, t in enumerate("abcdefg", 1)], "hashtag string, count long")
    pairs = [("a", "b", 9), ("b", "c", 8), ("a", "c", 7), ("d", "e", 6), ("e", "f", 5), ("c", "d", 1)]
    edges = spark.createDataFrame([(*p, 0.5) for p in pairs], "source string, target string, weight long, jaccard double")
    rows = {r.hashtag: (r.cluster_id, r.cluster_size, r.cluster_label_suggestion) for r in graph.tag_communities(nodes, edges, top_edges=5).collect()}
    assert rows == {**{t: (1, 3, "f, e, d") for t in "def"}, "g": (2, 1, "g"), **{t: (3, 3, "c, b, a") for t in "abc"}}


# betweenness


def test_betweenness_in_batches(spark, monkeypatch):
    r = random.Random(4)
    edges = list({tuple(sorted(r.sample(range(18), 2))) for _ in range(50)})
    df = spark.createDataFrame(edges, "src long, dst long")
    whole = {x.node: x.betweenness for x in betweenness(df).collect()}
    frames, held = [], components.durable

    def counting(frame):
        out = held(frame)
        if {"s", "node", "paths"} <= set(out.columns):
            frames.append(out.count())
        return out

    monkeypatch.setattr(components, "durable", counting)
    parts = {x.node: x.betweenness for x in betweenness(df, batch=6).collect()}
    assert parts.keys() == whole.keys() and all(abs(parts[n] - whole[n]) < 1e-12 for n in whole)
    assert max(frames) <= 6 * len(whole) < len(whole) ** 2 / 2


# languages


def test_languages_by_lookup_and_by_join(spark):
    texts = [("en", "The cat and the dog sat on the mat"), ("de", "Der Hund und die Katze saßen auf der Matte"), ("fr", "Le chien et le chat étaient sur le tapis")]
    labelled = spark.createDataFrame(texts, "language string, text string")
    profiles = quality.language_profiles(labelled)
    df = spark.createDataFrame([(1, "the dog"), (2, "die Katze"), (3, "étaient"), (4, None), (5, "12 !!"), (6, ""), (7, "zzqx"), (8, "a " * 5000 + "und die")], "id long, text string")
    looked = {r.id: r.detected for r in quality.detect_language(df, profiles, "id").collect()}
    joined = {r.id: r.detected for r in quality.detect_language(df, profiles, "id", lookup_cells=0).collect()}
    assert looked == joined
    assert [looked[i] for i in (1, 2, 3, 4, 5, 6, 7)] == ["en", "de", "fr", "unknown", "unknown", "unknown", "unknown"]


def test_trigrams_stand_inside_words(spark):
    got = spark.createDataFrame([("Ab c, dé\n\nx1y",), ("",), ("  ",)], "t string").select(quality.trigrams("t").alias("g")).collect()
    assert [r.g for r in got] == [[" ab", "ab ", " c ", " dé", "dé ", " x ", " y "], [], []]


# refrains


def plain_refrain(texts, similar, min_words=6, min_lines=2, single=8):
    """Label by the first line alike, then every block of every length."""
    label = [next((j for j in range(i) if similar(texts[i], texts[j])), i) for i in range(len(texts))]
    words = [max(1, len(t.split(" "))) for t in texts]
    best = None
    for m in range(1, len(texts) // 2 + 1):
        blocks = defaultdict(list)
        for i in range(len(texts) - m + 1):
            at = blocks[tuple(label[i : i + m])]
            if not at or i >= at[-1] + m:
                at.append(i)
        for at in blocks.values():
            used = sum(words[at[0] : at[0] + m])
            if len(at) > 1 and used >= min_words and (m >= min_lines or used >= single):
                best = max(best or ((0,),), ((len(at) * m, m, used, -at[0]), at))
    return best and (best[0][1], best[1])


def lyrics(spark, songs):
    payload = [(k, json.dumps({"phrases": [{"phrase": t, "start_time_in_ms": 1000.0 * i} for i, t in enumerate(lines)]})) for k, lines in songs.items()]
    return media.lyric_lines(spark.createDataFrame(payload, "asset_id string, lyrics string"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_refrains_equal_a_plain_search(spark):
    r = random.Random(7)
    pool = ["we go on and on", "we go on and onn", "never look back again", "oh", "la la la", "la la li", "hold the line my friend of old times gone by", ""]
    songs = {f"s{k}": [r.choice(pool[: r.randrange(1, 9)]) for _ in range(r.randrange(1, 26))] for k in range(40)}
    got = defaultdict(list)
    for x in media.refrain_starts(lyrics(spark, songs)).orderBy("asset_id", "occurrence").collect():
        got[x.asset_id].append((x.lines, x.start_s))
    similar = lambda a, b: a == b or distance(a, b) <= int(0.15 * max(len(a), len(b)) + 1e-9)
    for name, lines in songs.items():
        want = plain_refrain(lines, similar)
        assert got.get(name, []) == ([(want[0], float(i)) for i in want[1]] if want else []), name


def test_refrain_lines_are_compared_by_bytes_as_in_sql(spark):
    # three changed letters of twenty characters are within 0.15 only if each is one byte long
    lines = ["aaaa bbbb cccc dddddd", "aaaa bbbb cccc dddxyz", "aaaa bbbb cccc ddd\u00e9\u00e8\u00ea"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "asset_id string, i int, text string")
    assert {r.i: r.label for r in media.line_labels(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_only_lines_that_share_bytes_are_measured():
    r = random.Random(3)
    pairs_, near = [], []
    for _ in range(600):
        a = "".join(r.choice("ab\u00e9 ") if r.random() < 0.5 else "abc" for _ in range(r.randrange(1, 40)))
        b = list(a)
        for _ in range(r.randrange(9)):
            b[r.randrange(len(b) or 1) : r.randrange(len(b) or 1) + 1] = r.choice(["", "x", "ab"])
            b = b or ["a"]
        b = "".join(b) if r.random() < 0.8 else "".join(r.choice("defgh") for _ in a)
        pairs_.append((a, b, int(0.15 * max(len(a), len(b)) + 1e-9)))
        near.append(distance(a.encode(), b.encode()) <= pairs_[-1][2])
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs_]), pa.array([p[1] for p in pairs_]), pa.array([p[2] for p in pairs_], pa.int32())], ["text", "u", "most"])
    kept = Counter(tuple(x.values()) for b in media._sharing_grams([batch]) for x in b.to_pylist())
    wanted = Counter(p for p, n in zip(pairs_, near) if n)
    assert sum(wanted.values()) > 50 and not wanted - kept and sum(kept.values()) < len(pairs_) - 100


def test_a_lyric_of_two_thousand_equal_lines(spark):
    got = media.refrain_starts(lyrics(spark, {"long": ["sing it all again now"] * 2000})).orderBy("occurrence").collect()
    # every length covers at most all lines; of these the longest block wins
    assert [(x.lines, x.start_s) for x in got] == [(1000, 0.0), (1000, 1000.0)]


# peaks


def plain_peaks(v, factor=1.0):
    n = len(v)
    tops, i = [], 0
    while i < n:
        j = i
        while j + 1 < n and v[j + 1] == v[i]:
            j += 1
        if i > 0 and j + 1 < n and v[i - 1] < v[i] > v[j + 1]:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for t in sorted(tops, key=lambda t: (-v[t], -t)):
        if all(abs(t - k) >= max(1, n // 20) for k in kept):
            kept.append(t)
    spread = (sum(x * x for x in v) / n - (sum(v) / n) ** 2) ** 0.5
    out = set()
    for t in kept:
        low = []
        for side in (range(t, -1, -1), range(t, n)):
            lowest = v[t]
            for k in side:
                if v[k] > v[t]:
                    break
                lowest = min(lowest, v[k])
            low.append(lowest)
        if v[t] - max(low) >= max(1.0, factor * spread) - 1e-9:
            out.add(t)
    return out


def test_peaks_equal_a_plain_search(spark):
    r = random.Random(2)
    series = {f"s{k}": [r.choice([0, 0, 1, 2, 3, 5, 8]) if k % 2 else int(20 * r.random() ** 4) for _ in range(r.randrange(1, 130))] for k in range(25)} | {"one": [3], "flat": [2] * 9, "none": [0, 0, 0]}
    rows = [(s, f"{i:04d}", n) for s, v in series.items() for i, n in enumerate(v)]
    got = defaultdict(dict)
    for x in media.detect_peaks(spark.createDataFrame(rows, "song_id string, period string, n int")).collect():
        got[x.song_id][int(x.period)] = (x.is_peak, x.is_onset, x.is_main_peak)
    for s, v in series.items():
        assert {i for i, f in got[s].items() if f[0]} == plain_peaks(v), s
        usable = len(v) >= 3 and max(v) > 0
        assert [i for i, f in got[s].items() if f[2]] == ([v.index(max(v))] if usable else [])
        assert [i for i, f in got[s].items() if f[1]] == ([next(i for i, x in enumerate(v) if x >= 0.1 * max(v))] if usable else [])


# cut patterns


def plain_chamfer(a, b):
    one = lambda x, y: sum(min(abs(u - v) for v in y) for u in x) / len(x)
    return (one(a, b) + one(b, a)) / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_hold_every_near_pattern(spark, seed):
    r = random.Random(seed)
    base = [[round(40 * r.random(), 2) for _ in range(r.randrange(1, 14))] for _ in range(12)]
    points = []
    for k in range(150):
        cuts = [round(max(0, c + r.gauss(0, 0.6)), 2) for c in r.choice(base)]
        points.append(("x" if k % 5 else "y", k, sorted(cuts + ([0.0] if k % 10 else []))))
    df = spark.createDataFrame(points, "asset_id string, p long, cuts array<double>")
    got = {(x.a, x.b) for x in media.pattern_candidates(df, 0.5).collect()}
    near = {(p[1], q[1]) for p, q in itertools.combinations(points, 2) if p[0] == q[0] and plain_chamfer(p[2], q[2]) <= 0.5}
    assert near and near <= got


def test_a_cut_all_patterns_share_gives_few_candidates(spark):
    r = random.Random(6)
    points = [("x", k, sorted([0.0] * (k % 10 > 0) + [round(100_000 * r.random(), 1) for _ in range(9)])) for k in range(400)]
    df = spark.createDataFrame(points, "asset_id string, p long, cuts array<double>")
    assert media.pattern_candidates(df, 0.5).count() < 0.02 * 400 * 399 / 2


# topics


def plain_round(counts, terms, documents, k, alpha, beta):
    total = [sum(w[j] for w in terms.values()) / 1e6 + len(terms) * beta for j in range(k)]
    new_terms, new_documents = defaultdict(lambda: [0] * k), defaultdict(lambda: [0] * k)
    for (d, t), n in counts.items():
        p = [(documents[d][j] / 1e6 + alpha) * (terms[t][j] / 1e6 + beta) / total[j] for j in range(k)]
        for j in range(k):
            r = n * int(p[j] / sum(p) * 1e6 + 0.5)
            new_terms[t][j] += r
            new_documents[d][j] += r
    return dict(new_terms), dict(new_documents)


def test_topic_rounds_equal_a_plain_fit_and_do_not_depend_on_partitions(spark):
    r = random.Random(8)
    kinds = [["cat", "dog", "bird", "fish"], ["bread", "milk", "egg", "salt"]]
    messages = [(i, " ".join(r.choice(kinds[i % 2]) for _ in range(12)) + " common") for i in range(30)] + [(30, ""), (31, None)]
    df = spark.createDataFrame(messages, "id long, text string")
    counts = topics.term_counts(df, "id", (1, 1), min_docs=2, max_share=0.7)
    plain = {(x.id, x.term): x.n for x in counts.collect()}
    assert {t for _, t in plain} == {w for k in kinds for w in k}
    terms = {x.term: [x.w0, x.w1] for x in topics.first_topics(counts, 2).collect()}
    size = Counter()
    for (d, _), n in plain.items():
        size[d] += n
    documents = {d: [round(n / 2 * 1e6)] * 2 for d, n in size.items()}
    for _ in range(8):
        terms, documents = plain_round(plain, terms, documents, 2, 0.1, 0.01)
    t, d = topics.fit_topics(counts.repartition(3), "id", 2, 8)
    assert {x.term: [x.w0, x.w1] for x in t.collect()} == terms
    assert {x.id: [x.m0, x.m1] for x in d.collect()} == documents
    found = {x.id: (x.topic, x.weight) for x in topics.dominant_topics(df, "id", d, 2).collect()}
    assert len({found[i][0] for i in range(0, 30, 2)}) == len({found[i][0] for i in range(1, 30, 2)}) == 1 and found[0][0] != found[1][0]
    assert found[30] == found[31] == ("Topic 1", 0.5)
    lists = defaultdict(set)
    for x in topics.top_terms(t, 2, 4).collect():
        lists[x.topic].add(x.term)
    assert sorted(map(sorted, lists.values())) == sorted(map(sorted, kinds))


# pairs


def test_pairs_by_direct_count_and_by_candidates(spark, monkeypatch):
    r = random.Random(3)
    rows = sorted({(f"g{r.randrange(25)}", f"i{r.randrange(30)}") for _ in range(300)})
    df = spark.createDataFrame(rows, "g string, i string")
    groups = defaultdict(set)
    for g, i in rows:
        groups[i].add(g)
    want = {(a, b, len(groups[a] & groups[b])) for a, b in itertools.combinations(sorted(groups), 2) if len(groups[a] & groups[b]) >= 3}
    for ratio in (0, 10**9):
        monkeypatch.setattr(pairs, "_DIRECT", ratio)
        assert {tuple(x) for x in pairs.shared_group_counts(df, "g", "i", 3).collect()} == want


# many terms


def test_twenty_thousand_terms_equal_the_short_form(spark, monkeypatch):
    r = random.Random(5)
    terms = sorted({"".join(r.choice("abcde") for _ in range(r.randrange(3, 7))) for _ in range(60_000)})[:20_000]
    texts = [("".join(r.choice("abcdefg ") for _ in range(60)),) for _ in range(40)] + [(None,), ("",), ("ABCDE",)]
    df = spark.createDataFrame(texts, "text string")
    t = F.col("text")
    rows = df.select("text", text.contains_any(t, terms).alias("any"), text.term_hits(t, terms).alias("hits")).collect()
    for x in rows:
        want = [w for w in terms if w in (x.text or "").lower()]
        assert (x.any, x.hits) == (bool(want), want)
    few = terms[:300]
    rules = {"d": {"categories": {f"c{k}": {"keywords": few[k::30]} for k in range(30)}, "unknown_id": "none"}}
    tags = spark.createDataFrame([(w,) for w in few[::7] + ["zzz", "xx" + few[0] + "yy"]], "hashtag string")
    order = spark.createDataFrame([(k, ["priority", "exact", "contains"][k % 3], w, f"L{k % 9}") for k, w in enumerate(few)], "ord int, kind string, term string, label string")
    out = []
    for limit in (10, 10**6):
        monkeypatch.setattr(automaton, "EXPRESSION_TERMS", limit)
        found = df.select("text", classify.keyword_categories(t, rules, "d").alias("c"), text.contains_any(t, few).alias("a"), text.term_hits(t, few).alias("h"))
        out.append(([tuple(x) for x in found.collect()], sorted(map(tuple, graph.semantic_clusters(tags, order).collect()))))
    assert out[0] == out[1] and any(len(c) > 1 for _, c, _, _ in out[0][0])


# corpus files in slices


def test_a_large_corpus_file_is_read_in_slices(spark, tmp_path):
    r = random.Random(1)
    odd = ['a "video_info" inside', "x\\", '{"video_info": {', "}, ", "漢字 \n é", ""]
    corpus = {
        f"v{k}": {"video_info": {"title": r.choice(odd), "views": k}, "comments": [{"youtube_comment_id": f"k{k}-{c}", "text": r.choice(odd) * r.randrange(1, 40), "replies": []} for c in range(r.randrange(5))]}
        for k in range(300)
    } | {'odd " key': {"video_info": {"title": "t"}, "comments": []}}
    for indent, name in ((None, "a.json"), (1, "b.json")):
        path = tmp_path / name
        path.write_text(json.dumps(corpus, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
        whole = sorted(map(str, discussions.read_corpus(spark, str(path)).collect()))
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            cut = discussions.read_corpus_slices(spark, str(path))
            assert sorted(map(str, cut.collect())) == whole and len(whole) == 301
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    lines = discussions.import_corpus(spark, str(tmp_path / "b.json"), str(tmp_path / "lines"), slices=True)
    assert lines.count() == 301
    (tmp_path / "empty.json").write_text("{}")
    assert discussions.read_corpus_slices(spark, str(tmp_path / "empty.json")).count() == 0
    (tmp_path / "other.json").write_text('{"v": {"comments": [], "video_info": {"title": "t"}}}')
    with pytest.raises(Exception, match="begins with its video_info"):
        discussions.read_corpus_slices(spark, str(tmp_path / "other.json")).collect()
