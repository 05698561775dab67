"""Periodic runs, spelling variants and the Jaccard join against brute force and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import jaccard, periodic, spelling
from threadloom.llm.common import on_workers

SCHEMA = "doc_id long, text string, runs string, collapsed string, word string, n string, form string, name string, key string, component string"
R = random.Random(11)
WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta!", "théta", "iota", "kappa", "lambda", "mu"]
PLENTY = [f"w{R.randrange(10**6)}" for _ in range(300)]


def prose(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def edited(text, share, seed):
    r = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def odd_rows():
    base, other = prose(200, 1, PLENTY), prose(120, 2, PLENTY)
    loop = " ".join(["one two three four five"] * 9)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "One  two", "ONE two", base, base, base + " end", edited(base, 0.01, 3), edited(base, 0.05, 4), other, edited(other, 0.02, 5), loop, loop + " six " + loop]
    texts += ["a " * 40, "a b " * 30 + "a", prose(50, 6) + " " + loop + " " + prose(40, 7), prose(30_000, 8, PLENTY) + " " + "x y z " * 2000, "    word", "漢字 " * 30]
    texts += [edited(base, 0.002 * k, 100 + k) for k in range(40)]
    rows = [(i, t, *["q"] * 8) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, base + " end", *[None] * 8), (None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def docs(spark):
    on_workers(spark)
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


# runs


def plain_runs(w, least, exponent):
    a = np.unique(w, return_inverse=True)[1] if len(w) else np.empty(0, int)
    out = []
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], a[:-p] == a[p:], [False]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            n = e - s + p
            if n >= least and n >= exponent * p and not any(x <= s and x + m >= s + n and p % q == 0 for x, m, q in out):
                out.append((s, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_lyndon(w, reverse):
    tail = lambda i: tuple(-x if reverse else x for x in w[i:])
    return [next((j for j in range(i + 1, len(w)) if tail(j) < tail(i)), len(w)) - i for i in range(len(w))]


def some_words(seed):
    r = random.Random(seed)
    k = r.choice([1, 2, 3, 6])
    if r.random() < 0.5:
        return [r.randrange(k) for _ in range(r.randrange(1, 40))]
    root = [r.randrange(k + 1) for _ in range(r.randrange(1, 9))]
    return [r.randrange(k + 1) for _ in range(r.randrange(6))] + root * r.randrange(2, 7) + [r.randrange(k + 1) for _ in range(r.randrange(6))]


def test_groups_are_the_longest_lyndon_words_under_both_orders():
    for seed in range(400):
        w = some_words(seed)
        for reverse in (False, True):
            group, span = periodic.lyndon_groups(np.array(w), reverse)
            assert span.tolist() == plain_lyndon(w, reverse)
            words = {(g, tuple(w[i : i + s])) for i, (g, s) in enumerate(zip(group.tolist(), span.tolist()))}
            assert len(words) == len({g for g, _ in words}) == len({x for _, x in words})


@pytest.mark.parametrize("least, exponent", [(4, 3), (6, 3), (9, 3), (8, 4), (24, 3)])
def test_runs_equal_brute_force_whole_and_in_stretches(least, exponent):
    width = periodic.sieve_width(least, exponent)
    for seed in range(600):
        w = np.array(some_words(seed) * (2 if least == 24 else 1))
        want = plain_runs(w, least, exponent)
        assert periodic.text_runs(w, least, exponent) == want
        parts = periodic.stretches(w, np.zeros(len(w), int), width, least)
        assert sorted(((a + s, n, p) for a, b in parts for s, n, p in periodic.text_runs(w[a:b], least, exponent)), key=lambda r: (r[0], r[2])) == want


def test_stretches_do_not_reach_over_documents():
    w, doc = np.array([1, 2, 3] * 8), np.repeat([0, 1], 12)
    assert [(b - a) for a, b in periodic.stretches(w, doc, 3, 4)] == [12, 12]


def test_periodic_runs_and_digests(docs):
    got = {}
    for r in periodic.run_digests(periodic.periodic_runs(docs, prepare=periodic.planted)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = defaultdict(list)
    for i, text, *_ in odd_rows():
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        h, n = (1 if i is None else zlib.crc32(str(i).encode())), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words, 24, 3) if n < 5000 else None
        if runs is None:
            runs = [(n - 6000, 6000, 3)] if h % 10 else got[i][0][0]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        kept = [x for k, x in enumerate(words) if not any(s + p <= k < s + m for s, m, p in runs)]
        want[i].append((
            len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
        ))
    sortable = lambda rows: sorted(rows, key=str)
    assert {k: sortable(v) for k, v in got.items()} == {k: sortable(v) for k, v in want.items()}
    assert any(v[0][0] for v in got.values())


def test_runs_of_an_empty_table_and_of_bad_bounds(docs):
    assert periodic.run_digests(periodic.periodic_runs(docs.limit(0))).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_exponent=2)


# spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=7, ratio=10, change=True):
    n = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{i}:{w}".encode())
            if change and i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    n = {w: k for w, k in n.items() if k > 1}
    around = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in around[w]), default=None)
        if best and -best[0] >= ratio * n[w]:
            form[w] = best[1]

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(around[w]), n.get(form.get(w))) for w in n}


def word_rows(seed, size=250):
    r = random.Random(seed)
    letters = "abcdeÉéñß×"
    stems = ["".join(r.choice(letters) for _ in range(r.randrange(7, 12))) for _ in range(size)] + ["tionmente", "aaaaaaaa", "aaaaaaa", "abababab"]
    rows = []
    for i in range(60):
        words = []
        for _ in range(400):
            w = stems[int(len(stems) * r.random() ** 3)]
            x = r.random()
            at = r.randrange(len(w))
            words.append(w[:at] + w[at + 1 :] if x < 0.05 else w[:at] + r.choice(letters) + w[at:] if x < 0.1 else w[:at] + r.choice(letters) + w[at + 1 :] if x < 0.15 else w.upper() if x < 0.2 else w)
        rows.append((i, "-".join(words), *["q"] * 8))
    return rows + [(None, "Wordword wordword 12 wordworđ", *[None] * 8), (100, None, *["q"] * 8), (101, "", *["q"] * 8)]


@pytest.mark.parametrize("least, seed", [(7, 1), (5, 2)])
def test_variants_equal_brute_force(spark, least, seed):
    rows = word_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [tuple(r) for r in spelling.spelling_variants(df, least=least, prepare=spelling.misspelt).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(rows, least)
    assert sum(r[1] is not None for r in got) > 5


def test_variants_with_frequent_grams_and_chains(spark):
    """A dictionary of long frequent grams, and forms that lead over a middle form."""
    rows = word_rows(3, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    counts = spelling.word_counts(df, 7).filter("n > 1")
    found = spelling.gram_dictionary(counts, least=20)
    assert found and {len(g) for g in found} == {3, 4, 5, 6} and all(g[:-1] in found for g in found if len(g) > 3)
    words = {r.word: r.n for r in counts.collect()}
    longest = max(words, key=len)
    grams, touched = spelling.decompose(longest, found)
    assert len(grams) == len(longest) and touched <= 6
    chain = [(k, " ".join(["abcdefgh"] * 500 + ["abcdefghi"] * 40 + ["abcdefghij"] * 3), *["q"] * 8) for k in range(1)]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(spark.createDataFrame(chain, SCHEMA)).collect()}
    assert got == {"abcdefgh": (None, "abcdefgh"), "abcdefghi": ("abcdefgh", "abcdefgh"), "abcdefghij": ("abcdefghi", "abcdefgh")}


def test_an_edit_touches_no_more_grams_than_told():
    r = random.Random(9)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(7, 12))) for _ in range(300)}
    frequent = {}
    for q in (3, 4, 5, 6):
        n = Counter((w + "\x00" * 6)[i : i + q] for w in words for i in range(len(w)))
        frequent |= {g: k for g, k in n.items() if k > 12 and (q == 3 or g[:-1] in frequent)}
    for w in sorted(words):
        at = r.randrange(len(w) + 1)
        v = r.choice([w[:at] + r.choice("abc") + w[at:], w[:at] + w[at + 1 :], w[:at] + r.choice("abc") + w[at + 1 :]])
        if v != w and len(v) >= 7:
            (one, a), (two, b) = spelling.decompose(w, frequent), spelling.decompose(v, frequent)
            shared = sum((Counter(one) & Counter(two)).values())
            assert shared >= max(len(one) - a, len(two) - b)


def test_variants_of_odd_tables(docs):
    got = {tuple(r) for r in spelling.spelling_variants(docs).collect()}
    assert got == plain_variants(odd_rows(), change=False)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


# joins


def plain_sets(rows, width=4):
    out = []
    for i, text, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        out.append((i, {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))} if words else set()))
    return out


def plain_components(rows, percent=85):
    sets = plain_sets(rows)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def test_components_equal_brute_force(docs):
    got = [tuple(r) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(got, key=str) == plain_components(odd_rows())


@pytest.mark.parametrize("seed, percent, share", [(1, 85, 5), (3, 70, 3)])
def test_dense_groups_shared_passages_and_chains(spark, seed, percent, share):
    """Groups of near copies at all distances, chains, passages many texts share, short texts."""
    r = random.Random(seed)
    passages = [prose(30, 50 + k, PLENTY) for k in range(3)]
    texts = []
    for g in range(4):
        base = prose(r.randrange(20, 160), seed * 10 + g, PLENTY)
        texts += [edited(base, r.random() * 0.06, r.random()) for _ in range(45)]
        step = base
        for k in range(12):
            step = edited(step, 0.02, r.random())
            texts.append(step)
    for k in range(60):
        texts.append(prose(r.randrange(1, 40), r.random(), PLENTY) + " " + " ".join(r.sample(passages, r.randrange(1, 4))))
    texts += [prose(r.randrange(1, 9), r.random(), PLENTY[:6]) for _ in range(60)] + texts[:5]
    rows = [(k, t, *["q"] * 8) for k, t in enumerate(texts)]
    got = [tuple(x) for x in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=percent, share=share).collect()]
    assert sorted(got, key=str) == plain_components(rows, percent)


def test_a_region_larger_than_a_task_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_PART", 7)
    base = prose(90, 77, PLENTY)
    rows = [(k, edited(base, 0.05 * (k % 9) / 9, k), *["q"] * 8) for k in range(120)]
    got = [tuple(x) for x in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == plain_components(rows)


def test_join_of_empty_tables(docs):
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []
    assert {r.component_id for r in jaccard.jaccard_components(docs.filter(F.col("text") == "")).collect()} == {1}
