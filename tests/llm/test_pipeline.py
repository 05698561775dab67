"""The corpus pipeline against a plain-Python version over a small folder."""

from collections import Counter

import numpy as np
import pytest
from test_llm import brute_components, brute_fingerprint, edit_to_substring, prose, reference_ids

import corpus_pipeline
from threadloom.llm import decontaminate, packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    item = prose(40, 500)
    texts = [prose(60 + i, 600 + i) for i in range(20)]
    texts += [texts[0], texts[1] + " tail", f"{prose(30, 700)} {item} {prose(30, 701)}", f"{prose(40, 702)} {item[:-3]}", None, "", "12 34 !!", f"{prose(50, 703)} bob@mail.example.com", "Mrs. Anna Meier " + prose(40, 704)]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "more") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, "more")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(35, 501)), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_pipeline(spark, folder):
    path, rows, item = folder
    kept = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    ids = sorted(kept)
    groups = brute_components(ids, [brute_fingerprint(kept[i]) for i in ids], 4)
    kept = {i: kept[i] for i in ids if groups[i] == i}
    pattern = decontaminate.normalised(item)
    kept = {i: t for i, t in kept.items() if edit_to_substring(pattern, decontaminate.normalised(t)) > int(0.1 * len(pattern))}

    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    assert sorted(r["doc_id"] for r in seen["decontaminated"]) == sorted(kept)
    final = {r["doc_id"]: r for r in seen["without_pii"]}
    assert sorted(final) == sorted(kept) and all(r["n_chars"] == len(r["text"]) for r in final.values())
    assert all("bob@mail" not in r["text"] and "Meier" not in r["text"] for r in final.values())
    assert all(final[i]["text"] == t for i, t in kept.items() if i < 20)

    got = corpus_pipeline.run(spark, path).collect()
    want = Counter((i, n, len(x)) for i, r in final.items() for n, (_, x) in enumerate(packing.cut(np.array([*reference_ids(r["text"]), 2]), 1024)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == want


def test_pipeline_over_empty_tables(spark, folder, tmp_path):
    path = folder[0]
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_with_odd_ids(spark):
    rows = [(1, prose(60, 1)), (1, prose(60, 1)), (2, prose(60, 1)), (None, prose(60, 2)), (None, prose(60, 2)), (4, prose(60, 3)), (4, prose(60, 4))]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, table, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter({(1, prose(60, 1)): 1, (None, prose(60, 2)): 1, (4, prose(60, 3)): 1, (4, prose(60, 4)): 1})


def test_language_stage_without_labels(spark):
    table = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "12 !", None, "s", 4), (3, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, table, "").collect()] == [1]
