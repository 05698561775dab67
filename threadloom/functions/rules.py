"""Rule sets: dimensions, categories and keywords as plain nested dicts.

``{dimension: {"categories": {id: {"label": str, "keywords": [str]}},
"unknown_id": str, "unknown_label": str}}``. Rules are written by hand and stay
on the driver; operators turn them into column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def categories(rules: dict, dim: str) -> list[str]:
    return list(rules[dim]["categories"])


def labels(rules: dict, dim: str) -> dict[str, str]:
    spec = rules[dim]
    out = {c: v.get("label", c) for c, v in spec["categories"].items()}
    out[spec["unknown_id"]] = spec.get("unknown_label", spec["unknown_id"])
    return out


def label_of(rules: dict, dim: str, category: Column) -> Column:
    """Label of a category column, the id itself when unknown to the rules."""
    out = category
    for c, label in labels(rules, dim).items():
        out = F.when(category == c, F.lit(label)).otherwise(out)
    return out


def rule_table(spark: SparkSession, rules: dict) -> DataFrame:
    """Rules as rows (dimension, ord, category, label, keyword, unknown_id)."""
    rows = [
        (dim, i, cat, spec.get("label", cat), kw, rules[dim]["unknown_id"])
        for dim in rules
        for i, (cat, spec) in enumerate(rules[dim]["categories"].items())
        for kw in spec["keywords"]
    ]
    return spark.createDataFrame(rows, "dimension string, ord int, category string, label string, keyword string, unknown_id string")


def rules_from_table(df: DataFrame) -> dict:
    """Nested rules from a rule table; the table is configuration, not corpus data."""
    rules: dict = {}
    for r in df.orderBy("dimension", "ord").collect():
        spec = rules.setdefault(r.dimension, {"categories": {}, "unknown_id": r.unknown_id, "unknown_label": r.unknown_id})
        spec["categories"].setdefault(r.category, {"label": r.label, "keywords": []})["keywords"].append(r.keyword)
    return rules
