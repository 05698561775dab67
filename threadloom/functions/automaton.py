"""Many terms at once: one multi-pattern automaton per worker instead of one test per term."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

try:
    import ahocorasick
except ImportError:  # then every number of terms goes through column expressions
    ahocorasick = None

# up to this many terms become a column expression; more become an automaton
EXPRESSION_TERMS = 200


def many(terms: Sequence) -> bool:
    """Whether a term list is long enough for the automaton."""
    return ahocorasick is not None and len(terms) > EXPRESSION_TERMS


def groups_found(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Numbers, rising, of the groups with a term inside the text; an empty text finds only empty terms, null finds none.

    One pass over each text, whatever the number of terms. The terms travel
    to the workers with the function and the automaton is built once in each.
    """
    groups = [list(g) for g in groups]
    always = [k for k, g in enumerate(groups) if "" in g]

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        owners: dict[str, list[int]] = {}
        for k, terms in enumerate(groups):
            for term in set(terms):
                if term:
                    owners.setdefault(term, []).append(k)
        machine = ahocorasick.Automaton()
        for term, numbers in owners.items():
            machine.add_word(term, numbers)
        if owners:
            machine.make_automaton()

        def one(s: str | None) -> list[int]:
            if s is None:
                return []
            hits = set(always)
            if owners:
                for _, numbers in machine.iter(s):
                    hits.update(numbers)
            return sorted(hits)

        for batch in batches:
            yield batch.map(one, na_action=None)

    return found(text)


def named(numbers: Column, names: Sequence[str]) -> Column:
    """Group numbers as names."""
    every = F.array(*[F.lit(n) for n in names])
    return F.transform(numbers, lambda k: F.element_at(every, k + 1))
