"""Text column helpers: tokens, n-grams, markers, keyword hits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .automaton import groups_found, many, named
from .columns import col, nfkc

# fixed values: patterns of captions and comments
URL = r"(?i)https?://\S+|www\.\S+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
HASHTAG = r"(?U)(?<!\w)#([A-Za-z0-9_]{2,})"
MENTION = r"(?U)(?<!\w)@([A-Za-z0-9_]{2,})"
CAPTION_MENTION = r"(?U)(?<!\w)@[\w.]+"
CAPTION_HASHTAG = r"(?U)#([\wÀ-ÖØ-öø-ÿ一-龯ぁ-ゔァ-ヴー々〆〤]+)"
CAPTION_TOKEN = r"(?U)[\wÀ-ÖØ-öø-ÿ一-龯ぁ-ゔァ-ヴー々〆〤]+"
PUNCTUATION = r"[\.,;:!\?\(\)\[\]\{\}\"'`´“”‘’•·…|/\\]+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
JAPANESE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
# fixed values: caption stop words
CAPTION_STOPWORDS = [
    "the", "and", "for", "with", "this", "that", "you", "are", "from",
    "und", "der", "die", "das", "ein", "eine", "mit", "ist", "für", "von",
    "に", "の", "は", "を", "が", "と", "で",
]


def quoted(term: str) -> str:
    """A term as a literal Java regular expression."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(group))


def words(c: Column | str, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased words of two or more word characters, without stop words."""
    out = find_all(F.lower(col(c)), r"(?U)\b\w\w+\b")
    return F.filter(out, lambda t: ~t.isin(*stopwords)) if stopwords else out


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams with n from low to high, joined by a blank."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(tokens)
        else:
            starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def normalize_caption(c: Column | str) -> Column:
    """NFKC, without links, mentions, '#' and punctuation, single blanks, lower case."""
    out = nfkc(F.trim(F.coalesce(col(c), F.lit(""))))
    for pattern, by in ((URL, " "), (CAPTION_MENTION, " "), ("#", " "), (PUNCTUATION, " "), (r"(?U)\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.lower(F.trim(out))


def caption_tokens(normalized: Column | str, min_length: int = 3, stopwords: Sequence[str] = tuple(CAPTION_STOPWORDS)) -> Column:
    """Tokens of a normalised caption: long enough, no stop words, no plain numbers."""
    raw = F.transform(find_all(normalized, CAPTION_TOKEN), lambda t: F.trim(t, F.lit("_")))
    return F.filter(raw, lambda t: (F.length(t) >= min_length) & ~t.isin(*stopwords) & ~t.rlike(r"(?U)^\d+$"))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True when the lower-cased text contains one of the terms as a substring; long term lists go through an automaton."""
    if many(terms):
        return F.size(groups_found(F.lower(text), [[t.lower() for t in terms]])) > 0
    return F.coalesce(F.lower(text).rlike("|".join(quoted(t.lower()) for t in terms)), F.lit(False)) if terms else F.lit(False)


def contains_all(text: Column, terms: Sequence[str]) -> Column:
    low = F.lower(text)
    out = F.lit(True)
    for t in terms:
        out = out & F.coalesce(low.contains(t.lower()), F.lit(False))
    return out


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """Sorted distinct terms that occur in the lower-cased text; long term lists go through an automaton."""
    low, every = F.lower(text), sorted(set(terms))
    if many(every):
        return found_terms(low, every)
    found = [F.when(low.contains(t.lower()), F.lit(t)) for t in every]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def found_terms(low: Column, terms: Sequence[str]) -> Column:
    """The terms, in their order, that occur in a lower-cased text."""
    return named(groups_found(low, [[t.lower()] for t in terms]), terms)
