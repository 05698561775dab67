"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from .common import map_arrow
from .encode import balanced

UNDETERMINED = "und"
_BLOCK = 256
_MODELS: dict[str, "CrossParser"] = {}
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter (category L), once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of ``codes``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if depth[to] == depth[at] + 1:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                depth.append(depth[at] + 1)
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return moves


class CrossParser:
    """Counts, for many texts at once, the phrases of a text in terms of each language's training text.

    A phrase is the longest match that the language's automaton reads on from
    here; the next phrase starts where it ends. All automata stand in one table
    (state, letter) -> next state and phrases closed by this step (0, 1, or 2
    where the letter is unknown as well), so one numpy gather moves every text
    by one letter. Texts are parsed in blocks of 256 letters.
    """

    def __init__(self, training: dict[str, str], alphabet: int = 250):
        self.langs = sorted(training)
        points = {k: code_points(training[k]) for k in self.langs}
        there = [p[letters()[p]] for p in points.values()]
        kinds, counts = np.unique(np.concatenate(there) if there else np.empty(0, np.uint32), return_counts=True)
        ranked = kinds[np.lexsort((kinds, -counts))]
        # 0 separates words, 1 is any letter that no training text has; rarer letters beyond the alphabet share codes
        self.code = np.where(letters(), 1, 0).astype(np.int16)
        self.code[ranked] = 2 + np.where(np.arange(len(ranked)) < alphabet, np.arange(len(ranked)), alphabet + ranked % 50)
        self.width = int(self.code.max()) + 1
        self.cost = np.array([math.log2(len(self.letters_of(points[k])) + 2) for k in self.langs])
        automata = [self._edges(self.letters_of(points[k]).tolist()) for k in self.langs]
        sizes = [states * self.width for states, _ in automata]
        kind = np.int32 if sum(sizes) * 4 < 2**31 else np.int64
        self.starts = (np.cumsum([0, *sizes])[:-1]).astype(kind)[:, None]
        self.table = np.empty(sum(sizes), dtype=kind)
        for start, size, (states, (at, letter, to)) in zip(self.starts[:, 0], sizes, automata):
            table = self.table[start : start + size].reshape(states, self.width)
            first = np.full(self.width, start * 4 + 2, dtype=kind)  # a letter unknown even at the start
            roots = at == 0
            first[letter[roots]] = (start + to[roots] * self.width) * 4 + 1
            table[:] = first
            table[0] -= 1  # nothing is open at the start
            table[at, letter] = (start + to * self.width) * 4

    @staticmethod
    def _edges(codes: list[int]) -> tuple[int, np.ndarray]:
        """States and (state, letter, next state) columns of the automaton of a text."""
        moves = suffix_automaton(codes)
        edges = np.fromiter((x for s, own in enumerate(moves) for c, to in own.items() for x in (s, c, to)), dtype=np.int64)
        return len(moves), edges.reshape(-1, 3).T

    def letters_of(self, points: np.ndarray) -> np.ndarray:
        """Codes of a text, runs of anything but letters as one separator, none at the ends."""
        c = self.code[points]
        c = c[(c != 0) | (np.concatenate([[0], c[:-1]]) != 0)] if len(c) else c
        return c[:-1] if len(c) and c[-1] == 0 else c

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters per text, phrases per language and text)."""
        codes = [self.letters_of(code_points(t)) for t in texts]
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        lanes = -(-sizes // _BLOCK)
        total = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        if not lanes.sum() or not self.langs:
            return sizes, total
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(np.cumsum(sizes) - sizes, lanes) + nth * _BLOCK
        left = np.minimum(np.repeat(sizes, lanes) - nth * _BLOCK, _BLOCK)
        order = np.argsort(-left, kind="stable")  # finished lanes drop off the end
        owner, begin, left = owner[order], begin[order], left[order]
        flat = np.concatenate(codes).astype(self.table.dtype)
        at = np.repeat(self.starts, len(owner), axis=1)
        closed = np.zeros(at.shape, dtype=np.int32)
        for step in range(int(left[0])):
            live = int(np.searchsorted(-left, -step, side="left"))
            move = self.table[at[:, :live] + flat[begin[:live] + step]]
            closed[:, :live] += move & 3
            at[:, :live] = move >> 2
        closed += at != self.starts
        for k in range(len(self.langs)):
            total[k] = np.bincount(owner, weights=closed[k], minlength=len(texts)).astype(np.int64)
        return sizes, total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        sizes, phrases = self.phrases(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bits = phrases * self.cost[:, None]
        best = bits.argmin(axis=0)
        low = bits.min(axis=0)
        rest = np.sort(bits, axis=0)[1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.clip(np.where(rest > 0, 1 - low / rest, 0.0), 0.0, 1.0)
        words = letters()
        told = [bool(n) and bool(words[code_points(t)].any()) for n, t in zip(sizes, texts)]
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, told)], np.where(told, score, 0.0)


def training_texts(labelled: DataFrame, chars: int = 32_000, texts: int = 300, text_chars: int = 2_000, languages: int = 500) -> dict[str, str]:
    """A bounded sample of labelled text per language: the documented bound of what is learned from.

    Of each language about ``texts`` different texts, chosen by the hash of the
    text, give up to ``text_chars`` characters each and ``chars`` in all; lines that
    stand in several of them are left out. A language that would lose most of its
    letters by this gets them back, each once: first the lines of which it has most
    texts, then all. So each language with a letter in its sample is learned.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} different labels")
    if not sizes:
        return {}
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, texts / max(r["n"], 1)))])
    chosen = rows.filter(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < rate[F.col("lang")])
    sample = chosen.groupBy("lang", "h").agg(F.min(F.substring("text", 1, text_chars)).alias("text")).collect()
    texts_of: dict[str, list[list[str]]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"])):
        texts_of.setdefault(r["lang"], []).append(r["text"].split("\n"))
    stands = {k: Counter(x for t in own for x in set(t)) for k, own in texts_of.items()}
    lines = sum(stands.values(), Counter())
    out = {}
    for k, own in texts_of.items():
        enough = min(chars // 16, sum(map(_letter_count, stands[k])) / 2)
        # a line of several texts is boilerplate, often in another language; it counts once where too little is left without
        for fits in (lambda x: lines[x] == 1, lambda x: 2 * stands[k][x] > lines[x], lambda x: True):
            out[k] = _joined(own, fits, lines, chars)
            if _letter_count(out[k]) >= enough:
                break
    return {k: v for k, v in out.items() if _letter_count(v)}


def _letter_count(text: str) -> int:
    return sum(map(str.isalpha, text))


def _joined(texts: list[list[str]], fits: Callable[[str], bool], lines: Counter, chars: int) -> str:
    """The lines that fit, those of several texts once, up to ``chars`` characters."""
    out: list[str] = []
    seen: set[str] = set()
    size = 0
    for text in texts:
        if size >= chars:
            break
        out.append("\n".join(x for x in text if x not in seen and fits(x)))
        size += len(out[-1])
        seen.update(x for x in text if lines[x] > 1)
    return "\n".join(out)[:chars]


@F.pandas_udf(BooleanType())
def lettered(text):
    """Whether a text has a letter; a null has none."""
    return text.map(lambda t: isinstance(t, str) and any(map(str.isalpha, t))).astype(bool)


def _parser(training: dict[str, str]) -> CrossParser:
    key = hashlib.sha256(repr(sorted(training.items())).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = CrossParser(training)
    return _MODELS[key]


def identify(docs: DataFrame, training: dict[str, str], keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 20) -> DataFrame:
    """The ``keep`` columns with (lang_pred, score), one row per row, without a shuffle.

    The language whose training text needs the fewest phrases, each weighed by
    the bits of a position in that text, wins; ties go to the first label. The
    score is 1 - best / second best. A null text, or one without a letter, is
    ``und`` with score 0, as is everything when nothing was learned. Repeated
    rows get a row each, an empty table none. Only the text decides.
    """

    at = keep.index("text") if "text" in keep else len(keep)

    def tell(batches):
        parser = _parser(training)
        for batch in batches:
            text = batch.column(at)
            langs: list[str] = []
            scores: list[np.ndarray] = [np.empty(0)]
            for part in balanced(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), batch_bytes):
                own, score = parser.predict([t or "" for t in text.slice(part.start, part.stop - part.start).to_pylist()])
                langs += own
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("text to read"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(rows, tell, f"{kinds}, lang_pred string, score double")
