"""Benchmark decontamination: pigeonhole pieces found exactly, then verified by Myers' bit-parallel distance."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, stored
from .encode import texts_of

_GAPS = re.compile(r"[\W_]+")
HIT = "array<struct<item_id:{},distance:int,start:int,stop:int>>"


def normalised(text: str) -> str:
    """Lower case, every run of anything but letters and digits one space, none at the ends."""
    return _GAPS.sub(" ", text.lower()).strip()


def cut_pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(place, piece) of budget + 1 pieces of near equal length: an alignment with ``budget`` errors leaves one intact."""
    n = budget + 1
    ends = [i * len(text) // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(ends, ends[1:])]


def unspaced(c: str) -> bool:
    """Whether the letter is of a script written without spaces (Thai to Burmese, Khmer, Han and kana)."""
    return "\u0e00" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u2e80" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000"


def stands_alone(text: str, start: int, stop: int) -> bool:
    """Whether a stretch begins and ends on word borders; scripts without spaces have one at each letter."""
    return all(" " in (a, b) or unspaced(a) or unspaced(b) for a, b in ((text[start - 1 : start] or " ", text[start]), (text[stop - 1], text[stop : stop + 1] or " ")))


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to the pattern; the first such end."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, end = full, 0, size, size, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        across = eq | minus
        down = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(down | plus))
        less = plus & down
        if up & high:
            score += 1
        elif less & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        up, less = (up << 1) & full, (less << 1) & full
        plus, minus = less | (full & ~(across | up)), up & across
    return best, end


def block_count(budget: int) -> int:
    """Blocks of an item such that pieces stay long: few errors to each block, and few pieces in all."""
    return min(range(max(1, budget // 4), budget // 2 + 2), key=lambda b: (b * (budget // b + 1), -b))


class Matcher:
    """Approximate occurrences of a block of items in texts.

    The pigeonhole holds twice: of an item's blocks one has at most its share
    of the errors, and of that block's pieces one is intact. A piece hit is
    verified on its short block first, and only then on the whole item. Items
    under ``min_chars`` have no errors to spare: they are found as they are, on
    word borders.
    """

    def __init__(self, items: list[tuple], rate: float, min_chars: int = 0):
        import ahocorasick

        self.short = ahocorasick.Automaton()
        for n, (_, text) in enumerate(items):
            if len(text) < min_chars:
                self.short.add_word(text, (len(text), (*self.short.get(text, (0, ()))[1], n)))
        self.short.make_automaton()
        self.items = [(key, text, int(rate * len(text)), bit_masks(text)) for key, text in items]
        self.blocks: list[tuple] = []  # (item, start, stop, errors, masks)
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget, _) in enumerate(self.items):
            if len(text) < min_chars:
                continue
            count = block_count(budget)
            for start, part in cut_pieces(text, count - 1):
                errors = budget // count
                for at, piece in cut_pieces(part, errors):
                    places.setdefault(piece, []).append((len(self.blocks), start + at))
                self.blocks.append((n, start, start + len(part), errors, bit_masks(part)))
        self.finder = ahocorasick.Automaton()
        for piece, own in places.items():
            self.finder.add_word(piece, (len(piece), own))
        self.finder.make_automaton()

    def _windows(self, text: str) -> dict[int, set[int]]:
        """For each item the places, in cells of its budget, where a block of it matches."""
        tried: set[tuple[int, int]] = set()
        windows: dict[int, set[int]] = {}
        for end, (size, own) in self.finder.iter(text):
            for number, at in own:
                n, start, stop, errors, masks = self.blocks[number]
                # a cell holds all item starts that the block's errors make of this hit
                cell = (end + 1 - size - at) // (2 * errors + 1)
                if (number, cell) in tried:
                    continue
                tried.add((number, cell))
                first, last = cell * (2 * errors + 1), (cell + 1) * (2 * errors + 1)
                part = text[max(0, first + start - errors) : last + stop + 2 * errors]
                if best_match(masks, stop - start, part)[0] <= errors:
                    step = 2 * self.items[n][2] + 1
                    windows.setdefault(n, set()).update((first // step, last // step))
        return windows

    def hits(self, text: str) -> list[dict]:
        """The nearest occurrence of each item within its budget, by item order."""
        text = normalised(text)
        found: dict[int, dict] = {}
        for end, (size, own) in self.short.iter(text) if len(self.short) else ():
            if own[0] not in found and stands_alone(text, end + 1 - size, end + 1):
                found |= {n: {"item_id": self.items[n][0], "distance": 0, "start": end + 1 - size, "stop": end + 1} for n in own}
        windows = self._windows(text) if len(self.finder) else {}
        for n in sorted(windows):
            key, item, budget, masks = self.items[n]
            step, best = 2 * budget + 1, None
            for cell in sorted(windows[n]):
                a, b = max(0, cell * step - budget), (cell + 1) * step + 2 * budget + len(item)
                window = text[a:b]
                at = window.find(item)
                distance, stop = (0, at + len(item)) if at >= 0 else best_match(masks, len(item), window)
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, a + stop)
                    if not distance:
                        break
            if best:
                found[n] = {"item_id": key, "distance": best[0], "start": max(0, best[1] - len(item)), "stop": best[1]}
        return [found[n] for n in sorted(found)]


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: tuple, rate: float, min_chars: int) -> Matcher:
    key = (items, rate, min_chars)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(list(items), rate, min_chars)
    return _MATCHERS[key]


def item_blocks(items: DataFrame, block_chars: int):
    """The items as (item_id, normalised text), in blocks of about ``block_chars`` characters."""
    rows = items.filter(F.length("text") > 0).select("item_id", "text").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        own = {(r["item_id"], normalised(r["text"])) for r in part}
        yield tuple(sorted((x for x in own if x[1]), key=lambda x: (x[1], str(x[0]))))


def mark_contaminated(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), hits: str = "hits", rate: float = 0.1, min_chars: int = 25, block_chars: int = 2_000_000, drop: bool = False) -> DataFrame:
    """The ``keep`` columns with ``hits``: for each item found in the text (item_id, distance, start, stop).

    An item is found where a stretch of the text lies within an edit distance
    of ``rate`` times the item's length, both normalised (lower case, single
    spaces for all else); the nearest stretch is told, start is stop less the
    item's length. Items under ``min_chars`` normalised characters are
    matched without errors and on word borders; one without a letter or digit
    matches nothing. With ``drop`` rows with a hit go.

    The items are read in blocks of bounded size, one pass of the texts each,
    without a shuffle; every fourth block the rows are written, which bounds
    the workers alive at once. A null text has no hits, repeated rows get a
    row each, an empty table of items leaves every row without a hit, a null
    ``item_id`` is an item like any other. Very long texts are searched whole;
    columns outside ``keep`` may have any names, inside it none may be ``hits``.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    passed = list(dict.fromkeys(keep))
    state = "hits so far"
    own = passed if "text" in passed else [*passed, "text"]
    at, last = own.index("text"), len(own)
    rows = docs.select(*own, F.array().cast(HIT.format(kind)).alias(state))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)

    for n, block in enumerate(item_blocks(items, block_chars)):
        if n and n % 4 == 0:
            rows = stored(rows, "decontaminated")

        def scan(batches, block=block):
            matcher = _matcher(block, rate, min_chars)
            for batch in batches:
                new = [matcher.hits(t) if t else [] for t in texts_of(batch.column(at))]
                column = batch.column(last)
                if any(new):
                    column = pa.array([a + b for a, b in zip(column.to_pylist(), new)], column.type)
                batch = batch.set_column(last, batch.schema.field(last), column)
                yield batch.filter(pa.array([not x for x in new])) if drop else batch

        if block:
            rows = map_arrow(rows, scan, f"{fields}, `{state}` {HIT.format(kind)}")
    return rows.select(*passed, F.col(state).alias(hits))
