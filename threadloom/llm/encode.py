"""Exact ids of whole texts under a public vocabulary file."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# fixed value: the splitting pattern of byte-level vocabularies
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple[str, bool], "Encoder"] = {}


def vocabulary(name: str) -> str:
    """Path of one of the installed public vocabulary files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def safe_spans(text: str, limit: int = 1 << 16) -> Iterator[str]:
    """Spans of about ``limit`` characters whose ids, in order, are those of the text.

    A cut stands before a single space between two characters that are not
    white space; no byte-level token reaches over such a place. A stretch
    without such a place stays whole.
    """
    at = 0
    while len(text) - at > limit:
        place = _SAFE.search(text, at + limit)
        if not place:
            break
        yield text[at : place.start()]
        at = place.start()
    yield text[at:] if at else text


class Encoder:
    """Ids of whole texts as the library of the file gives them, without added tokens.

    ``.model`` files go through ``sentencepiece`` and ``.json`` files through
    ``tokenizers``. A byte-level BPE file whose merges stand in the order of
    their ids is the same thing as a table of ranks: it goes through
    ``tiktoken``, with the ranks read from the file itself, which gives the
    same ids several times faster. ``plain`` takes special strings inside a
    text as ordinary text; else they are single ids, as is the default of
    ``tokenizers``.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.plain, self.fast = plain, None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.model.vocab_size()
            return
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = [*file["model"].get("vocab", {}).values(), *(a["id"] for a in file.get("added_tokens") or [])] if isinstance(file["model"].get("vocab"), dict) else []
        self.fast, self.size = self._ranks(file), max(ids, default=-1) + 1
        if self.fast is not None:
            return
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = plain
        self.size = self.model.get_vocab_size()

    @staticmethod
    def _ranks(file: dict):
        """A ``tiktoken`` encoding of a byte-level BPE file, or None where the file is of another kind."""
        model, split = file["model"], file.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab"), model.get("merges")
        added = file.get("added_tokens") or []
        plain_kind = (
            model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not file.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(a["special"] and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in added)
        )
        joined = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges or [])
        if not plain_kind or any(vocab[x] != 256 + i for i, x in enumerate(joined)):
            return None
        import tiktoken

        # byte-level files write printable bytes as themselves and the others, in order, from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {a["content"]: a["id"] for a in added}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if word not in special}
        return tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        if self.fast is None:
            if hasattr(self.model, "encode_batch"):
                return [np.asarray(e.ids, dtype=np.uint32) for e in self.model.encode_batch(texts, add_special_tokens=False)]
            return [np.asarray(x, dtype=np.uint32) for x in self.model.encode(texts, num_threads=1)]
        allowed = set() if self.plain else "all"
        one = lambda t: self.fast.encode_to_numpy(t, allowed_special=allowed, disallowed_special=())
        return [one(t) if len(t) <= 1 << 16 else np.concatenate([one(s) for s in safe_spans(t)]) for t in texts]

    def text(self, ids) -> str:
        """The text of ids, special ids written out."""
        ids = [int(i) for i in ids]
        if self.fast is not None:
            return self.fast.decode(ids)
        return self.model.decode(ids, skip_special_tokens=False) if hasattr(self.model, "encode_batch") else self.model.decode(ids)


def encoder(path: str, plain: bool = False) -> Encoder:
    """The encoder of this worker process for a file, read once."""
    if (path, plain) not in _LOADED:
        _LOADED[path, plain] = Encoder(path, plain)
    return _LOADED[path, plain]


def balanced(lengths: np.ndarray, size: int = 1 << 20) -> Iterator[slice]:
    """Slices of rows with about ``size`` bytes each; a longer row stands alone."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, base + size, side="right")), at + 1)
        yield slice(at, to)
        at = to


def texts_of(column: pa.Array, size: int = 1 << 20) -> Iterator[str | None]:
    """The texts of a column one by one; only about ``size`` bytes of them exist as Python strings at a time."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for part in balanced(lengths, size):
        yield from column.slice(part.start, part.stop - part.start).to_pylist()
