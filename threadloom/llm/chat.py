"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks from prefix sums."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow
from .encode import encoder, vocabulary

# fixed values: control strings; the reserved ids follow the vocabulary in this order
CONTROL = ("### System: ", "### User: ", "### Assistant: ", "### Role: ", "### Text: ", "</turn>\n")
ROLES = {"system": 0, "user": 1, "assistant": 2}
_OTHER, _TEXT, _END = 3, 4, 5
_MARKS = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and every beginning of a control string."""
    return _MARKS.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(turns: list[tuple[str, str]], enc, learn: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, str]:
    """(ids, mask, text) of one conversation's (role, text) turns."""
    parts: list[tuple[int | str, bool]] = []  # a reserved id or a text, and whether it is learned
    for role, text in turns:
        if role in ROLES:
            parts.append((ROLES[role], False))
        else:
            parts += [(_OTHER, False), (escape(role), False), (_TEXT, False)]
        parts += [(escape(text), role in learn), (_END, False)]
    texts = iter(enc.ids([p for p, _ in parts if isinstance(p, str)]))
    pieces = [next(texts) if isinstance(p, str) else np.array([enc.size + p], dtype=np.uint32) for p, _ in parts]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
    steps = np.zeros(edges[-1] + 1, dtype=np.int32)
    for n, (_, learned) in enumerate(parts):
        if learned:
            steps[edges[n]] += 1
            steps[edges[n + 1]] -= 1
    written = "".join(p if isinstance(p, str) else CONTROL[p] for p, _ in parts)
    ids = np.concatenate(pieces) if pieces else np.empty(0, np.uint32)
    return ids.astype(np.int32), np.cumsum(steps[:-1]).astype(np.int8), written


def read_back(ids: np.ndarray, mask: np.ndarray, enc) -> tuple[list[tuple[str, str]], str]:
    """((role, text) turns, learned text) from the output alone."""
    turns: list[tuple[str, str]] = []
    names = {n: role for role, n in ROLES.items()}
    role, start = "", 0
    for at in np.flatnonzero(ids >= enc.size):
        mark = int(ids[at]) - enc.size
        if mark in names:
            role = names[mark]
        elif mark in (_TEXT, _END):
            text = unescape(enc.text(ids[start:at]))
            if mark == _TEXT:
                role = text
            else:
                turns.append((role, text))
        start = at + 1
    return turns, unescape(enc.text(ids[mask == 1]))


def format_chats(turns: DataFrame, path: str | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, input_ids, loss_mask, formatted), one row per conversation, turns by ``turn``.

    A turn is a reserved id for its role, the ids of its escaped text, and a
    reserved id that ends it; a role without a reserved id is spelled between
    two of its own. Control strings inside a text get a backslash, and so does
    a backslash, so a text can never read as a control string and every text
    comes back whole; special strings of the vocabulary inside a text are
    ordinary text. The mask is 1 on the ids of the texts of ``learn`` roles.

    Rows of a conversation meet in one task and are assembled one conversation
    at a time, in a sorted stream. A null text or role is empty; equal turns
    stand in the order of role and text, repeated rows are kept; rows with a
    null conv_id are one conversation; an empty table gives no rows.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def build(batches):
        enc, none = encoder(path, plain=True), object()
        key, own = none, []

        def row(key, own, schema):
            ids, mask, text = assemble(own, enc, learn)
            return pa.record_batch([pa.array([key], schema.field("conv_id").type), pa.array([ids]), pa.array([mask]), pa.array([text])], names=["conv_id", "input_ids", "loss_mask", "formatted"])

        for batch in batches:
            done = []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if k != key or key is none:
                    if key is not none:
                        done.append(row(key, own, batch.schema))
                    key, own = k, []
                own.append((role, text))
            schema = batch.schema
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if key is not none:
            yield row(key, own, schema)

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    streamed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return map_arrow(streamed, build, f"conv_id {kind}, input_ids array<int>, loss_mask array<tinyint>, formatted string")


def chat_digests(chats: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from formatted rows."""
    path = path or vocabulary("byte_bpe_50k.json")
    kind = chats.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        enc = encoder(path, plain=True)
        for batch in batches:
            out = []
            for key, ids, mask, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "input_ids", "loss_mask", "formatted"))):
                turns, learned = read_back(np.array(ids, dtype=np.int64), np.array(mask), enc)
                told = "".join(f"{role}\n{t}\n" for role, t in turns)
                out.append((key, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) or [[]] * len(names)
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return map_arrow(chats, read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
