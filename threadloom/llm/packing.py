"""Best-fit packing planned on the histogram of lengths; pieces take their slots by rank within length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, stored
from .encode import balanced, encoder, vocabulary


def cut(ids: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces: all of ``size`` tokens but for a shorter first one."""
    first = len(ids) % size or min(size, len(ids))
    starts = [0, *range(first, len(ids), size)]
    return [(a, ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first_rank, slots, first_sequence, each, offset).

    Sequences with the same content are one pattern with a count, so the work
    depends on the number of lengths, not of documents. The longest lengths go
    first; each fills the sequences with the least room that still takes it.
    Slot j of a row lies in sequence first_sequence + j div each, at offset +
    (j mod each) * length. Work and result are bounded by ``size``.
    """
    by_room: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def put(pattern: tuple, room: int, count: int) -> None:
        if room not in by_room or not by_room[room]:
            insort(rooms, room)
        by_room[room][pattern] += count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else size
            each = room // length
            if at < len(rooms):
                pattern, there = next(iter(by_room[room].items()))
            else:
                pattern, there = (), left
            took, k = (min(there, left // each), each) if left >= each else (1, left)
            if at < len(rooms):
                by_room[room][pattern] -= took
                if not by_room[room][pattern]:
                    del by_room[room][pattern]
                if not by_room[room]:
                    rooms.pop(at)
            put((*pattern, (length, k)), room - k * length, took)
            left -= took * k
    rows, ranks, sequence = [], Counter(), 0
    for room in rooms:
        for pattern, count in by_room[room].items():
            offset = 0
            for length, k in pattern:
                rows.append((length, ranks[length], count * k, sequence, k, offset))
                ranks[length] += count * k
                offset += length * k
            sequence += count
    return rows


def pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts equal lengths inside one task."""

    def encode(batches):
        enc, seen, part = encoder(path), np.zeros(size + 1, dtype=np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            text, key = batch.column("text"), batch.column("doc_id")
            lengths = pc.binary_length(text).to_numpy(zero_copy_only=False)
            for rows in balanced(lengths):
                out: list[tuple] = []
                for i, ids in enumerate(enc.ids(text.slice(rows.start, rows.stop - rows.start).to_pylist())):
                    for n, (start, own) in enumerate(cut(np.concatenate([ids.astype("<u4", copy=False), end]), size)):
                        out.append((rows.start + i, n, start, len(own), zlib.crc32(own.tobytes()), seen[len(own)]))
                        seen[len(own)] += 1
                row, *cols = (pa.array(x, pa.int64()) for x in zip(*out))
                yield pa.record_batch(
                    [key.take(row), cols[0].cast(pa.int32()), *cols[1:4], pa.array([part] * len(row), pa.int32()), cols[4]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every token of every document placed.

    A document is the ids of its text and ``end_id``; only one longer than
    ``size`` is cut, into pieces of ``size`` with a shorter first one. Only the
    histogram of lengths (at most ``size`` rows) reaches the driver, where the
    sequences are planned. A piece's rank within its length is its count inside
    its task plus the counts of earlier tasks, so a length that holds most
    pieces is never in one task; the piece rows are written once and only they
    are shuffled, never texts. A null or empty text is a document of one
    ``end_id``; repeated rows are packed each; a null ``doc_id`` stays null; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    cut_rows = stored(pieces(docs, path or vocabulary("byte_bpe_50k.json"), size, end_id), "pieces")
    counts = cut_rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, size), "length long, first_rank long, slots long, first_sequence long, each long, at long")
    rank = F.col("nth") + F.col("base")
    slot = F.col("rank") - F.col("first_rank")
    return (
        cut_rows.join(bases, ["part", "length"]).withColumn("rank", rank)
        .join(F.broadcast(slots.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("slots")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_sequence") + F.floor(slot / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.pmod(slot, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token rows themselves, for documents with unique ids.

    Each sequence gathers at most ``size`` tokens.
    """
    path = path or vocabulary("byte_bpe_50k.json")

    def encode(batches):
        enc = encoder(path)
        for batch in batches:
            out = [
                (key, n, own.astype("int32").tolist())
                for key, ids in zip(batch.column("doc_id").to_pylist(), enc.ids(batch.column("text").to_pylist()))
                for n, (_, own) in enumerate(cut(np.append(ids, np.uint32(end_id)), size))
            ]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.record_batch([pa.array(cols[0], batch.schema.field("doc_id").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = map_arrow(rows, encode, f"doc_id {kind}, piece int, ids array<int>")
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(own.alias("own"))
        .select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"))
    )
