"""Token counts: batches balanced by bytes are encoded in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow
from .encode import balanced, encoder, vocabulary


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, one row per row.

    No shuffle: each Arrow batch is cut into slices of about ``batch_bytes``
    bytes, a longer text stands alone and is encoded in spans that end at safe
    boundaries; only lengths leave the worker. A null text counts as empty (0
    tokens), repeated rows keep their own results, a null ``doc_id`` stays
    null, an empty table gives no rows, other columns are ignored.
    ``over_limit`` is n_tokens > ``limit``.
    """
    path = path or vocabulary("byte_bpe_50k.json")

    def count(batches):
        enc = encoder(path)
        for batch in batches:
            text = batch.column("text")
            size = pc.binary_length(text).to_numpy(zero_copy_only=False)
            counts = []
            for part in balanced(size, batch_bytes):
                counts += [len(x) for x in enc.ids(text.slice(part.start, part.stop - part.start).to_pylist())]
            n = pa.array(counts, pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
