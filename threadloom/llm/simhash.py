"""SimHash near-duplicates: exact Hamming links found in shards of vantage-point trees."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.components import connected_components
from .common import map_arrow, stored
from .encode import texts_of

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEED = 42


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest, seed = xxhash.xxh64_intdigest, _SEED
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text; fp as a signed long."""

    def sign(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts_of(batch.column("text"))], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), sign, f"doc_id {kind}, fp long")


def masks(radius: int, free: int = 2) -> list[int]:
    """Bit masks of which at least one covers no differing bit of any pair within ``radius``.

    The bits fall into radius + ``free`` blocks; each mask keeps ``free`` of them.
    """
    blocks = np.array_split(np.arange(64), radius + free)
    return [sum(1 << int(b) for block in chosen for b in block) for chosen in combinations(blocks, free)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_links(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints within ``radius`` inside each run of equal keys."""
    runs = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(runs, len(keys)))
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    few = np.repeat(sizes <= small, sizes)
    last = np.repeat(runs + sizes, sizes)  # where each row's run ends
    rows = np.flatnonzero(few)
    for step in range(1, small):
        rows = rows[rows + step < last[rows]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fps[rows] ^ fps[rows + step]) <= radius]
        left.append(fps[near])
        right.append(fps[near + step])
    for at in np.flatnonzero(sizes > small):
        rest = fps[runs[at] : runs[at] + sizes[at]]
        while len(rest):
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                x = reached.pop()
                near = np.bitwise_count(rest ^ x) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), x))
                    right.append(found)
                    reached.extend(found)
    return np.concatenate(left), np.concatenate(right)


def _split(big: DataFrame, radius: int) -> DataFrame:
    """One level of the tree: each shard's rows go to the side of its vantage point, with the overlap.

    The vantage point is the shard's fingerprint of lowest hash and the border
    its median distance m. Far rows lie beyond m; near rows up to m + radius: by
    the triangle inequality a far row within ``radius`` of a near one lies in
    that band, so every pair meets on one side.
    """
    vantage = big.groupBy("shard").agg(F.min_by("fp", F.xxhash64("fp")).alias("v"))
    measured = big.join(vantage, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))))
    rings = measured.groupBy("shard", "d").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("d")
    whole = Window.partitionBy("shard")
    border = (
        rings.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
        .groupBy("shard").agg(F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("d"))).alias("m"))
    )
    sides = F.filter(F.array(F.when(F.col("d") <= F.col("m") + radius, F.lit(0)), F.when(F.col("d") > F.col("m"), F.lit(1))), lambda s: s.isNotNull())
    return measured.join(border, "shard").select("fp", F.explode(sides).alias("side"), "shard").select(F.xxhash64("shard", "side").alias("shard"), "fp")


def links(points: DataFrame, radius: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """(src, dst) of fingerprints that connect everything within ``radius`` differing bits.

    ``points`` has the distinct fingerprints as ``fp``. A forest: two
    fingerprints within the radius agree on the bits of at least one mask, so
    under that mask their projected distance is 0 and, by the triangle bound,
    they lie at the same distance from any vantage point; a projected tree has
    no overlap, and its leaves are the values under the mask. A leaf with over
    ``shard_rows`` members is cut further by vantage points in the full space,
    with boundary overlap, until it is small or the cut no longer helps (a ball
    about as small as the radius, where the search joins nearly all at once).
    """
    own = [_signed(m) for m in masks(radius)]
    leaves = points.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(own)])).alias("shard")).select("shard", "fp")
    crowded = stored(leaves.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows), "crowded-leaves")
    parts = [leaves]
    if not crowded.isEmpty():
        parts = [leaves.join(crowded, "shard", "left_anti")]
        big = leaves.join(crowded.select("shard"), "shard", "left_semi")
        before = None
        while True:
            big = stored(big, "leaves")
            counts = big.groupBy("shard").agg(F.count("*").alias("n"))
            over = stored(counts.filter(F.col("n") > shard_rows), "crowded-leaves")
            now = over.agg(F.max("n"), F.sum("n")).first()
            if now[0] is None or (before and now[0] > 0.95 * before):
                parts.append(big)
                break
            before = now[0]
            parts.append(big.join(over, "shard", "left_anti"))
            big = _split(big.join(over.select("shard"), "shard", "left_semi"), radius)

    def search(batches):
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.concatenate([held[0], batch.column("shard").to_numpy()])
                fps = np.concatenate([held[1], batch.column("fp").to_numpy().view(np.uint64)])
                cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
                held = [keys[cut:], fps[cut:]]
                keys, fps = keys[:cut], fps[:cut]
            else:
                keys, fps = held
            if len(keys):
                a, b = shard_links(keys, fps, radius)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return map_arrow(whole.repartition("shard").sortWithinPartitions("shard"), search, "src long, dst long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id reachable over links of up to ``radius`` bits.

    Copies share a fingerprint and count once from there on; links are exact,
    for pairs of different fingerprints; components shrink in rounds on the
    link table. Texts are read once and never shuffled. A null or empty text
    has fingerprint 0 and is linked like any other; repeated rows get a row
    each; rows with a null doc_id keep it and never name a component that has
    an id; an empty table gives no rows; other columns are ignored.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    linked = stored(links(points.select("fp"), radius), "fingerprint-links")
    joined = connected_components(linked)
    roots = points.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(roots.select("fp", "root").join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
