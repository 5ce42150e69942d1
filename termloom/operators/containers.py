"""Sets of documents in compressed containers, one per term and bucket of documents.

A container holds the offsets of its documents within the bucket in whichever form
takes the fewest bytes: the offsets themselves, a bitmap, or runs. In memory a set
is a sorted array of 16-bit offsets or, where it is dense, an array of 64-bit words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents in a bucket, as a power of two; offsets must fit 16 bits.
BUCKET_BITS = 14
IDS, BITMAP, RUNS = "ids", "bitmap", "runs"
NONE = np.zeros(0, np.uint16)


def to_words(offsets: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(1 << bits, np.uint8)
    flags[offsets] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def to_offsets(held: np.ndarray) -> np.ndarray:
    if held.dtype != np.uint64:
        return held
    return np.flatnonzero(np.unpackbits(held.view(np.uint8), bitorder="little")).astype(np.uint16)


def as_set(offsets: np.ndarray, bits: int) -> np.ndarray:
    """The smaller form in memory of sorted, distinct offsets."""
    return to_words(offsets, bits) if len(offsets) * 16 > 1 << bits else offsets.astype(np.uint16)


def size_of(held: np.ndarray) -> int:
    return int(np.bitwise_count(held).sum()) if held.dtype == np.uint64 else len(held)


def both(sets: list[np.ndarray]) -> np.ndarray:
    """What all sets hold, beginning with the smallest list."""
    words = [s for s in sets if s.dtype == np.uint64]
    lists = sorted((s for s in sets if s.dtype != np.uint64), key=len)
    if not lists:
        return np.bitwise_and.reduce(words)
    found = lists[0]
    for other in lists[1:]:
        if not len(found):
            return found
        found = np.intersect1d(found, other, assume_unique=True)
    for other in words:
        found = found[(other[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return found


def either(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """What any set holds."""
    words = [s for s in sets if s.dtype == np.uint64]
    lists = [s for s in sets if s.dtype != np.uint64]
    together = np.unique(np.concatenate(lists)) if lists else NONE
    if not words:
        return as_set(together, bits)
    return np.bitwise_or.reduce([*words, to_words(together, bits)] if lists else words)


def encode(offsets: np.ndarray, bits: int) -> tuple[str, bytes]:
    """The shortest form of sorted, distinct offsets."""
    breaks = np.flatnonzero(np.diff(offsets.astype(np.int64)) != 1)
    sizes = {IDS: 2 * len(offsets), BITMAP: (1 << bits) // 8, RUNS: 4 * (len(breaks) + 1)}
    best = min(sizes, key=sizes.get)
    if best == IDS:
        return best, offsets.astype("<u2").tobytes()
    if best == BITMAP:
        return best, to_words(offsets, bits).tobytes()
    firsts, lasts = offsets[np.concatenate([[0], breaks + 1])], offsets[np.append(breaks, len(offsets) - 1)]
    return best, np.stack([firsts, lasts], axis=1).astype("<u2").tobytes()


def decode(encoding: str, data: bytes) -> np.ndarray:
    """The sorted offsets of a container."""
    if encoding == IDS:
        return np.frombuffer(data, "<u2")
    if encoding == BITMAP:
        return to_offsets(np.frombuffer(data, np.uint64))
    runs = np.frombuffer(data, "<u2").reshape(-1, 2).astype(np.int64)
    lengths = runs[:, 1] - runs[:, 0] + 1
    return (np.repeat(runs[:, 0] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())).astype(np.uint16)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], column: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """Values of ``column`` of each run of rows with equal ``keys``, over the ends of batches."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            whole = batch.column(k)
            codes = whole.dictionary_encode().indices if pa.types.is_string(whole.type) else whole
            codes = codes.to_numpy(zero_copy_only=False)
            changed |= codes[1:] != codes[:-1]
        values = batch.column(column).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(changed) + 1), batch.num_rows]
        starts = [batch.column(k).take(pa.array(bounds[:-1])).to_pylist() for k in keys]
        for start, end, *key in zip(bounds, bounds[1:], *starts):
            if tuple(key) != current:
                if held:
                    yield current, np.concatenate(held)
                current, held = tuple(key), []
            held.append(values[start:end])
    if held:
        yield current, np.concatenate(held)


def build_containers(postings: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """``term, bucket, n_docs, encoding, data`` of every term: one shuffle on term and bucket.

    Document numbers must not be negative. Repeated postings count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        names = ["term", "bucket", "n_docs", "encoding", "data"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for (term, bucket), offsets in groups(batches, ["term", "bucket"], "offset"):
            offsets = np.unique(offsets)
            encoding, data = encode(offsets, bits)
            rows.append((term, bucket, len(offsets), encoding, data))
            size += len(data)
            if len(rows) >= 20_000 or size >= 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    placed = postings.where("term IS NOT NULL AND doc_id >= 0").select(
        "term", F.shiftright("doc_id", bits).alias("bucket"), F.pmod("doc_id", F.lit(1 << bits)).cast("int").alias("offset")
    )
    arranged = placed.repartition("term", "bucket").sortWithinPartitions("term", "bucket")
    return arranged.mapInArrow(run, "term string, bucket bigint, n_docs bigint, encoding string, data binary")


def container_postings(containers: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """``term, doc_id``: the documents that containers hold. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # at most 256 full buckets at a time
                part = batch.slice(at, 256)
                found = [decode(e, d) for e, d in zip(part.column("encoding").to_pylist(), part.column("data").to_pylist())]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                base = np.repeat(part.column("bucket").to_numpy() << bits, counts)
                row = pa.array(np.repeat(np.arange(len(found)), counts))
                ids = base + np.concatenate(found).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("term").take(row), pa.array(ids)], ["term", "doc_id"])

    return containers.select("term", "bucket", "encoding", "data").mapInArrow(run, "term string, doc_id bigint")


def bitmap_ids(bitmaps: DataFrame, column: str = "bitmap", width: int = 1 << 15) -> DataFrame:
    """``doc_id``: the documents marked in the bitmaps ``bucket, bitmap`` of ``build_bitmaps`` or of an AND or OR of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column(column).to_pylist()):
                marked = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
                yield pa.RecordBatch.from_arrays([pa.array((bucket - 1) * width + marked)], ["doc_id"])

    return bitmaps.where(F.col(column).isNotNull()).select("bucket", column).mapInArrow(run, "doc_id bigint")
