"""Sizes of the intersections of many large sets, counted on compressed bitmaps by range.

Members are whole numbers; other identifiers are encoded first. Sets are numbered
densely. Every task turns the members it reads into containers by set and range of
2**16 members, a bitmap where a set is dense and offsets elsewhere, and bundles the
containers of a range and of 256 sets in one row, three bytes to a member of a
sparse set. Only bundles are shuffled. A task then holds one range of at most two
blocks of sets at a time, ands the bitmaps of every two sets, counts bits and adds
up over its ranges; what it passes on is one number per pair. Blocks meet only in
ranges that both have members in. No member of an intersection is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.ranking import global_rank
from termloom.operators.skew import join_unique
from termloom.session import materialise

#: Members in a range and sets in a block, as powers of two; offsets take 16 bits and sets of a block 8.
RANGE_BITS, BLOCK_BITS = 16, 8
BITMAP_BYTES = (1 << RANGE_BITS) // 8
#: From so many members in a range on, a bitmap takes less than a list.
DENSE = BITMAP_BYTES // 2
#: Members a task holds before it bundles them.
BUFFER = 1 << 19
#: Tasks over which the bundles of one range are dealt when they are sent to the blocks they meet.
SALTS = 8

_BUNDLE = "space string, range bigint, block bigint, places binary, dense binary, bitmaps binary"


def encode_identifiers(members: DataFrame) -> DataFrame:
    """``space, set, member`` with each different identifier replaced by a number from 0 on; null ones are left out.

    For identifiers that are strings, or numbers too far apart to share ranges.
    """
    rows = members.select("space", "set", F.col("member").alias("_id")).where("_id IS NOT NULL").distinct()
    numbers = global_rank(rows.select("_id").distinct(), ["_id"], "member")
    return join_unique(rows, materialise(numbers, "identifiers"), "_id", "inner").select("space", "set", "member")


def _bits_of(member: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and member of every set bit of words that begin at a member."""
    row, bit = np.nonzero((word[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1))
    return row, member[row] + bit


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held, size = [], 0

    def bundle() -> Iterator[pa.RecordBatch]:
        space, no, member = np.concatenate(held, axis=1)
        held.clear()
        order = np.lexsort((member, no, member >> RANGE_BITS, no >> BLOCK_BITS, space))
        space, no, member = space[order], no[order], member[order]
        fresh = np.ones(len(no), bool)
        fresh[1:] = (member[1:] != member[:-1]) | (no[1:] != no[:-1])
        space, no, member = space[fresh], no[fresh], member[fresh]
        key = np.stack([space, no >> BLOCK_BITS, member >> RANGE_BITS])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        local, offset = (no & ((1 << BLOCK_BITS) - 1)).astype(np.uint8), (member & ((1 << RANGE_BITS) - 1)).astype("<u2")
        shown, rows = list(names), []
        for start, end in zip(starts, np.append(starts[1:], len(no))):
            mine, at = local[start:end], offset[start:end]
            dense = np.flatnonzero(np.bincount(mine) > DENSE).astype(np.uint8)
            thin = ~np.isin(mine, dense)
            flags = np.zeros((len(dense), 1 << RANGE_BITS), np.uint8)
            for i, d in enumerate(dense):
                flags[i, at[mine == d]] = 1
            bitmaps = np.packbits(flags, axis=1, bitorder="little").tobytes()
            places = mine[thin].tobytes() + at[thin].tobytes()
            rows.append((shown[key[0, start]], int(key[2, start]), int(key[1, start]), places, dense.tobytes(), bitmaps))
        for i in range(0, len(rows), 1000):
            columns = zip(zip(*rows[i : i + 1000]), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["space", "range", "block", "places", "dense", "bitmaps"])

    for batch in batches:
        for at in range(0, batch.num_rows, BUFFER // 64):
            part = batch.slice(at, BUFFER // 64)
            coded = part.column("space").dictionary_encode()
            place = np.array([names.setdefault(s, len(names)) for s in coded.dictionary.to_pylist()], np.int64)
            space, no = place[coded.indices.to_numpy()], part.column("no").to_numpy()
            member, word = part.column("member").to_numpy(), part.column("word")
            single = word.is_null().to_numpy(zero_copy_only=False)
            whole = word.fill_null(0).to_numpy().view(np.uint64)
            held.append(np.stack([space[single], no[single], member[single]]))
            if not single.all():
                row, found = _bits_of(member[~single], whole[~single])
                held.append(np.stack([space[~single][row], no[~single][row], found]))
                size += len(found)
            size += int(single.sum())
            if size >= BUFFER:
                yield from bundle()
                size = 0
    if size:
        yield from bundle()


def _matrix(rows: list[tuple], columns: np.ndarray | None) -> np.ndarray:
    """Bitmaps of a block's sets in one range, over the given offsets or over all."""
    width = -(-len(columns) // 64) if columns is not None else (1 << RANGE_BITS) // 64
    bits = np.zeros((1 << BLOCK_BITS, width), np.uint64)
    for local, offset, dense, bitmaps in rows:
        at = np.searchsorted(columns, offset) if columns is not None else offset.astype(np.int64)
        np.bitwise_or.at(bits, (local, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        if len(dense):
            bits[dense] |= bitmaps.view(np.uint64).reshape(len(dense), -1)
    return bits


def _read(places: bytes, dense: bytes, bitmaps: bytes) -> tuple:
    n = len(places) // 3
    return (
        np.frombuffer(places, np.uint8, n), np.frombuffer(places, "<u2", n, offset=n),
        np.frombuffer(dense, np.uint8), np.frombuffer(bitmaps, np.uint8),
    )


def _intersections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts within one partition, whose rows come sorted by space, pair of blocks and range."""
    block = 1 << BLOCK_BITS
    total, held, current = np.zeros((block, block), np.int64), [], None

    def add() -> None:
        """Add one range's intersections."""
        _, a, b, _ = current
        sides = [[_read(*r[1:]) for r in held if r[0] == number] for number in dict.fromkeys((a, b))]
        rows = [r for side in sides for r in side]
        columns = None if any(len(r[2]) for r in rows) else np.unique(np.concatenate([r[1] for r in rows]))
        left, right = _matrix(sides[0], columns), _matrix(sides[-1], columns)
        used = np.flatnonzero(right.any(axis=1))
        for i in np.flatnonzero(left.any(axis=1)):
            words = np.flatnonzero(left[i])
            total[i, used] += np.bitwise_count(right[np.ix_(used, words)] & left[i, words]).sum(axis=1, dtype=np.int64)

    def pairs() -> pa.RecordBatch:
        _, a, b, _ = current
        i, j = np.nonzero(total)
        keep = (a * block + i) <= (b * block + j)
        i, j = i[keep], j[keep]
        found = pa.RecordBatch.from_arrays([pa.array(a * block + i), pa.array(b * block + j), pa.array(total[i, j])], ["no_a", "no_b", "shared"])
        total[:] = 0
        return found

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("space", "a", "b", "range", "block", "places", "dense", "bitmaps"))):
            if row[:4] != current:
                if current is not None:
                    add()
                    held = []
                    if row[:3] != current[:3]:
                        yield pairs()
                current = row[:4]
            held.append(row[4:])
    if current is not None:
        add()
        yield pairs()


#: Sets that are numbered on the driver; more are ranked by range partitions.
LOCAL_SETS = 10_000


def _numbered(keys: DataFrame) -> tuple[DataFrame, int, int]:
    """``key, no`` of different keys in their order, how many there are, and their bytes."""
    some = keys.limit(LOCAL_SETS + 1).collect()
    if len(some) <= LOCAL_SETS:
        rows = [(k, i) for i, k in enumerate(sorted(r["key"] for r in some))]
        local = keys.sparkSession.createDataFrame(rows, keys.select("key", F.lit(0).cast("bigint").alias("no")).schema)
        return local, len(rows), sum(len((k.space + k.set).encode()) + 40 for k, _ in rows)
    numbered = materialise(global_rank(keys, ["key"], "no"), "sets")
    size = F.sum(F.octet_length("key.space") + F.octet_length("key.set") + 40)
    count, measured = numbered.agg(F.count(F.lit(1)), size).first()
    return numbered, count, measured


def overlap_sizes(members: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """``space, set_a, set_b, n_a, n_b, shared`` of every two sets of one space that share a member, ``set_a < set_b``.

    ``members`` has rows ``space, set, member``, and may have ``word``: the row then
    stands for the members ``member`` to ``member + 63`` whose bits are set in it.
    Rows with a null space, set or member are left out, repeats count once. ``sets``
    are the different ``space, set`` that may occur, which saves reading ``members``
    for them; rows of others are left out. Empty sets are in no row.
    """
    sound = members.where("space IS NOT NULL AND set IS NOT NULL AND member IS NOT NULL")
    known = sound if sets is None else sets.where("space IS NOT NULL AND set IS NOT NULL")
    key = F.struct(F.col("space").cast("string").alias("space"), F.col("set").cast("string").alias("set")).alias("key")
    numbered, count, size = _numbered(known.select(key).distinct())
    blocks = -(-count // (1 << BLOCK_BITS))
    word = F.col("word").cast("bigint") if "word" in members.columns else F.lit(None).cast("bigint")
    rows = sound.select(key, F.col("member").cast("bigint").alias("member"), word.alias("word"))
    placed = join_unique(rows, numbered, "key", "inner", size=size).select("key.space", "no", "member", "word")
    bundles = placed.mapInArrow(_bundles, _BUNDLE)
    if blocks <= 1:
        dealt = bundles.withColumns({"a": F.col("block"), "b": F.col("block")})
    else:
        bundles = materialise(bundles, "bundles").withColumn("_salt", F.pmod(F.xxhash64("block", "places", "dense"), F.lit(SALTS)))
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        present = bundles.select("space", "range", F.col("block").alias("_other")).distinct().withColumn("_salt", salts)
        met = bundles.join(present, ["space", "range", "_salt"])
        dealt = met.withColumns({"a": F.least("block", "_other"), "b": F.greatest("block", "_other")})
    order = ["space", "a", "b", "range"]
    arranged = dealt.select(*order, "block", "places", "dense", "bitmaps").repartition(*order).sortWithinPartitions(*order)
    counted = arranged.mapInArrow(_intersections, "no_a bigint, no_b bigint, shared bigint")
    sizes = materialise(counted.groupBy("no_a", "no_b").agg(F.sum("shared").alias("shared")), "overlaps")
    own = sizes.where("no_a = no_b").select(F.col("no_a").alias("no"), F.col("shared").alias("n"))
    described = numbered.join(own, "no")
    pairs = sizes.where("no_a < no_b")
    for side in "ab":
        names = described.select(F.col("no").alias(f"no_{side}"), F.col("key").alias(f"key_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = join_unique(pairs, names, f"no_{side}", "inner", size=size)
    return pairs.select("key_a.space", F.col("key_a.set").alias("set_a"), F.col("key_b.set").alias("set_b"), "n_a", "n_b", "shared")
