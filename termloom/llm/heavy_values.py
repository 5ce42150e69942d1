"""Most frequent values of a huge column in bounded memory, by code-based identification.

Pass 1 hashes every value to a 64-bit fingerprint, sends the fingerprint to one
of ``groups`` groups (several times, with independent hashes), and writes it as
a Reed-Solomon codeword of ``LENGTH`` symbols over GF(256). All that is kept is
one counter per (hash, group, position, symbol): a fixed number, whatever the
number of values; a task sends a group's counters as one compressed row. Counters only ever grow by true occurrences, so at each
position the symbol of a value with at least ``share`` of all rows counts at
least that much, and at most ``1 / share`` symbols of a position do.

The driver gets just these heavy symbols, at most ``hashes * LENGTH / share``
rows, and decodes fingerprints from them: the largest symbol at each position
gives a word, the code corrects positions where another value is larger, the
word's counts are taken off, and so on. Pass 2 counts the values of the decoded
fingerprints exactly. What the exact counts leave of the heavy symbols then
proves that no frequent value is missing; if it does not, the round is repeated
with other hashes and more groups, and finally the groups in doubt are counted
exactly.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import materialise

MESSAGE, PARITY = 8, 4
LENGTH = MESSAGE + PARITY
#: Fingerprints buffered before they go into the counters.
BUFFER = 1 << 18
ROUNDS = 4


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Multiplication table and inverses of GF(256) with the polynomial 0x11D."""
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = (x << 1) ^ (0x11D if x & 0x80 else 0)
    times = np.zeros((256, 256), np.uint8)
    nonzero = np.arange(1, 256)
    times[1:, 1:] = exp[log[nonzero][:, None] + log[nonzero][None, :]]
    inverse = np.zeros(256, np.uint8)
    inverse[1:] = exp[255 - log[nonzero]]
    return times, inverse


TIMES, INVERSE = _field()
#: Columns of the systematic generator: identity, then a Cauchy matrix, so any MESSAGE positions determine the rest.
GENERATOR = np.concatenate(
    [np.eye(MESSAGE, dtype=np.uint8), INVERSE[np.arange(MESSAGE)[:, None] ^ np.arange(MESSAGE, LENGTH)[None, :]]], axis=1
)


def encode(fingerprints: np.ndarray) -> np.ndarray:
    """Codewords, one row of LENGTH symbols per fingerprint."""
    message = np.ascontiguousarray(fingerprints, dtype="<i8").view(np.uint8).reshape(-1, MESSAGE)
    word = np.zeros((len(message), LENGTH), np.uint8)
    word[:, :MESSAGE] = message
    for j in range(MESSAGE, LENGTH):
        for i in range(MESSAGE):
            word[:, j] ^= TIMES[GENERATOR[i, j]][message[:, i]]
    return word


def _solver(positions: tuple[int, ...]) -> np.ndarray:
    """Matrix that turns the symbols at MESSAGE positions into the message."""
    a = np.concatenate([GENERATOR[:, list(positions)].T.copy(), np.eye(MESSAGE, dtype=np.uint8)], axis=1)
    for c in range(MESSAGE):
        pivot = c + int(np.flatnonzero(a[c:, c])[0])
        a[[c, pivot]] = a[[pivot, c]]
        a[c] = TIMES[INVERSE[a[c, c]]][a[c]]
        for r in range(MESSAGE):
            if r != c and a[r, c]:
                a[r] ^= TIMES[a[r, c]][a[c]]
    return a[:, MESSAGE:]


_SOLVERS: list[tuple[tuple[int, ...], np.ndarray]] = []


def decode(word: np.ndarray) -> int | None:
    """The fingerprint of the codeword within PARITY // 2 symbols of ``word``, if there is one."""
    if not _SOLVERS:
        for bad in combinations(range(LENGTH), PARITY // 2):
            use = tuple(p for p in range(LENGTH) if p not in bad)[:MESSAGE]
            _SOLVERS.append((use, _solver(use)))
    for use, solve in _SOLVERS:
        part = TIMES[solve, word[list(use)][None, :]]
        message = np.bitwise_xor.reduce(part, axis=1).astype(np.uint8)
        value = int(message.view("<i8")[0])
        if (encode(np.array([value]))[0] != word).sum() <= PARITY // 2:
            return value
    return None


def group_of(fingerprints: np.ndarray, hashes: int, groups: int, seed: int) -> np.ndarray:
    """Group numbers, one row per hash; ``groups`` is a power of two."""
    rows = []
    for r in range(hashes):
        x = fingerprints.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (seed * hashes + r + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        rows.append(((x ^ (x >> np.uint64(31))) & np.uint64(groups - 1)).astype(np.int64))
    return np.stack(rows)


#: Counters of a group: one per position and symbol.
GROUP_CELLS = LENGTH * 256


def _packed(counters: np.ndarray) -> bytes:
    """Counters of a group in the narrowest type, compressed."""
    kind = np.min_scalar_type(int(counters.max())).newbyteorder("<")
    return kind.str.encode() + zlib.compress(counters.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[3:]), np.dtype(data[:3].decode())).astype(np.int64)


def _sketch(hashes: int, groups: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held, size = np.zeros((hashes * groups, GROUP_CELLS), np.int64), [], 0

        def flush() -> None:
            if not held:
                return
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            words, group = encode(values).astype(np.int64), group_of(values, hashes, groups, seed)
            flat = counters.reshape(-1)
            for r in range(hashes):
                at = ((r * groups + group[r])[:, None] * LENGTH + np.arange(LENGTH)[None, :]) * 256 + words
                np.add.at(flat, at.ravel(), np.repeat(counts, LENGTH))

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= BUFFER:
                flush()
                size = 0
        flush()
        used = np.flatnonzero(counters.any(axis=1))
        for part in np.array_split(used, len(used) // 1000 + 1):
            data = [_packed(counters[i]) for i in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(data, pa.binary())], ["block", "counters"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per group, from the rows of all tasks, which come sorted by group."""
    names, current, total = ["block", "n", "counters"], None, None

    def whole() -> pa.RecordBatch:
        n = int(total[:256].sum())  # every value has one symbol at the first position
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([n]), pa.array([_packed(total)], pa.binary())], names)

    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist()):
            if block != current:
                if current is not None:
                    yield whole()
                current, total = block, np.zeros(GROUP_CELLS, np.int64)
            total += _unpacked(data)
    if current is not None:
        yield whole()


def _heavy(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist()):
                counters = _unpacked(data)
                at = np.flatnonzero(counters >= least)
                yield pa.RecordBatch.from_arrays([pa.array(block * GROUP_CELLS + at), pa.array(counters[at])], ["cell", "n"])

    return run


def _peel(columns: list[dict[int, int]], least: float, belongs) -> list[tuple[int, int]]:
    """Fingerprints (with estimated counts) whose codewords the heavy symbols of one group hold."""
    found = []
    while all(columns):
        best = np.array([max(c, key=c.get) for c in columns], np.uint8)
        value = decode(best)
        if value is None or not belongs(value):
            value = next((v for v in _combinations(columns) if belongs(v)), None)
        if value is None:
            break
        word = encode(np.array([value]))[0]
        counts = [c.get(int(s), 0) for c, s in zip(columns, word)]
        estimate = min([n for n in counts if n] or [0])
        if sum(n > 0 for n in counts) < LENGTH - PARITY // 2 or estimate == 0:
            break
        found.append((value, estimate))
        for c, s in zip(columns, word):
            if (left := c.pop(int(s), 0) - estimate) >= least:
                c[int(s)] = left
    return found


def _combinations(columns: list[dict[int, int]]) -> Iterator[int]:
    """Messages made of the two largest symbols of each position, where all parity symbols are heavy too."""
    tops = [sorted(c, key=c.get, reverse=True)[:2] for c in columns]
    messages = np.array(list(product(*tops[:MESSAGE])), np.uint8)
    words = encode(messages.reshape(-1).view("<i8"))
    heavy = np.ones(len(words), bool)
    for j in range(MESSAGE, LENGTH):
        heavy &= np.isin(words[:, j], list(columns[j]))
    yield from (int(v) for v in messages[heavy].reshape(-1).view("<i8"))


def heavy_values(df: DataFrame, value: str, share: float = 1 / 140, hashes: int = 2) -> DataFrame:
    """``value, n, n_approx``: every value with at least ``share`` of the non-null rows.

    ``n`` is the exact count, ``n_approx`` the sketch's estimate (never too low,
    save that a value found only by the last, exact step has ``n`` there). Null
    values are not counted; the empty string is a value like any other. Ties at
    the threshold are all kept. No rows or only nulls give an empty result. Other
    columns are ignored. ``df`` is evaluated twice: once for the sketch, once for
    the candidates.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    spark = df.sparkSession
    rows = df.select(F.col(value).cast("string").alias("_value")).where("_value IS NOT NULL")
    print_of: Column = F.xxhash64("_value")
    schema = f"{value} string, n bigint, n_approx bigint"
    known: dict[int, int] = {}
    # Few groups to begin with, as every task sends its counters: two frequent values to a group if there are as many as can be.
    groups = 1 << max(4, int(np.ceil(np.log2(0.5 / share))))
    for seed in range(ROUNDS):
        groups <<= 2 * bool(seed)
        parts = rows.select(print_of.alias("f")).mapInArrow(_sketch(hashes, groups, seed), "block bigint, counters binary")
        arranged = parts.repartition("block").sortWithinPartitions("block")
        counters = materialise(arranged.mapInArrow(_add_up, "block bigint, n bigint, counters binary"), "symbols")
        total = counters.where(F.col("block") < groups).agg(F.sum("n")).first()[0] or 0
        if not total:
            return spark.createDataFrame([], schema)
        least = share * total
        # Bounded: at most 1 / share symbols of each position of each hash are this heavy.
        heavy = counters.select("block", "counters").mapInArrow(_heavy(least), "cell bigint, n bigint").collect()
        columns: dict[tuple[int, int], list[dict[int, int]]] = defaultdict(lambda: [{} for _ in range(LENGTH)])
        for cell, n in heavy:
            place, symbol = divmod(cell, 256)
            place, position = divmod(place, LENGTH)
            columns[divmod(place, groups)][position][symbol] = n
        for (r, g), symbols in columns.items():
            belongs = lambda v, r=r, g=g: group_of(np.array([v]), hashes, groups, seed)[r, 0] == g
            for fingerprint, estimate in _peel([dict(c) for c in symbols], least, belongs):
                known[fingerprint] = min(estimate, known.get(fingerprint, estimate))
        exact = rows.where(print_of.isin(list(known))) if known else rows.limit(0)
        counts = materialise(exact.groupBy("_value").agg(F.count(F.lit(1)).alias("n")).withColumn("f", print_of), "candidates")
        # Bounded: as many rows as candidates, but for fingerprints that collide.
        found = counts.groupBy("f").agg(F.sum("n").alias("n")).collect()
        doubt = _in_doubt(columns, found, least, hashes, groups, seed)
        if doubt is None:
            break
    else:
        at, open_groups = doubt[0], np.array(sorted(doubt[1]))

        def in_doubt(fingerprints: pd.Series) -> pd.Series:
            return pd.Series(np.isin(group_of(fingerprints.to_numpy(), hashes, groups, seed)[at], open_groups))

        rest = rows.where(F.pandas_udf(in_doubt, "boolean")(print_of)).groupBy("_value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        counts = counts.unionByName(rest.withColumn("f", print_of)).dropDuplicates(["_value"])
    guesses = spark.createDataFrame(list(known.items()) or [(0, 0)], "f bigint, guess bigint")
    kept = counts.where(F.col("n") >= F.lit(least)).join(guesses, "f", "left")
    approximate = F.greatest(F.col("n"), F.coalesce("guess", "n"))
    return kept.select(F.col("_value").alias(value), "n", approximate.alias("n_approx"))


def _in_doubt(columns, found, least, hashes, groups, seed) -> tuple[int, set[int]] | None:
    """None if some hash has no group left that could hide a frequent value; else the hash with fewest such groups."""
    left = {k: [dict(c) for c in v] for k, v in columns.items()}
    if found:
        values = np.array([f for f, _ in found], np.int64)
        words, at = encode(values), group_of(values, hashes, groups, seed)
        for i, (_, n) in enumerate(found):
            for r in range(hashes):
                for c, s in zip(left.get((r, int(at[r, i])), []), words[i]):
                    if int(s) in c:
                        c[int(s)] -= n
    open_groups: list[set[int]] = [set() for _ in range(hashes)]
    for (r, g), symbols in left.items():
        if all(any(n >= least for n in c.values()) for c in symbols):
            open_groups[r].add(g)
    fewest = min(range(hashes), key=lambda r: len(open_groups[r]))
    return (fewest, open_groups[fewest]) if open_groups[fewest] else None
