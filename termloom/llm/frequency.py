"""Occurrences and records of every term, by last-seen counters.

``term_frequencies`` is for records that are lists of terms, ``record_totals`` for
records of one term each with numbers to add up.

Tokens are partitioned by the hash of their record and ordered by record, so a
term's counters are three numbers: occurrences, records, and the record it was
last seen in, which tells whether the next occurrence opens a new record. No set
of records is kept per term, nor of terms per record. A record is never split,
so the counters of different partitions simply add up; a term with a third of
all tokens brings one row per partition to the sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms whose counters a task holds before it passes them on and starts afresh.
HELD_TERMS = 400_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place: dict[str, int] = {}
    seen, total, records = (np.zeros(1 << 16, np.int64) for _ in range(3))
    seen[:] = -1
    number, previous = 0, None

    def passed_on() -> pa.RecordBatch:
        n = len(place)
        out = [pa.array(list(place), pa.string()), pa.array(total[:n].copy()), pa.array(records[:n].copy())]
        place.clear()
        total[:], records[:], seen[:] = 0, 0, -1
        return pa.RecordBatch.from_arrays(out, ["term", "occurrences", "records"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("record").to_numpy(zero_copy_only=False)
        fresh = np.concatenate([[previous is None or keys[0] != previous], keys[1:] != keys[:-1]])
        if len(place) > HELD_TERMS and fresh[0]:
            yield passed_on()
        numbers = number + np.cumsum(fresh)
        number, previous = int(numbers[-1]), keys[-1]
        lists = batch.column("terms")
        flat = pc.list_flatten(lists)
        row = pc.list_parent_indices(lists).to_numpy()
        valid = flat.is_valid().to_numpy(zero_copy_only=False)
        if not valid.all():
            flat, row = flat.drop_null(), row[valid]
        if not len(flat):
            continue
        coded = flat.dictionary_encode()
        mapped = np.fromiter((place.setdefault(t, len(place)) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        while len(place) > len(seen):
            seen = np.concatenate([seen, np.full(len(seen), -1)])
            total, records = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (total, records))
        term, record = mapped[coded.indices.to_numpy()], numbers[row]
        order = np.argsort(term, kind="stable")  # keeps the order of records within a term
        term, record = term[order], record[order]
        first = np.concatenate([[True], term[1:] != term[:-1]])
        last_seen = np.where(first, seen[term], np.concatenate([[-1], record[:-1]]))
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(term))
        total[term[starts]] += ends - starts
        records[term[starts]] += np.add.reduceat((record != last_seen).astype(np.int64), starts)
        seen[term[starts]] = record[ends - 1]
    if place:
        yield passed_on()


def term_frequencies(df: DataFrame, record: str, terms: str, arranged: bool = False) -> DataFrame:
    """``term, occurrences, records`` of every distinct term.

    ``terms`` is a column of arrays of strings, ``record`` names the record an
    array belongs to; a record may have several rows. Null arrays, null terms and
    rows with a null record are left out, empty arrays add nothing, and an empty
    table gives no rows. Other columns are ignored. ``arranged`` says that the
    rows of each record already lie side by side in one partition, so that only
    the counters need a shuffle.
    """
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("_r"), F.col(terms).alias("terms"))
    if not arranged:
        rows = rows.repartition("_r").sortWithinPartitions("_r")
    counted = rows.select(F.xxhash64("_r").alias("record"), "terms").mapInArrow(
        _count, "term string, occurrences bigint, records bigint"
    )
    return counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _add(keys: int):
    """Totals per term of the first row of every record; rows come sorted by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str | None, int] = {}
        sums = np.zeros((keys + 1, 1 << 16), np.int64)
        last_seen = None

        def passed_on() -> pa.RecordBatch:
            n = len(place)
            out = [pa.array(list(place), pa.string()), *(pa.array(x[:n].copy()) for x in sums)]
            place.clear()
            sums[:] = 0
            return pa.RecordBatch.from_arrays(out, ["term", "records", *(f"v{i}" for i in range(keys))])

        for batch in batches:
            if not batch.num_rows:
                continue
            if len(place) > HELD_TERMS:
                yield passed_on()
            record = batch.column("record").to_numpy(zero_copy_only=False)
            opens = np.concatenate([[last_seen is None or record[0] != last_seen], record[1:] != record[:-1]])
            last_seen = record[-1]
            batch = batch.filter(pa.array(opens))
            coded = batch.column("term").dictionary_encode(null_encoding="encode")
            mapped = np.fromiter((place.setdefault(t, len(place)) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            while len(place) > sums.shape[1]:
                sums = np.concatenate([sums, np.zeros_like(sums)], axis=1)
            term = mapped[coded.indices.to_numpy()]
            np.add.at(sums[0], term, 1)
            for i in range(keys):
                np.add.at(sums[i + 1], term, batch.column(f"v{i}").to_numpy())
        if place:
            yield passed_on()

    return run


def record_totals(df: DataFrame, record: str, term: str, values: list[str], latest: str) -> DataFrame:
    """``term, records`` and the sum of every column of ``values``, for records that each have one term.

    A record may have several rows: they lie side by side, the one with the
    greatest ``latest`` first (nulls last, ties by term and values), and a term's counters take a
    row only if the record was not the last one seen. Null values add nothing, null
    terms form a term of their own, rows with a null record are left out. An empty
    table gives no rows; other columns are ignored.
    """
    rows = df.where(F.col(record).isNotNull()).select(
        F.col(record).alias("_r"), F.col(latest).alias("_l"), F.col(term).cast("string").alias("term"),
        *[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(f"v{i}") for i, v in enumerate(values)],
    )
    names = [f"v{i}" for i in range(len(values))]
    arranged = rows.repartition("_r").sortWithinPartitions("_r", F.col("_l").desc(), F.col("term").desc(), *[F.col(n).desc() for n in names])
    kinds = ", ".join(f"{n} bigint" for n in names)
    counted = arranged.select(F.xxhash64("_r").alias("record"), "term", *names).mapInArrow(_add(len(values)), f"term string, records bigint, {kinds}")
    return counted.groupBy("term").agg(F.sum("records").alias("records"), *[F.sum(n).alias(v) for n, v in zip(names, values)])
