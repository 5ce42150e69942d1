"""Items of varying length in containers of fixed capacity, from the length histogram.

Which item goes where depends on lengths alone, so the plan is made for the
histogram, of at most ``capacity`` entries, whatever the number of items. Lengths
are placed longest first, each into the shortest packs that exist, those with the
most room, and only counts of patterns change. Items then find their container by their rank among items of the same
length, which is computed without bringing a length's items together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import materialise

#: Items ranked together; a length with more of them is dealt into several lots.
LOT_ITEMS = 100_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns ``(count, ((length, times), ...))``, every item of the histogram in exactly one.

    At most two patterns more per length, so their number is bounded by ``2 * capacity``.
    """
    by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    rooms: list[int] = []  # negative, as a heap gives the least first

    def add(room: int, count: int, items: tuple[tuple[int, int], ...]) -> None:
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(rooms, -room)
        by_room[room].append((count, items))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or -rooms[0] < length:
                # No open pack takes it: new ones, which stay the shortest until they are full.
                times = min(capacity // length, left)
                count = left // times
                add(capacity - times * length, count, ((length, times),))
                left -= count * times
                continue
            room = -heapq.heappop(rooms)
            waiting = by_room.pop(room)
            # The packs with most room take items until others have more.
            until = max(-rooms[0] if rooms else 0, 0)
            most = min(room // length, max(1, -(-(room - until) // length)))
            for count, items in waiting:
                times = min(most, left)
                used = min(count, left // times) if times else 0
                if used:
                    left -= used * times
                    add(room - times * length, used, (*items, (length, times)))
                if used < count:
                    add(room, count - used, items)
    return [pattern for room in sorted(by_room) for pattern in by_room[room]]


def _intervals(patterns) -> dict[str, np.ndarray]:
    """Which ranks of which length go to which containers; sorted by length and rank."""
    rows, taken, container = [], {}, 0
    for count, items in patterns:
        start = 0
        for length, times in items:
            first = taken.get(length, 0)
            rows.append((length, first, container, times, start, count * times))
            taken[length] = first + count * times
            start += length * times
        container += count
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "first", "container", "times", "start", "items"))}


def _assign(plan: dict[str, np.ndarray]):
    """Places of items by length and rank. Items of all lengths are numbered on, so that no length or rank is too large to find."""
    lengths, begins = np.unique(plan["length"], return_index=True)
    ends = np.append(begins[1:], len(plan["length"])) - 1
    filled = plan["first"][ends] + plan["items"][ends] if len(lengths) else begins
    before = np.cumsum(filled) - filled
    keys = before[np.searchsorted(lengths, plan["length"])] + plan["first"] if len(lengths) else begins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, before[np.searchsorted(lengths, length)] + rank, side="right") - 1
            within = rank - plan["first"][at]
            times = plan["times"][at]
            container = plan["container"][at] + within // times
            start = plan["start"][at] + (within % times) * length
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("piece"), batch.column("pieces"), batch.column("length"), pa.array(container), pa.array(start)],
                ["key", "piece", "pieces", "length", "container", "start"],
            )

    return run


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """``key, piece, pieces, length, container, start`` of every item.

    An item is one piece, ``pieces = 1``, unless its size exceeds ``capacity``:
    then it is cut into full containers and a rest. ``start`` is the piece's
    place in its container; pieces of a container neither overlap nor exceed
    ``capacity``. Items of size zero or null have one piece of length zero and a
    null container. Every row of ``sizes`` is an item, repeated rows too; null
    keys are items as well. Other columns are ignored; an empty table gives no
    rows. ``sizes`` is evaluated once, and its items are written to the shared folder.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    whole = sizes.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    pieces = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("bigint")
    cut = whole.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    length = F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint")
    numbered = cut.withColumn("length", length).select("key", "piece", "pieces", "length", F.monotonically_increasing_id().alias("number"))
    items = materialise(numbered, "items")
    filled = items.where("length > 0")
    # Bounded: at most ``capacity`` different lengths.
    histogram = {r["length"]: r["n"] for r in filled.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = _intervals(shortest_pack_first(histogram, capacity))
    kind = sizes.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece bigint, pieces bigint, length bigint, container bigint, start bigint"
    empty = items.where("length = 0").drop("number").select("*", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("start"))
    lots = max(1, -(-max(histogram.values(), default=0) // LOT_ITEMS))
    lot = F.pmod(F.xxhash64("number"), F.lit(lots)).cast("int")  # by number, as any number of items may have one key
    dealt = filled.withColumn("lot", lot)
    lot_sizes = dealt.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("lot")) - F.col("n")
    # As many rows as lengths and lots, not items.
    offsets = materialise(lot_sizes.select("length", "lot", before.alias("before")), "lots")
    within = F.row_number().over(Window.partitionBy("length", "lot").orderBy("number"))
    ranked = dealt.withColumn("within", within).join(offsets, ["length", "lot"])
    ranked = ranked.select("key", "piece", "pieces", "length", (F.col("before") + F.col("within") - 1).alias("rank"))
    packed = ranked.mapInArrow(_assign(plan), schema).unionByName(empty)
    return packed.withColumnRenamed("key", key)
