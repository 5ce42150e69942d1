import random
from collections import Counter, defaultdict

import pytest

from termloom.llm import packing as p
from termloom.session import materialise


def check_patterns(histogram, capacity):
    placed = Counter()
    for count, items in p.shortest_pack_first(histogram, capacity):
        assert count > 0 and sum(length * times for length, times in items) <= capacity
        for length, times in items:
            placed[length] += count * times
    assert placed == Counter(histogram)


def test_patterns():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.choice([1, 7, 30, 2048])
        histogram = {length: rng.choice([1, 2, 50, 10**7]) for length in rng.sample(range(1, capacity + 1), min(capacity, rng.randrange(1, 40)))}
        check_patterns(histogram, capacity)
        assert len(p.shortest_pack_first(histogram, capacity)) <= 4 * len(histogram) + 4
    check_patterns({length: 1 + length * 977 % 5000 for length in range(1, 2049)}, 2048)
    assert p.shortest_pack_first({}, 5) == []


def test_little_room_is_lost():
    rng = random.Random(8)
    histogram = Counter(min(2048, max(1, int(rng.lognormvariate(5.5, 0.8)))) for _ in range(20_000))
    used = sum(count for count, _ in p.shortest_pack_first(histogram, 2048))
    assert used <= 1.005 * sum(length * n for length, n in histogram.items()) / 2048 + 1


@pytest.mark.parametrize("lot", [100_000, 7])
def test_items(spark, monkeypatch, lot):
    monkeypatch.setattr(p, "LOT_ITEMS", lot)
    rng = random.Random(9)
    sizes = [rng.choice([0, None, 1, 3, 3, 3, 10, 25, 26, 77, rng.randrange(1, 60)]) for _ in range(400)]
    rows = [(i, s, 5) for i, s in enumerate(sizes)] + [(7, 3, 5), (7, 3, 5), (None, 4, 5), (None, 4, 5), (1000, -2, 5)]
    df = materialise(spark.createDataFrame(rows, "doc bigint, size bigint, length bigint"), "test")
    found = p.pack(df, "doc", "size", 25).collect()
    assert Counter(r.doc for r in found if r.piece == 0) == Counter(r[0] for r in rows)
    lengths, boxes = defaultdict(int), defaultdict(list)
    for r in found:
        lengths[r.doc] += r.length
        if r.length:
            boxes[r.container].append((r.start, r.length))
        else:
            assert r.container is None and r.start is None
    wanted = defaultdict(int)
    for key, size, _ in rows:
        wanted[key] += max(size or 0, 0)
    assert lengths == wanted
    assert sorted(boxes) == list(range(len(boxes)))
    for parts in boxes.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 25
    assert {r.doc for r in found if r.pieces > 1} == {r[0] for r in rows if (r[1] or 0) > 25}
    assert {r.pieces for r in found if r.doc is not None and r.doc < 400 and sizes[r.doc] == 77} <= {4}
    assert len(boxes) <= 1.03 * sum(lengths.values()) / 25 + 1


def test_nothing(spark):
    df = materialise(spark.createDataFrame([], "doc string, size bigint"), "test")
    assert p.pack(df, "doc", "size").count() == 0
    with pytest.raises(ValueError, match="capacity"):
        p.pack(df, "doc", "size", 0)


def test_large_capacities_and_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(p, "LOT_ITEMS", 2)
    sizes = [900_000, 700_000, 600_000, 400_000, 300_000, 5, 5, 5, 3 << 20]
    df = spark.createDataFrame([(None, s) for s in sizes], "doc bigint, size bigint")
    boxes = defaultdict(list)
    for r in p.pack(df, "doc", "size", 1 << 20).collect():
        boxes[r.container].append((r.start, r.length))
    for parts in boxes.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 1 << 20
    assert sorted(n for parts in boxes.values() for _, n in parts) == sorted([*sizes[:-1], *[1 << 20] * 3])
