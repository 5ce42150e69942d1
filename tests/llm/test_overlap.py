import random
import time

import pytest

from termloom.llm import overlap as o


def brute(sets):
    return {(s, a, b): (len(x), len(y), n) for (s, a), x in sets.items() for (t, b), y in sets.items() if s == t and a < b and (n := len(x & y))}


def found(df):
    return {(r.space, r.set_a, r.set_b): (r.n_a, r.n_b, r.shared) for r in df.collect()}


@pytest.mark.parametrize(("names", "local"), [(11, 10_000), (300, 100)])
def test_against_sets(spark, monkeypatch, names, local):
    # 600 sets are three blocks, which meet each other, and are not numbered on the driver.
    monkeypatch.setattr(o, "LOCAL_SETS", local)
    rng = random.Random(4)
    pool = [rng.choice([rng.randrange(200), rng.randrange(10**6), 2**40 + rng.randrange(3), -rng.randrange(100)]) for _ in range(400)]
    sets = {(s, f"t{a}"): set(rng.sample(pool, rng.choice([0, 1, 5, 60, 300]))) for s in ("x", "y") for a in range(names)}
    rows = [(s, a, m) for (s, a), x in sets.items() for m in [*x, *list(x)[:3]]] + [("x", "t0", None), ("x", None, 5), (None, "t1", 5)]
    members = spark.createDataFrame(rows, "space string, set string, member bigint").repartition(5)
    assert found(o.overlap_sizes(members)) == brute(sets)


def test_dense_sets_and_words(spark):
    sets = {("x", "a"): set(range(0, 100_000, 2)), ("x", "b"): set(range(50_000, 140_000)), ("x", "c"): {3, 60_000, 131_071}, ("y", "a"): {1}}
    rows = [(s, t, m, None) for (s, t), x in sets.items() for m in x] + [("x", "w", 64 * i, -1) for i in range(3)] + [("x", "v", 128, 5), ("x", "v", 130, None)]
    sets |= {("x", "w"): set(range(192)), ("x", "v"): {128, 130}}
    members = spark.createDataFrame(rows, "space string, set string, member bigint, word bigint").repartition(3)
    assert found(o.overlap_sizes(members)) == brute(sets)
    known = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "unused")], "space string, set string")
    assert found(o.overlap_sizes(members, known)) == {k: v for k, v in brute(sets).items() if k[1:] == ("a", "b")}
    assert o.overlap_sizes(members.limit(0)).count() == 0


def test_set_names_far_apart(spark):
    members = spark.createDataFrame([("x", "0", 7), ("x", "5000000", 7), ("x", "5000000", 8)], "space string, set string, member bigint")
    o.overlap_sizes(members).collect()
    began = time.time()
    assert found(o.overlap_sizes(members)) == {("x", "0", "5000000"): (1, 2, 1)}
    assert time.time() - began < 20


def test_identifiers(spark):
    rows = [("x", "a", i) for i in ("u", "v", "w", None)] + [("x", "b", i) for i in ("v", "w", "w", "z")] + [("y", "a", "v")]
    coded = o.encode_identifiers(spark.createDataFrame(rows, "space string, set string, member string"))
    assert {r.member for r in coded.collect()} == {0, 1, 2, 3}
    assert found(o.overlap_sizes(coded)) == {("x", "a", "b"): (3, 3, 2)}


def test_bytes_of_a_member():
    """Bytes sent per member: three at most in a sparse set, less than a bit and a half in one with every second member."""
    import numpy as np
    import pyarrow as pa

    def sent(members):
        n = len(members)
        batch = pa.RecordBatch.from_arrays([pa.array(["x"] * n), pa.array(np.zeros(n, np.int64)), pa.array(members), pa.nulls(n, pa.int64())], ["space", "no", "member", "word"])
        return sum(len(b) for out in o._bundles(iter([batch])) for c in ("places", "dense", "bitmaps") for b in out.column(c).to_pylist()) / n

    assert sent(np.arange(0, 10**6, 100)) == 3
    assert sent(np.arange(0, 2 * 65536, 2)) < 0.26
