import math
import random

import pytest

from termloom.operators import skew


def expected(rows, q):
    groups = {}
    for k, v, _ in rows:
        groups.setdefault(k, []).append(v)
    found = {}
    for k, values in groups.items():
        known = sorted(v for v in values if v is not None)
        found[k] = (len(values), len(known), sum(known) if known else None, known[max(1, math.ceil(q * len(known))) - 1] if known else None)
    return found


@pytest.mark.parametrize("limit", [0, 100_000])
def test_profile_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)  # 0: every round is joined by salted shuffle
    monkeypatch.setattr(skew, "BINS", 4)
    rng = random.Random(5)
    rows = [("hot", rng.randint(-(10**9), 10**9), i) for i in range(700)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([None, 0, 1, 5, 5, 10**6, 10**12]), i) for i in range(300)]
    rows += [("none", None, 1), ("one", 2**61, 1), ("edge", 127, 1), ("edge", 128, 2), ("edge", 129, 3), ("edge", -128, 4)]
    df = spark.createDataFrame(rows, "k string, v bigint, rows bigint")
    for q, name in ((0.5, "q50"), (0.9, "q90")):
        found = skew.key_profile(df, "k", "v", quantiles=(q,)).collect()
        assert {r["k"]: (r["rows"], r["n_values"], r["sum_v"], r[name]) for r in found} == expected(rows, q)
        assert {r["all_rows"] for r in found} == {len(rows)}


def test_profile_of_nothing_and_clashing_names(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert skew.key_profile(df, "k", "v").count() == 0
    df = spark.createDataFrame([("x", 3, 7, 9), ("x", 3, 1, 9)], "_v string, _key bigint, _n bigint, _bin bigint")
    row = skew.key_profile(df, "_v", "_key", sums=["_n"], quantiles=(0.5, 1.0)).first()
    assert (row["rows"], row["sum__key"], row["sum__n"], row["q50"], row["q100"]) == (2, 6, 8, 3, 3)


def test_first_bins_are_monotone(spark):
    values = sorted({s * (2**e + o) for e in range(0, 61) for o in (-1, 0, 1) for s in (-1, 1)} | set(range(-300, 300)))
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    bins = [r[1] for r in df.select("v", skew._first_bin(df["v"])).orderBy("v").collect()]
    assert bins == sorted(bins)
    assert len(set(bins)) > 450  # within 1 in 32 of each other if they share one
