import random

import numpy as np
import pytest

from termloom.llm import heavy_values as hv


def test_code_corrects_two_symbols():
    rng = np.random.default_rng(1)
    values = rng.integers(-(2**63), 2**63, 20)
    words = hv.encode(values)
    for value, word in zip(values, words):
        broken = word.copy()
        for at in rng.choice(hv.LENGTH, 2, replace=False):
            broken[at] ^= rng.integers(1, 256)
        assert hv.decode(word) == value == hv.decode(broken)
        broken[rng.choice(hv.LENGTH, 6, replace=False)] ^= 77
        assert hv.decode(broken) != value
    # Different values differ in at least five symbols.
    assert (words[:, None, :] != words[None, :, :]).sum(axis=2)[~np.eye(20, dtype=bool)].min() > hv.PARITY


def exact(values, share):
    known = [v for v in values if v is not None]
    return {v: known.count(v) for v in set(known) if known.count(v) >= share * len(known)}


def table(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, n bigint")


def test_against_counting(spark):
    rng = random.Random(2)
    values = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)] + ["hot"] * 3000 + [None] * 50 + ["", "é" * 3000, "x" * 39] * 60
    for share in (1 / 140, 1 / 40):
        rows = hv.heavy_values(table(spark, values).repartition(5), "v", share).collect()
        assert {r.v: r.n for r in rows} == exact(values, share)
        assert all(r.n_approx >= r.n for r in rows)


@pytest.mark.parametrize("rounds", [1, 4])
def test_many_values_of_one_count_in_few_groups(spark, monkeypatch, rounds):
    # 100 values with exactly the threshold each, and as many groups as make most share one.
    monkeypatch.setattr(hv, "ROUNDS", rounds)
    monkeypatch.setattr(hv.np, "ceil", lambda x: 4)
    values = [f"value {i}" for i in range(100)] * 7
    rows = hv.heavy_values(table(spark, values), "v", 1 / 100, hashes=1).collect()
    assert {r.v: r.n for r in rows} == exact(values, 1 / 100)
    assert len(rows) == 100


def test_nothing(spark):
    assert hv.heavy_values(table(spark, []), "v").count() == 0
    assert hv.heavy_values(table(spark, [None, None]), "v").count() == 0
    assert [tuple(r) for r in hv.heavy_values(table(spark, ["a"]), "v", 1).collect()] == [("a", 1, 1)]
    with pytest.raises(ValueError, match="share"):
        hv.heavy_values(table(spark, ["a"]), "v", 0)
