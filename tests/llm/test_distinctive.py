import math

import numpy as np
import pytest

from termloom.llm import distinctive as d
from termloom.session import materialise


def one_by_one(histogram):
    """The same fit for one term, record by record."""
    counts = np.array([k for k, n in histogram for _ in range(n)], float)
    high, low, share, before = max(counts.max(), counts.mean() * 1.5), counts.mean() * 0.5, 0.1, np.inf
    for _ in range(d.STEPS):
        p, q = share * high**counts * math.exp(-high), (1 - share) * low**counts * math.exp(-low)
        elite = p / (p + q)
        share = elite.mean()
        high, low = max((elite * counts).sum() / elite.sum(), 1e-9), max(((1 - elite) * counts).sum() / (1 - elite).sum(), 1e-9)
        step = np.abs(elite - before).max()
        if step <= d.TOLERANCE:
            break
        before = elite
    return share, high, low, step


def test_fit_against_records():
    histograms = [[(0, 900), (1, 50), (2, 30), (5, 20)], [(0, 10), (1, 200), (2, 150), (3, 60), (9, 40), (11, 30)], [(0, 999), (3, 1)]]
    flat = [x for h in histograms for x in h]
    starts = np.cumsum([0] + [len(h) for h in histograms])[:-1]
    found = d.fit(np.array([k for k, _ in flat]), np.array([n for _, n in flat]), starts)
    for i, histogram in enumerate(histograms):
        assert [x[i] for x in found] == pytest.approx(one_by_one(histogram), rel=1e-6, abs=1e-8)
    share, high, _, step = found
    assert (step <= d.TOLERANCE).all()
    # Two clear kinds of records are told apart: 70 of 490 with about ten, the others with less than two.
    assert share[1] == pytest.approx(70 / 490, abs=0.02) and high[1] == pytest.approx(9.9, abs=0.3)


def test_scores(spark, monkeypatch):
    rows = [(i, "topic", 8 + i % 3, "p", False) for i in range(20)] + [(i, "topic", 1, "p", False) for i in range(20, 60)]
    rows += [(i, "the", 1 + i % 2, "p", True) for i in range(100)] + [(0, None, 3, "p", False), (1, "zero", 0, "p", False), (2, "once", 1, None, False)]
    postings = materialise(spark.createDataFrame(rows, "seq bigint, term string, tf bigint, df string, first boolean"), "test")
    bars = d.count_bars(postings)
    assert bars.agg({"begun": "sum"}).first()[0] == 100
    found = {(r.term, r.tf): r for r in d.elite_scores(bars, 100).collect()}
    assert set(found) == {("topic", 1), ("topic", 8), ("topic", 9), ("topic", 10), ("the", 1), ("the", 2), ("once", 1)}
    assert found["topic", 9].elite > 0.99 > 0.1 > found["topic", 1].elite
    assert found["topic", 1].df == 60 and found["topic", 1].n == 40
    scored, records = d.score_postings(postings)
    scored = scored.collect()
    assert records == 100 and len(scored) == 161
    assert all(r.df == {"topic": 60, "the": 100, "once": 1}[r.term] for r in scored)
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    for share in (0.0, 1 / 8, 100.0):  # common counts alone by broadcast: all, some, none
        monkeypatch.setattr(d, "HOT_SHARE", share)
        again = d.score_postings(postings)[0]
        assert sorted(map(tuple, again.select("seq", "term", "elite").collect())) == sorted((r.seq, r.term, r.elite) for r in scored)
    empty = materialise(postings.limit(0), "test")
    assert d.score_postings(empty)[0].count() == 0
