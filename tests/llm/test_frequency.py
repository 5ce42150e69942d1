import random
from collections import Counter

import pytest

from termloom.llm import frequency as f


@pytest.mark.parametrize("held", [400_000, 3])
def test_against_sets(spark, monkeypatch, held):
    monkeypatch.setattr(f, "HELD_TERMS", held)
    rng = random.Random(6)
    rows = []
    for record in range(300):
        for _ in range(rng.choice([1, 1, 2, 4])):  # a record may have several rows
            rows.append((record, rng.choice([None, [], [rng.choice(["the", "the", f"t{rng.randrange(80)}", None, ""]) for _ in range(rng.randrange(12))]]), "x"))
    rows.append((None, ["the"], "x"))
    occurrences, records = Counter(), {}
    for record, terms, _ in rows:
        for t in (terms or []) if record is not None else []:
            if t is not None:
                occurrences[t] += 1
                records.setdefault(t, set()).add(record)
    df = spark.createDataFrame(rows, "record bigint, terms array<string>, term string")
    found = f.term_frequencies(df, "record", "terms").collect()
    assert {r.term: (r.occurrences, r.records) for r in found} == {t: (n, len(records[t])) for t, n in occurrences.items()}
    assert f.term_frequencies(df.limit(0), "record", "terms").count() == 0


def test_long_record_and_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        df = spark.createDataFrame([(1, ["a"] * 100_000), (1, ["a", "b"]), (2, ["b"])], "record bigint, terms array<string>")
        found = {r.term: (r.occurrences, r.records) for r in f.term_frequencies(df, "record", "terms").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {"a": (100_001, 1), "b": (2, 2)}


@pytest.mark.parametrize("held", [400_000, 3])
def test_record_totals(spark, monkeypatch, held):
    monkeypatch.setattr(f, "HELD_TERMS", held)
    rng = random.Random(8)
    rows, latest = [], {}
    for record in range(400):
        for at in sorted(rng.sample(range(50), rng.choice([1, 1, 2, 3]))):
            row = (record, at if at else None, rng.choice([None, "", "hot", "hot", f"t{rng.randrange(40)}"]), rng.choice([None, 3, 10**12]), rng.randrange(9), "x")
            rows.append(row)
            if record not in latest or (row[1] or -1) > (latest[record][1] or -1):
                latest[record] = row
    rows += [(None, 1, "hot", 5, 5, "x")] + rows[:40]
    rng.shuffle(rows)
    wanted = {}
    for _, _, term, a, b, _ in latest.values():
        n, x, y = wanted.get(term, (0, 0, 0))
        wanted[term] = (n + 1, x + (a or 0), y + b)
    df = spark.createDataFrame(rows, "id bigint, at bigint, word string, a bigint, b bigint, term string").repartition(3)
    found = f.record_totals(df, "id", "word", ["a", "b"], "at").collect()
    assert {r.term: (r.records, r.a, r.b) for r in found} == wanted
    assert f.record_totals(df.limit(0), "id", "word", ["a"], "at").count() == 0
