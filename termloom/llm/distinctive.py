"""How much a term says about a record: two-Poisson mixtures fitted on frequency histograms.

A term's counts over all records are taken for a mixture of two Poisson
distributions, one of the records that are about the term (the elite) and one of
those that merely mention it. Expectation-maximisation needs only the term's
histogram (how many records have the count 0, 1, 2, ...), which is small however
many records there are; the posterior probability of the elite component then
scores every count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialise

#: A term's fit ends when a step moves no posterior of its counts by more than this, or after so many steps.
TOLERANCE, STEPS = 1e-3, 100
#: A (term, count) that alone holds this share of what a reducer gets is joined by broadcast.
HOT_SHARE = 1 / 8
#: Bytes of scores that may be broadcast whole.
BROADCAST_BYTES = 8_000_000


def fit(counts: np.ndarray, records: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixture of every term: elite share, elite mean, other mean; and how far the last step moved a posterior.

    ``counts`` and ``records`` are the concatenated histograms, ``starts`` the
    first index of each term's. Each term stops by itself, so that its fit depends
    on its own histogram alone. It stops by posteriors, as they are what is used:
    the parameters of a term that is not mixed drift on without moving them.
    """
    sizes = np.diff(np.append(starts, len(counts)))
    n, k = records.astype(float), counts.astype(float)
    everything = np.add.reduceat(n, starts)
    mean = np.add.reduceat(n * k, starts) / everything
    high, low = np.maximum(np.maximum.reduceat(k, starts), mean * 1.5), mean * 0.5
    share, step = np.full(len(starts), 0.1), np.full(len(starts), np.inf)
    live, before = np.arange(len(starts)), np.full(len(k), np.inf)
    for _ in range(STEPS):
        if not len(live):
            break
        begins = np.cumsum(sizes[live]) - sizes[live]
        term = np.repeat(np.arange(len(live)), sizes[live])
        posterior = 1 / (1 + np.exp(-_odds(k, share[live][term], high[live][term], low[live][term])))
        elite, whole = n * posterior, everything[live]
        total = lambda x, at=begins: np.add.reduceat(x, at)
        weight = np.clip(total(elite), 1e-9, whole - 1e-9)
        share[live] = weight / whole
        high[live] = np.maximum(total(elite * k) / weight, 1e-9)
        low[live] = np.maximum(total((n - elite) * k) / (whole - weight), 1e-9)
        step[live] = np.maximum.reduceat(np.abs(posterior - before), begins)
        moving = step[live] > TOLERANCE
        inside = moving[term]
        n, k, before, live = n[inside], k[inside], posterior[inside], live[moving]
    swap = low > high
    high[swap], low[swap], share[swap] = low[swap], high[swap], 1 - share[swap]
    return share, high, low, step


def _odds(k: np.ndarray, share: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Logarithm of the odds that a count comes from the elite component."""
    return np.clip(np.log(share) - np.log(1 - share) + k * (np.log(high) - np.log(low)) - high + low, -700, 700)


def _fit_batches(records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            histogram = batch.column("h")
            lengths = np.diff(histogram.offsets.to_numpy()).astype(np.int64)
            flat = histogram.flatten()
            k, n = flat.field("tf").to_numpy(), flat.field("n").to_numpy()
            term = np.repeat(np.arange(batch.num_rows), lengths)
            df = np.bincount(term, n, batch.num_rows).astype(np.int64)
            # The records without the term come first in its histogram.
            ends = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            all_k, all_n = np.insert(k, ends, 0), np.insert(n, ends, np.maximum(records - df, 0))
            share, high, low, step = fit(all_k, all_n, ends + np.arange(batch.num_rows))
            odds = _odds(k.astype(float), share[term], high[term], low[term])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("term").take(pa.array(term)),
                    pa.array(k),
                    pa.array(n),
                    pa.array(df[term]),
                    pa.array(1 / (1 + np.exp(-odds))),
                    pa.array(step[term]),
                ],
                ["term", "tf", "n", "df", "elite", "step"],
            )

    return run


def count_bars(postings: DataFrame) -> DataFrame:
    """``term, tf, n, begun``: records with each count of each term, from rows ``term, tf, first``.

    ``first`` is true for just one row of every record, so the sum of ``begun`` over
    all rows is the number of records. Null terms and counts below one are no bars,
    but are rows of their records.
    """
    begun = F.count_if("first")
    sound = F.col("term").isNotNull() & (F.col("tf") >= 1)
    return postings.groupBy(
        F.when(sound, F.col("term")).alias("term"), F.when(sound, F.col("tf").cast("bigint")).alias("tf")
    ).agg(F.count(F.lit(1)).alias("n"), begun.alias("begun"))


def elite_scores(bars: DataFrame, records: int) -> DataFrame:
    """``term, tf, n, df, elite, step``: a score for every count that occurs of every term.

    ``bars`` has a row ``term, tf, n`` per different count of a term, as of
    ``count_bars``; ``n`` is the number of records with that count, ``df`` that of
    records with the term, ``elite`` the posterior probability that such a record
    is about the term, ``step`` the last move of any of the term's posteriors.
    ``records`` counts all records. Rows with a null ``term`` are left out.
    """
    sound = bars.where("term IS NOT NULL")
    # As many entries as a term has different counts, which is at most the longest record's length.
    histograms = sound.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("tf", "n"))).alias("h"))
    return histograms.mapInArrow(_fit_batches(records), "term string, tf bigint, n bigint, df bigint, elite double, step double")


def score_postings(postings: DataFrame) -> tuple[DataFrame, int]:
    """``postings`` with ``df`` and ``elite`` of each row's term and count, and the number of records.

    ``postings`` has rows ``term, tf, first`` (see ``count_bars``) and must be a
    written table, as it is read twice. Scores that are few are broadcast. Else
    counts so common that one task would get too many of their rows are joined by
    broadcast: there are at most ``8 * partitions`` of them. Columns named ``n``,
    ``df``, ``elite`` or ``step`` of ``postings`` are replaced. Rows with a null term or a
    count below one are left out.
    """
    rows = postings.drop("n", "df", "elite", "step", "first")
    bars = materialise(count_bars(postings), "bars")
    sizes = bars.agg(F.sum("begun"), F.sum("n"), F.sum(F.octet_length("term") + 40)).first()
    records, total, size = (x or 0 for x in sizes)
    scores = elite_scores(bars, records).select("term", "tf", "n", "df", "elite")
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(scores.drop("n")), ["term", "tf"]), records
    scores = materialise(scores, "scores")
    reducers = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = F.col("n") >= F.lit(HOT_SHARE * total / reducers)
    keys = [f"{r.tf} {r.term}" for r in scores.where(often).select("term", "tf").collect()]
    is_hot = F.concat_ws(" ", F.col("tf").cast("string"), "term").isin(keys) if keys else F.lit(False)
    common = rows.where(is_hot).join(F.broadcast(scores.where(often).drop("n")), ["term", "tf"])
    others = rows.where(~is_hot).join(scores.where(~often).drop("n"), ["term", "tf"])
    return common.unionByName(others), records
