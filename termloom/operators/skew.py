"""Totals and exact quantiles per key when a few keys hold most rows.

Nothing is ever gathered by key. Totals come from sums that combine on the map
side. Quantiles come from value histograms, which are mergeable counts too: each
round counts the values of every open (key, rank) in a few hundred bins of its
current range, finds the bin that holds the rank, and goes on inside that bin
until the rank meets the bin's least or greatest value. A key with a third of
all rows costs its tasks a few hundred counters, as any other key does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import materialise

#: Bins a range is cut into in each refining round.
BINS = 256
#: Leading bits, after the first one, that the bins of the first round keep.
MANTISSA_BITS = 5
#: Open ranges that may be broadcast (about 60 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000


#: Bytes of a table that may be broadcast in ``join_unique``.
BROADCAST_BYTES = 32_000_000


def join_unique(rows: DataFrame, table: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """``rows`` joined with the row of ``table`` that has their key; null keys are equal to each other.

    ``table`` has at most one row per key. Its ``size`` in bytes is measured, which
    reads it, unless it is given. A table of up to ``limit`` bytes is broadcast. Else both are shuffled, and the rows of keys with
    a large share of ``rows`` are dealt over many tasks, their row of the table to
    each of these. ``how`` is ``left`` or ``inner``.
    """
    other = table.withColumnRenamed(key, "_k")
    match = F.col(key).eqNullSafe(F.col("_k"))
    if size is None:
        size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= limit:
        return rows.join(F.broadcast(other), match, how).drop("_k")
    spread = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    # Bounded: at most ``spread`` keys have such a share of the rows.
    hot = [r[0] for r in sizes.where(F.col("n") * spread >= total).select(key).collect()]
    none = F.lit(0).cast("bigint")
    salts = F.when(_listed("_k", hot), F.sequence(none, F.lit(spread - 1).cast("bigint"))).otherwise(F.array(none))
    salted = other.withColumn("_salt", F.explode(salts))
    dealt = rows.withColumn("_s", F.when(_listed(key, hot), F.pmod(F.monotonically_increasing_id(), F.lit(spread))).otherwise(none))
    return dealt.join(salted, match & (F.col("_s") == F.col("_salt")), how).drop("_k", "_s", "_salt")


def _listed(key: str, values: list) -> Column:
    """Whether a key is one of some values, null included; never null itself."""
    some = [v for v in values if v is not None]
    found = F.coalesce(F.col(key).isin(some), F.lit(False)) if some else F.lit(False)
    return found | (F.col(key).isNull() if None in values else F.lit(False))


def _first_bin(value: Column) -> Column:
    """Bin of a whole number, monotone in it: sign, exponent and leading bits."""
    shift = lambda bits: F.call_function("shiftright", size, bits)
    size = F.abs(value)
    exponent = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) - MANTISSA_BITS, F.lit(0)).cast("int")
    # log2 may round up just below a power of two.
    exponent = F.when((exponent > 0) & (shift(exponent) < 1 << MANTISSA_BITS), exponent - 1).otherwise(exponent)
    code = exponent * (1 << MANTISSA_BITS) + shift(exponent)
    return F.when(value < 0, -code).otherwise(code).cast("int")


def _locate(bins: DataFrame, keys: list[str], ranks: list[float] | None = None) -> DataFrame:
    """The bin of each rank, with the rank inside it and whether that settles the value."""
    window = Window.partitionBy(*keys)
    running = bins.withColumns(
        {"_upto": F.sum("_n").over(window.orderBy("_bin")), "_all": F.sum("_n").over(window)}
    )
    if ranks is not None:
        running = running.withColumn(
            "_target",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("q"),
                            F.greatest(F.ceil(F.lit(q) * F.col("_all")), F.lit(1)).cast("bigint").alias("rank"),
                        )
                        for i, q in enumerate(ranks)
                    ]
                )
            ),
        ).select("*", F.col("_target.q").alias("_q"), F.col("_target.rank").alias("_rank"))
    inside = F.col("_rank") - (F.col("_upto") - F.col("_n"))
    return running.where((F.col("_rank") <= F.col("_upto")) & (inside >= 1)).select(
        "_key",
        "_q",
        inside.alias("_rank"),
        "_lo",
        "_hi",
        F.when((F.col("_lo") == F.col("_hi")) | (inside == 1), F.col("_lo"))
        .when(inside == F.col("_n"), F.col("_hi"))
        .alias("_value"),
    )


def key_profile(
    df: DataFrame, key: str, value: str, sums: list[str] | None = None, quantiles: tuple[float, ...] = (0.5,)
) -> DataFrame:
    """One row per key: ``rows``, sums and exact quantiles of a whole-number column.

    Columns: ``key``, ``rows`` (all rows of the key), ``all_rows`` (those of the
    whole input), ``n_values`` (rows of the key with a value), ``sum_<c>`` for the value and every column of ``sums``, and
    ``q<percent>`` for each quantile: the least value whose rank is at least
    ``quantile * n_values`` (the discrete percentile).

    Null keys form one key of their own. Null values count in ``rows`` only; a
    key without values has null sums and quantiles. Ties are values like others.
    An empty input gives no rows. Values must lie within 2**62 of zero. Other columns of ``df`` are ignored, whatever
    their names. ``df`` is written once to the shared folder.
    """
    sums = sums or []
    chosen = df.select(
        F.col(key).alias("_key"), F.col(value).cast("bigint").alias("_v"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(sums)]
    )
    base = materialise(chosen, "profile")
    bins = materialise(
        base.groupBy("_key", _first_bin(F.col("_v")).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.sum("_v").alias("_sum"),
            *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))],
        ),
        "bins",
    )
    totals = bins.groupBy("_key").agg(
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_bin").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_values"),
        F.sum("_sum").alias(f"sum_{value}"),
        *[F.sum(f"_s{i}").alias(f"sum_{c}") for i, c in enumerate(sums)],
    )
    all_rows = bins.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    spread = max(8, df.sparkSession.sparkContext.defaultParallelism)
    # Bounded: at most ``spread`` keys have such a share of the rows.
    hot = [r["_key"] for r in totals.where(F.col("rows") * spread >= all_rows).select("_key").collect()]
    settled = _settle(base, hot, spread, bins.where("_bin IS NOT NULL"), list(quantiles))
    names = [f"q{q * 100:g}".replace(".", "_") for q in quantiles]
    wide = settled.groupBy("_key").agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_value"))).alias(n) for i, n in enumerate(names)]
    )
    joined = totals.join(wide.withColumnRenamed("_key", "_k2"), F.col("_key").eqNullSafe(F.col("_k2")), "left")
    return joined.drop("_k2").withColumn("all_rows", F.lit(all_rows).cast("bigint")).withColumnRenamed("_key", key)


def _settle(base: DataFrame, hot: list, spread: int, bins: DataFrame, quantiles: list[float]) -> DataFrame:
    """``_key, _q, _value`` for every key with values and every quantile."""
    found = materialise(_locate(bins, ["_key"], quantiles), "ranks")
    settled = [found.where("_value IS NOT NULL").select("_key", "_q", "_value")]

    while count := (remaining := found.where("_value IS NULL")).count():
        targets = remaining.select(F.col("_key").alias("_k"), "_q", "_rank", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        rows = base.where("_v IS NOT NULL").select("_key", "_v")
        match = F.col("_key").eqNullSafe(F.col("_k")) & F.col("_v").between(F.col("_from"), F.col("_to"))
        if count <= BROADCAST_ROWS:
            open_rows = rows.join(F.broadcast(targets), match)
        else:
            # The rows of a hot key are dealt over ``spread`` salts, and its few ranges go to each of them.
            none = F.lit(0).cast("bigint")
            salts = F.when(_listed("_k", hot), F.sequence(none, F.lit(spread - 1).cast("bigint"))).otherwise(F.array(none))
            salted = targets.withColumn("_salt", F.explode(salts))
            dealt = rows.withColumn("_s", F.when(_listed("_key", hot), F.pmod(F.monotonically_increasing_id(), F.lit(spread))).otherwise(none))
            open_rows = dealt.join(salted, match & (F.col("_s") == F.col("_salt")))
        width = F.col("_to") - F.col("_from") + 1
        cut = F.floor((F.col("_v") - F.col("_from")).cast("double") * BINS / width.cast("double")).cast("int")
        bins = open_rows.groupBy("_key", "_q", "_rank", cut.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        found = materialise(_locate(bins, ["_key", "_q", "_rank"]), "ranks")
        settled.append(found.where("_value IS NOT NULL").select("_key", "_q", "_value"))
    return reduce(DataFrame.unionByName, settled)
