"""Folders with the test tables in edge cases: empty, and with nulls in every column."""

TABLES = "wiki_item posting_batch term_meta_temp query_log watch_term documents".split()


def write_empty(spark, data, folder):
    for name in TABLES:
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def write_with_nulls(spark, data, folder, rows=40):
    """Some rows whole, and for each column some rows without it; a row of nulls; and columns with names used inside."""
    from pyspark.sql import functions as F

    for name in TABLES:
        table = spark.read.parquet(f"{data}/{name}.parquet").limit(rows)
        names = table.columns
        parts = [table, table.select(*[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in names]).limit(1)]
        parts += [table.limit(5).withColumn(c, F.lit(None).cast(table.schema[c].dataType)) for c in names]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        clash = {c: F.lit("x") for c in ("n", "_key", "_v", "_text", "terms", "record", "space", "tf", "_row", "key", "piece", "source2")}
        whole.withColumns(clash).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
