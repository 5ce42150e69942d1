"""Timing sweeps. Each prints one JSON object: setting -> seconds (median of three).

python sweeps.py block      build statistics for blocks of 512 to 10,240 documents
python sweeps.py corpus     a nested count over the first 1 to 10 sources
python sweeps.py threads    the same over all sources on 1 to 8 threads
python sweeps.py memory     bytes of the written postings, containers and bitmaps of the first 1 to 10 sources
"""

from __future__ import annotations

import json
import os
import statistics
import subprocess
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SHARED = os.environ.get("SWEEP_DIR") or tempfile.mkdtemp(prefix="sweeps-")
QUERY = "the AND (und OR nicht OR of)"


def session(threads: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{threads}]")
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", SHARED)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(call) -> float:
    call()
    took = []
    for _ in range(3):
        began = time.perf_counter()
        call()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took), 3)


def indexed(spark: SparkSession, where: str = "true"):
    from termloom.session import materialise
    from termloom.operators.postings import build_postings

    return materialise(build_postings(spark.read.parquet(f"{FOLDER}/documents.parquet").where(where)), "sweep")


def count(postings) -> None:
    from termloom.operators.boolean import by_pivot
    from termloom.plans.parser import parse_query

    by_pivot(postings, parse_query(QUERY)).agg(F.count(F.lit(1))).collect()


def sizes(postings) -> dict[str, int]:
    from termloom.operators.containers import build_containers
    from termloom.operators.postings import build_bitmaps
    from termloom.session import materialise

    made = {"postings": postings, "containers": materialise(build_containers(postings), "sweep"), "bitmaps": materialise(build_bitmaps(postings), "sweep")}
    size = lambda path: os.path.getsize(path.removeprefix("file:").replace("///", "/"))
    return {name: sum(map(size, df.inputFiles())) for name, df in made.items()}


def main(kind: str, threads: int = 8) -> dict[str, float]:
    if kind == "threads":
        runs = {str(n): subprocess.run([sys.executable, __file__, "one", str(n)], capture_output=True, text=True, check=True) for n in range(1, 9)}
        return {n: json.loads(run.stdout.strip().splitlines()[-1])["all"] for n, run in runs.items()}
    spark = session(threads)
    if kind == "one":
        postings = indexed(spark)
        return {"all": seconds(lambda: count(postings))}
    if kind == "block":
        from termloom.operators.postings import dictionary

        postings = indexed(spark)
        return {str(n): seconds(lambda n=n: dictionary(postings, n).agg(F.sum("n_blocks")).collect()) for n in range(512, 10_241, 512)}
    sources = [r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("source").distinct().orderBy("source").limit(10).collect()]
    found = {}
    for n in range(1, len(sources) + 1):
        names = ", ".join(f"'{s}'" for s in sources[:n])
        postings = indexed(spark, f"source IN ({names})")
        if kind == "memory":
            found[str(n)] = sizes(postings)
            continue
        found[str(n)] = seconds(lambda postings=postings: count(postings))
    return found


if __name__ == "__main__":
    if sys.argv[1:2] not in (["block"], ["corpus"], ["threads"], ["memory"], ["one"]):
        sys.exit(__doc__)
    print(json.dumps(main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 8)))
