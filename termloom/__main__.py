"""Command line: build an index from JSON-lines folders, and answer queries on it.

python -m termloom build INDEX PATH... [--base DIR]
python -m termloom query INDEX [QUERY...]        queries from lines COMMAND<TAB>QUERY on stdin if none is given
python -m termloom stats INDEX
python -m termloom run PATH... --handler NAME    one way of answering queries over a corpus, timed; see ``termloom.handlers``
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from termloom.context import BooleanContext
from termloom.handlers import HANDLERS
from termloom.operators.postings import chunk_report
from termloom.plans.parser import query_of_line
from termloom.plans.planner import BLOCK
from termloom.session import ship
from termloom.sources.corpus import number_documents, read_paths
from termloom.sources.index_store import build_index, save_index


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("index")
    build.add_argument("paths", nargs="+")
    build.add_argument("--base", default="")
    query = commands.add_parser("query")
    query.add_argument("index")
    query.add_argument("queries", nargs="*")
    stats = commands.add_parser("stats")
    stats.add_argument("index")
    run = commands.add_parser("run")
    run.add_argument("paths", nargs="+")
    run.add_argument("--base", default="")
    run.add_argument("--handler", choices=sorted(HANDLERS), required=True)
    run.add_argument("-p", "--partition-num", type=int, help="partitions of a shuffle")
    run.add_argument("-b", "--batch-size", type=int, default=BLOCK, help="documents in a block of the statistics")
    run.add_argument("-d", "--dump-path", help="where the index is kept")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("termloom").getOrCreate()
    began = time.time()
    if options.command == "run":
        if options.partition_num:
            spark.conf.set("spark.sql.shuffle.partitions", options.partition_num)
        documents = number_documents(read_paths(spark, options.base, options.paths).drop("path"))
        asked = [q for q in map(query_of_line, sys.stdin.read().splitlines()) if q] if options.handler == "boolean-query" else []
        found = HANDLERS[options.handler](ship(spark), documents, dump=options.dump_path, size=options.batch_size, queries=asked)
        for row in found.toLocalIterator():
            print(*row, sep="\t", flush=True)
    elif options.command == "build":
        documents = number_documents(read_paths(spark, options.base, options.paths).drop("path"))
        save_index(build_index(documents), options.index, mode="overwrite")
    else:
        context = BooleanContext(spark)
        index = context.register_index("index", options.index)
        if options.command == "stats":
            chunk_report(index.postings).show()
        else:
            asked = options.queries or [q for q in map(query_of_line, sys.stdin.read().splitlines()) if q]
            for text in asked:
                print(context.count("index", text), flush=True)
    print(f"{(time.time() - began) * 1000:.0f} ms", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
