import io
import json

import pytest

from termloom.__main__ import main
from termloom.handlers import HANDLERS
from termloom.sources.corpus import number_documents, read_directory, read_file, read_paths
from termloom.sources.index_store import load_index
from termloom.sources.query_log import logged_queries, read_lines
from termloom.sources.tables import items, metas
from termloom.streaming.incremental import index_stream, read_streamed, running_counts


def write(path, objects):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(o) + "\n" for o in objects))


def test_corpus(spark, tmp_path):
    write(tmp_path / "AA" / "wiki_00", [{"id": "12", "text": "red", "url": "x"}, {"id": "7", "text": "blue"}])
    write(tmp_path / "AB" / "deep" / "wiki_01", [{"id": "9", "text": None}])
    (tmp_path / "AB" / "bad").write_text("not json\n")
    assert read_file(spark, str(tmp_path / "AA" / "wiki_00")).count() == 2
    assert {r.id for r in read_directory(spark, str(tmp_path)).collect()} == {"12", "7", "9", None}
    assert read_paths(spark, str(tmp_path), ["AA", "AB/deep"]).count() == 3
    numbered = number_documents(read_directory(spark, str(tmp_path / "AA"))).collect()
    assert sorted((r.doc_id, r.id) for r in numbered) == [(0, "12"), (1, "7")]


def test_query_log(spark, tmp_path):
    (tmp_path / "log").write_text("COUNT\ta\nb\n")
    assert [r.line for r in read_lines(spark, str(tmp_path / "log")).collect()] == ["COUNT\ta", "b"]
    rows = [(1, "COUNT\ta b", "2020-01-01"), (1, "COUNT\ta b", None), (2, None, "2020-01-01"), (3, "plain", None), (None, "COUNT\tz", None)]
    log = spark.createDataFrame(rows, "query_id bigint, line string, asked_at string")
    assert sorted(map(tuple, logged_queries(log).collect())) == [(1, "a b"), (2, None), (3, None)]


def test_items(spark):
    rows = [("x", "t", 1, "2020-01-01"), ("x", "t", 1, None), ("y", None, 2, None), ("z", "u", None, None)]
    df = spark.createDataFrame(rows, "id string, text string, seq bigint, read_at string")
    assert sorted(map(tuple, items(df).collect())) == [(1, "x", "t"), (2, "y", None)]


def test_metas(spark):
    nan = float("nan")
    rows = [
        (1, " The\t", [[3], [-1]], [10, None], 0.5, "b"),
        (1, "the", [[3], [-1]], [10, 5], 0.5, "a"),
        (2, None, [[1], None], None, 0.25, None),
        (3, "x", None, None, nan, None),
        (4, "y", [[]], [], None, None),
        (5, "z", [[1]], None, -1.0, None),
        (None, "w", [[1]], [1], 0.5, None),
    ]
    df = spark.createDataFrame(rows, "meta_id bigint, term string, distribution array<array<bigint>>, nums array<bigint>, selectivity double, built_at string")
    found = {r.meta_id: tuple(r)[1:] for r in metas(df).collect()}
    assert found == {1: ("the", 10, 10, 66), 2: (None, None, 128, 1), 3: ("x", None, None, 0), 4: ("y", 0, 0, 0), 5: ("z", None, None, 1)}


def test_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    schema = "doc_id bigint, text string, at timestamp"
    write(source / "1.json", [{"doc_id": 1, "text": "red fox", "at": "2020-01-01T00:10:00Z"}, {"doc_id": 1, "text": "red fox", "at": None}])
    write(source / "2.json", [{"doc_id": 2, "text": "red red", "at": "2020-01-01T01:10:00Z"}])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = index_stream(stream, str(target), str(tmp_path / "check"), availableNow=True)
    query.awaitTermination(120)
    postings, terms = read_streamed(spark, str(target))
    assert sorted(map(tuple, postings.collect())) == [("fox", 1, 1), ("red", 1, 1), ("red", 2, 2)]
    assert {r.term: (r.df, r.ctf) for r in terms.collect()} == {"fox": (1, 1), "red": (2, 3)}
    write(source / "3.json", [{"doc_id": 1, "text": "blue fox", "at": "2020-01-01T00:20:00Z"}, {"doc_id": 2, "text": None, "at": None}, {"doc_id": None, "text": "x"}])
    index_stream(stream, str(target), str(tmp_path / "check"), availableNow=True).awaitTermination(120)
    postings, terms = read_streamed(spark, str(target))
    assert sorted(map(tuple, postings.collect())) == [("blue", 1, 1), ("fox", 1, 1)]
    assert sorted(r.term for r in terms.collect()) == ["blue", "fox"]
    counted = running_counts(stream, "at").writeStream.outputMode("complete").format("memory").queryName("arrivals")
    running = counted.option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert sorted(r.n_docs for r in spark.table("arrivals").collect() if r.start is not None) == [1, 2]


@pytest.mark.parametrize("handler", sorted(HANDLERS))
def test_command_line(spark, tmp_path, monkeypatch, capsys, handler):
    write(tmp_path / "AA" / "wiki_00", [{"id": str(i), "text": f"castle river word{i % 7} museum, {'bridge' if i % 2 else 'tower'}"} for i in range(40)])
    monkeypatch.setattr("sys.stdin", io.StringIO("COUNT\tcastle AND bridge\nnothing\nCOUNT\ttower OR word3"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert main(["run", "AA", "--base", str(tmp_path), "--handler", handler, "-p", "3", "-b", "8", "-d", str(tmp_path / "index")]) == 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    lines = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
    if handler == "load-data":
        assert lines == [["40", "40"]]
    elif handler == "boolean-query":
        assert sorted(lines) == [["0", "20"], ["1", "23"]]
        assert load_index(spark, str(tmp_path / "index")).terms.where("term = 'castle'").first()["n_blocks"] == 5
    else:
        texts = [r["text"] for r in read_directory(spark, str(tmp_path / "AA")).collect()]
        assert len(texts) == 40 and len(lines) == 6  # 12 words of three bytes or more, in pairs
        assert all(0 <= int(n) <= 40 for *_, n in lines)
