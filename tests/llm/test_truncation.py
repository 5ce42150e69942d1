import html
import json
import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import truncation as t

SHAPES = ["* Cache ~ cleared twice", "* Merged ~ 0 ms", "20 ~ hits=0 took=0ms", "- Batch ~ of W", "0- ~ hits=0 took=0ms"]
OUTLINES = ["* W", "-- W", "W: W", "[0] W, 0", "{{w}}", "| 0 | 0 |", "~~~~", "w://w.w/w", "w://w.w/0"]
CUT = [
    "The castle was bui", "The castle. It was the", "The castle. It was the ", "The castle stands…", "The castle stands...", "The cast [more]",
    "One. Two (19", "One.\n\n== Hist", "Done.\nhttps://exa", "COUNT\ta AND", "COUNT\ta\nCOU", "* Cache for A cleared twice\n* Merged segment 2 of sh",
    "2020-01-01T00:00:00Z s-1 INFO query=\"a\" hits=1 took=2ms\n2020-01-0", "Title:\n* Cache for Abc clea", "One.\n\nCategory: ", "Two.\n| 3 | 4",
]
WHOLE = [
    "The castle was built.", "Was it?", "“It was.”", "It was. [4]", "It was! 🙂", "It was. (edited)", "It was. :-)", "(It was.)", "It was.\n~~~~",
    "It was.\n{{x-stub}}", "It was.\n| 3 | 4 |", "Dekraith (station)", "no mark here\nnor here (3 km²)", "Was.  \n",
]
OPEN = [
    "* Cache for A cleared twice",     "It was.\n\n-- Nelvoron", "It was.\n\nCategory: Turpael", "It was.\n\n[1] Vellina, 2020", "It was.\nhttps://a.example/b", "It was.\n\n* Taulia",
    "no mark here\nnor here either", "COUNT\ta AND b", "COUNT\ta AND b\nCOUNT\tc", "* Merged segment 2 of shard 3 after 4 ms", "It was. -- Takorith",
    "x\n* Cache for A cleared twice\n- Batch 3 reloaded from the dump of Abc",
]


def test_endings(spark):
    rows = [(x, "cut") for x in CUT] + [(x, "whole") for x in WHOLE] + [(x, "open") for x in OPEN] + [("", None), (None, None), (" \n ", None)]
    rows += [("It was! " + "🙂" * 50_000, "whole"), ("It was. " + "[1] " * 50_000, "whole"), ("It was. The " + "1," * 50_000 + "1 of the", "cut"), ("a. " * 50_000 + "It", "cut")]
    rows += [("* Cache of " + "1." * 50_000, "cut")]
    df = spark.createDataFrame(rows, "text string, wanted string")
    assert t.line_shapes(df, "text")
    found = t.with_endings(df, "text", SHAPES, OUTLINES).where("NOT (wanted <=> ending)")
    assert [tuple(r) for r in found.collect()] == []


def test_lengths(spark):
    texts = ["", 'a"b\\c\n\t\r', "<é&'🙂字>\n", "x" * 5000]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for (text,), found in zip([(x,) for x in texts], [r[0] for r in df.select(t.stored_lengths(F.col("text"))).collect()]):
        quoted = json.dumps(text, ensure_ascii=False)[1:-1]
        wanted = {
            "chars": len(text), "utf8": len(text.encode()), "utf16": len(text.encode("utf-16-le")) // 2, "html": len(html.escape(text, False)),
            "html_quotes": len(html.escape(text)), "json": len(quoted), "json_utf8": len(quoted.encode()), "json_ascii": len(json.dumps(text)) - 2,
            "crlf": len(text.replace("\n", "\r\n")), "crlf_utf8": len(text.replace("\n", "\r\n").encode()),
        }
        assert dict(zip(t.UNITS, found)) == wanted


STORES = {
    "chars": len, "utf8": lambda x: len(x.encode()), "html_quotes": lambda x: len(html.escape(x)),
    "json_ascii": lambda x: len(json.dumps(x)) - 2, "crlf": lambda x: len(x) + x.count("\n"),
}


@pytest.fixture(scope="module")
def stored(spark):
    """Sources that cut at 150 in a unit of their own, and one that does not cut."""
    rng, rows, number = random.Random(11), [], 0
    words = ["war", "le", "château", "Été", "1850", "<b>", "&", '"so"', "字🙂", "Brücke", "river", "l'île"]
    for source, size in [*STORES.items(), ("none", None)]:
        for i in range(80):
            sentences = (" ".join(["The", *rng.choices(words, k=rng.randint(3, 9)), "end."]) for _ in range(rng.randint(1, 9)))
            text = "".join(x + rng.choice([" ", "\n"]) for x in sentences).strip()
            if size is not None and size(text) > 150:
                text = next(text[:n] for n in range(len(text), 0, -1) if size(text[:n]) <= 150)
            rows.append((number, source, text, "whole" if text.rstrip().endswith("end.") else "cut", 1))
            number += 1
    rows += [(number, None, None, None, 1), (number + 1, "none", "", None, 1), (number + 2, None, "It was the", "cut", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, ending string, limit bigint")


def test_limits(stored):
    judged = t.judge(stored, "doc_id", "source", "text")
    found = {r.source: (t.UNITS[r.i], r.lo, r.hi) for r in t.source_limits(judged).collect()}
    assert found == {source: (source, 150, 150) for source in STORES}


def test_truncated(stored):
    wanted = {r.doc_id for r in stored.where("ending = 'cut'").collect()}
    found = t.truncated_texts(stored, "doc_id", "source", "text")
    assert {r.doc_id for r in found.where("truncated").collect()} == wanted
    rates = {r.source: r for r in t.truncation_rates(stored, "doc_id", "source", "text").collect()}
    assert [rates[s][1:3] for s in ("none", None)] == [(80, 0), (1, 1)]
    assert [tuple(x)[:3] for x in rates["utf8"].limits] == [("utf8", 150, 0)] and rates["none"].limits == []
    assert rates["chars"].by_length == rates["chars"].by_ending == rates["chars"].truncated > 10
    assert t.truncated_texts(stored.limit(0), "doc_id", "source", "text").count() == 0


def test_open_endings_count_at_the_limit_only(spark):
    cut = [(10 + i, "s", f"Well. {'ab' * i} the end was no"[:22]) for i in range(8)]
    names = [(20, "s", "It was all.\n* Abcdefgh"), (21, "s", "It was.\n* Abcdefgh")]
    names += [(30 + i, "other", "It was so.\n* Abc" + "d" * i) for i in range(8)]  # so that such lines are known
    df = spark.createDataFrame([*cut, *names], "doc_id bigint, source string, text string")
    found = {r.doc_id: (r.at_limit, r.truncated) for r in t.truncated_texts(df, "doc_id", "source", "text").collect()}
    assert found[20] == (True, True) and found[21] == (False, False)


def _sentences(rng, n):
    words = ["war", "le", "church", "built", "1850", "river", "bridge", "village", "of"]
    return " ".join(" ".join(["The", *rng.choices(words, k=rng.randint(3, 9)), "end."]) for _ in range(n))


def test_bands_and_several_limits(spark):
    """A store that goes back to the end of a word, one with two limits, and one that adds a mark."""
    rng, rows = random.Random(5), []
    for i in range(300):
        long = _sentences(rng, 60)
        rows.append(("band", long[:400].rsplit(" ", 1)[0] if i % 2 else _sentences(rng, 1 + i % 20)))
        rows.append(("two", long[:300] if i % 4 == 0 else long[:500] if i % 4 == 1 else _sentences(rng, 1 + i % 20)))
        rows.append(("mark", long[:350] + "..." if i % 2 else _sentences(rng, 1 + i % 20)))
        rows.append(("none", _sentences(rng, 1 + i % 20)))
    df = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(rows)], "doc_id bigint, source string, text string")
    limits = {r.source: [tuple(x)[:3] for x in r.limits] for r in t.truncation_rates(df, "doc_id", "source", "text").collect()}
    assert limits["two"] == [("chars", 300, 0), ("chars", 500, 0)] and limits["mark"] == [("chars", 353, 0)] and limits["none"] == []
    (unit, limit, within), = limits["band"]
    assert unit == "chars" and 396 <= limit <= 400 and within == t.BAND - 1
    found = {r.doc_id for r in t.truncated_texts(df, "doc_id", "source", "text").where("truncated").collect()}
    assert found == {i for i, (_, x) in enumerate(rows) if not x.rstrip().endswith("end.")}


def test_shapes_are_learnt(spark):
    rows = [("It was.\n-- Nelvoron",), ("It is. -- Tak",), ("Category: Turpael",), ("It is.\nhttps://a.example/b",), ("The castle of the",), ("It was.",)] * 4
    rows += [("It was.\n-- Nelvoron",)] * 20 + [("It was.\n--",)] * 4 + [("a\nhttps://a",)] * 2 + [(None,), ("",)]
    records, outlines = t.line_shapes(spark.createDataFrame(rows, "text string"), "text")
    assert records == [] and sorted(outlines) == ["-- W", "W: W", "w://w.w/w"]
    rows = [("* Cache for A cleared twice\n* Cache for B cleared twice",)] * 4 + [(None,), ("",)]
    assert t.line_shapes(spark.createDataFrame(rows, "text string"), "text") == (["* Cache ~ cleared twice"], [])
