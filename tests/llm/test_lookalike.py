import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import lookalike as lk


@pytest.mark.parametrize(
    ("shown", "other"),
    [
        ("café", "café"),
        ("Ｑｕａ　１２", "Qua 12"),
        ("a b c d", "a b c d"),
        ("zero​width⁠﻿­", "zerowidth"),
        ("ﬁne ﬂow ﬆone", "fine flow stone"),
        ("Сосо рауѕ", "Coco pays"),
        ("е́té", "été"),
        ("ѐ ї", "è ï"),
        ("e‍́", "é"),
        ("́a", "́a"),
        ("ﾊﾟ", "パ"),
        ("Å K", "Å K"),
        ("q̣̇", "q̣̇"),
    ],
)
def test_same(shown, other):
    assert lk.compared(shown) == lk.compared(other)


@pytest.mark.parametrize(("one", "other"), [("a", "b"), ("é", "e"), ("A", "a"), ("km²", "km2"), ("a  b", "a b"), ("ß", "ss"), ("1", "l"), ("½", "1/2"), ("…", "...")])
def test_visibly_different(one, other):
    assert lk.compared(one) != lk.compared(other)


@pytest.mark.parametrize(
    ("text", "form"),
    [("Москва и оре", "Москва и оре"), ("Mосква", "Mocквa"), ("café\u200b Ｔоwn ﬁ", "café Town fi"), ("Ὀ Ὁδός", "Ὀ Ὁδός"), ("", ""), ("рау рal", "рау pal")],
)
def test_printed(text, form):
    assert lk.printed(text) == form == lk.printed(form)


def test_stable_letters_of_other_scripts_pass_the_quick_check(spark):
    texts = [("שלום עולם",), ("कमल जल",), ("жизнь ждиж",)]
    df = spark.createDataFrame(texts, "text string")
    assert [r.text for r in df.where(df.text.rlike(lk.quick_check())).collect()] == []


def plain_form(text):
    """The same form, by normalising the whole text."""
    replace = lk._tables()[0]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(replace)).translate(replace))


def _settled(text):
    # Characters outside the quick-check class are left as they are, private use and the like included.
    return re.sub("[\ud800-\udfff]", "", text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ae o1.éñ²–ßａＡ　 ​ְ̧̣́̈ᅡᆨ가ﬁаеоСѐοΟো🙂字µ")), max_size=30))
def test_segments_equal_the_whole(text):
    assert lk.compared(text) == plain_form(text)
    assert lk.compared(lk.compared(text)) == lk.compared(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=20).map(_settled))
def test_any_text(text):
    assert lk.compared(text) == plain_form(text)


def test_quick_check_misses_nothing(spark):
    chars = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    changed = [c for c in chars if lk.compared("a" + c + "b") != "a" + c + "b"]
    rows = spark.createDataFrame([(c,) for c in changed], "c string")
    assert rows.where(~rows.c.rlike(lk.quick_check())).count() == 0
    assert len(changed) > 1000


def test_pairs(spark):
    rows = [
        ("b", "café x"), ("a", "café x"), ("c", "café x"), ("c", "café x"), ("d", "cafe x"), ("e", "café x"),
        ("n", None), ("m", None), ("s", "  "), ("t", " ​"), (None, "café x"), ("u", ""), ("v", "Zed"), ("w", "Ｚed"),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "id string, text string, _look string, _same string")
    found = sorted(map(tuple, lk.same_looking_pairs(df, "id", "text").collect()))
    assert found == [("a", "b"), ("a", "c"), ("a", "e"), ("b", "e"), ("c", "e"), ("v", "w")]
    assert lk.same_looking_pairs(df.limit(0), "id", "text").count() == 0
    forms = {r[0]: r[1] for r in df.select("id", lk.compared_text("text")).where("id IN ('e', 'n')").collect()}
    assert forms == {"e": "café x", "n": None}


@pytest.mark.parametrize("lot", [10_000, 2])
def test_classes_and_lots(spark, monkeypatch, lot):
    monkeypatch.setattr(lk, "LOT_SPELLINGS", lot)
    monkeypatch.setattr(lk, "LOT_RECORDS", lot)
    spelling = ["cafe one", "cаfe one", "сafe one", "саfe one", "саfе one"]
    rows = [(f"i{i}", spelling[i % 5]) for i in range(40)] + [(f"x{i}", "other") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, text string")
    pairs = {tuple(r) for r in lk.same_looking_pairs(df, "id", "text").collect()}
    assert pairs == {(a, b) for a, x in rows for b, y in rows if a < b and x != y and x != "other" != y}
    classes = lk.same_looking_classes(df, "id", "text").collect()
    assert len(classes) == 40 and {(r.spellings, r.links) for r in classes} == {(5, 32)}
    assert len({r.look for r in classes}) == 1 and len({r.spelling for r in classes}) == 5


def test_very_long_text():
    assert lk.compared("é" * 200_000) == "é" * 200_000
    assert lk.compared("a" * 10 + "́" * 50_000).startswith("aaaaaaaaaá́")
