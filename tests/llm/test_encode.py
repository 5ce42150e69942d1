import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import encode as e

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return e.Vocabulary.load(e.DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    path = e.DEFAULT_VOCABULARY.replace(".json", ".tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=e.SPLIT, mergeable_ranks=ranks, special_tokens={})
    other = tokenizers.Tokenizer.from_file(e.DEFAULT_VOCABULARY)
    other.encode_special_tokens = True
    return own, other


TEXTS = [
    "", None, " ", "\n\n  \t x", "Hello world, it's 1234's", "aaaaaaaaaaaaaaaaaaaa" * 40, "<|endoftext|> and <|endoftext|>", "naïve café 🙂🙂👩‍👩‍👧 字字字 Жиловец",
    "a b　c​ ́", "x" * 5000, " " * 3000 + "end", "=-=-=-=-=-=-" * 300, "\x00\x01\x7f\x80", "don't DON'T we'LL we'll", "a b" * 1000,
]


def test_texts(vocabulary, reference):
    encoder = e.TextEncoder(vocabulary)
    for batch in (TEXTS, TEXTS[::-1], [t for t in TEXTS for _ in range(2)]):
        ids, offsets = encoder.encode(batch)
        assert list(encoder.lengths(batch)) == list(offsets[1:] - offsets[:-1])
        for i, text in enumerate(batch):
            mine = list(ids[offsets[i] : offsets[i + 1]])
            assert mine == reference[0].encode_ordinary(text or "")
            assert mine == reference[1].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aabe tho'sin.\n 0"), st.characters(codec="utf-8")), max_size=60), max_size=6))
def test_any_text(vocabulary, reference, texts):
    ids, offsets = e.TextEncoder(vocabulary).encode(texts)
    for i, text in enumerate(texts):
        assert list(ids[offsets[i] : offsets[i + 1]]) == reference[0].encode_ordinary(text)


def test_words_are_forgotten(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(e, "HELD_WORDS", 3)
    encoder = e.TextEncoder(vocabulary)
    for text in ("one two three four five", "six seven one", "two eight"):
        ids, _ = encoder.encode([text])
        assert list(ids) == reference[0].encode_ordinary(text)


def test_table(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null key", "y"), (0, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = [(r.doc_id, r.ids) for r in e.token_ids(df, "doc_id", "text").collect()]
    wanted = [(i, reference[0].encode_ordinary(t or "")) for i, t, _ in rows]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    counts = [(r.doc_id, r.n_tokens) for r in e.token_counts(df, "doc_id", "text").collect()]
    assert sorted(counts, key=repr) == sorted(((i, len(x)) for i, x in wanted), key=repr)
    assert e.token_ids(df.limit(0), "doc_id", "text").count() == 0
