"""Token ids of whole texts by a public byte-level BPE vocabulary, in numpy.

The words of a batch of texts are encoded together. Their symbols lie in one flat
array; a round looks up every adjacent pair by binary search over the sorted pair
keys, takes each word's lowest-rank pair, and merges all its places in the word
at once. That equals one merge at a time from the left: a merge's own result only
takes part in merges of higher rank. Words no pair of which can merge leave the
array. Each different word is encoded once and kept for later batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import spread

#: How byte-level BPE splits text before the merges (fixed value of the public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a task keeps the ids of before it starts afresh.
HELD_WORDS = 400_000
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_NONE = np.iinfo(np.int64).max


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself, or the next one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Merge table: sorted pair keys ``left * size + right`` with rank and resulting id of each."""

    size: int
    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, size = model["vocab"], max(model["vocab"].values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        return Vocabulary(
            size,
            np.array([ids[c] for c in _byte_alphabet()], np.int64),
            keys[order],
            np.arange(len(pairs), dtype=np.int64)[order],
            np.array([ids[a + b] for a, b in pairs], np.int64)[order],
        )

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank = np.full(len(symbol), _NONE)
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(symbol))))
            over = best == _NONE
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
                if over.all():
                    break
            chosen = np.flatnonzero((rank == best) & ~over)
            # Of overlapping places, as in a run of one letter, every second one from the left is taken.
            run = np.concatenate([[True], (chosen[1:] != chosen[:-1] + 1) | (word[chosen[1:]] != word[chosen[:-1]])])
            first = np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(chosen))))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            symbol[chosen] = self.merged[at[chosen]]
            keep = ~over
            keep[chosen + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), lengths
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(words))


class TextEncoder:
    """Encodes batches of texts and remembers words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(SPLIT).findall
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        known, need = len(self.place), len(self.place) + len(words)
        while need > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[known:need] = self.used + np.cumsum(counts) - counts
        self.count[known:need] = counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(words, range(known, need)))

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place of every word, and the number of words of each text."""
        if len(self.place) > HELD_WORDS:
            self._forget()
        words = [self.split(t) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        fresh = [w for w in dict.fromkeys(flat) if w not in self.place]
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, words), np.int64, len(words))

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        place, per_text = self._places(texts)
        upto = np.concatenate([[0], np.cumsum(self.count[place])])
        ends = np.cumsum(per_text)
        return upto[ends] - upto[ends - per_text]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text's part."""
        place, per_text = self._places(texts)
        counts = self.count[place]
        upto = np.concatenate([[0], np.cumsum(counts)])
        within = np.arange(upto[-1]) - np.repeat(upto[:-1], counts)
        ids = self.ids[np.repeat(self.start[place], counts) + within]
        return ids, upto[np.concatenate([[0], np.cumsum(per_text)])]


#: Texts handled together; memory follows the texts of so many rows.
BATCH_TEXTS = 512


def _encoding(shared, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                texts = batch.column("text").to_pylist()
                if lengths_only:
                    result = pa.array(encoder.lengths(texts))
                else:
                    ids, offsets = encoder.encode(texts)
                    result = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), result], ["key", "out"])

    return run


def _run(df: DataFrame, key: str, text: str, vocabulary: str, lengths_only: bool) -> DataFrame:
    # Bounded: a vocabulary's merges, whatever the texts.
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_encoding(shared, lengths_only), f"key {kind}, out {'bigint' if lengths_only else 'array<int>'}")


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, ids``: the token ids of every text, one row per row of ``df``.

    No special tokens are added, and their strings in a text are ordinary text.
    Empty and null texts give an empty list. Repeated rows stay repeated, null
    keys stay null, other columns are left out. No shuffle. ``vocabulary`` is a
    file of a byte-level BPE in the ``tokenizers`` format on the driver.
    """
    return _run(df, key, text, vocabulary, False).select(F.col("key").alias(key), F.col("out").alias("ids"))


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, n_tokens``: as ``token_ids``, but only how many they are."""
    return _run(df, key, text, vocabulary, True).select(F.col("key").alias(key), F.col("out").alias("n_tokens"))
