"""One consistent form for texts that look the same but differ in their characters.

Most text is already in that form. A quick-check class holds every character
that normalisation could change or move: marks that combine with what precedes
them, characters that are not their own NFC form, other widths, other blanks,
characters that do not show, ligatures and look-alike letters. A text without
any of them is passed through unread. In others the class delimits unstable
segments; a segment takes the character before it along as context, since a mark
may compose with it, and only the segments are normalised and spliced into the
unchanged rest.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termloom.operators.skew import join_unique
from termloom.session import materialise

#: Letters of other scripts, each followed by the Latin letter of the same shape, and other characters of one shape (fixed values).
CYRILLIC = "аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs ԝw хx уy үy АA ВB СC ЕE ԌG НH ІI ЈJ КK МM ОO РP ЅS ТT УY ҮY ԜW ХX ӀI"
GREEK = "οo νv ρp ϲc ϳj ΑA ΒB ϹC ΕE ϜF ΗH ΙI ͿJ ΚK ΜM ϺM ΝN ΟO ΡP ΤT ΧX ΥY ΖZ"
ARMENIAN = "ցg հh ոn օo զq սu ՕO ՏS ՍU"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᎩY ᏃZ ꮯc ꮩv ꮃw ꮓz ꮪs"
LISU = "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
COPTIC = "ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc"
DESERET = "𐐄O 𐐕C 𐐛L 𐐠S 𐐬o 𐐽c"
OTHERS = "ɑa ɡg µμ ‐- ‑-"
LOOKALIKES = {pair[0]: pair[1] for script in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, COPTIC, DESERET, OTHERS) for pair in script.split()}
#: Characters that take no room: those Unicode lets a display ignore, and the marks around an annotation.
INVISIBLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


def _plain(char: str) -> str | None:
    """What stands for a character of another width, blank or ligature; None for others."""
    if unicodedata.category(char) == "Zs":
        return None if char in (" ", "\u1680") else " "
    kind = unicodedata.decomposition(char)
    ligature = kind.startswith("<compat>") and 0xFB00 <= ord(char) and "LIGATURE" in unicodedata.name(char, "")
    # A Roman numeral of one letter looks like the letter.
    numeral = kind.startswith("<compat>") and 0x2160 <= ord(char) < 0x2180 and len(kind.split()) == 2
    if ligature or numeral or kind.startswith(("<wide>", "<narrow>", "<noBreak>")):
        return unicodedata.normalize("NFKC", char)
    return None


@lru_cache(2)
def _tables(letters: bool = True) -> tuple[dict[int, str | None], list[int]]:
    """Replacements by code point, and the code points of the quick-check class; with ``letters`` those of look-alike letters too."""
    shapes = {ord(c): latin for c, latin in LOOKALIKES.items()}
    replace: dict[int, str | None] = {c: x for c, x in shapes.items() if letters or not chr(c).isalpha()}
    unstable, second = set(shapes), set()
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xF900:
            continue  # surrogates and private use
        char = chr(code)
        plain, parts = _plain(char), unicodedata.normalize("NFD", char)
        if plain is not None:
            replace[code] = plain
        if len(parts) > 1:
            second.update(map(ord, parts[1:]))
        if plain is not None or unicodedata.combining(char) or unicodedata.normalize("NFC", char) != char or parts[0] in LOOKALIKES:
            unstable.add(code)
    for a, b in INVISIBLE:
        replace.update(dict.fromkeys(range(a, b + 1)))
        unstable.update(range(a, b + 1))
    return replace, sorted(unstable | second)


def _spans(codes: list[int]) -> list[list[int]]:
    spans: list[list[int]] = []
    for code in codes:
        if spans and spans[-1][1] >= code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return spans


@lru_cache(1)
def _segments() -> re.Pattern:
    members = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _spans(_tables()[1]))
    return re.compile(f"(?:^|.)[{members}]+(?:.[{members}]+)*", re.DOTALL)


#: Blocks whose unstable characters the quick check names one by one: Latin, Greek, Cyrillic, Hebrew, Devanagari, punctuation.
EXACT = ((0x0, 0x530), (0x590, 0x600), (0x900, 0x980), (0x2000, 0x2200))


@lru_cache(1)
def quick_check() -> str:
    """Java regular expression that finds every character normalisation could touch.

    Outside ``EXACT`` it takes whole blocks of 64 code points, which keeps it
    short; a stable character of such a block costs a look in Python.
    """
    codes = set()
    for code in _tables()[1]:
        exact = any(a <= code < b for a, b in EXACT)
        codes.update([code] if exact else range(code & ~63, (code | 63) + 1))
    # The look ahead spares the many ASCII characters a walk through all spans.
    return r"(?=[^\x00-\x7F])[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _spans(sorted(codes))) + "]"


def _settled(text: str, letters: bool) -> str:
    replace = _tables(letters)[0]

    def settle(match: re.Match) -> str:
        # Other widths first; then letters without their marks, as a marked letter of another script looks alike too.
        wide = match[0].translate(replace)
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", wide).translate(replace))

    return _segments().sub(settle, text)


def compared(text: str) -> str:
    """The form of a text in which texts that look the same are equal. Not for reading: whole words of another script come out as Latin."""
    return _settled(text, True)


_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")


def printed(text: str) -> str:
    """The consistent form for reading: as ``compared``, but look-alike letters stay unless their word has Latin letters too."""
    whole = _settled(text, False)
    if not any(c in LOOKALIKES for c in whole):
        return whole
    return _WORD.sub(lambda m: compared(m[0]) if _LATIN.search(m[0]) else m[0], whole)


@F.pandas_udf(StringType())
def _compared(texts: pd.Series) -> pd.Series:
    return texts.map(compared, na_action="ignore")


@F.pandas_udf(StringType())
def _printed(texts: pd.Series) -> pd.Series:
    return texts.map(printed, na_action="ignore")


def _by_quick_check(form, text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(form(F.when(column.rlike(quick_check()), column)), column)


def compared_text(text: Column | str) -> Column:
    """The form for comparing, of a text column; only texts that fail the quick check go to Python. Null stays null."""
    return _by_quick_check(_compared, text)


def printed_text(text: Column | str) -> Column:
    """The form for reading, of a text column; only texts that fail the quick check go to Python. Null stays null."""
    return _by_quick_check(_printed, text)


def _looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``_id, _look, _same`` of records with a text that is not blank: hashes of the form for comparing and of the text as stored."""
    # The test is on the stored text: on the other form, it would have that made a second time.
    unseen = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in INVISIBLE)
    rows = df.where(F.col(key).isNotNull() & F.col(text).rlike(rf"[^\s\p{{Z}}{unseen}]")).select(
        F.col(key).cast("string").alias("_id"), F.col(text).alias("_text"), compared_text(text).alias("_form")
    )
    return materialise(rows.select("_id", F.sha2("_form", 256).alias("_look"), F.sha2("_text", 256).alias("_same")).distinct(), "looks")


def _spellings(members: DataFrame) -> DataFrame:
    """``_same, _look, _n, _of, _spellings``: the records of each spelling, and the records and spellings of its look."""
    classes = members.groupBy("_look", "_same").agg(F.count(F.lit(1)).alias("_n"))
    looks = classes.groupBy("_look").agg(F.sum("_n").alias("_of"), F.count(F.lit(1)).alias("_spellings"))
    return classes.join(looks.where("_spellings > 1"), "_look")


def same_looking_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, look, spelling, spellings, links``: one row per record whose text has other spellings.

    ``look`` names the class of texts that look the same, ``spelling`` that of equal
    texts; ``links`` counts the records of the look with another spelling, those
    ``same_looking_pairs`` pairs it with. Rules for nulls and repeats are as there.
    """
    members = _looks(df, key, text)
    spelled = materialise(_spellings(members), "spellings")
    found = join_unique(members.select("_id", "_same"), spelled, "_same", "inner")
    return found.select(
        F.col("_id").alias(key), F.col("_look").alias("look"), F.col("_same").alias("spelling"), F.col("_spellings").alias("spellings"),
        (F.col("_of") - F.col("_n")).alias("links"),
    )


#: Spellings of one look, and records of one spelling, that are joined in one task; more are dealt into lots.
LOT_SPELLINGS, LOT_RECORDS = 1_000, 10_000


def _lot(column: str, lots: Column) -> Column:
    return F.pmod(F.xxhash64(column), lots)


def _each_lot(lots: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), lots - 1))


def same_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id_a, id_b``: records whose texts look the same but are not equal, ``id_a < id_b``.

    ``key`` names a record and is compared as a string; repeated rows of a record
    count once. Null and blank texts (nothing but blanks in the consistent form)
    are in no pair, null keys neither. Equal texts form one class, and pairs are
    made of classes first: a group of copies costs no comparison unless another
    spelling of it exists, and then only the rows that come out. An empty table
    gives an empty result; other columns are ignored.
    """
    members = _looks(df, key, text)
    lots = lambda n, size: F.ceil(F.col(n) / size).cast("bigint")
    spelled = materialise(_spellings(members).withColumns({"_deal": lots("_spellings", LOT_SPELLINGS), "_lots": lots("_n", LOT_RECORDS)}), "spellings")
    one = spelled.select("_look", _lot("_same", F.col("_deal")).alias("_at"), F.col("_same").alias("_a"), F.col("_lots").alias("_lots_a"))
    two = spelled.select("_look", _each_lot(F.col("_deal")).alias("_at"), F.col("_same").alias("_b"), F.col("_lots").alias("_lots_b"))
    pairs = one.join(two, ["_look", "_at"]).where("_a < _b").select("_a", "_lots_a", "_b", "_lots_b")
    kept = join_unique(members.select("_id", "_same"), spelled.select("_same", "_lots"), "_same", "inner")
    kept = materialise(kept.select("_id", "_same", _lot("_id", F.col("_lots")).alias("_at")), "spelled")
    left = kept.select(F.col("_same").alias("_a"), F.col("_at").alias("_at_a"), F.col("_id").alias("_ida"))
    right = kept.select(F.col("_same").alias("_b"), F.col("_at").alias("_at_b"), F.col("_id").alias("_idb"))
    half = pairs.withColumn("_at_a", _each_lot(F.col("_lots_a"))).join(left, ["_a", "_at_a"])
    both = half.withColumn("_at_b", _each_lot(F.col("_lots_b"))).join(right, ["_b", "_at_b"]).where(F.col("_ida") != F.col("_idb"))
    return both.select(F.least("_ida", "_idb").alias("id_a"), F.greatest("_ida", "_idb").alias("id_b")).distinct()
