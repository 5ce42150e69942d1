"""Texts that lost their end, and the storage limits that cut them.

Two kinds of evidence are brought together. A limit shows in lengths: many texts
of one source have exactly the same length, or lengths just below one where a store
goes back to the end of a word, but only if lengths are taken as the store took
them. So every text's length is recomputed in characters, UTF-8 bytes and UTF-16
units, with HTML entities, JSON escapes or CR LF line ends, and lengths that more
texts have than those around them name the limits of a source and their units. A
cut shows in the ending: a last line that is neither a finished sentence nor any of
the things that end without one. What these are is learnt from the collection: the
shapes of record lines that another line follows, and the outlines that many texts
end with, such as those of signatures, links, list and table rows, unless they are
the beginning of one that more texts end with. The two kinds meet where an ending alone
proves nothing: a last line that may go on (it ends in a name or a number) counts
as cut at a limit of its source and as whole elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.skew import join_unique
from termloom.session import materialise, spread

#: A limit stands out by so many texts and so many standard deviations from what the lengths near and around it hold.
SPIKE_TEXTS, SPIKE_SIGMAS, NEAR, AROUND = 4, 6, 3, 32
#: Lengths a store that goes back to the end of a word leaves below its limit.
BAND = 16
#: Shapes of record lines, and outlines of last lines, that make up less than such a share of all are not learnt; at most its inverse are.
SHAPE_SHARE, OUTLINE_SHARE, SHAPE_LINES = 1 / 2000, 1 / 200, 3
#: Outlines that texts end with this many times less often than with one they begin are cuts of it.
CUT_RATIO = 3
#: Characters of the longest line whose whole shape is looked at.
SHAPE_LENGTH = 120

_BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\u200b"
_CLOSERS = r"[\"'»”’)\]]*"
# Repeated groups are possessive, so that the longest text takes no more stack than a short one.
_AFTER = r"(?:\s*(?:\[\d+\]|\(edited\)|[:;]-?\)|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]\x{FE0F}?|~{3,}))*+"
FINISHED = rf"[.!?。！？]{_CLOSERS}{_AFTER}$"
SENTENCE_END = rf"[.!?。！？]{_CLOSERS}(\s|$)"
#: What follows the last finished sentence of a line.
UNFINISHED = rf"^(?:.*[.!?。！？]{_CLOSERS}\s+)?(.*)$"
MARKER = r"(\.\.\.|…|\[(more|\.\.\.|…|truncated|continued)\]|\((more|truncated|continued)\))$"
TITLE = r"^\p{Lu}\S*( \d+)?( \([^()]+\))?(, \d+| – \S+)?$"
#: Lines of lists and logs: they begin with a bullet and a word, or with a time.
RECORD = r"^([*\-] \p{Lu}[\p{L}:]+ |\d{4}-\d\d-\d\dT)"
#: Lines of two fields; whole ones end in a word that is no operator, or in a bracket.
QUERY_LINE = r"^\p{Lu}+\t"
WHOLE_QUERY_LINE = r"^\p{Lu}+\t(.* )?(?!(AND|OR)$)\S*[\p{L}\p{N})]$"


def _occurrences(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


#: Ways a store may take a text's length, the plainest first, and by how much a limit is missed so as not to split a character.
SLACK = {
    "chars": 0, "utf8": 3, "utf16": 1, "html": 5, "html_quotes": 5, "json": 1, "json_utf8": 3, "json_ascii": 11, "crlf": 1, "crlf_utf8": 3,
}
UNITS = tuple(SLACK)


def stored_lengths(text: Column) -> Column:
    """A text's length as different stores would take it, in the order of ``UNITS``."""
    count = lambda *what: sum((_occurrences(text, w) for w in what[1:]), _occurrences(text, what[0]))
    chars, utf8, lines = F.length(text), F.octet_length(text), _occurrences(text, "\n")
    utf16 = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    beyond_ascii = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    tags = 4 * count("&") + 3 * count("<", ">")
    escapes = count('"', "\\", "\n", "\r", "\t")
    lengths = {
        "chars": chars,
        "utf8": utf8,
        "utf16": utf16,
        "html": chars + tags,
        "html_quotes": chars + tags + 5 * count('"', "'"),
        "json": chars + escapes,
        "json_utf8": utf8 + escapes,
        # Each character beyond ASCII is written as \uXXXX, those beyond 16 bits as two.
        "json_ascii": chars + escapes + 5 * beyond_ascii + 6 * (utf16 - chars),
        "crlf": chars + lines,
        "crlf_utf8": utf8 + lines,
    }
    return F.array(*[lengths[unit].cast("bigint") for unit in UNITS])


def _standing_out(held: np.ndarray, usual: np.ndarray) -> np.ndarray:
    return held >= SPIKE_TEXTS + usual + SPIKE_SIGMAS * np.sqrt(usual)


def _bars(judged: DataFrame) -> DataFrame:
    """``source, i, n, texts, cut``: texts of each length in each unit. One row per different length, however many texts have it."""
    each = judged.select("source", "ending", F.posexplode("lengths").alias("i", "n"))
    return each.groupBy("source", "i", "n").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("ending") == "cut").alias("cut"))


#: More than any length: keeps the lengths of different sources and units apart when they are put in one row.
_SPAN = 1 << 40


def _over_lengths(choose):
    """Applies ``choose`` to bars that come sorted by source, unit and length; sources and units stay whole."""

    def chosen(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        i, n, texts, cut = (table.column(c).to_numpy() for c in ("i", "n", "texts", "cut"))
        place = group * _SPAN + n
        sums = {name: np.concatenate([[0], np.cumsum(x)]) for name, x in (("texts", texts), ("cut", cut))}
        # Total of a source and unit up to this length plus an offset, and of all before it, which differences leave out.
        upto = lambda offset, name="texts": sums[name][np.searchsorted(place, place + offset, side="right")]
        keep, lo, held, ends = choose(i, upto, texts, cut)
        kept = np.flatnonzero(keep)
        columns = [table.column("source").combine_chunks().take(pa.array(kept)), *(pa.array(x[kept]) for x in (i, n + lo, n, held, ends))]
        return pa.RecordBatch.from_arrays(columns, ["source", "i", "lo", "hi", "texts", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            waiting = new if waiting is None else pa.concat_tables([waiting, new])
            source = waiting.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            i = waiting.column("i").to_numpy()
            group = np.concatenate([[0], np.cumsum((source[1:] != source[:-1]) | (i[1:] != i[:-1]))])
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield chosen(waiting.slice(0, last), group[:last])
                waiting = waiting.slice(last)
        if waiting is not None:
            yield chosen(waiting, np.zeros(waiting.num_rows, np.int64))

    return run


def _spike(i, upto, texts, cut):
    gap = np.maximum(np.array(list(SLACK.values())), 1)[i]
    near, around = ((upto(-gap - 1) - upto(-gap - 1 - far), upto(far) - upto(0)) for far in (NEAR, AROUND))
    # Near by, either side counts: a band has lengths on one side of each of its own.
    usual = np.maximum(np.maximum(*near) / NEAR, sum(around) / (2 * AROUND))
    # Texts that missed the limit for a character's sake are fewer than those that met it.
    missed = upto(-1) - upto(-gap - 1)
    return _standing_out(texts, usual) & (texts >= missed) & (2 * cut >= texts), 0, texts, cut


def _band(i, upto, texts, cut):
    held, ends = (upto(0, name) - upto(-BAND, name) for name in ("texts", "cut"))
    sides = upto(-BAND) - upto(-BAND - 2 * AROUND), upto(2 * AROUND) - upto(0)
    return _standing_out(held, np.maximum(*sides) * (BAND / (2 * AROUND))) & (2 * ends >= held), 1 - BAND, held, ends


def _chosen(bars: DataFrame, choose) -> DataFrame:
    kind = bars.schema["source"].dataType.simpleString()
    sorted_bars = bars.repartition("source", "i").sortWithinPartitions("source", "i", "n")
    return sorted_bars.mapInArrow(_over_lengths(choose), f"source {kind}, i int, lo bigint, hi bigint, texts bigint, cut bigint")


def _spikes(bars: DataFrame) -> DataFrame:
    """``source, i, lo, hi, texts`` of single lengths that stand out."""
    return _chosen(bars, _spike).drop("cut")


def _bands(bars: DataFrame) -> DataFrame:
    """``source, i, lo, hi, texts`` of runs of ``BAND`` lengths that stand out; of those that overlap the first with the most cut texts."""
    near = Window.partitionBy("source", "i").orderBy("hi").rangeBetween(-BAND, BAND)
    best = F.max(F.struct("cut", (-F.col("hi")).alias("hi"))).over(near)
    return _chosen(bars, _band).withColumn("best", best).where(-F.col("best.hi") == F.col("hi")).drop("best", "cut")


def _met(limits: DataFrame, judged: DataFrame) -> DataFrame:
    """``judged`` with ``met`` (``limits`` is a written table): the limit ``texts, i, lo, hi`` a text has the length of, that of most texts and of the plainest unit; else null."""
    row = F.struct("texts", (-F.col("i")).alias("i"), "lo", "hi")
    listed = limits.groupBy("source").agg(F.collect_list(row).alias("_limits"))
    size = limits.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 40)).first()[0]
    if size is None:  # no limits
        return judged.withColumn("met", F.lit(None).cast(listed.schema["_limits"].dataType.elementType))
    joined = join_unique(judged, listed, "source", size=size)
    length = lambda x: F.get(F.col("lengths"), -x["i"])
    slack = lambda x: F.get(F.array(*[F.lit(n) for n in SLACK.values()]), -x["i"])
    at = F.filter("_limits", lambda x: length(x).between(x["lo"] - slack(x), x["hi"]))
    return joined.withColumn("met", F.array_max(at)).drop("_limits")


def _held(limits: DataFrame, judged: DataFrame) -> DataFrame:
    """The limits that still hold texts when each text counts at one limit only: one limit shows in several units."""
    counted = _met(limits, judged).where("met IS NOT NULL").groupBy("source", "met").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where(F.col("n") * 2 >= F.col("met.texts"))
    return kept.select("source", (-F.col("met.i")).alias("i"), "met.lo", "met.hi", F.col("n").alias("texts"))


def source_limits(judged: DataFrame) -> DataFrame:
    """``source, i, lo, hi, texts``: the lengths that limits of a source leave, in unit number ``i``, and the texts that have them.

    ``judged`` has rows ``source, ending, lengths`` as ``judge`` makes them. A
    limit must stand out from the lengths around it, and half of its texts or
    more must end as if cut: texts of one length by chance mostly do not. First
    come limits that texts meet exactly (``lo = hi``), then, among the texts that
    meet none, those kept to within ``BAND``.
    """
    exact = materialise(_held(materialise(_spikes(_bars(judged)), "spikes"), judged), "exact")
    rest = _met(exact, judged).where("met IS NULL").select("source", "ending", "lengths")
    bands = materialise(_bands(_bars(rest)), "bands")
    return exact.unionByName(_held(bands, rest))


def _shape(line: Column) -> Column:
    """What a record line keeps once names, numbers and quoted parts are masked: how it begins and its last two words."""
    masked = F.regexp_replace(F.regexp_replace(line, '"[^"]*"', '"Q"'), r"\d+(?:[.,]\d+)*+", "0")
    words = F.split(masked, " ")
    begin = F.when(line.rlike(r"^[*\-] "), F.concat_ws(" ", F.slice(words, 1, 2))).otherwise(F.get(words, F.lit(0)).substr(1, 2))
    end = F.transform(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), lambda w: F.regexp_replace(w, r"^(\(?)\p{Lu}[\p{L}\-]*$", "$1W"))
    return F.concat_ws(" ", begin, F.lit("~"), F.concat_ws(" ", end))


def _outline(line: Column) -> Column:
    """A line with words and numbers masked, for lines that are more than words: signs tell what they are. Null for others."""
    capital = F.regexp_replace(line, r"\p{Lu}[\p{L}\p{M}'’\-]*", "\x01")
    words = F.translate(F.regexp_replace(capital, r"\p{L}[\p{L}\p{M}'’\-]*", "w"), "\x01", "W")
    masked = F.regexp_replace(words, r"\d+(?:[.,:]\d+)*+", "0")
    return F.when((F.length(line) <= SHAPE_LENGTH) & masked.rlike(r"[^Ww0\s,;()\"'»«”“’.-]|^- |-- "), masked)


def _last_line(text: Column) -> Column:
    return F.substring_index(F.rtrim(text, F.lit(_BLANKS)), "\n", -1)


def line_shapes(df: DataFrame, text: str) -> tuple[list[str], list[str]]:
    """Shapes of record lines that another line follows, and outlines of what texts end with after their last finished sentence.

    At most ``1 / SHAPE_SHARE`` and ``1 / OUTLINE_SHARE`` of them.
    """
    column, lines = F.col(text), F.split(F.col(text), "\n")
    inner = F.filter(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(RECORD))
    records = F.when(column.rlike("(?m)" + RECORD), F.transform(inner, _shape))
    shown = df.select(records.alias("records"), _last_line(column).alias("last"))
    prose = ~F.col("last").rlike(FINISHED) & ~F.col("last").rlike(MARKER) & ~F.col("last").rlike(RECORD) & ~F.col("last").rlike(QUERY_LINE)
    outline = F.when(prose, _outline(F.regexp_extract("last", UNFINISHED, 1)))
    each = shown.select(F.explode(F.concat(
        F.transform(F.coalesce("records", F.array().cast("array<string>")), lambda x: F.struct(F.lit(True).alias("record"), x.alias("shape"))),
        F.array(F.struct(F.lit(False).alias("record"), outline.alias("shape"))),
    )).alias("x")).where("x.shape IS NOT NULL")
    shapes = materialise(each.groupBy("x.record", "x.shape").agg(F.count(F.lit(1)).alias("n")), "shapes")
    totals = {r["record"]: r["n"] for r in shapes.groupBy("record").agg(F.sum("n").alias("n")).collect()}
    least = F.when(F.col("record"), totals.get(True, 0) * SHAPE_SHARE).otherwise(totals.get(False, 0) * OUTLINE_SHARE)
    common = shapes.where((F.col("n") >= SHAPE_LINES) & (F.col("n") >= least)).collect()
    ends = {r["shape"]: r["n"] for r in common if not r["record"]}
    whole = [x for x, n in ends.items() if not any(y != x and y.startswith(x) and m >= CUT_RATIO * n for y, m in ends.items())]
    return [r["shape"] for r in common if r["record"]], whole


def with_endings(df: DataFrame, text: str, records: list[str], outlines: list[str]) -> DataFrame:
    """``df`` with a column ``ending``: ``cut``, ``whole`` or ``open`` (whole as far as it tells, but it could go on); null for blank texts."""
    # In steps, as each is used many times: Spark keeps such columns instead of working them out at every use.
    steps = df.withColumn("_stripped", F.rtrim(F.col(text), F.lit(_BLANKS)))
    steps = steps.withColumns(
        {
            "_last": F.substring_index("_stripped", "\n", -1),
            "_before": F.substring_index(F.substring_index("_stripped", "\n", -2), "\n", 1),
            "_several": F.instr("_stripped", "\n") > 0,
        }
    )
    last, before, several = (F.col(c) for c in ("_last", "_before", "_several"))
    steps = steps.withColumn("_finished", last.rlike(FINISHED))
    finished = F.col("_finished")
    in_records = F.when(several, before.rlike(RECORD) | (before.rlike(":$") & last.rlike(RECORD))).otherwise(last.rlike(RECORD))
    queries = F.when(several, before.rlike(QUERY_LINE)).otherwise(last.rlike(QUERY_LINE))
    listed = lambda shape, known: shape.isin(known) if known else F.lit(False)
    plain_style = ~F.col(text).rlike(SENTENCE_END) & ~F.col(text).rlike(r"\p{Lu}\p{Ll}")
    state = F.when(last.rlike(r"[\p{L}\p{N}]$"), "open").otherwise("whole")
    ending = (
        F.when(F.coalesce(F.length("_stripped"), F.lit(0)) == 0, None)
        .when(last.rlike(MARKER), "cut")
        .when(queries, F.when(last.rlike(WHOLE_QUERY_LINE), state).otherwise("cut"))
        .when(in_records, F.when(listed(_shape(last), records), state).otherwise("cut"))
        .when(finished, "whole")
        .when(listed(_outline(F.regexp_extract(last, UNFINISHED, 1)), outlines), state)
        .when(~several & last.rlike(TITLE), "whole")
        # A text that nowhere ends a sentence with a mark tells nothing by not doing so at its end.
        .when(plain_style, state)
        .otherwise("cut")
    )
    return steps.withColumn("ending", ending).drop("_stripped", "_last", "_before", "_several", "_finished")


def judge(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``key, source, ending, lengths`` of every text that is not blank, written to the shared folder."""
    rows = spread(df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).cast("string").alias("text")))
    # Blank texts go by the text; a filter on the ending would have that worked out a second time.
    shown = rows.where(F.length(F.rtrim(F.col("text"), F.lit(_BLANKS))) > 0)
    judged = with_endings(shown, "text", *line_shapes(rows, "text"))
    return materialise(judged.select("key", "source", "ending", stored_lengths(F.col("text")).alias("lengths")), "judged")


def _decide(judged: DataFrame, limits: DataFrame) -> DataFrame:
    by_ending, by_length = F.col("ending") == "cut", F.col("at_limit") & F.col("ending").isin("cut", "open")
    decided = _met(limits, judged).withColumn("at_limit", F.col("met").isNotNull())
    evidence = F.when(by_ending & by_length, "both").when(by_ending, "ending").when(by_length, "length")
    return decided.select("key", "source", "ending", "at_limit", "met", evidence.alias("evidence"), evidence.isNotNull().alias("truncated"))


def truncated_texts(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``key, source, ending, at_limit, evidence, truncated`` of every row of ``df`` with a text that is not blank.

    ``truncated`` is true if the ending is cut, or is open and the text has a
    length that a limit of its source leaves; ``evidence`` says whether that shows in the
    ``length``, in the ``ending`` or in ``both``, and is null for whole texts. Null and blank texts are
    left out; rows with a null source form a source of their own; repeated rows
    stay repeated. Empty tables give no rows, and other columns are ignored.
    """
    judged = judge(df, key, source, text)
    decided = _decide(judged, materialise(source_limits(judged), "kept"))
    return decided.select(F.col("key").alias(key), F.col("source").alias(source), "ending", "at_limit", "evidence", "truncated")


def truncation_rates(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``source, texts, truncated, share, by_length, by_ending`` and the source's ``limits``.

    ``limits`` is a list of ``unit, limit, within, texts``, empty where none shows: the greatest
    length that is left, how far below it lengths lie, and how many texts have one of them.
    """
    judged = judge(df, key, source, text)
    limits = materialise(source_limits(judged), "kept")
    has = lambda *kinds: F.count_if(F.col("evidence").isin(*kinds))
    rates = _decide(judged, limits).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated"),
        has("length", "both").alias("by_length"), has("ending", "both").alias("by_ending"),
    )
    units = F.array(*[F.lit(u) for u in UNITS])
    row = F.struct(F.get(units, F.col("i")).alias("unit"), F.col("hi").alias("limit"), (F.col("hi") - F.col("lo")).alias("within"), "texts")
    listed = limits.groupBy(F.col("source").alias("_source")).agg(F.sort_array(F.collect_list(row)).alias("limits"))
    # One row per source on either side.
    joined = rates.join(listed, F.col("source").eqNullSafe(F.col("_source")), "left")
    share = F.round(F.col("truncated") / F.col("texts"), 6)
    limits = F.coalesce("limits", F.array().cast(listed.schema["limits"].dataType))
    return joined.select(F.col("source").alias(source), "texts", "truncated", share.alias("share"), "by_length", "by_ending", limits.alias("limits"))
