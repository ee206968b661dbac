"""Matches with their places, in DataFrame functions only.

``split`` gives what stands between the matches that ``regexp_extract_all`` gives, so running sums of lengths are the matches' places in code points.
Patterns must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "struct<start:int,end:int,value:string>"
BESIDE = "struct<start:int,end:int,value:string,before:string,after:string>"
#: Matches that are put in order at a time; places of one run of them are shifted together, so a text's work is not the square of its matches.
RUN = 256
#: The first five words of a text, with what stands before each; never cut within a word.
FIVE = r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,5}+"


def words_after(text: Column) -> Column:
    """The text up to its fifth word."""
    return F.regexp_extract(text, FIVE, 0)


def words_before(text: Column) -> Column:
    """The text from its fifth last word on."""
    return F.reverse(F.regexp_extract(F.reverse(text), FIVE, 0))


def located(text: str, matches: str, pattern: Column, beside: bool = False) -> Column:
    """array<PLACE> of the column ``matches`` = all matches of ``pattern`` in the column ``text``; ``beside``: array<BESIDE>, with the five words before and after, up to the next match."""
    pieces = F.split(text, pattern, -1)
    # the pieces go through a one-element array, so that they are made once and not for each use
    places = F.transform(F.array(pieces), lambda p: _over(matches, p, beside))[0]
    return F.when(F.size(matches) > 0, places).otherwise(_none(beside))


def _none(beside: bool) -> Column:
    return F.expr(f"cast(array() as array<{BESIDE if beside else PLACE}>)")


def _over(matches: str, p: Column, beside: bool) -> Column:
    """Places of the matches between the pieces ``p``."""
    m = F.col(matches)
    zero = F.struct(F.lit(0).alias("pos"), _none(beside).alias("out"))

    def place(start: Column, i: Column) -> Column:
        more = [words_before(F.get(p, i)).alias("before"), words_after(F.get(p, i + 1)).alias("after")] if beside else []
        return F.struct(start.alias("start"), (start + F.length(F.get(m, i))).alias("end"), F.get(m, i).alias("value"), *more)

    def step(s: Column, i: Column) -> Column:
        start = s.getField("pos") + F.length(F.get(p, i))
        return F.struct((start + F.length(F.get(m, i))).alias("pos"), F.concat(s.getField("out"), F.array(place(start, i))).alias("out"))

    def shifted(by: Column):
        fields = lambda x: [x.getField(f).alias(f) for f in ("value", *(("before", "after") if beside else ()))]
        return lambda x: F.struct((x.getField("start") + by).alias("start"), (x.getField("end") + by).alias("end"), *fields(x))

    runs = F.transform(F.sequence(F.lit(0), F.size(m) - 1, F.lit(RUN)), lambda lo: F.aggregate(F.sequence(lo, F.least(lo + RUN, F.size(m)) - 1), zero, step))
    both = lambda s, r: F.struct((s.getField("pos") + r.getField("pos")).alias("pos"), F.concat(s.getField("out"), F.transform(r.getField("out"), shifted(s.getField("pos")))).alias("out"))
    return F.aggregate(runs, zero, both, lambda s: s.getField("out"))


def replaced(text: str, places: str, by) -> Column:
    """The text with each place (in order of start; one that begins within the last is passed over) replaced by ``by(place)``."""
    t = F.col(text)
    zero = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<string>)").alias("out"))
    fresh = lambda s, x: x.getField("start") >= s.getField("pos")
    more = lambda s, x: F.concat(s.getField("out"), F.array(F.substring(t, s.getField("pos") + 1, x.getField("start") - s.getField("pos")), by(x)))
    step = lambda s, x: F.struct(F.when(fresh(s, x), x.getField("end")).otherwise(s.getField("pos")).alias("pos"), F.when(fresh(s, x), more(s, x)).otherwise(s.getField("out")).alias("out"))
    rest = lambda s: F.concat(F.array_join(s.getField("out"), ""), F.substring(t, s.getField("pos") + 1, F.length(t)))
    return F.when(F.size(places) > 0, F.aggregate(places, zero, step, rest)).otherwise(t)
