"""Positions of pattern matches in texts, on built-in functions.

A span is struct(start, end, kind, value): code points, end exclusive, in order of text. Matches
are leftmost and do not overlap within a kind; what a caller drops afterwards stays consumed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def _running(values: Column, combine=lambda x, y: x + y, unit: int = 0) -> Column:
    """Running totals: in each of log2(size) steps, each place adds the one 1, 2, 4, … before it.

    An array that an aggregate lets grow match by match is copied each time: quadratic in a text's matches.
    `combine` may be another associative operation, of which `unit` changes nothing.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(
        steps, values,
        lambda acc, k: F.slice(F.zip_with(acc, F.concat(F.array_repeat(F.lit(unit), F.pow(F.lit(2), k).cast("int")), acc), lambda x, y: combine(x, y)), F.lit(1), F.size(acc)),
    )


def spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All matches of `pattern`; value is the named group. Only texts that match are cut up."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.transform(whole, F.char_length)
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    ends = _running(F.zip_with(F.slice(between, 1, F.size(whole)), lengths, lambda gap, n: gap + n))
    places = F.zip_with(ends, lengths, lambda end, n: F.struct((end - n).alias("start"), end.alias("end")))
    found = F.zip_with(places, value, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def apart(found: Column, others: Column, touching: bool = False) -> Column:
    """Those of `found` that overlap none of `others` (with `touching`, neither touch any), by start.

    Both are sorted into one array; a span is met by an earlier one if the running maximum of ends reaches
    it, by a later one if the running minimum of starts from behind does: n log n, not all pairs.
    """
    far = 2**31 - 1
    mark = lambda rank: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
    every = F.array_sort(F.concat(F.transform(others, mark(0)), F.transform(found, mark(1))))
    reach = _running(F.transform(every, lambda s: F.when(s["rank"] == 0, s["end"]).otherwise(-1)), F.greatest, -1)
    starts = F.reverse(F.transform(every, lambda s: F.when(s["rank"] == 0, s["start"]).otherwise(far)))
    coming = F.reverse(_running(starts, F.least, far))
    edge = 0 if touching else 1
    met = F.zip_with(reach, coming, lambda r, c: F.struct(r.alias("reach"), c.alias("coming")))
    judged = F.zip_with(every, met, lambda s, m: F.struct(
        s.alias("s"), ((s["rank"] == 1) & (m["reach"] < s["start"] + edge) & (m["coming"] > s["end"] - edge)).alias("free"),
    ))
    plain = F.transform(F.filter(judged, lambda j: j["free"]), lambda j: F.struct(
        j["s"]["start"].alias("start"), j["s"]["end"].alias("end"), j["s"]["kind"].alias("kind"), j["s"]["value"].alias("value"),
    ))
    return F.when(F.size(others) == 0, found).otherwise(plain).cast(SPAN)


def ordered(spans_: Column, kinds: list[str]) -> Column:
    """By start, then kind as listed."""
    rank = {k: i for i, k in enumerate(kinds)}
    position = F.create_map(*[F.lit(x) for k, i in rank.items() for x in (k, i)])
    keyed = F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), position[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def joined(spans_: Column, kinds: list[str]) -> Column:
    """kind:start:end of the ordered spans, comma-joined."""
    return F.array_join(F.transform(ordered(spans_, kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans_: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")
