"""Matches of a regular expression with their places, as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,found:string,part:string>>"
_BLOCK = 64


def bound(*values: Column, then) -> Column:
    """``then(*values)`` with each value computed once: Spark evaluates an expression inside a lambda for every element
    even if it does not depend on it, but a lambda's variable is only read."""
    fields = [v.alias(f"v{i}") for i, v in enumerate(values)]
    return F.element_at(F.transform(F.array(F.struct(*fields)), lambda s: then(*[s[f"v{i}"] for i in range(len(values))])), 1)


def matches(text: Column, pattern: str, look: Column, part: str | None = None, around: int = 0) -> Column:
    """Array of (start, end, found, part): the leftmost non-overlapping matches in code points, end exclusive.

    ``look``: a cheap necessary condition, so that other texts cost nothing more. ``pattern`` has no capturing group;
    ``part`` is a pattern with one group, taken from each match (else part is the match). Each match of the expression
    below begins where the last one ended, holds the text up to the next match and that match, so one pass over the
    text gives lengths whose running sums are the places. With ``around`` there are two fields more: ``before``, up to
    so many characters before the match, and ``after``, the character after it.
    """
    step = F.lit(f"(?s)\\G(.*?)({pattern})")
    up_to = F.regexp_extract_all(text, step, F.lit(0))
    found = F.regexp_extract_all(text, step, F.lit(2))

    def made(up_to: Column, found: Column, ends: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            fields = [(x["end"] - F.length(x["found"])).alias("start"), x["end"].alias("end"), x["found"].alias("found"), (F.regexp_extract(x["found"], part, 1) if part else x["found"]).alias("part")]
            if around:
                gap = F.left(x["up_to"], F.length(x["up_to"]) - F.length(x["found"]))
                last = F.when(i > 0, F.element_at(up_to, F.greatest(i, F.lit(1)))).otherwise("")
                following = F.when(i + 1 < F.size(up_to), F.left(F.element_at(up_to, F.least(i + 2, F.size(up_to))), F.lit(1))).otherwise(F.substring(text, x["end"] + 1, F.lit(1)))
                fields += [F.right(F.concat(F.right(last, F.lit(around)), gap), F.lit(around)).alias("before"), following.alias("after")]
            return F.struct(*fields)

        return F.transform(F.arrays_zip(ends.alias("end"), found.alias("found"), up_to.alias("up_to")), one)

    all_ = bound(up_to, found, then=lambda u, f: bound(u, f, running_sum(F.transform(u, F.length)), then=made))
    kind = SPAN.replace("part:string", "part:string,before:string,after:string") if around else SPAN
    return F.when(look, all_).otherwise(F.array().cast(kind))


def running_sum(numbers: Column) -> Column:
    """Running sums of an array, block by block: about linear in its length."""
    at = lambda i: F.floor(i / _BLOCK).cast("int")

    def blocks(numbers: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), at(F.size(numbers))), lambda b: total(F.slice(numbers, b * _BLOCK + 1, _BLOCK)))

    def sums(numbers: Column, before: Column) -> Column:
        return F.transform(numbers, lambda _, i: F.element_at(before, at(i) + 1) + total(F.slice(numbers, at(i) * _BLOCK + 1, i % _BLOCK + 1)))

    grown = lambda b: F.aggregate(b, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    return bound(numbers, then=lambda n: bound(n, grown(blocks(n)), then=sums))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _rank(ordered: Column, x: Column, or_equal: bool = False) -> Column:
    """How many numbers of an ascending array (a lambda's variable) are below ``x``, or equal: by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + F.lit(1))).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        at = F.element_at(ordered, F.least(mid + 1, F.size(ordered)))
        below = at <= x if or_equal else at < x
        open_ = s["low"] < s["high"]
        low = F.when(open_ & below, mid + 1).otherwise(s["low"])
        high = F.when(open_ & ~below, mid).otherwise(s["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    return F.when(F.size(ordered) > 0, F.aggregate(steps, start, halve)["low"]).otherwise(0)


def apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of ``others``; both in any order, ``others`` may overlap each other.

    A span is overlapped by those that begin before its end less those that end at its start or before, and both numbers
    are found by halving in sorted arrays.
    """
    starts, ends = F.array_sort(_each(others, "start")), F.array_sort(_each(others, "end"))
    free = lambda all_, s, e: F.filter(all_, lambda x: _rank(s, x["end"]) == _rank(e, x["start"], True))
    return F.when(F.size(others) > 0, bound(spans, starts, ends, then=free)).otherwise(spans)


def outside(spans: Column, others: Column) -> Column:
    """The parts of ``spans`` (start, end, found, of) outside ``others``, which are in order and do not overlap.

    ``of`` is the start of the text ``found``, whose characters from start - of to end - of make the part.
    """

    def cut(all_: Column, starts: Column, ends: Column) -> Column:
        def parts(x: Column) -> Column:
            def gaps(x: Column, low: Column, high: Column) -> Column:
                def gap(i: Column) -> Column:
                    start = F.when(i == low, x["start"]).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))))
                    end = F.when(i == high, x["end"]).otherwise(F.element_at(starts, F.least(i + 1, F.size(starts))))
                    return F.struct(F.greatest(start, x["start"]).alias("start"), F.least(end, x["end"]).alias("end"), x["found"].alias("found"), x["of"].alias("of"))

                return F.filter(F.transform(F.sequence(low, high), gap), lambda g: g["start"] < g["end"])

            return bound(x, _rank(ends, x["start"], True), _rank(starts, x["end"]), then=gaps)

        return F.flatten(F.transform(all_, parts))

    return F.when(F.size(others) > 0, bound(spans, _each(others, "start"), _each(others, "end"), then=cut)).otherwise(spans)


def _each(spans: Column, field: str) -> Column:
    return F.transform(spans, lambda s: s[field])


def listed(kinds: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` of all spans, by start, then in the kinds' order; joined by commas."""
    tagged = [_tagged(spans, n, kind) for n, (kind, spans) in enumerate(kinds)]
    rows = F.array_sort(reduce(lambda a, b: F.concat(a, b), tagged))
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


def _tagged(spans: Column, n: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind")))
