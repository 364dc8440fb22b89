"""Where the matches of a pattern lie in a text, with column functions alone.

``regexp_extract_all`` gives the matches and ``split`` the text between them; adding up their lengths gives the places.
Places count code points from 0, ends are exclusive.  Patterns are of Java's dialect and never match an empty string;
those with a repeated group are written with possessive quantifiers, which Java runs without recursion, so that very
long matches don't exhaust its stack, and look back to the start of a run, so that long runs take linear time.

Sums and maxima of what stands before are taken in blocks, and pieces of a text are cut from chunks of it, so the time is
linear in the text and its matches: nothing is appended to a growing array or string, nor counted from the text's start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string,value:string>>"
#: Elements of a block of sums, and code points of a chunk of text.
BLOCK, CHUNK = 256, 1024


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: within a lambda an expression is evaluated anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of each element of an array of integers, ``combine`` (a sum or a maximum) over 0 and all elements before it."""
    zero, none = F.lit(0), F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

    def fold(v: Column) -> Column:
        return F.aggregate(v, F.struct(zero.alias("now"), none.alias("out")), step, lambda acc: acc["out"])

    def over(v: Column, first: Column, size: Column) -> Column:
        return F.aggregate(F.slice(v, first, size), zero, combine)

    def blocked(v: Column) -> Column:
        blocks = F.sequence(zero, F.floor(F.size(v) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: over(v, b * BLOCK + 1, F.lit(BLOCK)))
        own = lambda first: F.transform(v, lambda _, i: combine(F.get(first, F.floor(i / BLOCK).cast("int")), over(v, i - i % BLOCK + 1, i % BLOCK)))
        return F.when(F.size(v) <= BLOCK, fold(v)).otherwise(bind(fold(sums), own))

    return bind(values, blocked)


def total(a: Column, b: Column) -> Column:
    return a + b


def greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: an array of (start, end, match, value); ``value`` is the match's group."""

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        steps = F.zip_with(matches, gaps, lambda m, g: F.length(m) + F.length(g))
        value = lambda m: F.regexp_extract(m, pattern, group) if group else m
        # a match ends where all steps up to its own end
        ends = bind(steps, lambda s: F.zip_with(s, before(s, total), total))
        return F.zip_with(
            matches, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match"), value(m).alias("value"))
        )

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(SPAN)))


def spliced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """``text`` with each of ``spans`` (structs with ``start`` and ``end``, sorted by start) replaced.

    ``fill(span, at)`` stands for a span; ``at`` is how far the spans before it reach, more than its start if it overlaps one.
    """

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        size = F.floor((b - 1) / CHUNK).cast("int") - first + 1
        joined = F.array_join(F.slice(chunks, first + 1, F.greatest(size, F.lit(1))), "")
        return F.when(b > a, F.substring(joined, a % CHUNK + 1, b - a)).otherwise("")

    def pieces(s: Column, chunks: Column, ends: Column, last: Column) -> Column:
        each = F.zip_with(s, before(ends, greater), lambda one, at: F.concat(cut(chunks, at, one["start"]), fill(one, at)))
        return F.array_join(F.concat(each, F.array(cut(chunks, last, F.length(text)))), "")

    def changed(s: Column) -> Column:
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        ends = F.transform(s, lambda one: one["end"])
        return bind(chunks, lambda c: bind(ends, lambda e: bind(F.array_max(e), lambda last: pieces(s, c, e, last))))

    return bind(spans, lambda s: F.when(F.size(s) > 0, changed(s)).otherwise(text))


def joined(kinds: list[str], spans: Column) -> Column:
    """``kind:start:end`` of an array of (…, kind, start, end) in its order, comma-joined; ``kind`` is a place in ``kinds``."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
