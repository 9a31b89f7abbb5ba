"""Spans of regular expressions in a text as Column expressions only: no Python on the executors.

A span is a struct (s, o, e, k, m): start and end in code points (end
exclusive), the kind's place in its list, the kind and the matched text.
Fields stand in the order in which spans sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:bigint,o:int,e:bigint,k:string,m:string>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(rows: Column, step: Callable[[Column, Callable[[int], Column]], Column]) -> Column:
    """Prefix results of an array by doubling: about log2(n) passes, each as long as the array.

    In every pass ``step(x, at)`` makes the new entry from the entry ``x`` and
    its neighbours ``at(-1)`` and ``at(1)`` at the distance of the pass (null
    beyond the ends), so entries of any length never grow an array one by one.
    """
    def whole(first: Column) -> Column:
        passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(first), F.lit(1)))).cast("int"))
        far = F.transform(passes, lambda i: F.pow(F.lit(2.0), i).cast("int"))
        return F.aggregate(far, first, lambda acc, d: F.transform(acc, lambda x, j: step(x, lambda side: F.get(acc, j + side * d))))

    return let(rows, whole)


def all_matches(text: Column, asked: Sequence[tuple[str, str, int, Column | None]]) -> Column:
    """For each (pattern, kind, order, where) the leftmost non-overlapping matches: an array of arrays of spans.

    ``where``: a cheap condition without which there can't be any. The gaps
    between matches and the matches' lengths add up to the places, so no position
    is searched for again, and time grows with the text only.
    """
    pair = "array<struct<e:bigint,m:string>>"

    def pairs(pattern: str, kind: str, order: int, where: Column | None) -> Column:
        found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        both = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct((F.length(g) + F.length(m)).cast("long").alias("e"), m.alias("m"))), lambda x: x["m"].isNotNull())
        has = text.rlike(pattern) if where is None else where & text.rlike(pattern)
        return F.struct(F.when(has, both.cast(pair)).otherwise(F.array().cast(pair)).alias("p"), F.lit(order).alias("o"), F.lit(kind).alias("k"))

    def spans(q: Column) -> Column:
        ends = running(q["p"], lambda x, at: F.struct((x["e"] + F.coalesce(at(-1)["e"], F.lit(0).cast("long"))).alias("e"), x["m"].alias("m")))
        return F.transform(ends, lambda x: F.struct((x["e"] - F.length(x["m"])).alias("s"), q["o"].alias("o"), x["e"].alias("e"), q["k"].alias("k"), x["m"].alias("m"))).cast(SPANS)

    return F.transform(F.array(*(pairs(*one) for one in asked)), spans)


def matches(text: Column, pattern: str, kind: str, order: int, where: Column | None = None) -> Column:
    """all_matches() of one pattern."""
    return F.element_at(all_matches(text, [(pattern, kind, order, where)]), 1)


def free(spans: Column, blockers: Column) -> Column:
    """The spans that overlap none of ``blockers``, by start: both are sorted together once.

    A span is free if all blockers that begin before or with it end by its start,
    and the next one begins at its end or later.
    """
    never, zero = F.lit(2**62).cast("long"), F.lit(0).cast("long")
    blocking = lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("own"), b.alias("x"), b["e"].alias("reach"), b["s"].alias("next"))
    asking = lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x.alias("x"), zero.alias("reach"), never.alias("next"))

    def step(x: Column, at: Callable[[int], Column]) -> Column:
        reach, then = F.greatest(x["reach"], F.coalesce(at(-1)["reach"], zero)), F.least(x["next"], F.coalesce(at(1)["next"], never))
        return F.struct(x["s"].alias("s"), x["own"].alias("own"), x["x"].alias("x"), reach.alias("reach"), then.alias("next"))

    def among(both: Column) -> Column:
        seen = running(F.sort_array(F.concat(F.transform(both["b"], blocking), F.transform(both["a"], asking))), step)
        open_ = F.filter(seen, lambda r: (r["own"] == 1) & (r["reach"] <= r["x"]["s"]) & (r["next"] >= r["x"]["e"]))
        return F.when((F.size(both["a"]) == 0) | (F.size(both["b"]) == 0), both["a"]).otherwise(F.transform(open_, lambda r: r["x"]))

    return let(F.struct(spans.alias("a"), blockers.alias("b")), among)


#: Code points of a chunk of text.
CHUNK = 256


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, so that reading around a place doesn't walk through the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to before ``end`` (at least 0) of the text in chunks()."""
    first = F.floor(start / CHUNK).cast("int")
    many = F.floor(end / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(pieces, first + 1, F.greatest(many, F.lit(0))), ""), (start - first * CHUNK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    back = F.reverse(number)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
            F.substring(back, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(back, i, F.lit(1)) > "4", 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def merged(parts: Sequence[Column]) -> Column:
    """All spans of several columns, by start and then by kind."""
    return F.sort_array(F.concat(*parts))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined with commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def masked(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with every run of overlapping spans (in order) replaced by the label of its first."""
    zero = F.lit(0).cast("long")

    def step(x: Column, at: Callable[[int], Column]) -> Column:
        return F.struct(x["x"].alias("x"), x["j"].alias("j"), F.greatest(x["reach"], F.coalesce(at(-1)["reach"], zero)).alias("reach"))

    def joined(both: Column) -> Column:
        pieces, seen, runs = both["pieces"], both["seen"], both["runs"]
        before = lambda r: F.coalesce(F.get(seen, r["j"] - 1)["reach"], zero)
        blocks = F.transform(runs, lambda r: F.concat(part(pieces, before(r), r["x"]["s"]), label(r["x"])))
        tail = F.element_at(seen, -1)["reach"]
        return F.concat(F.array_join(blocks, ""), part(pieces, tail, F.length(text).cast("long")))

    seen = running(F.transform(spans, lambda x, j: F.struct(x.alias("x"), j.alias("j"), x["e"].alias("reach"))), step)
    starts = lambda all_: F.filter(all_, lambda r: (r["j"] == 0) | (F.get(all_, r["j"] - 1)["reach"] <= r["x"]["s"]))
    whole = let(seen, lambda all_: let(F.struct(chunks(text).alias("pieces"), all_.alias("seen"), starts(all_).alias("runs")), joined))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
