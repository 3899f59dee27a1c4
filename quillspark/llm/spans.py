"""Matches of a pattern with their places in code points, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Code points of the text before and after a match that are kept as its context.
AROUND = 32
MATCH = "array<struct<s:int,e:int,hit:string,before:string,after:string>>"


def found(text: Column, pattern: str) -> Column:
    """s, e (end exclusive), hit, before and after of all matches from left to right. The text between matches gives the places; a text without a match is scanned once."""

    def starts(gaps: Column, hits: Column) -> Column:
        sizes = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            sizes, start,
            lambda a, x: F.struct((a["at"] + x["g"] + F.coalesce(x["h"], F.lit(0))).alias("at"), F.when(x["h"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["at"] + x["g"])).alias("out")),
        )["out"]

    def matches(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        each = lambda h: let(starts(gaps, h), lambda p: F.transform(h, lambda x, i: one(gaps, p, x, i)))
        return F.when(F.size(gaps) < 2, F.array().cast(MATCH)).otherwise(let(hits, each))

    def one(gaps: Column, places: Column, hit: Column, i: Column) -> Column:
        at = F.get(places, i)
        return F.struct(at.alias("s"), (at + F.length(hit)).alias("e"), hit.alias("hit"), F.right(F.get(gaps, i), F.lit(AROUND)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("after"))

    return let(F.split(text, pattern, -1), matches)


def count_of(x: Column, pattern: str) -> Column:
    """Matches of pattern in x."""
    return F.size(F.split(x, pattern, -1)) - 1


def redacted(text: Column, spans: Column, mask) -> Column:
    """text with each of spans (sorted structs of s and e that don't overlap) replaced by mask(span)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        # of overlapping spans the first is masked, and the last end counts
        between = F.when(x["s"] > a["at"], F.substr(text, a["at"] + 1, x["s"] - a["at"])).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], between, F.when(x["s"] >= a["at"], mask(x)).otherwise(F.lit(""))).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(spans, start, step), lambda r: F.concat(r["out"], F.substr(text, r["at"] + 1))))
