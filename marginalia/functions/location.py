"""Reader locations: decoding, comparing, and mapping between locations and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

WORDS_PER_LOCATION = 150
LOCATIONS_PER_PAGE = 10


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def location_page(loc: Column) -> Column:
    return F.greatest(F.lit(1), _floor_div(loc, LOCATIONS_PER_PAGE))


# Group 1 and 2 of a range; a whole number.
_RANGE, _WHOLE = r"\A\+?(\d+)\s*-\s*\+?(\d+)\z", r"\A[+-]?\d+\z"


def decode(c: Column | str) -> Column:
    """struct of "a-b" (range), "a" (single), digits somewhere (extracted) or neither (error).

    Two parts around one hyphen that aren't both whole numbers are a broken range: an error, whatever digits they hold.
    """
    c = _col(c)

    def parse(s: Column) -> Column:
        part = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit("")).try_cast("int")
        return F.struct(s.alias("s"), part(_RANGE, 1).alias("a"), part(_RANGE, 2).alias("b"), part(_WHOLE, 0).alias("whole"),
            part(r"\d+", 0).alias("digits"), (F.size(F.split(s, "-")) == 2).alias("two"))

    def shaped(v: Column) -> Column:
        s, a, b, whole, digits, two = (v.getField(n) for n in ("s", "a", "b", "whole", "digits", "two"))
        ranged = a.isNotNull() & b.isNotNull()
        broken = two & ~ranged
        loc = F.when(~broken, F.coalesce(F.when(ranged, a), whole, digits))
        kind = F.when(ranged, "range").when(loc.isNull(), "error").when(whole.isNotNull(), "single").otherwise("extracted")
        return F.struct(
            kind.alias("type"),
            loc.alias("start_location"),
            F.when(ranged, b).otherwise(loc).alias("end_location"),
            F.when(ranged, b - a + 1).alias("span"),
            F.when(ranged, (b - a + 1) * WORDS_PER_LOCATION).when(loc.isNotNull() & whole.isNotNull(), WORDS_PER_LOCATION).alias("estimated_words"),
            F.when(loc.isNotNull(), location_page(loc)).alias("estimated_page"),
            c.alias("original"),
            F.when(s == "", "empty location").when(broken, "a range needs two whole numbers").when(loc.isNull(), "no number in location").alias("error"),
        )

    return let(let(strip(F.coalesce(c, F.lit(""))), parse), shaped)


def normalize(c: Column | str) -> Column:
    """"a-b" or "a"; a text without a number is kept."""
    one = lambda f: F.when(f("type") == "range",
        F.concat_ws("-", f("start_location").cast("string"), f("end_location").cast("string"))).otherwise(f("start_location").cast("string"))
    return F.coalesce(let(decode(c), lambda d: one(d.getField)), _col(c))


def compare(a: Column | str, b: Column | str) -> Column:
    """struct<difference, first_is_earlier, pages_apart, error> of two location strings."""

    def shaped(v: Column) -> Column:
        x, y = v.getField("x"), v.getField("y")
        bad = x.isNull() | y.isNull()
        d = F.abs(x - y)
        return F.struct(d.alias("difference"), F.when(~bad, x < y).alias("first_is_earlier"), _floor_div(d, LOCATIONS_PER_PAGE).alias("pages_apart"),
            F.when(bad, "a location can't be read").alias("error"))

    return let(F.struct(decode(a).getField("start_location").alias("x"), decode(b).getField("start_location").alias("y")), shaped)


def percentage(loc: Column, total: Column) -> Column:
    """0 to 1, null where the total is unknown."""
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), loc / total)))


def reading_estimate(loc: Column, total: Column) -> Column:
    return F.struct(
        location_page(loc).alias("page"), (loc * WORDS_PER_LOCATION).alias("word_position"), percentage(loc, total).alias("percentage"),
        F.when(total > 0, F.greatest(F.lit(0), _floor_div(total - loc, LOCATIONS_PER_PAGE))).alias("pages_remaining"),
    )


def location_to_page(loc: Column, pages: Column, total: Column | None = None) -> Column:
    """struct<page, confidence>: a 0-based page of a document with ``pages`` pages; (0, 0.0) where it can't be told."""
    total = F.coalesce(total if total is not None else F.lit(None).cast("int"), pages * LOCATIONS_PER_PAGE)
    ok = (pages > 0) & (total > 0) & loc.isNotNull()
    page = F.least(pages - 1, F.greatest(F.lit(0), (loc / total * pages).cast("int")))
    return F.struct(F.when(ok, page).otherwise(0).alias("page"), F.when(ok, F.lit(0.7)).otherwise(0.0).alias("confidence"))


def page_to_location(page: Column, pages: Column, total: Column | None = None) -> Column:
    """struct<location, confidence> of a 0-based page; (0, 0.0) out of range."""
    total = F.coalesce(total if total is not None else F.lit(None).cast("int"), pages * LOCATIONS_PER_PAGE)
    ok = (page >= 0) & (page < pages)
    return F.struct(F.when(ok, (page / pages * total).cast("int")).otherwise(0).alias("location"), F.when(ok, F.lit(0.6)).otherwise(0.0).alias("confidence"))
