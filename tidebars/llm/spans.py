"""Places of regex matches as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,t:string>>"


def matches(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern that never matches the empty string: code points s (start), e (end) and
    the matched text t. needs: a cheap condition without which there is no match.

    The pieces between the matches give the places: each match starts where the lengths of all before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(pieces, found, lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        e = s + F.coalesce(F.char_length(x["t"]), F.lit(0))
        span = F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"))
        return F.struct(e.alias("at"), F.when(x["t"].isNull(), a["out"]).otherwise(F.array_append(a["out"], span)).alias("out"))

    got = F.aggregate(pairs, start, add, lambda a: a["out"])
    return got if needs is None else F.when(needs, got).otherwise(F.array().cast(SPAN))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


def named(kind: str, spans: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))
