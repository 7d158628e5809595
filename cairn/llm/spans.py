"""Spans of regular expressions in column expressions, in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import prefix

SPAN = "array<struct<start:int,end:int,match:string>>"


def _empty() -> Column:
    return F.array().cast(SPAN)


def find_spans(df: DataFrame, out: str, text: str, pattern: str, gate: Column | None = None) -> DataFrame:
    """Add column ``out``: (start, end, match) of the leftmost non-overlapping matches.

    ``pattern`` must not match the empty string.  The matches and the pieces between
    them come from two scans by the same engine; their lengths, summed up, place each
    match.  The second scan is for texts with a match alone, and ``gate`` (cheap, true
    wherever a match can be) spares texts the first.  ``text`` must not be null.
    """
    gate = F.lit(True) if gate is None else gate
    p = prefix(df)
    matches, pieces, steps = f"{p}m", f"{p}p", f"{p}s"
    df = df.withColumn(matches, F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn(pieces, F.when(F.size(matches) > 0, F.split(text, pattern, -1)))
    df = df.withColumn(steps, F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m)))
    spans = F.zip_with(running_sums(steps), matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))
    return df.withColumn(out, F.when(F.size(matches) > 0, spans).otherwise(_empty())).drop(matches, pieces, steps)


#: Items that are summed up one by one; longer arrays go by blocks of so many.
_BLOCK = 64


def running_sums(steps: str) -> Column:
    """Sums up to each item of a column of int arrays (not an expression: lambdas would evaluate it anew).

    An array grows by copying, so sums are taken by blocks, each from the total of those
    before it: n items copy about n^2 / 64 numbers, not n^2.
    """
    items = F.col(steps)

    def sums(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(
            F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(at) + x)))

    def step(acc: Column, first: Column) -> Column:
        part = F.slice(items, first, F.lit(_BLOCK))
        return F.struct(F.aggregate(part, acc["at"], lambda a, x: a + x).alias("at"), F.concat(acc["sums"], F.array(sums(part, acc["at"]))).alias("sums"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("sums"))
    firsts = F.sequence(F.lit(1), F.size(items), F.lit(_BLOCK))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(firsts, start, step)["sums"])).otherwise(F.array().cast("array<int>"))


def tagged(spans: Column, kind: str, rank: int, rank_first: bool) -> Column:
    """Spans as sortable structs with their kind, by rank or by start first."""

    def one(s: Column) -> Column:
        place = [s["start"].alias("start"), F.lit(rank).alias("rank")]
        return F.struct(*(place[::-1] if rank_first else place), s["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.transform(spans, one)


def written(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged(spans: Column) -> Column:
    """Union of spans as disjoint ascending (start, end)."""
    kind = "array<struct<start:int,end:int>>"
    plain = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(plain, F.array().cast(kind), step)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every disjoint ascending span replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.lit(mark)).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
