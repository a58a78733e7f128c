"""Sampled splitters: size-weighted key samples give the boundaries of ranges of about equal cost."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key samples drawn for each range; ranges are planned for so many rows, between the two bounds. What the driver gathers is
#: SAMPLES_PER_RANGE * MOST_RANGES keys at most (expected), whatever the input's size.
SAMPLES_PER_RANGE, ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 20, 500, 1_024, 32_768
#: A range of more than so many times the mean cost is subdivided, in so many rounds at most.
OVERFULL, ROUNDS = 2.5, 3


def _order(key: tuple) -> tuple:
    """Spark's order in Python: nulls first, strings by their UTF-8 bytes."""
    return tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in key)


def _literal(key: list[str], schema: T.StructType, splitters: list[tuple]) -> Column:
    fields = T.StructType([T.StructField(c, schema[c].dataType) for c in key])
    return F.from_json(F.lit(json.dumps([dict(zip(key, s, strict=True)) for s in splitters])), T.ArrayType(fields))


def range_of(key: list[str], schema: T.StructType, splitters: list[tuple]) -> Column:
    """How many splitters are at or below the row's key: a binary search inside one expression, without a join."""
    if not splitters:
        return F.lit(0)
    known = _literal(key, schema, splitters)
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    own = F.struct(*[F.col(c) for c in key])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(F.try_element_at(known, low + step) <= own, low + step).otherwise(low),
    )


def cut_by_splitter(key: list[str], schema: T.StructType, splitters: list[tuple]) -> Column:
    """Whether a splitter agrees with the row in these first columns of its key, so that rows equal in them may lie in several ranges."""
    found = sorted({s[: len(key)] for s in splitters}, key=_order)
    if not found:
        return F.lit(False)
    own = F.struct(*[F.col(c) for c in key])
    at = range_of(key, schema, found)
    return F.coalesce(F.when(at > 0, F.try_element_at(_literal(key, schema, found), at).eqNullSafe(own)), F.lit(False))


def plan_ranges(keyed: DataFrame, key: list[str], cost: str, seed: int = 11) -> list[tuple]:
    """Splitters for ``keyed``: its columns ``key`` and the positive column ``cost``.

    Empty input gives no splitter. Rows whose whole key is equal stay in one range, as no boundary can part them.
    """
    n, total = keyed.agg(F.count(F.lit(1)), F.sum(cost)).first()
    if not n:
        return []
    ranges = max(LEAST_RANGES, min(MOST_RANGES, n // ROWS_PER_RANGE))

    def drawn(rows: DataFrame, rate: float, round_: int) -> list[tuple]:
        hit = rows.filter(F.rand(seed + round_) < F.col(cost) * F.lit(rate)).select(*key)
        return sorted((tuple(r) for r in hit.collect()), key=_order)

    def boundaries(sample: list[tuple], parts: int) -> list[tuple]:
        return [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []

    def distinct(found: list[tuple]) -> list[tuple]:
        return sorted(set(found), key=_order)

    found = distinct(boundaries(drawn(keyed, SAMPLES_PER_RANGE * ranges / total, 0), ranges))
    for round_ in range(1, ROUNDS + 1):
        placed = keyed.withColumn("__rng", range_of(key, keyed.schema, found))
        over = placed.groupBy("__rng").agg(F.sum(cost).alias("c"), F.count(F.lit(1)).alias("n")).filter((F.col("c") > OVERFULL * total / ranges) & (F.col("n") > 1)).collect()
        if not over or len(found) >= 2 * MOST_RANGES:
            break
        inside = placed.filter(F.col("__rng").isin([r["__rng"] for r in over]))
        more = drawn(inside, SAMPLES_PER_RANGE * ranges / total, round_)
        parts = max(2, round(2 * sum(r["c"] for r in over) * ranges / total))
        grown = distinct(found + boundaries(more, parts))
        if len(grown) == len(found):
            break
        found = grown
    return found
