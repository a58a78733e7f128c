"""Joins on intervals, through buckets, so that no pair outside them is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookback_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, reach: int) -> DataFrame:
    """Rows of ``right`` (columns prefixed ``earlier_``) at most ``reach`` before a row of ``left`` and not at its time.

    Both sides carry a bucket of ``reach`` units of the whole number ``at``; a left row asks for its own and the one before, so
    each pair meets once. The rest is an equi-join, which adaptive execution can split where a key is hot.
    """
    bucket = F.floor(F.col(at) / reach)
    asked = left.withColumn("__b", F.explode(F.array(bucket, bucket - 1)))
    there = right.select(*[F.col(c).alias(f"earlier_{c}") for c in right.columns], bucket.alias("earlier___b"))
    on = [asked[k] == there[f"earlier_{k}"] for k in keys] + [asked["__b"] == there["earlier___b"], there[f"earlier_{at}"] < asked[at], there[f"earlier_{at}"] >= asked[at] - reach]
    return asked.join(there, on).drop("__b", "earlier___b")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals [start, end) of equal keys that overlap; ``right``'s columns prefixed ``other_``.

    Each interval is laid into the buckets of ``width`` that it meets; of the buckets that two share, only the one in which the
    later of the two begins counts.
    """

    def laid(df: DataFrame) -> DataFrame:
        return df.filter("end > start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))

    a, b = laid(left), laid(right)
    b = b.select(*[F.col(c).alias(f"other_{c}") for c in b.columns])
    on = [a[k] == b[f"other_{k}"] for k in keys] + [a["__b"] == b["other___b"], a["start"] < b["other_end"], a["end"] > b["other_start"]]
    met = a.join(b, on).filter(F.col("__b") == F.floor(F.greatest("start", "other_start") / width))
    return met.drop("__b", "other___b")
