"""Compare-and-set upserts as joins: a write counts only against the generation that its writer has read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cas_upsert(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New state and refused updates. ``current``: key, generation, value. ``updates``: key, expected, at, value.

    ``expected`` is the generation read, null for a key that must not exist yet. Of several updates of a key the first by ``at``, of
    equal ones by expected generation and value, counts; the others have read a generation that is gone then. Rows that nothing changes
    keep their generation.
    """
    order = Window.partitionBy("key").orderBy("at", "expected", "value")
    first = updates.withColumn("__n", F.row_number().over(order))
    met = first.join(current.select(F.col("key").alias("__k"), "generation"), first["key"] == F.col("__k"), "left")
    fits = (F.col("__n") == 1) & F.col("expected").eqNullSafe(F.col("generation"))
    applied = met.filter(fits).select("key", (F.coalesce("generation", F.lit(0)) + 1).alias("generation"), "value")
    refused = met.filter(~fits).select("key", "expected", "at", "value")
    return current.join(applied.select("key"), "key", "left_anti").unionByName(applied), refused


def insert_absent(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh`` whose key is new, one of each key; safe to apply twice. A null in a key equals a null."""
    known = current.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    found = fresh.dropDuplicates(keys)
    return found.join(known, [found[k].eqNullSafe(known[f"__{k}"]) for k in keys], "left_anti")
