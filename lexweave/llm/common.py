"""What the operators share: reading tables, the shared folder, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that a Python worker gets: what bounds its memory.
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20
#: What this Python worker has loaded for the operator it works for.
_LOADED: dict[Hashable, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. One of our own only where it is unset and all tasks run in
    the driver's process, as in tests; on a cluster an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, group_bytes: int = 128 << 20) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut and survives lost executors. A reader holds a column
    of a row group of ``group_bytes`` at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", group_bytes).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches small enough that a batch of long texts fits a worker's memory. The setting belongs to the session, as Spark reads it
    when a query runs; smaller ones that the user has set stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def loaded(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, which a worker keeps for later tasks with this key; what was loaded with another key goes first."""
    _keep_only(key)
    if key not in _LOADED:
        _LOADED[key] = make()
        _give_back()
    return _LOADED[key]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: Hashable = None):
    """``run`` for mapInArrow. Workers outlive a task and count as the executor's memory also while only its JVM works: so what was loaded
    with another key goes before the first batch, and what the task freed goes back to the system after the last."""

    def run_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_only(key)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return run_lean


def _keep_only(key: Hashable) -> None:
    for other in [k for k in _LOADED if k != key]:
        del _LOADED[other]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    # glibc keeps what numpy and Python free; other C libraries have no such function
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
