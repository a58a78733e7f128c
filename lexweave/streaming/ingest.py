"""Streams: ingestion that is safe to repeat, and the reservation ledger as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ledger
from ..sources.shared import fresh_folder


def ingest(spark: SparkSession, path: str, schema: T.StructType, key: str, valid: str, target: str | None = None, glob: str = "*") -> DataFrame:
    """Take the files under ``path`` into a keyed table once each: rows that ``valid`` accepts and whose key is new are appended.

    Keys that were taken are the stream's state, so no batch reads the table again. Offsets and state stand beside the target: a file
    seen again, a batch that runs again, a repeated key and a second call change nothing. Rows with a null key count as one key. One
    stream at a time may write to a target; the checkpoint's log makes a second one fail. Returns the table.
    """
    target = target or fresh_folder(spark, "ingest")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    taken = stream.filter(valid).dropDuplicates([key])
    taken.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", f"{target.rstrip('/')}-offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target)


_ATTEMPT = T.StructType([T.StructField("usd", T.StringType()), T.StructField("reserved", T.StringType()), T.StructField("third", T.BooleanType()), T.StructField("state", T.StringType())])
_STATE = T.StructType([T.StructField("attempts", T.MapType(T.StringType(), _ATTEMPT)), T.StructField("total", T.StringType()), T.StructField("third", T.StringType()), T.StructField("locked", T.BooleanType())])
_OUT = "episode_key long, attempt_id long, outcome string, committed string"


def admit(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The batch fold of a ledger, over what has arrived, on state that is kept between batches. A request without an amount closes the
    ledger: its outcome is ``closed``, and its state is dropped."""
    book = ledger.new_state()
    if state.exists:
        attempts, total, third, locked = state.get
        book |= {"attempts": {k: {"usd": Decimal(a[0]), "reserved": Decimal(a[1]), "third": a[2], "state": a[3]} for k, a in attempts.items()}, "total": Decimal(total), "third": Decimal(third), "locked": locked}
    out = []
    closed = False
    for r in pd.concat(list(frames)).sort_values("attempt_id").itertuples():
        closed = pd.isna(r.usd)
        if closed:
            out.append((key[0], r.attempt_id, "closed", str(ledger.committed(book))))
            book = ledger.new_state()
            continue
        got = ledger.reserve(book, [(str(r.attempt_id), Decimal(r.usd), False)], Decimal(0), ledger.CAP * 1000)
        out.append((key[0], r.attempt_id, got, str(ledger.committed(book))))
    if closed:
        state.remove()
    else:
        state.update(({k: (str(a["usd"]), str(a["reserved"]), a["third"], a["state"]) for k, a in book["attempts"].items()}, str(book["total"]), str(book["third"]), book["locked"]))
    yield pd.DataFrame(out, columns=["episode_key", "attempt_id", "outcome", "committed"])


def admission_stream(requests: DataFrame) -> DataFrame:
    """A stream of requests (episode_key, attempt_id, usd as text) as a stream of outcomes. A key's state is what its ledger admitted, until a
    request without an amount closes it."""
    return requests.groupBy("episode_key").applyInPandasWithState(admit, _OUT, _STATE, "append", "NoTimeout")


def first_notices(events: DataFrame, delay: str = "10 days") -> DataFrame:
    """One late notice for a key within the watermark; times must be timestamps with a zone, as watermarks ask for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["episode_key"])
