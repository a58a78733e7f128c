"""Files from DataFrames. Writers go through Spark's committers, or write one object for each row under a name that the row decides, so
that a task that runs again writes the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_cell(x: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " ")


def markdown_table(title: str, head: list[str], cells: Column) -> Column:
    """A Markdown report: a title and a table whose rows are an array of arrays of cells."""
    line = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    body = F.transform(cells, lambda row: line(F.transform(row, table_cell)))
    fixed = [f"# {title}", "", f"| {' | '.join(head)} |", f"|{'---|' * len(head)}"]
    return F.concat(F.lit("\n".join(fixed) + "\n"), F.array_join(body, "\n"), F.lit("\n"))


def write_files(rows: DataFrame, folder: str, name: str = "name", text: str = "text") -> DataFrame:
    """Write each row's text to a file of its name in ``folder``; a null text writes nothing. Returns (name, bytes), whose evaluation writes.

    Names are the rows' own, so a repeated row or task overwrites a file with the same content. The path must be one that pyarrow opens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None:
                    continue
                raw = content.encode("utf-8")
                with fs.open_output_stream(f"{root}/{file}") as out:
                    out.write(raw)
                names.append(file)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text")).mapInArrow(run, "name string, bytes long")


def changed_only(fresh: DataFrame, stored: DataFrame, key: str, content: str = "text") -> DataFrame:
    """Rows whose content isn't stored under their key yet, by digest. ``stored``: key, digest."""
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256)
    rows = fresh.withColumn("digest", digest)
    known = stored.select(F.col(key).alias("__key"), F.col("digest").alias("__digest"))
    return rows.join(known, rows[key].eqNullSafe(known["__key"]) & (rows["digest"] == known["__digest"]), "left_anti")


def record_receipts(receipts: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """Receipts (key, digest, confirmed_at) after confirmations of the same shape: the newest digest of a key counts; one that is already
    on record leaves its receipt as it is."""
    newest = confirmed.groupBy(key).agg(F.max_by(F.struct("digest", "confirmed_at"), F.struct("confirmed_at", "digest")).alias("n")).select(key, "n.digest", "n.confirmed_at")
    old = receipts.select(F.col(key).alias("__key"), F.col("digest").alias("__digest"))
    fresh = newest.join(old, newest[key].eqNullSafe(old["__key"]) & (newest["digest"] == old["__digest"]), "left_anti")
    gone = fresh.select(F.col(key).alias("__key"))
    return receipts.join(gone, receipts[key].eqNullSafe(gone["__key"]), "left_anti").unionByName(fresh)
