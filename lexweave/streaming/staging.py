"""Files that arrive in a staging folder: checked, copied, entered into the index, and removed from staging in this order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import insert_absent
from ..sources.writers import write_files

INDEX = "episode_key string, digest string, bytes long"


def staged(spark: SparkSession, staging: str) -> DataFrame:
    """(path, episode_key, text, valid) of the staged JSON files; valid if a file's name is the key that it states and it has a text."""
    files = spark.read.schema("episode_key string, text string").option("multiLine", "true").option("pathGlobFilter", "*.json").json(staging)
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    valid = name.eqNullSafe(F.col("episode_key")) & F.coalesce(F.length("text") > 0, F.lit(False))
    return files.select(F.col("_metadata.file_path").alias("path"), "episode_key", "text").withColumn("valid", valid)


def take_staged(spark: SparkSession, staging: str, target: str, index: str) -> DataFrame:
    """Take what is staged into ``target`` (a file for each key) and ``index`` (a Parquet table of keys); returns what was refused.

    Copies are named by key and the index takes a key once, so a run that breaks off is repeated without harm: staging is cleared last, and
    only of what the index then has. Refused files stay. A key that is in the index already keeps its entry; its staged file goes.
    """
    rows = staged(spark, staging)
    spark.createDataFrame([], INDEX).write.mode("append").parquet(index)
    good = rows.filter("valid")
    write_files(good.select(F.concat(F.col("episode_key"), F.lit(".txt")).alias("name"), "text").join(_keys(spark, index), F.regexp_replace("name", r"\.txt$", "") == F.col("__key"), "left_anti"), target).write.format("noop").mode("overwrite").save()
    entries = good.select("episode_key", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    insert_absent(spark.read.schema(INDEX).parquet(index), entries, ["episode_key"]).write.mode("append").parquet(index)
    _remove(good.join(_keys(spark, index), F.col("episode_key") == F.col("__key"), "left_semi").select("path"))
    return staged(spark, staging).filter("NOT valid").select("path", "episode_key")


def _keys(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(index).select(F.col("episode_key").alias("__key"))


def _remove(paths: DataFrame) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                if fs.get_file_info(at).type != pafs.FileType.NotFound:
                    fs.delete_file(at)
            yield batch

    paths.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
