"""Writes under concurrency, bounded work, and streams, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import cas_upsert
from .dialect import Dialect, sql
from .registry import query


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    current = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 3 + 1).alias("generation"), F.col("o_orderstatus").alias("value"))
    asked = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3 + F.col("o_orderkey") % 5).alias("expected"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), F.lit("new").alias("value"))
    return current, asked


@query(
    "snk_01",
    """WITH c AS (SELECT o_orderkey AS key, o_orderkey % 3 + 1 AS generation, o_orderstatus AS value FROM orders WHERE o_orderkey % 4 <> 0),
        u AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 + o_orderkey % 5 END AS expected FROM orders WHERE o_orderkey % 2 = 0),
        a AS (SELECT u.key, coalesce(c.generation, 0) + 1 AS generation, 'new' AS value FROM u LEFT JOIN c ON c.key = u.key WHERE u.expected IS NOT DISTINCT FROM c.generation)
        SELECT key, generation, value FROM c WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT key, generation, value FROM a""",
)
def index_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas_upsert(*_index(spark, sf_dir))[0]


@query(
    "sm_06",
    """WITH c AS (SELECT o_orderkey AS key, o_orderkey % 3 + 1 AS generation FROM orders WHERE o_orderkey % 4 <> 0),
        u AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 + o_orderkey % 5 END AS expected, seq FROM orders, (VALUES (1), (2)) t(seq) WHERE o_orderkey % 2 = 0)
        SELECT u.key, u.seq FROM u LEFT JOIN c ON c.key = u.key WHERE u.seq = 2 OR u.expected IS DISTINCT FROM c.generation""",
)
def refused_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas_upsert(*_index(spark, sf_dir))[1].select("key", F.col("at").alias("seq"))


@sql("sm_08")
def bounded_work(q: Dialect) -> str:
    """Work in order until five failures stand in a row; what comes after isn't tried. Failed items before that get one more try."""
    return f"""WITH e AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {q.t("events")}), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM e),
        r AS (SELECT *, count(CASE WHEN failed THEN 1 END) OVER (PARTITION BY user_id, run ORDER BY rn ROWS UNBOUNDED PRECEDING) AS in_row FROM g), stop AS (SELECT user_id, min(CASE WHEN in_row >= 5 THEN rn END) AS stop_at FROM r GROUP BY user_id)
        SELECT r.user_id, r.event_id, s.stop_at IS NULL OR r.rn <= s.stop_at AS tried, r.failed AND (s.stop_at IS NULL OR r.rn <= s.stop_at) AS retried FROM r JOIN stop s ON s.user_id = r.user_id"""


@query("src_12", "SELECT DISTINCT doc_id, lang, n_chars FROM documents WHERE text IS NOT NULL")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken in through a stream that is safe to repeat; without a shared folder for its offsets, by the same rule in one batch."""
    from ..operators.upsert import insert_absent
    from ..streaming.ingest import ingest

    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path)
    found = docs.select("_metadata.file_path").first()
    if found and spark.conf.get("spark.checkpoint.dir", None):
        # a stream reads folders: of a table in one file, the folder that holds it, with all other files left out
        one_file = found[0].endswith("/documents.parquet")
        glob = "documents.parquet" if one_file else "*"
        return ingest(spark, sf_dir if one_file else path, docs.schema, "doc_id", "text IS NOT NULL", glob=glob).select("doc_id", "lang", "n_chars")
    return insert_absent(docs.limit(0), docs.filter("text IS NOT NULL"), ["doc_id"]).select("doc_id", "lang", "n_chars")
