"""Sources and sinks as queries: the analog's rows are written in the format that an operator reads, and read from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import differences as diffs
from ..sources import readers, writers
from ..sources.shared import fresh_folder
from . import filters, spend, text
from .dialect import Dialect, Duck, checked
from .python_ops import _in_batches, spans
from .registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(df: DataFrame, name: str, line: Column | str) -> str:
    """Write one line for each row; returns the folder."""
    folder = fresh_folder(df.sparkSession, name)
    df.select((F.col(line) if isinstance(line, str) else line).alias("value")).write.text(folder)
    return folder


def _json(df: DataFrame, name: str) -> str:
    folder = fresh_folder(df.sparkSession, name)
    df.write.json(folder)
    return folder


def _rows(spark: SparkSession, sf_dir: str, statement: Callable[[Dialect], str]) -> DataFrame:
    return spark.sql(checked(statement(Dialect(sf_dir))))


def of(name: str, statement: Callable[[Dialect], str]) -> Callable:
    """Register a query whose rows must be the statement's, in DuckDB."""
    return query(name, checked(statement(Duck())))


@of("src_01", filters.episode_index)
def episode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each podcast's episodes as an array in a line of JSON."""
    e = _rows(spark, sf_dir, filters.episode_index).select(
        F.col("episode_key").cast("string").alias("episode_key"), F.col("podcast_id").cast("string").alias("podcast_id"), "published",
        F.create_map(F.lit("whisper"), F.struct(F.col("state"), F.col("published").alias("updated_at"))).alias("status"),
    )
    arrays = e.groupBy("podcast_id").agg(F.to_json(F.collect_list(F.struct(*e.columns))).alias("line"))
    got = readers.read_episodes(spark, _lines(arrays, "episodes", "line"), multi_line=False)
    return got.select(F.col("episode_key").cast("long").alias("episode_key"), F.col("podcast_id").cast("long").alias("podcast_id"), "published", "state")


@of("src_02", filters.keyed_reads)
def keyed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "labels")
    labels = _table(spark, sf_dir, "labels")
    labels.withColumn("shard", F.col("doc_id") % 16).write.partitionBy("shard").json(folder)
    got = readers.read_keyed_json(spark, f"{folder}/*", "doc_id long, quality int, toxic int", r"shard=(\d+)").withColumnRenamed("doc_id", "__id")
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(got, (docs["doc_id"] == got["__id"]) & (F.col("file_key") == F.col("__id") % 16), "left")
    return joined.select("doc_id", "quality", "toxic", F.col("__id").isNull().alias("absent"))


@of("src_03", spend.scan_ledgers)
def scan_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _rows(spark, sf_dir, lambda q: f"WITH {q.attempts()} SELECT * FROM attempts")
    amount = F.col("usd").cast("string")
    attempt = F.struct("state", "stage", F.col("third").alias("third_asr"), amount.alias("reserved_usd"), F.when(F.col("state") == "settled", amount).alias("settled_usd"))
    ledgers = a.groupBy("episode_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("attempt_id").cast("string"), attempt))).alias("attempts"))
    got = readers.read_ledgers(spark, _json(ledgers.withColumn("episode_key", F.col("episode_key").cast("string")), "ledgers"))
    return got.select(F.col("episode_key").cast("long").alias("episode_key"), F.col("attempt_id").cast("long").alias("attempt_id"), "state", "stage", F.col("third_asr").alias("third"), F.col("reserved_usd").cast("double").alias("usd"))


def _xml(df: DataFrame, name: str, row: str, root: str) -> str:
    folder = fresh_folder(df.sparkSession, name)
    df.write.format("xml").option("rowTag", row).option("rootTag", root).save(folder)
    return folder


@of("src_04", text.feed_entries)
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each page, its newest entry first."""
    p = _rows(spark, sf_dir, text.feed_entries)
    none, link = F.lit(None).cast("string"), F.concat(F.lit("https://feed.example/"), F.col("page_id").cast("string"))
    entry = lambda title, id_: F.struct(title.alias("title"), none.alias("guid"), id_.alias("id"), link.alias("link"))
    channel = F.struct(F.col("page_id").cast("string").alias("title"), F.array(entry(F.col("title"), F.col("guid")), entry(F.lit("older"), none)).alias("item"))
    got = readers.newest_entries(readers.read_feeds(spark, _xml(p.select(F.lit("2.0").alias("_version"), channel.alias("channel")), "feeds", "rss", "feeds")))
    return got.select(F.col("podcast").cast("long").alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), "guid")


def _captions(q: Dialect) -> str:
    """Turns as paragraphs of captions: words and signs, the signs put back to the word before them."""
    return f"""WITH w AS (SELECT conv_id, turn, {q.find_all("text", "[A-Za-z]+|[,.;:!?]")} AS ws FROM {q.t("conversations")})
        SELECT conv_id, CAST(turn AS DOUBLE) * 10 AS start_at, {q.size("ws")} AS words, {q.rr(q.join("ws"), " +([,.;:!?])", chr(92) + "1")} AS said FROM w WHERE {q.size("ws")} > 0"""


@of("src_05", _captions)
def caption_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TTML document for each conversation; words stand in spans inside a span of their phrase."""
    c = _table(spark, sf_dir, "conversations")
    span = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[,.;:!?]"), F.lit(0)), lambda w: F.concat(F.lit('<span podcasts:unit="word">'), w, F.lit("</span>")))
    begin = F.concat(F.floor(F.col("turn") / 6).cast("string"), F.lit(":"), (F.col("turn") % 6 * 10).cast("string"))
    p = F.concat(F.lit('<p begin="'), begin, F.lit('" ttm:agent="v1"><span podcasts:unit="sentence">'), F.array_join(span, ""), F.lit("</span></p>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", p.alias("p")))), lambda x: x["p"]), "")
    head = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata" xmlns:podcasts="urn:podcasts"><body><div>'
    documents = c.groupBy("conv_id").agg(body.alias("body")).select(F.concat(F.col("conv_id").cast("string"), F.lit("\t"), F.lit(head), F.col("body"), F.lit("</div></body></tt>")).alias("line"))
    got = readers.read_captions(spark, _lines(documents, "captions", "line"), whole=False)
    return got.select(F.col("key").cast("long").alias("conv_id"), F.col("begin").alias("start_at"), F.col("words").cast("long").alias("words"), F.col("text").alias("said"))


@of("src_06", filters.whole_texts)
def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a file of its own."""
    docs, folder = _table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_folder(spark, "texts")
    writers.write_files(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text"), folder).write.format("noop").mode("overwrite").save()
    got = readers.read_texts(spark, folder).select(F.col("key").cast("long").alias("__id"), F.length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    ids = docs.select("doc_id")
    return ids.join(got, ids["doc_id"] == got["__id"], "left").select("doc_id", "n", "digest")


@of("src_07", text.word_metadata)
def word_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long")
    number = lambda x: x.cast("string")
    word = F.struct(F.lit("w").alias("word"), F.when(k % 3 == 0, number(-F.col("value") / 100)).alias("logprob"), F.when(k % 5 == 0, "NaN").otherwise(number(F.col("value") / 500)).alias("probability"))
    segment = F.struct(F.when(k % 3 == 1, number(-F.col("value") / 200)).alias("avg_logprob"), F.array(word).alias("words"))
    got = readers.read_word_metadata(spark, _json(e.select(F.col("event_id").cast("string").alias("episode_key"), F.array(segment).alias("segments")), "segments"))
    return got.select(F.col("episode_key").cast("long").alias("event_id"), F.round("logprob", 6).alias("logprob"), "origin")


def _vocabulary(q: Dialect) -> str:
    """Parts as descriptors: the name, and brand and type as other forms, each once, none like the name."""
    forms = lambda a, b, c: f"CASE WHEN lower({b}) = lower({a}) THEN '' ELSE {b} END || '|' || CASE WHEN lower({c}) IN (lower({a}), lower({b})) THEN '' ELSE {c} END"
    return f"SELECT 'D' || CAST(p_partkey AS STRING) AS source_id, trim(p_name) AS canonical, {forms('trim(p_name)', 'trim(p_brand)', 'trim(p_type)')} AS aliases FROM {q.t('part')}"


@of("src_09", _vocabulary)
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    concept = lambda *forms: F.struct(F.struct(F.array(*[F.struct(f.alias("String")) for f in forms]).alias("Term")).alias("TermList"))
    concepts = F.array(concept(F.upper("p_name"), F.col("p_brand")), concept(F.concat(F.lit(" "), F.col("p_type"), F.lit("  ")), F.lower("p_brand")))
    records = p.select(F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("DescriptorUI"), F.struct(F.col("p_name").alias("String")).alias("DescriptorName"), F.struct(concepts.alias("Concept")).alias("ConceptList"))
    got = readers.read_mesh(spark, _xml(records, "mesh", "DescriptorRecord", "DescriptorRecordSet"))
    at = lambda c: F.coalesce(F.filter("aliases", lambda a: F.lower(a) == F.lower(F.trim(c)))[0], F.lit(""))
    named = got.join(p.select(F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("source_id"), "p_brand", "p_type"), "source_id")
    same = F.lower(F.trim("p_brand")) == F.lower(F.trim("p_type"))
    return named.select("source_id", "canonical", F.concat(at(F.col("p_brand")), F.lit("|"), F.when(same, "").otherwise(at(F.col("p_type")))).alias("aliases"))


@of("src_10", filters.lexicon)
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _table(spark, sf_dir, "part").agg(F.to_json(F.create_map(F.lit("exercise"), F.collect_set("p_name"), F.lit("unit"), F.collect_set("p_type"))).alias("line"))
    return readers.read_lexicon(spark, _lines(lists, "lexicon", "line"))


@of("src_11", filters.golden_cases)
def golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of provenance must not stand in two partitions."""
    d = _table(spark, sf_dir, "documents")
    cases, broken = readers.read_golden(spark, _json(d.select(F.col("doc_id").cast("string").alias("case_id"), F.col("source").alias("provenance_group"), F.col("lang").alias("partition")), "golden"))
    sums = cases.groupBy("provenance_group").agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("partition").alias("partitions"))
    leaks = broken.filter("rule = 'partition'").select(F.col("value").alias("__g"))
    joined = sums.join(leaks, sums["provenance_group"].eqNullSafe(leaks["__g"]), "left")
    return joined.select(F.col("provenance_group").alias("source"), "cases", "partitions", (F.col("__g").isNull() & (F.col("partitions") == 1)).alias("clean"))


def _note_heads(q: Dialect) -> str:
    return f"""SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || '.md' AS path, trim({q.find("text", "^[^.]*")}) AS title, CAST(2 AS BIGINT) AS n_keys, CAST(length(text) AS BIGINT) AS n_body FROM {q.t("conversations")} WHERE text IS NOT NULL AND turn % 4 <> 3"""


@of("src_13", _note_heads)
def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a leading block, and some without, which are left out."""
    c, folder = _table(spark, sf_dir, "conversations").filter("text IS NOT NULL"), fresh_folder(spark, "notes")
    name = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".md"))
    block = F.concat(F.lit('---\ntitle: "'), F.trim(F.regexp_extract("text", "^[^.]*", 0)), F.lit('"\nepisode: '), F.col("conv_id").cast("string"), F.lit("\n---\n"))
    writers.write_files(c.select(name.alias("name"), F.concat(F.when(F.col("turn") % 4 != 3, block).otherwise(F.lit("")), "text").alias("text")), folder).write.format("noop").mode("overwrite").save()
    got = readers.read_notes(spark, folder)
    return got.select("path", F.coalesce("title", F.lit("")).alias("title"), F.size("keys").cast("long").alias("n_keys"), F.length("body").cast("long").alias("n_body"))


@of("src_14", filters.bibliography)
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    item = F.struct(F.array("p_name").alias("title"), F.col("p_size").cast("double").alias("score"))
    second = F.when(F.col("p_size") > 25, F.array(F.struct(F.col("p_name").alias("title")))).otherwise(F.array().cast("array<struct<title:string>>"))
    got = readers.read_bibliography(spark, _json(p.select(F.col("p_partkey").alias("id"), F.struct(F.array(item).alias("items")).alias("message"), second.alias("results")), "payloads"))
    return got.select(F.col("id").alias("p_partkey"), "title", "score", "provider")


@of("snk_02", filters.changed_only)
def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose bytes differ from what is stored are written; what was written is read again."""
    docs, folder = _table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_folder(spark, "changed")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    stored = docs.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(digest).alias("digest"))
    writers.changed_only(docs, stored, "doc_id").write.json(folder)
    got = spark.read.schema("doc_id long, text string, digest string").json(folder)
    return got.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))


@query("snk_03")
def compiler_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report of at most 100 differences, and all of them as JSON, written and read again."""
    def report(r) -> list[tuple]:
        found = [{"kind": d.kind, "severity": d.severity, "category": d.category, "apple": d.apple_text, "whisper": d.whisper_text} for d in diffs.differences(r.apple, r.whisper)]
        return [(r.episode_key, r.id, r.part, found)]

    item = "struct<kind: string, severity: string, category: string, apple: string, whisper: string>"
    made = _in_batches(spans(spark, sf_dir), f"episode_key long, id long, part long, differences array<{item}>", lambda: report)
    folder = fresh_folder(spark, "reports")
    cells = F.transform(F.slice("differences", 1, 100), lambda d, k: F.array((k + 1).cast("string"), d["kind"], d["severity"], d["apple"], d["whisper"]))
    made.withColumn("report", writers.markdown_table("Differences", ["#", "kind", "severity", "apple", "whisper"], cells)).write.json(folder)
    got = spark.read.schema(f"episode_key long, id long, part long, differences array<{item}>, report string").json(folder)
    return got.select("episode_key", "id", "part", F.size("differences").cast("long").alias("n"), "report")


@of("snk_04", spend.report_columns)
def report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spend report as CSV with its fixed columns, read again."""
    rows, folder = _rows(spark, sf_dir, spend.report_columns), fresh_folder(spark, "spend")
    rows.write.option("header", "true").csv(folder)
    return spark.read.schema(rows.schema).option("header", "true").csv(folder)


def _telemetry(q: Dialect) -> str:
    return f"WITH {q.cards()}, c AS (SELECT kind, severity, count(*) AS n FROM cards GROUP BY kind, severity) SELECT '| ' || kind || ' | ' || severity || ' | ' || CAST(n AS STRING) || ' |' AS line FROM c"


@of("snk_05", _telemetry)
def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry report's table as Markdown, written and read again, without its head."""
    folder = fresh_folder(spark, "telemetry")
    counts = _rows(spark, sf_dir, lambda q: f"WITH {q.cards()} SELECT kind, severity, CAST(count(*) AS STRING) AS n FROM cards GROUP BY kind, severity")
    counts.agg(writers.markdown_table("Telemetry", ["kind", "severity", "n"], F.sort_array(F.collect_list(F.array("kind", "severity", "n")))).alias("value")).write.text(folder)
    return spark.read.text(folder).filter("value LIKE '| %' AND value NOT LIKE '| kind |%'").select(F.col("value").alias("line"))


def _notes(q: Dialect) -> str:
    head = "'---' || chr(10) || 'title: \"Turn ' || CAST(turn AS STRING) || '\"' || chr(10) || '---' || chr(10) || chr(10) || '# Turn ' || CAST(turn AS STRING) || chr(10) || chr(10) || '## Said' || chr(10) || chr(10)"
    return f"SELECT conv_id AS episode_key, turn AS id, {q.sha(f"{head} || '- ' || replace(coalesce(text, ''), '. ', '.' || chr(10) || '- ') || chr(10)")} AS digest FROM {q.t('conversations')}"


@of("snk_06", _notes)
def rendered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file for each turn, read again."""
    c, folder = _table(spark, sf_dir, "conversations"), fresh_folder(spark, "rendered")
    n = F.col("turn").cast("string")
    body = F.concat(F.lit('---\ntitle: "Turn '), n, F.lit('"\n---\n\n# Turn '), n, F.lit("\n\n## Said\n\n- "), F.array_join(F.split(F.coalesce("text", F.lit("")), r"(?<=\.) "), "\n- "), F.lit("\n"))
    writers.write_files(c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), n, F.lit(".txt")).alias("name"), body.alias("text")), folder).write.format("noop").mode("overwrite").save()
    got = readers.read_texts(spark, folder)
    key = F.split("key", "-")
    return got.select(key[0].cast("long").alias("episode_key"), key[1].cast("long").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@of("snk_07", filters.vault_export)
def vault_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported notes and their receipts: confirmations that are on record already change nothing."""
    rows, folder = _rows(spark, sf_dir, filters.vault_export), fresh_folder(spark, "receipts")
    confirmed = rows.select("o_orderkey", "digest", F.lit("2026-01-02").alias("confirmed_at"))
    before = confirmed.filter("o_orderkey % 2 = 0").withColumn("digest", F.when(F.col("o_orderkey") % 4 == 0, "old").otherwise(F.col("digest"))).withColumn("confirmed_at", F.lit("2026-01-01"))
    writers.record_receipts(before, confirmed, "o_orderkey").write.json(folder)
    receipts = spark.read.schema("o_orderkey long, digest string, confirmed_at string").json(folder)
    return rows.select("o_orderkey", "file_name").join(receipts, "o_orderkey").select("o_orderkey", "file_name", "digest")


def _events(q: Dialect) -> str:
    payload = q._("to_json(named_struct('event', 'review_ready', 'severity', 'INFO', 'words', n))", "CAST(to_json({'event': 'review_ready', 'severity': 'INFO', 'words': n}) AS VARCHAR)")
    return f"SELECT episode_key, id, {payload} AS payload FROM (SELECT conv_id AS episode_key, turn AS id, {q.size(q.words('coalesce(text, chr(32))'))} AS n FROM {q.t('conversations')}) t"


@of("snk_08", _events)
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, read again."""
    folder = fresh_folder(spark, "events")
    _rows(spark, sf_dir, _events).write.json(folder)
    return spark.read.schema("episode_key long, id long, payload string").json(folder)
