"""Files as DataFrames. Every reader takes a path or a glob, scans it once, and leaves parsing to Spark where Spark has a parser."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODE = "episode_key string, podcast string, podcast_id string, feed_url string, title string, published string, status map<string, struct<state: string, updated_at: string>>"
LEDGER = "episode_key string, source_fingerprint string, attempts map<string, struct<state: string, stage: string, third_asr: boolean, reserved_usd: string, settled_usd: string>>"
SEGMENTS = (
    "episode_key string, segments array<struct<start: string, end: string, avg_logprob: string, no_speech_prob: string, "
    "words: array<struct<word: string, start: string, end: string, avg_logprob: string, logprob: string, probability: string>>>>"
)
#: A probability below this counts as this.
LEAST_PROBABILITY = 1e-12


def clean(text: Column) -> Column:
    """White space as single spaces, none around; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def folded(text: Column) -> Column:
    return F.lower(clean(text))


def read_episodes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The episode index: one JSON array in a file, or with ``multi_line=False`` an array in a line. Missing states are ``pending``."""
    rows = spark.read.schema(EPISODE).option("multiLine", multi_line).json(path)
    return rows.withColumn("state", F.coalesce(F.col("status")["whisper"]["state"], F.lit("pending")))


def read_keyed_json(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Objects of many episodes in one scan; ``key`` is a regular expression whose first group finds the key in a file's path. A key
    without a file has no row: join from the left."""
    return spark.read.schema(schema).json(path).select(F.regexp_extract("_metadata.file_path", key, 1).alias("file_key"), "*")


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each attempt of each ledger; amounts, which the files hold as strings, as decimals."""
    rows = spark.read.schema(LEDGER).json(path).select("episode_key", "source_fingerprint", F.explode("attempts").alias("attempt_id", "a"))
    usd = {c: F.col(f"a.{c}").try_cast("decimal(18,6)").alias(c) for c in ("reserved_usd", "settled_usd")}
    return rows.select("episode_key", "source_fingerprint", "attempt_id", "a.state", "a.stage", "a.third_asr", *usd.values())


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS feeds, their place in the feed from 0, and their identity: guid, id, link or title, the first that is there."""
    item = "struct<guid: string, id: string, link: string, title: string, pubDate: string, description: string, enclosure: struct<_url: string>>"
    channel = f"channel struct<title: string, item: array<{item}>>"
    feeds = spark.read.format("xml").schema(channel).option("rowTag", "rss").option("ignoreSurroundingSpaces", "false").load(path)
    entries = feeds.select(F.col("channel.title").alias("podcast"), F.posexplode("channel.item").alias("place", "e"))
    text = lambda c: F.nullif(F.trim(F.col(f"e.{c}")), F.lit(""))
    return entries.select("podcast", "place", F.coalesce(*map(text, ("guid", "id", "link", "title"))).alias("guid"), F.col("e.title").alias("title"), F.col("e.link").alias("link"), F.col("e.pubDate").alias("published"), F.col("e.enclosure._url").alias("audio_url"))


def newest_entries(entries: DataFrame) -> DataFrame:
    """A feed's first entry is its newest."""
    return entries.filter("place = 0").drop("place")


def clock(text: str | None) -> float | None:
    """Seconds of "12.5", "1:02", "1:02:03.4" and "12.5s"; null if it is none of these."""
    try:
        parts = [float(p) for p in (text or "").strip().removesuffix("s").split(":")]
    except ValueError:
        return None
    return sum(p * 60**i for i, p in enumerate(reversed(parts))) if len(parts) <= 3 else None


def captions(document: str) -> list[tuple[int, str, float | None, float | None, str | None, int]]:
    """(place, text, begin, end, speaker, words) of a TTML document's paragraphs. Words are spans of unit "word", at any depth; signs go
    to the word before them. Paragraphs without words count for nothing."""
    local = lambda name: name.rpartition("}")[2]
    root = ElementTree.fromstring(document)
    if local(root.tag) != "tt":
        raise ValueError("the root element is not tt")
    out = []
    for p in (e for e in root.iter() if local(e.tag) == "p"):
        marks = {local(k): v for k, v in p.attrib.items()}
        found = [(s.text or "").strip() for s in p.iter() if local(s.tag) == "span" and any(local(k) == "unit" and v == "word" for k, v in s.attrib.items())]
        found = [w for w in found if w]
        text = ""
        for w in found:
            text += w if not text or w[0] in ",.;:!?" else f" {w}"
        if text:
            out.append((len(out), text, clock(marks.get("begin")), clock(marks.get("end")), marks.get("agent") or None, len(found)))
    return out


def read_captions(spark: SparkSession, path: str, whole: bool = True, key: str = r"([^/]+)$") -> DataFrame:
    """Paragraphs of TTML files, the key found in a file's path; ``whole=False``: a key, a tab and a document in each line."""
    files = spark.read.text(path, wholetext=whole)
    if whole:
        files = files.select(F.regexp_extract("_metadata.file_path", key, 1).alias("key"), "value")
    else:
        files = files.select(F.regexp_extract("value", r"^([^\t]*)\t", 1).alias("key"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *c) for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True) for c in captions(v)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names=["key", "paragraph", "text", "begin", "end", "speaker", "words"])

    return files.mapInArrow(run, "key string, paragraph int, text string, begin double, end double, speaker string, words int")


def read_texts(spark: SparkSession, path: str, key: str = r"([^/]+)\.txt$") -> DataFrame:
    """(key, text) of whole UTF-8 files, a byte order mark left out; the key is found in a file's path."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_path", key, 1).alias("key"), F.regexp_replace("value", "^﻿", "").alias("text"))


def read_word_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Words of segments. Log-probability: the word's, else the segment's, else that of the word's probability. Times and speech: the
    word's, else the segment's. What isn't a finite number is null."""
    rows = spark.read.schema(SEGMENTS).json(path).select("episode_key", F.posexplode("segments").alias("segment", "s")).select("episode_key", "segment", "s", F.posexplode("s.words").alias("place", "w"))

    def number(name: str) -> Column:
        x = F.col(name).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    p = number("w.probability")
    logged = {"word": F.coalesce(number("w.avg_logprob"), number("w.logprob")), "segment": number("s.avg_logprob"), "probability": F.when(p.isNotNull(), F.ln(F.greatest(p, F.lit(LEAST_PROBABILITY))))}
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in logged.items()])
    return rows.select(
        "episode_key", "segment", "place", F.col("w.word").alias("word"), F.coalesce(*logged.values()).alias("logprob"), origin.alias("origin"), number("s.no_speech_prob").alias("no_speech_prob"),
        F.coalesce(number("w.start"), number("s.start")).alias("start"), F.coalesce(number("w.end"), number("s.end")).alias("end"),
    )


def _terms(rows: DataFrame, canonical: Column, source_id: Column, aliases: Column) -> DataFrame:
    """(canonical, source_id, aliases): aliases cleaned, each once whatever its case, none that is the canonical form."""
    rows = rows.select(clean(canonical).alias("canonical"), F.trim(source_id).alias("source_id"), F.coalesce(aliases, F.array().cast("array<string>")).alias("found")).filter("canonical IS NOT NULL AND source_id <> ''")
    cleaned = F.filter(F.transform("found", clean), lambda a: a.isNotNull() & (F.lower(a) != F.lower("canonical")))
    folds = F.transform(F.col("cleaned"), F.lower)
    first = F.filter("cleaned", lambda a, i: F.array_position(folds, F.lower(a)) == i + 1)
    return rows.withColumn("cleaned", cleaned).select("canonical", "source_id", first.alias("aliases"))


def read_mesh(spark: SparkSession, path: str, tag: str = "Descriptor") -> DataFrame:
    """Terms of a MeSH file of descriptors, or with ``tag="Supplemental"`` of supplemental records."""
    terms = "TermList struct<Term: array<struct<String: string>>>"
    schema = f"{tag}{'' if tag == 'Descriptor' else 'Record'}UI string, {tag}{'' if tag == 'Descriptor' else 'Record'}Name struct<String: string>, ConceptList struct<Concept: array<struct<{terms.replace(' ', ': ', 1)}>>>"
    name = "Descriptor" if tag == "Descriptor" else "SupplementalRecord"
    rows = spark.read.format("xml").schema(schema).option("rowTag", f"{tag}Record").load(path)
    aliases = F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: t["String"])))
    return _terms(rows, F.col(f"{name}Name.String"), F.col(f"{name}UI"), aliases)


def read_owl(spark: SparkSession, path: str) -> DataFrame:
    """Terms of the classes of an RDF/XML ontology: the first label or preferred label, synonyms and alternative labels as aliases."""
    labels = ("rdfs:label", "skos:prefLabel")
    synonyms = ("oboInOwl:hasExactSynonym", "oboInOwl:hasRelatedSynonym", "oboInOwl:hasBroadSynonym", "oboInOwl:hasNarrowSynonym", "skos:altLabel")
    schema = ", ".join(["`_rdf:about` string", "`_rdf:ID` string", *(f"`{c}` array<struct<_VALUE: string>>" for c in (*labels, *synonyms))])
    rows = spark.read.format("xml").schema(schema).option("rowTag", "owl:Class").load(path)
    text = lambda c: F.coalesce(F.transform(F.col(f"`{c}`"), lambda x: x["_VALUE"]), F.array().cast("array<string>"))
    labelled = F.filter(F.concat(*map(text, labels)), lambda x: clean(x).isNotNull())
    return _terms(rows, F.try_element_at(labelled, F.lit(1)), F.coalesce(F.col("`_rdf:about`"), F.col("`_rdf:ID`")), F.concat(*map(text, synonyms)))


def read_lexicon(spark: SparkSession, path: str, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(kind, term) of a dimension file of lists by kind, with an operator's own terms; normalised, each once."""
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("lists"))
    found = lists.select(F.explode("lists").alias("kind", "terms")).select("kind", F.explode("terms").alias("term"))
    if extra:
        found = found.unionByName(spark.createDataFrame([(k, t) for k, ts in extra.items() for t in ts], "kind string, term string"))
    return found.select("kind", folded(F.col("term")).alias("term")).filter("term IS NOT NULL").distinct()


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Policy cases, and what breaks their rules: a case id used twice, or a provenance group in two partitions."""
    cases = spark.read.schema("case_id string, provenance_group string, partition string").json(path)
    twice = cases.groupBy("case_id").count().filter("count > 1").select(F.lit("case_id").alias("rule"), F.col("case_id").alias("value"))
    leaks = cases.groupBy("provenance_group").agg(F.count_distinct("partition").alias("n")).filter("n > 1").select(F.lit("partition").alias("rule"), F.col("provenance_group").alias("value"))
    return cases, twice.unionByName(leaks)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, keys, body) of Markdown notes; those without a leading block between lines of three dashes are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    block = F.regexp_extract("value", r"\A---\n((?s:.*?))\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^ \-#:][^:]*:"))
    key, value = (lambda x: F.trim(F.regexp_extract(x, r"^([^:]*):", 1))), (lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2"))
    keys = F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x), value(x))))
    return files.filter(block != "").select(F.regexp_extract("_metadata.file_path", r"([^/]+\.md)$", 1).alias("path"), keys["title"].alias("title"), keys.alias("keys"), F.regexp_replace("value", r"\A---\n(?s:.*?)\n---(?:\n|\z)", "").alias("body"))


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of two providers' payloads: a score without bound is taken as a share of 40, one at most."""
    item = "struct<title: array<string>, DOI: string, score: double>"
    schema = f"id long, message struct<items: array<{item}>>, results array<struct<title: string, doi: string>>"
    rows = spark.read.schema(schema).json(path)
    first = rows.select("id", F.explode("message.items").alias("x")).select("id", F.col("x.title")[0].alias("title"), F.col("x.DOI").alias("doi"), F.least(F.lit(1.0), F.col("x.score") / 40).alias("score"), F.lit("first").alias("provider"))
    second = rows.select("id", F.explode("results").alias("x")).select("id", "x.title", "x.doi", F.lit(None).cast("double").alias("score"), F.lit("second").alias("provider"))
    return first.unionByName(second)
