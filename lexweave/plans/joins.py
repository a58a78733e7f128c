"""Joins: intervals, lookups with priorities, containment, anchors, replay, anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity import WORDS_LEAST, duplicates, normalised_words
from .dialect import Dialect, sql
from .registry import query


@sql("jn_04")
def earlier_candidates(q: Dialect) -> str:
    """Earlier documents of the same show in the 30 days before: an equi-join on the show and 30-day buckets, two a row, then the interval itself."""
    bucket = lambda x: q.div(f"CAST({x} AS BIGINT)", 30)
    day = q._("datediff(o_orderdate, DATE '1990-01-01')", "date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))")
    return f"""WITH e AS (SELECT o_orderkey AS episode_key, o_custkey AS show, CAST({day} AS BIGINT) AS day, o_orderstatus <> 'F' AS has_source FROM {q.t("orders")}),
        probe AS (SELECT *, {bucket("day")} AS b FROM e UNION ALL SELECT *, {bucket("day")} - 1 AS b FROM e),
        build AS (SELECT *, {bucket("day")} AS b FROM e WHERE has_source)
        SELECT p.episode_key, o.episode_key AS earlier_key, p.day - o.day AS days FROM probe p JOIN build o ON o.show = p.show AND o.b = p.b WHERE o.day < p.day AND o.day >= p.day - 30"""


@sql("jn_06")
def episode_lookup(q: Dialect) -> str:
    """By a name that one row has; else by a normalised title that one row has; several are ambiguous, none isn't ready."""
    title = lambda x: q.rr(f"lower({x})", "[^a-z0-9]+", " ")
    return f"""WITH g AS (SELECT p_brand || p_name AS guid, count(*) AS n, min(p_partkey) AS k FROM {q.t("part")} GROUP BY p_brand || p_name), t AS (SELECT {title("p_name || ' ' || p_type")} AS title, count(*) AS n, min(p_partkey) AS k FROM {q.t("part")} GROUP BY {title("p_name || ' ' || p_type")}),
        ask AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand || p_name END AS guid, {title("CASE WHEN p_partkey % 7 = 0 THEN 'no such' ELSE p_name || ' ' || p_type END")} AS title FROM {q.t("part")})
        SELECT a.p_partkey, CASE WHEN g.n = 1 THEN g.k WHEN t.n = 1 THEN t.k END AS found, CASE WHEN g.n = 1 THEN 'GUID' WHEN t.n = 1 THEN 'TITLE' WHEN g.n > 1 OR t.n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_READY' END AS outcome
        FROM ask a LEFT JOIN g ON g.guid = a.guid LEFT JOIN t ON t.title = a.title"""


@sql("jn_07")
def external_matches(q: Dialect) -> str:
    """Terms whose normalised form names one source; forms of several sources are rejected, and matches recorded before left out."""
    return f"""WITH forms AS (SELECT lower(p_name) AS form, p_partkey AS source_id FROM {q.t("part")} UNION SELECT lower(p_name || ' ' || p_type), p_partkey FROM {q.t("part")}),
        one AS (SELECT form, min(source_id) AS source_id FROM forms GROUP BY form HAVING count(DISTINCT source_id) = 1),
        candidates AS (SELECT p_partkey AS candidate, lower(p_name || ' ' || p_type) AS form FROM {q.t("part")}), before AS (SELECT p_partkey AS candidate FROM {q.t("part")} WHERE p_size % 2 = 0)
        SELECT c.candidate, c.form, o.source_id FROM candidates c JOIN one o ON o.form = c.form LEFT JOIN before b ON b.candidate = c.candidate WHERE b.candidate IS NULL"""


@sql("jn_10")
def interval_overlaps(q: Dialect) -> str:
    """Review spans that overlap a region of the same episode; a span that only touches doesn't."""
    return f"""WITH spans AS (SELECT l_orderkey AS episode_key, l_linenumber AS id, l_partkey AS a, l_partkey + 40 AS b FROM {q.t("lineitem")}), regions AS (SELECT o_orderkey AS episode_key, o_custkey AS a, o_custkey + 300 AS b FROM {q.t("orders")})
        SELECT r.episode_key, count(*) AS spans, count(DISTINCT s.id) AS ids, min(s.a) AS first_start FROM regions r JOIN spans s ON s.episode_key = r.episode_key AND s.a < r.b AND s.b > r.a GROUP BY r.episode_key"""


@sql("jn_12")
def decision_replay(q: Dialect) -> str:
    """Old decisions count on a fresh card only if all the evidence is the same, nulls included; the others are told why."""
    return f"""WITH {q.cards()}, old AS (SELECT id, episode_key, kind, category, chosen_source, CASE WHEN m % 4 = 0 THEN NULL ELSE suggested_source END AS evidence FROM cards WHERE decided), fresh AS (SELECT id, kind, category, suggested_source AS evidence FROM cards WHERE m % 9 <> 0)
        SELECT o.id, o.chosen_source, CASE WHEN f.id IS NULL THEN 'card_gone' WHEN o.kind = f.kind AND o.category = f.category AND o.evidence IS NOT DISTINCT FROM f.evidence THEN 'valid' ELSE 'evidence_changed' END AS outcome FROM old o LEFT JOIN fresh f ON f.id = o.id"""


@sql("jn_13")
def undecided_only(q: Dialect) -> str:
    return f"WITH {q.cards()} SELECT c.episode_key, c.id FROM cards c LEFT ANTI JOIN (SELECT id FROM cards WHERE decided) d ON d.id = c.id".replace("LEFT ANTI JOIN", q._("LEFT ANTI JOIN", "ANTI JOIN"))


@sql("jn_16")
def alias_resolution(q: Dialect) -> str:
    """A slug is its canonical tag by name or by alias, else a candidate."""
    return f"""WITH dim AS (SELECT DISTINCT lower(p_type) AS form, lower(p_type) AS tag FROM {q.t("part")} UNION SELECT DISTINCT lower(p_type) || 's', lower(p_type) FROM {q.t("part")}), ask AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_type) || 's' ELSE lower(p_name) END AS slug FROM {q.t("part")})
        SELECT a.p_partkey, a.slug, coalesce(d.tag, a.slug) AS tag, CASE WHEN d.tag IS NULL THEN 'candidate' ELSE 'canonical' END AS status FROM ask a LEFT JOIN dim d ON d.form = a.slug"""


@sql("jn_18")
def exactly_one(q: Dialect) -> str:
    return f"SELECT o.o_orderkey AS episode_key, count(c.c_custkey) AS podcasts, count(c.c_custkey) = 1 AS valid FROM {q.t('orders')} o LEFT JOIN {q.t('customer')} c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 GROUP BY o.o_orderkey"


@sql("jn_20")
def resolver_outcomes(q: Dialect) -> str:
    """What became of each submitted item: accepted, abstained, rejected, or without a response."""
    return f"""WITH {q.cards()}, responses AS (SELECT id, CASE WHEN m % 5 = 0 THEN NULL ELSE chosen_source END AS answer FROM cards WHERE m % 7 <> 0), accepted AS (SELECT id FROM cards WHERE chosen_source = suggested_source)
        SELECT c.id, CASE WHEN r.id IS NULL THEN 'missing_response' WHEN r.answer IS NULL THEN 'abstained' WHEN a.id IS NOT NULL THEN 'accepted' ELSE 'rejected' END AS outcome FROM cards c LEFT JOIN responses r ON r.id = c.id LEFT JOIN accepted a ON a.id = c.id"""


@sql("jn_21")
def correlation_match(q: Dialect) -> str:
    """An execution matches if each of three names is there exactly once, with the value asked for."""
    ok = " AND ".join(f"count(CASE WHEN event_type = '{n}' THEN 1 END) = 1" for n in ("signup", "error", "purchase"))
    return f"SELECT user_id, {q.div('event_id', 50)} AS execution, count(*) AS settings, {ok} AND max(CASE WHEN event_type = 'purchase' THEN value END) > 10 AS matches FROM {q.t('events')} GROUP BY user_id, {q.div('event_id', 50)}"


@sql("src_08")
def attach_words(q: Dialect) -> str:
    """Each word goes to the last segment that began at its midpoint or before, and to the first segment if none had."""
    return f"""WITH seg AS (SELECT user_id, event_id AS seg_id, CAST(event_id AS DOUBLE) AS start FROM {q.t("events")} WHERE event_type = 'view'), word AS (SELECT user_id, event_id AS word_id, event_id + value / 200 AS mid FROM {q.t("events")} WHERE event_type = 'click'),
        firsts AS (SELECT user_id, min(seg_id) AS first_seg FROM seg GROUP BY user_id),
        line AS (SELECT user_id, start AS placed, 0 AS is_word, seg_id, CAST(NULL AS BIGINT) AS word_id FROM seg UNION ALL SELECT user_id, mid + 0.000001, 1, NULL, word_id FROM word),
        carried AS (SELECT user_id, word_id, {q.known('last', 'seg_id')} OVER (PARTITION BY user_id ORDER BY placed, is_word, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg_id FROM line)
        SELECT c.user_id, c.word_id, coalesce(c.seg_id, f.first_seg) AS seg_id FROM carried c LEFT JOIN firsts f ON f.user_id = c.user_id WHERE c.word_id IS NOT NULL"""


@sql("jn_09")
def locate_by_neighbours(q: Dialect) -> str:
    """An unmapped place lies between its nearest mapped neighbours, by interpolation; beyond the ends it is unknown."""
    w = "PARTITION BY user_id ORDER BY event_id"
    return f"""WITH m AS (SELECT user_id, event_id, row_number() OVER ({w}) AS pos, CASE WHEN event_type = 'purchase' THEN event_id * 2 END AS mapped FROM {q.t("events")}),
        n AS (SELECT *, CASE WHEN mapped IS NOT NULL THEN pos END AS mp FROM m),
        f AS (SELECT *, {q.known('last', 'mapped')} OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, {q.known('last', 'mp')} OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo_pos,
                    {q.known('first', 'mapped')} OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi, {q.known('first', 'mp')} OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi_pos FROM n)
        SELECT user_id, event_id, CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN lo_pos = hi_pos THEN lo ELSE lo + {q.div("(hi - lo) * (pos - lo_pos)", "hi_pos - lo_pos")} END AS located, mapped IS NOT NULL AS exact FROM f"""


def _grams(source: str, n: int) -> str:
    """In DuckDB: distinct word n-grams of texts (doc_id, gram), and the documents' numbers of them."""
    ahead = f"OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-zà-ÿß]+'), lambda w: w <> '') AS ws FROM {source}),
        each_word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words),
        grams AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, string_agg(w, ' ') {ahead} AS gram, count(*) {ahead} AS c FROM each_word) t WHERE c = {n}),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id)"""


#: A document is published every hour: so far back, in hours, originals are looked for.
_REACH = 30 * 24


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the hour they were published in; the analog publishes one an hour."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("at"))


def containment_check() -> str:
    return f"""WITH {_grams("(SELECT doc_id, text FROM documents WHERE n_chars > 0)", 4)}, shared AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1), kept AS (SELECT g.doc_id, g.gram FROM grams g JOIN shared s ON s.gram = g.gram),
        pairs AS (SELECT a.doc_id AS doc_id, b.doc_id AS earlier_id, count(*) AS common FROM kept a JOIN kept b ON b.gram = a.gram AND b.doc_id < a.doc_id AND b.doc_id >= a.doc_id - {_REACH} GROUP BY a.doc_id, b.doc_id),
        found AS (SELECT p.doc_id, p.earlier_id, p.common, s.n AS grams, CAST(p.common AS DOUBLE) / s.n AS containment, CAST(len(w.ws) AS BIGINT) AS words FROM pairs p JOIN sizes s ON s.doc_id = p.doc_id JOIN words w ON w.doc_id = p.doc_id WHERE 2 * p.common >= s.n)
        SELECT doc_id, earlier_id, common, grams, containment, words, words >= 1000 AND row_number() OVER (PARTITION BY doc_id ORDER BY common DESC, earlier_id) = 1 AS is_duplicate FROM found"""


@query("jn_05", containment_check())
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share half their distinct 4-grams with one of the 30 days before, and which of them are duplicates."""
    found = duplicates(published(spark, sf_dir), _REACH)
    return found.select(F.col("id").alias("doc_id"), "earlier_id", "common", "grams", "containment", "words", "is_duplicate")


@query(
    "flt_04",
    f"""WITH found AS ({containment_check()}), {_grams("documents", 4).partition(",\n        each_word AS")[0]}
        SELECT w.doc_id, CAST(coalesce(len(w.ws), 0) AS BIGINT) AS n, coalesce(len(w.ws), 0) >= 1000 AS checkable, count(CASE WHEN f.is_duplicate THEN 1 END) > 0 AS duplicate FROM words w LEFT JOIN found f ON f.doc_id = w.doc_id GROUP BY w.doc_id, w.ws""",
)
def duplicate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least 1,000 words can be checked; half of the 4-grams in one earlier document makes a duplicate."""
    docs = published(spark, sf_dir)
    found = duplicates(docs, _REACH).filter("is_duplicate").select(F.col("id").alias("__id"))
    n = F.size(normalised_words(F.col("text"))).cast("long")
    return docs.join(found, docs["id"] == found["__id"], "left").select(F.col("id").alias("doc_id"), n.alias("n"), (n >= WORDS_LEAST).alias("checkable"), F.col("__id").isNotNull().alias("duplicate"))


@sql("jn_08")
def unique_anchors(q: Dialect) -> str:
    """5-grams that stand exactly once in each of two neighbouring readings, with their places."""
    grams = lambda c: q.bind(c, "v", q.each(q.range(1, f"{q.size('v')} - 4"), "i", q.join(q.slice("v", "i", 5))))
    side = lambda c, name: f"{name} AS (SELECT episode_key, id, gram, min(pos) AS pos FROM {q.unnest('episode_key, id', 'w', grams(c), 'gram')} x GROUP BY episode_key, id, gram HAVING count(*) = 1)"
    return f"""WITH {q.turns()}, w AS (SELECT episode_key, id, {q.words("apple_text")} AS a, {q.words("coalesce(apple_text || ' ' || whisper_text, apple_text)")} AS b FROM turns), {side("a", "l")}, {side("b", "r")}
        SELECT l.episode_key, l.id, l.gram, CAST(l.pos AS BIGINT) AS left_pos, CAST(r.pos AS BIGINT) AS right_pos FROM l JOIN r ON r.episode_key = l.episode_key AND r.id = l.id AND r.gram = l.gram"""
