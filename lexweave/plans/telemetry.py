"""Review telemetry: cross-tabs, availability, queues, samples, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from .dialect import Dialect, Duck, checked, sql
from .registry import query

#: The sources a decision can choose, and the groups and tiers of a queue.
SOURCES = ["apple", "whisper", "manual", "third_asr", "<unknown>"]
GROUPS = ["settled", "sample", "click_one", "proposal", "full"]
_SRC = "coalesce(chosen_source, '<unknown>')"


def _domain(values: list[str], column: str) -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS {column}" for v in values)


@sql("ag_05")
def source_crosstab(q: Dialect) -> str:
    """Counts and percentages over the fixed sources; a source that nobody chose keeps its row."""
    return f"""WITH {q.cards()}, domain AS ({_domain(SOURCES, "source")}), c AS (SELECT {_SRC} AS source, count(*) AS n FROM cards WHERE decided GROUP BY {_SRC})
        SELECT d.source, coalesce(c.n, 0) AS decisions, 100.0 * CAST(coalesce(c.n, 0) AS DOUBLE) / CAST(sum(coalesce(c.n, 0)) OVER () AS DOUBLE) AS percentage FROM domain d LEFT JOIN c ON c.source = d.source"""


@sql("ag_06")
def breakdowns(q: Dialect) -> str:
    """The same decisions by kind, category, severity, tier and podcast, each on its own, in one pass."""
    return f"""WITH {q.cards()}, d AS (SELECT CAST(episode_key % 10 AS STRING) AS podcast, kind, category, severity, tier, {_SRC} AS source FROM cards WHERE decided)
        SELECT podcast, kind, category, severity, tier, source, count(*) AS decisions FROM d
        GROUP BY GROUPING SETS ((podcast, source), (kind, source), (category, source), (severity, source), (tier))"""


@sql("ag_07")
def compiler_distributions(q: Dialect) -> str:
    """Differences by severity and kind in each episode, then over the fleet."""
    return f"""WITH {q.cards()}, e AS (SELECT episode_key, severity, kind, count(*) AS n FROM cards GROUP BY episode_key, severity, kind)
        SELECT severity, kind, count(*) AS episodes, CAST(sum(n) AS BIGINT) AS differences, max(n) AS most FROM e GROUP BY severity, kind"""


@sql("ag_08")
def availability(q: Dialect) -> str:
    """A metric that some records lack is mixed, one that all lack unavailable: its sum is null then, never zero."""
    metrics = {"resolved": "CASE WHEN m % 3 <> 0 THEN m % 50 END", "bypassed": "CASE WHEN m < 0 THEN m END", "deferred": "m % 7"}
    rows = " UNION ALL ".join(f"SELECT '{name}' AS metric, episode_key, {value} AS v FROM cards" for name, value in metrics.items())
    return f"""WITH {q.cards()}, r AS ({rows})
        SELECT metric, CASE WHEN count(v) = count(*) THEN 'available' WHEN count(v) = 0 THEN 'unavailable' ELSE 'mixed' END AS availability, count(*) AS records, count(v) AS reporting, CAST(sum(v) AS BIGINT) AS total
        FROM r GROUP BY metric"""


@sql("ag_09")
def assisted_states(q: Dialect) -> str:
    """Cards by assisted state; what isn't a state is counted apart, and the parts add up to all."""
    return f"""WITH {q.cards()}, s AS (SELECT episode_key, CASE route WHEN 'judge' THEN 'ready' WHEN 'reviewer' THEN 'excluded' WHEN 'immaterial' THEN 'needs_audio' ELSE NULL END AS state FROM cards)
        SELECT episode_key, count(*) AS cards, count_if(state = 'ready') AS ready, count_if(state = 'excluded') AS excluded, count_if(state = 'needs_audio') AS needs_audio, count(*) - count(state) AS malformed,
               count_if(state = 'ready') + count_if(state = 'excluded') + count_if(state = 'needs_audio') + count(*) - count(state) = count(*) AS adds_up
        FROM s GROUP BY episode_key"""


@sql("ag_10")
def registry_stats(q: Dialect) -> str:
    """A candidate's primary category is the most frequent one, of equal ones the last by name."""
    return f"""WITH c AS (SELECT p_name AS term, p_brand AS category, count(*) AS n FROM {q.t("part")} GROUP BY p_name, p_brand)
        SELECT term, CAST(sum(n) AS BIGINT) AS observations, {q.argmax("category", ["n", "category"])} AS primary_category, max(n) AS most FROM c GROUP BY term"""


@sql("ag_11")
def route_counts(q: Dialect) -> str:
    routes = ", ".join(f"count_if(route = '{r}') AS {r}" for r in ("advertisement", "immaterial", "reviewer", "judge"))
    return f"""WITH {q.cards()} SELECT episode_key, {routes}, count_if(decided AND route = 'immaterial' AND chosen_source = suggested_source) AS agreed,
        count_if(decided AND route = 'immaterial' AND chosen_source <> suggested_source) AS disagreed FROM cards GROUP BY episode_key"""


@sql("ag_12")
def review_session(q: Dialect) -> str:
    return f"""WITH {q.cards()} SELECT episode_key, grp, count(*) AS decisions, count_if(chosen_source <> suggested_source) AS overruled,
        {q.sorted_list("CAST(id AS STRING)", where="chosen_source <> suggested_source")} AS overruled_ids, CAST(sum(CASE WHEN seconds > 0 THEN seconds END) AS BIGINT) AS seconds, count_if(seconds > 0) AS timed, bool_or(opened) AS any_opened
        FROM cards WHERE decided GROUP BY episode_key, grp"""


@sql("ag_13")
def policy_evaluation(q: Dialect) -> str:
    """Automatic, right and wrong answers of each partition, and of all."""
    return f"""WITH l AS (SELECT d.lang AS part, l.quality, l.toxic, d.n_chars > 1500 AS automatic FROM {q.t("labels")} l JOIN {q.t("documents")} d ON d.doc_id = l.doc_id)
        SELECT coalesce(part, '*') AS part, count(*) AS cases, count_if(automatic) AS automatic, count_if(automatic AND quality = 1) AS correct, count_if(automatic AND quality = 0) AS wrong, count_if(NOT automatic) AS burden, count_if(automatic AND toxic = 1) AS harmful
        FROM l GROUP BY ROLLUP (part)"""


@sql("ag_14")
def queue_groups(q: Dialect) -> str:
    """Undecided cards over the fixed groups and tiers; empty ones keep their rows."""
    return f"""WITH {q.cards()}, domain AS ({_domain(GROUPS, "grp")}), tiers AS ({_domain(["A", "B", "C"], "tier")}), n AS (SELECT grp, tier, count(*) AS n FROM cards WHERE NOT decided GROUP BY grp, tier)
        SELECT d.grp, t.tier, coalesce(n.n, 0) AS cards FROM domain d JOIN tiers t ON true LEFT JOIN n ON n.grp = d.grp AND n.tier = t.tier"""


@sql("ag_15")
def corpus_thresholds(q: Dialect) -> str:
    """Distinct episodes, the first record of each; the least reached threshold that isn't accepted blocks, the least not reached is next."""
    thresholds = " UNION ALL ".join(f"SELECT {n} AS threshold, {str(n < 500).lower()} AS accepted" for n in (100, 500, 1000, 5000, 100000))
    return f"""WITH {q.cards()}, firsts AS (SELECT episode_key, min(id) AS id FROM cards GROUP BY episode_key), n AS (SELECT count(*) AS n FROM firsts f JOIN cards c ON c.id = f.id AND c.severity <> 'low'), t AS ({thresholds})
        SELECT n.n AS comparable, min(CASE WHEN t.threshold <= n.n AND NOT t.accepted THEN t.threshold END) AS blocking, min(CASE WHEN t.threshold > n.n THEN t.threshold END) AS next_threshold FROM t JOIN n ON true GROUP BY n.n"""


@sql("ag_18")
def votes(q: Dialect) -> str:
    """Unanimous: exactly three equal votes. Majority: two or more, and strictly more than the others."""
    vote = lambda k: f"CASE {q.div('m', k)} % 4 WHEN 0 THEN 'apple' WHEN 1 THEN 'whisper' WHEN 2 THEN 'apple' END"
    return f"""WITH {q.cards()}, v AS (SELECT id, unnest_v AS vote FROM (SELECT id, {vote(41)} AS unnest_v FROM cards UNION ALL SELECT id, {vote(43)} FROM cards UNION ALL SELECT id, {vote(47)} FROM cards) x),
        c AS (SELECT id, count(vote) AS n, count_if(vote = 'apple') AS a, count_if(vote = 'whisper') AS w FROM v GROUP BY id)
        SELECT id, n, CASE WHEN a = 3 THEN 'apple' WHEN w = 3 THEN 'whisper' END AS unanimous, CASE WHEN a >= 2 AND a > w THEN 'apple' WHEN w >= 2 AND w > a THEN 'whisper' END AS majority FROM c"""


@sql("ag_19")
def range_metadata(q: Dialect) -> str:
    """Mean, first and last of what is known in a range; nothing known gives null."""
    v = "CASE WHEN event_id % 3 <> 0 THEN value END"
    return f"""WITH e AS (SELECT user_id, ts, event_id, {v} AS v FROM {q.t("events")})
        SELECT user_id, {q.div("event_id", 500)} AS part, round(avg(v), 4) AS mean_value, {q._("min_by(v, event_id) FILTER (WHERE v IS NOT NULL)", "arg_min(v, event_id) FILTER (WHERE v IS NOT NULL)")} AS first_value, {q._("max_by(v, event_id) FILTER (WHERE v IS NOT NULL)", "arg_max(v, event_id) FILTER (WHERE v IS NOT NULL)")} AS last_value, count(*) - count(v) AS unknown
        FROM e GROUP BY user_id, {q.div("event_id", 500)}"""


@sql("ag_20")
def observation_upsert(q: Dialect) -> str:
    """What a registry holds of a candidate: a count, its categories, at most 12 distinct forms, and when it was seen first and last."""
    forms = q._("slice(sort_array(collect_set(event_type || '-' || CAST(k AS STRING))), 1, 12)", "list_slice(list_sort(list_distinct(list(event_type || '-' || CAST(k AS STRING)))), 1, 12)")
    return f"""WITH e AS (SELECT user_id, event_type, ts, {q.json_int("props", "k")} % 9 AS k FROM {q.t("events")})
        SELECT user_id AS candidate, count(*) AS observations, count(DISTINCT event_type) AS categories, {q.join(forms, ",")} AS forms, CAST(min(ts) AS STRING) AS first_seen, CAST(max(ts) AS STRING) AS last_seen FROM e GROUP BY user_id"""


@sql("ag_21")
def backfill_counts(q: Dialect) -> str:
    """A candidate and episode observed before add nothing; of repeated seeds the first stays."""
    return f"""WITH {q.cards()}, seen AS (SELECT DISTINCT episode_key, category FROM cards WHERE decided), fresh AS (SELECT episode_key, category, id, row_number() OVER (PARTITION BY episode_key, category ORDER BY id) AS rn FROM cards WHERE NOT decided),
        s AS (SELECT f.category, CASE WHEN s.category IS NOT NULL THEN 'already_observed' WHEN f.rn > 1 THEN 'duplicate_seed' ELSE 'added' END AS status FROM fresh f LEFT JOIN seen s ON s.episode_key = f.episode_key AND s.category = f.category)
        SELECT category, status, count(*) AS candidates FROM s GROUP BY category, status"""


def _tags(q: Dialect) -> str:
    return f"""WITH r AS (SELECT p_name AS slug, p_type AS source_type, count(*) AS n FROM {q.t("part")} GROUP BY p_name, p_type)
        SELECT slug, CAST(sum(n) AS BIGINT) AS occurrences, {q.sorted_list("source_type || '=' || CAST(n AS STRING)")} AS source_types FROM r GROUP BY slug"""


@query("ag_26", f"SELECT *, row_number() OVER (ORDER BY occurrences DESC, slug) AS place FROM ({checked(_tags(Duck()))}) t")
def tag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by how often they occur."""
    return global_rank(spark.sql(checked(_tags(Dialect(sf_dir)))), [F.desc("occurrences"), F.col("slug")])


@sql("ag_27")
def work_summary(q: Dialect) -> str:
    """One line of an episode's work: quick cards are samples, single clicks and proposals."""
    return f"""WITH {q.cards()}, c AS (SELECT episode_key, count_if(grp IN ('sample', 'click_one', 'proposal')) AS quick, count_if(grp = 'full') AS full_cards, count_if(grp = 'settled') AS settled FROM cards WHERE NOT decided GROUP BY episode_key)
        SELECT episode_key, CAST(quick AS STRING) || ' quick, ' || CAST(full_cards AS STRING) || ' full, ' || CAST(settled AS STRING) || ' settled' AS summary FROM c"""


@sql("ag_28")
def review_progress(q: Dialect) -> str:
    """All: pending or decided cards. Reviewed: decided ones that aren't pending again."""
    return f"""WITH {q.cards()}, s AS (SELECT episode_key, id, bool_or(p) AS pending, bool_or(NOT p) AS decided FROM (SELECT episode_key, id, false AS p FROM cards WHERE decided UNION ALL SELECT episode_key, id, true FROM cards WHERE NOT decided OR m % 10 = 0) x GROUP BY episode_key, id)
        SELECT episode_key, count(*) AS total, count_if(decided AND NOT pending) AS reviewed FROM s GROUP BY episode_key"""


@sql("ag_29")
def degradation(q: Dialect) -> str:
    """How much of a triage run was unavailable, with its distinct statuses; null where nothing was."""
    return f"""WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 400 + {q.json_int("props", "k")} % 5 END AS status FROM {q.t("events")})
        SELECT user_id, count(*) AS total, CASE WHEN count(status) > 0 THEN count(status) END AS unavailable, CASE WHEN count(status) > 0 THEN {q.sorted_list("CAST(status AS STRING)", distinct=True, where="status IS NOT NULL")} END AS statuses FROM e GROUP BY user_id"""


@sql("ag_30")
def save_log(q: Dialect) -> str:
    return f"WITH {q.cards()} SELECT episode_key, grp, count(*) AS decisions, count_if(chosen_source IS DISTINCT FROM suggested_source) AS overruled, CAST(sum(seconds) AS BIGINT) AS seconds FROM cards WHERE decided GROUP BY episode_key, grp".replace("IS DISTINCT FROM suggested_source", "IS NULL OR suggested_source IS NULL OR chosen_source <> suggested_source")


def _published(q: Dialect) -> str:
    return f"SELECT o_orderkey AS episode_key, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published FROM {q.t('orders')}"


@query("tk_01", f"SELECT *, row_number() OVER (ORDER BY published DESC, CAST(episode_key AS VARCHAR) DESC) AS place FROM ({_published(Duck())}) t")
def latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By publication as text, then by key, both falling."""
    return global_rank(spark.sql(_published(Dialect(sf_dir))), [F.desc("published"), F.desc(F.col("episode_key").cast("string"))])


#: The resolver's queue, first category first, and how many it takes.
PRIORITY = ["protocol_number", "unit", "negation", "citation", "proper_name", "supplement", "exercise_name", "training_term", "other"]


def _priority() -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(PRIORITY)) + " END"


@sql("tk_04")
def resolver_batch(q: Dialect) -> str:
    """Cards that can't go to the resolver are bypassed before the limit; of the others the first 40 are the batch, the rest deferred."""
    return f"""WITH {q.cards()}, c AS (SELECT episode_key % 20 AS episode_key, id, category, severity <> 'low' AS eligible FROM cards),
        r AS (SELECT *, row_number() OVER (PARTITION BY episode_key, eligible ORDER BY {_priority()}, id) AS rn FROM c)
        SELECT episode_key, id, category, CASE WHEN NOT eligible THEN 'bypassed' WHEN rn <= 40 THEN 'batch' ELSE 'deferred' END AS outcome, CASE WHEN eligible THEN rn END AS place FROM r"""


@sql("tk_05")
def triage_batch(q: Dialect) -> str:
    """The first 80 by id in chunks of ten; the rest is deferred."""
    return f"""WITH {q.cards()}, r AS (SELECT episode_key % 20 AS episode_key, id, row_number() OVER (PARTITION BY episode_key % 20 ORDER BY id) AS rn FROM cards WHERE NOT decided)
        SELECT episode_key, id, CASE WHEN rn <= 80 THEN {q.div("rn - 1", 10)} END AS chunk, rn > 80 AS deferred FROM r"""


@sql("tk_08")
def first_best(q: Dialect) -> str:
    """The best score; of equal ones the first seen."""
    return f"SELECT o_custkey AS episode_key, {q.argmax('o_orderkey', ['CAST(o_totalprice / 50000 AS INT)', '-o_orderkey'])} AS best_id, max(CAST(o_totalprice / 50000 AS INT)) AS score FROM {q.t('orders')} GROUP BY o_custkey".replace("CAST(o_totalprice / 50000 AS INT)", "CAST(floor(o_totalprice / 50000) AS BIGINT)")


@sql("tk_09")
def beyond_newest(q: Dialect) -> str:
    return f"WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {q.t('orders')}) SELECT o_custkey, o_orderkey, rn FROM r WHERE rn > 5"


@query(
    "tk_10",
    """WITH l AS (SELECT doc_id, toxic, sha256('133:' || CAST(doc_id AS VARCHAR)) AS rank FROM labels), n AS (SELECT count(CASE WHEN toxic = 1 THEN 1 END) AS n FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY rank, doc_id) AS rn FROM l)
        SELECT doc_id, toxic, row_number() OVER (ORDER BY rank, doc_id) AS place FROM r JOIN n ON true WHERE toxic = 1 OR rn <= n""",
)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positive rows and as many others, drawn and shuffled by a seeded digest. The number, not the draw, depends on the data."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic", F.sha2(F.concat(F.lit("133:"), F.col("doc_id").cast("string")).cast("binary"), 256).alias("rank"))
    n = rows.filter("toxic = 1").count()
    # classes follow each other in one order: a row's place in its class is its place less those before its class
    ranked = global_rank(rows, [F.col("toxic"), F.col("rank"), F.col("doc_id")], "in_order")
    first = ranked.groupBy("toxic").agg(F.min("in_order").alias("first"))
    drawn = ranked.join(F.broadcast(first), "toxic").filter((F.col("toxic") == 1) | (F.col("in_order") - F.col("first") < n))
    return global_rank(drawn.select("doc_id", "toxic", "rank"), [F.col("rank"), F.col("doc_id")]).select("doc_id", "toxic", "place")


@sql("wn_08")
def control_sample(q: Dialect) -> str:
    """A tenth of an episode's cards, two at least, by the first 12 hex digits of a digest."""
    rank = f"substr({q.sha("CAST(episode_key AS STRING) || ':' || CAST(id AS STRING)")}, 1, 12)"
    return f"""WITH {q.cards()}, r AS (SELECT episode_key, id, row_number() OVER (PARTITION BY episode_key ORDER BY {rank}, CAST(id AS STRING)) AS rn, count(*) OVER (PARTITION BY episode_key) AS n FROM cards)
        SELECT episode_key, id, rn FROM r WHERE rn <= least(n, greatest(2, CAST(ceil(n / 10.0) AS BIGINT)))"""


@sql("al_15")
def queue_group(q: Dialect) -> str:
    """A settled card drawn as a control goes to the sample; others by their route and proposal."""
    rank = f"substr({q.sha("CAST(episode_key AS STRING) || ':' || CAST(id AS STRING)")}, 1, 12)"
    return f"""WITH {q.cards()}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_key ORDER BY {rank}, CAST(id AS STRING)) AS rn, count(*) OVER (PARTITION BY episode_key) AS n FROM cards),
        g AS (SELECT episode_key, id, rn <= least(n, greatest(2, CAST(ceil(n / 10.0) AS BIGINT))) AS sampled, CASE WHEN route IN ('advertisement', 'immaterial') AND suggested_source IS NOT NULL THEN 'settled' WHEN route IN ('advertisement', 'immaterial') THEN 'click_one' WHEN suggested_source IS NOT NULL THEN 'proposal' ELSE 'full' END AS base FROM r)
        SELECT episode_key, id, CASE WHEN base = 'settled' AND sampled THEN 'sample' ELSE base END AS queue_group FROM g"""


@sql("st_02")
def pending_and_decided(q: Dialect) -> str:
    return f"WITH {q.cards()} SELECT episode_key, id, 'decided' AS part FROM cards WHERE decided UNION ALL SELECT episode_key, id, 'pending' FROM cards WHERE NOT decided OR m % 10 = 0"


@sql("st_05")
def first_by_key(q: Dialect) -> str:
    return f"WITH {q.cards()}, r AS (SELECT episode_key, id, category, row_number() OVER (PARTITION BY episode_key ORDER BY id) AS rn FROM cards) SELECT episode_key, id, category FROM r WHERE rn = 1"


@sql("jn_15")
def prefer_decided(q: Dialect) -> str:
    return f"""WITH {q.cards()}, u AS (SELECT episode_key, id, true AS done, chosen_source AS answer FROM cards WHERE decided UNION ALL SELECT episode_key, id, false, suggested_source FROM cards WHERE m % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY episode_key, id ORDER BY CASE WHEN done THEN 0 ELSE 1 END) AS rn FROM u) SELECT episode_key, id, done, answer FROM r WHERE rn = 1"""
