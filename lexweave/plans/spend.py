"""Spend ledgers: breakdowns, headroom, report totals, bounds."""

from __future__ import annotations

from .dialect import Dialect, sql

#: The caps of an episode in USD.
CAP, THIRD_CAP = "1.60", "0.10"
#: The stages of the report's columns, in its order.
STAGES = ["transcription", "resolver", "triage", "judge", "note_writer"]
_SUM = "CAST(coalesce(sum(CASE WHEN {when} THEN usd END), 0) AS DECIMAL(18,6))"


def _sum(when: str) -> str:
    return f"CAST({_SUM.format(when=when)} AS DOUBLE)"


@sql("ag_01")
def spend_breakdown(q: Dialect) -> str:
    """Sums by stage; released attempts count and add nothing. The row without a stage is the episode's total."""
    return f"""WITH {q.attempts()}
        SELECT episode_key, stage, CAST(grouping(stage) AS INT) AS is_total, count(*) AS attempts,
               {_sum("state = 'settled'")} AS settled_usd, {_sum("state = 'uncertain'")} AS uncertain_usd, {_sum("state = 'reserved'")} AS reserved_usd,
               {_sum("state <> 'released'")} AS committed_usd
        FROM attempts GROUP BY GROUPING SETS ((episode_key, stage), (episode_key))"""


@sql("ag_02")
def budget_summary(q: Dialect) -> str:
    """Totals and headroom under both caps; only attempts that weren't released use it up."""
    return f"""WITH {q.attempts()}, s AS (
        SELECT episode_key, CAST(sum(CASE WHEN state = 'settled' THEN usd ELSE 0 END) AS DECIMAL(18,6)) AS settled,
               CAST(sum(CASE WHEN state = 'uncertain' THEN usd ELSE 0 END) AS DECIMAL(18,6)) AS uncertain,
               CAST(sum(CASE WHEN state = 'reserved' THEN usd ELSE 0 END) AS DECIMAL(18,6)) AS live,
               CAST(sum(CASE WHEN third AND state = 'reserved' THEN usd ELSE 0 END) AS DECIMAL(18,6)) AS third_live,
               CAST(sum(CASE WHEN third AND state <> 'released' THEN usd ELSE 0 END) AS DECIMAL(18,6)) AS third_spent
        FROM attempts GROUP BY episode_key)
        SELECT episode_key, CAST(settled AS DOUBLE) AS settled_usd, CAST(uncertain AS DOUBLE) AS uncertain_usd, CAST(live AS DOUBLE) AS live_usd, CAST(third_live AS DOUBLE) AS third_live_usd,
               CAST({CAP} - settled - uncertain - live AS DOUBLE) AS headroom_usd, CAST({THIRD_CAP} - third_spent AS DOUBLE) AS third_headroom_usd,
               settled + uncertain + live <= {CAP} AND third_spent <= {THIRD_CAP} AS within_caps
        FROM s"""


@sql("ag_03")
def report_totals(q: Dialect) -> str:
    return f"""WITH {q.attempts()}, e AS (
        SELECT episode_key, CAST(sum(CASE WHEN state <> 'released' THEN usd ELSE 0 END) AS DOUBLE) AS total, CAST(sum(CASE WHEN stage = 'note_writer' AND state <> 'released' THEN usd END) AS DOUBLE) AS notes
        FROM attempts GROUP BY episode_key)
        SELECT count(*) AS ledgers, count(DISTINCT episode_key) AS episodes, round(sum(total), 6) AS total_usd, round(avg(total), 6) AS mean_usd, round(median(total), 6) AS median_usd, round(max(total), 6) AS max_usd,
               count(notes) AS note_ledgers, round(avg(notes), 6) AS note_mean_usd, round(median(notes), 6) AS note_median_usd, round(max(notes), 6) AS note_max_usd
        FROM e"""


@sql("ag_04")
def fleet_ledgers(q: Dialect) -> str:
    """Counts by state; an attempt commits what settled, else what it reserved; what isn't a number commits nothing."""
    return f"""WITH a AS (
        SELECT event_type AS state, CASE WHEN event_id % 10 = 3 THEN 'n/a' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS reserved,
               CASE WHEN event_type = 'purchase' THEN CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS settled FROM {q.t("events")})
        SELECT state, count(*) AS attempts, count(TRY_CAST(reserved AS DECIMAL(18,2))) AS wellformed,
               CAST(sum(coalesce(TRY_CAST(settled AS DECIMAL(18,2)), TRY_CAST(reserved AS DECIMAL(18,2)), 0)) AS DOUBLE) AS committed_usd
        FROM a GROUP BY state"""


@sql("ag_22")
def downstream_reserve(q: Dialect) -> str:
    """The reserve of all required stages; a stage without a price leaves the sum unknown, never zero."""
    required = " UNION ALL ".join(f"SELECT '{s}' AS stage" for s in STAGES)
    return f"""WITH {q.attempts()}, required AS ({required}),
        priced AS (SELECT episode_key, stage, max(usd) AS bound FROM attempts WHERE state <> 'released' GROUP BY episode_key, stage),
        episodes AS (SELECT DISTINCT episode_key FROM attempts)
        SELECT e.episode_key, count(*) - count(p.bound) AS missing, {q.sorted_list("r.stage", where="p.bound IS NULL")} AS missing_stages,
               CASE WHEN count(*) = count(p.bound) THEN CAST(sum(p.bound) AS DOUBLE) END AS reserve_usd
        FROM episodes e JOIN required r ON true LEFT JOIN priced p ON p.episode_key = e.episode_key AND p.stage = r.stage
        GROUP BY e.episode_key"""


@sql("ag_24")
def price_bounds(q: Dialect) -> str:
    """Worst case over candidate models: dearest prices, least context; an endpoint counts only if exactly one matches."""
    return f"""SELECT p_brand AS preset, max(p_retailprice) AS prompt_price, max(p_retailprice * 2) AS completion_price, min(p_size) AS context_size,
               count_if(p_type = 'ECONOMY') = 1 AS one_endpoint, CASE WHEN count_if(p_type = 'ECONOMY') = 1 THEN max(CASE WHEN p_type = 'ECONOMY' THEN p_retailprice END) END AS audio_price
        FROM {q.t("part")} GROUP BY p_brand"""


@sql("ag_25")
def integrity_failures(q: Dialect) -> str:
    """Attempts that settled above what they had reserved, as the largest reservation of their stage."""
    return f"""WITH {q.attempts()}, bound AS (SELECT episode_key, stage, max(usd) AS reserved FROM attempts WHERE state = 'reserved' GROUP BY episode_key, stage)
        SELECT a.episode_key, a.attempt_id, a.stage, CAST(a.usd AS DOUBLE) AS settled_usd, CAST(b.reserved AS DOUBLE) AS reserved_usd
        FROM attempts a JOIN bound b ON a.episode_key = b.episode_key AND a.stage = b.stage WHERE a.state = 'settled' AND a.usd > b.reserved"""


@sql("sc_29")
def reservation_bounds(q: Dialect) -> str:
    """Bytes times the prompt's price plus the most tokens times the completion's; seconds of audio count up to whole ones."""
    size = "octet_length(CAST(text AS BINARY))" if q.spark else "strlen(text)"
    return f"""SELECT doc_id, CAST({size} AS BIGINT) AS request_bytes, {size} + 48000 <= 64000 AS fits_context,
               CAST(CAST({size} AS DECIMAL(18,0)) * CAST('0.000003' AS DECIMAL(12,6)) + 48000 * CAST('0.000015' AS DECIMAL(12,6)) AS DOUBLE) AS text_usd,
               CAST(ceil(n_chars / 15.0) AS BIGINT) AS audio_seconds, CAST(CAST(ceil(n_chars / 15.0) AS DECIMAL(18,0)) * CAST('0.0001' AS DECIMAL(12,6)) AS DOUBLE) AS audio_usd
        FROM {q.t("documents")}"""


@sql("sc_30")
def strict_decimals(q: Dialect) -> str:
    """An amount is admitted only as a plain, finite number that isn't negative."""
    raw = "CASE event_id % 6 WHEN 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS STRING) WHEN 1 THEN '-' || CAST(CAST(value AS DECIMAL(18,2)) AS STRING) WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN '1e3' ELSE '0' END"
    return f"""WITH r AS (SELECT event_id, {raw} AS raw FROM {q.t("events")})
        SELECT event_id, raw, {q.rx("raw", "^[0-9]+([.][0-9]+)?$")} AS admitted, CASE WHEN {q.rx("raw", "^[0-9]+([.][0-9]+)?$")} THEN CAST(TRY_CAST(raw AS DECIMAL(18,6)) AS DOUBLE) END AS usd FROM r"""


@sql("sc_36")
def price_ceiling(q: Dialect) -> str:
    """The lesser of an existing ceiling and the bound per million tokens, all in decimals."""
    return f"""SELECT p_partkey, CAST(least(coalesce(CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DECIMAL(18,6)) END, CAST(p_retailprice / 1000 AS DECIMAL(18,6))), CAST(p_retailprice / 1000 AS DECIMAL(18,6))) AS DOUBLE) AS ceiling_usd,
               CASE WHEN p_size % 3 = 0 THEN 'existing' ELSE 'bound' END AS source FROM {q.t("part")}"""


def report_columns(q: Dialect) -> str:
    """The report's fixed columns, one for each stage."""
    columns = ", ".join(f"{_sum(f"stage = '{s}' AND state <> 'released'")} AS {s}_usd" for s in STAGES)
    return f"WITH {q.attempts()} SELECT episode_key, {columns}, count(*) AS attempts FROM attempts GROUP BY episode_key"


def scan_ledgers(q: Dialect) -> str:
    """Attempts of all ledgers, one row each."""
    return f"WITH {q.attempts()} SELECT episode_key, attempt_id, state, stage, third, CAST(usd AS DOUBLE) AS usd FROM attempts"


@sql("jn_01")
def spend_with_episodes(q: Dialect) -> str:
    """Spend beside its episode; one without an episode keeps its row, with nulls."""
    return f"""WITH {q.attempts()}, spend AS (SELECT episode_key, CAST(sum(CASE WHEN state <> 'released' THEN usd ELSE 0 END) AS DOUBLE) AS committed_usd FROM attempts GROUP BY episode_key)
        SELECT s.episode_key, s.committed_usd, c.c_name AS title, n.n_name AS podcast
        FROM spend s LEFT JOIN (SELECT * FROM {q.t("customer")} WHERE c_custkey % 3 <> 0) c ON c.c_custkey = s.episode_key LEFT JOIN {q.t("nation")} n ON n.n_nationkey = c.c_nationkey"""


@sql("jn_02")
def telemetry_sources(q: Dialect) -> str:
    """Episodes with their review record, report and ledger; those with neither record nor report are left out."""
    return f"""WITH {q.attempts()}, {q.cards()},
        resolver AS (SELECT episode_key, count(*) AS cards, {q.sha("CAST(episode_key AS STRING)")} AS fingerprint FROM cards GROUP BY episode_key),
        report AS (SELECT c_custkey AS episode_key, c_acctbal AS score FROM {q.t("customer")} WHERE c_acctbal > 5000),
        ledger AS (SELECT {q.sha("CAST(episode_key AS STRING)")} AS fingerprint, count(*) AS attempts FROM attempts GROUP BY episode_key)
        SELECT e.c_custkey AS episode_key, r.cards, p.score, l.attempts FROM {q.t("customer")} e
        LEFT JOIN resolver r ON r.episode_key = e.c_custkey LEFT JOIN report p ON p.episode_key = e.c_custkey LEFT JOIN ledger l ON l.fingerprint = r.fingerprint
        WHERE r.episode_key IS NOT NULL OR p.episode_key IS NOT NULL"""


@sql("jn_03")
def receipt_status(q: Dialect) -> str:
    """Confirmed if the receipt's digest is the summary's; outdated if not; unconfirmed without one; unavailable without a summary."""
    return f"""WITH summary AS (SELECT doc_id AS episode_key, {q.sha("text")} AS digest FROM {q.t("documents")} WHERE doc_id % 7 <> 0),
        receipts AS (SELECT doc_id AS episode_key, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE {q.sha("text")} END AS digest FROM {q.t("documents")} WHERE doc_id % 3 <> 0)
        SELECT e.doc_id AS episode_key, CASE WHEN s.digest IS NULL THEN 'unavailable' WHEN r.digest IS NULL THEN 'unconfirmed' WHEN r.digest = s.digest THEN 'confirmed' ELSE 'outdated' END AS receipt
        FROM {q.t("documents")} e LEFT JOIN summary s ON s.episode_key = e.doc_id LEFT JOIN receipts r ON r.episode_key = e.doc_id"""
