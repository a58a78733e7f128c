"""Filters, predicates and projections over episodes, cards and tables."""

from __future__ import annotations

from .dialect import Dialect, sql

#: Categories that always need a person.
PROTECTED = "('protocol_number', 'unit', 'negation', 'citation', 'proper_name')"


@sql("flt_01")
def belongs(q: Dialect) -> str:
    """By id if both have one, else by feed, else by name."""
    return f"""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS pid, CASE WHEN o_orderkey % 5 <> 0 THEN 'feed' || CAST(o_custkey AS STRING) END AS feed, 'Customer#' || CAST(o_custkey AS STRING) AS name FROM {q.t("orders")}),
        p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS pid, CASE WHEN c_custkey % 6 <> 0 THEN 'feed' || CAST(c_custkey AS STRING) END AS feed, 'Customer#' || CAST(c_custkey AS STRING) AS name FROM {q.t("customer")}),
        hit AS (SELECT e.o_orderkey, p.k, 'id' AS how FROM e JOIN p ON p.pid = e.pid UNION ALL SELECT e.o_orderkey, p.k, 'feed' FROM e JOIN p ON p.feed = e.feed WHERE e.pid IS NULL OR p.pid IS NULL
                UNION ALL SELECT e.o_orderkey, p.k, 'name' FROM e JOIN p ON p.name = e.name WHERE (e.pid IS NULL OR p.pid IS NULL) AND (e.feed IS NULL OR p.feed IS NULL))
        SELECT o_orderkey, k, how FROM hit"""


@sql("flt_02")
def resumable(q: Dialect) -> str:
    return f"""SELECT o.o_orderkey FROM {q.t("orders")} o {q._("LEFT ANTI JOIN", "ANTI JOIN")} (SELECT l_orderkey FROM {q.t("lineitem")} WHERE l_returnflag = 'R') d ON d.l_orderkey = o.o_orderkey WHERE o.o_orderstatus <> 'F' AND o.o_custkey IS NOT NULL"""


@sql("flt_03")
def export_ready(q: Dialect) -> str:
    return f"SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS ready FROM {q.t('orders')}"


@sql("flt_05")
def enabled(q: Dialect) -> str:
    return f"SELECT c_custkey, c_name FROM {q.t('customer')} WHERE c_acctbal > 0"


@sql("flt_06")
def batch_eligible(q: Dialect) -> str:
    """Low risk all over, and a confident advice for one of the two readings."""
    return f"""WITH {q.cards()} SELECT id, kind IN ('wording_difference', 'transcription_difference') AND severity = 'low' AND category NOT IN {PROTECTED} AND NOT decided AND suggested_source IS NOT NULL AND route <> 'reviewer' AS eligible,
        CASE WHEN kind IN ('wording_difference', 'transcription_difference') AND severity = 'low' AND category NOT IN {PROTECTED} AND NOT decided AND route <> 'reviewer' THEN suggested_source END AS recommendation FROM cards"""


@sql("flt_07")
def assisted_routing(q: Dialect) -> str:
    """All the reasons against a card; it is eligible if there is none."""
    checks = {"decided": "decided", "protected_category": f"category IN {PROTECTED}", "high_severity": "severity = 'high'", "no_advice": "suggested_source IS NULL", "too_long": q.div("m", 5) + " % 20 > 11"}
    reasons = " || ".join(f"CASE WHEN {c} THEN '{name};' ELSE '' END" for name, c in checks.items())
    return f"WITH {q.cards()}, r AS (SELECT id, {reasons} AS reasons FROM cards) SELECT id, reasons, reasons = '' AS eligible FROM r"


@sql("flt_08")
def protected(q: Dialect) -> str:
    return f"WITH {q.cards()} SELECT id, category IN {PROTECTED} OR severity = 'high' OR opened AND kind = 'number_mismatch' AS is_protected FROM cards"


@sql("flt_09")
def queued_episodes(q: Dialect) -> str:
    return f"WITH {q.cards()} SELECT episode_key, count(*) AS cards, count_if(route = 'judge') AS judge, count_if(route = 'reviewer') AS reviewer FROM cards WHERE NOT decided GROUP BY episode_key HAVING count(*) >= 2"


@sql("flt_10")
def prefetch_candidates(q: Dialect) -> str:
    """Cards of tiers B and C with a window and without evidence, 120 of an episode."""
    return f"""WITH {q.cards()}, r AS (SELECT episode_key % 20 AS episode_key, id, tier, row_number() OVER (PARTITION BY episode_key % 20 ORDER BY id) AS rn FROM cards WHERE tier IN ('B', 'C') AND NOT opened AND seconds > 0) SELECT episode_key, id, tier FROM r WHERE rn <= 120"""


@sql("flt_11")
def regeneration_plan(q: Dialect) -> str:
    return f"""WITH {q.attempts()}, s AS (SELECT episode_key, sum(CASE WHEN state <> 'released' THEN usd ELSE 0 END) AS committed FROM attempts GROUP BY episode_key), m AS (SELECT c_custkey AS episode_key, c_nationkey % 3 AS writer, c_nationkey % 2 AS render, c_acctbal < 0 AS no_fill FROM {q.t("customer")})
        SELECT m.episode_key, writer <> 2 AS needs_regeneration, writer = 2 AND no_fill AS needs_fill, writer = 2 AND render <> 1 AS needs_rerender, CAST(12000 - coalesce(s.committed, 0) AS DOUBLE) AS headroom, 12000 - coalesce(s.committed, 0) >= 720 AS fits FROM m LEFT JOIN s ON s.episode_key = m.episode_key"""


@sql("flt_12")
def corpus_eligibility(q: Dialect) -> str:
    """The first reason that fails, in a fixed order."""
    return f"""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_report' WHEN d.n_chars < 300 THEN 'too_short' WHEN d.lang <> 'en' THEN 'other_language' WHEN l.toxic = 1 THEN 'contract_mismatch' WHEN l.quality = 0 THEN 'low_quality' ELSE 'comparable' END AS reason FROM {q.t("documents")} d LEFT JOIN {q.t("labels")} l ON l.doc_id = d.doc_id"""


@sql("flt_13")
def key_expiry(q: Dialect) -> str:
    days = q._("datediff(DATE '1998-07-01', CAST(o_orderdate AS DATE))", "date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-07-01')")
    return f"""WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(-({days}) AS BIGINT) END AS left_days FROM {q.t("orders")})
        SELECT o_orderkey, left_days, CASE WHEN left_days IS NULL THEN 'no_expiry' WHEN left_days <= 0 THEN 'expired' WHEN left_days <= 14 THEN 'expiring' ELSE 'ok' END AS status, coalesce(left_days <= 7, false) AS alert FROM k"""


@sql("flt_14")
def acquisition_due(q: Dialect) -> str:
    """Two days after publication, or at once if the date isn't known; late after ten, told once."""
    now = "TIMESTAMP '1998-07-01 00:00:00'"
    return f"""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS published, o_orderstatus = 'P' AS notified FROM {q.t("orders")})
        SELECT o_orderkey, published IS NULL OR published + INTERVAL '2' DAY <= {now} AS due, coalesce(published + INTERVAL '10' DAY <= {now}, false) AND NOT notified AS late FROM e"""


@sql("flt_15")
def cache_reuse(q: Dialect) -> str:
    """A stored record counts only if policy, preset and fingerprint are all the same, nulls included."""
    return f"""WITH {q.cards()}, want AS (SELECT id, kind, suggested_source, category FROM cards), have AS (SELECT id, kind, suggested_source, CASE WHEN m % 8 = 0 THEN 'changed' ELSE category END AS category FROM cards WHERE decided)
        SELECT w.id, h.id IS NOT NULL AS reusable FROM want w LEFT JOIN have h ON h.id = w.id AND h.kind = w.kind AND h.suggested_source IS NOT DISTINCT FROM w.suggested_source AND h.category = w.category"""


@sql("flt_16")
def anomalies(q: Dialect) -> str:
    """A span that ends before it begins, or 40 words on one side only, goes another way."""
    return f"""WITH {q.turns()}, w AS (SELECT episode_key, id, {q.size(q.words("apple_text"))} AS a, {q.size(q.words("coalesce(whisper_text, '')"))} AS b, id * 10 AS s, CASE WHEN id % 5 = 4 THEN id * 10 - 1 ELSE id * 10 + 4 END AS e FROM turns)
        SELECT episode_key, id, CASE WHEN e < s THEN 'negative_span' WHEN (a = 0 OR b = 0) AND greatest(a, b) >= 40 THEN 'one_sided_long' END AS anomaly FROM w"""


@sql("flt_18")
def validated_triage(q: Dialect) -> str:
    """Advice counts if there is exactly one and it is valid; else the card needs audio."""
    return f"""WITH {q.cards()}, r AS (SELECT id, suggested_source AS advice FROM cards WHERE m % 6 <> 0 UNION ALL SELECT id, chosen_source FROM cards WHERE m % 10 = 0), n AS (SELECT id, count(*) AS n, min(advice) AS advice FROM r GROUP BY id)
        SELECT c.id, CASE WHEN n.n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'duplicate' WHEN n.advice IS NULL OR n.advice NOT IN ('apple', 'whisper') THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN n.n = 1 AND n.advice IN ('apple', 'whisper') THEN n.advice ELSE 'needs_audio' END AS recommendation FROM cards c LEFT JOIN n ON n.id = c.id"""


@sql("flt_19")
def validated_answers(q: Dialect) -> str:
    """The first rule that an answer breaks, or none."""
    return f"""WITH {q.cards()} SELECT id, CASE WHEN chosen_source IS NULL THEN 'no_answer' WHEN tier <> 'A' AND seconds < 30 THEN 'low_confidence' WHEN category = 'other' THEN 'category_mismatch' WHEN chosen_source NOT IN ('apple', 'whisper') THEN 'unsupported_source' WHEN chosen_source <> coalesce(suggested_source, chosen_source) THEN 'text_mismatch' END AS reason FROM cards"""


@sql("flt_20")
def empty_chunks(q: Dialect) -> str:
    return f"SELECT doc_id, n_chars, n_chars >= least(60, 600) AND {q.size(q.words('text'))} = 0 AS fatal FROM {q.t('documents')}"


@sql("flt_21")
def retention(q: Dialect) -> str:
    return f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {q.t("orders")} WHERE o_orderstatus = 'F') SELECT o_custkey, o_orderkey FROM r WHERE rn > 2"""


@sql("flt_22")
def object_paths(q: Dialect) -> str:
    """Exact names or keyed paths; one pattern is enough."""
    hosts = q.find("url", "^https?://([^/?#]+)", 1)
    return f"SELECT page_id, {q.rx('url', '^https://[a-z.]+/en/[0-9]+$')} OR {q.rx('url', '[?&]page=[0-9]+')} AS allowed, {hosts} AS host FROM {q.t('pages')}"


@sql("flt_23")
def exit_status(q: Dialect) -> str:
    return f"WITH {q.cards()} SELECT episode_key, count_if(severity = 'high') > 0 AS fails_on_high, count_if(severity IN ('high', 'medium')) > 0 AS fails_on_medium FROM cards GROUP BY episode_key"


@sql("flt_24")
def current_evidence(q: Dialect) -> str:
    """Stored evidence is current if the identity recomputed now is the one it was stored under."""
    now = q.sha("kind || '|' || category || '|' || CAST(id AS STRING)")
    return f"WITH {q.cards()}, s AS (SELECT id, {now} AS now_id, CASE WHEN m % 6 = 0 THEN 'stale' ELSE {now} END AS stored_id FROM cards) SELECT id, stored_id = now_id AS is_current FROM s"


@sql("flt_25")
def work_lists(q: Dialect) -> str:
    return f"""WITH {q.cards()}, n AS (SELECT episode_key, count_if(NOT decided) AS pending, count_if(decided) AS decided FROM cards GROUP BY episode_key)
        SELECT c.c_custkey AS episode_key, coalesce(n.pending, 0) AS pending, coalesce(n.decided, 0) AS decided, c.c_mktsegment = 'HOUSEHOLD' AS producer_outdated FROM {q.t("customer")} c LEFT JOIN n ON n.episode_key = c.c_custkey WHERE c.c_acctbal > 0"""


@sql("flt_26")
def registry_integrity(q: Dialect) -> str:
    """Forms that more than one entry claims."""
    return f"""WITH forms AS (SELECT lower(p_name) AS form, p_partkey, 'canonical' AS role FROM {q.t("part")} UNION ALL SELECT lower(p_type || ' ' || p_brand), p_partkey, 'alias' FROM {q.t("part")})
        SELECT form, count(DISTINCT p_partkey) AS entries, count(*) FILTER (WHERE role = 'alias') AS aliases FROM forms GROUP BY form HAVING count(DISTINCT p_partkey) > 1"""


@sql("flt_27")
def text_rules(q: Dialect) -> str:
    """The labels of all the rules that a text meets."""
    rules = {"token": "token = .[0-9a-f]{40}", "email": "[a-z0-9.]+@[a-z0-9.]+", "ip": "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "licence": "[Ll]icen[sc]ed"}
    return f"SELECT doc_id, {' || '.join(f'CASE WHEN {q.rx("text", p)} THEN {chr(39)}{name};{chr(39)} ELSE {chr(39)}{chr(39)} END' for name, p in rules.items())} AS problems FROM {q.t('documents')}"


@sql("prj_01")
def normalised_record(q: Dialect) -> str:
    """Defaults for what is missing; states derived from what is there; other versions rejected."""
    return f"""SELECT o_orderkey AS episode_key, CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 3 END AS schema_version, o_orderkey % 13 <> 0 AS accepted, coalesce(NULLIF(o_orderpriority, '4-NOT SPECIFIED'), 'normal') AS priority,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'ready' ELSE 'pending' END AS download_state, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'blocked' END AS compiler_state FROM {q.t("orders")}"""


@sql("prj_02")
def paths(q: Dialect) -> str:
    key = "CAST(o_orderkey AS STRING)"
    return f"SELECT o_orderkey, 'episodes/' || {key} || '/sources/apple.txt' AS apple_text, 'episodes/' || {key} || '/review/resolver.json' AS resolver, 'episodes/' || {key} || '/compiled/report.json' AS report FROM {q.t('orders')}"


@sql("prj_03")
def dashboard_row(q: Dialect) -> str:
    """One row an episode; what can't be read is unavailable, not zero."""
    return f"""WITH {q.cards()}, n AS (SELECT episode_key, count_if(NOT decided) AS pending FROM cards GROUP BY episode_key) SELECT c.c_custkey AS episode_key, substr(c.c_name, 1, 12) AS title, CASE WHEN n.episode_key IS NULL THEN 'unavailable' WHEN n.pending = 0 THEN 'done' ELSE 'waiting' END AS review, n.pending,
        CASE WHEN c.c_acctbal < 0 THEN 'blocked' WHEN c.c_acctbal < 2000 THEN 'queued' WHEN n.pending > 0 THEN 'in_review' ELSE 'delivered' END AS delivery FROM {q.t("customer")} c LEFT JOIN n ON n.episode_key = c.c_custkey"""


@sql("prj_04")
def repaired_urls(q: Dialect) -> str:
    return f"SELECT page_id, {q.rr(q.rr('url', '#.*$', ''), '^http://', 'https://')} AS canonical, {q.find('url', '^https?://([^/?#]+)', 1)} AS host FROM {q.t('pages')}"


@sql("prj_05")
def front_matter(q: Dialect) -> str:
    """Lines in a fixed order; what is null or empty leaves none."""
    line = lambda name, x: f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE '{name}: ' || {x} || ';' END"
    return f"SELECT o_orderkey, {line('title', 'CAST(o_orderkey AS STRING)')} || {line('published', 'CAST(CAST(o_orderdate AS DATE) AS STRING)')} || {line('status', chr(78) + 'ULLIF(o_orderstatus, ' + chr(39) + 'P' + chr(39) + ')')} || {line('priority', 'o_orderpriority')} AS front FROM {q.t('orders')}"


@sql("prj_06")
def sparse_update(q: Dialect) -> str:
    """A field that the update names replaces the old one, null too; a new transcript makes the compiler ready and clears a deferral."""
    return f"""WITH old AS (SELECT o_orderkey AS k, o_orderpriority AS transcript, o_orderstatus AS state, o_orderkey % 4 = 0 AS deferred FROM {q.t("orders")}), upd AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS has_transcript, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'new' END AS transcript FROM {q.t("orders")} WHERE o_orderkey % 2 = 0)
        SELECT old.k, CASE WHEN upd.has_transcript THEN upd.transcript ELSE old.transcript END AS transcript, CASE WHEN upd.has_transcript AND upd.transcript IS NOT NULL THEN 'ready' WHEN upd.has_transcript THEN 'blocked' ELSE old.state END AS compiler, old.deferred AND NOT coalesce(upd.has_transcript, false) AS deferred FROM old LEFT JOIN upd ON upd.k = old.k"""


@sql("prj_07")
def review_cards(q: Dialect) -> str:
    return f"""WITH {q.cards()}, resolver AS (SELECT id, chosen_source AS resolved FROM cards WHERE m % 4 = 0), triage AS (SELECT id, suggested_source AS advice FROM cards WHERE m % 3 = 0) SELECT c.id, c.kind, c.severity, c.category, t.advice, c.seconds > 80 AS anomaly FROM cards c LEFT JOIN resolver r ON r.id = c.id LEFT JOIN triage t ON t.id = c.id WHERE r.resolved IS NULL AND NOT c.decided"""


@sql("prj_08")
def pending_cards(q: Dialect) -> str:
    return f"WITH {q.cards()} SELECT episode_key, id, CASE WHEN suggested_source IS NULL THEN 'unassisted' WHEN severity = 'high' THEN 'excluded' ELSE 'ready' END AS assisted_state, row_number() OVER (PARTITION BY episode_key ORDER BY id) AS place FROM cards WHERE NOT decided"


@sql("prj_09")
def anonymous(q: Dialect) -> str:
    """Labels without a provider's name; sides swap with the id's parity."""
    return f"WITH {q.cards()} SELECT id, CASE WHEN kind IN ('whisper_omission', 'whisper_addition') THEN 'source_only_difference' ELSE kind END AS kind, CASE WHEN id % 2 = 1 THEN 'B' ELSE 'A' END AS apple_side FROM cards"


@sql("prj_11")
def bounded_payload(q: Dialect) -> str:
    w = q._("slice(array_distinct(ws), 1, 8)", "list_slice(list_sort(list_distinct(ws)), 1, 8)")
    w = q._("slice(sort_array(array_distinct(ws)), 1, 8)", w)
    return f"WITH d AS (SELECT doc_id, {q.words('text')} AS ws FROM {q.t('documents')}) SELECT doc_id, {q.join(w, ',')} AS tags FROM d"


@sql("prj_12")
def anchored_units(q: Dialect) -> str:
    """One row for each unit of a note, from each of its lists."""
    return f"SELECT conv_id, 'bullet' AS unit, text FROM {q.t('conversations')} WHERE role = 'user' UNION ALL SELECT conv_id, 'protocol', role || ' ' || text FROM {q.t('conversations')} WHERE role = 'assistant' UNION ALL SELECT item_id, 'study', text FROM {q.t('benchmark')}"


@sql("prj_13")
def report_counts(q: Dialect) -> str:
    return f"WITH {q.cards()} SELECT episode_key, count_if(severity IN ('high', 'medium')) AS risk_candidates, count_if(NOT decided) AS review_required FROM cards GROUP BY episode_key"


@sql("prj_14")
def checkpoint_lines(q: Dialect) -> str:
    t = " UNION ALL ".join(f"SELECT {n} AS threshold" for n in (100, 1000, 100000))
    return f"WITH n AS (SELECT count(DISTINCT o_custkey) AS n FROM {q.t('orders')}), t AS ({t}) SELECT threshold, CASE WHEN threshold <= 100 THEN 'ACCEPTED' WHEN n >= threshold THEN 'REACHED' ELSE CAST(n AS STRING) || ' of ' || CAST(threshold AS STRING) END AS line FROM t JOIN n ON true"


def episode_index(q: Dialect) -> str:
    return f"SELECT o_orderkey AS episode_key, o_custkey AS podcast_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published, coalesce(o_orderstatus, 'pending') AS state FROM {q.t('orders')}"


def keyed_reads(q: Dialect) -> str:
    return f"SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NULL AS absent FROM {q.t('documents')} d LEFT JOIN {q.t('labels')} l ON l.doc_id = d.doc_id"


def whole_texts(q: Dialect) -> str:
    return f"SELECT doc_id, length(text) AS n, {q.sha('text')} AS digest FROM {q.t('documents')}"


def lexicon(q: Dialect) -> str:
    return f"SELECT DISTINCT 'exercise' AS kind, lower(trim(p_name)) AS term FROM {q.t('part')} UNION SELECT DISTINCT 'unit', lower(p_type) FROM {q.t('part')}"


def golden_cases(q: Dialect) -> str:
    """Groups of provenance must not stand in two partitions."""
    return f"SELECT source, count(*) AS cases, count(DISTINCT lang) AS partitions, count(DISTINCT lang) = 1 AS clean FROM {q.t('documents')} GROUP BY source"


def bibliography(q: Dialect) -> str:
    return f"SELECT p_partkey, p_name AS title, least(1.0, p_size / 40.0) AS score, 'first' AS provider FROM {q.t('part')} UNION ALL SELECT p_partkey, p_name, CAST(NULL AS DOUBLE), 'second' FROM {q.t('part')} WHERE p_size > 25".replace("p_size / 40.0", "CAST(p_size AS DOUBLE) / 40").replace("1.0,", "CAST(1 AS DOUBLE),")


def changed_only(q: Dialect) -> str:
    return f"""WITH fresh AS (SELECT doc_id, {q.sha("text")} AS digest FROM {q.t("documents")}), stored AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE {q.sha("text")} END AS digest FROM {q.t("documents")} WHERE doc_id % 3 <> 0) SELECT f.doc_id, f.digest FROM fresh f LEFT JOIN stored s ON s.doc_id = f.doc_id AND s.digest = f.digest WHERE s.doc_id IS NULL"""


def vault_export(q: Dialect) -> str:
    return f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) || ' ' || {q.rr('o_orderpriority', '[^A-Za-z0-9]+', '-')} || '.md' AS file_name, {q.sha('CAST(o_orderkey AS STRING)')} AS digest FROM {q.t('orders')} WHERE o_orderstatus IN ('F', 'P')"


@sql("sm_04")
def stage_machine(q: Dialect) -> str:
    """The next stage of each episode, from those that are done since its last failure; a deferral long ago is told."""
    last = lambda kind: f"max(CASE WHEN event_type = '{kind}' THEN event_id END)"
    done = lambda kind: f"coalesce({last(kind)} > coalesce({last('error')}, -1), false)"
    return f"""WITH s AS (SELECT user_id, {done("signup")} AS transcribed, {done("click")} AS acquired, {done("view")} AS compiled, {done("purchase")} AS reviewed, {last("error")} AS deferred_at, max(event_id) AS newest FROM {q.t("events")} GROUP BY user_id)
        SELECT user_id, CASE WHEN NOT transcribed THEN 'transcribe' WHEN NOT acquired THEN 'acquire' WHEN NOT compiled THEN 'compile' WHEN NOT reviewed THEN 'review' ELSE 'note' END AS next_stage, coalesce(newest - deferred_at > 300, false) AS deferred_long FROM s"""


@sql("sm_05")
def late_once(q: Dialect) -> str:
    """One notice for an episode, at its first late event; the first deferral is kept."""
    return f"SELECT user_id, min(event_id) AS noticed_at, CAST(min(ts) AS STRING) AS first_seen FROM {q.t('events')} WHERE event_type = 'error' GROUP BY user_id"


@sql("sm_07")
def atomic_batches(q: Dialect) -> str:
    """A batch of decisions is applied if all of them are valid, else none."""
    return f"WITH {q.cards()} SELECT episode_key, grp, count(*) AS decisions, bool_and(chosen_source IS NOT NULL) AS applied, count_if(chosen_source IS NULL) AS invalid FROM cards WHERE decided GROUP BY episode_key, grp"


@sql("sm_09")
def recompile_lifecycle(q: Dialect) -> str:
    return f"""WITH r AS (SELECT user_id, {q.div("event_id", 1000)} AS request, event_type, row_number() OVER (PARTITION BY user_id, {q.div("event_id", 1000)} ORDER BY event_id DESC) AS rn FROM {q.t("events")}) SELECT user_id, request, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'requested' ELSE 'running' END AS status FROM r WHERE rn = 1"""


@sql("wn_13")
def newest_request(q: Dialect) -> str:
    return f"""SELECT user_id, {q.argmax("event_type", ["event_id"])} AS newest, {q._("max_by(event_type, event_id) FILTER (WHERE event_type IN ('error', 'signup'))", "arg_max(event_type, event_id) FILTER (WHERE event_type IN ('error', 'signup'))")} AS blocking FROM {q.t("events")} GROUP BY user_id"""
