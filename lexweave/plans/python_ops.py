"""Queries whose logic SQL can't express: Python over Arrow batches, no shuffle of its own but for folds over a key."""

from __future__ import annotations

import re
from collections import deque, namedtuple
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import differences as diffs
from ..functions import ledger, materiality, notes, numbers, rules, sequences, tokens
from ..functions.terms import Registry, Terms
from .registry import query

Source = Callable[[SparkSession, str], DataFrame]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn as one reading; as the other, the same without a word in about fifteen."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select(F.col("conv_id").alias("episode_key"), F.col("turn").alias("id"), F.coalesce("text", F.lit("")).alias("apple"), F.regexp_replace(F.coalesce("text", F.lit("")), r" [b-z]*o[a-z]n[a-z]*(?=[ .])", "").alias("whisper"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the turns, each beside the next one of its turn as another reading, with what a third source heard."""
    t = turns(spark, sf_dir).select("episode_key", "id", F.posexplode(F.split("apple", r"(?<=\.)\s+")).alias("part", "apple"))
    w = Window.partitionBy("episode_key", "id").orderBy("part")
    drop = F.regexp_replace("apple", r"(?<= )(?:the|of|and|a) ", "")
    other = F.when(F.col("part") % 3 == 0, drop).when(F.col("part") % 3 == 1, F.lead("apple").over(w)).otherwise(F.lower("apple"))
    return t.select("episode_key", "id", "part", "apple", F.coalesce(other, F.lit("")).alias("whisper"), F.when(F.col("part") % 2 == 0, drop).alias("third"), F.coalesce(F.lag("apple").over(w), F.lit("")).alias("before"), F.coalesce(F.lead("apple", 2).over(w), F.lit("")).alias("after"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as one text, and the same without the first word of each sentence."""
    t = turns(spark, sf_dir).groupBy("episode_key").agg(F.sort_array(F.collect_list(F.struct("id", "apple"))).alias("t"))
    text = lambda c: F.array_join(F.transform("t", lambda x: x[c]), " ")
    return t.select("episode_key", F.lit(0).cast("long").alias("id"), text("apple").alias("apple"), F.regexp_replace(text("apple"), r"(?<=[.] )[A-Za-z]+ ", "").alias("whisper"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def labels_on_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a quantity, one for each part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    unit = F.element_at(F.array(*map(F.lit, ("kg", "pounds", "grams", "percent", "minutes", "ml", "calories"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    text = F.concat(F.lit("Take "), F.col("p_size").cast("string"), F.lit(" "), unit, F.lit(" of "), F.col("p_name"), F.lit(" as said in "), (F.col("p_partkey") % 300 + 1850).cast("string"), F.lit(", then twenty five kilograms."))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def benchmark_terms(spark: SparkSession, sf_dir: str) -> list[str]:
    """The registry: all longer words of the benchmark's texts, however many."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    w = b.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).filter(F.length("w") >= 6).distinct()
    return sorted(r["w"] for r in w.collect())


def _in_batches(source: DataFrame, schema: str, made: Callable[[], Callable[[tuple], Iterable[tuple]]]) -> DataFrame:
    """Rows of ``schema`` from a function of a row, which is made once in each task."""
    kinds = T.StructType.fromDDL(schema)
    columns = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, arrow, row = made(), to_arrow_schema(kinds), namedtuple("Row", columns)
        for batch in batches:
            found = [out for r in map(row._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)) for out in f(r)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], field.type) for i, field in enumerate(arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def rows(name: str, schema: str, source: Source = turns) -> Callable:
    """Register ``f(row) -> rows`` over a source. The row is a named tuple; results are tuples of the schema."""

    def keep(f: Callable) -> Callable:
        query(name)(lambda spark, sf_dir: _in_batches(source(spark, sf_dir), schema, lambda: f))
        return f

    return keep


_KEY = "episode_key long, id long"


@rows("sc_03", f"{_KEY}, value string, original string, start_at int, end_at int")
def tokenized(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, *t) for t in tokens.tokenize(r.apple)]


@rows("sc_05", "doc_id long, numbers string", documents)
def spoken_numbers(r) -> Iterable[tuple]:
    return [(r.doc_id, " ".join(numbers.numbers(tokens.words(r.text))))]


@rows("sc_06", f"{_KEY}, part long, equivalent boolean", spans)
def numeric_equivalence(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, r.part, numbers.numeric_or_unit_equivalent(tokens.words(r.apple), tokens.words(r.whisper)))]


@rows("sc_07", "doc_id long, units string", documents)
def units_near_numbers(r) -> Iterable[tuple]:
    return [(r.doc_id, ",".join(sorted(numbers.measurement_units(tokens.words(r.text)))))]


@rows("sc_11", f"{_KEY}, similarity double")
def similarity(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, sequences.ratio(tokens.words(r.apple), tokens.words(r.whisper)))]


@rows("sc_12", f"{_KEY}, part long, distance int", spans)
def token_distance(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, r.part, sequences.edit_distance(tokens.words(r.apple), tokens.words(r.whisper)))]


@rows("sc_13", "doc_id long, form string", documents)
def number_forms(r) -> Iterable[tuple]:
    return [(r.doc_id, " ".join(w for w in numbers.number_form(r.text) if not w.isalpha()))]


@rows("sc_14", "doc_id long, n_values long, values_said string", documents)
def values_said(r) -> Iterable[tuple]:
    v = numbers.number_values(r.text)
    return [(r.doc_id, len(v), " ".join(v))]


@rows("sc_23", "doc_id long, at int, value string, unit string", labels_on_parts)
def unit_mentions(r) -> Iterable[tuple]:
    return [(r.doc_id, at, str(v), u) for at, v, u in notes.quantity_mentions(r.text)]


@rows("sc_24", f"{_KEY}, part long, at int, fuzzy boolean", spans)
def anchor_places(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, r.part, *notes.locate(r.before + " " + r.apple, r.whisper))]


@rows("sc_31", f"{_KEY}, errors string")
def schema_paths(r) -> Iterable[tuple]:
    schema = {"type": "object", "required": ["text", "kind"], "properties": {"text": {"type": "string"}, "kind": {"type": "string", "enum": ["a", "b"]}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string"}}}}
    value = {"text": r.apple, "tags": tokens.words(r.apple)[:3]} | ({"kind": "ab"[r.id % 2]} if r.id % 3 else {}) | ({"more": 1} if r.id % 4 == 3 else {})
    return [(r.episode_key, r.id, ";".join(notes.schema_errors(value, schema)))]


@rows("sc_38", f"{_KEY}, part long, slice string", spans)
def expanded_edit(r) -> Iterable[tuple]:
    """A token's span with at most three words more to each side, exactly as written."""
    t = tokens.tokenize(r.apple)
    if len(t) < 3:
        return []
    i, left, right = len(t) // 2, min(3, len(t) // 2), min(3, len(t) - len(t) // 2 - 1)
    return [(r.episode_key, r.id, r.part, r.apple[t[i - left].start : t[i + right].end])]


@rows("wn_09", f"{_KEY}, a int, b int")
def rising_anchors(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, i, j) for i, j in sequences.anchors(tokens.words(r.apple), tokens.words(r.whisper), 5)]


@rows("al_01", f"{_KEY}, tag string, i1 int, i2 int, j1 int, j2 int")
def aligned(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, *c) for c in sequences.opcodes(tokens.words(r.apple), tokens.words(r.whisper))]


@rows("al_02", f"{_KEY}, part long, tag string, i1 int, i2 int, j1 int, j2 int", spans)
def globally_aligned(r) -> Iterable[tuple]:
    """Opcodes of the whole words; a window too large for the matrix has one row that says so."""
    found = sequences.global_opcodes(tokens.words(r.apple), tokens.words(r.whisper))
    return [(r.episode_key, r.id, r.part, *c) for c in ([("skipped_window_too_large", None, None, None, None)] if found is None else found)]


@rows("al_03", f"{_KEY}, region int, i1 int, i2 int, j1 int, j2 int, reason string")
def diagnostic_regions(r) -> Iterable[tuple]:
    """The first twenty regions of change, with why they are looked at."""
    groups = sequences.edit_groups(sequences.opcodes(tokens.words(r.apple), tokens.words(r.whisper)), 12)[:20]
    return [(r.episode_key, r.id, k, *g, "one_sided" if g[0] == g[1] or g[2] == g[3] else "long" if g[1] - g[0] > 20 else "mixed") for k, g in enumerate(groups)]


@rows("al_04", f"{_KEY}, mapped long, unmapped long")
def mapped_words(r) -> Iterable[tuple]:
    a = tokens.words(r.apple)
    m = sequences.word_map(a, tokens.words(r.whisper))
    return [(r.episode_key, r.id, len(m), len(a) - len(m))]


@rows("al_05", f"{_KEY}, coverage double, attached long")
def reattached_metadata(r) -> Iterable[tuple]:
    """Times of one reading's words for the other's; nothing if fewer than 95 in a hundred are aligned."""
    a, b = tokens.words(r.apple), tokens.words(r.whisper)
    n = len(sequences.word_map(b, a))
    share = n / len(b) if b else 0.0
    return [(r.episode_key, r.id, share, n if share >= 0.95 else 0)]


def _differences(a_text: str, b_text: str) -> list[tuple[int, int, int, int, str, str]]:
    a, b = tokens.words(a_text), tokens.words(b_text)
    return [(*g, *rules.classify(a[g[0] : g[1]], b[g[2] : g[3]])) for g in sequences.edit_groups(sequences.opcodes(a, b))]


@rows("al_06", f"{_KEY}, kind string, severity string, n long")
def classified(r) -> Iterable[tuple]:
    count: dict[tuple, int] = {}
    for *_, kind, severity in _differences(r.apple, r.whisper):
        count[kind, severity] = count.get((kind, severity), 0) + 1
    return [(r.episode_key, r.id, *k, n) for k, n in sorted(count.items())]


@rows("al_09", f"{_KEY}, consensus string, edits long")
def consensus(r) -> Iterable[tuple]:
    """The second reading, with what only the first one has put back."""
    a, b = tokens.tokenize(r.apple), tokens.tokenize(r.whisper)
    edits = []
    for i1, i2, j1, j2, _, _ in _differences(r.apple, r.whisper):
        if j1 == j2:
            at = b[j1].start if j1 < len(b) else len(r.whisper)
            edits.append((at, at, r.apple[a[i1].start : a[i2 - 1].end]))
    return [(r.episode_key, r.id, rules.splice(r.whisper, edits), len(edits))]


@rows("al_10", f"{_KEY}, applied long, rejected long, resolved string")
def resolutions(r) -> Iterable[tuple]:
    """Answers are applied only where the text they name still stands at its place."""
    b, edits, bad = tokens.tokenize(r.whisper), [], 0
    for k, (i1, i2, j1, j2, _, _) in enumerate(_differences(r.apple, r.whisper)):
        if j1 < j2 and k % 2 == 0:
            edits.append((b[j1].start, b[j2 - 1].end, " ".join(tokens.words(r.apple)[i1:i2])))
        else:
            bad += 1
    return [(r.episode_key, r.id, len(edits), bad, rules.splice(r.whisper, edits))]


@rows("al_11", f"{_KEY}, part long, route string, reason string", spans)
def routed(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, r.part, *materiality.verdict(r.apple, r.whisper, r.before, r.after))]


@rows("al_13", f"{_KEY}, part long, tier string, reason string, source string", spans)
def tiers(r) -> Iterable[tuple]:
    triage = (None, "apple", "whisper")[(r.id + r.part) % 3]
    return [(r.episode_key, r.id, r.part, *rules.tier(r.apple, r.whisper, r.third, triage, r.part % 5 == 0))]


@rows("al_14", f"{_KEY}, part long, state string, reason string, recommendation string", spans)
def assisted(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, r.part, *rules.assisted_state(r.apple, r.whisper, r.third, "apple" if r.part % 2 else None, r.part % 4 == 1))]


@rows("al_16", f"{_KEY}, part long, units long, outcomes string", spans)
def note_fill(r) -> Iterable[tuple]:
    w = r.apple.split()
    units, told = notes.apply_fill([r.apple, r.whisper], [(1, "add", None, r.apple), (1, "skip", None, ""), (2, "extend", len(w) % 3, r.apple + " 5"), (3, "add", None, "short")])
    return [(r.episode_key, r.id, r.part, len(units), ",".join(told))]


@rows("ag_16", f"{_KEY}, matched long, apple_words long, whisper_words long, similarity double, high long, medium long, low long")
def report_metrics(r) -> Iterable[tuple]:
    a, b = tokens.words(r.apple), tokens.words(r.whisper)
    matched = sequences.metrics(sequences.opcodes(a, b))[0]
    s = [d[5] for d in _differences(r.apple, r.whisper)]
    return [(r.episode_key, r.id, matched, len(a), len(b), 2 * matched / max(1, len(a) + len(b)), s.count("high"), s.count("medium"), s.count("low"))]


@rows("ag_17", f"{_KEY}, matched long, blocks long, apple_changed long, whisper_changed long, longest long")
def opcode_metrics(r) -> Iterable[tuple]:
    return [(r.episode_key, r.id, *sequences.metrics(sequences.opcodes(tokens.words(r.apple), tokens.words(r.whisper))))]


@rows("tk_07", f"{_KEY}, part long, score_num long, score_den long, distance long, start_at long, length long", spans)
def nearest_window(r) -> Iterable[tuple]:
    s, d, i, n = sequences.best_window(tokens.words(r.apple), tokens.words(r.before + " " + r.whisper))
    return [(r.episode_key, r.id, r.part, s.numerator, s.denominator, d, i, n)]


@rows("jn_17", f"{_KEY}, part long, window_text string", spans)
def anchored_window(r) -> Iterable[tuple]:
    """What a third source has between the words that stand right before and after the span, three of them, else two; no tie."""
    left, mid, right = tokens.words(r.before), tokens.words(r.apple), tokens.words(r.whisper)
    third = left[-6:] + mid + right[:6]
    for n in (3, 2):
        a, b = left[-n:], right[:n]
        ends = [j for j in range(len(third)) if b and third[j : j + len(b)] == b]
        found = [(abs(j - i - len(a) - len(mid)), i + len(a), j) for i in range(len(third)) if a and third[i : i + len(a)] == a for j in ends if j >= i + len(a)]
        best = sorted(found)
        if best and (len(best) == 1 or best[0][0] != best[1][0]):
            return [(r.episode_key, r.id, r.part, " ".join(third[best[0][1] : best[0][2]]))]
    return []


@rows("jn_19", f"{_KEY}, focus string, at int, place string, n long", episodes)
def corroboration(r) -> Iterable[tuple]:
    """Where a disputed word stands in regions on which both readings agree: before or after the dispute, the first five."""
    a = tokens.words(r.apple)
    codes = sequences.opcodes(a, tokens.words(r.whisper))
    agreed: dict[str, list[int]] = {}
    for t, x1, x2, _, _ in codes:
        for k in range(x1, x2) if t == "equal" else ():
            agreed.setdefault(a[k], []).append(k)
    out = []
    for t, i1, i2, _, _ in codes:
        if t != "equal" and i1 < i2:
            found = agreed.get(a[i1], [])[:5]
            out += [(r.episode_key, r.id, a[i1], i1, place, n) for place, n in (("before", sum(k < i1 for k in found)), ("after", sum(k >= i2 for k in found))) if n]
    return out


@rows("flt_17", f"{_KEY}, kept long, reasons string, rejected boolean")
def note_checks(r) -> Iterable[tuple]:
    units = [(s, s) for s in re.split(r"(?<=\.)\s+", r.whisper)]
    kept, reasons, rejected = notes.check_units(units, r.apple)
    return [(r.episode_key, r.id, len(kept), ",".join(sorted(reasons)), rejected)]


@lru_cache(maxsize=1)
def _registry(kind: type[Registry], known: tuple[str, ...]) -> Registry:
    """A registry, which a worker keeps for its later tasks."""
    return kind(known)


@lru_cache(maxsize=1)
def _categories(terms: Terms) -> dict[str, str]:
    """A term's category follows from its first letter, as the analog's registry has none."""
    return {t: diffs.GLOSSARY_CATEGORIES[ord(t[0]) % len(diffs.GLOSSARY_CATEGORIES)] for t in terms.terms}


def _with_terms(name: str, schema: str, source: Source, kind: type[Registry] = Terms) -> Callable:
    """Like ``rows``, with the whole registry as a second argument: to search, or the plain list of its terms."""

    def keep(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            known = tuple(benchmark_terms(spark, sf_dir))

            def made() -> Callable:
                terms = _registry(kind, known)
                return lambda row: f(row, terms)

            return _in_batches(source(spark, sf_dir), schema, made)

        query(name)(run)
        return f

    return keep


def _changed(r) -> tuple[list[str], list[str]]:
    """The words of each reading that the other lacks."""
    a, b = tokens.words(r.apple), tokens.words(r.whisper)
    codes = [c for c in sequences.opcodes(a, b) if c[0] != "equal"]
    return [w for _, i, j, _, _ in codes for w in a[i:j]], [w for *_, i, j in codes for w in b[i:j]]


@_with_terms("jn_11", f"{_KEY}, part long, term string", spans)
def glossary_matches(r, terms: Terms) -> Iterable[tuple]:
    """Terms in a sentence of which a word that the other reading lacks is a part."""
    a, b = _changed(r)
    found = dict.fromkeys([*terms.of_difference(a, tokens.words(r.apple)), *terms.of_difference(b, tokens.words(r.whisper))])
    return [(r.episode_key, r.id, r.part, t) for t in found]


@_with_terms("tk_02", f"{_KEY}, part long, place long, term string, score double, apple_score double, whisper_score double", spans)
def best_terms(r, terms: Terms) -> Iterable[tuple]:
    return [(r.episode_key, r.id, r.part, k, *t) for k, t in enumerate(terms.top(*_changed(r)), 1)]


@_with_terms("tk_03", f"{_KEY}, part long, terms string", spans)
def glossary_candidates(r, terms: Terms) -> Iterable[tuple]:
    return [(r.episode_key, r.id, r.part, ",".join(terms.both(tokens.words(r.apple), tokens.words(r.whisper))))]


@_with_terms("prj_10", f"{_KEY}, part long, scope string, focus string", spans)
def resolver_focus(r, terms: Terms) -> Iterable[tuple]:
    """The word of a span that is nearest to a term, or all of the span."""
    word = terms.focus(tokens.words(r.apple))
    return [(r.episode_key, r.id, r.part, "partial", word) if word else (r.episode_key, r.id, r.part, "full", r.apple)]


@_with_terms("al_12", f"{_KEY}, part long, source string, step string", spans, Registry)
def chosen_reading(r, terms: Registry) -> Iterable[tuple]:
    votes = [("apple", "whisper")[(r.id + r.part * k) % 2] for k in (1, 2, 3)]
    reason = materiality.verdict(r.apple, r.whisper, r.before, r.after)[1]
    return [(r.episode_key, r.id, r.part, *materiality.choose(r.apple, r.whisper, reason, r.third, terms.spellings, votes))]


@_with_terms(
    "al_07", f"{_KEY}, part long, diff int, a_from int, a_to int, b_from int, b_to int, kind string, severity string, category string, apple_text string, whisper_text string, similarity double, "
    "domain_terms string, citation_signal boolean, source_only string, risk_reasons string, repetition boolean", spans,
)
def built_differences(r, terms: Terms) -> Iterable[tuple]:
    """All differences."""
    return [
        (r.episode_key, r.id, r.part, d.id, d.apple_start, d.apple_end, d.whisper_start, d.whisper_end, d.kind, d.severity, d.category, d.apple_text, d.whisper_text, d.similarity, ",".join(d.domain_terms), d.citation_signal, d.source_only, ",".join(d.risk_reasons), d.repetition)
        for d in diffs.differences(r.apple, r.whisper, terms, _categories(terms))
    ]


def _fold(name: str, schema: str, sql: str | None = None) -> Callable:
    """Register a fold over each user's events in order: ``f()`` gives a function of an event, with a fresh state for each user. The
    shuffle sorts; a task holds one user's state and one batch, however many events a user has."""

    def keep(f: Callable[[], Callable]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), F.get_json_object("props", "$.k").cast("long").alias("k"))

            def made() -> Callable:
                user, step = object(), None

                def one(r) -> Iterable[tuple]:
                    nonlocal user, step
                    if r.user_id != user:
                        user, step = r.user_id, f()
                    return [(r.user_id, r.event_id, *step(r))]

                return one

            return _in_batches(e.repartition("user_id").sortWithinPartitions("user_id", "event_id"), schema, made)

        query(name, sql)(run)
        return f

    return keep


#: Events of a user in order, as the checks on the folds walk through them.
_STEPS = "SELECT user_id, event_id, event_type, CAST(value AS DECIMAL(18,2)) AS value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events"


@_fold(
    "sm_01", "user_id long, event_id long, outcome string, committed string",
    f"""WITH RECURSIVE e AS ({_STEPS}), s AS (
        SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS rn, '' AS outcome, CAST(0 AS DECIMAL(18,2)) AS total, CAST(0 AS DECIMAL(18,2)) AS third FROM e WHERE rn = 1
        UNION ALL
        SELECT user_id, event_id, rn, outcome, CAST(CASE WHEN outcome = 'admitted' THEN total + value ELSE total END AS DECIMAL(18,2)), CAST(CASE WHEN outcome = 'admitted' AND is_third THEN third + value ELSE third END AS DECIMAL(18,2))
        FROM (SELECT e.user_id, e.event_id, e.rn, e.value, e.k % 7 = 0 AS is_third, s.total, s.third,
                     CASE WHEN e.value <= 0 THEN 'conflict' WHEN s.total + e.value > 1600 OR e.k % 7 = 0 AND s.third + e.value > 100 OR s.third > 100 THEN 'refused' ELSE 'admitted' END AS outcome
              FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1) x)
        SELECT user_id, event_id, outcome, CAST(total AS VARCHAR) AS committed FROM s WHERE rn > 0""",
)
def admission() -> Callable:
    """Requests in order against one ledger; the caps are times 1,000, as these values are."""
    state = ledger.new_state()

    def step(r) -> tuple:
        got = ledger.reserve(state, [(str(r.event_id), r.value, r.k is not None and r.k % 7 == 0)], Decimal(0), ledger.CAP * 1000, ledger.THIRD_CAP * 1000)
        return got, f"{ledger.committed(state):.2f}"

    return step


@_fold("sm_02", "user_id long, event_id long, step string")
def attempt_states() -> Callable:
    state, open_ = ledger.new_state(), deque()
    how = {"purchase": "settled", "view": "uncertain", "error": "released"}

    def step(r) -> tuple:
        if r.event_type in how and open_:
            return (ledger.finish(state, open_.popleft(), how[r.event_type], r.value),)
        open_.append(str(r.event_id))
        return (ledger.reserve(state, [(str(r.event_id), r.value, False)], Decimal(0), Decimal(10**9)),)

    return step


@_fold(
    "sm_03", "user_id long, event_id long, owner string, got boolean",
    f"""WITH RECURSIVE e AS ({_STEPS}), s AS (
        SELECT user_id, event_id, rn, event_type AS owner, CAST(event_id AS DOUBLE) + 600 AS until, true AS got FROM e WHERE rn = 1
        UNION ALL
        SELECT user_id, event_id, rn, CASE WHEN got THEN event_type ELSE owner END, CASE WHEN got THEN CAST(event_id AS DOUBLE) + 600 ELSE until END, got
        FROM (SELECT e.*, s.owner, s.until, s.until <= e.event_id OR s.owner = e.event_type AS got FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1) x)
        SELECT user_id, event_id, owner, got FROM s""",
)
def leases() -> Callable:
    owner = None

    def step(r) -> tuple:
        nonlocal owner
        owner, got = ledger.lease(owner, r.event_type, float(r.event_id))
        return owner[0], got

    return step


@_fold(
    "wn_05", "user_id long, event_id long, start_at double",
    f"""WITH RECURSIVE e AS (SELECT *, CAST(event_id % 100 AS DOUBLE) + CAST(value AS DOUBLE) / 1000 AS told FROM ({_STEPS}) x), s AS (
        SELECT user_id, event_id, rn, told AS start_at FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.rn, CASE WHEN s.start_at > e.told AND s.start_at - e.told <= 0.5 THEN s.start_at ELSE e.told END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
        SELECT user_id, event_id, start_at FROM s""",
)
def clamped() -> Callable:
    """Steps back of half a second or less are set to the time before, which then counts for the next."""
    last: list[float] = []

    def step(r) -> tuple:
        last[:] = sequences.clamp_backsteps([*last, float(r.event_id % 100) + float(r.value) / 1000])[-1:]
        return (last[0],)

    return step


@query(
    "tk_11",
    """SELECT conv_id, sha256('[' || string_agg(x, ',' ORDER BY x) || ']') AS fingerprint FROM (
        SELECT conv_id, CAST(turn AS VARCHAR) || ':' || coalesce(role, '') || ':' || sha256(coalesce(text, '')) AS x FROM conversations) t GROUP BY conv_id""",
)
def canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a conversation's turns that doesn't depend on their order."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    item = F.concat(F.col("turn").cast("string"), F.lit(":"), F.coalesce("role", F.lit("")), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return t.groupBy("conv_id").agg(F.sha2(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]")).cast("binary"), 256).alias("fingerprint"))
