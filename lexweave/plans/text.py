"""Scalars over text, sequences of words, sets, and rules as ordered cases."""

from __future__ import annotations

from ..functions.tokens import COLLOQUIAL, FILLER_PHRASES, FILLERS
from .dialect import Dialect, sql

# Fixed values.
NEGATIONS = ["no", "not", "never", "none", "neither", "nor", "cannot"]
CITATION_CUES = ["study", "studies", "research", "researcher", "researchers", "paper", "trial", "trials", "review", "meta", "analysis", "authors", "author", "published", "journal", "et", "al"]
HONORIFICS = "Dr|Prof|Mr|Mrs|Ms"
FOREIGN = """de la le les et des du un une pour avec sur dans est sont ne vous nous qui que au aux jusqu comme encore votre nos
het een van voor met op tot zijn niet ook maar wij jullie bij naar deze dit wordt zowel vanaf alle
und der das mit nicht ist sie wir auch auf zu den dem ein eine
el los las para con por y es una como""".split()
AD_MARKERS = ["brought to you by", "sponsored by", "promo code", "use code", "terms apply", "subject to credit approval"]


def _docs(q: Dialect, extra: str = "") -> str:
    return f"d AS (SELECT doc_id, text, lang, {q.words('text')} AS ws{extra} FROM {q.t('documents')})"


def _pairs(q: Dialect) -> str:
    """Two readings: a text, and the same with every word after the first 20 that has an 'a' left out."""
    return f"d AS (SELECT doc_id, {q.words('text')} AS a, {q.words(q.rr('text', ' [b-z]*a[b-z]*', ' '))} AS b FROM {q.t('documents')})"


@sql("wn_01")
def adjacent_repetitions(q: Dialect) -> str:
    """How often a word follows itself, and its share."""
    return f"""WITH {_docs(q)}, w AS (SELECT doc_id, pos, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {q.unnest("doc_id", "d", "ws", "w")} x)
        SELECT doc_id, count(*) AS words, count_if(w = before) AS repetitions, CAST(count_if(w = before) AS DOUBLE) / count(*) AS rate FROM w GROUP BY doc_id"""


@sql("wn_02")
def context_frames(q: Dialect) -> str:
    """The words around every place: two to each side, and a digest of five, ten and thirty to each side, cut at the text's ends. In Spark
    slices inside the row, in DuckDB frames of a window."""
    if q.spark:
        frame = lambda r: q.join(q.slice("v", f"greatest(1, i - {r})", f"i + {r} - greatest(1, i - {r}) + 1"))
        digest = q.sha(" || '#' || ".join(map(frame, (5, 10, 30))))
        frames = q.bind("ws", "v", q.each(q.range(1, q.size("v")), "i", f"{frame(2)} || '#' || {digest}"))
        return f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, f AS frame FROM {q.unnest('doc_id', f'(SELECT doc_id, {q.words("text")} AS ws FROM {q.t("documents")}) z', frames, 'f')} x"
    around = lambda r: f"string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    return f"""WITH {_docs(q)}, f AS (SELECT doc_id, pos, {around(2)} AS a, {around(5)} AS b, {around(10)} AS c, {around(30)} AS d FROM {q.unnest("doc_id", "d", "ws", "w")} x)
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, a || '#' || sha256(b || '#' || c || '#' || d) AS frame FROM f"""


@sql("wn_03")
def word_ngrams(q: Dialect) -> str:
    """All 4-grams, how many are different, and the first of them by name; the set of them is made once."""
    grams = q.bind("ws", "v", q.each(q.range(1, f"{q.size('v')} - 3"), "i", q.join(q.slice("v", "i", 4))))
    different, least = q._("array_distinct(grams)", "list_distinct(grams)"), q._("array_min(grams)", "list_min(grams)")
    return f"WITH {_docs(q)}, g AS (SELECT doc_id, {grams} AS grams FROM d) SELECT doc_id, {q.size('grams')} AS n, {q.size(different)} AS distinct_n, {least} AS first_gram FROM g"


@sql("wn_04")
def caption_times(q: Dialect) -> str:
    """A timestamp holds until the next different one; words between them get times by interpolation."""
    w = "PARTITION BY user_id ORDER BY event_id"
    return f"""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN event_id END AS t FROM {q.t("events")}),
        f AS (SELECT user_id, event_id, {q.known("last", "t")} OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start_t, min(CASE WHEN t IS NOT NULL THEN t END) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_t FROM e),
        g AS (SELECT *, row_number() OVER (PARTITION BY user_id, start_t ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, start_t) AS n FROM f)
        SELECT user_id, event_id, start_t, end_t, CASE WHEN start_t IS NULL THEN NULL WHEN end_t IS NULL THEN CAST(start_t AS DOUBLE) ELSE start_t + i * CAST(end_t - start_t AS DOUBLE) / n END AS word_time FROM g"""


@sql("wn_06")
def monotone(q: Dialect) -> str:
    return f"WITH e AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {q.t('events')}) SELECT user_id, count_if(value < before) AS steps_back, count_if(value < before) = 0 AS valid FROM e GROUP BY user_id"


@sql("wn_07")
def islands(q: Dialect) -> str:
    """Spans no further than three apart belong together."""
    w = "PARTITION BY l_orderkey ORDER BY a, b"
    return f"""WITH s AS (SELECT l_orderkey, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) AS b FROM {q.t("lineitem")}), m AS (SELECT *, max(b) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 3 THEN 1 ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT l_orderkey, CAST(island AS BIGINT) AS island, min(a) AS first_word, max(b) AS last_word, count(*) AS spans FROM g GROUP BY l_orderkey, island"""


@sql("wn_10")
def repeat_runs(q: Dialect) -> str:
    """Whether a phrase of two to eight words stands three times in a row: so many words in a row, twice its length, equal the one that
    stands its length before. In Spark stretches inside the row are compared, in DuckDB the words are counted over a window."""
    if q.spark:
        again = lambda n: f"{q.size(q.keep(q.range(1, f'{q.size("v")} - {3 * n - 1}'), 'i', f'{q.slice("v", "i", 2 * n)} = {q.slice("v", f"i + {n}", 2 * n)}'))} > 0"
        return f"WITH {_docs(q)} SELECT doc_id, {q.bind('ws', 'v', ' OR '.join(map(again, range(2, 9))))} AS repeats FROM d"
    same = ", ".join(f"w = lag(w, {n}) OVER (PARTITION BY doc_id ORDER BY pos) AS e{n}" for n in range(2, 9))
    runs = " OR ".join(f"count(CASE WHEN e{n} THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {2 * n - 1} PRECEDING AND CURRENT ROW) = {2 * n}" for n in range(2, 9))
    return f"""WITH {_docs(q)}, e AS (SELECT doc_id, pos, {same} FROM {q.unnest("doc_id", "d", "ws", "w")} x), r AS (SELECT doc_id, {runs} AS hit FROM e)
        SELECT d.doc_id, count(CASE WHEN r.hit THEN 1 END) > 0 AS repeats FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


@sql("wn_11")
def adjacent_spans(q: Dialect) -> str:
    """How many spans of one to three words equal the one right before or right after them."""
    def same(n: int) -> str:
        own = q.slice("v", "i", n)
        before, after = f"i > {n} AND {own} = {q.slice('v', f'greatest(i - {n}, 1)', n)}", f"i + {2 * n - 1} <= {q.size('v')} AND {own} = {q.slice('v', f'i + {n}', n)}"
        return q.size(q.keep(q.range(1, f"{q.size('v')} - {n - 1}"), "i", f"({before}) OR ({after})"))

    return f"WITH w AS (SELECT conv_id AS episode_key, turn AS id, {q.words('text')} AS ws FROM {q.t('conversations')}) SELECT episode_key, id, {q.bind('ws', 'v', ' + '.join(map(same, (1, 2, 3))))} AS duplicates FROM w"


@sql("wn_12")
def chunks(q: Dialect) -> str:
    """25 words a chunk; windows of 2,000 characters."""
    return f"""WITH {_docs(q)} SELECT doc_id, {q.div("pos - 1", 25)} AS chunk, count(*) AS words, min(w) AS least_word FROM {q.unnest("doc_id", "d", "ws", "w")} x GROUP BY doc_id, {q.div("pos - 1", 25)}"""


@sql("wn_14")
def overlap_stitch(q: Dialect) -> str:
    """Of two overlapping chunks, words before the cut are the earlier one's, the others the later one's."""
    return f"""WITH w AS (SELECT user_id, event_id, event_id % 100 AS pos, {q.div("event_id", 100)} AS chunk FROM {q.t("events")}), joined AS (SELECT user_id, event_id, chunk, pos FROM w UNION ALL SELECT user_id, event_id, chunk - 1, pos + 100 FROM w WHERE pos < 10)
        SELECT user_id, event_id, chunk, pos FROM joined WHERE pos >= 5 AND pos < 105 OR chunk = 0 AND pos < 105"""


@sql("st_01")
def intersections(q: Dialect) -> str:
    return f"WITH {_docs(q)} SELECT doc_id, {q.join(q.common(q.distinct('ws'), q.lit(CITATION_CUES + FOREIGN)), ',')} AS common, {q.size(q.distinct('ws'))} AS distinct_words FROM d"


@sql("st_03")
def tag_transition(q: Dialect) -> str:
    """A text's distinct words as tags: less the obsolete ones, with the target."""
    return f"""WITH t AS (SELECT DISTINCT doc_id, w AS tag FROM {q.unnest("doc_id", f"(SELECT doc_id, {q.words('text')} AS ws FROM {q.t('documents')}) z", "ws", "w")} x), u AS (SELECT doc_id, tag FROM t WHERE tag NOT IN ('the', 'of', 'and') UNION SELECT doc_id, coalesce(lang, 'none') FROM {q.t("documents")})
        SELECT doc_id, count(*) AS n, {q.sha(q.sorted_list("tag"))} AS tags FROM u GROUP BY doc_id"""


@sql("st_04")
def ordered_distinct(q: Dialect) -> str:
    """Distinct words without regard to case, in the order and form of their first occurrence. In Spark inside the row: distinct forms
    are sorted by key and place, the first of each key stays, and they are put back into order."""
    parts = q.keep(q.split(q.rr("text", "[^A-Za-z]+", " "), " "), "w", "w <> ''")
    if q.spark:
        forms = "sort_array(transform(array_distinct(ws), (w, i) -> struct(lower(w) AS k, i, w)))"
        first = "filter(s, (x, j) -> j = 0 OR x.k <> get(s, j - 1).k)"
        kept = f"element_at(transform(array({forms}), s -> transform(sort_array(transform({first}, x -> struct(x.i, x.w))), y -> y.w)), 1)"
        return f"SELECT doc_id, CAST(size(a) AS BIGINT) AS forms, array_join(a, ' ') AS words FROM (SELECT doc_id, {kept} AS a FROM (SELECT doc_id, {parts} AS ws FROM {q.t('documents')} WHERE {q.rx("text", "[A-Za-z]")}) z) y"
    return f"""WITH p AS (SELECT doc_id, lower(w) AS k, {q.argmin("w", ["pos"])} AS w, min(pos) AS pos FROM {q.unnest("doc_id", f"(SELECT doc_id, {parts} AS ws FROM {q.t('documents')}) z", "ws", "w")} x GROUP BY doc_id, lower(w))
        SELECT doc_id, count(*) AS forms, string_agg(w, ' ' ORDER BY pos) AS words FROM p GROUP BY doc_id"""


@sql("sc_01")
def clean_text(q: Dialect) -> str:
    """Without timestamp lines, white space squeezed."""
    lines = q.keep(q._("split(text, '\\n')", "string_split(text, chr(10))"), "x", f"NOT {q.rx('x', r'^[ ]*[0-9]{1,3}:[0-9]{2}(:[0-9]{2})?[ ]*$')}")
    return f"SELECT doc_id, trim({q.rr(q.join(lines), '[ \\t\\n\\r]+', ' ')}) AS cleaned FROM {q.t('documents')}"


@sql("sc_02")
def clock_seconds(q: Dialect) -> str:
    clock = f"CAST({q.div('event_id', 60)} % 60 AS STRING) || ':' || lpad(CAST(event_id % 60 AS STRING), 2, '0')"
    clock = f"CASE WHEN event_id % 3 = 0 THEN '1:' || lpad(CAST({q.div('event_id', 60)} % 60 AS STRING), 2, '0') || ':' || lpad(CAST(event_id % 60 AS STRING), 2, '0') ELSE {clock} END"
    p = q.split("clock", ":")
    n = q.size("p")
    return f"WITH c AS (SELECT event_id, {clock} AS clock FROM {q.t('events')}), s AS (SELECT event_id, clock, {p} AS p FROM c) SELECT event_id, clock, CASE WHEN {n} = 3 THEN CAST({q.at('p', 1)} AS BIGINT) * 3600 + CAST({q.at('p', 2)} AS BIGINT) * 60 + CAST({q.at('p', 3)} AS BIGINT) ELSE CAST({q.at('p', 1)} AS BIGINT) * 60 + CAST({q.at('p', 2)} AS BIGINT) END AS seconds FROM s"


@sql("sc_04")
def tokenizers(q: Dialect) -> str:
    """The same text by several rules: letters; letters and digits; with inner apostrophes; numbers."""
    count = lambda p: q.size(q.find_all("lower(text)", p))
    return f"SELECT doc_id, {count('[a-z]+')} AS letters, {count('[a-z0-9]+')} AS alnum, {count("[a-z]+(?:-[a-z]+)*")} AS joined, {count('[0-9]+(?:[.,:/][0-9]+)*|%')} AS numbers FROM {q.t('documents')}"


@sql("sc_08")
def negations(q: Dialect) -> str:
    """Negations of a text; a 'no' before 'cebo' or 'sebo' is none."""
    return f"""WITH {_docs(q)}, w AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM {q.unnest("doc_id", "d", "ws", "w")} x)
        SELECT doc_id, {q.sorted_list("w", distinct=True)} AS found FROM w WHERE {q.has(q.lit(NEGATIONS), "w")} AND NOT (w = 'no' AND coalesce(following, '') IN ('cebo', 'sebo')) GROUP BY doc_id"""


@sql("sc_09")
def citation_signal(q: Dialect) -> str:
    """'et al', or a year and a cue."""
    year = f"{q.size(q.keep('ws', 'w', q.rx('w', '^(19|20)[0-9]{2}$')))} > 0"
    cue = f"{q.size(q.common(q.distinct('ws'), q.lit(CITATION_CUES)))} > 0"
    return f"WITH {_docs(q)}, s AS (SELECT doc_id, {year} AS has_year, {cue} AS has_cue, ' ' || {q.join('ws')} || ' ' LIKE '% et al %' AS has_et_al FROM d) SELECT doc_id, has_year, has_cue, has_et_al OR has_year AND has_cue AS is_citation FROM s"


@sql("sc_10")
def proper_names(q: Dialect) -> str:
    """Two title-case words together outside sentences, an honorific before one, or capitals only."""
    return f"""SELECT doc_id, {q.rx("text", "(^|[^A-Za-z.])[A-Z][a-z]+ [A-Z][a-z]+")} AND text NOT LIKE '%.%' AS two_titles, {q.rx("text", f"(^| )({HONORIFICS})[.]? [A-Z][a-z]+")} AS honorific, {q.rx("text", "(^|[^A-Za-z])[A-Z]{3,}($|[^A-Za-z])")} AS capitals FROM {q.t("documents")}"""


def _spaced(q: Dialect, words: str) -> str:
    """Words in one line, each with a space of its own on both sides."""
    return f"' ' || {q.join(words, '  ')} || ' '"


@sql("sc_15")
def filler_free(q: Dialect) -> str:
    """Words, and those left without fillers and filler phrases."""
    fillers = "|".join([*("  ".join(p) for p in sorted(FILLER_PHRASES)), *sorted(FILLERS)])
    left = q.keep(q.split(q.rr(_spaced(q, "ws"), f" ({fillers}) ", ""), " "), "w", "w <> ''")
    return f"WITH w AS (SELECT conv_id AS episode_key, turn AS id, {q.words(f"replace(replace(text, ' the ', ' you know '), ' of ', ' um ')")} AS ws FROM {q.t('conversations')}) SELECT episode_key, id, {q.size('ws')} AS n_words, {q.size(left)} AS n_kept FROM w"


@sql("sc_18")
def colloquial_only(q: Dialect) -> str:
    """Whether two readings differ only in colloquial forms: both in full are the same."""
    def full(x: str) -> str:
        for short, long in COLLOQUIAL.items():
            x = f"replace({x}, ' {short} ', ' {long.replace(' ', '  ')} ')"
        return x

    a, b = (f"replace(replace(text, ' the ', ' {x} '), ' of ', ' {y} ')" for x, y in (("gonna", "because"), ("going to", "cuz")))
    return f"""WITH w AS (SELECT conv_id AS episode_key, turn AS id, {q.words(a)} AS a, {q.words(f"CASE WHEN turn % 3 = 0 THEN replace({b}, ' and ', ' or ') ELSE {b} END")} AS b FROM {q.t("conversations")})
        SELECT episode_key, id, {full(_spaced(q, "a"))} = {full(_spaced(q, "b"))} AS same FROM w"""


@sql("sc_21")
def quantity_ranges(q: Dialect) -> str:
    """Numbers and ranges with their ends; a range that falls is none."""
    number = "[0-9]+([.][0-9]+)?"
    found = q.find_all("text", "[0-9]+(?:[.][0-9]+)?(?: *(?:-|to) *[0-9]+(?:[.][0-9]+)?)?")
    value = lambda x: f"TRY_CAST({x} AS DECIMAL(38,6))"
    return f"""WITH m AS (SELECT doc_id, m FROM {q.unnest("doc_id", q.t("documents"), found, "m")} x), r AS (SELECT doc_id, {q.find("m", f"^{number}")} AS low, {q.find("m", f"{number}$")} AS high FROM m)
        SELECT doc_id, low, high FROM r WHERE {value("low")} <= {value("high")}"""


@sql("tk_06")
def coverage_candidates(q: Dialect) -> str:
    """Long words of a turn, the longest kind first, then in order; the first forty."""
    return f"""WITH s AS (SELECT episode_key, id, lower(t) AS term, row_number() OVER (PARTITION BY episode_key, id ORDER BY CASE WHEN length(t) > 12 THEN 0 ELSE 1 END, pos) AS place, count(*) OVER (PARTITION BY episode_key, id) AS total
        FROM {q.unnest("episode_key, id", f"(SELECT conv_id AS episode_key, turn AS id, text FROM {q.t('conversations')}) c", q.find_all("text", "[A-Za-z]{9,}"), "t")} x)
        SELECT episode_key, id, total, place, term FROM s WHERE place <= 40"""


@sql("jn_14")
def coverage_gaps(q: Dialect) -> str:
    """Long words of one reading, and those that the other one lacks within eight words of their place."""
    turns = f"(SELECT conv_id AS episode_key, turn AS id, {q.words('text')} AS a, {q.words(q.rr('text', ' [b-z]*a[b-z]*', ' '))} AS b FROM {q.t('conversations')}) c"
    side = lambda c, name: f"{name} AS (SELECT episode_key, id, pos, w FROM {q.unnest('episode_key, id', turns, c, 'w')} x WHERE length(w) >= 9)"
    return f"""WITH {side("a", "spots")}, {side("b", "placed")},
        met AS (SELECT DISTINCT s.episode_key, s.id, s.pos FROM spots s JOIN placed p ON p.episode_key = s.episode_key AND p.id = s.id AND p.w = s.w AND abs(p.pos - s.pos) <= 8)
        SELECT s.episode_key, s.id, count(*) AS spots, count_if(m.pos IS NULL) AS uncovered FROM spots s LEFT JOIN met m ON m.episode_key = s.episode_key AND m.id = s.id AND m.pos = s.pos GROUP BY s.episode_key, s.id"""


@sql("sc_16")
def foreign_language(q: Dialect) -> str:
    """A fifth of 25 words or more that are foreign function words."""
    n, f = q.size("ws"), q.size(q.keep("ws", "w", q.has(q.lit(FOREIGN), "w")))
    return f"WITH {_docs(q)} SELECT doc_id, {n} AS words, {f} AS foreign_words, {n} >= 25 AND {f} * 5 >= {n} AS is_foreign FROM d"


@sql("sc_17")
def advertisements(q: Dialect) -> str:
    """A long one-sided stretch with a marker, or one for which the audio has no room."""
    marker = " OR ".join(f"lower(text) LIKE '%{m}%'" for m in AD_MARKERS)
    n, f = q.size("ws"), q.size(q.keep("ws", "w", q.has(q.lit(FOREIGN), "w")))
    return f"WITH {_docs(q)} SELECT doc_id, CASE WHEN {n} >= 25 AND {f} * 5 >= {n} THEN 'language' WHEN {n} >= 25 AND ({marker}) THEN 'marker' WHEN {n} >= 25 AND doc_id % 10 = 0 THEN 'no_room' END AS advertisement FROM d"


@sql("sc_19")
def representations(q: Dialect) -> str:
    """Equal once white space, case and 'etc' are written alike; or the same clock time."""
    a, b = "lower(p_name || ' etc')", "lower(replace(p_name, ' ', '')) || ' et cetera'"
    same = lambda x: q.rr(q.rr(x, "(etc|et cetera)", "et cetera"), "[^a-z]", "")
    return f"SELECT p_partkey, {same(a)} = {same(b)} AS compound, CAST(p_size AS STRING) || ':30' = CAST(p_size AS STRING) || ':' || CAST(30 AS STRING) AS clock FROM {q.t('part')}"


@sql("sc_20")
def run_on_words(q: Dialect) -> str:
    """Of two readings with the same letters, the one that parts a run-on word of nine letters into words of five or more."""
    longest = lambda c: q._(f"array_max(transform({c}, w -> length(w)))", f"list_max(list_transform({c}, lambda w: length(w)))")
    least = lambda c: q._(f"array_min(transform({c}, w -> length(w)))", f"list_min(list_transform({c}, lambda w: length(w)))")
    return f"""WITH p AS (SELECT p_partkey, {q.split("CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '') ELSE p_name END", " ")} AS a, {q.split("p_name", " ")} AS b FROM {q.t("part")})
        SELECT p_partkey, CASE WHEN {q.join("a", "")} <> {q.join("b", "")} OR {q.size("a")} = {q.size("b")} THEN NULL WHEN {q.size("a")} < {q.size("b")} AND {longest("a")} >= 9 AND {least("b")} >= 5 THEN 'second' WHEN {q.size("b")} < {q.size("a")} AND {longest("b")} >= 9 AND {least("a")} >= 5 THEN 'first' END AS preferred FROM p"""


#: A unit, its metric unit, and the factor.
UNITS = [("lb", "kg", "0.45359237"), ("oz", "g", "28.349523125"), ("mile", "km", "1.609344"), ("ft", "cm", "30.48"), ("in", "cm", "2.54")]


@sql("sc_22")
def metric(q: Dialect) -> str:
    """Metric values with two significant figures, half up; whole from a hundred on; Fahrenheit apart."""
    table = " UNION ALL ".join(f"SELECT {i} AS k, '{u}' AS unit, '{m}' AS si, CAST('{f}' AS DECIMAL(18,9)) AS factor" for i, (u, m, f) in enumerate(UNITS))
    return f"""WITH u AS ({table}), v AS (SELECT p.p_partkey, u.unit, u.si, CAST(p.p_size AS DECIMAL(18,3)) * u.factor AS v, CAST(p.p_size AS DOUBLE) AS spoken FROM {q.t("part")} p JOIN u ON u.k = p.p_partkey % 6)
        SELECT p_partkey, unit, si, CAST(CASE WHEN v >= 100 THEN round(v, 0) WHEN v >= 10 THEN round(v, 0) WHEN v >= 1 THEN round(v, 1) ELSE round(v, 2) END AS DOUBLE) AS shown FROM v
        UNION ALL SELECT p_partkey, 'F', 'C', CAST(round(CAST((p_size - 32) * 5 AS DECIMAL(18,3)) / 9, 0) AS DOUBLE) FROM {q.t("part")} WHERE p_partkey % 6 = 5"""


@sql("sc_25")
def slugs(q: Dialect) -> str:
    return f"SELECT p_partkey, trim({q.rr("lower(p_name || ' ' || p_brand)", "[^a-z0-9]+", "-")}) AS slug, {q.rr("p_name || ': ' || p_type", "[^A-Za-z0-9 ]+", "")} AS file_name FROM {q.t('part')}"


@sql("sc_26")
def dates(q: Dialect) -> str:
    """A text is a date by the first form that reads it, else unknown."""
    raw = "CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
    return f"WITH r AS (SELECT o_orderkey, {raw} AS raw FROM {q.t('orders')}) SELECT o_orderkey, raw, CAST(TRY_CAST(raw AS DATE) AS STRING) AS published, TRY_CAST(raw AS DATE) IS NULL AS unknown FROM r"


@sql("sc_27")
def identities(q: Dialect) -> str:
    """24 hex digits of the digest of feed and guid, a NUL between them."""
    nul = q._("char(0)", "chr(0)")
    key = f"c_name || {nul} || CAST(c_custkey AS STRING)"
    return f"SELECT c_custkey, substr({q.sha(key)}, 1, 24) AS episode_key FROM {q.t('customer')}"


@sql("sc_28")
def clip_windows(q: Dialect) -> str:
    """Twelve seconds about a span, thirty at most, three of margin, within the recording."""
    return f"""WITH s AS (SELECT event_id, CAST(event_id % 600 AS DOUBLE) AS a, event_id % 600 + value / 20 AS b FROM {q.t("events")}), l AS (SELECT *, least(30, greatest(12, b - a + 6)) AS n FROM s)
        SELECT event_id, greatest(0, (a + b) / 2 - n / 2) AS clip_start, least(600, (a + b) / 2 + n / 2) AS clip_end, CAST(ceil(n * 2.5) AS BIGINT) AS words FROM l"""


@sql("sc_32")
def splice(q: Dialect) -> str:
    """A span replaced, with white space and colliding signs put right."""
    return f"SELECT doc_id, {q.rr(q.rr("substr(text, 1, 20) || ' ,  ' || substr(text, 31)", "[ \\t\\n]+", " "), " ([,.;:!?])", "\\1")} AS merged FROM {q.t('documents')}"


@sql("sc_33")
def shown_times(q: Dialect) -> str:
    return f"SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' ELSE CAST({q.div('CAST(floor(value) AS BIGINT)', 60)} AS STRING) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS STRING), 2, '0') END AS shown FROM {q.t('events')}"


@sql("sc_34")
def term_like(q: Dialect) -> str:
    n = q.size(q.words("text"))
    return f"SELECT doc_id, {n} BETWEEN 1 AND 8 AND length(text) <= 120 AS is_term, lower(trim({q.rr('text', '[ \\t\\n]+', ' ')})) AS term_key FROM {q.t('documents')}"


@sql("sc_35")
def case_only(q: Dialect) -> str:
    return f"WITH p AS (SELECT p_partkey, p_name AS a, CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' ' ELSE p_type END AS b FROM {q.t('part')}) SELECT p_partkey, length(a) = length(b) AND lower(a) = lower(b) AS same FROM p"


@sql("sc_37")
def failure_classes(q: Dialect) -> str:
    """What a status says about a request: surely not sent, or possibly charged."""
    return f"WITH s AS (SELECT event_id, CASE WHEN {q.json_int('props', 'k')} % 5 = 0 THEN NULL ELSE 400 + {q.json_int('props', 'k')} * 3 % 150 END AS status FROM {q.t('events')}) SELECT event_id, CASE WHEN status IS NULL THEN 'transport' WHEN status = 429 THEN 'rate_limited' WHEN status IN (401, 402, 403) THEN 'rejected' WHEN status >= 500 THEN 'provider' ELSE 'client' END AS failure, coalesce(status IN (400, 401, 402, 403, 404, 413, 422, 429), false) AS surely_unsent FROM s"


@sql("ag_23")
def source_quality(q: Dialect) -> str:
    """Coverage, completeness, punctuation and repetition, out of 100, or of 85 for captions without punctuation."""
    n = "n"
    return f"""WITH {_docs(q)}, w AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {q.unnest("doc_id", "d", "ws", "w")} x), r AS (SELECT doc_id, count(*) AS n, CAST(count_if(w = before) AS DOUBLE) AS rep FROM w GROUP BY doc_id),
        s AS (SELECT r.doc_id, n, rep / n AS rate, CAST(length(d.text) - length({q.rr("d.text", "[.?!]", "")}) AS DOUBLE) AS marks, n >= 20 AND NOT {q.rx("d.text", r"[.?!](\s|$)")} AS captions, max(n) OVER (PARTITION BY d.lang) AS longest FROM r JOIN d ON d.doc_id = r.doc_id),
        t AS (SELECT *, CASE WHEN captions THEN 0 ELSE 15 END AS weight FROM s)
        SELECT doc_id, {n}, round((0.9 * 20 + CAST({n} AS DOUBLE) / longest * 60 + least(1, marks / greatest(1, {n} * 0.02)) * weight + (1 - least(1, rate * 20)) * 5) / (85 + weight) * 100, 6) AS quality FROM t""".replace("0.9 * 20", "CAST(18 AS DOUBLE)").replace("0.02", "CAST(0.02 AS DOUBLE)")


@sql("al_08")
def merge_decisions(q: Dialect) -> str:
    """What is done with a difference: the first rule that applies, in a fixed order."""
    rules = [
        ("only_one AND filler", "discarded_confirmed_filler"), ("only_one AND risk", "review_source_only_semantic_risk"), ("only_one AND repeats", "review_source_only_suspected_repetition"),
        ("kind IN ('number_mismatch', 'negation_mismatch')", "review_kept_primary"), ("repeats AND NOT repeats_other", "review_suspected_whisper_repetition"), ("repeats_other AND NOT repeats", "review_suspected_apple_repetition"),
        ("only_one", "preserved_content"), ("kind = 'wording_difference' AND severity = 'low' AND risk", "equivalent_representation"), ("repeats", "review_kept_primary"), ("severity IN ('high', 'medium')", "review_kept_primary"),
        ("known", "preferred_verbatim_whisper"),
    ]
    cases = " ".join(f"WHEN {c} THEN '{a}'" for c, a in rules)
    d = lambda k, n: f"{q.div('m', k)} % {n}"
    return f"""WITH {q.cards()}, f AS (SELECT *, kind IN ('whisper_omission', 'whisper_addition') AS only_one, {d(53, 8)} = 0 AS filler, {d(59, 3)} = 0 AS risk, {d(61, 7)} = 0 AS repeats, {d(67, 9)} = 0 AS repeats_other, {d(71, 2)} = 0 AS known FROM cards), a AS (SELECT id, kind, CASE {cases} ELSE 'kept_primary' END AS merge_action FROM f)
        SELECT id, merge_action, merge_action LIKE 'review%' AS review_required, CASE WHEN merge_action = 'preferred_verbatim_whisper' THEN 'whisper' WHEN merge_action = 'preserved_content' AND kind = 'whisper_addition' THEN 'whisper' WHEN merge_action = 'discarded_confirmed_filler' AND kind = 'whisper_omission' THEN 'whisper' ELSE 'apple' END AS selected_source FROM a"""


@sql("al_17")
def term_observations(q: Dialect) -> str:
    """Observed forms from reports and decisions that look like terms."""
    return f"""WITH o AS (SELECT p_name AS form, p_type AS category, 'report' AS provenance, p_partkey AS episode_key FROM {q.t("part")} WHERE p_size > 10 UNION ALL SELECT p_name || ' ' || p_type, 'decision', 'decision', p_partkey FROM {q.t("part")} WHERE p_size % 3 = 0)
        SELECT lower(trim(form)) AS term, provenance, count(*) AS observations, count(DISTINCT episode_key) AS episodes, min(category) AS category FROM o WHERE length(form) <= 120 GROUP BY lower(trim(form)), provenance"""


def feed_entries(q: Dialect) -> str:
    """A page's first heading and its identity: the first of several that is there."""
    return f"SELECT page_id, {q.find('html', '<h1>([^<]*)</h1>', 1)} AS title, coalesce(NULLIF({q.find('url', '([0-9]+)', 1)}, ''), url) AS guid FROM {q.t('pages')}"


def word_metadata(q: Dialect) -> str:
    """Words with their own log-probability, else the segment's, else that of their probability; what isn't a number is null."""
    k = q.json_int("props", "k")
    return f"""WITH w AS (SELECT event_id, CASE WHEN {k} % 3 = 0 THEN -value / 100 END AS own, CASE WHEN {k} % 3 = 1 THEN -value / 200 END AS seg, CASE WHEN {k} % 5 = 0 THEN NULL ELSE value / 500 END AS prob FROM {q.t("events")})
        SELECT event_id, round(coalesce(own, seg, CASE WHEN prob IS NOT NULL THEN ln(greatest(prob, 1e-12)) END), 6) AS logprob, CASE WHEN own IS NOT NULL THEN 'word' WHEN seg IS NOT NULL THEN 'segment' WHEN prob IS NOT NULL THEN 'probability' END AS origin FROM w"""
