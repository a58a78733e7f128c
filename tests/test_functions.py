"""Functions by hand-made cases, and laws they keep."""

from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.functions import differences, ledger, materiality, notes, numbers, rules, sequences, terms, tokens

WORDS = st.lists(st.sampled_from("a b c d no um 5 7".split()), max_size=14)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("forty two", ["40", "2"]), ("one hundred and five", ["105"]), ("one hundred five", ["105"]), ("two thousand three hundred", ["2300"]), ("3 million", ["3000000"]), ("zero point eight", ["0.8"]),
        ("1,000 and 7.30", ["1000", "7.3"]), ("nothing", []), ("twenty twenty four", ["2024"]), ("two hundred and fifty", ["250"]), ("a hundred and fifty", ["150"]), ("ten point five", ["10.5"]),
        ("two thirds", ["0.666667"]), ("three and a half", ["3.5"]), ("twenty two and a half", ["22.5"]), ("see you in the next one", []), ("take one gram", ["1"]), ("a quarter", ["0.25"]), ("3/4 cup", ["0.75"]), ("34 81", ["34", "81"]),
    ],
)
def test_numbers(text, want):
    assert numbers.numbers(tokens.words(text)) == want


def test_fractions_that_differ_are_a_number_mismatch():
    assert rules.classify(tokens.words("two thirds"), tokens.words("two fifths")) == ("number_mismatch", "high")
    assert rules.classify(tokens.words("three and a half"), tokens.words("four and a half")) == ("number_mismatch", "high")


def test_digits_in_groups():
    assert numbers.compact_readings(["34", "81"]) == {"3481"}
    assert numbers.compact_readings(["20", "1", "12"]) == {"2112", "20112"}
    assert numbers.compact_readings(["05"]) == set()
    assert numbers.numeric_or_unit_equivalent(["3481"], ["34", "81"])
    assert numbers.numeric_or_unit_equivalent(["20", "1", "to", "30"], ["21", "to", "30"])
    assert numbers.numeric_or_unit_equivalent(tokens.words("five percent"), tokens.words("5%"))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("am or 2am", "a.m. or 2 a.m"), ("PM and 10 PM", "p.m. and 10 p.m"), ("40s and 50s to the 60s and 70s", "forties and fifties to the sixties and seventies"), ("1,500", "a thousand five hundred"),
        ("twenty five percent", "25%"), ("a hundred and ten kilos", "110 kg"), ("7:30", "7.30"), ("0.8, 0.75", ".8 .75"), ("1.25", "one point two five"), ("0.05", ".05"), ("the 21st", "the twenty first"), ("the 2nd set", "the second set"),
    ],
)
def test_numbers_written_otherwise(a, b):
    assert numbers.same_numbers(a, b)
    assert materiality.verdict(a, b, "so", "and then") == ("immaterial", "number_format")


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("110 kilo deadlift", "a hundred, hundred ten kilo deadlift. You know"), ("25", "twenty, twenty-five"), ("late 1940s", "nineteen late nineteen forties"), ("1950s", "1940s is or 1950s, pardon me"),
        ("between 5 and 10", "between fifty and ten"), ("8, 1, 5, 7, 30, and 10", "uh, like, eight, one, five, uh, 7:30 and 10. Like"), ("2017", "17"), ("0.8", "8"), ("0.8", "zero point nine"), ("the 3rd", "the three"),
        ("first", "one"), ("1.25", "one point two"), ("five sets", "two three sets"), ("7.30", "7, 30"), ("twenty seventeen", "2017"), ("200", "2"), ("twenty twenty", "twenty twenty eight"),
    ],
)
def test_numbers_that_differ_stay_with_the_reviewer(a, b):
    assert materiality.verdict(a, b, "so", "and") == ("reviewer", "number")


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("But certainly from the US, 58", "Yeah, but certainly in the US, fifty-eight"), ("Mr. America in 1944", "Mister America in nineteen forty four"), ("I've got like an $800", "I got like an eight hundred dollar"),
        ("2200, 2300", "twenty two hundred, twenty three hundred"), ("100 percent", "yeah, hundred percent. Yeah"), ("two different PT's", "a PT. I have like two different PTs"),
    ],
)
def test_same_numbers_amid_other_words(a, b):
    assert numbers.same_values(a, b) and materiality.verdict(a, b, "so", "and")[0] != "reviewer"


FRENCH = "Dans notre jardin il y a une table pour les enfants et nous avons des chaises avec le chat qui est sur le mur. Vous pouvez venir avec votre famille et les amis dans la salle."
ENGLISH = "This made up announcement speaks of a quiet room with chairs near a window where people read a book and wait until somebody calls their name from the other side of it."


@pytest.mark.parametrize(
    ("left", "a", "b", "right", "want"),
    [
        ("a lot of it. So", "", "it's not, you know,", "it isn't all over. And", ("immaterial", "fillers_restarts")),
        ("yourself or something, but like", "", "No", ", I don't know about that", ("immaterial", "fillers_restarts")),
        ("it's just energy. I", "", "don't", "think there's anything special", ("judge", "negation")),
        ("you don't feel", "just a", "like, you know, just the", "tired", ("immaterial", "function_words")),
        ("we got a", "e-mail from someone", "email from someone", "who", ("immaterial", "same_letters")),
        ("but I'm not,", "", "I'm not", "I'm not training with them", ("immaterial", "fillers_restarts")),
        ("camp where", "creatine", "creating", "coffee", ("judge", "content")),
        ("so", "we don't do 3 sets", "we do 3 sets", "and then", ("judge", "negation")),
        ("the estimate", "is 0.8", "it was zero point eight", "a week", ("immaterial", "function_words")),
        ("", ENGLISH, FRENCH, "hello", ("advertisement", "use_apple")),
        ("", FRENCH, "", "hello", ("advertisement", "use_whisper")),
        ("", FRENCH, FRENCH.replace("chat", "chien"), "", ("judge", "content")),
        ("", ENGLISH + " Use code LIFT.", "", "hello", ("advertisement", "use_whisper")),
        ("", ENGLISH, "", "hello", ("reviewer", "one_sided_long")),
        ("um", "lift", "um you know lift", "", ("immaterial", "fillers_restarts")),
        ("kind", "", "kind", "of slow", ("immaterial", "fillers_restarts")),
    ],
)
def test_materiality(left, a, b, right, want):
    assert materiality.verdict(a, b, left, right) == want


def test_no_room_in_the_audio_is_an_advertisement():
    texts = {"apple": ENGLISH, "whisper": ""}
    assert materiality.room_in_audio(texts, 1.46, 1.84) == 0.38
    assert materiality.room_in_audio(texts, 1.0, 1.1, partial=True) is None and materiality.room_in_audio({"apple": "", "whisper": ENGLISH}, 1.0, 1.1) is None
    assert materiality.verdict(ENGLISH, "", seconds=0.38) == ("advertisement", "use_whisper")
    assert materiality.verdict(ENGLISH, "", seconds=31.5) == ("reviewer", "one_sided_long")


def test_tokens_keep_their_places():
    text = "Don’t take 1,000 mg at 7:30am — 5%"
    assert all(text[t.start : t.end] == t.original for t in tokens.tokenize(text))
    assert [t.value for t in tokens.tokenize("Twelve o'clock")] == ["12", "o'clock"]


def test_number_mismatch_and_format():
    assert rules.classify(tokens.words("take 42"), tokens.words("take 40")) == ("number_mismatch", "high")
    assert rules.classify(tokens.words("twelve kg"), tokens.words("12 kilograms")) == ("numeric_unit_equivalent", "low")
    assert materiality.verdict("twelve reps", "12 reps") == ("immaterial", "number_format")
    assert materiality.verdict("take 42", "take 40") == ("reviewer", "number")
    assert materiality.verdict("um you know lift", "lift") == ("immaterial", "fillers_restarts")
    assert materiality.verdict("never lift", "always lift")[0] == "judge"


def test_negation_guard():
    assert tokens.negations(["no", "cebo"]) == set()
    assert tokens.negations(["no", "pain"]) == {"no"}


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_opcodes_rebuild_the_other_side(a, b):
    for codes in (sequences.opcodes(a, b), sequences.global_opcodes(a, b)):
        built = [w for t, i1, i2, j1, j2 in codes for w in (a[i1:i2] if t == "equal" else b[j1:j2])]
        assert built == b
        assert [w for _, i1, i2, _, _ in codes for w in a[i1:i2]] == a


@settings(max_examples=100, deadline=None)
@given(WORDS, WORDS)
def test_distance_is_a_metric(a, b):
    d = sequences.edit_distance(a, b)
    assert d == sequences.edit_distance(b, a)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert (d == 0) == (a == b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, max_size=12))
def test_longest_rising_chain(values):
    pairs = list(enumerate(values))
    got = sequences.increasing(pairs)
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = max([1, *(best[j] + 1 for j in range(i) if values[j] < values[i])])
    assert len(got) == max(best, default=0)
    assert all(x < y for (_, x), (_, y) in zip(got, got[1:], strict=False))


def test_anchored_alignment_of_long_texts():
    a = [f"w{i}" for i in range(7000)]
    b = a[:3000] + ["x"] * 5 + a[3010:]
    assert sequences.metrics(sequences.opcodes(a, b)) == (6990, 1, 10, 5, 10)


def test_best_window_is_exact():
    assert sequences.best_window(["b", "c"], ["a", "b", "c", "d"]) == (Fraction(1), 0, 1, 2)
    assert sequences.best_window(["x"], [])[0] == 0


def test_repeats():
    assert tokens.repeat_run("a b a b a b".split())
    assert not tokens.repeat_run("no no no no".split()[:3])
    assert not tokens.repeat_run("a b a b".split())
    assert tokens.adjacent_duplicate("a b a b".split(), 0, 2)


def test_clamping_feeds_the_next_step():
    assert sequences.clamp_backsteps([1.0, 0.8, 0.6, 5.0, 2.0]) == [1.0, 1.0, 1.0, 5.0, 2.0]


def test_ledger_caps_and_replay():
    s = ledger.new_state()
    assert ledger.reserve(s, [("a", Decimal("1.50"), False)]) == "admitted"
    assert ledger.reserve(s, [("a", Decimal("1.50"), False)]) == "replayed"
    assert ledger.reserve(s, [("b", Decimal("0.11"), False)]) == "refused"
    assert ledger.reserve(s, [("b", Decimal("0.10"), True)]) == "admitted"
    assert ledger.reserve(s, [("c", Decimal("0.01"), True)]) == "refused"
    assert ledger.finish(s, "a", "settled", Decimal("1.60")) == "overrun"
    assert ledger.reserve(s, [("d", Decimal("0.01"), False)]) == "integrity_locked"


def test_released_spend_comes_back():
    s = ledger.new_state()
    ledger.reserve(s, [("a", Decimal("1.60"), False)])
    ledger.finish(s, "a", "released")
    assert ledger.reserve(s, [("b", Decimal("1.60"), False)]) == "admitted"


def test_leases():
    owner, got = ledger.lease(None, "a", 0)
    assert got and not ledger.lease(owner, "b", 10)[1] and ledger.lease(owner, "b", 600)[1] and ledger.lease(owner, "a", 10)[1]


def test_anchors_in_transcripts():
    text = "We lift, twice a week; and rest well."
    assert notes.locate(text, "Twice a WEEK") == (8, False)
    assert notes.locate(text, "lift twice a week and rest good") == (3, True)
    assert notes.locate(text, "something else entirely said here") == (None, False)


def test_note_checks():
    kept, reasons, rejected = notes.check_units([("short label", "x"), ("rest well after every hard session", "rest well"), ("use code LIFT for a discount today", "rest well")], "we rest well")
    assert len(kept) == 1 and sorted(reasons) == ["ad_or_sponsor", "label_only"] and rejected


def test_tiers_and_states():
    assert rules.tier("bench press", "bench dress", "bench press", None, True) == ("A", "two_of_three", "apple")
    assert rules.tier("a b", "a c", None, None, True)[0] == "C"
    assert rules.assisted_state("bench press now", "wrench dress now", "so bench press now ok", None)[0] == "machine_supported_apple"
    assert rules.assisted_state("x y z", "p q r", None, None)[0] == "audio_pending"


def test_choice_ladder():
    assert materiality.choose("a b", "a c", "content", "a c") == ("whisper", "third_asr")
    assert materiality.choose("big squat", "big squad", "content", None, ["squat"]) == ("apple", "registry_term")
    assert materiality.choose("a b", "a c", "content", None, (), ["apple"] * 3) == ("apple", "judge")
    assert materiality.choose("a b", "a c", "number_format") == (None, "either")
    assert materiality.choose("a b", "a c", "content") == (None, "click_one")
    assert materiality.choose("a pull down", "a pool down", "content", None, ["pulldown"]) == ("apple", "registry_term")
    assert materiality.choose("a hurdle", "a hurl", "content", None, ["rdl"]) == (None, "click_one")
    assert materiality.choose("on to", "onto the bigger top", "content", votes=["whisper", "apple", "apple"]) == ("apple", "judge_majority")
    assert materiality.choose("on to", "onto the bigger top", "content", votes=["apple", "whisper", "unclear"]) == ("whisper", "fuller")
    assert materiality.choose("ad", "", "use_whisper") == ("whisper", "advertisement")
    assert materiality.choose("e-mail", "email", "same_letters") == (None, "either")
    assert materiality.proposal("50 minutes", "um", "number") == ("apple", "number_gap")
    assert materiality.proposal("2017", "17", "number") == (None, None)
    assert materiality.proposal("a squat", "a squad", "content", "a squad", ["apple"] * 3) == (None, None)
    assert materiality.proposal("a squat", "a squad", "content", None, ["apple"] * 3) == ("apple", "judge")


def test_terms_are_found_in_any_spelling_within_reach():
    known = terms.Terms(["creatine", "bulgarian split squat", "metformin"])
    assert [t for t, *_ in known.top(["kreatine"], ["crea", "tine"])] == ["creatine"]
    assert known.top(["kreatine"], [])[0][1] == 0.875 and known.top([], ["crea", "tine"])[0][1] == round(16 / 17, 6)
    assert known.both(["kreatine", "now"], ["creatin"]) == ["creatine"]
    assert known.of_difference(["squot"], "a bulgarian split squot for the".split()) == []
    assert known.of_difference(["split"], "a bulgarian split squat for the".split()) == ["bulgarian split squat"]
    assert terms.Terms(str(i) + "x" for i in range(5001)).status == "too_large"


def test_letter_bounds_lose_no_term():
    import random
    from difflib import SequenceMatcher

    r = random.Random(4)
    known = terms.Terms({"".join(r.choices("abcdef", k=r.randint(4, 9))) for _ in range(300)})
    for _ in range(200):
        word = "".join(r.choices("abcdef", k=r.randint(3, 10)))
        want = {t: round(SequenceMatcher(None, word, known.joined[t], autojunk=False).ratio(), 6) for t in range(len(known.terms))}
        assert dict(known.near(word, 0)) == {t: s for t, s in want.items() if s >= terms.NEAR}


def test_differences_have_categories():
    known = terms.Terms(["squat", "creatine"])
    kinds = {"squat": "exercise_name", "creatine": "supplement"}

    def first(a, b):
        d = differences.differences(a, b, known, kinds)[0]
        return d.kind, d.severity, d.category

    assert first("Use 25 kilograms for this lift.", "Use 25 pounds for this lift.") == ("unit_mismatch", "high", "unit")
    assert first("Use 5 grams.", "Use 15 grams.")[2] == "protocol_number"
    assert first("The 2019 study supports it.", "The 2020 study supports it.")[2] == "citation"
    assert first("Do a squat today.", "Do a squad today.") == ("domain_term_mismatch", "medium", "exercise_name")
    assert first("start creatine end", "start end") == ("domain_term_mismatch", "high", "supplement")
    assert first("and John Smith said so", "and said so") == ("source_only_proper_name", "high", "proper_name")
    assert first("I do not lift", "I do lift")[2] == "negation"
    assert first("a split-squat rack", "a splitsquat rack") == ("representation_equivalent", "low", "other")
    assert first("start unfamiliarbiofactor end", "start end")[2] == "other"


def test_splice_spacing():
    assert rules.splice("one , two", [(3, 3, "and")]) == "one and, two"


def test_schema_paths():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "maxItems": 1, "items": {"type": "string"}}}}
    assert notes.schema_errors({"a": ["x", 1], "b": 2}, schema) == ["$.b: unknown", "$.a: too many", "$.a[1]: not a string"]
