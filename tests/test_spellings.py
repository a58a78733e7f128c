"""The registry is spelled once for all texts, not once a text."""

from collections import namedtuple

from lexweave.functions import materiality, terms
from lexweave.plans import python_ops


class Counted(list):
    read = 0

    def __iter__(self):
        self.read += 1
        return super().__iter__()


def test_chosen_readings_read_the_registry_once():
    known = terms.Terms(["creatine", "pull down"])
    known.terms = Counted(known.terms)
    row = namedtuple("Row", "episode_key id part apple whisper third before after")
    found = [python_ops.chosen_reading(row(1, k, 0, "take creatine now", "take creating now", None, "", ""), known) for k in range(20)]
    assert all(f == [(1, k, 0, "apple", "registry_term")] for k, f in enumerate(found))
    assert known.terms.read == 1


def test_spellings_are_those_of_the_list():
    listed = ["pull down", "Creatine", "beta-alanine", "!!!"]
    for a, b in (("a pulldown", "a pull up"), ("creatine", "pull down"), ("beta alanine", ""), ("x", "creatine betaalanine"), (None, "pull  down")):
        assert materiality.named_terms(a, materiality.Spellings.of(listed)) == materiality.named_terms(a, listed)
        assert materiality.term_source(a or "", b, materiality.Spellings.of(listed)) == materiality.term_source(a or "", b, listed)
    assert materiality.term_source("a pulldown", "a pull up", listed) == "apple"
