"""Readers and writers on files of each format."""

import random

from pyspark.sql import functions as F

from lexweave.operators.ranks import global_rank
from lexweave.sources import readers, writers


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode("utf-8"))
    return str(path)


def all_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_episode_index(spark, tmp_path):
    path = put(tmp_path, "episodes.json", """[
        {"episode_key": "a", "podcast": "P", "published": "2026-01-01", "status": {"whisper": {"state": "ready", "updated_at": "x"}}},
        {"episode_key": "b", "title": null}
    ]""")  # fmt: skip
    assert all_of(readers.read_episodes(spark, path).select("episode_key", "podcast", "state"), "episode_key") == [("a", "P", "ready"), ("b", None, "pending")]


def test_keyed_objects_and_ledgers(spark, tmp_path):
    put(tmp_path, "episodes/k1/review/resolver.json", '{"cards": 3}')
    put(tmp_path, "episodes/k2/review/resolver.json", '{"cards": 5}')
    got = readers.read_keyed_json(spark, f"{tmp_path}/episodes/*/review/resolver.json", "cards int", r"episodes/([^/]+)/")
    assert all_of(got, "file_key") == [("k1", 3), ("k2", 5)]
    put(tmp_path, "ledgers/a.json", '{"episode_key": "e", "source_fingerprint": "f", "attempts": {"1": {"state": "settled", "stage": "judge", "third_asr": false, "reserved_usd": "0.10", "settled_usd": "0.08"}, "2": {"state": "reserved", "reserved_usd": "bad"}}}')
    assert [(r["attempt_id"], r["state"], str(r["reserved_usd"]), str(r["settled_usd"])) for r in readers.read_ledgers(spark, f"{tmp_path}/ledgers/*.json").orderBy("attempt_id").collect()] == [("1", "settled", "0.100000", "0.080000"), ("2", "reserved", "None", "None")]


def test_feeds(spark, tmp_path):
    path = put(tmp_path, "feed.xml", """<?xml version="1.0"?>
<rss version="2.0"><channel><title>Show &amp; tell</title><link>https://x.example</link>
  <item><title>Newest &lt;one&gt;</title><guid isPermaLink="false"> g-1 </guid><link>https://x.example/1</link><pubDate>Sat, 03 Oct 2026 13:00:00 -0000</pubDate><enclosure url="https://x.example/1.mp3" type="audio/mpeg"/></item>
  <item><title>Older</title><link>https://x.example/0</link></item>
  <item><title>Oldest</title></item>
</channel></rss>""")
    entries = readers.read_feeds(spark, path)
    assert [r["guid"] for r in entries.orderBy("place").collect()] == ["g-1", "https://x.example/0", "Oldest"]
    first = readers.newest_entries(entries).collect()[0]
    assert (first["podcast"], first["title"], first["published"], first["audio_url"]) == ("Show & tell", "Newest <one>", "Sat, 03 Oct 2026 13:00:00 -0000", "https://x.example/1.mp3")


def test_captions(spark, tmp_path):
    put(tmp_path, "t/one.ttml", """<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata" xmlns:podcasts="http://podcasts.example/ns"><body><div>
      <p begin="1.5" end="0:03.25" ttm:agent="SPEAKER_1"><span podcasts:unit="sentence"><span podcasts:unit="word" begin="1.5">Hello</span><span podcasts:unit="word">,</span> <span podcasts:unit="word">R&amp;D</span></span></p>
      <p begin="bad"><span podcasts:unit="sentence">no words</span></p><p><span podcasts:unit="word">Bye</span><span podcasts:unit="word">!</span></p></div></body></tt>""")
    assert all_of(readers.read_captions(spark, f"{tmp_path}/t", key=r"([^/]+)\.ttml$"), "paragraph") == [("one", 0, "Hello, R&D", 1.5, 3.25, "SPEAKER_1", 3), ("one", 1, "Bye!", None, None, None, 2)]
    assert [readers.clock(x) for x in ("12.5", "1:02", "1:02:03.5", "7s", "x", None, "1:2:3:4")] == [12.5, 62.0, 3723.5, 7.0, None, None, None]


def test_texts_and_notes(spark, tmp_path):
    put(tmp_path, "x/a.txt", b"\xef\xbb\xbfone\r\ntwo\n")
    assert all_of(readers.read_texts(spark, f"{tmp_path}/x")) == [("a", "one\r\ntwo\n")]
    put(tmp_path, "n/deep/one.md", "---\ntitle: 'A: note'\ntags:\n  - x\nepisode: e1\n---\nBody\n")
    put(tmp_path, "n/none.md", "No block\n")
    put(tmp_path, "n/other.txt", "---\ntitle: t\n---\n")
    got = readers.read_notes(spark, f"{tmp_path}/n").collect()
    assert [(r["path"], r["title"], dict(r["keys"]), r["body"]) for r in got] == [("one.md", "A: note", {"title": "A: note", "tags": "", "episode": "e1"}, "Body\n")]


def test_word_metadata(spark, tmp_path):
    path = put(tmp_path, "m.json", '{"episode_key": "e", "segments": [{"start": 1, "avg_logprob": -0.2, "no_speech_prob": 0.1, "words": [{"word": "a", "probability": 0.5}, {"word": "b", "logprob": -0.7, "start": 2.5}]}, {"words": [{"word": "c", "probability": 0}, {"word": "d", "probability": "NaN"}, {"word": "e", "probability": 1}]}]}')
    got = [(r["word"], r["logprob"], r["origin"], r["start"]) for r in readers.read_word_metadata(spark, path).orderBy("segment", "place").collect()]
    assert got[:2] == [("a", -0.2, "segment", 1.0), ("b", -0.7, "word", 2.5)]
    assert got[2][0] == "c" and abs(got[2][1] + 27.631) < 0.001 and got[3] == ("d", None, None, None) and got[4] == ("e", 0.0, "probability", None)


MESH = """<?xml version="1.0"?><DescriptorRecordSet><DescriptorRecord DescriptorClass="1"><DescriptorUI>D001</DescriptorUI><DescriptorName><String>Creatine </String></DescriptorName>
<ConceptList><Concept><TermList><Term><String>creatine</String></Term><Term><String>Methyl  Glycocyamine</String></Term></TermList></Concept><Concept><TermList><Term><String>methyl glycocyamine</String></Term><Term><String>N-Amidino</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
<DescriptorRecord><DescriptorUI>D002</DescriptorUI><DescriptorName><String>Alone</String></DescriptorName></DescriptorRecord></DescriptorRecordSet>"""
OWL = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:skos="http://www.w3.org/2004/02/skos/core#" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#">
<owl:Class rdf:about="http://x.example/1"><rdfs:label xml:lang="en">Squat</rdfs:label><oboInOwl:hasExactSynonym>knee bend</oboInOwl:hasExactSynonym><skos:altLabel>Knee Bend</skos:altLabel><skos:altLabel>squat</skos:altLabel></owl:Class>
<owl:Class rdf:about="http://x.example/2"><skos:prefLabel>Press</skos:prefLabel></owl:Class><owl:Class rdf:about="http://x.example/3"/></rdf:RDF>"""


def test_vocabularies(spark, tmp_path):
    assert all_of(readers.read_mesh(spark, put(tmp_path, "mesh.xml", MESH)), "source_id") == [("Creatine", "D001", ["Methyl Glycocyamine", "N-Amidino"]), ("Alone", "D002", [])]
    assert all_of(readers.read_owl(spark, put(tmp_path, "o.owl", OWL)), "source_id") == [("Squat", "http://x.example/1", ["knee bend"]), ("Press", "http://x.example/2", [])]


def test_dimensions(spark, tmp_path):
    path = put(tmp_path, "lexicon.json", '{"exercises": ["Squat", " squat "], "units": ["kg"]}')
    assert all_of(readers.read_lexicon(spark, path, {"units": ["LB", "kg"]}), "kind", "term") == [("exercises", "squat"), ("units", "kg"), ("units", "lb")]
    path = put(tmp_path, "golden.json", "\n".join('{"case_id": "%s", "provenance_group": "%s", "partition": "%s"}' % x for x in (("1", "a", "train"), ("1", "a", "train"), ("2", "b", "train"), ("3", "b", "test"))))
    assert all_of(readers.read_golden(spark, path)[1], "rule") == [("case_id", "1"), ("partition", "b")]
    path = put(tmp_path, "payload.json", '{"id": 1, "message": {"items": [{"title": ["T"], "DOI": "d", "score": 80}, {"title": ["U"], "score": 10}]}, "results": [{"title": "V", "doi": "e"}]}')
    assert all_of(readers.read_bibliography(spark, path), "title") == [(1, "T", "d", 1.0, "first"), (1, "U", None, 0.25, "first"), (1, "V", "e", None, "second")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "one"), ("b.md", None), ("c.md", "é")], "name string, text string").repartition(2)
    for _ in range(2):
        assert all_of(writers.write_files(rows, f"file://{tmp_path}/out"), "name") == [("a.md", 3), ("c.md", 2)]
    assert sorted((f.name, f.read_text()) for f in (tmp_path / "out").iterdir()) == [("a.md", "one"), ("c.md", "é")]
    stored = spark.createDataFrame([("a.md", "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed")], "name string, digest string")
    assert {r["name"] for r in writers.changed_only(rows, stored, "name").collect()} == {"b.md", "c.md"}
    table = spark.range(1).select(writers.markdown_table("T", ["x", "y"], F.array(F.array(F.lit("a|b"), F.lit("c\nd"))))).first()[0]
    assert table == "# T\n\n| x | y |\n|---|---|\n| a\\|b | c d |\n"


def test_receipts_are_written_once(spark):
    old = spark.createDataFrame([("a", "1", "t0"), ("b", "1", "t0"), ("c", "9", "t0")], "k string, digest string, confirmed_at string")
    new = spark.createDataFrame([("a", "1", "t5"), ("b", "1", "t2"), ("b", "2", "t3"), ("d", "4", "t1")], "k string, digest string, confirmed_at string")
    want = [("a", "1", "t0"), ("b", "2", "t3"), ("c", "9", "t0"), ("d", "4", "t1")]
    after = writers.record_receipts(old, new, "k")
    assert all_of(after, "k") == want and all_of(writers.record_receipts(after, new, "k"), "k") == want


def test_global_rank(spark):
    r = random.Random(8)
    values = r.sample(range(10_000), 500)
    df = spark.createDataFrame([(v, "hot" if v % 3 else str(v)) for v in values], "v long, s string").repartition(5)
    got = global_rank(df, [F.col("s"), F.desc("v")], partitions=7).collect()
    want = sorted(((("hot" if v % 3 else str(v)), -v) for v in values))
    assert [(x["s"], -x["v"]) for x in sorted(got, key=lambda x: x["place"])] == want and sorted(x["place"] for x in got) == list(range(1, 501))
    assert global_rank(df.limit(0), [F.col("v")]).count() == 0
