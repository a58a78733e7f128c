"""Language identification by held-out accuracy; packing and BPE by the library and by exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexweave.llm import language, lexicon, packing, word_bpe
from lexweave.llm.bpe import ByteLevelEncoder

SF = "/root/testdata/sf0.01"
R = random.Random(3)
ATOMS = ["a", "b", " ", "  ", "\n", "'", "s", "1", "é", "漢", "\t", ".", "$", "<|endoftext|>", " ", "\x1c", "ll", "Σ", "İ", "ﬁ", "́", "A", "_", "\x00", "the ", "thonti"]
ODD = ["", " ", "a" * 3000, "it's they'll", " x", "x "] + ["".join(R.choice(ATOMS) for _ in range(R.randint(0, 14))) for _ in range(1500)]


def test_byte_level_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = ByteLevelEncoder(path), Tokenizer.from_file(path)
    for t in ODD:
        assert ours.ids(t) == np.array(theirs.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_word_ids_and_decoding(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    file = tmp_path / "lexicon"
    file.write_bytes(word_bpe.compile_lexicon(path))
    ours, theirs = word_bpe.WordEncoder(path, str(file)), Tokenizer.from_file(path)
    for t, (ids, decoded) in zip(ODD, ours.encode(ODD), strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert (ids, decoded) == (np.array(want, "<u4").tobytes(), theirs.decode(want, skip_special_tokens=False)), repr(t)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({"".join(R.choice("abc") for _ in range(R.randint(1, 6))).encode() for _ in range(300)})
    arrays = lexicon.build([(w, [i, i + 1]) for i, w in enumerate(words)] + [(b"", [1])])
    file = tmp_path / "l"
    file.write_bytes(lexicon.to_bytes(arrays))
    lex = lexicon.Lexicon(str(file))
    assert lex.ranks(words).tolist() == list(range(len(words)))
    assert all(lex.output(i).tolist() == [i, i + 1] for i in range(len(words)))
    others = [w for w in (b"", b"z", b"abcabcabc", *(w + b"c" for w in words)) if w not in set(words)]
    assert set(lex.ranks(others).tolist()) == {-1}
    # no two states have the same right language
    keys, targets, final = arrays["keys"], arrays["targets"], arrays["final"]
    seen = {(int(f), tuple((int(k) % 256, int(t)) for k, t in zip(keys[keys // 256 == s], targets[keys // 256 == s], strict=True))) for s, f in enumerate(final)}
    assert len(seen) == len(final)


def test_empty_lexicon(tmp_path):
    file = tmp_path / "l"
    file.write_bytes(lexicon.to_bytes(lexicon.build([])))
    assert lexicon.Lexicon(str(file)).ranks([b"a", b""]).tolist() == [-1, -1]


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language_model(docs)
    rows = docs.filter(language.held_out()).filter("lang IS NOT NULL").select("text", "lang").collect()
    got = model.predict([r["text"] for r in rows])
    assert sum(g[0] == r["lang"] for g, r in zip(got, rows, strict=True)) / len(rows) > 0.98
    assert not any(g[2] for g in got)
    assert all(0 <= g[1] <= 1 for g in got)


FOREIGN = [
    "Gallia est omnis divisa in partes tres quarum unam incolunt Belgae", "Привет как дела сегодня хорошая погода на улице", "今日は天気がいいですね、散歩に行きましょう", "오늘은 날씨가 아주 좋습니다",
    "Dzisiaj jest bardzo ładna pogoda i idziemy na spacer do parku", "Bugün hava çok güzel ve parka yürüyüşe gidiyoruz", "Tänään on hyvin kaunis ilma ja menemme kävelylle puistoon", "Ma nagyon szép idő van és sétálni megyünk a parkba",
    "Dnes je velmi hezké počasí a jdeme na procházku do parku", "Hari ini cuacanya sangat bagus dan kami pergi berjalan kaki", "Hôm nay thời tiết rất đẹp và chúng tôi đi dạo trong công viên", "اليوم الطقس جميل جدا ونحن ذاهبون للتنزه",
    "היום מזג האוויר יפה מאוד ואנחנו הולכים לטייל", "आज मौसम बहुत अच्छा है और हम टहलने जा रहे हैं", "Σήμερα ο καιρός είναι πολύ ωραίος και πάμε βόλτα", "Leo hali ya hewa ni nzuri sana na tunaenda kutembea",
    "xqzv wkjf plmk zzrt qqpw vbnm", "lorem ipsum dolor sit amet consectetur adipiscing elit", "jjkw qxzz vvkp wqjx zkqv", "Gaur eguraldi oso ona egiten du eta parkera goaz",
]


def test_foreign_lines_are_rejected(spark):
    model = language.fit_language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    rejected = [g[2] for g in model.predict(FOREIGN)]
    assert sum(rejected) >= 0.75 * len(FOREIGN)
    for line in ("The cat sits on the mat and the dog runs in the park", "Le chat est assis sur le tapis et le chien court dans le parc", "Der Hund läuft durch den Park und die Katze ist auf der Matte"):
        assert not model.predict([line])[0][2]


def test_scripts_are_told_apart_from_one_learned_language():
    model = language.train([(f"the cat number {i} is on the mat and it is here", "en") for i in range(80)])
    assert [g[2] for g in model.predict(["the cat is here", FOREIGN[1], FOREIGN[2]])] == [False, True, True]


def test_both_ways_to_draw_the_sample_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(language, "train", lambda rows: sorted(rows))
    few = language.fit_language_model(docs)
    monkeypatch.setattr(language, "LANGS_BROADCAST", 0)
    assert few == language.fit_language_model(docs) and len(few) > 500


def test_every_language_is_learned():
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x{chr(97 + k % 7)} word{chr(97 + k // 26)}{chr(97 + k % 26)} " * 4, f"l{k:03}") for k in range(250) for _ in range(2)]
    assert len(language.train(rows).langs) == 250


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate([("le chat est la", "fr"), ("the cat is here", "en")] * 30 + [(None, None), ("", "en"), ("123 !!", "fr")])], "doc_id long, text string, lang string, lang_pred int")
    model = language.fit_language_model(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (60, 61, 62)] == ["und"] * 3 and got[60]["lang_rejected"]
    assert got[0]["lang_pred"] == "fr" and got[1]["lang_pred"] == "en"
    none = language.fit_language_model(docs.limit(0))
    assert [r["lang_pred"] for r in language.identify(docs, none).limit(2).collect()] == ["und", "und"]
    assert language.identify(docs.limit(0), model).count() == 0


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 64), (7, 2), (5, 64)])
def test_packing_round_trip(spark, parts, fan_in):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "a", "word " * 1500, *("x y " * R.randint(0, 400) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(1, "", 0)], "doc_id long, text string, part int").repartition(parts)
    got = packing.pack(docs, path, open_windows=4, fan_in=fan_in).collect()
    encode = Tokenizer.from_file(path).encode
    for i, t in enumerate(texts):
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        if i == 1:
            assert [(r["start"], r["length"]) for r in own] == [(0, 1), (0, 1)]
            continue
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for w in windows.values():  # every window but the last lacks less than a cut
        assert all(sum(n for _, n in sorted(w)[:k]) == o for k, (o, _) in enumerate(sorted(w)))
        total = sum(n for _, n in w)
        assert 0 < total <= 1024
        short += total <= 1024 - packing.CUT_LEAST
    assert short <= 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_word_ids_of_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello World", "x"), (3, "Hello World", "x"), (None, "ß Straße", "x"), (4, "word " * 30_000, "x")], "doc_id long, text string, ids string")
    theirs, got = Tokenizer.from_file(path), word_bpe.encode_words(docs, path).collect()
    assert len(got) == 6
    of = {1: "", 2: "", 3: "Hello World", None: "ß Straße", 4: "word " * 30_000}
    for r in got:
        ids = theirs.encode(of[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], bytes(r["ids"]), r["decoded"]) == (len(ids), np.array(ids, "<u4").tobytes(), theirs.decode(ids, skip_special_tokens=False))
    assert word_bpe.encode_words(docs.limit(0), path).count() == 0
