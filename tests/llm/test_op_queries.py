"""Each registered query over the whole smallest tables, against brute force."""

import hashlib
import html
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import test_near_text
import test_passages_media_pages as passages
import test_pii
import test_simhash
from tokenizers import Tokenizer

from lexweave.llm import media, pii, queries

SF = "/root/testdata/sf0.001"


def run(spark, name):
    got = queries.QUERIES[name](spark, SF)
    return got.columns, got.collect()


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def sha(raw):
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def test_op1(spark, texts):
    for r in run(spark, "op1_crf_pii")[1]:
        base = test_pii.plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == sha(pii.show(base))
        assert set(filter(None, pii.show(base).split(","))) <= set(r["spans"].split(","))


def test_op2(spark):
    pages = {i: (u, h) for i, u, h in duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()}
    _, got = run(spark, "op2_wrapper_induction")
    assert len(got) == len(pages)
    for r in got:
        url, page = pages[r["page_id"]]
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
        want = "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks)))
        assert (r["url"], r["text"], r["n_chars"]) == (url, want, len(want))


def test_op3(spark, texts):
    _, got = run(spark, "op3_sampled_splitters")
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t in texts.items())
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def samples_of(image):
    """The samples of an 8-bit grey PNG of unfiltered lines, by the format's rules."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data = 8, b""
    while at < len(image):
        size, kind = int.from_bytes(image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        assert int.from_bytes(image[at + 8 + size : at + 12 + size]) == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height, rest = int.from_bytes(body[:4]), int.from_bytes(body[4:8]), body[8:]
            assert rest == bytes([8, 0, 0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    plain = zlib.decompress(data)
    lines = [plain[i * (width + 1) : (i + 1) * (width + 1)] for i in range(height)]
    assert kind == b"IEND" and all(line[0] == 0 for line in lines)
    return b"".join(line[1:] for line in lines)


def feature_by_hand(payload):
    n, total, squares = len(payload), sum(payload), sum(b * b for b in payload)
    bins = [0] * 8
    for b in payload:
        bins[b // 32] += 1
    return f"mean={total * 1000 // n};std={int(((squares * n - total * total) / (n * n)) ** 0.5 * 1000)};hist={'/'.join(map(str, bins))}"


def test_op4(spark, texts):
    for r in run(spark, "op4_tar_media")[1]:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        image = media.write_image(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), sha(image)) and samples_of(image) == payload
        assert r["feature"] == feature_by_hand(payload)


def test_op5(spark, texts):
    fp = {i: test_simhash.plain(t) for i, t in texts.items()}
    want = test_simhash.union(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op5_multi_index_simhash")[1]} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_op6(spark):
    columns, got = run(spark, "op6_content_sort")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op6_content_sort"])
    assert columns == want.columns and sorted(map(tuple, got)) == sorted(want.fetchall())


def test_op7(spark, texts):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    _, got = run(spark, "op7_subword_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and langs[r["doc_id"]]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_op8_and_op10(spark, texts):
    byte, word = (Tokenizer.from_file(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    pieces = {}
    for r in run(spark, "op8_online_packing")[1]:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in texts.items():
        ids = np.array([*byte.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [(r["start"], r["length"], r["doc_tokens"]) for r in own] == [(a, b - a, len(ids)) for a, b in zip([r["start"] for r in own], [*(r["start"] for r in own[1:]), len(ids)], strict=True)]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    for r in run(spark, "op10_transducer_bpe")[1]:
        ids = word.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(word.decode(ids, skip_special_tokens=False)))


def test_op9(spark, texts):
    want = passages.brute(list(texts.items()), 50)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, "op9_recompression")[1]} == {i: (n, k, sha(t)) for i, (n, k, t) in want.items()}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        if name == "language_id":
            assert got.keys() == {i for i, r in kept.items() if re.search(r"[^\W\d_]", r["text"] or "")}
        elif name == "exact_dedup":
            last = {r["text"] or "": i for i, r in sorted(kept.items())}
            assert got.keys() == set(last.values())
        elif name == "near_dedup":
            assert got.keys() == test_near_text.kept([(i, r["text"]) for i, r in kept.items()])
        else:
            assert got.keys() == kept.keys() and not any(test_pii.plain(r["text"] or "") for r in got.values())
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        docs, kept = out, got
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == kept.keys()
