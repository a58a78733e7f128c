"""Repeated passages by brute force; media by reading tar files; pages by what was put into them."""

import hashlib
import io
import random
import tarfile
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from lexweave.llm import html_dom, media, recompress, substring_dedup, wrapper

R = random.Random(9)
BASE = [R.choice(["a", "b", "c", "dd", f"e{R.randint(0, 40)}"]) for _ in range(400)]


def rows():
    out = [(900, None), (901, ""), (902, "short")]
    for i in range(150):
        k = R.random()
        if k < 0.3:
            w = [R.choice("ab")] * R.randint(0, 200)
        elif k < 0.5:
            w = ["a", "b", "c"][: R.randint(2, 3)] * R.randint(0, 60)
        elif k < 0.8:
            a = R.randint(0, 300)
            w = [f"x{R.randint(0, 99)}" for _ in range(R.randint(0, 40))] + BASE[a : a + R.randint(20, 200)] + [f"y{R.randint(0, 99)}" for _ in range(R.randint(0, 40))]
        else:
            w = list(BASE)
            for _ in range(R.randint(0, 4)):
                w[R.randrange(400)] = f"z{R.randint(0, 9)}"
        out.append((i * 7 % 150, " \t".join(w)))
    return out


def brute(table, size):
    docs = {i: (t or "").encode().split() for i, t in table}
    first = {}
    for i, w in docs.items():
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in docs.items():
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize("size", [1, 5, 50])
def test_repeats_by_brute_force(spark, size):
    table = rows()
    df = spark.createDataFrame([(*r, 1) for r in table] + [(None, " ".join(BASE), 1)] + [(*table[5], 1)], "doc_id long, text string, key int").repartition(5)
    got = substring_dedup.remove_repeats(df, size).collect()
    want = brute(table, size)
    assert len(got) == len(table) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]
    assert substring_dedup.remove_repeats(df.limit(0), size).count() == 0


def test_equal_windows_have_equal_anchors():
    texts = [t for _, t in rows() if t]
    words = recompress.read_words(texts)
    found = recompress.anchors(words, 30)
    assert sum((found.last - found.first + 1).tolist()) == sum(max(0, len(t.split()) - 29) for t in texts)
    names, place = {}, {}
    for key, a, b in zip(found.key.tolist(), found.first.tolist(), found.last.tolist(), strict=True):
        for w in range(a, b + 1):
            content = tuple(words.name[w : w + 30].tolist())
            assert names.setdefault(content, key) == key
            place[content] = w
    assert len(names) > 100


def test_symbols_are_decided_by_their_range():
    w1 = recompress.read_words([" ".join(BASE)])
    w2 = recompress.read_words(["p q r " + " ".join(BASE[50:300]) + " s t"])
    s1, s2 = recompress.parse(w1), recompress.parse(w2)
    inside = {(int(n), int(a) - 50) for n, a, lo, hi in zip(s1.name, s1.start, s1.low, s1.high, strict=True) if lo >= 50 and hi <= 300}
    other = {(int(n), int(a) - 3) for n, a in zip(s2.name, s2.start, strict=True)}
    assert inside and inside <= other
    assert (np.diff(s1.low) >= 0).all() and (np.diff(s1.high) >= 0).all()


def test_media_round_trip(spark, tmp_path):
    table = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 576), (5, "y" * 50_000), (6, "héllo"), (None, "z")]
    folder = f"file://{tmp_path}/m"
    df = spark.createDataFrame([(*r, "clash") for r in table], "doc_id long, text string, digest string").repartition(3)
    index = media.store(df, folder, shard_bytes=2_000)
    got = index.select("id", "digest", "n_bytes").join(media.read_back(index, folder), "digest").collect()
    assert len(got) == len(table)
    fs, root = pafs.FileSystem.from_uri(folder)
    for r in got:
        payload, n = media.payload_of(dict(table)[r["id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["width"] * r["height"] == len(payload) and len(payload) % 576 == 0
        raw = fs.open_input_file(f"{root}/{r['shard']}").read()
        members = {m.name: m for m in tarfile.open(fileobj=io.BytesIO(raw))}
        m = members[f"{r['digest']}.png"]
        assert (m.offset_data, m.size) == (r["at"], r["length"])
        assert media.read_image(raw[m.offset_data : m.offset_data + m.size]) == payload
    heads = media.read_back(index, folder, whole=False).collect()
    assert all(h["payload_bytes"] == h["width"] * h["height"] and h["feature"] is None for h in heads)
    assert media.media_columns(df.limit(0), folder).count() == 0


def test_damage_is_found():
    image = bytearray(media.write_image(media.payload_of("abc")[0]))
    image[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        media.read_image(bytes(image))


def page(body, nav="<nav><a href='/'>Home</a></nav>", after="<footer>Imprint</footer>"):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{nav}{body}{after}</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("<p>only", "only"),
        (page("<article><h1>A &amp; B</h1><p>one<br>two<p>three  <b>bold</b>&nbsp;x</article>"), "A & B\none two\nthree bold x"),
        (page("<div class='ad'>Buy</div><main><p>text</p><aside>side</aside><form>f</form><div class='comments'><p>c</p></div></main>"), "text"),
        (page("<div id='content'><h2>Head</h2><p>long text of the article here</p><ul><li>a<li>b</ul></div><div class='sidebar'>s</div>"), "Head\nlong text of the article here\na\nb"),
        (page("<article><header><h1>T</h1></header><p>x</p><!-- c --><style>p{}</style></article>"), "T\nx"),
        ("<div><p>a<div>b</p>c", "a\nb\nc"),
        ("<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "</article>", "deep"),
        ('<article><p>a < b & c<p title="x>y">d</article', "a < b & c\nd"),
    ],
)
def test_one_page(html, want):
    assert wrapper.extract(html, None) == want


def test_wrapper_of_a_host(spark):
    shell = "<div class='x'><div>Same line on every page</div><div><p>{}</p><p>{}</p></div><div>All rights</div></div>"
    table = [(i, "https://h.example/a", page(shell.format(f"first {i} " + "word " * i, f"second {i}"), nav="", after="")) for i in range(12)]
    table += [(100, None, None), (101, "not a url", "<p>alone</p>"), (5, "https://h.example/a", table[5][2])]
    df = spark.createDataFrame([(*r, "clash") for r in table], "page_id long, url string, html string, pivot string").repartition(4)
    got = wrapper.main_text(df).collect()
    assert len(got) == len(table)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"first {i} " .rstrip() + (" " + " ".join(["word"] * i) if i else "") + f"\nsecond {i}" for i in range(12))
    assert text[100] == "" and text[101] == "alone"
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_tree_matching_keeps_order():
    a, b = (wrapper.skeleton(html_dom.parse(h)) for h in ("<div><p>1</p><ul><li>2</ul><h2>3</h2></div>", "<div><p>1</p><h2>3</h2><ul><li>2</ul></div>"))
    assert wrapper.tree_match(a, b)[0] == 5
    assert wrapper.tree_match(a, a)[0] == 6
