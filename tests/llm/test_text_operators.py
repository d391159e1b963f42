"""Secrets, fingerprints, quality, HTML and WARC: operators that look at one row, or at a row and its group."""

import base64
import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stylematch.llm import fingerprints, hashing, html_text, quality, secret_scan, warc  # noqa: E402
from stylematch.llm.queries import QUERIES  # noqa: E402

from helpers import WORD, fold  # noqa: E402

DOCS = "doc_id long, text string, source string, spans string, score double"
ODD = [None, "", " \n\t ", "x", "a" * 70_000, "één twee\x0bdrie", "same line\nsame line", "same line\nsame line"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i if i else None, t, None, "clash", 1.0) for i, t in enumerate(ODD)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_match_the_plain_split():
    texts = ["", "One two  three", None, " lead", "trail ", "\n\t", "é à\x0cü", "no\xa0break"]
    at = 0
    for row, data, offsets in hashing.text_chunks(pa.array(texts), 8):
        starts, ends, bounds = hashing.words(data, offsets)
        hashes = hashing.word_hashes(data, starts, ends)
        for i in range(len(offsets) - 1):
            want = WORD.findall(fold(texts[row + i]))
            got = [bytes(data[a:b]).decode() for a, b in zip(starts[bounds[i]:bounds[i + 1]], ends[bounds[i]:bounds[i + 1]])]
            assert [fold(g) for g in got] == want
            for word, h in zip(want, hashes[bounds[i]:bounds[i + 1]]):
                raw = np.frombuffer(word.encode(), np.uint8)
                assert h == hashing.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
            at += 1
    assert at == len(texts)


def test_secrets_of_a_text():
    key = "q9Zk3Lx8Vb2Nw7Rt5Ys1"
    text = f"PassWord: '{key}' then AKIA{'B' * 16} and {'0a' * 8} é token=short secret  =  'abcdef/ghi+jk'"
    found = secret_scan.base_spans(text)
    assert [(k, text[a:b]) for a, k, b in sorted(found)] == [
        (0, f"PassWord: '{key}"), (1, "AKIA" + "B" * 16), (2, "0a" * 8), (0, "secret  =  'abcdef/ghi+jk")]
    assert not secret_scan.base_spans("AKIAB 0123456789abcde paſſword=abcdefghijklmnop toKen=abcdefghijklmnop")


def test_novel_strings_need_context_and_surprise():
    random = "Zx81Kq0vNw34RtLp77Ys"
    known = f"authorization bearer {random} end"
    spans = secret_scan.novel_spans(known, [])
    assert [known[a:b] for a, _, b, _ in spans] == [random]
    assert not secret_scan.novel_spans(f"plain words {random} end", [])
    assert not secret_scan.novel_spans("auth password_password_password1 end", [])
    assert not secret_scan.novel_spans(known, [(21, 0, 21 + len(random))])


def test_novel_strings_of_every_alphabet_and_length():
    import random

    rng = random.Random(3)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    found, asked = {}, {}
    for alphabet in (digits + "ABCDEF", upper + "234567", lower + digits, lower + upper, lower + upper + digits + "+/", lower):
        for n in (16, 32, 63, 64, 128, 256, 800, 2000):
            for _ in range(20):
                value = "".join(rng.choices(alphabet, k=n))
                text = f"the signing_key of the server is {value} and then more text"
                got = [text[a:b] for a, _, b, _ in secret_scan.novel_spans(text, [])]
                asked[alphabet, n] = asked.get((alphabet, n), 0) + any(c.isalpha() for c in value)
                found[alphabet, n] = found.get((alphabet, n), 0) + (got == [value])
    print({k: (found[k], asked[k]) for k in asked if found[k] < asked[k]})
    assert all(found[k] >= 0.9 * asked[k] for k in asked) and sum(found.values()) >= 0.99 * sum(asked.values())
    words = secret_scan.IDENTIFIERS.split()
    plain = ["_".join(rng.choices(words, k=k)) for k in (3, 8, 20, 100) for _ in range(20)]
    plain += ["".join(w.title() for w in rng.choices(words, k=k)) for k in (3, 8, 20, 100) for _ in range(20)]
    plain += ["internationalization", "characteristically", "getElementByIdentifierName", "a" * 200, "ab01" * 100]
    assert not [p for p in plain if secret_scan.novel_spans(f"auth key {p} end", [])]


def test_novel_strings_beside_many_others():
    value = "q9Xv2LmZ7RtB4KcW8NdY3HsF6GjP1TaE"
    known = [(i, 2, i + 10 if i else 100) for i in range(0, 5000, 20)]
    for at, want in ((30, []), (5010, [(5017, 3, 5017 + len(value))])):
        text = " " * at + "secret " + value
        assert [s[:3] for s in secret_scan.novel_spans(text, known)] == want
    many = " ".join(f"token={i:032x}" for i in range(20000)) + " secret " + value
    assert [s[:3] for s in secret_scan.novel_spans(many, secret_scan.base_spans(many))][-1][2] == len(many)


def test_secret_query_matches_plain_scan(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op1_secret_scan"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        spans = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        told = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        row = got[doc_id]
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(1 for s in spans if s[1] == k) for k in range(3)]


def test_secrets_of_odd_rows(odd, none):
    rows = secret_scan.find_secrets(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == [] for r in rows if r.doc_id != 4)
    assert secret_scan.find_secrets(none).count() == 0


def test_fingerprints_are_multisets():
    one, two, three = "first par", "second, longer paragraph", "third"
    whole = fingerprints.fingerprint(f"{one}\n{two}\n{three}")
    assert whole == fingerprints.fingerprint(f"{three}\n{one}\n{two}")
    assert whole != fingerprints.fingerprint(f"{one}\n{two}\n{three}\n{three}")
    assert fingerprints.insert(fingerprints.fingerprint(f"{one}\n{two}"), three) == whole
    assert fingerprints.insert(whole, two, -1) == fingerprints.fingerprint(f"{one}\n{three}")
    decoded = fingerprints.decode(whole)
    assert fingerprints.encode(*decoded) == whole and fingerprints.likeness(decoded, decoded) == 1.0


def test_lanes_of_repetitive_texts_do_not_wrap():
    text = "a " * 40_000
    whole, half = fingerprints.fingerprint(text), fingerprints.fingerprint(text[:40_000] + "b c d e f " * 100)
    assert fingerprints.likeness(fingerprints.decode(whole), fingerprints.decode(half)) > 0.9
    assert fingerprints.insert(fingerprints.insert(half, text), text, -1) == half


def test_fingerprint_query_matches_plain_edit(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op5_document_fingerprints"](spark, sf).collect()}
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    ids = sorted(docs, reverse=True)
    assert sorted(got) == sorted(docs)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        k = len(docs[a]) // 2
        edited = docs[a][:len(docs[a]) - k] + docs[b][:k]
        row = got[a]
        assert (row.n_chars, row.edited_sha256) == (len(docs[a]), hashlib.sha256(edited.encode()).hexdigest())
        assert row.fingerprint == fingerprints.fingerprint(docs[a]) and row.edited_fingerprint == fingerprints.fingerprint(edited)
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


@pytest.mark.parametrize("hot", [None, 7, 5000])
def test_fingerprints_with_an_id_on_half_of_the_rows(spark, hot):
    from pyspark.sql import functions as F

    data = [(hot if i % 2 else i, f"text {i % 1500} of a row, {'word ' * (i % 5)}") for i in range(4000)] + [(hot, "")] * 20
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = fingerprints.fingerprint_edits(docs, range_rows=200)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(data) and max(sizes) < 700
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    order = [tuple(r) for r in docs.orderBy(key.desc(), F.when(key == (-(1 << 63) if hot is None else hot), F.xxhash64("text")).otherwise(0), "text").collect()]
    want = []
    for (doc_id, text), (_, other) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want.append((str(doc_id), hashlib.sha256((text[:len(text) - half] + other[:half]).encode()).hexdigest()))
    assert sorted(want) == sorted((str(r.doc_id), r.edited_sha256) for r in out.collect())


def test_fingerprints_of_odd_rows(spark, odd, none):
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].fingerprint == by_id[7].fingerprint and by_id[7].near_next == 1.0
    assert by_id[1].n_chars == by_id[None].n_chars == 0 and by_id[1].fingerprint == by_id[None].fingerprint
    assert fingerprints.fingerprint_edits(none).count() == 0
    alone = fingerprints.fingerprint_edits(odd.filter("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    repeated = fingerprints.fingerprint_edits(odd.filter("doc_id = 5").unionByName(odd.filter("doc_id = 5"))).collect()
    assert len(repeated) == 2


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = quality.fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97
    row = x[1700]
    total = forest.base
    for feature, cut, value in zip(forest.feature, forest.cut, forest.value):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + (row[feature[node]] > cut[node])
        total += value[node - len(feature)]
    assert forest.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.fit(x, np.ones(len(x))).score(x[:2])[0] > 0.99
    assert quality.fit(np.zeros((0, 4)), np.zeros(0)).score(x[:1])[0] == 0.5


def test_quality_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    import zlib

    got = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, sf).collect()}
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert len(held) > 40 and np.mean([p == q for p, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_the_fitted_sample_is_bounded_by_rows(spark, monkeypatch):
    rows = [(1, f"text {i} of an id with very many rows") for i in range(3000)] + [(i, f"another text {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    seen, learn = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or learn(x, y))
    quality.train(docs, labels, 500)
    quality.train(docs.filter("doc_id > 1"), labels, 500)
    held_out = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(2, 60))
    assert seen == [500, 58 - held_out]


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality long")
    forest = quality.train(odd, labels)
    rows = quality.score_documents(odd, forest).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(none, quality.train(none, labels.limit(0))).count() == 0
    assert quality.keep_good(odd, quality.train(none, labels)).count() == len(ODD)
    assert quality.keep_good(odd, forest).columns == odd.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>hidden</p> --><div id="cookie-notice">We use cookies, really</div>
<div class="sidebar"><p>Side, text, with, many, commas</p></div>
<div class="post"><header><h2>Title &amp; more</h2><span>by X</span></header><p>First
   para&nbsp;here, <b>bold</b> text.<p>Second &lt;b&gt; <a href="x>y">link</a><br>next<script>var t="</p>";</script> end</p>
<ul><li>one<li>two</ul><form><input>go</form><div class="ad">Buy</div>
<div class="comments"><p>Nice article, thanks, very, much, appreciated</p></div></div><footer>foot</footer>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Title & more\nFirst para here, bold text.\nSecond <b> link next end\none\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div class=ad>x</div>") == ""
    assert html_text.main_text("only text") == "only text"
    assert html_text.main_text("<article><p>a</p></article><div class=ad>long advert, with commas, and words</div>") == "a"
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html_text.main_text("a < b and c > d") == "a < b and c > d"


def test_nothing_beside_the_best_container_is_lost():
    paragraphs = [f"Paragraph {i}, with commas, and words, enough of them." for i in range(40)]
    long = "".join(f"<p>{p}</p>" for p in paragraphs)
    for n in (5, 40):
        got = html_text.main_text(f"<article><h1>Title</h1><div>{''.join(f'<p>{p}</p>' for p in paragraphs[:n])}</div></article>")
        assert got.split("\n") == ["Title", *paragraphs[:n]]
    whole = "\n".join(paragraphs)
    assert html_text.main_text(f"<article><section>{long}</section><section><p>Short end.</p></section></article>") == whole + "\nShort end."
    assert html_text.main_text(f"<main><header><h1>T</h1></header><div><div>{long}</div></div><p>End.</p></main>") == f"T\n{whole}\nEnd."
    menu = "<ul><li><a href=a>Other pages</a><li><a href=b>More pages</a></ul>"
    assert html_text.main_text(f"<div><h2>T</h2><p>Short.</p><div>{long}</div>loose words{menu}<p>Last.</p></div>") == f"T\nShort.\n{whole}\nloose words\nLast."
    assert html_text.main_text(f"<div><h1>T</h1><div><div>{long}</div></div></div>") == f"T\n{whole}"


def test_names_of_noise_are_no_proof_alone():
    paragraphs = [f"Paragraph {i}, with commas, and words, enough of them." for i in range(8)]
    long, whole = "".join(f"<p>{p}</p>" for p in paragraphs), "\n".join(paragraphs)
    for element in ("div class='content has-sidebar'", "div id='post' class='share-enabled'", "div class='page with-comments'",
                    "section class='related-work'", "form action=x", "div class=widget", "div class='content share'"):
        tag = element.split()[0]
        assert html_text.main_text(f"<nav>menu</nav><{element}><h1>T</h1>{long}</{tag}><footer>x</footer>") == f"T\n{whole}"
        assert html_text.main_text(f"<{element}><main><h1>T</h1>{long}</main></{tag}>") == f"T\n{whole}"
        assert html_text.main_text(f"<header><h1>Site</h1></header><{element}><article>{long}</article></{tag}>") == whole
    inner = "<div class='comments'><p>Nice, nice, very nice</p></div><form><p>Search, find</p></form>"
    assert html_text.main_text(f"<form><div class='page with-comments'><h1>T</h1>{long}{inner}</div></form>") == f"T\n{whole}"
    talk = "<div class=comments>" + "<article class=comment><p>Much, longer, comments, than, the text itself, by far.</p></article>" * 50 + "</div>"
    assert html_text.main_text(f"<article><h1>T</h1>{long}</article>{talk}") == f"T\n{whole}"
    assert html_text.main_text(f"<div class=post><h1>T</h1>{long}{talk}</div>") == f"T\n{whole}"


def test_layouts_around_an_article():
    long = "".join(f"<p>Paragraph {i}, with commas, and words, enough of them.</p>" for i in range(8))
    whole = "\n".join(f"Paragraph {i}, with commas, and words, enough of them." for i in range(8))
    text = html_text.main_text
    assert text(f"<main><h1>Title</h1><div>By A</div><article>{long}</article></main>") == f"Title\nBy A\n{whole}"
    assert text(f"<main><h1>Title</h1><div><article>{long}</article></div></main><div>Imprint of the page</div>") == f"Title\n{whole}"
    assert text(f"<main><article>{long}</article><article><p>Second, short.</p></article></main>") == f"{whole}\nSecond, short."
    assert text(f"<div>Some site</div><article>{long}</article><article><p>Second, short.</p></article><div>All of it</div>") == f"{whole}\nSecond, short."
    assert text(f"<div id=content><article>{long}</article><section>rest</section><ul><li><a href=x>Next</a></ul></div>") == f"{whole}\nrest"
    assert text(f"<article>{long}<ol class=commentlist><li>Nice, nice, nice</ol><ol id='commentList'><li>Nice</ol></article>") == whole
    assert text(f"<div class=post>{long}<div class=foot>All rights</div><div class='legal'>Terms, of, use</div></div>") == whole
    lead = "<header><h1>T</h1><p class=lead>The lead</p><p>By X</p><p>A whole sentence that says what the article is about.</p></header>"
    assert text(f"<article>{lead}{long}</article>") == f"T\nThe lead\nA whole sentence that says what the article is about.\n{whole}"
    assert text(f"<header>{lead[8:-9]}</header><article>{long}</article>") == whole
    menu = "<a href=a>Home</a> <a href=b>More</a>"
    assert text(f"<table><tr><td>{menu}</td><td>{long}</td></tr></table>") == whole
    assert text(f"<table><tr><td>{menu}</td><td>The text, with commas, as it is.</td></tr></table>") == "The text, with commas, as it is."


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<!" * 500_000, "<a" * 500_000, '<a "x' * 250_000, "<a \"x'" * 200_000 + "'>'", "<script>" + "</script " * 110_000, "<p " + "class " * 160_000 + ">",
    "<span>" * 150_000, "<span><p>x, y</p>" * 60_000, "<span>" * 80_000 + "</b>" * 120_000, "<ul><li>" * 120_000, "<div class=ad><div>" * 50_000 + "<p>x, y</p>",
], ids=range(12))
def test_malformed_megabytes_end(page):
    import time

    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 15


def test_main_text_query(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op4_html_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for row in got:
        body = re.search(r"<article>(.*)</article>", pages[row.page_id], re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\x00", body))).split("\x00")
        want = "\n".join(p for p in (" ".join(html.unescape(x).split()) for x in parts) if p)
        assert (row.text, row.n_chars) == (want, len(want))


def test_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "<p>x", 1)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_text.extract_pages(pages).collect()) == ["", "", "x"]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_records_survive_a_whole_file_stream():
    import io
    import zlib

    made = [warc.record(i, f"http://x/{i}\r\nEvil: 1", b"\r\n\r\n" * i + os.urandom(1000 * i), 3 if i % 2 else None) for i in range(40)]
    packer = zlib.compressobj(1, zlib.DEFLATED, warc.GZIP)
    whole = packer.compress(b"".join(made)) + packer.flush()
    assert list(warc.split_records(warc._inflated(io.BytesIO(whole)))) == made
    members = b"".join(zlib.compress(m, 6, warc.GZIP) for m in made)
    assert list(warc.split_records(warc._inflated(io.BytesIO(members)))) == made
    with pytest.raises(ValueError):
        list(warc.split_records(warc._inflated(io.BytesIO(whole[:len(whole) // 2]))))


def test_archives_round_trip(spark, tmp_path):
    import glob
    import json
    import zlib

    rows = [(5, "http://a", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (None, None, "<p>é</p>"), (7, "u", None), (9, "u", ""), (4, "u", "x" * 3_000_000), (6, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.archive_pages(pages, folder=str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert got[page_id].payload_bytes == len(raw)
        assert got[page_id].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    kinds = {i: (r.record_type, r.refers_to) for i, r in got.items()}
    assert kinds == {3: ("response", None), 5: ("revisit", 3), None: ("revisit", 3), 7: ("response", None), 9: ("revisit", 7), 4: ("response", None), 6: ("response", None)}
    for index in glob.glob(f"{tmp_path}/members/*.idx"):
        raw = open(index.removesuffix(".idx"), "rb").read()
        for line in open(index):
            x = json.loads(line)
            assert warc.parse(zlib.decompress(raw[x["offset"]:x["offset"] + x["length"]], warc.GZIP))["page_id"] == x["page_id"]
    small = {r.page_id: r.record_type for r in warc.archive_pages(pages, least_bytes=1).collect()}
    assert small[7] == small[9] == "response" and small[5] == "revisit"
    assert warc.archive_pages(pages.limit(0)).count() == 0
