"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stylematch.llm import collocations as C
from stylematch.llm.queries import QUERIES


def plain(rows, least=10, share=50, most=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    kept = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in kept.items():
        for i in range(len(w) - 1 if len(w) == 3 else 0):
            part = (lang, *w[i:i + 2])
            longer[part] = max(longer[part], a)
    out = {}
    for (lang, *w), a in kept.items():
        if 100 * longer[lang, *w] >= share * a:
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k, counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -score) for lang, ps in out.items() for i, (score, a, p, left, right) in enumerate(sorted(ps)[:most], 1))


def told(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, 1, 2) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string, n int, one0 int").repartition(3)


def some_texts(rng, langs, n, vocabulary):
    def text():
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", ";", "\x0b"]) for _ in range(rng.randrange(40)))
    return [(rng.choice(langs), text()) for _ in range(n)]


def test_against_plain_counts(spark):
    rng = random.Random(13)
    vocabulary = ["a", "A", "the", "The", "of", "é", "É", "-x-", "…", "word" * 30, "日本"] + [f"w{i}" for i in range(12)]
    rows = some_texts(rng, ["en", "de", None, "und", ""], 3000, vocabulary)
    rows += [("en", None), (None, ""), ("en", " ,.\n"), ("fr", "a a a a a a a a a a a a a a"), ("it", "one two " * 20000)]
    want = plain(rows)
    assert len(want) > 100
    assert told(C.collocations(table(spark, rows))) == want


def test_crowded_filters_and_small_shards_change_nothing(spark, monkeypatch):
    """A filter of 64 cells lets nearly everything through; tries of 50 phrases take many passes."""
    monkeypatch.setattr(C, "SHARD", 50)
    rng = random.Random(4)
    rows = some_texts(rng, ["en", "de"], 150, [f"w{i}" for i in range(14)])
    assert told(C.collocations(table(spark, rows), filter_bits=6)) == plain(rows)


def test_best_per_language(spark):
    rng = random.Random(6)
    rows = some_texts(rng, ["en", "de"], 300, [f"w{i}" for i in range(9)])
    assert told(C.collocations(table(spark, rows), least=5, share=80, most=7)) == plain(rows, 5, 80, 7)


def test_nothing(spark):
    for rows in ([], [("en", None), (None, ""), ("en", "lone words only")]):
        assert C.collocations(table(spark, rows) if rows else table(spark, [("x", "")]).limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    parts = spark.createDataFrame([("en", "a", 1, 4 * 10**12), ("en", "b", 1, 3 * 10**12)], "lang string, phrase string, size int, f long")
    phrases = spark.createDataFrame([("en", "a b", 2, 2 * 10**12 + 1)], "lang string, phrase string, size int, f long")
    monkeypatch.setattr(C, "phrase_counts", lambda *_: (parts, phrases))
    a = 2 * 10**12 + 1
    assert told(C.collocations(None)) == [("en", 1, "a b", a, 4 * 10**12, 3 * 10**12, 7 * 10**12, 10**6 * a * a // (12 * 10**24))]


@pytest.mark.parametrize("wide", [3, 400])
def test_trie_holds_its_phrases_only(wide):
    """Nodes with few and with very many children; words that share their first hash."""
    rng = np.random.default_rng(wide)
    words = rng.integers(1 << 62, size=(wide * 2, 2)).astype(np.uint64)
    words[1::7, 0] = words[0, 0]
    picks = {tuple(p) for p in rng.integers(len(words), size=(wide * 20, 3))} | {(0, i, 0) for i in range(len(words))}
    phrases = sorted(picks | {p[:2] + (-1,) for p in picks if rng.random() < 0.5})
    phrases = [p for p in phrases if p[2] >= 0] + [p for p in phrases if p[2] < 0]
    sizes = np.array([3 if p[2] >= 0 else 2 for p in phrases])
    trie = C.build_trie(np.array([[words[w] if w >= 0 else (0, 0) for w in p] for p in phrases], dtype=np.uint64), sizes)
    number = {p[:s]: i for i, (p, s) in enumerate(zip(phrases, sizes))}
    starts = {p[:k] for p in number for k in range(1, len(p) + 1)}
    symbols = trie.symbols(words[:, 0], words[:, 1])
    assert (trie.symbols(words[:, 0], words[:, 1] + np.uint64(1)) == -1).all()
    asked = rng.integers(len(words), size=(20000, 3))
    nodes = np.zeros(len(asked), np.int64)
    for level in range(3):
        alive = nodes >= 0
        nodes[alive] = trie.step(nodes[alive], symbols[asked[alive, level]])
        for row, node in zip(asked[:, :level + 1], nodes):
            key = tuple(int(x) for x in row)
            assert (node >= 0) == (key in starts)
            assert node < 0 or trie.phrase[node] == number.get(key, -1)


def test_query(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_phrase_collocations"](spark, sf)
    assert told(got) == plain(rows)
    assert got.filter(F.col("rank") > 2000).isEmpty()


def test_texts_are_read_twice_however_many_tries(spark, monkeypatch):
    """Words are counted, then numbered; all other passes, also those of many tries, go over the numbers."""
    monkeypatch.setattr(C, "SHARD", 50)
    rng = random.Random(5)
    rows = some_texts(rng, ["en", "de"], 150, [f"w{i}" for i in range(14)])
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    read = F.udf(counted, "string").asNondeterministic()
    docs = table(spark, rows)
    assert told(C.collocations(docs.withColumn("text", read("text")))) == plain(rows)
    assert seen.value == 2 * len(rows)


def test_numbers_of_words():
    """Words that share their first hash, or all its first bits, and words that have no number."""
    rng = np.random.default_rng(2)
    one, two = rng.integers(1 << 63, size=(2, 3000)).astype(np.uint64)
    one[::5] = one[0]
    one[1::5] = (one[1] & ~np.uint64(0xFFFF)) + np.arange(600, dtype=np.uint64)
    one[2], one[3] = 0, 2**64 - 1
    numbers = C.Numbers(one, two)
    assert (numbers.of(one, two) == np.arange(3000)).all()
    assert (numbers.of(one, two + np.uint64(1)) == -1).all()
    assert (C.Numbers(one[:0], two[:0]).of(one, two) == -1).all()
    assert (C.Numbers(one[:1], two[:1]).of(one, two) == np.append(0, np.full(2999, -1))).all()


def test_runs_hold_what_follows(monkeypatch):
    """Frequent words that follow each other, whole runs in rows of about RUN numbers."""
    monkeypatch.setattr(C, "RUN", 4)
    texts = ["a b x c d e, a", "", None, "A\tb c. d", "c", "x a b", "a b c d e a b c d e"]
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    found = next(C._read(iter([batch])))[1]
    words = [found.data[i:j].tobytes().decode().lower() for i, j in zip(found.starts, found.ends)]
    at = [words.index(w) for w in "abcde"]

    class Held:
        value = C.Numbers(found.one[at], found.two[at])

    rows = list(C._numbered(iter([batch]), Held))
    assert rows[0].num_rows > 2
    runs = np.concatenate(list(C._runs(iter(rows))))
    assert "".join("abcde "[n] for n in runs).split() == ["ab", "cde", "abc", "ab", "abcdeabcde"]
