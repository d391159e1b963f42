"""Near duplicates, lines, benchmark leaks, conversations, mixing and the pipeline, next to brute force."""

import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from stylematch.llm import chat, decontaminate, graph, line_dedup, mixing, near_dedup, prefix  # noqa: E402
from stylematch.llm.queries import QUERIES  # noqa: E402
from stylematch.llm.rarity import sieved  # noqa: E402

from helpers import WORD, deduped_lines, maximal, near_groups  # noqa: E402

DOCS = "doc_id long, text string, source string, cls string, token long"


def corpus(seed, n=60):
    """Documents with copies, near copies in chains, shared lines, and odd rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocab) for _ in range(12))
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            words = rng.choice(docs)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            docs.append((i, " ".join(words)))
        else:
            lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
            docs.append((i, "\n".join(lines + [shared] * rng.randrange(2))))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (None, docs[0][1]), (None, None), docs[3], docs[3], (n + 5, "tab\tone\x0btwo\rthree"), (n + 6, "a b c d e f g h")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "s", "clash", 1) for d, t in docs], DOCS)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_match_all_pairs(spark, seed):
    docs = corpus(seed)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, docs)).collect()), key=str)
    assert got == sorted(near_groups(docs), key=str)
    assert any(d != c for d, n, c in got if d is not None)


def test_near_groups_with_a_large_family(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
        docs.append((i, " ".join(words)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, docs)).collect())
    assert got == sorted(near_groups(docs))


def test_near_query_matches_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op3_minhash_near_dedup"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near_groups([tuple(d) for d in docs]))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(4)
    names = rng.sample(range(1000), 200)
    edges = [(a, b) for a, b in zip(names[:150], names[1:150])] + [(a, b) for a, b in zip(names[150:], names[151:])] + [(5000, 5000), (None, 1)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: min(names[:150]) for n in names[:150]}, **{n: min(names[150:]) for n in names[150:]}}


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_match_all_pairs(spark, seed):
    docs = corpus(seed)
    rows = line_dedup.drop_similar_lines(frame(spark, docs), count="gone").collect()
    assert len(rows) == len(docs)
    want = deduped_lines(docs)
    by_id = defaultdict(set)
    for (d, _), text in want.items():
        by_id[d].add(text)
    for r in rows:
        assert r.text in by_id[r.doc_id], r.doc_id
        assert r.cls == "clash"
    assert sum(r.gone for r in rows) > 10


def test_line_query_matches_all_pairs(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in QUERIES["op6_line_dedup"](spark, sf).collect()}
    assert got == {d: text for (d, _), text in deduped_lines(docs).items()}


def test_lines_of_nothing_and_no_python(spark, capsys):
    out = line_dedup.drop_similar_lines(frame(spark, []))
    assert out.count() == 0
    line_dedup.drop_similar_lines(frame(spark, corpus(3, 8))).explain()
    chat.collapse_and_render(conversations(spark, [])).explain()
    plans = capsys.readouterr().out
    assert "Python" not in plans and "Arrow" not in plans and "Pandas" not in plans


@pytest.mark.parametrize("name", ["_id", "_kept", "_gone", "_of", "_doc", "_text", "in0", "a.b"])
def test_lines_beside_any_column_name(spark, name):
    docs = spark.createDataFrame([("x", 1, "a b c d\na b c d\ne"), ("y", 2, "a b c d\nf"), (None, None, None)], f"`{name}` string, doc_id long, text string")
    got = line_dedup.drop_similar_lines(docs, count="gone")
    assert got.columns == [*docs.columns, "gone"]
    assert {tuple(r) for r in got.collect()} == {("x", 1, "a b c d\ne", 1), ("y", 2, "f", 1), (None, None, None, 0)}


def test_a_family_of_lines_meets_once_for_each_run_of_tokens(spark):
    rng = random.Random(6)
    prefixes = [list(range(100, 112)) for _ in range(30)]
    for p in prefixes[10:]:
        for _ in range(rng.randrange(1, 4)):
            p[rng.randrange(12)] = rng.randrange(10 ** 6)
    sets = spark.createDataFrame([(i, 46, 0, 0, p) for i, p in enumerate(prefixes)], "set long, n int, p0 long, p1 long, prefix array<int>")
    met = Counter((r.a, r.b) for r in line_dedup._meetings(sets, spark.createDataFrame([(29,)], "set long")).collect())
    near = {(a, b) for a in range(30) for b in range(a + 1, 29) if any(x == y and 46 - max(i, j) >= 40 for i, x in enumerate(prefixes[a]) for j, y in enumerate(prefixes[b]))}
    assert set(met) == near
    assert {met[a, b] for a in range(10) for b in range(a + 1, 10)} == {1}
    assert sum(met.values()) < 4 * len(met)


def test_lines_are_searched_once(spark, monkeypatch):
    """Whatever stars fail: sets that no verified star holds are searched together with the others."""
    staged = []
    monkeypatch.setattr(line_dedup, "stage", lambda df, label, real=line_dedup.stage: staged.append(label) or real(df, label))
    docs = [(i, " ".join(["shared"] + [f"w{i % 7}x{j}" for j in range(12)] + [f"v{i}y{j}" for j in range(i % 5)])) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.drop_similar_lines(spark.createDataFrame(docs, "doc_id long, text string"), count="gone").collect()}
    assert got == {d: text for (d, _), text in deduped_lines(docs).items()}
    assert staged.count("pairs") == 1 and staged.index("similar") < staged.index("pairs")


def test_sieve_keeps_every_key(spark):
    keys = spark.createDataFrame([(i * 7919,) for i in range(500)] + [(None,)], "x long")
    others = spark.createDataFrame([(-i - 1,) for i in range(5000)], "x long")
    assert keys.filter(sieved(keys, "x")).count() == 501
    assert others.filter(sieved(keys, "x")).count() < 20


def test_common_length_matches_the_table():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_length(a, b) == table[-1][-1]


def test_row_sums_match_a_loop():
    rng = np.random.default_rng(3)
    values, row = rng.standard_normal((40, 6)), np.sort(rng.integers(0, 30, 200))
    number = rng.integers(0, 40, 200)
    wanted = np.zeros((31, 6))
    np.add.at(wanted, row, values[number])
    assert np.allclose(decontaminate.row_sums(values, number, row, 31), wanted)
    assert not decontaminate.row_sums(values, number[:0], row[:0], 31).any()


def test_leaks_are_found_and_clean_documents_left(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_decontamination"](spark, sf).collect()}
    assert got == {(d, i) for d, t in docs for i, x in bench if x in t} and got


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(3000)]
    noise = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, noise(30) + ". " + noise(6)) for i in range(8)] + [(8, None), (9, "")]
    words = items[2][1].split()
    changed = [w if i % 5 else "other" for i, w in enumerate(words)]
    docs = [(0, noise(300)), (1, noise(100) + " " + items[1][1].upper() + " " + noise(90)), (2, noise(40) + " " + " ".join(changed) + " " + noise(40)), (3, None), (4, ""), (None, items[4][1]), (5, noise(5000) + " " + items[5][1])]
    table = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4000, 3):
        got = decontaminate.contaminated(table, bench, items=block)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2), (None, 4), (5, 5)}
    kept = decontaminate.drop_contaminated(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0


@pytest.mark.parametrize("least, most", [(8, 14), (15, 59)])
def test_leaks_of_thousands_of_items(spark, least, most):
    rng = random.Random(least + most)
    vocab = [f"v{i}" for i in range(4000)]
    noise = lambda n: rng.choices(vocab, k=n)
    items = [noise(rng.randrange(least, most + 1)) for _ in range(3000)]
    docs, want = [], set()
    for d in range(150):
        words = noise(rng.randrange(20, 120))
        for item in rng.sample(range(len(items)), 2):
            plant = list(items[item])
            for i in rng.sample(range(len(plant)), len(plant) // 5 if d % 2 else 0):
                plant[i] = f"edit{d}"
            words += plant + noise(rng.randrange(20, 120))
            want.add((d, item))
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert want <= found
    asked = sorted({i for _, i in want})[:60]
    near = set()
    for d, text in docs:
        words = text.split()
        for i in asked:
            reach = max(32, len(items[i]) // 2)
            for place in range(0, max(1, len(words) - 32), 32):
                passage = words[max(0, place - reach):place + 64 + reach]
                if decontaminate.common_length(items[i], passage) / len(items[i]) >= 0.6:
                    near.add((d, i))
    missed = near - found
    assert len(missed) <= 0.1 * len(near) and not missed & want, (len(near), len(missed))


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")


def test_snapshots_collapse(spark):
    rng = random.Random(8)
    rows = []
    for c in range(60):
        length = rng.randrange(1, 6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes"]) if t < 3 else f"t{rng.randrange(3)}") for t in range(length)]
    rows += [(100, t, "user", f"long {t}") for t in range(700)] + [(101, t, "user", f"long {t}") for t in range(600)] + [(102, 0, None, None), (102, 0, None, None)]
    rows += [(103, t + 5, "user", f"long {t}") for t in range(10)]
    got = {r.conv: (r.n_turns, r.copies) for r in chat.maximal_conversations(conversations(spark, rows)).collect()}
    assert got == maximal(rows)
    rendered = chat.collapse_and_render(conversations(spark, rows)).filter("conv_id = 100").orderBy("part").collect()
    assert len(rendered) == 3
    assert "".join(r.text for r in rendered) == "".join(f"<|user|>\nlong {t}\n<|end|>\n" for t in range(700))


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, 0, "user", "b")]
    got = {r.conv_id: r.text for r in chat.collapse_and_render(conversations(spark, rows)).collect() if r.part == 0 or r.conv_id is None and "a\n" in r.text}
    assert got[1] == "<|user|>\nb\n<|end|>\n" and got[None] == "<|user|>\na\n<|end|>\n"
    assert chat.collapse_and_render(conversations(spark, [])).count() == 0


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i long, v long")
    got = prefix.running_totals(df, "k", ["i"], "v", "before").collect()
    for k in range(3):
        own = sorted((r.before, r.before + r.v) for r in got if r.k == k)
        assert own[0][0] == 0 and own[-1][1] == sum(v for a, _, v in rows if a == k)
        assert all(a[1] <= b[1] and b[0] <= a[1] for a, b in zip(own, own[1:]))


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        at = np.arange(n)
        out = mixing.permuted(at, np.full(n, n), np.full(n, 12345))
        assert sorted(out) == list(range(n))


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 300, 300], [3, 2, 1]) == pytest.approx([30, 580 * 2 / 3, 580 / 3])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_mix_query(spark, sf):
    got = QUERIES["op10_source_mixing"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs)
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(docs[r.doc_id].text)) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = (r.source_size, r.target)
    for s in size:
        assert target[s][0] == size[s]
        assert abs(taken[s] - target[s][1]) <= max(0.1 * target[s][1], 3 * mixing.BLOCK)
    again = QUERIES["op10_source_mixing"](spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_content_and_odd_rows(spark):
    rows = [(1, "a b c " * 50, "x"), (2, None, "x"), (None, "d " * 100, None), (3, "", "y"), (4, "e " * 300, "z"), (4, "f " * 30, "z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    held, content = mixing.mix_sources(docs, block=10, slots=7)
    out = mixing.taken_words(held, content).collect()
    assert len(out) == len(rows)
    times = defaultdict(Counter)
    sizes = {r.row: r["size"] for r in out}
    for p in content.collect():
        times[p.row].update(range(p.first_word, p.first_word + p.words))
    for row, seen in times.items():
        assert max(seen) < sizes[row] and max(seen.values()) <= 3
    assert {r.row: r.taken for r in out if r.taken} == {row: sum(seen.values()) for row, seen in times.items()}
    empty = mixing.taken_words(*mixing.mix_sources(docs.limit(0)))
    assert empty.count() == 0
    wordless = mixing.taken_words(*mixing.mix_sources(docs.filter("doc_id IN (2, 3)"))).collect()
    assert [(r["size"], r.target, r.taken) for r in wordless] == [(0, 0.0, 0)] * 2


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    from stylematch.session import stage

    before = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, apply) in enumerate(corpus_pipeline.STAGES):
        docs = stage(apply(spark, docs, sf), f"test-{i}")
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows} if i < 4 else {r.doc_id: r.taken for r in rows}
        assert len(after) == len(rows)
        assert i == 4 or docs.columns == columns
        if i == 0:
            gone = [labels[d] for d in before if d not in after and d in labels]
            stay = [labels[d] for d in after if d in labels]
            assert np.mean(gone) < 0.1 and np.mean(stay) > 0.9
        if i == 1:
            want = deduped_lines(list(before.items()))
            assert after == {d: t for (d, _), t in want.items() if t.split() or not before[d].split()}
            assert all(r.n_chars == len(r.text) for r in rows)
        if i == 2:
            lead = {d: c for d, _, c in near_groups(list(before.items()))}
            assert after == {d: t for d, t in before.items() if lead[d] == d}
        if i == 3:
            assert after == {d: t for d, t in before.items() if not any(b in t for b in bench)}
        if i == 4:
            assert set(after) == set(before) and sum(after.values()) > 0
        before = after


def test_pipeline_of_nothing(spark, sf, tmp_path):
    import corpus_pipeline

    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_stage_with_repeated_rows(spark, sf):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x"), (None, "x")], "doc_id long, text string").withColumn("kept", F.lit(1))
    out = corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == [(1, "a b c d e f"), (None, "x"), (None, "x")]
