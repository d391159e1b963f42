"""Scores against a plain user x item loop on small fixtures with ties, nulls, dislikes and shared profiles."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.operators.filters import nonzero_gate, top_value_gate
from stylematch.plans import evaluate, score

ACCORDS = {"rose": [255, 0, 0], "oud": [80, 60, 50], "iris": [254, 1, 107], "musk": [230, 216, 234], "sea": [14, 82, 155]}
CLOTHES = {"white": [255, 255, 255], "navy": [0, 0, 128], "red": [255, 0, 0]}
FAMILY = {"rose": vocab.FAMILIES[0], "oud": vocab.FAMILIES[2], "iris": vocab.FAMILIES[0], "musk": vocab.FAMILIES[2], "sea": vocab.FAMILIES[4]}


def make(seed, n_items=60, n_users=40):
    rng = random.Random(seed)
    names = list(ACCORDS)
    items = []
    for i in range(n_items):
        # few accord triples and small votes, so that signatures and shares repeat
        triple = [rng.choice(names[:3]), rng.choice(names[2:]), rng.choice(["rose", "sea"])]
        if i % 11 == 0:
            triple[1] = None
        votes = [float(rng.randrange(3)) for _ in range(4)] if i % 13 else None
        items.append((i, triple, FAMILY[triple[0]] if i % 17 else None, votes))
    users = []
    for u in range(n_users):
        dress = rng.choice(list(CLOTHES)) if rng.random() < 0.4 else None
        top, bottom = (None, None) if dress else (rng.choice(list(CLOTHES)), rng.choice(list(CLOTHES)))
        users.append((u, rng.choice(vocab.STYLES), rng.choice(["봄", "summer", "가을", "winter"]), dress, top, bottom,
                      rng.choice([None, "", "rose", " iris , sea ", "rose,iris,oud,musk,sea"])))
    return items, users


@pytest.fixture(scope="module")
def world(spark):
    items, users = make(11)
    frames = {
        "items": spark.createDataFrame([(i, *t) for i, t, _, _ in items], "item_id long, accord1 string, accord2 string, accord3 string"),
        "families": spark.createDataFrame([(i, f) for i, _, f, _ in items], "item_id long, family string"),
        "seasons": spark.createDataFrame([(i, *v) for i, _, _, v in items if v], "item_id long, spring double, summer double, fall double, winter double"),
        "users": spark.createDataFrame(users, "user_id long, user_style string, season string, dress_color string, top_color string, bottom_color string, disliked_accord string"),
        "accords": spark.createDataFrame(list(ACCORDS.items()), "accord string, rgb array<int>"),
        "clothes": spark.createDataFrame(list(CLOTHES.items()), "color string, rgb array<int>"),
    }
    return items, users, frames


def outfit(user):
    _, _, _, dress, top, bottom, _ = user
    if dress:
        return [float(x) for x in CLOTHES[dress]]
    return [a * 0.7 + b * 0.3 for a, b in zip(CLOTHES[top], CLOTHES[bottom])]


def raw_scores(items, user, table, colour, season, dislikes=True):
    """[(item, style, colour, season share)] of the candidates of one user."""
    _, style, season_name, *_, disliked = user
    at = vocab.SEASONS.index(vocab.SEASON_COLUMN[season_name])
    hated = {x.strip() for x in (disliked or "").split(",")} if dislikes else set()
    out = []
    for item, triple, family, votes in items:
        if hated & {a for a in triple if a}:
            continue
        if None in triple and colour == "drop":
            continue
        if votes is None and season == "drop":
            continue
        rgbs = [ACCORDS.get(a, [255, 255, 255] if colour == "white" else None) for a in triple]
        c = None
        if None not in rgbs:
            mixed = [x * 0.6 + y * 0.3 + z * 0.1 for x, y, z in zip(*rgbs)]
            c = 100 * (1 - math.sqrt(sum((p - q) ** 2 for p, q in zip(outfit(user), mixed))) / (255 * math.sqrt(3)))
        e = None if votes is None else (100 * (votes[at] / sum(votes)) if sum(votes) else 0.0)
        s = table[style][vocab.FAMILIES.index(family)] if family else 0.0
        out.append((item, s, c, e))
    return out


def scaled(rows):
    def column(i):
        values = [r[i] or 0.0 for r in rows]
        low, high = min(values), max(values)
        return [((v - low) / (high - low) if high > low else 0.0) for v in values]

    cols = [[(v + 0.02) / 1.02 for v in column(i)] for i in (1, 2, 3)]
    return [(r[0], s, c, e) for r, s, c, e in zip(rows, *cols)]


def best(rows, total, k):
    scored = [(r[0], total(r)) for r in rows]
    return sorted(scored, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:k]


def features(frames, colour="drop", season="drop"):
    return score.item_features(frames["items"], frames["accords"], frames["families"], frames["seasons"], colour, season)


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], r["myscore"]))
    return {u: [x[1:] for x in sorted(v)] for u, v in out.items()}


def check(got, want):
    want = {u: v for u, v in want.items() if v}
    assert set(got) == set(want)
    for u in want:
        assert [i for i, _ in got[u]] == [i for i, _ in want[u]], u
        for (_, a), (_, b) in zip(got[u], want[u]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))


@pytest.mark.parametrize("k", [1, 3, 7])
def test_additive(spark, world, k):
    items, users, f = world
    got = score.additive_top(f["users"], features(f, "white", "null"), f["clothes"], vocab.style_scores(spark), k)

    def total(r):
        return None if r[3] is None else r[1] + r[2] + r[3]

    check(result(got), {u[0]: best(raw_scores(items, u, vocab.STYLE_PERCENT, "white", "null"), total, k) for u in users})


@pytest.mark.parametrize("make_gate, allowed", [
    (top_value_gate, lambda v: [x >= sorted(set(v))[-2] for x in v]), (nonzero_gate, lambda v: [x > 0 for x in v]),
])
def test_gated(spark, world, make_gate, allowed):
    items, users, f = world
    styles = vocab.style_scores(spark)
    got = score.gated_top(f["users"], features(f), f["clothes"], styles, make_gate(styles), 3)
    want = {}
    for u in users:
        ok = {fam for fam, a in zip(vocab.FAMILIES, allowed(vocab.STYLE_PERCENT[u[1]])) if a}
        mine = [i for i in items if i[2] in ok]
        want[u[0]] = best(raw_scores(mine, u, vocab.STYLE_PERCENT, "drop", "drop"), lambda r: r[2] + r[3], 3)
    check(result(got), want)


@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), (0.5, 0.25, 0.25), (0.6, 0.4, 0.0), (0.0, 0.0, 0.0), (0.2, 0.3, -0.5)])
def test_scaled_with_weights(spark, world, weights):
    items, users, f = world
    got = score.scaled_top(f["users"], features(f), f["clothes"], vocab.style_scores(spark, "points"), weights, 4)

    def total(r):
        return weights[0] * r[1] + weights[1] * r[2] + weights[2] * r[3]

    want = {}
    for u in users:
        rows = raw_scores(items, u, vocab.STYLE_POINTS, "drop", "drop")
        want[u[0]] = best(scaled(rows), total, 4) if rows else []
    check(result(got), want)


def test_user_who_dislikes_everything_gets_nothing(spark, world):
    _, users, f = world
    got = score.scaled_top(f["users"], features(f), f["clothes"], vocab.style_scores(spark, "points"))
    nothing = {u[0] for u in users if u[6] == "rose,iris,oud,musk,sea"}
    assert nothing and not nothing & set(result(got))


def test_free_text_dislikes_make_no_profiles(spark, world):
    _, _, frames = world
    one = frames["users"].filter("user_id = 0").drop("user_id", "disliked_accord")
    typed = F.concat(F.lit("misspelt"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, ", rose").otherwise(""))
    users = spark.range(200).withColumnRenamed("id", "user_id").crossJoin(one).withColumn("disliked_accord", typed)
    profiled = score.user_profiles(users, frames["clothes"], features(frames))
    assert profiled.count() == 200 and score.distinct_profiles(profiled).count() == 2
    assert sorted(r["dislikes"] for r in score.distinct_profiles(profiled).collect()) == [[], ["rose"]]


def test_newest_weights(spark):
    history = spark.createDataFrame([(2, 0.2, 0.3, 0.5), (1, 1.0, 1.0, 1.0)], "weight_id long, style_weight double, color_weight double, season_weight double")
    assert score.newest_weights(history) == (0.2, 0.3, 0.5)
    with pytest.raises(ValueError):
        score.newest_weights(history.limit(0))


def batch(items, users):
    """Batch rule: nulls count 0 before scaling, no dislikes."""
    return {u[0]: scaled(raw_scores(items, u, vocab.STYLE_POINTS, "null", "null", dislikes=False)) for u in users}


def log_of(users, items, seed=4):
    rng = random.Random(seed)
    return [(u[0], rng.randrange(len(items)), rng.randrange(100)) for u in users[:-5] for _ in range(rng.randrange(1, 12))]


def test_batch_scores(spark, world):
    items, users, f = world
    raw = score.score_all_items(f["users"], features(f, "null", "null"), f["clothes"], vocab.style_scores(spark, "points"))
    got = {(r["user_id"], r["item_id"]): r["myscore"] for r in score.batch_scaled(raw).collect()}
    want = {(u, i): s + c + e for u, rows in batch(items, users).items() for i, s, c, e in rows}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_precision(spark, world):
    items, users, f = world
    log = log_of(users, items)
    top = score.scaled_top(
        f["users"], features(f, "null", "zero"), f["clothes"], vocab.style_scores(spark, "points"), k=5, use_dislikes=False, null_scores_zero=True
    )
    frame = spark.createDataFrame(log, "user_id long, item_id long, rate long")
    got = {(r["user_id"], r["k"]): r["precision"] for r in evaluate.precision_rows(top, frame, range(1, 6)).collect()}
    for u, rows in batch(items, users).items():
        ranked = [i for i, _ in best(rows, lambda r: r[1] + r[2] + r[3], 5)]
        rated = {i for x, i, _ in log if x == u}
        for k in range(1, 6):
            assert got[(u, k)] == pytest.approx(len(set(ranked[:k]) & rated) / k)
    rated_only = evaluate.precision_rows(top, frame, [3], rated_only=True)
    assert rated_only.count() == len({x for x, _, _ in log})


def grid_by_loop(scores, rated, k, users):
    out = []
    for i in range(6):
        for j in range(6):
            for l in range(6):
                if i + j + l == 0:
                    continue
                w = [x / float(i + j + l) for x in (i, j, l)]
                hits = sum(
                    len({x for x, _ in best(scores[u], lambda r: r[1] * w[0] + r[2] * w[1] + r[3] * w[2], k)} & rated.get(u, set()))
                    for u in users
                )
                out.append((w, hits / (k * len(users))))
    return out


@pytest.mark.parametrize("rated_only", [False, True])
def test_weight_search_all_users(spark, world, rated_only):
    items, users, f = world
    log = log_of(users, items)
    rated = {}
    for u, i, _ in log:
        rated.setdefault(u, set()).add(i)
    grid = evaluate.search_weights_all_users(
        f["users"], features(f, "null", "zero"), f["clothes"], vocab.style_scores(spark, "points"),
        spark.createDataFrame(log, "user_id long, item_id long, rate long"), rated_only=rated_only, null_scores_zero=True,
    )
    got = [r["mean_precision"] for r in grid.orderBy("seq").collect()]
    scores = batch(items, users)
    counted = [u for u in scores if not rated_only or u in rated]
    assert got == pytest.approx([p for _, p in grid_by_loop(scores, rated, 3, counted)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_weight_search_on_stored_scores_with_many_ties(spark, seed):
    rng = random.Random(seed)
    levels = [0.0, 0.25, 0.5, 0.75, 1.0]
    scores = {u: [(i, rng.choice(levels), rng.choice(levels), rng.choice(levels)) for i in range(80)] for u in range(6)}
    log = [(u, rng.randrange(80)) for u in range(5) for _ in range(25)]
    rated = {}
    for u, i in log:
        rated.setdefault(u, set()).add(i)
    stored = spark.createDataFrame(
        [(u, *r) for u, rows in scores.items() for r in rows],
        "user_id long, item_id long, style_score double, color_score double, season_score double",
    ).withColumns({c: F.col(c).cast("decimal(10,6)") for c in evaluate.SCORES})
    grid = evaluate.search_weights(stored, spark.createDataFrame(log, "user_id long, item_id long"), k=3, rated_only=True)
    got = [r["mean_precision"] for r in grid.orderBy("seq").collect()]
    assert got == pytest.approx([p for _, p in grid_by_loop(scores, rated, 3, sorted(rated))])


def test_weight_search_without_ratings_gives_zero(spark, world):
    _, users, f = world
    empty = spark.createDataFrame([], "user_id long, item_id long")
    stored = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.3)], "user_id long, item_id long, style_score double, color_score double, season_score double")
    grid = evaluate.search_weights(stored, empty, rated_only=True)
    assert grid.count() == 215 and grid.agg(F.max("mean_precision")).first()[0] == 0.0


def test_correlations_from_sums(spark, world):
    import numpy as np

    items, users, f = world
    rating = {i[0]: float((i[0] * 37) % 23) for i in items}
    rated = features(f).join(spark.createDataFrame(list(rating.items()), "item_id long, rating double"), "item_id")
    styles = vocab.style_scores(spark)
    rows = {u[0]: raw_scores(items, u, vocab.STYLE_PERCENT, "drop", "drop") for u in users}
    overall = [(s, c, e, s + c + e, rating[i]) for r in rows.values() for i, s, c, e in r]
    got = evaluate.rating_correlations(f["users"], rated, f["clothes"], styles).first()
    matrix = np.array(overall)
    for col, name in enumerate(("corr_style", "corr_color", "corr_season", "corr_myscore")):
        assert got[name] == pytest.approx(np.corrcoef(matrix[:, col], matrix[:, 4])[0, 1], abs=1e-9)
    assert got["n_pairs"] == len(overall)
    per_user = {r["user_id"]: r for r in evaluate.rating_correlations(f["users"], rated, f["clothes"], styles, per_user=True).collect()}
    for u, r in rows.items():
        if len(r) < 2:
            continue
        mine = np.array([(s + c + e, rating[i]) for i, s, c, e in r])
        if mine.std(axis=0).min() > 1e-9:
            assert per_user[u]["corr_myscore"] == pytest.approx(np.corrcoef(mine.T)[0, 1], abs=1e-8)


def test_correlations_with_a_large_offset(spark, world):
    _, _, f = world
    rated = features(f).withColumn("rating", ((F.col("item_id") * 37) % 23).cast("double"))
    args = f["users"], f["clothes"], vocab.style_scores(spark)
    near = evaluate.rating_correlations(args[0], rated, *args[1:]).first()
    far = evaluate.rating_correlations(args[0], rated.withColumn("rating", F.col("rating") + 1e9), *args[1:]).first()
    for name in ("corr_style", "corr_color", "corr_season", "corr_myscore"):
        assert far[name] == pytest.approx(near[name], abs=1e-6) and near[name] is not None


def test_season_constant_gives_null_correlation(spark, world):
    _, _, f = world
    one = spark.createDataFrame([(1, "봄"), (2, "봄")], "user_id long, season string")
    users = one.selectExpr("user_id", f"'{vocab.STYLES[0]}' AS user_style", "season", "'red' AS dress_color", "CAST(NULL AS STRING) AS top_color",
                           "CAST(NULL AS STRING) AS bottom_color", "CAST(NULL AS STRING) AS disliked_accord")
    flat = features(f).withColumn("spring", F.lit(25.0)).withColumn("rating", F.col("item_id").cast("double"))
    got = evaluate.rating_correlations(users, flat, f["clothes"], vocab.style_scores(spark)).first()
    assert got["corr_season"] is None and got["corr_color"] is not None


def test_many_dislike_sets_share_one_ranking(spark, world, monkeypatch):
    """10,000 sets of dislikes: the signatures are paired with the few bases, not with the sets, and results stay exact."""
    _, _, f = world
    rng = random.Random(21)
    names = [f"a{i}" for i in range(40)]
    colours = {n: [rng.randrange(256) for _ in range(3)] for n in names}
    items = [(i, rng.sample(names, 3), rng.choice(vocab.FAMILIES), [float(rng.randrange(1, 5)) for _ in range(4)]) for i in range(800)]
    sets = [",".join(s) for s in [*itertools.islice(itertools.combinations(names, 4), 9990)]] + [",".join(names[:n]) for n in (30, 35, 37, 38, 39, 40)] + ["", "none of them", "a1", None]
    users = [(u, vocab.STYLES[u % 2], "summer", "navy", None, None, s) for u, s in enumerate(sets)]
    made = item_tables(spark, items, colours)
    feats = score.item_features(made["items"], made["accords"], made["families"], made["seasons"])
    people = spark.createDataFrame(users, "user_id long, user_style string, season string, dress_color string, top_color string, bottom_color string, disliked_accord string")

    paired, plain = [], score.raw_pairs
    monkeypatch.setattr(score, "raw_pairs", lambda profiles, signatures, *a, **kw: paired.append((profiles.count(), signatures.filter("season = 'summer'").count())) or plain(profiles, signatures, *a, **kw))
    scores = vocab.style_scores(spark)
    got = result(score.additive_top(people, feats, f["clothes"], scores, 3))
    assert sum(p * s for p, s in paired) <= 2 * 2 * 800 * len(paired) and len(paired) <= 4
    assert sorted(got) == [u for u, *_, s in users if any(not set((s or "").split(",")) & set(t) for _, t, _, _ in items)]
    monkeypatch.setitem(globals(), "ACCORDS", colours)
    sample = [users[i] for i in [*rng.sample(range(9990), 60), *range(9990, 10000)]]
    check({u[0]: got[u[0]] for u in sample if u[0] in got}, {u[0]: best(raw_scores(items, u, vocab.STYLE_PERCENT, "drop", "drop"), lambda r: r[1] + r[2] + r[3], 3) for u in sample})

    paired.clear()
    points = vocab.style_scores(spark, "points")
    few = people.join(spark.createDataFrame([(u[0],) for u in sample], "user_id long"), "user_id")
    got = result(score.scaled_top(few, feats, f["clothes"], points, (0.2, 0.5, 0.3), 3))
    want = {}
    for u in sample:
        rows = raw_scores(items, u, vocab.STYLE_POINTS, "drop", "drop")
        want[u[0]] = best(scaled(rows), lambda r: 0.2 * r[1] + 0.5 * r[2] + 0.3 * r[3], 3) if rows else []
    check(got, want)


def item_tables(spark, items, colours):
    return {
        "items": spark.createDataFrame([(i, *t) for i, t, _, _ in items], "item_id long, accord1 string, accord2 string, accord3 string"),
        "families": spark.createDataFrame([(i, f) for i, _, f, _ in items], "item_id long, family string"),
        "seasons": spark.createDataFrame([(i, *v) for i, _, _, v in items], "item_id long, spring double, summer double, fall double, winter double"),
        "accords": spark.createDataFrame(list(colours.items()), "accord string, rgb array<int>"),
    }


def test_scores_by_parts_count_all_pairs(spark, world):
    items, users, f = world
    table, styles = features(f, "null", "null"), vocab.style_scores(spark, "points")
    # ids of one profile twice, and ids of two profiles, which are scaled over both
    people = f["users"].unionByName(f["users"].filter("user_id < 4")).unionByName(f["users"].filter("user_id < 8").withColumn("user_id", F.col("user_id") + 20))
    profiled = score.user_profiles(people, f["clothes"]).withColumn("n_users", F.col("user_id") % 3 + 1)
    whole = score.batch_scaled(score.score_all_items(people, table, f["clothes"], styles)).withColumn("n_users", F.col("user_id") % 3 + 1)
    parts = score.score_parts(profiled, table, f["clothes"], styles, "n_users")
    for name, rows in parts.items():
        want = {(r["column"], r["epsilon"], r["bin"]): r["n"] for r in evaluate.epsilon_histograms(whole, [name], times="n_users").collect()}
        got = {(r["column"], r["epsilon"], r["bin"]): r["n"] for r in evaluate.epsilon_histograms(rows, [name], times="n").collect()}
        assert got == want
        assert rows.count() < whole.count()
