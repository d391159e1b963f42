import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stylematch.operators import encode
from stylematch.plans import clusters, features, stored_models, styles, synthetic


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    data = []
    for c in range(4):
        centre = rng.normal(size=6) * 4
        data += [(len(data) + i, [float(x) for x in centre + rng.normal(size=6)], "abcd"[c] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(data, "id int, v array<double>, cat string")
    return clusters.vector_rows(df, "id", "v", "cat")


def test_cost_never_rises_and_matches_assignment(rows):
    model = clusters.fit(rows, [4])[4]
    assert all(b <= a + 1e-9 for a, b in zip(model.costs, model.costs[1:]))
    total = clusters.assign(rows, model).agg(F.sum("distance")).first()[0]
    assert total <= model.costs[-1] + 1e-6


def test_assignment_is_the_nearest_prototype(rows):
    model = clusters.fit(rows, [3])[3]
    got = {r["row_id"]: r["cluster"] for r in clusters.assign(rows, model).collect()}
    for r in rows.collect():
        distance = [
            sum((a - b) ** 2 for a, b in zip(r["vector"], model.centres[j])) + model.gamma * (r["category"] != model.categories[j])
            for j in range(3)
        ]
        assert distance[got[r["row_id"]]] == pytest.approx(min(distance))


def test_sweep_equals_single_fits_and_library_silhouette(rows):
    swept = {k: (cost, sil) for k, cost, sil in clusters.sweep(rows, [3, 4, 5])}
    for k in (3, 4, 5):
        model = clusters.fit(rows, [k])[k]
        labels = clusters.assign(rows, model)
        assert swept[k][0] == pytest.approx(labels.agg(F.sum("distance")).first()[0])
        scored = labels.join(rows.select("row_id", array_to_vector("vector").alias("features")), "row_id")
        library = ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(scored)
        assert swept[k][1] == pytest.approx(library, abs=1e-6)


def test_unfinished_clustering_is_an_error(rows):
    with pytest.raises(RuntimeError, match="still move"):
        clusters.fit(rows, [4], rounds=1)


def test_only_the_cost_ends_the_rounds(rows, monkeypatch):
    def moved(model, sums):
        cost = 1 / min(len(model.costs) + 1, 400)
        return dataclasses.replace(model, centres=model.centres + 1, cost=cost, costs=[*model.costs, cost])

    monkeypatch.setattr(clusters, "_sums", lambda rows, models: pd.DataFrame({"model": range(len(models))}))
    monkeypatch.setattr(clusters, "_updated", moved)
    assert len(clusters.fit(rows, [4])[4].costs) == 401


def test_vectors_without_distances_are_an_error(spark):
    odd = spark.range(9).selectExpr("id", "array(double(id), IF(id = 4, double('NaN'), 1D)) AS v", "'a' AS cat")
    with pytest.raises(ValueError):
        clusters.fit(clusters.vector_rows(odd, "id", "v", "cat"), [2])


def test_one_file_of_vectors_is_dealt_over_the_tasks(rows, monkeypatch):
    real, dealt = clusters.stage, []

    def watched(df, label):
        dealt.append(df.rdd.getNumPartitions())
        return real(df, label)

    monkeypatch.setattr(clusters, "stage", watched)
    model = clusters.fit(rows.coalesce(1), [4])[4]
    assert dealt == [4] and model.sizes.sum() == 160


def _told(sums):
    """Costs come by cluster or at the first one; only packed rows have a room."""
    sums = sums[sums["place"] != clusters._ROOM]
    sums = sums.assign(cluster=sums["cluster"].where(sums["place"] != clusters._COST, 0), category=sums["category"].fillna(""))
    return sums.groupby(["model", "cluster", "place", "category"])["value"].sum().sort_index()


@pytest.mark.parametrize("counted", [64, 2])
def test_packed_rows_have_the_same_sums(spark, monkeypatch, counted):
    """Also with more categories than are counted as attributes, equal distances and clusters without rows."""
    monkeypatch.setattr(clusters, "_COUNTED", counted)
    monkeypatch.setattr(clusters, "_CELLS", 100)
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.integers(-2, 3, size=3)], "abcde"[i % 5] if i % 7 else None) for i in range(300)]
    rows = clusters.vector_rows(spark.createDataFrame(data, "id int, v array<double>, cat string").repartition(3), "id", "v", "cat")
    far = np.array([[0.0, 0, 0], [1, 0, 0], [1, 0, 0], [99, 0, 0]])
    models = [clusters.Prototypes(4, far, ["a", "b", "b", "None"], 0.7), clusters.Prototypes(2, far[:2], ["z", "e"], 0.0)]
    want, got = clusters._sums(rows, models), clusters._sums(clusters._packed(rows), models)
    assert len(got) == len(got.drop_duplicates(["model", "cluster", "place"]))
    assert _told(want).drop(index=_none_left(want), errors="ignore").to_dict() == pytest.approx(_told(got).to_dict())


def _none_left(sums):
    """Sums of attributes that come out as 0 are not listed for packed rows."""
    return [k for k, v in _told(sums).items() if k[2] >= 0 and v == 0]


def test_a_round_over_vectors_is_one_job_at_most(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=4)], "ab"[i % 2]) for i in range(600)]
    rows = clusters.vector_rows(spark.createDataFrame(data, "id int, v array<double>, cat string"), "id", "v", "cat")
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        model = clusters.fit(rows, [8], starts=1)[8]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.costs) > 20
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < len(model.costs) + 20


@pytest.mark.parametrize("counted", [64, 2])
def test_rounds_over_the_rows_with_little_room_are_those_over_all(spark, monkeypatch, counted):
    """Every cost is the same, also where only some rows are dealt to the models' tasks, or none."""
    monkeypatch.setattr(clusters, "_COUNTED", counted)
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.normal(size=3)] if i % 9 else [0.5, 0.5, 0.5], "abcd"[i * i % 4]) for i in range(3000)]
    rows = clusters.vector_rows(spark.createDataFrame(data, "id int, v array<double>, cat string").repartition(3), "id", "v", "cat")
    found, passes, real = {}, {}, clusters._sums
    for size in (0, 40 * 1000, 1 << 25):
        seen = []
        monkeypatch.setattr(clusters, "_sums", lambda *a: seen.append(a) or real(*a))
        monkeypatch.setattr(clusters, "_LOCAL_BYTES", size)
        found[size], passes[size] = clusters.fit(rows, [5, 9], starts=2), len(seen)
    assert max(len(m.costs) for m in found[0].values()) > 30
    assert passes[0] > 30 and passes[0] > passes[40 * 1000] + 10 and passes[1 << 25] == 1
    for size in (40 * 1000, 1 << 25):
        for k in (5, 9):
            one, two = found[0][k], found[size][k]
            assert one.costs == pytest.approx(two.costs, rel=1e-12) and one.categories == two.categories
            assert np.allclose(one.centres, two.centres, atol=1e-12) and (one.sizes == two.sizes).all()


def test_room_is_how_far_the_centres_may_move():
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"vector": list(rng.normal(size=(400, 3))), "category": ["ab"[i % 2] for i in range(400)]})
    x = clusters.Vectors.of(frame)
    model = clusters.Prototypes(4, rng.normal(size=(4, 3)), ["a", "b", "b", "a"], 0.8)
    block = x.codes, list(x.names), 3, np.concatenate([x.dense, np.ones((400, 1)), x.squares[:, None]], axis=1)
    label = model.distances(x).argmin(axis=1)
    for room in (0.0, 0.05, 0.2, 1.0):
        out = clusters._block_sums(block, [model], np.array([room]))[1][0]
        for _ in range(200):
            step = rng.normal(size=(4, 3))
            moved = dataclasses.replace(model, centres=model.centres + room * step / np.sqrt((step**2).sum(axis=1))[:, None])
            assert ((moved.distances(x).argmin(axis=1) == label) | out).all()
        assert room in (0.0, 1.0) or 0 < out.sum() < 400


def test_too_few_rows_for_the_clusters(rows):
    with pytest.raises(ValueError):
        clusters.fit(rows.limit(3), [5])


def test_tf_idf_against_formula(spark):
    docs = spark.createDataFrame([(1, "Rose,Pink Pepper,Rose"), (2, "Rose,Musk"), (3, None), (4, "rare")], "id int, notes string")
    got = {(r["id"], r["term"]): r["weight"] for r in features.tf_idf(docs, "id", "notes", min_count=1).collect()}
    df = {"rose": 2, "pink": 1, "pepper": 1, "musk": 1, "rare": 1}
    idf = {t: np.log((1 + 4) / (1 + n)) + 1 for t, n in df.items()}
    one = {"rose": 2 * idf["rose"], "pink": idf["pink"], "pepper": idf["pepper"]}
    norm = np.sqrt(sum(v * v for v in one.values()))
    for term, v in one.items():
        assert got[(1, term)] == pytest.approx(v / norm)
    assert got[(4, "rare")] == pytest.approx(1.0) and not [k for k in got if k[0] == 3]
    kept = features.tf_idf(docs, "id", "notes", min_count=3)
    assert {r["term"] for r in kept.collect()} == {"rose"}


def test_tf_idf_counts_by_number_with_small_and_large_vocabularies(spark, monkeypatch):
    texts = [(1, "Sea,salt\nsea,sea salt,"), (2, "salt\nsea,Sea,x"), (2, "Sea"), (3, None), (None, "sea salt,Sea")]
    docs = spark.createDataFrame(texts, "id long, text string")

    def weights():
        return {(r["id"], r["term"]): round(r["weight"], 9) for r in features.tf_idf(docs, "id", "text", ",", 2).collect()}

    # kept tokens: Sea (4), "salt\nsea" (2), "sea salt" (2), and the empty one, which has no terms
    df = {"sea": 3, "salt": 3}
    tf = {(1, "sea"): 3, (1, "salt"): 2, (2, "sea"): 3, (2, "salt"): 1, (None, "sea"): 2, (None, "salt"): 1}
    raw = {k: n * (np.log(6 / (1 + df[k[1]])) + 1) for k, n in tf.items()}
    want = {k: round(w / np.sqrt(sum(v * v for j, v in raw.items() if j[0] == k[0])), 9) for k, w in raw.items()}
    copied, salted = [], features.salted_join
    monkeypatch.setattr(features, "salted_join", lambda *a: copied.append(a) or salted(*a))
    assert weights() == pytest.approx(want) and not copied
    monkeypatch.setattr(features, "COPIED_ROWS", 0)
    monkeypatch.setattr(features, "TASK_BYTES", 4)
    assert weights() == pytest.approx(want) and len(copied) == 2


def test_fitted_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(styles, "TASK_ROWS", 100)
    rows = spark.range(1000).coalesce(1).selectExpr("id", "concat('s', id % 2) AS style", "concat('a', id % 7) AS kind")
    coded = styles.coded_rows(styles.encoders(rows, ["kind"]), rows)
    parts = [r[0] for r in coded.groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(parts) == 1000 and len(parts) == 10 and max(parts) < 200


def test_sparse_rows(spark):
    weights = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.25), (3, "c", 1.0)], "id int, term string, weight double")
    docs = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "id int, cat string")
    rows, index = clusters.sparse_rows(weights, docs, "id", "cat")
    assert {r["row_id"]: (r["indices"], r["values"], r["category"]) for r in rows.collect()} == {1: ([0, 1], [0.25, 0.5], "x"), 2: ([], [], "None"), 3: ([2], [1.0], "x")}
    assert {r["term"]: r["place"] for r in index.collect()} == {"a": 0, "b": 1, "c": 2}


def test_sparse_and_dense_rows_cluster_alike(spark, rows):
    dense = rows.withColumn("vector", F.transform("vector", lambda x: F.when(x > 0, x).otherwise(0.0)))
    entries = dense.select("row_id", "category", F.filter(F.transform("vector", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] > 0).alias("e"))
    sparse = entries.select("row_id", F.col("e.i").alias("indices"), F.col("e.x").alias("values"), "category")
    assert clusters.mismatch_weight(sparse) == pytest.approx(clusters.mismatch_weight(dense))
    one, two = clusters.fit(dense, [4])[4], clusters.fit(sparse, [4])[4]
    assert np.allclose(one.centres, two.centres) and one.categories == two.categories and one.cost == pytest.approx(two.cost)
    assert np.allclose(clusters.sweep(sparse, [3, 4]), clusters.sweep(dense, [3, 4]))


def _lloyd(data, centres, categories, gamma):
    """Plain K-Prototypes from given centres: the final cost."""
    x, cat = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    while True:
        distance = ((x[:, None] - centres[None]) ** 2).sum(axis=2) + gamma * (cat[:, None] != np.array(categories)[None])
        label, before = distance.argmin(axis=1), centres.copy()
        for j in range(len(centres)):
            if (label == j).any():
                centres[j] = x[label == j].mean(axis=0)
                names, counts = np.unique(cat[label == j], return_counts=True)
                categories[j] = names[counts.argmax()]
        if np.allclose(before, centres):
            return distance.min(axis=1).sum()


def test_start_is_fixed_by_the_seed_and_no_worse_than_the_first_rows(rows):
    held = rows.orderBy(F.xxhash64("row_id", F.lit(42)), "row_id").collect()
    data = [(r["vector"], r["category"]) for r in held]
    for k in (3, 4, 6):
        model, again = clusters.fit(rows, [k])[k], clusters.fit(rows.repartition(5), [k])[k]
        assert np.allclose(model.centres, again.centres) and model.categories == again.categories
        first = _lloyd(data, np.array([v for v, _ in data[:k]]), [c for _, c in data[:k]], model.gamma)
        assert model.cost <= first + 1e-6


def test_start_takes_distinct_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0], "a") for i in range(50)] + [(50, [0.0, 1.0], "a"), (51, [1.0, 0.0], "b")], "id int, v array<double>, cat string")
    model = clusters.fit(clusters.vector_rows(same, "id", "v", "cat"), [3])[3]
    assert model.cost == pytest.approx(0) and sorted(model.sizes) == [1, 1, 50]


def test_a_hundred_thousand_terms(spark):
    """Three groups of documents with terms of their own, 100,000 terms in all; nothing is refused or cut."""
    weights = [(d, f"t{t}", 20.0 if t < 15 else 1.0) for d in range(300) for t in (*range(d % 3 * 5, d % 3 * 5 + 5), *range(15 + d * 334, 15 + (d + 1) * 334))]
    docs = spark.createDataFrame([(d, "x") for d in range(300)], "id int, cat string")
    rows, index = clusters.sparse_rows(spark.createDataFrame(weights, "id int, term string, weight double"), docs, "id", "cat")
    assert index.count() > 100_000
    model = clusters.fit(rows, [3])[3]
    assert sorted(model.sizes) == [100, 100, 100]
    groups = clusters.assign(rows, model).groupBy("cluster").agg(F.collect_set(F.col("row_id") % 3).alias("g")).collect()
    assert sorted(tuple(r["g"]) for r in groups) == [(0,), (1,), (2,)]


def test_sparse_multi_hot_has_no_widest_class_list(spark):
    df = spark.createDataFrame([(i, f"c{i},c{(i * 7) % 3000}") for i in range(3000)] + [(3000, "c5")], "id int, m string")
    rows, index = encode.multi_hot_sparse(df, "id", "m")
    names = sorted(f"c{i}" for i in range(3000))
    assert [r["class"] for r in index.orderBy("place").collect()] == names
    for r in rows.filter("id % 500 = 0").collect():
        assert [names[p] for p in r["indices"]] == sorted({"c5"} if r["id"] == 3000 else {f"c{r['id']}", f"c{r['id'] * 7 % 3000}"})


def test_soft_vote_first_class_wins_ties(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.8, 0.2]), ([0.1, 0.9], [0.3, 0.7])], "a array<double>, b array<double>")
    out = df.select(styles.arg_max_class(styles.soft_vote([F.col("a"), F.col("b")])).alias("c")).collect()
    assert [r["c"] for r in out] == [0, 1]


def test_style_model_learns_a_rule_and_is_stored(spark, tmp_path):
    colours, fits = ["화이트", "블랙", "레드"], ["루즈", "노멀", None]
    data = [
        (i, "ab"[i % 3 == 0], colours[i % 3], "셔츠", "긴팔", "면", "무지", fits[i % 3], "x", "롱", "팬츠", "블랙", "면", "노멀", "x")
        for i in range(180)
    ]
    schema = "id int, style string, " + ", ".join(f"{c} string" for c in (
        "top_color", "top_category", "top_sleeve_length", "top_material", "top_print", "top_fit", "top_sub_style",
        "bottom_length", "bottom_category", "bottom_color", "bottom_material", "bottom_fit", "bottom_sub_style"))
    train, test = styles.split_and_fill(spark.createDataFrame(data, schema), styles.TWO_PIECE)
    assert train.count() + test.count() == 180 and test.count() == 36
    assert train.filter("top_fit IS NULL").count() == 0
    model = styles.train_style_model(train, styles.TWO_PIECE, trees=5, rounds=2)
    scored = model.predict(test)
    assert scored.filter("style = predicted_style").count() == 36

    folder = str(tmp_path / "models")
    with pytest.raises(ValueError):
        stored_models.load_style_model(spark, folder)
    assert [stored_models.save_style_model(model, folder) for _ in range(2)] == [1, 2]
    # a save that was cut short is no version, and its folder is not written again
    spark.range(1).write.parquet(f"{folder}/3/codes")
    for version in (None, 1):
        loaded = stored_models.load_style_model(spark, folder, version)
        assert sorted(loaded.predict(test).select("id", "probability", "predicted_style").collect()) == sorted(scored.select("id", "probability", "predicted_style").collect())
    with pytest.raises(ValueError):
        stored_models.load_style_model(spark, folder, 3)
    assert stored_models.save_style_model(model, folder) == 4
    unseen = test.withColumn("top_color", F.lit("never seen"))
    assert model.predict(unseen).filter("predicted_style IS NULL").count() == 0


def test_class_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    got = {r["class"]: r for r in features.class_report(df).collect()}
    assert (got["c"]["precision"], got["c"]["recall"], got["c"]["f1"], got["c"]["support"]) == (0.0, 0.0, 0.0, 1.0)
    assert got["a"]["precision"] == 0.5 and got["accuracy"]["f1"] == 0.5
    assert got["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 0) / 3)


def test_random_users(spark):
    tops = spark.createDataFrame([(i, "셔츠", "레드", "팬츠", "블랙") for i in range(30)], "id long, top_category string, top_color string, bottom_category string, bottom_color string")
    dresses = spark.createDataFrame([(100 + i, "레드") for i in range(5)], "id long, dress_color string")
    ids = spark.range(2000).withColumnRenamed("id", "user_id")
    users = synthetic.random_users(ids, tops, dresses)
    assert users.count() == 2000
    share = users.filter("dress_id IS NOT NULL").count() / 2000
    assert 0.35 < share < 0.45
    assert users.filter("(dress_id IS NULL) = (top_id IS NULL)").count() == 0
    assert users.select("top_id").distinct().count() == 31
    assert users.exceptAll(synthetic.random_users(ids, tops, dresses)).count() == 0
