import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from demescope.operators import class_metrics, classify, cluster, contingency, trees


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    lab = np.arange(90) % 3
    x = centres[lab] + rng.normal(size=(90, 2))
    df = spark.createDataFrame([(f"s{i:02d}", "ABC"[lab[i]], Vectors.dense(x[i])) for i in range(90)], ["sample_id", "region", "features"]).coalesce(1).persist()
    return df, x, lab


def ari(df):
    return contingency.agreement(contingency.confusion(df, "region", "prediction")).first()["ari"]


def test_clusterings_find_the_blobs(blobs):
    df, _, _ = blobs
    for fit in (cluster.kmeans, cluster.gaussian_mixture, cluster.bisecting_kmeans):
        found, model = fit(df, 3)
        assert found.columns == cluster.OUTPUT
        assert cluster.assign(model, df).count() == 90
    for fit in (cluster.ward, cluster.ward_kmeans, lambda d, k: cluster.ward(d, k, leaves=20)):
        assert ari(fit(df, 3)) > 90


def naive_ward(x, k):
    groups = [[i] for i in range(len(x))]
    d = {(i, j): np.linalg.norm(x[i] - x[j]) for i in range(len(x)) for j in range(i)}
    ids = list(range(len(x)))
    size = {i: 1 for i in ids}
    members = {i: [i] for i in ids}

    def gap(i, j):
        return d[(max(i, j), min(i, j))]

    while len(ids) > k:
        i, j = min(((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]), key=lambda p: gap(*p))
        for h in ids:
            if h not in (i, j):
                new = ((size[i] + size[h]) * gap(i, h) + (size[j] + size[h]) * gap(j, h) - size[h] * gap(i, j)) / (size[i] + size[j] + size[h])
                d[(max(i, h), min(i, h))] = new
        size[i] += size[j]
        members[i] += members.pop(j)
        ids.remove(j)
    return {frozenset(m) for m in members.values()}


def test_ward_labels_match_a_plain_loop():
    x = np.random.default_rng(11).normal(size=(30, 3))
    for k in (1, 3, 6, 30):
        lab = cluster.ward_labels(x, np.ones(30), k)
        assert {frozenset(np.flatnonzero(lab == c)) for c in set(lab)} == naive_ward(x, k)
    assert cluster.ward_labels(x, np.ones(30), 3)[0] == 0


def test_ward_of_a_table_is_the_textbook_method_up_to_the_leaves(spark):
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(12).normal(size=(40, 3))
    x[7] = x[3]  # equal samples share a leaf of weight two
    df = spark.createDataFrame([(f"s{i:02d}", "X", Vectors.dense(v)) for i, v in enumerate(x)], ["sample_id", "region", "features"])
    single = np.delete(x, 7, axis=0)
    weights = np.ones(39)
    weights[3] = 2
    want = cluster.ward_labels(single, weights, 5)
    want = np.insert(want, 7, want[3])
    for leaves in (40, 500):
        rows = sorted((r["sample_id"], r["prediction"]) for r in cluster.ward(df, 5, leaves).collect())
        got = np.array([p for _, p in rows])
        assert {frozenset(np.flatnonzero(got == c)) for c in set(got)} == {frozenset(np.flatnonzero(want == c)) for c in set(want)}


def test_seeded_kmeans_matches_lloyd(blobs):
    df, x, _ = blobs
    start = x[[0, 1, 5]]
    c = start.copy()
    for _ in range(20):
        lab = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[lab == i].mean(axis=0) if (lab == i).any() else c[i] for i in range(3)])
        if np.abs(new - c).max() <= 1e-9:
            break
        c = new
    got = [r["prediction"] for r in cluster.seeded_kmeans(df, start).orderBy("sample_id").collect()]
    assert got == lab.tolist()


def test_tune_k_and_members(blobs):
    df, _, _ = blobs
    scores = cluster.tune_k(df, "kmeans", (2, 3), repeats=2)
    assert scores.count() == 4
    assert cluster.best_k(scores, "ari").first()["k"] == 3
    found = cluster.ward(df, 3)
    members = cluster.cluster_members(found, 0, df.select("sample_id", "region"))
    assert members.count() == found.filter("prediction = 0").count()


def cells(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, n bigint")


def test_agreement_of_equal_and_trivial_groupings(spark):
    same = contingency.agreement(cells(spark, [(0, 5, 4), (1, 7, 6)])).first()
    assert (same["purity"], same["ri"], same["ari"]) == (100.0, 100.0, 100.0)
    one = contingency.agreement(cells(spark, [(0, 0, 3)])).first()
    assert one["ari"] == 100.0
    single = contingency.agreement(cells(spark, [(0, 0, 1)])).first()
    assert single["ri"] == 100.0


def test_macro_metrics_and_kappa(spark):
    chance = class_metrics.macro_metrics(cells(spark, [(0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, 5)])).first()
    assert chance["kappa"] == 0.0 and chance["accuracy"] == 50.0
    perfect = class_metrics.macro_metrics(cells(spark, [(0, 0, 5), (1, 1, 3)])).first()
    assert perfect["kappa"] == 1.0 and perfect["error"] == 0.0 and perfect["f1_error"] == 0.0
    skew = {r["label"]: r for r in class_metrics.class_report(cells(spark, [(0, 0, 8), (1, 0, 2)])).collect()}
    assert skew["1"]["precision"] is None and skew["1"]["recall"] == 0.0
    assert skew["0"]["precision"] == 80.0 and skew["0"]["ref_recall"] == 80.0


def test_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(3)
    lab, pred = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(lab, pred)], "label int, prediction int")
    areas = []
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = pred[lab == i], pred[lab == j]
            auc = np.mean([(p < q) + 0.5 * (p == q) for p in a for q in b])
            areas.append(auc if np.median(a) <= np.median(b) else 1 - auc)
    got = class_metrics.multiclass_auc(contingency.confusion(df)).first()["auc"]
    assert np.isclose(got, np.mean(areas))


@pytest.mark.parametrize("name", list(classify.CLASSIFIERS))
def test_classifiers_separate_blobs(blobs, name):
    df, _, _ = blobs
    row = classify.train_test_errors(df, [name], trees=10, folds=2).first()
    assert row["train_error"] <= 12 and row["test_error"] <= 15
    assert df.is_cached


def test_bayes_and_discriminants(blobs):
    df, x, lab = blobs
    for model in (classify.naive_bayes(df), classify.discriminant(df), classify.discriminant(df, quadratic=True)):
        assert classify.metrics_of(classify.predicted(model, df)).first()["error"] <= 8
    lda = classify.discriminant(df)
    means = np.array([x[lab == c].mean(axis=0) for c in range(3)])
    cov = sum(np.cov(x[lab == c].T) * ((lab == c).sum() - 1) for c in range(3)) / (len(x) - 3)
    score = np.array([x @ np.linalg.inv(cov) @ m - 0.5 * m @ np.linalg.inv(cov) @ m + np.log((lab == c).mean()) for c, m in enumerate(means)]).T
    got = [r["prediction"] for r in classify.predicted(lda, df).orderBy("sample_id").collect()]
    assert got == score.argmax(axis=1).tolist()


def test_quadratic_map_is_the_kernel(blobs):
    df, x, _ = blobs
    stages, column = classify.kernel_stages(df, "quadratic", 0.7, 1)
    mapped = df
    for s in stages:
        mapped = s.transform(mapped)
    z = np.array([r[column].toArray() for r in mapped.orderBy("sample_id").collect()])
    assert np.allclose(z @ z.T + 1, (0.7 * x @ x.T + 1) ** 2)


def test_fourier_map_approximates_the_gaussian_kernel(blobs):
    df, x, _ = blobs
    stages, column = classify.kernel_stages(df, "RBF", 0.1, 1)
    z = np.array([r[column].toArray() for r in stages[0].transform(df).orderBy("sample_id").collect()])
    want = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.35
    with pytest.raises(ValueError):
        classify.kernel_stages(df, "cubic", 1.0, 1)


def test_tree_reports(blobs):
    df, _, _ = blobs
    model = classify.decision_tree(df, cv=True, folds=2, bins=(10,), depths=(2, 4), impurities=("gini",))
    assert "If" in classify.tree_text(model)
    train, test = df.filter("sample_id < 's60'"), df.filter("sample_id >= 's60'")
    forest, report = trees.forest_report(train, test, trees=10)
    assert {r["split"] for r in report.collect()} == {"train", "test"}
    assert np.isclose(classify.feature_importance(forest).agg(F.sum("importance")).first()[0], 1.0)


def test_weakest_links_of_a_hand_worked_tree():
    # Root 0 (40, 20, 20) has leaf 1 (30, 2, 0) and node 2 (10, 18, 20); 2 has 3 (8, 16, 0), cut into pure leaves
    # 4 and 5, and leaf 6 (2, 2, 20). Root errs 40, 2 errs 28, 3 errs 8; leaves 1 and 6 err 2 and 4.
    counts = np.array([[40, 20, 20], [30, 2, 0], [10, 18, 20], [8, 16, 0], [8, 0, 0], [0, 16, 0], [2, 2, 20]], float)
    nodes = trees.Nodes(counts, np.array([1, -1, 3, 4, -1, -1, -1]), np.array([2, -1, 6, 5, -1, -1, -1]))
    # Saved errors a leaf: 3: 8; 2: (28 - 4) / 2 = 12; 0: (40 - 6) / 3 = 11.33. So 3 closes at 8 / 40. Then 2:
    # 28 - 12 = 16; 0: (40 - 14) / 2 = 13, which closes the root at 13 / 40.
    links = nodes.links()
    assert [(round(c, 6), np.flatnonzero(o).tolist()) for c, o in links] == [(0.0, [0, 2, 3]), (0.2, [0, 2]), (0.325, [])]
    assert nodes.predictions(links[0][1]).tolist() == [0, 0, 1, 2]
    assert nodes.predictions(links[1][1]).tolist() == [0, 1, 1, 2]
    assert nodes.predictions(links[2][1]).tolist() == [0, 0, 0, 0]
    assert (trees.subtree_at(links, 0.25) == links[1][1]).all() and not trees.subtree_at(links, np.inf).any()


def test_pruned_tree_drops_splits_on_noise(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    lab = (x[:, 0] > 0) ^ (rng.random(400) < 0.15)
    df = spark.createDataFrame([(f"s{i:03d}", "AB"[int(lab[i])], Vectors.dense(x[i])) for i in range(400)], ["sample_id", "region", "features"]).coalesce(1)
    model, table = trees.pruned_tree(df, folds=5)
    got = table.collect()
    assert got[0]["n_splits"] == 0 and got[0]["rel_error"] == 1.0 and got[-1]["cp"] == 0.001
    assert all(a["cp"] > b["cp"] and a["n_splits"] < b["n_splits"] and a["rel_error"] > b["rel_error"] for a, b in zip(got, got[1:]))
    best = min(got, key=lambda r: (r["cv_error"], r["n_splits"]))
    assert 1 <= best["n_splits"] <= 5 < got[-1]["n_splits"] and best["cv_error"] < got[-1]["cv_error"]
    judged = classify.predicted(model, df)
    root = min(lab.sum(), 400 - lab.sum())
    assert np.isclose(judged.filter("label <> prediction").count() / root, best["rel_error"])


def test_out_of_bag_votes_against_numpy(blobs):
    df, x, lab = blobs
    forest = trees.bagged_forest(df, trees=45, seed=5)
    every = forest.index.transform(df)
    for k, tree in enumerate(forest.trees):
        every = tree.transform(every).withColumn(f"w{k}", trees.bag_weight("sample_id", k, 5))
    seen = {r["sample_id"]: r for r in every.collect()}
    assert 0.9 < np.mean([r[f"w{k}"] for r in seen.values() for k in range(45)]) < 1.1
    for unseen in (True, False):
        want = {}
        for name, r in seen.items():
            votes = np.bincount([int(r[f"_tree{k}"]) for k in range(45) if not unseen or r[f"w{k}"] == 0], minlength=3)
            want[name] = float(votes.argmax())
        assert {r["sample_id"]: r["prediction"] for r in forest.elected(df, unseen).collect()} == want
    assert sum(want[f"s{i:02d}"] == lab[i] for i in range(90)) > 85


def test_named_predictions_and_repeats(blobs):
    df, _, _ = blobs
    model = classify.decision_tree(df)
    named = classify.with_class_names(classify.predicted(model, df), classify.class_names(df))
    assert named.filter("predicted_region = region").count() > 80
    assert classify.f1_error(classify.predicted(model, df)) < 0.1
    runs = classify.repeated_metrics(df, lambda d: classify.decision_tree(d), repeats=2)
    assert runs.count() == 4
    assert class_metrics.mean_metrics(runs, ["split"]).count() == 2
    errors = class_metrics.mean_metrics(runs, ["split"]).columns
    assert "repeat" not in errors


def test_knn_vote_and_errors(spark):
    rows = [(i, [float(i)], int(i >= 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label int")
    errors = {r["k"]: r["error"] for r in classify.knn_errors(df, (1, 3)).collect()}
    # Each line end of a class prefers the smaller id, so one border point errs at k = 1.
    want = {}
    for k in (1, 3):
        wrong = 0
        for i in range(10):
            near = sorted((j for j in range(10) if j != i), key=lambda j: (abs(i - j), j))[:k]
            votes = [int(j >= 5) for j in near]
            wrong += int(min((-votes.count(v), v) for v in set(votes))[1] != int(i >= 5))
        want[k] = 10.0 * wrong
    assert errors == want


def test_best_classifier(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 4.0, 5.0), ("c", 0.0, 6.0)], "algorithm string, train_error double, test_error double")
    assert classify.best_classifier(df).first()["algorithm"] == "b"
