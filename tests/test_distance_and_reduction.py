import itertools

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from demescope.functions.vectors import vector_distance
from demescope.operators import balls, cluster_metrics, distance, reduce, reshape


@pytest.mark.parametrize("tile,block", [(256, 16384), (7, 9)])
def test_sample_distances_match_numpy(cells, tile, block):
    df, m = cells
    got = {(r["sample_a"], r["sample_b"]): r for r in distance.sample_differences(df, tile, block)
           .withColumn("h", distance.distance_from_differences("hamming"))
           .withColumn("m1", distance.distance_from_differences("manhattan"))
           .withColumn("e", distance.distance_from_differences("euclidean"))
           .withColumn("p3", distance.distance_from_differences("minkowski", 3)).collect()}
    assert len(got) == 60 * 59 // 2
    for (a, b), r in got.items():
        both = (m[a] >= 0) & (m[b] >= 0)
        d = np.abs(m[a, both] - m[b, both]).astype(float)
        assert r["n_valid"] == both.sum()
        assert np.allclose([r["h"], r["m1"], r["e"], r["p3"]], [(d > 0).sum(), d.sum(), np.sqrt((d**2).sum()), (d**3).sum() ** (1 / 3)])


def test_pairs_of_samples_are_not_shuffled(spark, cells):
    """With one block of variants pairs are listed where they are counted, with several their counts travel as matrices."""
    df, _ = cells
    for block in (40, 9, 2):
        found = distance.sample_differences(df, 16, block)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "sample_b" not in plan.split("\n", 1)[1] and "Aggregate [sample_a" not in plan
        assert found.agg(F.sum("n_valid"), F.sum("off_by_1"), F.sum("off_by_2"), F.count("*")).first() == distance.sample_differences(
            df).agg(F.sum("n_valid"), F.sum("off_by_1"), F.sum("off_by_2"), F.count("*")).first()


def test_tiles_of_samples_meet_without_a_shuffle(spark, cells):
    """Tiles are dealt once, whatever the number of pairs of tiles; a sample without a call has pairs, a cell without a sample none."""
    df, m = cells
    odd = spark.createDataFrame([(60, 0, None), (None, 1, 2), (61, 3, 7)], "sample_no int, snp_idx int, dosage int")
    found = distance.sample_differences(df.select("sample_no", "snp_idx", "dosage").unionByName(odd), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    rows = found.collect()
    assert len({(r["sample_a"], r["sample_b"]) for r in rows}) == len(rows) == 62 * 61 // 2
    assert all(r["n_valid"] == 0 for r in rows if r["sample_b"] >= 60)
    for r in rows[::7]:
        if r["sample_b"] < 60:
            a, b = m[r["sample_a"]], m[r["sample_b"]]
            gap = np.abs(a - b)[(a >= 0) & (b >= 0)]
            assert (r["n_valid"], r["off_by_1"], r["off_by_2"]) == (len(gap), (gap == 1).sum(), (gap == 2).sum())


def test_rescaled_distance_and_bad_metric(cells):
    df, _ = cells
    r = distance.sample_distances(df, "manhattan", rescale=True).join(
        distance.sample_distances(df, "manhattan").withColumnRenamed("distance", "plain"), ["sample_a", "sample_b", "n_valid"]).first()
    assert np.isclose(r["distance"], r["plain"] * 40 / r["n_valid"])
    with pytest.raises(ValueError):
        distance.sample_distances(df, "cosine")


def test_vector_expressions(spark):
    df = spark.createDataFrame([([0.0, 3.0, 1.0], [4.0, 0.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(*[vector_distance("a", "b", m, 3).alias(m) for m in ("euclidean", "manhattan", "minkowski", "hamming")]).first()
    assert np.allclose(list(got), [5.0, 7.0, (64 + 27) ** (1 / 3), 2.0])


def points(spark, n=90, d=3, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[5] = x[17]
    lab = np.random.default_rng(seed + 1).integers(0, 4, n)
    df = spark.createDataFrame([(i, x[i].tolist(), int(lab[i])) for i in range(n)], "id bigint, features array<double>, label int")
    return df, x, lab


@pytest.mark.parametrize("tile", [1024, 11])
def test_neighbours_match_brute_force(spark, tile):
    df, x, _ = points(spark)
    near = distance.nearest_neighbours(df, df, 5, tile, exclude_self=True)
    got = {}
    for r in near.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:5]
        assert [got[i][k] for k in range(1, 6)] == want


@pytest.mark.parametrize("tile", [1024, 13])
def test_separation_and_ch_match_brute_force(spark, tile):
    df, x, lab = points(spark)
    pts = df.withColumnRenamed("label", "cluster")
    r = distance.cluster_separation(pts, tile).first()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    same = lab[:, None] == lab[None]
    assert np.isclose(r["min_between"], d[~same].min()) and np.isclose(r["max_within"], d[same].max())
    g = x.mean(axis=0)
    b = sum((lab == c).sum() * ((x[lab == c].mean(axis=0) - g) ** 2).sum() for c in set(lab))
    w = sum(((x[lab == c] - x[lab == c].mean(axis=0)) ** 2).sum() for c in set(lab))
    k = len(set(lab))
    assert np.isclose(cluster_metrics.calinski_harabasz(pts).first()["ch"], (b / (k - 1)) / (w / (len(x) - k)))


def test_balls_out_of_reach_are_not_compared(spark):
    """Tight groups far apart: neighbours and extremes are exact, most pairs of balls are never looked into."""
    rng = np.random.default_rng(6)
    lab = np.arange(400) % 20
    x = rng.normal(size=(20, 4))[lab] * 100 + rng.normal(size=(400, 4)) * 0.1
    df = spark.createDataFrame([(i, x[i].tolist(), int(lab[i])) for i in range(400)], "id bigint, features array<double>, label int")
    near, pairs, compared = balls.nearest_in_balls(df, df, 3, tile=8, exclude_self=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in near.collect()}
    order = np.lexsort((np.broadcast_to(np.arange(400), d.shape), d), axis=1)
    assert {k: v[0] for k, v in got.items()} == {(i, r + 1): order[i, r] for i in range(400) for r in range(3)}
    assert compared < pairs / 3
    r = balls.separation(df.withColumnRenamed("label", "cluster"), tile=8).first()
    np.fill_diagonal(d, 0)
    same = lab[:, None] == lab[None]
    assert np.isclose(r["min_between"], d[~same].min()) and np.isclose(r["max_within"], d[same].max())
    assert r["compared"] < r["pairs"] / 2


def test_points_travel_by_chunks(spark, monkeypatch):
    """Points meet once per pair of chunks, however many balls a chunk holds; cut balls and small steps change nothing."""
    monkeypatch.setattr(balls, "TILE", 4)
    monkeypatch.setattr(balls, "MAX_CHUNK", 40)
    met, plain = [], balls.meet
    monkeypatch.setattr(balls, "meet", lambda left, right, *rest: met.append(left.count()) or plain(left, right, *rest))
    df, x, lab = points(spark, n=160, d=12)
    near, pairs, compared = balls.nearest_in_balls(df, df, 4, tile=4, exclude_self=True)
    assert len(met) == 2 and max(met) <= 100 < compared
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(160), d.shape), d), axis=1)
    assert {(r["query_id"], r["rank"]): r["id"] for r in near.collect()} == {(i, r + 1): order[i, r] for i in range(160) for r in range(4)}
    met.clear()
    r = balls.separation(df.withColumnRenamed("label", "cluster"), tile=4).first()
    same = lab[:, None] == lab[None]
    assert np.isclose(r["min_between"], d[~same].min()) and np.isclose(r["max_within"], d[same & np.isfinite(d)].max())
    assert len(met) <= balls.WAVES + 1 and max(met) <= 55 < r["compared"]


def test_few_exact_distances_are_taken(spark):
    """One product tells which pairs matter, also for points far from the origin, with ties and with wild numbers."""
    rng = np.random.default_rng(9)
    for shift, size in ((0.0, 1.0), (1e6, 1.0), (0.0, 1e-30), (0.0, 1e30)):
        x = rng.normal(size=(700, 8)) * size + shift
        x[100:140] = x[:40]
        rough = balls.Rough.of(x, x)
        d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        assert np.abs(rough.block(slice(0, 700)) * rough.scale**2 - d2).max() <= rough.slack * rough.scale**2
        ids, label = np.arange(700), np.arange(700) % 3
        side = {"id": ids, "number": np.zeros(700, int), "x": x, "label": label, "reach": [None] * 700}
        taken, plain = [], balls.Rough.exact
        balls.Rough.exact = lambda self, rows, cols, taken=taken, plain=plain: taken.append(len(rows)) or plain(self, rows, cols)
        try:
            got = balls._kernel(4, True)(side, side, np.ones((1, 1), dtype=bool))
        finally:
            balls.Rough.exact = plain
        d = np.sqrt(d2)
        np.fill_diagonal(d, np.inf)
        want = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :4]
        assert (got["id"].to_numpy().reshape(700, 4) == want).all() and 0 < sum(taken) < 700 * 700 / 10
    x[3, 2] = np.nan
    assert balls.Rough.of(x, x) is None and balls.Rough.of(x[:2], x[:2] * 1e200) is None
    assert len(balls._kernel(2, True)(side | {"x": x}, side | {"x": x}, np.ones((1, 1), dtype=bool))) == 699 * 2


def test_neighbours_of_few_points(spark):
    df = spark.createDataFrame([(1, [0.0], 5), (2, [3.0], 6)], "id bigint, features array<double>, label int")
    got = sorted(tuple(r) for r in distance.nearest_neighbours(df, df, 4, exclude_self=True).collect())
    assert got == [(1, 1, 2, 6, 3.0), (2, 1, 1, 5, 3.0)]
    assert distance.nearest_neighbours(df, df.limit(0), 2).count() == 0 and distance.nearest_neighbours(df.limit(0), df, 2).count() == 0
    assert tuple(balls.separation(df.limit(0).withColumnRenamed("label", "cluster")).first()) == (None, None, 0, 0)


def test_running_share_over_many_partitions(spark):
    df = spark.range(5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("k")).withColumn("v", (F.col("k") % 13).cast("int"))
    got = reshape.cumulative_share(df, "k", "v")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    v = np.arange(5000) % 13
    rows = got.orderBy("k").collect()
    assert np.allclose([r["cum_share"] for r in rows], np.cumsum(v) / v.sum()) and got.columns == ["k", "v", "share", "cum_share"]
    assert reshape.cumulative_share(df.limit(0), "k", "v").count() == 0


def test_separation_of_degenerate_clusterings(spark):
    one = spark.createDataFrame([(1, [0.0], 0), (2, [3.0], 0)], "id bigint, features array<double>, cluster int")
    assert cluster_metrics.dunn(one).first()["dunn"] is None
    assert cluster_metrics.calinski_harabasz(one).first()["ch"] is None


def test_sample_pca_matches_numpy(cells):
    df, m = cells
    z = []
    for v in range(40):
        ok = m[:, v] >= 0
        p = m[ok, v].mean() / 2
        if 0 < p < 1:
            row = np.zeros(60)
            row[ok] = (m[ok, v] - 2 * p) / np.sqrt(p * (1 - p))
            z.append(row)
    u, s, vt = np.linalg.svd(np.array(z), full_matrices=False)
    scores, values = reduce.sample_pca(df, 3)
    rows = sorted((r["sample_id"], list(r["features"])) for r in scores.collect())
    got = np.array([f for _, f in rows])
    assert np.allclose(got, reduce.fix_signs(vt[:3].T), atol=1e-8)
    vals = [r["eigenvalue"] for r in values.orderBy("pc").collect()]
    assert np.allclose(vals, s[:3] ** 2 / len(z))
    table = reduce.eigenvalue_table(values).collect()
    assert table[0]["component"] == "PC1" and np.isclose(table[2]["cum_pct_variance"], round(100 * (s[:3] ** 2).sum() / (s**2).sum(), 2), atol=0.011)


def test_sample_pca_drops_incomplete_variants(cells):
    df, m = cells
    rows = reduce.standard_features(df, 60, missing_rate=0.05).count()
    full = [(m[:, v] >= 0).sum() >= 57 and 0 < m[m[:, v] >= 0, v].mean() < 2 for v in range(40)]
    assert rows == sum(full)


def test_mds_of_euclidean_distances_equals_component_scores(spark):
    x = np.random.default_rng(0).normal(size=(25, 4)) * [4, 3, 2, 1]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(25), 2)], "sample_a bigint, sample_b bigint, distance double")
    got = np.array([list(r["features"]) for r in reduce.classical_mds(pairs, 25, 10, None).orderBy("sample_no").collect()])
    assert got.shape == (25, 4)
    back = np.sqrt(((got[:, None] - got[None]) ** 2).sum(axis=2))
    assert np.allclose(back, d, atol=1e-6)
    df = spark.createDataFrame([(i, Vectors.dense(x[i])) for i in range(25)], ["i", "features"])
    pca = np.array([list(r["features"]) for r in reduce.mds_euclidean(df, 4).orderBy("i").collect()])
    gap = np.sqrt(((pca[:, None] - pca[None]) ** 2).sum(axis=2))
    assert np.allclose(gap, d, atol=1e-6)
    assert reduce.classical_mds(pairs, 25, 10, 0.1).first()["features"].size == 1


def test_mds_without_a_list_of_pairs(spark, cells, monkeypatch):
    """Distances counted anew for each product scale as listed ones do, also with restarts and with numbers that no sample has."""
    df, m = cells
    held = []
    monkeypatch.setattr(reduce, "MDS_BLOCK", 4)
    monkeypatch.setattr(reduce, "MDS_BASIS", 24)
    monkeypatch.setattr(distance, "sample_differences", lambda *a: held.append(a))
    gaps = df.filter("sample_no not in (3, 50)")
    for metric, p, rescale, tables in (("manhattan", 1, True, [df, gaps]), ("hamming", 2, False, [df]), ("minkowski", 2.5, True, [df])):
        for left in tables:
            some = sorted({r[0] for r in left.select("sample_no").distinct().collect()})
            d2, power = np.zeros((60, 60)), {"manhattan": 1, "euclidean": 2, "hamming": 0}.get(metric, p)
            for a, b in itertools.permutations(some, 2):
                both = (m[a] >= 0) & (m[b] >= 0)
                gap = np.abs(m[a, both] - m[b, both]).astype(float)
                total = (gap[gap > 0] ** power).sum() * (40 / both.sum() if rescale else 1)
                d2[a, b] = total ** (2 / (power or 1))
            mean = d2.sum(axis=1) / 60
            c = -0.5 * (d2 - mean[:, None] - mean + mean.mean())[some]
            s, v = np.linalg.svd(c)[1:]
            keep = [i for i in range(5) if (v[i][some] * (c @ v[i])).sum() > 0]
            want = reduce.fix_signs(v[keep].T) * np.sqrt(s[keep])
            found = distance.sample_distances(left, metric, p, tile=7, rescale=rescale, listed=False)
            got = np.array([list(r["features"]) for r in reduce.classical_mds(found, 60, 5, None).orderBy("sample_no").collect()])
            assert got.shape == want.shape and np.allclose(got, want, atol=1e-6)
    assert not held
    alone = df.filter("sample_no < 2 and (sample_no = 0) = (snp_idx < 9)")
    with pytest.raises(Exception, match="no variant called in both"):
        reduce.classical_mds(distance.sample_distances(alone, rescale=True, listed=False), 2)


def test_components_by_share_keeps_one():
    assert reduce.components_by_share([9.0, 1.0], 0.5) == 1
    assert reduce.components_by_share([4.0, 3.0, 2.0, 1.0], 0.7) == 2


def test_pca_cuts(spark):
    x = np.random.default_rng(3).normal(size=(40, 5)) @ np.diag([5, 4, 1, 1, 1])
    df = spark.createDataFrame([(f"s{i}", "X", Vectors.dense(x[i])) for i in range(40)], ["sample_id", "region", "features"])
    k = reduce.pca_scaled(df, 5, 0.7, mode="variance").first()["features"].size
    cov = np.cov((x / x.std(axis=0, ddof=1)).T)
    vals = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert k == reduce.components_by_share(vals, 0.7)
    assert reduce.pca_scaled(df, 5, 0.7).first()["features"].size >= 1
    assert reduce.pca_on_split(df, 0, 0.5).count() == 40
    with pytest.raises(ValueError):
        reduce.pca_on_split(df, 2, method="Exact")
