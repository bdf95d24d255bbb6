"""Clustering against an independent numpy version, invariants and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulo.operators import fcm, init, metrics, normalise, profile
from cumulo.plans import clustering
from cumulo.sources.synthetic import bands


def table(spark, rows, labels=None):
    data = [(i, [float(v) for v in r], None if labels is None else labels[i]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row_id bigint, x array<double>, label int")


def matrix(points):
    return np.array([r["x"] for r in points.orderBy("row_id").collect()])


def np_membership(x, c, m=2.0):
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1))
    out = np.zeros(d.shape)
    for i, row in enumerate(d):
        near = [j for j, v in enumerate(row) if v < 1e-10]
        out[i] = np.eye(len(row))[near[-1]] if near else [1 / sum((a / b) ** (2 / (m - 1)) for b in row) for a in row]
    return out


def np_fit(x, u, steps, m=2.0):
    deltas = []
    c = (u**m).T @ x / np.maximum((u**m).sum(0), 1e-10)[:, None]
    for _ in range(steps):
        new = np_membership(x, c, m)
        c = (new**m).T @ x / np.maximum((new**m).sum(0), 1e-10)[:, None]
        deltas.append(math.sqrt(((new - u) ** 2).sum()))
        u = new
    return c, u, deltas


@pytest.fixture(scope="module")
def synthetic(spark):
    return bands(spark).cache()


def test_generator(synthetic):
    state, rows = 42, []
    for _ in range(400):
        draws = []
        for _ in range(51):
            state = (state * 1664525 + 1013904223) % 2**32
            draws.append(state / (2**32 - 1))
        g = min(int(draws[0] * 4), 3)
        rows.append([0.45 + 0.45 * r if g * 12 <= f < (g + 1) * 12 else 0.12 * r for f, r in enumerate(draws[1:])])
    assert matrix(synthetic) == pytest.approx(np.array(rows), abs=1e-12)
    assert {r["grp"]: r["count"] for r in synthetic.groupBy("grp").count().collect()} == {0: 106, 1: 86, 2: 107, 3: 101}


@pytest.mark.parametrize("norm, iterations, delta, sil, db", [("l2", 12, 1.684e-6, 0.777490, 0.322221), ("zscore", 15, 2.498e-6, 0.714697, 0.420186)])
def test_goldens(synthetic, norm, iterations, delta, sil, db):
    points = normalise.prepare(synthetic.select("row_id", "x"), norm, True)
    result, row = clustering.run_strategy(points, "domain", 4)
    r = row.first()
    assert result.iterations == iterations and result.final_delta == pytest.approx(delta, rel=1e-3) and result.converged
    assert r["silhouette"] == pytest.approx(sil, abs=1e-6) and r["davies_bouldin"] == pytest.approx(db, abs=1e-6)
    assert [x["n"] for x in metrics.sizes(points.withColumn("domain_label", init.index_label(4)), result).orderBy("label").collect()] == [107, 86, 106, 101]


@pytest.mark.parametrize("form", ["arrow", "flat"])
@pytest.mark.parametrize("m", [2.0, 1.6])
def test_fit_equals_numpy(spark, form, m):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (20, 3)) for c in (0, 2, 5)])
    points = table(spark, x.tolist(), [i % 3 for i in range(60)])
    result = fcm.fit(points, init.Start("labels", 3, label="label"), m=m, epsilon=0.0, max_iterations=5, form=form)
    u0 = np.where(np.arange(60)[:, None] % 3 == np.arange(3), 0.8, 0.1)
    c, u, deltas = np_fit(x, u0, 5, m)
    assert np.array(result.centroids) == pytest.approx(c, abs=1e-9)
    assert [d for _, d in result.history] == pytest.approx(deltas, abs=1e-9)
    got = np.array([r["u"] for r in fcm.result_membership(points, result).orderBy("row_id").collect()])
    assert got == pytest.approx(u, abs=1e-9) and got.sum(1) == pytest.approx(1)
    assert fcm.progress(result)[0].startswith("iteration 1:") and len(fcm.progress(result)) == 5


def test_row_order_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(2)
    points = table(spark, rng.random((40, 2)).tolist())
    a = fcm.fit(points.repartition(1), init.Start("random", 3, 7), max_iterations=4)
    b = fcm.fit(points.orderBy(F.desc("row_id")).repartition(5), init.Start("random", 3, 7), max_iterations=4)
    assert np.array(a.centroids) == pytest.approx(np.array(b.centroids), abs=1e-12)


def test_a_point_on_two_centroids_belongs_to_the_last(spark):
    points = table(spark, [[1, 1], [3, 3]])
    for limit in (0, 64):
        fcm.FLAT_LIMIT, old = limit, fcm.FLAT_LIMIT
        u = [list(r["u"]) for r in fcm.membership(points, [[1.0, 1.0], [1.0, 1.0], [2.0, 2.0]]).orderBy("row_id").collect()]
        fcm.FLAT_LIMIT = old
        assert u[0] == [0.0, 1.0, 0.0] and sum(u[1]) == pytest.approx(1)
    assert [r["label"] for r in fcm.labels(spark.createDataFrame([(0, [0.4, 0.4, 0.2])], "row_id bigint, u array<double>")).collect()] == [0]


def test_bad_arguments(spark):
    points = table(spark, [[1, 1]])
    with pytest.raises(ValueError):
        fcm.fit(points, init.Start("random", 2), m=1.0)
    with pytest.raises(ValueError):
        fcm.fit(points.limit(0), init.Start("random", 2))
    for bad in (lambda: init.Start("other", 2), lambda: init.Start("random", 0), lambda: normalise.normalize(points, "l3"), lambda: clustering.RunSettings(norm="l3"), lambda: clustering.RunSettings(n=0), lambda: init.start(points, "best", 2)):
        with pytest.raises(ValueError):
            bad()


def test_starts(spark):
    points = table(spark, [[0, 0], [0, 1], [9, 9], [9, 8]], [0, 7, None, 1])
    u = [list(r["u0"]) for r in init.Start("labels", 2, label="label").apply(points).orderBy("row_id").collect()]
    assert u == [pytest.approx([0.8, 0.2])] * 3 + [pytest.approx([0.2, 0.8])]
    assert [list(r["u0"]) for r in init.Start("labels", 1, label="label").apply(points).collect()] == [[1.0]] * 4
    seeds = ((0.0, 0.0), (9.0, 9.0))
    near = [list(r["u0"]) for r in init.Start("seeds", 2, seeds=seeds).apply(points).orderBy("row_id").collect()]
    assert [n.index(max(n)) for n in near] == [0, 0, 1, 1] and near[0] == pytest.approx([0.7, 0.3])
    means = {(r["j"], r["f"]): r["v"] for r in init.class_means(points, "label", 2).collect()}
    assert means == {(0, 0): 0.0, (0, 1): 0.0, (1, 0): 9.0, (1, 1): 8.0}
    assert init.class_seeds(points, "label", 3)[2] in matrix(points).tolist()
    found = init.kmeanspp_seeds(points, 2, first=0)
    assert found[0] == (0.0, 0.0) and found[1] in {(9.0, 9.0), (9.0, 8.0), (0.0, 1.0)}


@pytest.mark.parametrize("r", [0.0, 0.1, 0.5, 0.73, 0.999, 1.0])
def test_sampling_by_prefix_sums(spark, r):
    w = np.random.default_rng(3).random(50)
    w[7] = 0
    ids = np.arange(50) * 1000
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, w)], "row_id bigint, d2 double")
    c = np.cumsum(w)
    hit = np.flatnonzero(c >= r * c[-1] - 1e-12)
    assert init.sample_by_weight(df, r) == ids[hit[0] if len(hit) else -1]
    assert init.sample_by_weight(df.limit(0), r) is None


def np_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(x)) != i)
        others = [d[i, labels == k].mean() for k in set(labels) if k != own]
        if not mine.any():
            out.append(0.0)
        elif not others:
            out.append(1.0)
        else:
            a, b = d[i, mine].mean(), min(others)
            out.append((b - a) / max(a, b) if max(a, b) > 1e-15 else 0.0)
    return np.array(out)


@pytest.mark.parametrize("labels", [[0, 0, 0, 1, 1, 1, 2, 2], [0] * 7 + [5], [3] * 8])
def test_silhouette_equals_numpy(spark, labels):
    x = np.random.default_rng(4).random((8, 3))
    x[1] = x[0]
    points = table(spark, x.tolist(), labels)
    slow = np_silhouette(x, np.array(labels))
    for tile in (3, 2048):
        sums = metrics.distance_sums(points, tile)
        assert sums.where("other = label").count() == 8
    got = [r["s"] for r in metrics.silhouette_samples(points).orderBy("row_id").collect()]
    assert got == pytest.approx(slow.tolist(), abs=1e-12)


def test_silhouette_merges_equal_points(spark):
    """copies of a few points cost no more pairs than the points themselves."""
    x = np.random.default_rng(5).random((30, 2)).repeat(20, axis=0)
    labels = [int(v[0] > 0.5) for v in x]
    points = table(spark, x.tolist(), labels)
    merged, kinds = metrics._merged(points)
    assert merged.count() == 30 and sum(n for _, n in kinds) == 600
    slow = np_silhouette(x, np.array(labels))
    assert [r["s"] for r in metrics.silhouette_samples(points).orderBy("row_id").collect()] == pytest.approx(slow.tolist(), abs=1e-9)
    assert metrics.silhouette_mean(points).first()["silhouette"] == pytest.approx(slow.mean(), abs=1e-9)


def test_silhouette_far_from_the_origin_and_in_many_groups(spark, monkeypatch):
    """distances by products keep their digits, and each pair of groups is a task of its own, which adaptive execution leaves alone."""
    monkeypatch.setattr(metrics, "LEAST", 8)
    x = np.random.default_rng(6).random((60, 3)) * 1e-3 + 1e6
    points = table(spark, x.tolist(), [i % 3 for i in range(60)])
    merged, kinds = metrics._merged(points)
    totals = metrics._totals(merged, kinds, metrics.TILE)
    got = {r["row_id"]: r["s"] for r in metrics.silhouette_samples(points).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(np_silhouette(x, np.arange(60) % 3).tolist(), abs=1e-9)
    assert "REPARTITION_BY_NUM, [plan_id" in totals._jdf.queryExecution().executedPlan().toString() and totals.count() == 60


def test_silhouette_wants_ids_and_labels(spark):
    for ids, labels in (([0, 0], [1, 2]), ([0, 1], [1, None])):
        with pytest.raises(ValueError):
            metrics.silhouette_samples(table(spark, [[1], [2]], labels).withColumn("row_id", F.when(F.col("row_id") == 1, F.lit(ids[1])).otherwise(F.lit(ids[0]))))


def test_davies_bouldin(spark):
    points = table(spark, [[0, 0], [0, 2], [10, 0], [10, 4]], [0, 0, 1, 1])
    assert metrics.davies_bouldin(points, [[0.0, 1.0], [10.0, 2.0], [99.0, 99.0]]) == pytest.approx(3 / math.sqrt(101))
    assert metrics.davies_bouldin(points, [[1.0, 1.0], [1.0, 1.0]]) == math.inf  # the sum of two largest numbers
    assert metrics.davies_bouldin(points.withColumn("label", F.lit(0)), [[0.0, 1.0]]) == 0.0


def test_scaling_edges(spark):
    points = table(spark, [[0, 0, 5], [3, 4, 5], [6, 8, 5]])
    assert matrix(normalise.normalize_l2(points.select("row_id", F.slice("x", 1, 2).alias("x")))).tolist() == [[0, 0], [0.6, 0.8], [0.6, 0.8]]
    assert normalise.count_zero_rows(points.select("row_id", F.slice("x", 1, 2).alias("x"))) == 1
    assert matrix(normalise.normalize_minmax(points))[:, 2].tolist() == [0, 0, 0] and matrix(normalise.normalize_minmax(points))[:, 0].tolist() == [0, 0.5, 1]
    z = matrix(normalise.normalize_zscore(points))
    assert z[:, 2].tolist() == [0, 0, 0] and z[:, 0].std() == pytest.approx(1)
    idf = matrix(normalise.weight_idf(points))
    assert idf[:, 0].tolist() == [0, 0, 0] and (idf[:, 2] < 0).all()
    assert normalise.normalize_minmax(points.limit(0)).count() == 0 and normalise.idf_imbalance(points) == (0, 1)


def test_profile_edges(spark):
    points = table(spark, [[1, 0, 0], [1, 1, 0], [1, 0, 0]])
    r = profile.imbalance(points).first()
    assert (r["n_features"], r["dead"], r["low_variance"], r["active"], r["rare"]) == (3, 2, 2, 1, 1)
    assert [x["f"] for x in profile.top_variance(points).collect()] == [1, 0, 2] and [x["f"] for x in profile.low_variance(points).collect()] == [1]
    s = profile.sparsity(points).first()
    assert (s["cells"], s["zeros"]) == (9, 5) and s["mean_nnz"] == pytest.approx(4 / 3)
    h = {x["bin"]: x["n"] for x in profile.nonzero_histogram(points, 4).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 1}
    profile.check_range(points)
    with pytest.raises(ValueError):
        profile.check_range(table(spark, [[1.5]]))
