import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.operators import learning as L


def test_softmax_regression_separates():
    rows = [(np.array([0, 2]), np.array([1.0, 0.1])), (np.array([1, 2]), np.array([1.0, 0.1]))] * 4
    w, b = L.fit_softmax(rows, np.array([0, 1] * 4), 3, 2)
    for at, want in ((0, 0), (1, 1)):
        z = w[at] + b
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert p.argmax() == want and p.max() > 0.5 and p.sum() == pytest.approx(1)


def test_out_of_fold(spark):
    docs = spark.createDataFrame([(f"d{i}", "ab"[i % 2], i // 2 % 5) for i in range(40)], "doc string, label string, fold int")
    vectors = spark.createDataFrame([(f"d{i}", [i % 2, 5], [1.0, 0.2]) for i in range(39)], "doc string, terms array<bigint>, weights array<float>")
    got = L.out_of_fold(docs, vectors, epochs=20).collect()
    assert len(got) == 40 and sum(r["label"] == r["predicted"] for r in got) >= 39


def test_kmeans(spark):
    rng = np.random.default_rng(3)
    x = [(i, (np.eye(3)[i % 3] + rng.normal(0, 0.05, 3)).tolist()) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    df = spark.createDataFrame(x, "id long, v array<double>")
    labels, centroids = L.kmeans(df, 3, doc="id", vector="v")
    got = {r["doc"]: r["cluster"] for r in labels.collect()}
    assert len({tuple(sorted(i for i in range(60) if got[i] == c)) for c in range(3)}) == 3
    assert all(len({got[i] for i in range(s, 60, 3)}) == 1 for s in range(3)) and got[60] == 0 and 61 not in got


def test_zero_vectors_and_ties_go_first(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    got = {r["doc"]: r["cluster"] for r in L.assign(df, np.eye(2), doc="id", vector="v").collect()}
    assert got == {1: 0, 2: 0}


def test_top_terms(spark):
    w = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", -1.0), ("c", "z", 1.0)], "doc string, term string, w double")
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "doc string, cluster int")
    got = {(r["cluster"], r["term"]) for r in L.top_terms(w, labels, 1).collect()}
    assert got == {(0, "x"), (1, "z")}
    assert L.top_terms(w.where("false"), labels, 1).select(F.col("term")).count() == 0


def test_sparse_kmeans_matches_dense(spark):
    rng = np.random.default_rng(5)
    x = np.eye(4)[rng.integers(0, 4, 80)] + np.abs(rng.normal(0, 0.05, (80, 4)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, list(range(4)), v.tolist()) for i, v in enumerate(x)], "doc long, at array<int>, w array<float>")
    labels, c = L.sparse_kmeans(rows, 4, 4)
    got = {r["doc"]: r["cluster"] for r in labels.collect()}
    assert len({(got[i], int(x[i].argmax())) for i in range(80)}) == 4 and c.shape == (4, 4)
    assert L.sparse_kmeans(rows.where("false"), 4, 4)[0].count() == 0


def test_registered_models_get_the_production_epochs(spark, monkeypatch):
    from compare import DATA
    from deskloom import queries

    if not DATA.exists():
        pytest.skip("no data")
    seen = []
    real = L.out_of_fold
    monkeypatch.setattr(L, "out_of_fold", lambda *a, **o: seen.append(o.get("epochs", L.EPOCHS)) or real(*a, **o))
    queries.logreg_oof(spark, str(DATA))
    queries.simple_system(spark, str(DATA))
    assert seen == [250, 250]


def test_models_see_every_labelled_row(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i:02d}", "abc"[i % 3], i // 3 % 5) for i in range(60)], "doc string, label string, fold int")
    vectors = spark.createDataFrame([(f"d{i:02d}", [i % 3, 5], [1.0, 0.2]) for i in range(60)], "doc string, terms array<bigint>, weights array<float>")
    seen = []
    real = L.cut
    # a marked row's term has a weight only in the models that were given the row
    monkeypatch.setattr(L, "cut", lambda df: seen.append(real(df)) or seen[-1])
    marked = vectors.withColumn("terms", F.when(F.col("doc") == "d59", F.array(F.lit(77).cast("long"), F.lit(5).cast("long"))).otherwise(F.col("terms")))
    assert "train_bound" not in L.out_of_fold.__kwdefaults__
    L.out_of_fold(docs, marked, epochs=5).collect()
    models = {r["model"]: np.array(r["w"]).reshape(-1, 3)[list(r["known"]).index(77)] for r in seen[-1].collect()}
    assert set(models) == set(range(5)) and {m for m, w in models.items() if not w.any()} == {59 // 3 % 5}


def test_models_in_step_equal_models_alone():
    draw = np.random.default_rng(2)
    rows = [(np.sort(draw.choice(30, n, replace=False)), draw.random(n)) for n in draw.integers(0, 25, 41)]
    y = draw.integers(0, 3, 41)
    members = [np.flatnonzero(np.arange(41) % 4 != k) for k in range(4)]
    w, b = L.fit_in_step(rows, y, members, 30, np.zeros((4, 3)), epochs=6)
    for k, m in enumerate(members):
        alone, bias, order, rng = np.zeros((30, 3)), np.zeros(3), np.arange(len(m)), np.random.default_rng(5)
        for epoch in range(6):
            step = L.RATE / (1 + 0.01 * epoch)
            rng.shuffle(order)
            for i in m[order]:
                at, x = rows[i]
                p = np.exp(x @ alone[at] + bias)
                p /= p.sum()
                p[y[i]] -= 1
                alone[at] -= step * np.outer(x, p)
                bias -= step * p
            alone *= 1 - step * L.L2
        assert np.allclose(alone, w[k]) and np.allclose(bias, b[k])
