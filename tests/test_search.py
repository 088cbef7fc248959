import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.functions.text import analyze, signature, tokenize
from deskloom.operators import search, tfidf


def vectors(spark, docs, **fit):
    df = spark.createDataFrame(docs, "id string, t string")
    counts = tfidf.terms_of(df, doc="id", terms=analyze(tokenize(F.col("t"))))
    return counts, tfidf.transform(counts, tfidf.fit(counts, df, **fit))


DOCS = [("a", "flight delayed three hours"), ("b", "flight delayed again today"), ("c", "lost suitcase"), ("d", None), ("e", "")]


def test_unit_length_and_cosine(spark):
    _, w = vectors(spark, DOCS)
    norms = {r["doc"]: r["n"] for r in w.groupBy("doc").agg(F.sum(F.col("w").cast("double") * F.col("w")).alias("n")).collect()}
    assert set(norms) == {"a", "b", "c"} and all(abs(n - 1) < 1e-5 for n in norms.values())
    v = search.vectors(w)
    got = {(r["q"], r["doc"]): r["score"] for r in search.top_k(v, v, 9).collect()}
    assert got["a", "a"] == pytest.approx(1, abs=1e-5) and got["a", "b"] > 0 and ("a", "c") not in got


def test_vocabulary_ties_at_the_cap(spark):
    counts, _ = vectors(spark, DOCS)
    v = tfidf.fit(counts, 5, max_features=3).collect()
    assert {r["term"] for r in v} == {"delayed", "flight", "flight_delayed"}


def test_unknown_words_find_nothing(spark):
    _, w = vectors(spark, DOCS)
    _, q = vectors(spark, [("q", "the of and"), ("r", "zebra")])
    assert search.top_k(search.vectors(q), search.vectors(w), 3).count() == 0
    ids = spark.createDataFrame([("q",), ("r",)], "doc string")
    assert {r["top_score"] for r in tfidf.top_score(q, ids, w).collect()} == {0.0}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, (300, 8)).astype(float)
    rows = spark.createDataFrame([(f"{i:03d}", [int(j) for j in np.flatnonzero(v)], [float(v[j]) for j in np.flatnonzero(v)]) for i, v in enumerate(x)], "doc string, terms array<bigint>, weights array<float>")
    got = {}
    for r in search.top_k(rows.where("doc < '040'"), rows, 7, drop_self=True).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["doc"])
    for i in range(40):
        s = x @ x[i]
        want = sorted((j for j in range(300) if j != i and s[j] > 0), key=lambda j: (-s[j], j))[:7]
        assert got.get(f"{i:03d}", []) == [f"{j:03d}" for j in want]


def test_precedents_take_one_of_a_template(spark):
    docs = [(f"d{i}", "flight delayed") for i in range(5)] + [("x", "flight delayed hours")]
    _, w = vectors(spark, docs)
    replies = spark.createDataFrame([(d, "sorry about that, agent {} is here".format("one" if d != "x" else "two")) for d, _ in docs], "doc string, r string").select("doc", signature(tokenize(F.col("r"))).alias("signature"))
    q = w.where("doc = 'd0'").withColumn("doc", F.lit("q"))
    got = tfidf.precedents(q, w, replies, 3).orderBy("rank").collect()
    assert [r["doc"] for r in got] == ["d0", "x"]


def test_allowed_rows_only(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 0.5), ("c", "y", 1.0)], "doc string, term string, w float")
    q = spark.createDataFrame([("q", "x", 1.0)], "doc string, term string, w float")
    allow = spark.createDataFrame([("b",), ("c",)], "doc string")
    got = search.top_k(search.vectors(q), search.vectors(rows), 3, allow=allow).collect()
    assert [(r["doc"], r["rank"]) for r in got] == [("b", 1)]


def test_sparse_products_equal_matrix_products():
    import numpy as np

    draw = np.random.default_rng(1)
    n = lambda k: (np.sort(draw.integers(0, k, 6000)), draw.integers(0, 3000, 6000), draw.random(6000))
    (q_of, q_t, q_w), (d_of, d_t, d_w) = n(50), n(300)
    want = np.zeros((300, 3000))
    np.add.at(want, (d_of, d_t), d_w)
    right = np.zeros((3000, 50))
    np.add.at(right, (q_t, q_of), q_w)
    assert np.allclose(search._scores(q_of, q_t, q_w, 50, d_of, d_t, d_w, 300), want @ right)


def test_blocks_of_any_size_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 12)), 1) * (rng.random((90, 12)) < 0.5)
    x[60:] = x[:30]  # equal scores, told apart by id
    rows = spark.createDataFrame([(f"{i:03d}", [int(j) for j in np.flatnonzero(v)], [float(v[j]) for j in np.flatnonzero(v)]) for i, v in enumerate(x)], "doc string, terms array<int>, weights array<float>").repartition(3)
    told = lambda: sorted((r["q"], r["rank"], r["doc"]) for r in search.top_k(rows, rows, 4, drop_self=True).collect())
    want = []
    for i, v in enumerate(x.astype(np.float32).astype(float)):
        s = np.round(x.astype(np.float32).astype(float) @ v, 6)
        want += [(f"{i:03d}", n + 1, f"{j:03d}") for n, j in enumerate(sorted((j for j in range(90) if j != i and s[j] > 0), key=lambda j: (-s[j], j))[:4])]
    assert told() == sorted(want)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ROW_BLOCK", 5)
    assert told() == sorted(want)


def test_no_pair_of_blocks_is_shuffled(spark):
    rows = spark.range(50).selectExpr("cast(id as string) doc", "array(id % 7, id % 5 + 10) terms", "array(float(1), float(1)) weights")
    plan = search.top_k(rows, rows, 2)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "CartesianProduct" in below and "Exchange" not in below


def test_weights_without_rows_for_terms(spark):
    """Vectors from lines equal those from long rows, texts of one document and pairs within a text included."""
    df = spark.createDataFrame([*DOCS, ("a", "delayed flight flight"), ("f", "hours hours")], "id string, t string")
    counts = tfidf.terms_of(df, doc="id", terms=analyze(tokenize(F.col("t"))))
    v = tfidf.fit(counts, 7)
    want = {(r["doc"], r["term"]): r["w"] for r in tfidf.transform(counts, v).collect()}
    docs = tfidf.documents(df.select("id", tfidf.line(tokenize(F.col("t"))).alias("line")), doc="id")
    assert sorted((r["term"], r["df"]) for r in tfidf.document_frequency(tfidf.line_terms(docs)).collect()) == sorted((r["term"], r["df"]) for r in v.collect())
    names = [r["term"] for r in v.orderBy("term").collect()]
    got = {(r["doc"], names[t]): w for r in tfidf.weigh(docs, v.orderBy("term")).collect() for t, w in zip(r["terms"], r["weights"])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
