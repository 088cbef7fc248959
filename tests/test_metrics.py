import random

import pytest
from pyspark.sql import functions as F

from deskloom.operators import metrics as m


def frame(spark, rows, schema="g string, p string"):
    return spark.createDataFrame(rows, schema)


def test_routing(spark):
    rows = list(zip(["auto", "auto", "escalate", "escalate", "escalate"], ["auto", "escalate", "auto", "escalate", "escalate"]))
    r = m.routing(frame(spark, rows + [("?", "auto"), (None, None)]), by=[], gold="g", pred="p").first()
    assert (r["n"], r["auto_rate"], r["false_auto_rate"], r["over_escalation"]) == (5, 0.4, 0.5, 0.5) and r["escalation_recall"] == pytest.approx(2 / 3)
    none = m.routing(frame(spark, [("escalate", "escalate")]), by=[], gold="g", pred="p").first()
    assert none["auto_precision"] == 0 and none["auto_rate"] == 0


def test_class_report(spark):
    cells = m.confusion(frame(spark, [("a", "a"), ("a", "a"), ("b", "b"), ("zz", "a")]), by=[], gold="g", pred="p", labels=["a", "b", "c"])
    report = m.class_report(cells, by=[], labels=["a", "b", "c"])
    c = m.classification(report, by=[]).first()
    assert (c["n"], c["accuracy"], c["macro_f1"], c["weighted_f1"]) == (3, 1.0, 1.0, 1.0)
    assert {r["label"]: r["support"] for r in report.collect()} == {"a": 2, "b": 1, "c": 0}


def test_wilson(spark):
    got = {}
    for k, n in ((5, 100), (0, 50), (0, 0), (7, 7)):
        low, high = m.wilson(F.lit(k), F.lit(n))
        got[k, n] = tuple(spark.range(1).select(low, high).first())
    assert got[5, 100][0] < 0.05 < got[5, 100][1] and got[0, 50][0] == 0 < got[0, 50][1] and got[0, 0] == (0, 0) and got[7, 7][1] == 1


def test_kappa(spark):
    k = lambda rows: m.cohen_kappa(frame(spark, rows), "g", "p", by=[]).first()["kappa"]
    assert k([("a", "a"), ("b", "b")]) == 1 and k([("a", "a")] * 3) == 1 and k([("a", "b"), ("b", "a")]) == -1


def test_ordinal(spark):
    q = lambda a, b: m.quadratic_kappa(frame(spark, list(zip(a, b)), "g int, p int"), "g", "p", by=[]).first()["quadratic_kappa"]
    assert q([4, 4, 5, 3], [5, 4, 4, 3]) > q([1, 1, 5, 5], [5, 5, 1, 1]) and q([3, 3], [3, 3]) == 1 and q([9, 1], [5, -3]) == 1
    o = m.ordinal_agreement(frame(spark, [(5, 3)] * 3 + [(None, 1)], "g int, p int"), "g", "p", by=[]).first()
    assert (o["n"], o["bias"], o["mae"], o["within_one"]) == (3, 2.0, 2.0, 0.0)


def test_correlations(spark):
    random.seed(2)
    xs, ys = [random.randint(1, 5) for _ in range(60)], [random.randint(1, 5) for _ in range(60)]
    rank = lambda v: [sum(a < x for a in v) + (sum(a == x for a in v) + 1) / 2 for x in v]

    def r(a, b):
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5

    df = frame(spark, list(zip(xs, ys)) + [(None, 2)], "x int, y int")
    assert m.pearson(df, "x", "y", by=[]).first()["pearson"] == pytest.approx(r(xs, ys))
    assert m.spearman(df, "x", "y", by=[]).first()["spearman"] == pytest.approx(r(rank(xs), rank(ys)))
    flat = frame(spark, [(1, 2), (1, 3)], "x int, y int")
    assert m.pearson(flat, "x", "y", by=[]).first()["pearson"] == 0 and m.spearman(flat, "x", "y", by=[]).first()["spearman"] == 0


def test_bootstrap(spark):
    df = frame(spark, [(f"k{i}", float(i % 5)) for i in range(50)], "k string, v double")
    b = m.bootstrap_mean(df, "v", by=[], seed=1, iterations=100).first()
    assert b["low"] < b["mean"] == 2.0 < b["high"]
    one = m.bootstrap_mean(frame(spark, [("k", 3.0)], "k string, v double"), "v", by=[], seed=1, iterations=1).first()
    assert (one["low"], one["mean"], one["high"]) == (3.0, 3.0, 3.0)


def test_calibration_keeps_empty_bins(spark):
    c = m.calibration(frame(spark, [(0.95, True), (1.0, False), (None, True)], "c double, ok boolean"), by=[], confidence="c", correct=F.col("ok")).orderBy("bin").collect()
    assert [r["n"] for r in c] == [0, 0, 0, 0, 0, 2] and c[-1]["accuracy"] == 0.5


def test_majority(spark):
    one = lambda rows: m.majority(frame(spark, [(x,) for x in rows], "l string"), "l").first()["label"]
    assert one(["b", "a", "b", "a", None]) == "a" and one([]) == "other" and one([None]) == "other"


def test_bootstrap_counts_equal_values_together(spark):
    """The interval of a share of a million rows, from two rows of counts, is that of theory."""
    df = spark.range(1_000_000).select((F.col("id") % 4 == 0).cast("double").alias("v"))
    b = m.bootstrap_mean(df, "v", by=[], seed=2, iterations=2000).first()
    half = 1.96 * (0.25 * 0.75 / 1_000_000) ** 0.5
    assert b["n"] == 1_000_000 and b["mean"] == 0.25 and b["high"] - b["low"] == pytest.approx(2 * half, rel=0.12)
    cells = frame(spark, [("a", "a", 40), ("a", "b", 10), ("b", "b", 45), ("b", "a", 5)], "gold string, pred string, n long").withColumn("system", F.lit("s"))
    c = m.bootstrap_classes(cells, by=["system"]).first()
    assert 0.75 < c["accuracy_low"] < 0.85 < c["accuracy_high"] < 0.95 and c["macro_f1_low"] < 0.85 < c["macro_f1_high"]


def test_judge_against_people(spark):
    from deskloom.plans import report

    schema = "system string, episode_id string, grounding int, resolution int, tone int, composite double, sendable boolean"
    judge = spark.createDataFrame([("s", f"e{i}", 1 + i % 5, 3, 4, i / 10, i % 2 == 0) for i in range(10)] + [("s", "alone", 1, 1, 1, 1.0, True)], schema)
    got = {r["dimension"]: r for r in report.judge_human(judge, judge.where("episode_id <> 'alone'")).collect()}
    assert set(got) == {"grounding", "resolution", "tone", "composite", "sendable"} and got["grounding"]["n"] == 10
    assert got["grounding"]["kappa"] == 1 == got["sendable"]["kappa"] == got["sendable"]["exact"] and got["composite"]["rho"] == pytest.approx(1)
