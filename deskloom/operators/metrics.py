"""Evaluation statistics as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.functions.text import hash_draw

# --- fixed values -----------------------------------------------------------
Z = 1.959964
EDGES = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0001)
BOOTSTRAP = 2000
# ---------------------------------------------------------------------------
#: Counts up to this are drawn from the exact distribution, of which so many values matter; larger ones from the normal one.
EXACT, VALUES = 10, 32


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of k out of n, ``[0, 0]`` for n = 0."""
    p = ratio(k, n)
    d = 1 + Z * Z / n
    mid, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / d)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / d)).otherwise(0.0)


def confusion(df: DataFrame, *, by: list[str], gold: str, pred: str, labels: list[str]) -> DataFrame:
    """``by, gold, pred, n`` of known labels only."""
    return df.where(F.col(gold).isin(labels) & F.col(pred).isin(labels)).groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(cells: DataFrame, *, by: list[str], labels: list[str]) -> DataFrame:
    """Support, predicted, precision, recall and F1 for every label of ``labels`` and group of ``cells``."""
    spark = cells.sparkSession
    grid = cells.select(*by).distinct().crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in labels], "label string"))) if by else spark.createDataFrame([(x,) for x in labels], "label string")
    gold = cells.groupBy(*by, F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    pred = cells.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    on = [*by, "label"]
    x = grid.join(gold, on, "left").join(pred, on, "left").fillna(0, ["support", "hits", "predicted"])
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return x.select(*on, "support", "predicted", "hits", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def classification(report: DataFrame, *, by: list[str]) -> DataFrame:
    """Accuracy, macro F1 over labels that occur in gold, and F1 weighted by support."""
    n = F.sum("support")
    return report.groupBy(*by).agg(n.alias("n"), ratio(F.sum("hits"), n).alias("accuracy"), F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"))


def routing(df: DataFrame, *, by: list[str], gold: str, pred: str) -> DataFrame:
    """The 2 x 2 table of routes, ``escalate`` positive, and its rates; other labels don't count."""
    x = df.where(F.col(gold).isin("auto", "escalate") & F.col(pred).isin("auto", "escalate"))
    g, p = F.col(gold) == "escalate", F.col(pred) == "escalate"
    t = x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return t.select(
        *by, "n", "tp", "fp", "fn", "tn",
        ratio(tn + fn, F.col("n")).alias("auto_rate"), ratio(fn, tn + fn).alias("false_auto_rate"), recall.alias("escalation_recall"), precision.alias("escalation_precision"),
        ratio(2 * precision * recall, precision + recall).alias("escalation_f1"), ratio(fp, fp + tn).alias("over_escalation"), ratio(tp + tn, F.col("n")).alias("accuracy"),
        F.when(tn + fn > 0, ratio(tn, tn + fn)).otherwise(0.0).alias("auto_precision"),
    )


def majority(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label, the first in alphabetical order among equals; ``other`` where there is none."""
    best = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))
    return best.select(F.coalesce("label", F.lit("other")).alias("label"))


def agreement(df: DataFrame, a: str, b: str, *, by: list[str]) -> DataFrame:
    """``by, n, agree``: the share of rows on which two columns are equal."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col(a) == F.col(b)).cast("double")), F.lit(0.0)).alias("agree"))


def cohen_kappa(df: DataFrame, a: str, b: str, *, by: list[str]) -> DataFrame:
    """``by, n, agree, kappa`` over the labels of either rater; 1 where chance alone would agree."""
    cells = df.groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    xs = cells.groupBy(*by, F.col("x").alias("label")).agg(F.sum("c").alias("nx"))
    ys = cells.groupBy(*by, F.col("y").alias("label")).agg(F.sum("c").alias("ny"))
    chance = xs.join(ys, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("products"))
    x = (total.join(chance, by, "left") if by else total.crossJoin(chance)).fillna(0, ["products"])
    po, pe = ratio(F.col("same"), F.col("n")), ratio(F.col("products"), F.col("n").cast("double") * F.col("n"))
    return x.select(*by, F.coalesce("n", F.lit(0)).alias("n"), po.alias("agree"), F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(pe >= 1 - 1e-12, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums, 0 without variance."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy))).otherwise(0.0)


def pearson(df: DataFrame, x: str, y: str, *, by: list[str], name: str = "pearson") -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(pearson_from_sums(F.count("*"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)), F.lit(0.0)).alias(name))


def average_rank(df: DataFrame, x: str, *, by: list[str], name: str) -> DataFrame:
    """Add the average rank of ``x`` within ``by``. Distinct values are ranked from their counts, so many equal values cost one row."""
    counts = df.groupBy(*by, x).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(x))
    return df.join(counts.select(*by, x, (upto - (F.col("_c") - 1) / 2).alias(name)), [*by, x])


def spearman(df: DataFrame, x: str, y: str, *, by: list[str]) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_rank(average_rank(rows, "_x", by=by, name="_rx"), "_y", by=by, name="_ry")
    return pearson(ranked, "_rx", "_ry", by=by, name="spearman")


def ordinal_agreement(df: DataFrame, a: str, b: str, *, by: list[str]) -> DataFrame:
    """Exact and near agreement, mean absolute error, means and bias of two ratings."""
    d = F.col(a) - F.col(b)
    return df.where(d.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((F.abs(d) <= 1).cast("double")).alias("within_one"), F.avg(F.abs(d).cast("double")).alias("mae"),
        F.avg(F.col(a).cast("double")).alias("mean_a"), F.avg(F.col(b).cast("double")).alias("mean_b"), F.avg(d.cast("double")).alias("bias"),
    )


def quadratic_kappa(df: DataFrame, a: str, b: str, *, by: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """Kappa weighted by squared distance; ratings are rounded and kept in range. 1 without expected disagreement, 0 below two levels."""
    level = lambda c: F.least(F.greatest(F.round(F.col(c).cast("double")), F.lit(float(low))), F.lit(float(high)))
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, level(a).alias("x"), level(b).alias("y"))
    # the expected squared distance of independent ratings follows from means and squares alone
    s = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("x") - F.col("y"), F.lit(2))).alias("seen"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    expected = F.col("sxx") + F.col("syy") - 2 * F.col("sx") * F.col("sy") / F.col("n")
    value = F.lit(0.0) if high <= low else F.when(F.col("n") == 0, 0.0).when(F.abs(expected) < 1e-12, 1.0).otherwise(1 - F.col("seen") / expected)
    return s.select(*by, "n", value.alias("quadratic_kappa"))


def poisson_table() -> list[list[float]]:
    """For counts 0 to ``EXACT``: the chance of at most 0, 1, 2, ... draws."""
    out = []
    for c in range(EXACT + 1):
        p, total, row = math.exp(-c), 0.0, []
        for k in range(VALUES):
            total += p
            row.append(total)
            p *= c / (k + 1)
        out.append(row)
    return out


def resampled(count: Column, key: Column, seed: int) -> Column:
    """How often a resample takes what occurs ``count`` times: a Poisson draw by the hash of ``key``.

    Rows of a resample with replacement are taken about Poisson(1) times each,
    so equal rows need one draw together, however many they are.
    """
    u = (hash_draw(key, seed) + 0.5) / 2**32
    v = (hash_draw(F.concat(key, F.lit("'")), seed) + 0.5) / 2**32
    flat = F.array(*(F.lit(x) for row in poisson_table() for x in row))
    at = F.least(count, F.lit(EXACT)).cast("int") * VALUES
    # bound to a variable, so that the draw is hashed once
    few = F.get(F.transform(F.array(u), lambda x: F.size(F.filter(F.slice(flat, at + 1, F.lit(VALUES)), lambda p: p < x))), F.lit(0)).cast("long")
    many = F.greatest(F.lit(0.0), F.round(count + F.sqrt(count.cast("double")) * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v))).cast("long")
    return F.when(count <= EXACT, few).otherwise(many)


def _percentiles(values: str, iterations: int) -> tuple[Column, Column]:
    """The 2.5 and 97.5 % places of a sorted array of ``iterations`` values."""
    return tuple(F.element_at(values, min(int(q * iterations), iterations - 1) + 1) for q in (0.025, 0.975))


def bootstrap_mean(df: DataFrame, value: str, *, by: list[str], seed: int, iterations: int = BOOTSTRAP) -> DataFrame:
    """``by, n, mean, low, high``: percentile interval of the mean from ``iterations`` resamples.

    Equal values (to six decimals) are counted first and drawn together, so a
    resample costs a row for each different value. A resample that takes
    nothing counts with the mean itself.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.round(F.col(value).cast("double") * 1_000_000).cast("long").alias("v")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("v")) / F.sum("c") / 1e6).alias("mean"))
    draws = counts.crossJoin(F.broadcast(df.sparkSession.range(iterations).withColumnRenamed("id", "b")))  # a fixed number of resamples
    w = resampled(F.col("c"), F.concat_ws(":", *by, "b", "v"), seed)
    means = draws.withColumn("w", w).groupBy(*by, "b").agg(F.try_divide(F.sum(F.col("w") * F.col("v")).cast("double"), F.sum("w").cast("double")).alias("m"))
    means = means.join(sizes, by) if by else means.crossJoin(sizes)
    ordered = means.groupBy(*by, "n", "mean").agg(F.array_sort(F.collect_list(F.coalesce(F.col("m") / 1e6, F.col("mean")))).alias("ms"))
    low, high = _percentiles("ms", iterations)
    return ordered.select(*by, "n", "mean", low.alias("low"), high.alias("high"))


def bootstrap_classes(cells: DataFrame, *, by: list[str], seeds: tuple[int, int] = (17, 19), iterations: int = BOOTSTRAP) -> DataFrame:
    """``by, accuracy_low, accuracy_high, macro_f1_low, macro_f1_high`` from resamples of a confusion table ``by, gold, pred, n``."""
    key = F.concat_ws(":", *by, "gold", "pred", "b")
    x = cells.crossJoin(F.broadcast(cells.sparkSession.range(iterations).withColumnRenamed("id", "b")))
    x = x.select(*by, "b", "gold", "pred", *(resampled(F.col("n"), key, seed).alias(w) for seed, w in zip(seeds, "st")))
    hit = F.col("gold") == F.col("pred")
    accuracy = x.groupBy(*by, "b").agg(ratio(F.sum(F.when(hit, F.col("s")).otherwise(0)), F.sum("s")).alias("a"))
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("t").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("t").alias("predicted")))).alias("x")
    labels = x.select(*by, "b", F.when(hit, F.col("t")).otherwise(0).alias("h"), sides).groupBy(*by, "b", "x.label").agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"), (F.sum("h") / 2).alias("hits"))
    f1 = labels.groupBy(*by, "b").agg(F.coalesce(F.avg(F.when(F.col("support") > 0, ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")))), F.lit(0.0)).alias("f"))
    both = accuracy.join(f1, [*by, "b"]).groupBy(*by).agg(F.array_sort(F.collect_list("a")).alias("as"), F.array_sort(F.collect_list("f")).alias("fs"))
    (al, ah), (fl, fh) = _percentiles("as", iterations), _percentiles("fs", iterations)
    return both.select(*by, al.alias("accuracy_low"), ah.alias("accuracy_high"), fl.alias("macro_f1_low"), fh.alias("macro_f1_high"))


def calibration(df: DataFrame, *, by: list[str], confidence: str, correct: Column) -> DataFrame:
    """Per confidence bin: n, mean confidence and accuracy; bins without rows are kept with zeros."""
    bins = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))], "bin int, lo double, hi double")
    which = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])):
        which = F.when((F.col(confidence) >= a) & (F.col(confidence) < b), i).otherwise(which)
    rows = df.withColumn("bin", which).where("bin IS NOT NULL")
    sums = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))
    grid = (df.select(*by).distinct().crossJoin(F.broadcast(bins))) if by else bins
    return grid.join(sums, [*by, "bin"], "left").fillna(0, ["n", "mean_confidence", "accuracy"])
