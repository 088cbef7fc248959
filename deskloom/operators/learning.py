"""Spherical k-means and softmax regression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.runtime import cut

# ---- dense spherical k-means: centroids have a fixed size, k x dimension ----


def _dense(column: pa.Array) -> np.ndarray:
    """A batch of vectors of one length as a matrix, without a Python object for each number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def assign(df: DataFrame, centroids: np.ndarray, *, doc: str, vector: str) -> DataFrame:
    """``doc, cluster, similarity``: the nearest centroid by cosine, the first among equals; a zero vector goes to 0."""
    c = _unit(np.asarray(centroids, float))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_dense(batch.column("v")))
                sims = x @ c.T
                best = np.round(sims, 9).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(best, pa.int32()), pa.array(sims[np.arange(len(best)), best])], ["doc", "cluster", "similarity"])

    return df.where(F.col(vector).isNotNull()).select(F.col(doc).alias("doc"), F.col(vector).alias("v")).mapInArrow(each, f"doc {df.schema[doc].dataType.simpleString()}, cluster int, similarity double")


def update(df: DataFrame, labels: DataFrame, *, doc: str, vector: str) -> DataFrame:
    """``cluster, dim, value, size``: unit-length mean direction of every cluster that has members."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = df.select(F.col(doc).alias("doc"), F.posexplode(vector).alias("dim", "x"), length.alias("len")).where("len > 0")
    sums = rows.join(labels.select("doc", "cluster"), "doc").groupBy("cluster", "dim").agg(F.sum(F.col("x") / F.col("len")).alias("s"), F.count("*").alias("size"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("cluster")))
    return sums.select("cluster", "dim", F.coalesce(F.try_divide(F.col("s"), norm), F.lit(0.0)).alias("value"), "size")


def _draws(seed: int, docs: pa.Array) -> np.ndarray:
    """One number in (0, 1) per key, from MD5."""
    return np.array([(int(hashlib.md5(f"{d}|{seed}".encode()).hexdigest()[:8], 16) + 1) / (2**32 + 2) for d in docs.to_pylist()])


def seed_centroids(rows: DataFrame, k: int, *, seed: int) -> np.ndarray:
    """k-means++ on the cosine from ``doc, v``: each further centroid is drawn with the weight of its squared distance to the nearest.

    A draw is the largest ``log(u) / weight`` over all rows; every task offers its best row.
    """
    chosen: list[np.ndarray] = []
    while len(chosen) < k:
        have = _unit(np.array(chosen)) if chosen else None
        step = seed + len(chosen)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _unit(_dense(batch.column("v")))
                gap = np.ones(len(x)) if have is None else (1 - (x @ have.T).max(1)) ** 2
                gap[np.abs(x).sum(1) == 0] = 0
                key = np.where(gap > 1e-12, np.log(_draws(step, batch.column("doc"))) / np.maximum(gap, 1e-12), -np.inf)
                at = int(key.argmax())
                if np.isfinite(key[at]):
                    yield pa.RecordBatch.from_arrays([pa.array([key[at]]), batch.column("v").slice(at, 1).cast(pa.list_(pa.float64()))], ["key", "v"])

        top = rows.mapInArrow(best, "key double, v array<double>").orderBy(F.desc("key"), "v").limit(1).collect()
        if not top:
            break
        chosen.append(np.array(top[0]["v"], float))
    return np.array(chosen)


#: Centroids that move less are made from the same labels.
STILL = 1e-9


def kmeans(df: DataFrame, k: int, *, doc: str, vector: str, seed: int = 42, max_iter: int = 40, start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """``(labels, centroids)``; stops when no label changes, an empty cluster keeps its centroid.

    A round is one pass over the rows, in which a task adds up the members of
    each cluster. Where no label changes, no centroid moves. ``start`` gives
    the first centroids, else they are drawn by :func:`seed_centroids`.
    """
    rows = cut(df.where(F.col(vector).isNotNull()).select(F.col(doc).alias("doc"), F.col(vector).alias("v")))
    centroids = _unit(seed_centroids(rows, k, seed=seed) if start is None else np.asarray(start, float))
    if not len(centroids):
        return rows.select("doc", F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity")), centroids
    before: np.ndarray | None = None
    for _ in range(max_iter):

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, size = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _unit(_dense(batch.column("v")))
                    label = np.round(x @ now.T, 9).argmax(1)
                    total += np.eye(len(now))[:, label] @ x
                    size += np.bincount(label, minlength=len(now))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array(size)], ["cluster", "total", "size"])

        dim = centroids.shape[1]
        parts = rows.mapInArrow(sums, "cluster int, total array<double>, size long").groupBy("cluster").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total"), F.sum("size").alias("size")).collect()  # k rows
        before, centroids = centroids, centroids.copy()
        for r in parts:
            if r["size"] and any(r["total"]):
                centroids[r["cluster"]] = _unit(np.array([r["total"]]))[0]
        if np.abs(centroids - before).max() < STILL:
            break
    # the labels that the last centroids were made from, or that no longer change
    return assign(rows, centroids if before is None else before, doc="doc", vector="v") if max_iter else rows.select("doc", F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity")), centroids


# ---- sparse spherical k-means: centroids are k x vocabulary, bounded by the vocabulary's cap ----


def sparse_rows(weights: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc, at, w`` from long ``doc, term, w`` and ``term, term_id``."""
    x = weights.join(ids.select("term", "term_id"), "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("i"), F.col("w").cast("float").alias("w")))).alias("x"))
    return x.select("doc", F.col("x.i").alias("at"), F.col("x.w").alias("w"))


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, w = batch.column("at"), batch.column("w")
    sizes = pa.compute.list_value_length(at).to_numpy(zero_copy_only=False)
    return pa.compute.list_flatten(at).to_numpy(zero_copy_only=False), pa.compute.list_flatten(w).to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(sizes)), sizes)


def _similar(batch: pa.RecordBatch, centroids: np.ndarray) -> np.ndarray:
    """Dot products of every row with every centroid."""
    at, w, row = _sparse(batch)
    out = np.zeros((batch.num_rows, len(centroids)))
    for k, c in enumerate(centroids):
        out[:, k] = np.bincount(row, c[at] * w, minlength=batch.num_rows)
    return out


def sparse_kmeans(rows: DataFrame, k: int, size: int, *, seed: int = 42, max_iter: int = 40) -> tuple[DataFrame, np.ndarray]:
    """``(labels, centroids)`` of ``doc, at, w`` rows over ``size`` terms; the same rounds as :func:`kmeans`."""
    rows = cut(rows)
    chosen: list[np.ndarray] = []
    while len(chosen) < k:
        have, step = np.array(chosen), seed + len(chosen)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                gap = (1 - _similar(batch, have).max(1)) ** 2 if len(have) else np.ones(batch.num_rows)
                key = np.where(gap > 1e-9, np.log(_draws(step, batch.column("doc"))) / np.maximum(gap, 1e-9), -np.inf)
                i = int(key.argmax())
                if np.isfinite(key[i]):
                    yield pa.RecordBatch.from_arrays([pa.array([key[i]]), batch.column("at").slice(i, 1), batch.column("w").slice(i, 1)], ["key", "at", "w"])

        top = rows.mapInArrow(best, "key double, at array<int>, w array<float>").orderBy(F.desc("key"), "at").limit(1).collect()
        if not top:
            break
        c = np.zeros(size)
        c[top[0]["at"]] = top[0]["w"]
        chosen.append(c)
    if not chosen:
        return rows.select("doc", F.lit(0).alias("cluster")), np.zeros((0, size))
    centroids, before = _unit(np.array(chosen)), None
    for _ in range(max_iter):

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for batch in batches:
                if batch.num_rows:
                    label = np.round(_similar(batch, now), 9).argmax(1)
                    at, w, row = _sparse(batch)
                    np.add.at(total, (label[row], at), w)
            some = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), pa.array(some[1], pa.int32()), pa.array(total[some])], ["cluster", "term_id", "s"])

        parts = rows.mapInArrow(sums, "cluster int, term_id int, s double").groupBy("cluster", "term_id").agg(F.sum("s").alias("s")).toArrow()  # at most k x size
        new = np.zeros_like(centroids)
        new[parts.column("cluster").to_numpy(), parts.column("term_id").to_numpy()] = parts.column("s").to_numpy()
        filled = np.abs(new).sum(1) > 0
        before, centroids = centroids, np.where(filled[:, None], _unit(new), centroids)
        if np.abs(centroids - before).max() < STILL:
            break
    last = centroids if before is None else before

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.round(_similar(batch, last), 9).argmax(1), pa.int32())], ["doc", "cluster"])

    return rows.mapInArrow(label, f"doc {rows.schema['doc'].dataType.simpleString()}, cluster int"), centroids


def top_terms(weights: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """``cluster, term, weight, rank``: the ``n`` heaviest positive terms of each centroid of sparse ``doc, term, w`` rows."""
    sums = weights.join(labels.select("doc", "cluster"), "doc").groupBy("cluster", "term").agg(F.sum(F.col("w").cast("double")).alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("cluster")))
    x = sums.select("cluster", "term", (F.col("s") / norm).alias("weight")).where("weight > 0")
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("weight", 6)), "term")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ---- softmax regression by stochastic gradient, some folds' models in step ----

EPOCHS, RATE, L2 = 250, 0.5, 1e-4
#: Models that a task trains in step.
IN_STEP = 3


def fit_softmax(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int, classes: int, *, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases; the rate falls as ``rate / (1 + 0.01 epoch)``, weights shrink once per epoch."""
    w, b = fit_in_step(rows, labels, [np.arange(len(rows))], dim, np.zeros((1, classes)), epochs=epochs, rate=rate, l2=l2, seed=seed)
    return w[0], b[0]


def fit_in_step(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, members: list[np.ndarray], dim: int, start: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A model for each of ``members``, places in ``rows``, from the biases ``start``.

    Every model meets its rows one by one in its own order, as if it were alone;
    only the arithmetic of one step is done for all of them at once.
    """
    n, models, classes = len(rows), len(members), start.shape[1]
    width = int(np.ceil(np.quantile([len(a) for a, _ in rows], 0.98))) if n else 0
    # rows of one width; a missing entry has weight 0 in a row of its own, and row n stands for none
    at, x, is_label = np.full((n + 1, width), dim, np.int64), np.zeros((n + 1, width)), np.zeros((n + 1, classes))
    for i, (a, v) in enumerate(rows):
        at[i, : min(width, len(a))], x[i, : min(width, len(a))] = a[:width], v[:width]
    is_label[np.arange(n), labels] = 1
    rest = {i: (a[width:], v[width:]) for i, (a, v) in enumerate(rows) if len(a) > width}
    longer = np.zeros(n + 1, bool)
    longer[list(rest)] = True
    w, b, own = np.zeros((models * (dim + 1), classes)), start.astype(float), np.arange(models)[:, None] * (dim + 1)
    draws, orders = [np.random.default_rng(seed) for _ in members], [np.arange(len(m)) for m in members]
    most, least = max(map(len, members), default=0), min(map(len, members), default=0)
    for epoch in range(epochs):
        step = rate / (1 + 0.01 * epoch)
        turns = np.full((most, models), n)
        for k, (draw, order) in enumerate(zip(draws, orders)):
            draw.shuffle(order)
            turns[: len(order), k] = members[k][order]
        late = set(np.flatnonzero(longer[turns].any(1)).tolist())
        for t in range(most):
            some = turns[t]
            spot = at.take(some, axis=0)
            spot += own
            v = x.take(some, axis=0)
            held = w.take(spot, axis=0)
            p = np.matmul(v[:, None, :], held)[:, 0]
            p += b
            more = []
            if t in late:
                for k, i in enumerate(some.tolist()):
                    if i in rest:
                        more.append((k, rest[i][0] + k * (dim + 1), rest[i][1]))
                        p[k] += rest[i][1] @ w[more[-1][1]]
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(1, keepdims=True)
            p -= is_label.take(some, axis=0)
            p *= step
            if t >= least:
                p *= (some < n)[:, None]
            held -= v[:, :, None] * p[:, None, :]
            w[spot] = held
            for k, places, values in more:
                w[places] -= np.outer(values, p[k])
            b -= p
        w *= 1 - step * l2
    return w.reshape(models, dim + 1, classes)[:, :dim], b


def out_of_fold(docs: DataFrame, vectors: DataFrame, *, n_folds: int = 5, epochs: int = EPOCHS) -> DataFrame:
    """``doc, fold, label, predicted, probability`` from models that never saw the document.

    ``docs`` is ``doc, label, fold``; ``vectors`` is ``doc, terms, weights``. A
    fold's model is fitted on all labelled rows of the other folds, one after
    the other, so a task holds them all; every document is predicted, blocks of
    them in parallel.
    """
    x = docs.join(vectors, "doc", "left")
    x = x.withColumn("terms", F.coalesce("terms", F.array().cast("array<bigint>"))).withColumn("weights", F.coalesce("weights", F.array().cast("array<float>")))
    x = cut(x.select(F.col("doc").cast("string").alias("doc"), F.col("fold").cast("int").alias("fold"), "label", F.col("terms").cast("array<bigint>").alias("terms"), "weights"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [x for x in batches if x.num_rows]
        if not every:
            return
        every = pa.Table.from_batches(every).sort_by("doc")
        for first in pc.unique(every.column("first")).to_pylist():
            rows = every.filter(pc.equal(every.column("first"), first)).combine_chunks()
            fold, label = rows.column("fold").to_numpy(), rows.column("label").to_pylist()
            terms, weights = rows.column("terms").combine_chunks(), rows.column("weights").combine_chunks()
            known, at = np.unique(pc.list_flatten(terms).to_numpy(), return_inverse=True)
            cuts = np.cumsum(pc.list_value_length(terms).to_numpy())[:-1]
            sparse = list(zip(np.split(at, cuts), np.split(pc.list_flatten(weights).to_numpy().astype(float), cuts)))
            names = sorted(set(label))
            y = np.array([names.index(v) for v in label])
            models = [m for m in range(first, min(n_folds, first + IN_STEP)) if (fold != m).any()]
            members = [np.flatnonzero(fold != m) for m in models]
            # a label that a model never saw it can't give
            start = np.array([np.where(np.bincount(y[m], minlength=len(names)) > 0, 0.0, -np.inf) for m in members]).reshape(len(models), len(names))
            w, b = fit_in_step(sparse, y, members, len(known), start, epochs=epochs)
            for k, m in enumerate(models):
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([names]), pa.array([known.tolist()], pa.list_(pa.int64())), pa.array([w[k].ravel()]), pa.array([b[k]])], ["model", "names", "known", "w", "b"])

    firsts = list(range(0, n_folds, IN_STEP))
    train = x.withColumn("first", F.explode(F.array(*map(F.lit, firsts)))).repartitionByRange(len(firsts), "first")
    models = cut(train.mapInArrow(fit, "model int, names array<string>, known array<bigint>, w array<double>, b array<double>"))
    told = {r["model"]: (r["names"], np.array(r["known"], np.int64), np.array(r["w"]).reshape(-1, len(r["names"])), np.array(r["b"])) for r in models.collect()}  # n_folds models of bounded size

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess, sure = [], []
            for fold, terms, weights in zip(*(batch.column(c).to_pylist() for c in ("fold", "terms", "weights"))):
                if fold not in told:
                    guess.append(None)
                    sure.append(None)
                    continue
                names, known, w, b = told[fold]
                t = np.asarray(terms, np.int64)
                spot = np.searchsorted(known, t).clip(max=max(0, len(known) - 1))
                hit = known[spot] == t if len(known) else np.zeros(len(t), bool)
                z = np.asarray(weights, float)[hit] @ w[spot[hit]] + b
                p = np.exp(z - z.max())
                p /= p.sum()
                guess.append(names[int(p.argmax())])
                sure.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("fold"), batch.column("label"), pa.array(guess, pa.string()), pa.array(sure, pa.float64())], ["doc", "fold", "label", "predicted", "probability"])

    return x.mapInArrow(predict, "doc string, fold int, label string, predicted string, probability double")


def softmax_scores(vectors: DataFrame, model: DataFrame, bias: DataFrame) -> DataFrame:
    """``doc, label, p`` from long ``doc, term, w``, weights ``label, term, weight`` and ``label, bias``."""
    docs = vectors.select("doc").distinct().crossJoin(F.broadcast(bias))  # a class list of fixed size
    z = vectors.join(model, "term").groupBy("doc", "label").agg(F.sum(F.col("w").cast("double") * F.col("weight")).alias("x"))
    z = docs.join(z, ["doc", "label"], "left").select("doc", "label", (F.coalesce("x", F.lit(0.0)) + F.col("bias")).alias("z"))
    over = Window.partitionBy("doc")
    e = F.exp(F.col("z") - F.max("z").over(over))
    return z.withColumn("e", e).select("doc", "label", (F.col("e") / F.sum("e").over(over)).alias("p"))
