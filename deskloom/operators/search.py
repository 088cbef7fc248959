"""Exact top-k search of a stated query set against all rows, in packed blocks.

Queries and rows are packed into blocks of fixed size and written once. A task holds
one part of the queries and streams blocks of rows past it, so pairs of blocks are
never shuffled; what is shuffled is k rows per query and stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.runtime import cut

QUERY_BLOCK, ROW_BLOCK = 512, 4096
PLACES = 6
#: Products that are added up at a time; pairs of one term from which a matrix product is cheaper, by pairs of a query and a row; terms of it at most.
CHUNK, DENSE_SHARE, DENSE_TERMS = 300_000, 0.004, 512


def _pack(size: int, names: tuple[str, str, str, str], term: pa.DataType):
    """Rows ``doc, terms, weights`` to blocks: ids, offsets, terms, weights."""

    def block(part: pa.RecordBatch) -> pa.RecordBatch:
        terms, weights = part.column("terms"), part.column("weights")
        lengths = pc.fill_null(pc.list_value_length(terms), 0)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t)) for x, t in ((part.column("doc"), pa.string()), (lengths, pa.int32()), (pc.list_flatten(terms), term), (pc.list_flatten(weights), pa.float32()))], list(names))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                free = size - sum(x.num_rows for x in held)
                held.append(batch.slice(0, free))
                batch = batch.slice(free)
                if sum(x.num_rows for x in held) == size:
                    yield block(pa.concat_batches(held))
                    held = []
        if held:
            yield block(pa.concat_batches(held))

    return each


def _scores(q_of: np.ndarray, q_terms: np.ndarray, q_weights: np.ndarray, qs: int, d_of: np.ndarray, d_terms: np.ndarray, d_weights: np.ndarray, ds: int) -> np.ndarray:
    """Dot products of rows with queries, near to single precision: a matrix product for terms that many of both hold, for others each entry of a row meets the queries that hold its term."""
    known, at = np.unique(q_terms, return_inverse=True)
    if not len(known) or not len(d_terms):
        return np.zeros((ds, qs), np.float32)
    spot = np.searchsorted(known, d_terms).clip(max=len(known) - 1)
    hit = known[spot] == d_terms
    docs, spot, w = d_of[hit], spot[hit], d_weights[hit]
    return _products(np.bincount(at, minlength=len(known)), at, q_of, q_weights, qs, docs, spot, w, ds)


def _products(many: np.ndarray, at: np.ndarray, q_of: np.ndarray, q_weights: np.ndarray, qs: int, docs: np.ndarray, spot: np.ndarray, w: np.ndarray, ds: int) -> np.ndarray:
    met = many * np.bincount(spot, minlength=len(many))
    common = np.argsort(-met, kind="stable")[:DENSE_TERMS]
    common = common[met[common] > DENSE_SHARE * qs * ds]
    column = np.full(len(many), -1)
    column[common] = np.arange(len(common))
    left, right = np.zeros((ds, len(common)), np.float32), np.zeros((len(common), qs), np.float32)
    own, theirs = column[spot] >= 0, column[at] >= 0
    left[docs[own], column[spot[own]]] = w[own]
    right[column[at[theirs]], q_of[theirs]] = q_weights[theirs]
    scores = left @ right
    docs, spot, w = docs[~own], spot[~own], w[~own]
    if not len(docs):
        return scores
    order = np.argsort(at, kind="stable")
    of, weight = q_of[order], q_weights[order]
    first = np.cumsum(many) - many
    upto = np.cumsum(many[spot])
    flat = scores.ravel()
    for lo, hi in zip(*_runs(upto, CHUNK)):
        n = many[spot[lo:hi]]
        entry = np.repeat(first[spot[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        low, high = int(docs[lo]) * qs, (int(docs[hi - 1]) + 1) * qs
        flat[low:high] += np.bincount(np.repeat(docs[lo:hi] * qs - low, n) + of[entry], np.repeat(w[lo:hi], n) * weight[entry], minlength=high - low)
    return scores


def _runs(upto: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of entries whose running total is ``upto`` into runs of about ``size``."""
    ends = np.unique(np.append(np.searchsorted(upto, np.arange(size, int(upto[-1]) + 1, size), side="right"), len(upto)))
    ends = ends[ends > 0]
    return np.concatenate([[0], ends[:-1]]), ends


#: Candidates that are weighed again at a time.
TAKE = 4096


class _Nearest:
    """The ``k`` best rows of each query of a block, from the blocks of rows it has met."""

    def __init__(self, k: int, drop_self: bool, ids: pa.Array, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.k, self.drop_self, self.ids, self.qs = k, drop_self, ids, len(ids)
        self.of, self.weights = np.repeat(np.arange(self.qs), sizes), weights.astype(np.float64)
        self.known, self.at = np.unique(terms, return_inverse=True)
        self.many = np.bincount(self.at, minlength=len(self.known))
        self.table = np.zeros((self.qs, len(self.known)), np.float32)
        self.table[self.of, self.at] = weights
        self.length = np.sqrt(np.bincount(self.of, self.weights**2, minlength=self.qs))
        self.least = np.full(self.qs, -np.inf)
        self.best, self.new = None, []

    def meet(self, ids: pa.Array, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        if not len(self.known) or not len(terms):
            return
        spot = np.searchsorted(self.known, terms).clip(max=len(self.known) - 1)
        hit = self.known[spot] == terms
        of, spot, w = np.repeat(np.arange(len(ids)), sizes)[hit], spot[hit], weights[hit].astype(np.float64)
        near = _products(self.many, self.at, self.of, self.weights, self.qs, of, spot, w, len(ids))
        # how far single precision may be off, for the longest row
        off = 2.0**-22 * (DENSE_TERMS + 8) * self.length * np.sqrt(np.bincount(of, w * w, minlength=1).max())
        least = self.least - 10.0**-PLACES
        fresh, most = np.flatnonzero(np.isneginf(self.least)), self.k + self.drop_self
        if len(fresh) and len(ids) > most:
            least[fresh] = np.partition(near[:, fresh], len(ids) - most, axis=0)[len(ids) - most] - off[fresh] - 10.0**-PLACES
        doc, q = np.nonzero((near >= (least - off).astype(np.float32)) & (near != 0))
        self._take(ids, q, doc, of, spot, w)

    def _take(self, ids: pa.Array, q: np.ndarray, doc: np.ndarray, of: np.ndarray, spot: np.ndarray, w: np.ndarray) -> None:
        """Candidates with their products in double precision."""
        n = np.bincount(of, minlength=len(ids))
        first = np.cumsum(n) - n
        for at in range(0, len(q), TAKE):
            qq, dd = q[at : at + (TAKE)], doc[at : at + (TAKE)]
            m = n[dd]
            entry = np.repeat(first[dd] - np.cumsum(m) + m, m) + np.arange(m.sum())
            pair = np.repeat(np.arange(len(dd)), m)
            score = np.bincount(pair, self.table[qq[pair], spot[entry]] * w[entry], minlength=len(dd))
            good = (score > 0) & (np.round(score, PLACES) >= self.least[qq])
            docs = ids.take(pa.array(dd[good]))
            x = pa.table({"q": qq[good], "key": -np.round(score[good], PLACES), "doc": docs, "score": score[good]})
            if self.drop_self:
                x = x.filter(pc.fill_null(pc.not_equal(docs, self.ids.take(x.column("q").combine_chunks())), True))
            self.new.append(x)
        waiting = sum(x.num_rows for x in self.new)
        if waiting >= self.qs * self.k or waiting and np.isneginf(self.least).any():
            self._settle()

    def _settle(self) -> None:
        x = pa.concat_tables([self.best, *self.new] if self.best is not None else self.new).combine_chunks() if self.new else self.best
        self.new = []
        if x is None:
            return
        x = x.take(pc.sort_indices(x, [("q", "ascending"), ("key", "ascending"), ("doc", "ascending")]))
        q = x.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        x, last = x.filter(pa.array(place < self.k)), place == self.k - 1
        self.least[q[last]] = -x.column("key").to_numpy()[np.flatnonzero(last[place < self.k])]
        self.best = x.combine_chunks()

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        if self.best is not None and self.best.num_rows:
            x = self.best
            yield pa.RecordBatch.from_arrays([self.ids.take(x.column("q").combine_chunks()), x.column("doc").combine_chunks(), x.column("score").combine_chunks()], ["q", "doc", "score"])


def _multiply(k: int, drop_self: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Nearest] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = {n: batch.column(n)[i] for n in batch.schema.names}
                sides = {s: [part[f"{s}_ids"].values, *(part[f"{s}_{n}"].values.to_numpy(zero_copy_only=False) for n in ("sizes", "terms", "weights"))] for s in "qd"}
                block = part["q_block"].as_py()
                if block not in held:
                    held[block] = _Nearest(k, drop_self, *sides["q"])
                held[block].meet(*sides["d"])
        for x in held.values():
            yield from x.rows()

    return each


def _blocks(rows: DataFrame, size: int, side: str) -> DataFrame:
    names = (f"{side}_ids", f"{side}_sizes", f"{side}_terms", f"{side}_weights")
    kind = rows.schema["terms"].dataType.elementType.simpleString()
    return rows.mapInArrow(_pack(size, names, pa.int32() if kind == "int" else pa.int64()), f"{names[0]} array<string>, {names[1]} array<int>, {names[2]} array<{kind}>, {names[3]} array<float>")


def vectors(long: DataFrame) -> DataFrame:
    """``doc, terms, weights`` from long ``doc, term, w``; terms become 64-bit hashes. Rows that are vectors stay as they are."""
    if "terms" in long.columns:
        return long
    x = long.groupBy(F.col("doc").cast("string").alias("doc")).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("float").alias("w"))).alias("x"))
    return x.select("doc", F.col("x.t").alias("terms"), F.col("x.w").alias("weights"))


def top_k(queries: DataFrame, rows: DataFrame, k: int, *, drop_self: bool = False, allow: DataFrame | None = None) -> DataFrame:
    """``q, doc, score, rank``: the ``k`` rows with the largest positive dot product per query.

    Both sides are ``doc, terms, weights``. Scores equal to six decimals are
    ordered by ``doc``; a query that shares no term with any row has no result.
    Only rows whose ``doc`` is in ``allow`` count, where it is given.
    """
    if allow is not None:
        rows = rows.join(allow.select(F.col("doc").cast("string").alias("doc")), "doc", "left_semi")
    q = cut(_blocks(queries, QUERY_BLOCK, "q")).withColumn("q_block", F.monotonically_increasing_id())
    d = cut(_blocks(rows, ROW_BLOCK, "d"))
    asked = q.agg(F.sum(F.size("q_ids"))).first()[0] or 0
    parts = max(1, min(-(-asked // QUERY_BLOCK), q.rdd.getNumPartitions()))
    streams = max(1, -(-4 * d.sparkSession.sparkContext.defaultParallelism // parts))
    # a Cartesian product reads both sides where they are; a task streams rows past its queries
    pairs = d.coalesce(streams).hint("shuffle_replicate_nl").crossJoin(q.coalesce(parts))
    near = pairs.mapInArrow(_multiply(k, drop_self), "q string, doc string, score double")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", PLACES)), "doc")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
