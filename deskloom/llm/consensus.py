"""Problem 6: one label per item from several raters who disagree.

Community confusion model. Every rater belongs to one of a few types with a shared
confusion matrix; a rater's own matrix is drawn around its type's. Variational
updates alternate between the labels of items, the raters' counts, their types and
the types' matrices. A rater with few labels stays close to its type, a rater with
many goes its own way.

Two passes of one drafting procedure are no independent witnesses: they repeat each
other's errors. Labels with the same ``link`` on an item make one statement where
they agree, and statements of raters of another kind where they don't, so that the
data say how much such an agreement is worth.

Labels stay in long form, so neither an item with many labels nor a rater with
many items meets one task; the driver only holds the types' matrices, whose size is
fixed by the taxonomy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.runtime import cut

# --- fixed values -----------------------------------------------------------
#: The intents of the taxonomy, in alphabetical order, since ties go to the first.
INTENTS = sorted("flight_disruption baggage booking_change refund_compensation loyalty_program digital_issue service_complaint contact_support general_inquiry praise other".split())
# ---------------------------------------------------------------------------
#: Chance of a right label that each type starts from, the weight of that start, and of the type in a rater's matrix.
TYPES, TYPE_WEIGHT, SHRINK = (0.95, 0.8, 0.6, 0.3), 30.0, 12.0
ROUNDS, SETTLED = 12, 1e-3
LEAST_RATERS = 3

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(6):
        shift -= 1 / x
        x += 1
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def usable(label: Column) -> Column:
    """An intent of the taxonomy in its one spelling, else null."""
    x = F.regexp_replace(F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s-]+", "_")
    return F.when(x.isin(INTENTS), x)


def collect_labels(golden: DataFrame, audits: DataFrame) -> DataFrame:
    """``item, rater, label, link``: each rater's latest usable label of each golden item; the two passes are linked.

    Passes come first, then the human and the gold label, then audits by time
    and number. A pass without a named rater counts as a rater of its own;
    other labels without a rater, unusable labels and labels of items outside
    ``golden`` are ignored.
    """
    sources = [("pass_a_intent", "pass_a_by", "pass_a"), ("pass_b_intent", "pass_b_by", "pass_b"), ("human_intent", "human_by", None), ("gold_intent", "gold_by", None)]
    given = F.array(*(F.struct(F.coalesce(F.col(by), F.lit(own)).alias("rater"), usable(F.col(c)).alias("label"), F.lit(i).alias("step"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("nr")) for i, (c, by, own) in enumerate(sources)))
    rows = golden.select(F.col("episode_id").alias("item"), F.explode(given).alias("x")).select("item", "x.*")
    items = golden.select(F.col("episode_id").alias("item")).distinct()
    later = audits.select(F.col("episode_id").alias("item"), F.col("annotator_id").alias("rater"), usable(F.col("intent")).alias("label"), F.lit(len(sources)).alias("step"), F.col("labelled_at").cast("timestamp").alias("at"), F.coalesce(F.col("audit_id").cast("long"), F.lit(-1)).alias("nr"))
    rows = rows.union(later.join(items, "item", "left_semi")).where("item IS NOT NULL AND rater IS NOT NULL AND label IS NOT NULL")
    last = F.max(F.struct("step", F.coalesce("at", F.lit("0001-01-01").cast("timestamp")), "nr", "label"))
    return rows.groupBy("item", "rater").agg(last.alias("x")).select("item", "rater", F.col("x.label").alias("label"), F.when(F.col("x.step") < 2, "passes").alias("link"))


def _statements(labels: DataFrame) -> DataFrame:
    """``item, rater, code`` of independent statements; linked labels of an item are a handful by construction."""
    free = labels.where("link IS NULL").select("item", "rater", "code")
    groups = labels.where("link IS NOT NULL").groupBy("item", "link").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count("*").alias("n"), F.collect_list(F.struct("rater", "code")).alias("each"))
    agreed = groups.where("n > 1 AND lo = hi").select("item", F.concat("link", F.lit("|same")).alias("rater"), F.col("lo").alias("code"))
    apart = groups.where("n = 1 OR lo <> hi").select("item", F.explode("each").alias("x"), F.when(F.col("n") > 1, "|apart").otherwise("|alone").alias("how"))
    return free.union(agreed).union(apart.select("item", F.concat("x.rater", "how"), "x.code"))


def _raters(types: np.ndarray, weights: np.ndarray, size: int):
    """For batches of raters with what they said: counts by true class and label, types, expected log confusion and matrix."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            said = batch.column("said")
            flat = pc.list_flatten(said)
            owner = pc.list_parent_indices(said).to_numpy(zero_copy_only=False)
            counts = np.zeros((batch.num_rows, size, size))
            counts[owner, :, flat.field("code").to_numpy(zero_copy_only=False)] = pc.list_flatten(flat.field("qs")).to_numpy(zero_copy_only=False).reshape(-1, size)
            n = counts[:, None]
            prior = SHRINK * types[None]
            fit = (_lgamma(prior.sum(3)) - _lgamma((prior + n).sum(3)) + (_lgamma(prior + n) - _lgamma(prior)).sum(3)).sum(2) + np.log(weights)[None]
            q = np.exp(fit - fit.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            own = counts + np.einsum("rm,mkl->rkl", q, SHRINK * types)
            log = _digamma(own) - _digamma(own.sum(2, keepdims=True))
            mean = own / own.sum(2, keepdims=True)
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rater"), batch.column("labels"), *(pa.array(list(x.reshape(rows, -1)), pa.list_(pa.float64())) for x in (counts, q, log, mean))], ["rater", "labels", "counts", "types", "logs", "matrix"]
            )

    return each


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: counts summed by type of rater, sizes of types and all counts, in one array of fixed size."""
    total = None
    for batch in batches:
        if batch.num_rows:
            counts, q = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("counts", "types"))
            part = np.concatenate([(q.T @ counts).ravel(), q.sum(0), counts.sum(0)])
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["part"])


def _counts(weighted: DataFrame, size: int) -> DataFrame:
    """``rater, labels, said``: per label the rater used, the expected number of uses for each true class."""
    by_label = weighted.groupBy("rater", "code").agg(F.count("*").alias("n"), *(F.sum(F.col("q")[k]).alias(f"q{k}") for k in range(size)))
    return by_label.groupBy("rater").agg(F.sum("n").alias("labels"), F.collect_list(F.struct("code", F.array(*(f"q{k}" for k in range(size))).alias("qs"))).alias("said"))


def consensus(labels: DataFrame, *, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``(items, raters)`` from ``item, rater, label, link`` rows, one for each item and rater.

    items: ``item, intent, confidence, labels, agreement, pair_agreement`` with
    the share of labels that agree with the consensus and of agreeing pairs of
    labels (null for a single label). raters: ``rater, labels, reliability,
    type, type_share, last_move``, the last being how far the types' matrices
    moved in the last round (all rounds were needed where it is ``SETTLED`` or
    more). Ties go to the first intent in alphabetical order.
    """
    size = len(INTENTS)
    codes = labels.withColumn("code", F.array_position(F.array(*map(F.lit, INTENTS)), F.col("label")).cast("int") - 1)
    codes = cut(codes.select("item", "rater", "code", "link"))
    stated = cut(_statements(codes))
    votes = codes.groupBy("item").agg(F.count("*").alias("n"), *(F.count_if(F.col("code") == k).alias(f"v{k}") for k in range(size)))
    posterior = votes.select("item", F.array(*(F.col(f"v{k}") / F.col("n") for k in range(size))).alias("q"))
    types = np.stack([np.full((size, size), (1 - p) / (size - 1)) + np.eye(size) * (p - (1 - p) / (size - 1)) for p in TYPES])
    start, weights = types.copy(), np.full(len(TYPES), 1 / len(TYPES))
    kind = "rater string, labels long, counts array<double>, types array<double>, logs array<double>, matrix array<double>"
    moved = 0.0
    for _ in range(rounds):
        weighted = stated.join(posterior, "item")
        raters = cut(_counts(weighted, size).mapInArrow(_raters(types, weights, size), kind))
        # sums over raters, as many numbers as the types' matrices have
        sums_ = raters.select("counts", "types").mapInArrow(_sums, "part array<double>").select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        if not sums_.num_rows:
            break
        flat = np.zeros(sums_.num_rows)
        flat[sums_.column("at").to_numpy()] = sums_.column("x").to_numpy()
        cells = len(TYPES) * size * size
        sums, sizes, every = flat[:cells].reshape(len(TYPES), size, size), flat[cells : cells + len(TYPES)], flat[cells + len(TYPES) :]
        new = TYPE_WEIGHT * start + sums
        new /= new.sum(2, keepdims=True)
        moved = float(np.abs(new - types).max())
        types, weights = new, (sizes + 1) / (sizes.sum() + len(TYPES))
        shares = every.reshape(size, size).sum(1) + 1
        logs = np.log(shares / shares.sum())
        # a label needs one row of its rater's matrix only
        spread = raters.select("rater", F.posexplode(F.array(*(F.array(*(F.col("logs")[k * size + c] for k in range(size))) for c in range(size)))).alias("code", "told"))
        scores = stated.join(spread, ["rater", "code"]).groupBy("item").agg(*(F.sum(F.col("told")[k]).alias(f"s{k}") for k in range(size)))
        raw = [F.col(f"s{k}") + float(logs[k]) for k in range(size)]
        top = F.greatest(*raw)
        powers = F.array(*(F.exp(x - top) for x in raw))
        posterior = cut(scores.select("item", powers.alias("p")).select("item", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, y: a + y)).alias("q")))
        if moved < SETTLED:
            break
    best = F.array_position(F.transform("q", lambda x: F.round(x, 9)), F.round(F.array_max("q"), 9)).cast("int")
    chosen = posterior.join(votes, "item")
    own = F.element_at(F.array(*(F.col(f"v{k}") for k in range(size))), best)
    pairs = sum((F.col(f"v{k}") * (F.col(f"v{k}") - 1) for k in range(size)), F.lit(0))
    items = chosen.select(
        "item",
        F.element_at(F.array(*map(F.lit, INTENTS)), best).alias("intent"),
        F.array_max("q").alias("confidence"),
        F.col("n").alias("labels"),
        (own / F.col("n")).alias("agreement"),
        F.when(F.col("n") > 1, pairs / (F.col("n") * (F.col("n") - 1))).alias("pair_agreement"),
    )
    raters = _counts(codes.join(posterior, "item"), size).mapInArrow(_raters(types, weights, size), kind)
    seen = [sum((F.col("counts")[k * size + c] for c in range(size)), F.lit(0.0)) for k in range(size)]
    right = sum((seen[k] * F.col("matrix")[k * size + k] for k in range(size)), F.lit(0.0)) / sum(seen, F.lit(0.0))
    top_type = F.array_position("types", F.array_max("types")).cast("int")
    return items, raters.select("rater", "labels", right.alias("reliability"), top_type.alias("type"), F.array_max("types").alias("type_share"), F.lit(moved).alias("last_move"))
