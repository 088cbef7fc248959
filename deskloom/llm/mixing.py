"""Problem 9: mixing sources to target weights by Pfair scheduling.

Every source is a task whose weight is its target share; its i-th block of tokens
is released at floor(i / w) and due at ceil((i + 1) / w) slots. Earliest deadline
first over released blocks keeps each source within one block of its share at every
point of the mix. Weights are fractions of a common period, so one period is
scheduled, a table of fixed size, and block i of a source gets its slot by
arithmetic on it; nothing is sequential in the data.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.runtime import SMALL, cut, small

BLOCK_TOKENS = 1024
#: Records of one run of the prefix sums.
RUN_RECORDS = 50_000
#: A share below one slot of the longest period is interleaved as one slot; its tokens are those of its share all the same.
PERIODS = (100, 1000, 10_000)


def weights_of(shares: dict[str, float]) -> tuple[dict[str, int], int]:
    """Whole numbers of slots per period for shares that sum to 1, by largest remainders where no period is exact."""
    period = next((p for p in PERIODS if all(abs(s * p - round(s * p)) < 1e-6 and round(s * p) > 0 for s in shares.values())), PERIODS[-1])
    exact = {k: s * period for k, s in shares.items()}
    slots = {k: max(1, math.floor(x + 1e-9)) for k, x in exact.items()}
    by_rest = sorted(exact, key=lambda k: (slots[k] - exact[k], k))
    i = 0
    while sum(slots.values()) != period:
        step = 1 if sum(slots.values()) < period else -1
        k = by_rest[i % len(by_rest)] if step > 0 else max(slots, key=lambda x: (slots[x] - exact[x], x))
        slots[k] += step
        i += 1
    return slots, period


def schedule(slots: dict[str, int], period: int) -> dict[str, list[int]]:
    """Slots of each source in one period: earliest deadline first over released blocks."""
    out: dict[str, list[int]] = {k: [] for k in slots}
    releases = sorted((i * period // n, -(-(i + 1) * period // n), k) for k, n in slots.items() for i in range(n))
    ready: list[tuple[int, str]] = []
    at = 0
    for t in range(period):
        while at < len(releases) and releases[at][0] <= t:
            heapq.heappush(ready, releases[at][1:])
            at += 1
        out[heapq.heappop(ready)[1]].append(t)
    return out


def plan_mix(sizes: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, dict[str, float]]:
    """``(total, shares)``: the most tokens at which every source can reach its share, and the shares.

    A source without tokens can't have a share; the others' shares grow in
    proportion. ``total`` asks for less.
    """
    able = {k: s for k, (s, repeats) in targets.items() if s > 0 and repeats > 0 and sizes.get(k, (0, 0))[0] > 0}
    whole = sum(able.values())
    shares = {k: s / whole for k, s in able.items()}
    most = min((sizes[k][0] * targets[k][1] / s for k, s in shares.items()), default=0.0)
    return (most if total is None else min(total, most)), shares


def mix(records: DataFrame, targets: DataFrame, *, key: str, source: str, size: str, block_tokens: int = BLOCK_TOKENS, total: float | None = None, seed: int = 0) -> DataFrame:
    """``slot, source, start, <key>, pass_no, tokens`` in the order ``slot, start``.

    ``targets`` is a handful of rows ``source, target_share, max_repeats``.
    Every source gives its share of the largest total all can reach, in a random
    order of its records that differs by pass; no record is used more than
    ``max_repeats`` times. What whole records in that order leave of a share
    goes to the one record that fills it best, if that comes nearer. Records without tokens, key or target are unused.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").collect()}
    rows = cut(records.where(F.col(key).isNotNull() & (F.col(size) > 0) & F.col(source).isin(list(wanted))).select(F.col(key).alias("item"), F.col(source).alias("source"), F.col(size).cast("long").alias("tokens")))
    sizes = {r["source"]: (r["tokens"], r["n"]) for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    total, shares = plan_mix(sizes, wanted, total)
    kind = rows.schema["item"].dataType.simpleString()
    spark = rows.sparkSession
    empty = f"slot long, source string, start long, `{key}` {kind}, pass_no int, tokens long"
    if not shares:
        return spark.createDataFrame([], empty)
    slots, period = weights_of(shares)
    table = schedule(slots, period)
    # the shares that slots give, to the token
    need = {k: int(total * shares[k]) for k in shares}
    passes = {k: min(wanted[k][1], -(-need[k] // sizes[k][0])) for k in shares}
    plan = spark.createDataFrame([(k, need[k], passes[k], slots[k], max(1, sizes[k][1] // RUN_RECORDS)) for k in shares], "source string, need long, passes int, per_period long, runs long")
    if len(shares) > SMALL:
        raise ValueError(f"a mix has at most {SMALL} sources, this one {len(shares)}")
    # plan, and what is grouped by its sources, has a row for each source
    x = rows.join(F.broadcast(plan), "source")
    x = x.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    x = x.withColumn("draw", F.xxhash64("item", "pass_no", F.lit(seed))).withColumn("run", F.pmod(F.shiftrightunsigned("draw", 20), F.col("runs")))
    runs = x.groupBy("source", "pass_no", "run").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("pass_no", "run")) - F.col("sum")
    offsets = runs.select("source", "pass_no", "run", before.alias("before")).join(F.broadcast(plan.select("source", "need")), "source").where("before < need").drop("need")
    within = F.sum("tokens").over(Window.partitionBy("source", "pass_no", "run").orderBy("draw", "item").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    x = x.join(offsets, ["source", "pass_no", "run"]).withColumn("start", within + F.col("before")).select("source", "need", "item", "pass_no", "draw", "tokens", "start")
    x = cut(x)
    fits = x.where("start + tokens <= need")
    # what is left of a share goes to the unused record that fills it best
    ends = fits.groupBy("source").agg(F.max(F.col("start") + F.col("tokens")).alias("end"))
    spare = x.where("start + tokens > need").join(F.broadcast(ends), "source", "left").withColumn("end", F.coalesce("end", F.lit(0)))
    gap = F.col("need") - F.col("end")
    best = spare.where(F.col("tokens") < 2 * gap).groupBy("source").agg(F.min(F.struct(F.abs(F.col("tokens") - gap).alias("off"), "draw", "item", "pass_no", "tokens", "end")).alias("b"))
    x = fits.select("source", "item", "pass_no", "tokens", "start").union(best.select("source", "b.item", "b.pass_no", "b.tokens", "b.end"))
    x = x.join(F.broadcast(plan.select("source", "per_period")), "source")
    block = F.floor(F.col("start") / block_tokens)
    # a row for each slot of the period, so that no row of the mix carries the table
    places = spark.createDataFrame([(k, i, t) for k in shares for i, t in enumerate(table[k])], "source string, place long, at long")
    x = x.withColumn("block", block).withColumn("place", F.col("block") % F.col("per_period")).join(F.broadcast(places), ["source", "place"])
    slot = F.floor(F.col("block") / F.col("per_period")) * period + F.col("at")
    return x.select(slot.cast("long").alias("slot"), "source", "start", F.col("item").alias(key), "pass_no", "tokens")


def shares_reached(mixed: DataFrame, targets: DataFrame, *, key: str) -> DataFrame:
    """Per target source: the share asked for and reached, tokens, records used and the most uses of one."""
    uses = mixed.groupBy("source", key).agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    sums = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    whole = sums.agg(F.sum("tokens").alias("all_tokens"))  # one row
    out = targets.join(small(sums), "source", "left").crossJoin(F.broadcast(whole))
    n = F.coalesce("tokens", F.lit(0))
    return out.select("source", "target_share", "max_repeats", n.alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.when(F.col("all_tokens") > 0, n / F.col("all_tokens")).otherwise(0.0).alias("share"))
