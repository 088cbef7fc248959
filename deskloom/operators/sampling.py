"""Seeded samples: draws are hashes of keys, so they don't depend on partitions or engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.functions.text import hash_draw
from deskloom.runtime import cut


def rank_within(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``, the place from 1 of each row of a group in ``order``; a group may span any number of tasks.

    Rows are spread by ranges, counted by range and group, and numbered within.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_size")  # a row for each range and group
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    joined = spread.withColumn("_n", within).join(sizes.select(*by, "_part", before.alias("_before")), [*by, "_part"])
    return joined.withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def uniform(df: DataFrame, n: int, *, key: str, seed: int) -> DataFrame:
    """``n`` rows without replacement."""
    return df.withColumn("_d", hash_draw(F.col(key), seed)).orderBy("_d", key).limit(n).drop("_d")


def keep_first(df: DataFrame, *, key: Column, order: list[str]) -> DataFrame:
    """The first row of each non-empty ``key``."""
    w = Window.partitionBy("_k").orderBy(*order)
    return df.withColumn("_k", key).where("_k <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_k", "_n")


def balanced(df: DataFrame, n: int, *, group: str, key: str, seed: int) -> DataFrame:
    """``floor(n / groups)`` rows of every group, all in one shuffled order ``position`` from 1."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct().count()
    each = n // groups if groups else 0
    w = Window.partitionBy(group).orderBy("_d", key)
    x = df.withColumn("_d", hash_draw(F.concat_ws("|", F.col(group), F.col(key)), seed)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each)  # a literal limit, kept from the shuffle
    return x.withColumn("position", F.row_number().over(Window.orderBy("_d", group, key))).drop("_d", "_n")  # at most n rows


def rule_quota(df: DataFrame, rules: list[str], total: int, *, key: str, fired: str, seed: int) -> DataFrame:
    """Up to ``max(1, floor(total / 2 / rules with candidates))`` rows per rule, rules in order of name, no row twice.

    Candidates of a rule come in the order of their draw; a row that an earlier
    rule took is passed over. Adds ``rule``.
    """
    x = df.withColumn("_d", hash_draw(F.col(key), seed))
    with_any = [r for r, n in zip(rules, x.agg(*(F.count_if(F.array_contains(fired, r)) for r in rules)).first() or []) if n]
    quota = max(1, total // 2 // max(1, len(with_any)))
    out = taken = None
    for rule in sorted(with_any):
        free = x.where(F.array_contains(fired, rule))
        if taken is not None:
            free = free.join(taken, key, "left_anti")
        pick = free.orderBy("_d", key).limit(quota).withColumn("rule", F.lit(rule))
        out = pick if out is None else out.unionByName(pick)
        taken = pick.select(key) if taken is None else taken.union(pick.select(key))
    return x.withColumn("rule", F.lit(None).cast("string")).where("false").drop("_d") if out is None else out.drop("_d")


def round_robin(df: DataFrame, budget: int, *, group: str, order: list[str], rounds: int = 50) -> DataFrame:
    """Rounds over groups take one row of each until ``budget`` or ``rounds`` is reached; adds ``round`` from 1."""
    w = Window.partitionBy(group).orderBy(*order)
    x = df.withColumn("round", F.row_number().over(w)).where(F.col("round") <= rounds)
    return x.orderBy("round", group).limit(budget)


def folds(df: DataFrame, n: int, *, label: str, key: str, seed: int) -> DataFrame:
    """Add ``fold`` from 0: classes are dealt out evenly in the order of the draw; rows without a class leave."""
    ranked = rank_within(df.where(F.col(label).isNotNull()).withColumn("_d", hash_draw(F.col(key), seed)), [label], ["_d", key], "_r")
    return ranked.withColumn("fold", (F.col("_r") - 1) % n).drop("_d", "_r").select(*df.columns, "fold")
