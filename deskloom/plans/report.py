"""The evaluation report: metric frames of fixed size, rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.functions.text import INTENTS
from deskloom.operators import metrics

LIMITS = {"false_auto": 5, "ungrounded": 5, "confident_mistake": 5, "over_escalation": 5, "no_precedent": 4}


def outputs_with_gold(outputs: DataFrame, golden: DataFrame) -> DataFrame:
    """System outputs of labelled golden items with ``gold_intent``, ``gold_route`` and ``stratum``."""
    g = golden.where("gold_intent IS NOT NULL AND gold_intent <> '' AND gold_route IS NOT NULL AND gold_route <> ''").select("episode_id", "gold_intent", "gold_route", "stratum")
    return outputs.join(g, "episode_id")


def strata(joined: DataFrame) -> DataFrame:
    """Every row under ``overall`` and under ``random`` or ``targeted``."""
    part = F.when(F.col("stratum") == "random", "random").otherwise("targeted")
    return joined.withColumn("part", F.explode(F.array(F.lit("overall"), part)))


def system_metrics(joined: DataFrame) -> DataFrame:
    """Classification and routing per system and part of the sample."""
    rows = strata(joined)
    by = ["system", "part"]
    cells = metrics.confusion(rows, by=by, gold="gold_intent", pred="intent", labels=list(INTENTS))
    c = metrics.classification(metrics.class_report(cells, by=by, labels=list(INTENTS)), by=by).withColumnRenamed("n", "n_intent").withColumnRenamed("accuracy", "intent_accuracy")
    r = metrics.routing(rows, by=by, gold="gold_route", pred="route").withColumnRenamed("n", "n_route").withColumnRenamed("accuracy", "route_accuracy")
    return c.join(r, by, "full")


def judge_aggregate(scores: DataFrame, outputs: DataFrame) -> DataFrame:
    """Means, shares with intervals, and the share of sendable replies among those sent automatically, per system. Repeated grades of a reply count once, the best composite."""
    best = scores.where("(error IS NULL OR error = '') AND grounding > 0").groupBy("system", "episode_id").agg(F.max(F.struct("composite", "grounding", "resolution", "tone", "sendable", F.coalesce("violation", F.lit("")).alias("violation"))).alias("s")).select("system", "episode_id", "s.*")
    x = best.join(outputs.select("system", "episode_id", "route").distinct(), ["system", "episode_id"], "left")
    n, k = F.count("*"), F.count_if("sendable")
    auto, auto_k = F.count_if(F.col("route") == "auto"), F.count_if((F.col("route") == "auto") & F.col("sendable"))
    low, high = metrics.wilson(k, n)
    return x.groupBy("system").agg(n.alias("n"), *(F.avg(F.col(c).cast("double")).alias(c) for c in ("grounding", "resolution", "tone", "composite")), metrics.ratio(k, n).alias("sendable"), low.alias("sendable_low"), high.alias("sendable_high"), metrics.ratio(F.count_if(F.col("violation") != ""), n).alias("violations"), auto.alias("auto_n"), metrics.ratio(auto_k, auto).alias("auto_sendable"))


def system_intervals(joined: DataFrame) -> DataFrame:
    """Bootstrap intervals of accuracy and macro F1 per system and part of the sample."""
    by = ["system", "part"]
    cells = metrics.confusion(strata(joined), by=by, gold="gold_intent", pred="intent", labels=list(INTENTS))
    return metrics.bootstrap_classes(cells, by=by)


def composite_intervals(scores: DataFrame) -> DataFrame:
    """Bootstrap interval of the composite per system; repeated grades of a reply count once, the best."""
    best = scores.where("(error IS NULL OR error = '') AND grounding > 0").groupBy("system", "episode_id").agg(F.max("composite").alias("composite"))
    return metrics.bootstrap_mean(best, "composite", by=["system"], seed=29)


def judge_human(judge: DataFrame, people: DataFrame) -> DataFrame:
    """``dimension, n, exact, mae, kappa, rho``: grades of the judge against people's of the same reply.

    Both are ``system, episode_id, grounding, resolution, tone, composite,
    sendable``, one row for each reply. Dimensions have quadratic kappa, the
    composite its rank correlation, sendable plain agreement and Cohen's kappa.
    """
    both = judge.alias("a").join(people.alias("b"), [F.col("a.system").eqNullSafe(F.col("b.system")), F.col("a.episode_id") == F.col("b.episode_id")])
    pair = lambda c, kind: F.struct(F.lit(c).alias("dimension"), F.col(f"a.{c}").cast(kind).alias("x"), F.col(f"b.{c}").cast(kind).alias("y"))
    by = ["dimension"]
    rows = both.select(F.explode(F.array(*(pair(c, "double") for c in ("grounding", "resolution", "tone", "composite")))).alias("k")).select("k.*")
    grades = rows.where("dimension <> 'composite'")
    none = F.lit(None).cast("double")
    o = metrics.ordinal_agreement(grades, "x", "y", by=by).join(metrics.quadratic_kappa(grades, "x", "y", by=by).select("dimension", "quadratic_kappa"), "dimension").select("dimension", "n", "exact", "mae", F.col("quadratic_kappa").alias("kappa"), none.alias("rho"))
    r = metrics.spearman(rows.where("dimension = 'composite'"), "x", "y", by=by).select("dimension", "n", none, none, none, F.col("spearman"))
    s = metrics.cohen_kappa(both.select(pair("sendable", "boolean").alias("k")).select("k.*").where("x IS NOT NULL AND y IS NOT NULL"), "x", "y", by=by).select("dimension", "n", "agree", none, "kappa", none)
    return o.union(r).union(s)


def failure_gallery(joined: DataFrame, scores: DataFrame) -> DataFrame:
    """A few rows per kind of failure, in order of system and item: what was sent though it shouldn't be, ungrounded, confidently wrong, held back, without precedent."""
    low = scores.where("grounding BETWEEN 1 AND 2").select("system", "episode_id").distinct().withColumn("_low", F.lit(True))
    x = joined.join(low, ["system", "episode_id"], "left")
    kinds = F.array(
        F.when((F.col("route") == "auto") & (F.col("gold_route") == "escalate"), "false_auto"),
        F.when(F.col("_low"), "ungrounded"),
        F.when((F.col("intent") != F.col("gold_intent")) & (F.col("confidence") >= 0.9), "confident_mistake"),
        F.when((F.col("route") == "escalate") & (F.col("gold_route") == "auto"), "over_escalation"),
        F.when(F.col("retrieval_top") < 0.12, "no_precedent"),
    )
    rows = x.select("episode_id", "system", "intent", "gold_intent", "route", "gold_route", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    w = Window.partitionBy("kind").orderBy("system", "episode_id", "intent")
    limit = F.create_map(*(F.lit(v) for k, n in LIMITS.items() for v in (k, n)))
    most = max(LIMITS.values())  # a literal limit, kept from the shuffle
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).where(F.col("place") <= limit[F.col("kind")])


def taxonomy_document(intents: dict[str, str] | None = None) -> str:
    """The intents and the routes they take, as a Markdown page."""
    rows = [f"| {name} | {route} |" for name, route in (intents or INTENTS).items()]
    return "\n".join(["# Intents", "", "| intent | default route |", "|---|---|", *rows, ""])


def short(text: str | None, n: int = 80) -> str:
    """One line of at most ``n`` characters, dots for what is cut."""
    line = " ".join((text or "").split())
    return line if len(line) <= n else line[: n - 1].rstrip() + "…"


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f} %"


def interval(low: float | None, high: float | None) -> str:
    return "" if low is None or high is None else f"[{low:.3f}, {high:.3f}]"


def _table(rows: list, columns: list[str]) -> str:
    def cell(v: object) -> str:
        return f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])


def markdown(title: str, sections: list[tuple[str, DataFrame, list[str]]]) -> str:
    """A document with a table per section ``(heading, frame, order)``; frames are metric tables of fixed size."""
    parts = [f"# {title}"]
    for heading, frame, order in sections:
        rows = frame.orderBy(*order).collect()
        parts.append(f"## {heading}\n\n" + (_table(rows, frame.columns) if rows else "(nothing)"))
    return "\n\n".join(parts) + "\n"
