"""Decision systems over messages, draft labels and the judge."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.text import INTENTS, clamp, normalise_intent, normalise_route, request_key, trim_space
from deskloom.operators.policy import Rule, decide

CANNED = "Thank you for your message. A colleague will look into it and answer here."
TOP_PRECEDENTS = 6
JUDGE_WEIGHTS = (0.5, 0.3, 0.2)
DECISION = "intent string, route string, reason string, reply string, confidence double"
GRADES = "grounding int, resolution int, tone int, sendable boolean, violation string, rationale string"


def trivial(messages: DataFrame, *, route: str, intent: str | DataFrame) -> DataFrame:
    """The same intent, reply and route for every message, with confidence 1.

    ``intent`` is a label, or a one-row frame with ``label``.
    """
    rows = messages.crossJoin(F.broadcast(intent.select(F.col("label").alias("intent")))) if isinstance(intent, DataFrame) else messages.withColumn("intent", F.lit(intent))
    return rows.select("episode_id", "customer_text", F.lit(f"trivial-{route}").alias("system"), "intent", F.lit(1.0).alias("confidence"), F.lit(CANNED).alias("reply"), F.lit(route).alias("route"))


def simple(predictions: DataFrame, precedents: DataFrame, *, rules: tuple[Rule, ...]) -> DataFrame:
    """Predicted intent, the nearest reply verbatim or the canned one, rules with a model that always says auto.

    ``predictions`` is ``episode_id, customer_text, intent, confidence``;
    ``precedents`` the best one per message, ``episode_id, brand_reply, top_score``.
    """
    x = predictions.join(precedents, "episode_id", "left").withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))
    x = x.withColumn("reply", F.when(trim_space(F.coalesce("brand_reply", F.lit(""))) != "", F.col("brand_reply")).otherwise(CANNED))
    x = decide(x.withColumn("model_route", F.lit("auto")).withColumn("model_reason", F.lit("")), text="customer_text", rules=rules)
    return x.select("episode_id", "customer_text", F.lit("simple").alias("system"), "intent", "confidence", "reply", "route", "route_reason", "fired_rules", "overridden", "top_score")


def agent_prompt(text: Column, precedents: Column) -> Column:
    """The message and numbered precedents ``ARRAY<STRUCT<customer, brand_reply, score>>``."""
    lines = F.transform(precedents, lambda p, i: F.format_string("%d. (%.2f) customer: %s\n   reply: %s", (i + 1).cast("int"), p["score"], p["customer"], p["brand_reply"]))
    shown = F.when(F.size(precedents) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(none)"))
    return F.concat(F.lit("Message:\n"), text, F.lit("\n\nEarlier answers:\n"), shown, F.lit(f"\n\nIntents: {', '.join(INTENTS)}\nAnswer as JSON with intent, route, reason, reply and confidence."))


def requests(df: DataFrame, prompt: Column, *, key: str, model: str, system: str = "You answer support messages.", max_tokens: int = 1024) -> DataFrame:
    """Completion requests of ``df`` with their keys; ``item`` is the row's ``key``."""
    x = df.select(F.col(key).alias("item"), F.lit(model).alias("model"), F.lit(system).alias("system"), prompt.alias("prompt"), F.lit(max_tokens).alias("max_tokens"), F.lit(0.0).alias("temperature"))
    return x.withColumn("key", request_key(*(F.col(c) for c in ("model", "system", "prompt", "max_tokens", "temperature"))))


def agent(messages: DataFrame, asked: DataFrame, answers: DataFrame, *, rules: tuple[Rule, ...], name: str = "agent") -> DataFrame:
    """Model decisions behind the guardrails.

    ``messages`` is ``episode_id, customer_text, top_score``, ``asked`` the
    requests with ``item`` and ``key``, ``answers`` their ``key, json, error``.
    A failed call escalates with intent ``other`` and the rule ``agent_error``.
    """
    x = messages.join(asked.select(F.col("item").alias("episode_id"), "key"), "episode_id", "left").join(answers.select("key", "json", F.col("error")), "key", "left")
    x = x.withColumn("a", F.from_json("json", DECISION))
    failed = F.col("json").isNull() | F.col("a").isNull()
    x = x.select("episode_id", "customer_text", "top_score", failed.alias("failed"), F.coalesce("error", F.when(failed, F.lit("no answer"))).alias("error"), normalise_intent(F.col("a.intent")).alias("intent"), clamp(F.coalesce("a.confidence", F.lit(0.0)), 0.0, 1.0).alias("confidence"), F.coalesce("a.reply", F.lit("")).alias("reply"), normalise_route(F.coalesce("a.route", F.lit(""))).alias("model_route"), F.coalesce("a.reason", F.lit("")).alias("model_reason"))
    x = decide(x, text="customer_text", rules=rules)
    bad = F.col("failed")
    return x.select(
        "episode_id", "customer_text", F.lit(name).alias("system"), F.when(bad, "other").otherwise(F.col("intent")).alias("intent"), F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(bad, "").otherwise(F.col("reply")).alias("reply"), F.when(bad, "escalate").otherwise(F.col("route")).alias("route"), F.when(bad, "A person should answer: the model failed.").otherwise(F.col("route_reason")).alias("route_reason"),
        F.when(bad, F.array(F.lit("agent_error"))).otherwise(F.col("fired_rules")).alias("fired_rules"), (~bad & F.col("overridden")).alias("overridden"), F.when(bad, "").otherwise(F.col("model_route")).alias("model_route"), "top_score", "error",
    )


def selected(outputs: DataFrame, names: str) -> DataFrame:
    """Rows of the systems in a comma-separated list; an empty list selects all."""
    wanted = [x.strip() for x in names.split(",") if x.strip()]
    return outputs.where(F.col("system").isin(wanted)) if wanted else outputs


def first_n(df: DataFrame, n: int, *, order: list[str]) -> DataFrame:
    """The first ``n`` rows in ``order`` for a smoke run; all for 0."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def run_systems(messages: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]], *, only: str = "", first: int = 0) -> DataFrame:
    """Outputs of every builder, or of those in ``only``, over all messages or the first ones by id."""
    wanted = [x.strip() for x in only.split(",") if x.strip()] or list(builders)
    if unknown := [x for x in wanted if x not in builders]:
        raise ValueError(f"unknown systems: {', '.join(unknown)}")
    rows = first_n(messages, first, order=["episode_id"])
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (builders[x](rows) for x in wanted))


def brand_reply(c: Column) -> Column:
    """What the brand answered, trimmed; blank where it didn't."""
    return trim_space(F.coalesce(c, F.lit("")))


REFERENCE = "human-reference"


def with_reference(outputs: DataFrame, golden: DataFrame) -> DataFrame:
    """``episode_id, system, reply, reference``: replies to grade, with the people's own as one more system, whose reference is withheld."""
    told = golden.select("episode_id", brand_reply(F.col("delta_reply")).alias("reference"))
    own = told.select("episode_id", F.lit(REFERENCE).alias("system"), F.col("reference").alias("reply"), F.lit(None).cast("string").alias("reference"))
    return outputs.select("episode_id", "system", "reply").join(told, "episode_id", "left").unionByName(own)


def intents_block(intents: dict[str, str] | None = None) -> str:
    """The intents for a prompt, one to a line with the route each takes by default."""
    return "\n".join(f"- {name} (usually {route})" for name, route in (intents or INTENTS).items())


def judge_prompt(text: Column, reply: Column, reference: Column) -> Column:
    """A request to grade ``reply``; a null reference isn't mentioned."""
    shown = F.when(reference.isNotNull(), F.concat(F.lit("\n\nWhat people answered:\n"), reference)).otherwise(F.lit(""))
    return F.concat(F.lit("Message:\n"), text, F.lit("\n\nReply to grade:\n"), reply, shown, F.lit("\n\nGrade from 1 to 5 how well the reply keeps to known facts (grounding), how far it settles the matter (resolution) and its manner (tone). Answer as JSON with grounding, resolution, tone, sendable, violation and rationale."))


def draft_prompt(text: Column, *, style: str, a: Column | None = None, b: Column | None = None) -> Column:
    """A request for a label: pass "a" decides at once, "b" weighs the runner-up first, "adjudicate" sees the labels ``a`` and ``b``."""
    tasks = {
        "a": "Name the one intent that fits best and the route.",
        "b": "Name the two most likely intents, say what speaks against each, then decide on one and on the route.",
        "adjudicate": "Two annotators disagree. Decide which label holds, or give a third.",
    }
    seen = F.concat(F.lit("\n\nFirst label: "), a, F.lit("\nSecond label: "), b) if style == "adjudicate" else F.lit("")
    return F.concat(F.lit("Message:\n"), text, seen, F.lit(f"\n\nIntents:\n{intents_block()}\n\n{tasks[style]} Answer as JSON with intent, route and reason."))


def draft_labels(passes: DataFrame) -> DataFrame:
    """Draft labels from two passes and an adjudication of those that differ.

    ``passes`` is ``episode_id`` and ``a_, b_, c_`` each with ``intent, route``.
    A failed pass counts as other/escalate (its ``error`` stays visible in
    ``pass_error``); agreement on both fields is easy, anything else hard and
    decided by c, or, where that failed, by a's intent and escalation.
    """
    got = lambda p: (normalise_intent(F.col(f"{p}_intent")), normalise_route(F.coalesce(f"{p}_route", F.lit(""))))
    (ai, ar), (bi, br), (ci, cr) = got("a"), got("b"), got("c")
    agreed = (ai == bi) & (ar == br)
    c_failed = F.col("c_intent").isNull()
    return passes.select(
        "episode_id", ai.alias("pass_a_intent"), ar.alias("pass_a_route"), bi.alias("pass_b_intent"), br.alias("pass_b_route"), agreed.alias("passes_agreed"), F.when(agreed, "easy").otherwise("hard").alias("difficulty"),
        F.when(agreed | c_failed, ai).otherwise(ci).alias("draft_intent"), F.when(agreed, ar).when(c_failed, "escalate").otherwise(cr).alias("draft_route"), (F.col("a_intent").isNull() | F.col("b_intent").isNull()).alias("pass_error"),
    )


def composite(g: Column, r: Column, t: Column) -> Column:
    a, b, c = JUDGE_WEIGHTS
    return a * g + b * r + c * t


def judge(replies: DataFrame, answers: DataFrame) -> DataFrame:
    """Grades of replies: blank ones get 1/1/1 without a call, others the model's, kept between 1 and 5.

    ``replies`` is ``episode_id, system, reply``; ``answers`` is
    ``episode_id, system, json, error``.
    """
    x = replies.join(answers, ["episode_id", "system"], "left").withColumn("g", F.from_json("json", GRADES))
    blank = trim_space(F.coalesce("reply", F.lit(""))) == ""
    grade = lambda c: F.when(blank, 1).otherwise(clamp(F.col(f"g.{c}"), 1, 5)).cast("int")
    g, r, t = grade("grounding"), grade("resolution"), grade("tone")
    return x.select("episode_id", "system", g.alias("grounding"), r.alias("resolution"), t.alias("tone"), F.when(blank, False).otherwise(F.coalesce("g.sendable", F.lit(False))).alias("sendable"), F.when(blank, "").otherwise(F.coalesce("g.violation", F.lit(""))).alias("violation"), F.when(blank, "empty reply").otherwise(F.coalesce("g.rationale", F.lit(""))).alias("rationale"), composite(g.cast("double"), r.cast("double"), t.cast("double")).alias("composite"), F.when(~blank & F.col("g").isNull(), F.coalesce("error", F.lit("no grade"))).alias("error"))


def resume(drafts: DataFrame, reviewed: DataFrame, *, key: str) -> DataFrame:
    """Drafts with earlier reviewed rows in place of theirs; both sides have the same columns and ``reviewed``."""
    old = reviewed.where("reviewed").select(F.col(key), F.struct(*(c for c in drafts.columns if c != key)).alias("_old"))
    own = drafts.select(F.col(key), F.struct(*(c for c in drafts.columns if c != key)).alias("_own"))
    x = own.join(old, key, "left").select(key, F.when(F.col("_old").isNotNull(), F.col("_old")).otherwise(F.col("_own")).alias("_x"))
    return x.select(key, "_x.*").select(*drafts.columns)


def not_done(items: DataFrame, done: DataFrame, *, keys: list[str]) -> DataFrame:
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def thread_text(thread: Column) -> Column:
    """A thread as lines ``  CUSTOMER: …`` and ``  BRAND: …``; a missing one as a note."""
    return F.coalesce(F.array_join(F.transform(thread, lambda t: F.concat(F.lit("  "), F.rpad(F.concat(F.upper(t["role"]), F.lit(":")), 10, " "), F.coalesce(t["text"], F.lit("")))), "\n"), F.lit("(thread unavailable)"))
