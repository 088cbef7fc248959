"""Guardrails: a rule set given as a parameter, and the decision it takes part in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.text import INTENTS, join_reasons

# --- fixed values: thresholds and names of the gates ------------------------
MIN_CONFIDENCE, MIN_SCORE = 0.60, 0.12
LOW_CONFIDENCE, NO_PRECEDENT, BY_DEFAULT = "low_intent_confidence", "no_precedent", "intent_default_escalate"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A rule fires on a whole word or phrase; letter case doesn't matter, word edges are those of ASCII."""

    name: str
    reason: str
    words: tuple[str, ...]

    def pattern(self) -> str:
        # the look-arounds stay outside the group that ignores case, whose folding would change their class
        return "(?<![0-9A-Za-z_])(?iu:" + "|".join(self.words) + ")(?![0-9A-Za-z_])"

    def re2(self) -> str:
        return r"(?i)\b(" + "|".join(self.words) + r")\b"


#: A neutral default; the rules of a business are its own configuration.
DEFAULT_RULES = (
    Rule("lost_item", "reports a missing item", ("left behind", "did not make it", "never showed up", "did not arrive")),
    Rule("payment_trouble", "mentions a payment", ("billed", "owe", "paid", "rejects my card")),
    Rule("long_wait", "complains about waiting", ("on hold", "waiting", "hours", "stuck")),
    Rule("technical", "describes a technical fault", ("app", "website", "login", "kiosk", "wifi")),
)


def fired_rules(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Names of the rules that fire on ``text``, in their order."""
    hit = F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(r.pattern()), F.lit(r.name)) for r in rules))
    return F.filter(hit, lambda x: x.isNotNull())


def decide(df: DataFrame, *, text: str, rules: tuple[Rule, ...] = DEFAULT_RULES, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """Add ``route, route_reason, fired_rules, overridden``.

    ``df`` has ``intent, confidence, top_score, model_route, model_reason``.
    Rules only push towards a person: any that fires escalates, ``overridden``
    says that the model had proposed ``auto``; otherwise the model's own
    escalation stands. A missing confidence or score counts as too low.
    """
    by_default = [i for i, route in INTENTS.items() if route == "escalate"]
    gates = [
        (F.coalesce("confidence", F.lit(0.0)) < min_confidence, LOW_CONFIDENCE, F.lit("was classified with little confidence")),
        (F.coalesce("top_score", F.lit(0.0)) < min_score, NO_PRECEDENT, F.lit("has no similar precedent")),
        (F.coalesce(F.col("intent").isin(by_default), F.lit(False)), BY_DEFAULT, F.concat(F.lit("has intent "), F.col("intent"), F.lit(", which people handle"))),
    ]
    names = F.concat(fired_rules(F.col(text), rules), *(F.when(c, F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for c, n, _ in gates))
    told = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.reason)))
    reasons = F.concat(F.transform(fired_rules(F.col(text), rules), lambda n: F.element_at(told, n)), *(F.when(c, F.array(r)).otherwise(F.array().cast("array<string>")) for c, _, r in gates))
    fired = F.size("_names") > 0
    model_escalates = F.coalesce(F.col("model_route") == "escalate", F.lit(False))
    own = F.trim(F.coalesce("model_reason", F.lit("")))
    return (
        df.withColumn("_names", names)
        .withColumn("_reasons", reasons)
        .withColumn("route", F.when(fired | model_escalates, "escalate").otherwise("auto"))
        .withColumn(
            "route_reason",
            F.when(fired, F.concat(F.lit("A person should answer: it "), join_reasons(F.col("_reasons")), F.lit(".")))
            .when(model_escalates, F.when(own == "", "The model asked for a person.").otherwise(own))
            .otherwise(F.concat(F.lit("Answered: intent "), F.coalesce("intent", F.lit("other")), F.lit(" needs no person and no rule fired."))),
        )
        .withColumn("fired_rules", F.when(fired, F.col("_names")).when(model_escalates, F.array(F.lit("model_judgement"))).otherwise(F.array().cast("array<string>")))
        .withColumn("overridden", fired & F.coalesce(F.col("model_route") == "auto", F.lit(False)))
        .drop("_names", "_reasons")
    )
