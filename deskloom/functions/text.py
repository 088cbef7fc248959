"""Text and scalar functions as column expressions; Python only where no built-in expression exists."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------
#: Words without meaning for retrieval.
STOPWORDS = """a about after all also am an and any are as at be because been before being
but by can cant do does doing dont for from get got had has have he her here hers him his how i if in into is it
its just me more most my no nor not of off on once only or other our out over own same she should so some such
than that the their them then there these they this those to too under until up very was we were what when where
which while who whom why will with would you your yours url delta amp im ive u ur pls plz""".split()
#: Intents in their order, with the route that each takes by default.
INTENTS = {
    "flight_disruption": "escalate", "baggage": "escalate", "booking_change": "escalate", "refund_compensation": "escalate",
    "loyalty_program": "escalate", "digital_issue": "auto", "service_complaint": "escalate", "contact_support": "auto",
    "general_inquiry": "auto", "praise": "auto", "other": "auto",
}
#: Near misses that stand for an intent.
ALIASES = {
    "delay": "flight_disruption", "delays": "flight_disruption", "cancellation": "flight_disruption", "flight_delay": "flight_disruption",
    "disruption": "flight_disruption", "rebooking": "flight_disruption", "luggage": "baggage", "bags": "baggage", "lost_baggage": "baggage",
    "booking": "booking_change", "seat": "booking_change", "upgrade": "booking_change", "refund": "refund_compensation",
    "compensation": "refund_compensation", "loyalty": "loyalty_program", "skymiles": "loyalty_program", "miles": "loyalty_program",
    "app": "digital_issue", "website": "digital_issue", "technical": "digital_issue", "wifi": "digital_issue", "checkin": "digital_issue",
    "check_in": "digital_issue", "complaint": "service_complaint", "feedback": "service_complaint", "contact": "contact_support",
    "support": "contact_support", "inquiry": "general_inquiry", "question": "general_inquiry", "general": "general_inquiry",
    "compliment": "praise", "positive": "praise", "thanks": "praise", "unknown": "other", "none": "other", "n/a": "other", "mixed": "other",
}
#: White space that trimming removes, as a class both regular-expression dialects know.
SPACE = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# ---------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def trim_space(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(c: Column, *, unescaped: bool = False) -> Column:
    """Entities resolved, links as ``<url>``, numeric @handles gone, white space collapsed and trimmed.

    ``unescaped`` says that ``c`` went through :func:`unescape` already.
    """
    s = c if unescaped else unescape(c)
    s = F.regexp_replace(s, r"https?://[^\t\n\f\r ]+|(?<![0-9A-Za-z_])t\.co/[^\t\n\f\r ]+", "<url>")
    s = F.regexp_replace(s, r"@[0-9]{4,}", "")
    s = F.regexp_replace(s, r"[\t\n\f\r ]+", " ")
    return trim_space(s)


def unescape(c: Column) -> Column:
    """HTML entities resolved; only texts with an ampersand go through Python."""
    return F.when(c.contains("&"), _unescape(F.when(c.contains("&"), c))).otherwise(c)


def tokenize(c: Column) -> Column:
    """Lower-case words of at least two bytes that aren't stopwords; null has none."""
    words = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}']+"), lambda w: F.regexp_replace(w, "^'+|'+$", ""))
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOPWORDS))


def analyze(tokens: Column) -> Column:
    """Words, then pairs of neighbours as ``a_b``."""

    def terms(t: Column) -> Column:
        pairs = F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda x, y: F.concat(x, F.lit("_"), y))
        return F.when(F.size(t) < 2, t).otherwise(F.concat(t, pairs))

    # bound to a variable, so that the words are found once
    return F.get(F.transform(F.array(tokens), terms), F.lit(0))


def signature(tokens: Column) -> Column:
    """The first six words: replies from one template share it."""
    return F.array_join(F.slice(tokens, 1, 6), " ")


def dedupe_key(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def normalise_intent(c: Column) -> Column:
    """The intent a free label stands for, ``other`` if none."""
    s = F.translate(F.lower(trim_space(F.coalesce(c, F.lit("")))), " -", "__")
    known = F.create_map(*(F.lit(x) for k, v in {**ALIASES, **{i: i for i in INTENTS}}.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(known, s), F.lit("other"))


def intent_names() -> list[str]:
    """The intents in their order."""
    return list(INTENTS)


def is_intent(c: Column) -> Column:
    """Whether ``c`` is the exact name of an intent; null is none."""
    return F.coalesce(c.isin(list(INTENTS)), F.lit(False))


def default_route(c: Column) -> Column:
    """The route an intent takes by default, null for what is no intent."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in INTENTS.items() for x in pair)), c)


def normalise_route(c: Column) -> Column:
    """``auto`` for what begins with it, else ``escalate``."""
    return F.when(F.lower(trim_space(c)).startswith("auto"), "auto").otherwise("escalate")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def join_reasons(reasons: Column) -> Column:
    """An English list: ``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(reasons)
    return (
        F.when(n <= 1, F.array_join(reasons, ""))
        .when(n == 2, F.array_join(reasons, " and "))
        .otherwise(F.concat(F.array_join(F.slice(reasons, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(reasons, -1)))
    )


def hash_draw(key: Column, seed: int | Column) -> Column:
    """A reproducible draw of 32 bits from a key, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), (F.lit(seed) if isinstance(seed, int) else seed).cast("string"))), 1, 8), 16, 10).cast("long")


def request_key(model: Column, system: Column, prompt: Column, max_tokens: Column, temperature: Column) -> Column:
    """SHA-256 of a request's canonical JSON; the provider is no part of it."""
    return F.sha2(F.to_json(F.struct(model.alias("model"), system.alias("system"), prompt.alias("prompt"), max_tokens.alias("max_tokens"), temperature.alias("temperature"))), 256)


def parse_label_command(c: Column) -> Column:
    """``STRUCT<intent, route, valid>`` of an annotator's command.

    Tokens are ``a`` or ``e`` for a route, a number for the intent of that
    place, or an intent's name; the last of a sort wins, unknown tokens are
    passed over as long as one counts.
    """
    names = F.array(*map(F.lit, INTENTS))
    tokens = F.split(trim_space(c), f"[{SPACE}]+")
    route = F.filter(tokens, lambda t: t.isin("a", "e"))
    intents = F.filter(F.transform(tokens, lambda t: F.when(t.rlike("^[+]?0*([1-9]|10|11)$"), F.element_at(names, F.when(t.rlike("^[+]?0*([1-9]|10|11)$"), t.cast("int")))).when(F.array_contains(names, t), t)), lambda t: t.isNotNull())
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.struct(last(intents).alias("intent"), F.when(last(route) == "a", "auto").when(last(route) == "e", "escalate").alias("route"), ((F.size(intents) > 0) | (F.size(route) > 0)).alias("valid"))


def parse_rating(c: Column) -> Column:
    """``STRUCT<grounding, resolution, tone, sendable>`` from ``4 3 5 y``; null where it's no rating."""
    s = F.replace(c, F.lit(" "), F.lit(""))
    good = s.rlike("(?s)^[1-5]{3}.*[yn]$")
    return F.when(good, F.struct(*(F.substring(s, i, 1).try_cast("int").alias(n) for i, n in ((1, "grounding"), (2, "resolution"), (3, "tone"))), F.endswith(s, F.lit("y")).alias("sendable")))


_FENCE = re.compile(r"```(?:json)?(.*?)```", re.S)
_PIECES = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[{}]', re.S)


def first_json_object(text: str | None) -> str | None:
    """The first balanced object of an answer, out of a code fence or prose; braces in strings don't count. None if there is none."""
    if text is None:
        return None
    fence = _FENCE.search(text)
    body = fence[1] if fence else text
    start = body.find("{")
    depth = 0
    for m in _PIECES.finditer(body, start) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return body[start : m.end()]
    return None


@F.pandas_udf(StringType())
def extract_json(s: pd.Series) -> pd.Series:
    return s.map(first_json_object, na_action="ignore")
