"""Problem 4: personal information in free text, found by how much terms disclose.

No pattern decides by itself. Patterns only propose spans: runs with six digits or
more, houses with a street, pairs of words, and addresses of mail, which are what
they are. Whether a span goes is decided by what its terms disclose in the whole
corpus, in bits over the base rate:

1. Entities are a few words that name a protected thing ("passport", "phone",
   "live at"). A span's term is its shape (digits and letters generalised), for an
   address its kind of street and first word. Counting how often spans of a term
   stand by an entity word, against how often any word does, gives what the term
   discloses; rare terms lean on their coarser form. A protected shape goes
   wherever it stands, and a shape of case numbers stays even behind "phone".
2. A word discloses a first or last name by its share of uses inside names. Names
   start from a few titles, and spread once: a word that completes a known one
   behind a signature or booking counts as well. Two words that disclose a name go
   wherever they stand together, and "my name is on the list" stays.

Statistics cover every text, as often as it comes. Workers get those of words as a
bit map of fixed size that only pre-selects; the decision joins the exact tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.lookalike import form_sql, map_sql
from deskloom.runtime import cut

#: Disclosure thresholds: what is removed raises the odds of an entity by so many bits and is one with this chance at least.
LEAST_BITS, LEAST_CHANCE, LEAST_SHARE = 4.0, 0.5, 0.3
#: Uses that a term's coarser form stands for, and words that an entity word reaches.
LEAN, REACH = 4.0, 4
#: Of protected spans, at least 3 % stand without an entity word, whatever the counts say.
MOST_SEEN = 0.97
MAP_BITS = 20
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# --- fixed values -----------------------------------------------------------
#: Words that name what is protected, and what may stand between them and a span.
ENTITIES = {
    "phone": (r"call|phone|tel|telephone|cell|mobile|teléfono|téléphone|telefon|handy|móvil", r"(?:[^\pL.!?\n][^.!?\n]{0,24}|[.:] ?)?$"),
    "id_number": (r"passport|licen[cs]e|ssn|social security|national id|identity card|id card|pasaporte|passeport|reisepass|personalausweis", r"(?:[^\pL!?\n][^!?\n]{0,16})?$"),
    "address": (r"live at|living at|stay at|staying at|address|send|ship|deliver|adresse|dirección", r"(?:[^\pL.!?\n][^.!?\n]{0,16})?$"),
}
#: Numbers whose public format is that of a kind, without and with their signs: E.164, the North American plan, social security.
FORMATS = {"phone": ("[+]9{9,15}", ["(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999"]), "id_number": ("-", ["999-99-9999", "999 99 9999"]), "address": ("-", ["-"])}
_DIGIT = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_KIND = "(?:street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|drive|gardens|court|square|terrace|close|crescent|way)"
_TITLES = r"my name is|name ?:|passenger|(?:mr|mrs|ms|miss|dr)\.?"
_SIGNS = r"regards,|sincerely,|(?:booked|registered) (?:under|for)|reservation (?:of|for)|this is|i['’]m|i am"
# ---------------------------------------------------------------------------
_LABEL = r"[\pL\p{Nd}][\pL\p{Nd}_-]*"
_AT, _DOT = r"(?: ?@ ?| ?[(\[{] ?at ?[)\]}] ?)", r"(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )"
_MAIL = rf"(?:mailto:)?<?[\pL\p{{Nd}}](?:[\pL\p{{Nd}}_.+-]*[\pL\p{{Nd}}_])?(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+| at {_LABEL}(?: dot {_LABEL})+)>?"
_NUMBER = r"\+?\(?(?:\pL{1,6}-?)?\p{Nd}(?:(?:[-./ ]| ?\(|\)[ -]?)?\p{Nd}){5,}[\pL\p{Nd}]*"
_SPELLED = rf"{_DIGIT}(?:[ -]{_DIGIT}){{6,}}"
_STREET = rf"(?:(?:flat|apt\.?|apartment|unit) [\pL\p{{Nd}}]+, ?)?(?:no\.? ?)?\p{{Nd}}{{1,5}}\pL?,? +(?:[nsew]\. +)?(?:\pL[\pL'’-]+ +){{1,2}}{_KIND}\b\.?(?:,? +(?:apt\.?|suite|flat|unit) +[\pL\p{{Nd}}]+)?(?:, \pL+ \p{{Nd}}{{5}})?"
_OTHER = (
    r"p\.? ?o\.? ?box \p{Nd}+(?:, \pL+)?|(?:calle|avenida|plaza|via) \pL+,? \p{Nd}{1,5}(?:, \p{Nd}{1,2} ?º?o? ?[a-z]\b)?"
    r"|\p{Nd}{1,5},? (?:rue|avenue|boulevard|chemin|impasse) (?:(?:de|du|des|la|le) )*\pL+|\pL{3,}(?:straße|strasse|str\.|gasse|allee|weg) \p{Nd}{1,5}[a-z]?"
)
_L = r"\pL"
_BOUND = r"(^|[^\pL\p{Nd}_.$€£/@#+-])"
_W = r"\pL[\pL\p{Nd}_'’]*(?:-\pL[\pL\p{Nd}_'’]*)*"
_WS = r"[ \t\n\r]"
#: Names that are whole values, first name first or last.
_NAMES = rf"^\s*(\pL{{2,}})[ _]({_W})\s*$", rf"^\s*({_W}), ?(\pL{{2,}})\s*$"
_PAIR = rf"({_W})(, ?|/|{_WS}(?:\pL\.{_WS})?)({_W})"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pairs_sql(pattern: str, source: str, table: str) -> str:
    """``grp, first, last`` of the pairs of words behind ``pattern``; a comma or slash puts the last name first."""
    full = _q(rf"(?i)(?:^|[^\pL])(?:{pattern}){_WS}+{_PAIR}")
    every = f"SELECT unnest(list_zip(regexp_extract_all(text, {full}, 1), regexp_extract_all(text, {full}, 2), regexp_extract_all(text, {full}, 3))) AS z FROM {table} WHERE NOT ident"
    turned = "(contains(z[2], ',') OR z[2] = '/')"
    word = lambda n: f"string_split(lower(z[{n}]), '-')[1]"
    return f"SELECT '{source}' AS grp, CASE WHEN {turned} THEN {word(3)} ELSE {word(1)} END AS first, CASE WHEN {turned} THEN {word(1)} ELSE {word(3)} END AS last FROM ({every})"


def evidence_sql(table: str) -> str:
    """What the rows ``k, field, ident, d, text`` of ``table`` tell, as one relation.

    ``what`` is "span" (a proposed span with its terms and entity words), "word"
    (uses of a word), "pair" (words of a name by source) or "total".
    """
    clear = "translate(text, chr(1) || chr(2), '  ')"
    mark = lambda p: f"regexp_replace(x, {_q(f'(?i){_BOUND}({p})')}, '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    # one pattern at a time is far cheaper than their union, which only texts with several sorts need
    sorts = {"mail": _MAIL, "street": _STREET, "place": _OTHER, "number": _NUMBER, "spelled": _SPELLED}
    flags = ", ".join(f"regexp_matches(x, {_q(f'(?i){p}')}) AS {c}" for c, p in sorts.items())
    alone = " ".join(f"WHEN NOT ({' OR '.join(o for o in sorts if o != c)}) THEN {mark(p)}" for c, p in sorts.items())
    marked = f"CASE WHEN NOT ({' OR '.join(sorts)}) THEN NULL {alone} ELSE {mark('|'.join(sorts.values()))} END"
    near = ", ".join(f"regexp_matches(before, {_q(f'(?:^|[^{_L}])(?:{words}){tail}')}) AS {kind}" for kind, (words, tail) in ENTITIES.items())
    street, of_kind = r"\p{Nd}\pL?,? +(?:[nsew]\. +)?(\pL[^ ]*) ", rf" ({_KIND})\b"
    coarse = (
        r"CASE WHEN grp = 'mail' THEN '@' WHEN grp = 'num' THEN regexp_replace(exact, '[^9aw+]', '', 'g') WHEN regexp_matches(low, '^p\.? ?o\.? ?box ') THEN 'box' WHEN regexp_matches(low, '^(?:calle|avenida|plaza|via) ') THEN 'calle'"
        rf" WHEN regexp_matches(low, '^\p{{Nd}}+,? (?:rue|avenue|boulevard|chemin|impasse) ') THEN 'rue' WHEN regexp_matches(low, {_q(of_kind)}) THEN 'street ' || regexp_extract(low, {_q(of_kind)}, 1) ELSE 'strasse' END"
    )
    shape = r"CASE WHEN NOT regexp_matches(low, '\p{Nd}') THEN 'w' ELSE regexp_replace(regexp_replace(low, '\p{Nd}', '9', 'g'), '\pL', 'a', 'g') END"
    group = f"CASE WHEN regexp_matches(low, {_q(f'^(?:{_MAIL})$')}) THEN 'mail' WHEN regexp_matches(low, {_q(f'^(?:{_NUMBER}|{_SPELLED})$')}) THEN 'num' ELSE 'addr' END"
    empty = "NULL::VARCHAR AS k, NULL::VARCHAR AS field, NULL::BIGINT AS d, NULL::INTEGER AS start, NULL::INTEGER AS stop, NULL::BOOLEAN AS ident"
    none = "NULL::VARCHAR AS after, " + ", ".join(f"NULL::BOOLEAN AS {kind}" for kind in ENTITIES)
    whole = _q(rf"(?i)^(?:{_MAIL}|{_STREET}|{_OTHER}|{_NUMBER}|{_SPELLED})$")
    mails = r"^(?:mailto:)?<?([a-z]{2,})[._-]([a-z]{2,})[^a-z]"
    parts = f"""
ev_m AS (SELECT k, field, d, row_number() OVER () AS rid, string_split(x, chr(1)) AS ps FROM (SELECT k, field, d, {marked} AS x FROM (SELECT *, {flags} FROM (SELECT k, field, d, {clear} AS x FROM {table} WHERE NOT ident))) WHERE contains(x, chr(1))),
ev_u AS (SELECT k, field, d, rid, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM ev_m),
ev_w AS (SELECT *, sum(length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS start, lag(piece) OVER (PARTITION BY rid ORDER BY i) AS prev FROM ev_u),
ev_c AS (SELECT k, field, d, false AS ident, start::INTEGER AS start, string_split(piece, chr(2))[1] AS span, string_split(piece, chr(2))[2] AS rest, right(lower(string_split(prev, chr(2))[-1]), 60) AS before FROM ev_w WHERE i > 1
  UNION ALL SELECT k, field, d, true, 0, text, '', '' FROM {table} WHERE ident AND regexp_matches(trim(text), {whole})),
ev_g AS (SELECT *, trim(lower(span)) AS low, {near} FROM ev_c WHERE NOT regexp_matches(rest, '^[\\pL\\p{{Nd}}_]')),
ev_s AS (SELECT *, {group} AS grp, regexp_extract(lower(rest), '^[^\\pL.!?\\n]*(\\pL+)', 1) AS after FROM ev_g),
ev_e AS (SELECT *, CASE WHEN grp = 'mail' THEN '@' WHEN grp = 'num' THEN {shape} ELSE regexp_extract(low, {_q(street)}, 1) END AS exact FROM ev_s),
ev_f AS (SELECT *, {coarse} AS coarse FROM ev_e),
ev_p AS ({_pairs_sql(_TITLES, 'title', table)} UNION ALL {_pairs_sql(_SIGNS, 'sign', table)}
  UNION ALL SELECT 'mail', regexp_extract(low, {_q(mails)}, 1), regexp_extract(low, {_q(mails)}, 2) FROM ev_s WHERE grp = 'mail'
  UNION ALL SELECT 'ident', lower(regexp_extract(text, {_q(_NAMES[0])}, 1)), string_split(lower(regexp_extract(text, {_q(_NAMES[0])}, 2)), '-')[1] FROM {table} WHERE ident AND regexp_matches(text, {_q(_NAMES[0])})
  UNION ALL SELECT 'ident', lower(regexp_extract(text, {_q(_NAMES[1])}, 2)), string_split(lower(regexp_extract(text, {_q(_NAMES[1])}, 1)), '-')[1] FROM {table} WHERE ident AND regexp_matches(text, {_q(_NAMES[1])}))"""
    count = {"words": "len(string_split(text, ' '))", **{kind: f"len(regexp_extract_all(lower(text), {_q(f'(?:^|[^{_L}])(?:{words})(?:[^{_L}]|$)')}))" for kind, (words, _) in ENTITIES.items()}}
    totals = " UNION ALL ".join(f"SELECT 'total' AS what, {empty}, '{name}' AS grp, NULL::VARCHAR AS exact, NULL::VARCHAR AS coarse, {none}, coalesce(sum({x}), 0)::BIGINT AS n FROM {table} WHERE NOT ident" for name, x in count.items())
    kinds = ", ".join(ENTITIES)
    return f"""WITH {parts}
SELECT 'span' AS what, k, field, d, start, (start + length(span))::INTEGER AS stop, ident, grp, CASE WHEN grp = 'addr' THEN coarse || '|' || exact ELSE exact END AS exact, coarse, after, {kinds}, 1::BIGINT AS n FROM ev_f
UNION ALL SELECT 'word', {empty}, NULL, term, NULL, {none}, count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '\\pL[\\pL''’]+')) AS term FROM {table} WHERE NOT ident) GROUP BY term
UNION ALL SELECT 'pair', {empty}, grp, first, last, {none}, count(*) FROM ev_p WHERE length(first) > 1 AND length(last) > 1 GROUP BY grp, first, last
UNION ALL {totals}"""


EVIDENCE = "what string, k string, field string, d long, start int, stop int, ident boolean, grp string, exact string, coarse string, after string, phone boolean, id_number boolean, address boolean, n long"


def _values(df: DataFrame, *, key: str, texts: list[str], idents: list[str]) -> DataFrame:
    """``k, field, ident, text``: one row per key, field and value as it stands; nulls and blanks leave."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(c in idents).alias("ident"), F.col(c).cast("string").alias("text")) for c in [*texts, *idents]))
    return df.select(F.col(key).cast("string").alias("k"), F.explode(fields).alias("x")).select("k", "x.*").where("k IS NOT NULL AND text IS NOT NULL")


_PLAIN = "ident AND text RLIKE '^[0-9]+$'"


def consistent(df: DataFrame, *, key: str, texts: list[str], idents: list[str]) -> DataFrame:
    """``k, field, ident, text, d``: one row per key, field and value, in consistent form with a digest of it; nulls, blanks and ``plain`` identifiers leave."""
    rows = _values(df, key=key, texts=texts, idents=idents).where(f"NOT ({_PLAIN})")
    return map_sql(rows, f"SELECT * FROM (SELECT k, field, ident, {form_sql('text')} AS text FROM batch) WHERE regexp_matches(text, '\\S')", "k string, field string, ident boolean, text string").withColumn("d", F.xxhash64("text"))


def plain(df: DataFrame, *, key: str, texts: list[str], idents: list[str]) -> DataFrame:
    """``k, field, text``: identifiers of digits alone, which disclose nothing, are consistent as they are and need no worker."""
    return _values(df, key=key, texts=texts, idents=idents).where(_PLAIN).select("k", "field", "text").distinct()


# ---- what terms of numbers and addresses disclose ----


def base_rates(evidence: DataFrame) -> DataFrame:
    """One row: the chance ``p0_<kind>`` that any word stands by an entity word, and ``p0_email`` that it is an address of mail."""
    n = {name: F.coalesce(F.sum(F.when((F.col("what") == "total") & (F.col("grp") == name), F.col("n"))), F.lit(0)) for name in ("words", *ENTITIES)}
    mails = F.count_if((F.col("what") == "span") & (F.col("grp") == "mail"))
    return evidence.agg(*(((REACH * n[kind] + 1) / (n["words"] + 500)).alias(f"p0_{kind}") for kind in ENTITIES), ((mails + 1) / (n["words"] + 500)).alias("p0_email"))


def term_model(spans: DataFrame, base: DataFrame) -> DataFrame:
    """``grp, exact, coarse, kind, part, seen, p0``: for every term and kind, the chance that its spans are protected.

    ``seen`` is how often protected spans of the kind stand by an entity word
    themselves, so a term whose spans do as often is protected altogether
    (``part`` near 1). Terms that disclose nothing have no row.
    """
    own = [F.count_if(~F.col("ident")).alias("n"), *(F.count_if(F.col(kind)).alias(kind) for kind in ENTITIES)]
    terms = spans.where("grp <> 'mail'").groupBy("grp", "coarse", "exact").agg(*own)
    forms = terms.groupBy("grp", "coarse").agg(F.sum("n").alias("all"), *(F.sum(kind).alias(f"all_{kind}") for kind in ENTITIES))
    x = terms.join(forms, ["grp", "coarse"]).crossJoin(F.broadcast(base))  # base is one row
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit("addr" if kind == "address" else "num").alias("of"), F.col(kind).alias("by"), F.col(f"all_{kind}").alias("all_by"), F.col(f"p0_{kind}").alias("p0"), _public(kind).alias("public")) for kind in ENTITIES))
    x = x.select("grp", "coarse", "exact", "n", "all", F.explode(kinds).alias("e")).select("*", "e.*").where("grp = of").drop("e", "of")
    form = (F.col("all_by") + LEAN * F.col("p0")) / (F.col("all") + LEAN)
    lean = F.when(F.col("public"), F.greatest(form, F.lit(0.9))).otherwise(form)
    x = x.withColumn("p", (F.col("by") + LEAN * lean) / (F.col("n") + LEAN)).where((F.col("p") >= LEAST_SHARE) & (F.log2(F.col("p") / F.col("p0")) >= LEAST_BITS))
    seen = x.groupBy("kind").agg(((F.sum("by") + 2) / (F.sum("n") + 4)).alias("seen"))  # a row per kind
    x = x.join(F.broadcast(seen), "kind").withColumn("seen", F.least(F.greatest("seen", F.lit(0.05)), F.lit(MOST_SEEN)))
    part = F.least(F.greatest((F.col("p") - F.col("p0")) / F.greatest(F.col("seen") - F.col("p0"), F.lit(1e-6)), F.lit(0.0)), F.lit(0.99))
    return x.select("grp", "exact", "coarse", "kind", part.alias("part"), "seen", "p0")


def _public(kind: str) -> Column:
    coarse, exact = FORMATS[kind]
    return F.col("coarse").rlike(f"^{coarse}$") | F.col("exact").isin(exact)


def after_model(spans: DataFrame) -> DataFrame:
    """``after, odds``: how much seldomer addresses before this word stand by an entity word than all do, at most 1."""
    rows = spans.where("grp = 'addr' AND NOT ident")
    counts = rows.groupBy("after").agg(F.count("*").alias("n"), F.count_if("address").alias("by"))
    whole = counts.agg(((F.sum("by") + 0.5) / (F.sum("n") + 1)).alias("rate"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("after", F.least(F.lit(1.0), (F.col("by") + LEAN * F.col("rate")) / (F.col("n") + LEAN) / F.col("rate")).alias("odds"))


def judged_spans(spans: DataFrame, base: DataFrame) -> DataFrame:
    """``k, field, d, start, stop, kind, bits`` of the proposed spans that go: the kind with the highest chance, and what its terms disclose."""
    x = spans.where("grp <> 'mail'").join(term_model(spans, base), ["grp", "exact", "coarse"]).join(after_model(spans), "after", "left")
    by = F.expr("CASE kind " + " ".join(f"WHEN '{kind}' THEN {kind}" for kind in ENTITIES) + " END")
    part, seen, p0 = F.col("part"), F.col("seen"), F.col("p0")
    odds = part / (1 - part) * F.when(F.col("ident"), 1.0).when(by, seen / p0).otherwise((1 - seen) / (1 - p0)) * F.when(F.col("grp") == "addr", F.coalesce("odds", F.lit(1.0))).otherwise(1.0)
    chance = odds / (1 + odds)
    own = ["k", "field", "d", "start", "stop"]
    best = x.withColumn("chance", chance).withColumn("bits", F.log2(F.col("chance") / p0)).where((F.col("chance") >= LEAST_CHANCE) & (F.col("bits") >= LEAST_BITS))
    best = best.groupBy(*own).agg(F.max(F.struct("chance", "kind", "bits")).alias("b")).select(*own, "b.kind", "b.bits")
    mails = spans.where("grp = 'mail'").crossJoin(F.broadcast(base)).select(*own, F.lit("email").alias("kind"), (-F.log2("p0_email")).alias("bits"))
    return best.union(mails.distinct())


# ---- what words disclose of names ----


def _score(inside: DataFrame, words: DataFrame) -> DataFrame:
    """``term, slot, bits`` of the words that disclose a first ("f") or last ("l") name beyond the thresholds."""
    inside = inside.groupBy("term", "slot").agg(F.sum("n").alias("inside"))
    totals = words.agg(F.sum("uses").alias("all_uses")).crossJoin(inside.agg(F.sum("inside").alias("all_inside")))  # one row each
    share = F.col("inside") / F.greatest(F.coalesce("uses", F.lit(0)), F.col("inside"))
    bits = F.log2(share / (F.col("all_inside") / F.greatest("all_uses", "all_inside")))
    return inside.join(words, "term", "left").crossJoin(F.broadcast(totals)).select("term", "slot", share.alias("share"), bits.alias("bits")).where((F.col("bits") >= LEAST_BITS) & (F.col("share") >= LEAST_SHARE)).select("term", "slot", "bits")


def name_terms(evidence: DataFrame) -> DataFrame:
    """``term, slot, bits``: words that disclose a first or last name, from titles, then from signatures that a known word completes."""
    words = evidence.where("what = 'word'").groupBy(F.col("exact").alias("term")).agg(F.sum("n").alias("uses"))
    pairs = evidence.where("what = 'pair'").groupBy("grp", F.col("exact").alias("first"), F.col("coarse").alias("last")).agg(F.sum("n").alias("n"))
    both = F.explode(F.array(F.struct(F.col("first").alias("term"), F.lit("f").alias("slot")), F.struct(F.col("last").alias("term"), F.lit("l").alias("slot")))).alias("x")
    start = cut(pairs.where("grp <> 'sign'").select(both, "n").select("x.*", "n"))
    known = cut(_score(start, words))
    signs = pairs.where("grp = 'sign'")
    lasts = signs.join(known.where("slot = 'f'").select(F.col("term").alias("first")), "first", "left_semi").select(F.col("last").alias("term"), F.lit("l").alias("slot"), "n")
    firsts = signs.join(known.where("slot = 'l'").select(F.col("term").alias("last")), "last", "left_semi").select(F.col("first").alias("term"), F.lit("f").alias("slot"), "n")
    return _score(start.union(lasts).union(firsts), words)


def _slot(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << MAP_BITS) - 1)


def _bitmap(terms: DataFrame) -> bytes:
    """Fixed-size bit map of the terms' hashes: only a pre-selection."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_slot(w) for w in batch.column("term").to_pylist()], pa.int64())], ["slot"])

    bits = np.zeros(1 << MAP_BITS, bool)
    bits[terms.select("term").mapInArrow(each, "slot long").distinct().toArrow().column("slot").to_numpy()] = True
    return np.packbits(bits).tobytes()


_TOKEN = re.compile(r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*")
_GAP = re.compile(r",?[ \t\n\r](?:[^\W\d_]\.[ \t\n\r])?|/")
_PAIRS = "k string, field string, d long, start int, stop int, first string, last string"


def _pair_scan(bitmap: bytes):
    """Neighbouring words, an initial between them aside, that the bit map knows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
        known: dict[str, bool] = {}
        parts: dict[str, bool] = {}

        def knows(word: str) -> bool:
            hit = known.get(word)
            if hit is None:
                if len(known) > 500_000:
                    known.clear()
                hit = known[word] = len(word) > 1 and bool(bits[_slot(word)])
            return hit

        def part(raw: str) -> bool:
            """Whether a piece between blanks may take part in a pair."""
            if len(parts) > 500_000:
                parts.clear()
            words = [m[0].lower().split("-")[0] for m in _TOKEN.finditer(raw)]
            parts[raw] = any(len(w) == 1 or knows(w) for w in words)
            return parts[raw]

        for batch in batches:
            out = []
            for k, field, d, text in zip(*(batch.column(c).to_pylist() for c in ("k", "field", "d", "text"))):
                last = some = False
                for raw in text.split():
                    now = parts[raw] if raw in parts else part(raw)
                    if now and (last or "/" in raw):
                        some = True
                        break
                    last = now
                if not some:
                    continue
                before = None
                for m in _TOKEN.finditer(text):
                    word = m[0].lower().split("-")[0]
                    if knows(word):
                        if before is not None and (g := _GAP.fullmatch(text, before[2], m.start())):
                            turned = "," in g[0] or g[0] == "/"
                            out.append((k, field, d, before[1], m.end(), *((word, before[0]) if turned else (before[0], word))))
                        before = (word, m.start(), m.end())
                    elif len(word) > 1:
                        before = None
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _PAIRS.split(", ")])

    return each


def _ident_pairs(rows: DataFrame) -> DataFrame:
    """Identifiers that are two words, ``first last``, ``first_last`` or ``last, first``, as pairs."""
    straight, turned = _NAMES
    part = lambda p, n: F.substring_index(F.lower(F.regexp_extract("text", p, n)), "-", 1)
    hit = F.col("text").rlike(straight)
    x = rows.where("ident").where(hit | F.col("text").rlike(turned))
    return x.select("k", "field", "d", F.lit(0).alias("start"), F.length("text").alias("stop"), F.when(hit, part(straight, 1)).otherwise(part(turned, 2)).alias("first"), F.when(hit, part(straight, 2)).otherwise(part(turned, 1)).alias("last"))


def named_spans(rows: DataFrame, evidence: DataFrame, judged: DataFrame) -> DataFrame:
    """``k, field, d, start, stop, kind, bits`` of names: both words disclose one, and nothing else that goes overlaps them."""
    terms = cut(name_terms(evidence))
    first, last = (terms.where(f"slot = '{s}'").select(F.col("term").alias(c), F.col("bits").alias(f"bits_{s}")) for s, c in (("f", "first"), ("l", "last")))
    pairs = rows.where("NOT ident").mapInArrow(_pair_scan(_bitmap(terms)), _PAIRS).union(_ident_pairs(rows)).distinct()
    named = pairs.join(first, "first").join(last, "last").select("k", "field", "d", "start", "stop", F.lit("name").alias("kind"), F.least("bits_f", "bits_l").alias("bits"))
    other = judged.select("k", "field", "d", F.col("start").alias("s"), F.col("stop").alias("e"))
    over = (named.k == other.k) & (named.field == other.field) & (named.d == other.d) & (named.start < other.e) & (named.stop > other.s)
    return named.join(other, over, "left_anti")


def protected_spans(df: DataFrame, *, key: str, texts: list[str], idents: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the texts in consistent form, and ``k, field, d, start, stop, kind, bits`` of what must go.

    ``texts`` are searched inside, ``idents`` are judged as whole values. ``d``
    is the digest of the text that the places belong to, so a key with several
    texts keeps them apart. Null and blank values and null keys have no rows.
    """
    rows = cut(consistent(df, key=key, texts=texts, idents=idents))
    evidence = cut(map_sql(rows, evidence_sql("batch"), EVIDENCE))
    spans = evidence.where("what = 'span'")
    judged = cut(judged_spans(spans, cut(base_rates(evidence))))
    return rows, judged.union(named_spans(rows, evidence, judged))


def redact(df: DataFrame, *, key: str, texts: list[str], idents: list[str]) -> DataFrame:
    """``k, field, text, found``: every different value in consistent form with typed placeholders, and how many it has.

    Spans that overlap make one placeholder, of the first. Identifiers of digits
    alone come back as they are.
    """
    rows, spans = protected_spans(df, key=key, texts=texts, idents=idents)
    marks = spans.groupBy("k", "field", "d").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("marks"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                parts, at, n = [], 0, 0
                for m in found or []:
                    if m["start"] >= at or not n:
                        parts += [text[at : m["start"]], PLACEHOLDER[m["kind"]]]
                        n += 1
                    at = max(at, m["stop"])
                out.append("".join(parts) + text[at:])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("field"), pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["k", "field", "text", "found"])

    judged = rows.distinct().join(marks, ["k", "field", "d"], "left").select("k", "field", "text", "marks").mapInArrow(each, "k string, field string, text string, found long")
    return judged.union(plain(df, key=key, texts=texts, idents=idents).withColumn("found", F.lit(0).cast("long")))
