"""SQL twins of the operators that SQL can express, by plain joins over all rows."""

from __future__ import annotations

from deskloom.llm import consensus, privacy
from deskloom.llm.conversations import FOUND_SQL, SESSIONS_SQL, THREADS_SQL
from deskloom.llm.lookalike import bare_sql, form_sql, own_script_sql

FIELDS = ("customer_text", "brand_reply")
_LABEL = r"(?:^[\s\"''“”(\[]*|[\n/|,;][ \t]*)(\pL+(?: \pL+){0,2})[ \t]*(?:[:=]|[-–—]\s)\s*"


def _squeeze(x: str) -> str:
    return f"replace({bare_sql(x)}, ' ', '')"


_forms = " UNION ALL ".join(f"SELECT episode_id, '{f}' AS field_name, {f} AS raw, {form_sql(f)} AS form FROM episodes WHERE episode_id IS NOT NULL" for f in FIELDS)
P1_FOUND = f"""WITH x AS (SELECT DISTINCT * FROM ({_forms}) WHERE regexp_matches(form, '\\S'))
SELECT DISTINCT a.episode_id AS episode_a, b.episode_id AS episode_b, field_name FROM x a JOIN x b USING (field_name, form) WHERE a.episode_id < b.episode_id AND a.raw <> b.raw"""
P1_CLASSES = f"""WITH x AS (SELECT DISTINCT * FROM ({_forms}) WHERE regexp_matches(form, '\\S')), c AS (SELECT field_name, form, min(episode_id) AS first_id, count(DISTINCT episode_id) AS members, count(DISTINCT raw) AS spellings FROM x GROUP BY ALL)
SELECT episode_id, field_name, first_id, members, spellings FROM (SELECT DISTINCT episode_id, field_name, form FROM x) JOIN c USING (field_name, form)"""
P1_FORMS = "SELECT episode_id, " + ", ".join(f"{own_script_sql(f)} AS {f}" for f in FIELDS) + " FROM (SELECT episode_id, " + ", ".join(f"{form_sql(f)} AS {f}" for f in FIELDS) + " FROM episodes)"

#: Record keys: the sorted canonical fields of a labelled form, else the whole canonical text.
_KEYS = f"""e AS (SELECT DISTINCT episode_id, customer_text FROM episodes WHERE episode_id IS NOT NULL AND customer_text IS NOT NULL), y AS (SELECT episode_id, {form_sql('customer_text')} AS y FROM e),
sp AS (SELECT episode_id, y, string_split(regexp_replace(y, '{_LABEL}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM y),
k AS (SELECT episode_id, y, CASE WHEN len(ps) >= 3 AND ps[1] = '' AND len(list_distinct(list_transform(ps[2:], lambda p: lower(string_split(p, chr(2))[1])))) >= 2
  THEN array_to_string(list_sort(list_transform(ps[2:], lambda p: lower(string_split(p, chr(2))[1]) || chr(2) || {_squeeze('string_split(p, chr(2))[2]')})), chr(3)) ELSE {_squeeze('y')} END AS key FROM sp)"""
P3_GROUPS = f"WITH {_KEYS} SELECT episode_id, min(episode_id) OVER (PARTITION BY key) AS first_id, count(*) OVER (PARTITION BY key) AS copies FROM k WHERE key <> ''"
P3_FOUND = f"SELECT first_id, episode_id FROM ({P3_GROUPS}) WHERE copies > 1 AND episode_id <> first_id"
_P7 = f"""{_KEYS}, d AS (SELECT DISTINCT k.episode_id, key, {bare_sql('y')} AS bare, CASE WHEN purpose = 'training' THEN 'a' ELSE 'b' END AS side FROM k JOIN episodes USING (episode_id) JOIN splits ON episodes.created_at >= starts_at AND episodes.created_at < ends_at WHERE key <> ''),
w AS (SELECT episode_id, side, word, row_number() OVER (PARTITION BY episode_id, side, word) AS nth, count(*) OVER (PARTITION BY episode_id, side) AS n FROM (SELECT episode_id, side, unnest(string_split(bare, ' ')) AS word FROM d)),
o AS (SELECT a.episode_id AS a, b.episode_id AS b FROM w a JOIN w b USING (word, nth) WHERE a.side = 'a' AND b.side = 'b' AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING count(*) >= 0.9 * greatest(any_value(a.n), any_value(b.n))),
same AS (SELECT DISTINCT x.episode_id AS a, y.episode_id AS b FROM d x JOIN d y USING (key) WHERE x.side = 'a' AND y.side = 'b'),
p AS (SELECT * FROM o UNION SELECT * FROM same)"""
P7_FOUND = f"WITH {_P7} SELECT DISTINCT least(a, b) AS episode_a, greatest(a, b) AS episode_b FROM p WHERE a <> b"
P7_REPORT = f"""WITH {_P7}, ev AS (SELECT DISTINCT episode_id AS b, split_name, brand FROM episodes JOIN splits ON created_at >= starts_at AND created_at < ends_at WHERE purpose <> 'training' AND customer_text IS NOT NULL)
SELECT split_name, brand, count(*) AS pairs, count(same.a) AS same_pairs, count(DISTINCT b) AS evaluation_records FROM p JOIN ev USING (b) LEFT JOIN same USING (a, b) WHERE a <> b GROUP BY ALL"""

def _p4() -> str:
    """Rows ``r`` of all values in one form, and ``gone``, the spans that go, by the same terms over plain joins."""
    least, chance, share, lean, reach = privacy.LEAST_BITS, privacy.LEAST_CHANCE, privacy.LEAST_SHARE, privacy.LEAN, privacy.REACH
    kinds = list(privacy.ENTITIES)
    total = lambda name: f"sum(n) FILTER (what = 'total' AND grp = '{name}')"
    rates = ", ".join(f"({reach} * {total(k)} + 1)::DOUBLE / ({total('words')} + 500) AS p0_{k}" for k in kinds)
    public = lambda k: f"(regexp_full_match(coarse, '{privacy.FORMATS[k][0]}') OR exact IN ({', '.join(repr(x) for x in privacy.FORMATS[k][1])}))"
    by_kind = " UNION ALL ".join(
        f"SELECT t.grp, t.coarse, t.exact, t.n, '{k}' AS kind, t.{k} AS c, p0_{k} AS p0, greatest((f.all_{k} + {lean} * p0_{k}) / (f.every + {lean}), CASE WHEN {public(k).replace('coarse', 't.coarse').replace('exact', 't.exact')} THEN 0.9 ELSE 0 END) AS form FROM t JOIN f USING (grp, coarse), base WHERE t.grp = '{'addr' if k == 'address' else 'num'}'"
        for k in kinds
    )
    token, ws = r"[^\pL]*\pL[\pL\p{Nd}_''’]*(?:-\pL[\pL\p{Nd}_''’]*)*", r"[ \t\n\r]"
    names = [privacy._q(x) for x in privacy._NAMES]
    part = lambda p, n: f"string_split(lower(regexp_extract(text, {p}, {n})), '-')[1]"
    scored = lambda pairs: f"""SELECT term, slot, log2(sh / base) AS bits FROM (SELECT i.term, slot, i.n::DOUBLE / greatest(coalesce(w.n, 0), i.n) AS sh, (SELECT sum(n) FROM {pairs})::DOUBLE / greatest((SELECT sum(n) FROM words), (SELECT sum(n) FROM {pairs})) AS base
      FROM (SELECT term, slot, sum(n) AS n FROM {pairs} GROUP BY ALL) i LEFT JOIN words w USING (term)) WHERE sh >= {share} AND log2(sh / base) >= {least}"""  # noqa: E731
    return rf"""u AS (SELECT episode_id AS k, 'customer_text' AS field, false AS ident, customer_text AS raw FROM episodes UNION ALL SELECT episode_id, 'customer_id', true, customer_id FROM episodes),
r AS MATERIALIZED (SELECT k, field, ident, text, (hash(text) >> 1)::BIGINT AS d FROM (SELECT k, field, ident, {form_sql('raw')} AS text FROM u WHERE k IS NOT NULL AND raw IS NOT NULL AND NOT (ident AND regexp_full_match(raw, '[0-9]+'))) WHERE regexp_matches(text, '\S')),
ev AS MATERIALIZED (SELECT * FROM ({privacy.evidence_sql('r')})),
base AS (SELECT {rates}, (count(*) FILTER (what = 'span' AND grp = 'mail') + 1)::DOUBLE / ({total('words')} + 500) AS p0_email FROM ev),
t AS (SELECT grp, coarse, exact, count(*) FILTER (NOT ident) AS n, {', '.join(f'count(*) FILTER ({k}) AS {k}' for k in kinds)} FROM ev WHERE what = 'span' AND grp <> 'mail' GROUP BY ALL),
f AS (SELECT grp, coarse, sum(n) AS every, {', '.join(f'sum({k}) AS all_{k}' for k in kinds)} FROM t GROUP BY ALL),
x AS (SELECT *, (c + {lean} * form) / (n + {lean}) AS p FROM ({by_kind})),
y AS (SELECT *, least(greatest((sum(c) OVER (PARTITION BY kind) + 2)::DOUBLE / (sum(n) OVER (PARTITION BY kind) + 4), 0.05), {privacy.MOST_SEEN}) AS seen FROM x WHERE p >= {share} AND log2(p / p0) >= {least}),
model AS (SELECT grp, exact, coarse, kind, seen, p0, least(greatest((p - p0) / greatest(seen - p0, 1e-6), 0), 0.99) AS part FROM y),
rest AS (SELECT after, n, c, (sum(c) OVER () + 0.5)::DOUBLE / (sum(n) OVER () + 1) AS rate FROM (SELECT after, count(*) AS n, count(*) FILTER (address) AS c FROM ev WHERE what = 'span' AND grp = 'addr' AND NOT ident GROUP BY after)),
odd AS (SELECT k, field, d, start, stop, kind, p0, part / (1 - part) * CASE WHEN ident THEN 1 WHEN CASE kind {' '.join(f"WHEN '{k}' THEN {k}" for k in kinds)} END THEN seen / p0 ELSE (1 - seen) / (1 - p0) END
  * CASE WHEN ev.grp = 'addr' THEN coalesce(least(1, (rest.c + {lean} * rate) / (rest.n + {lean}) / rate), 1) ELSE 1 END AS odds FROM ev JOIN model USING (grp, exact, coarse) LEFT JOIN rest USING (after) WHERE what = 'span'),
judged AS (SELECT k, field, d, start, stop, arg_max(kind, odds) AS kind FROM odd WHERE odds / (1 + odds) >= {chance} AND log2(odds / (1 + odds) / p0) >= {least} GROUP BY ALL UNION SELECT k, field, d, start, stop, 'email' FROM ev WHERE what = 'span' AND grp = 'mail'),
words AS MATERIALIZED (SELECT exact AS term, sum(n) AS n FROM ev WHERE what = 'word' GROUP BY 1),
pr AS (SELECT grp, exact AS first, coarse AS last, sum(n) AS n FROM ev WHERE what = 'pair' GROUP BY ALL),
st AS MATERIALIZED (SELECT first AS term, 'f' AS slot, n FROM pr WHERE grp <> 'sign' UNION ALL SELECT last, 'l', n FROM pr WHERE grp <> 'sign'),
known AS MATERIALIZED ({scored('st')}),
more AS MATERIALIZED (SELECT * FROM st UNION ALL SELECT last, 'l', n FROM pr WHERE grp = 'sign' AND first IN (SELECT term FROM known WHERE slot = 'f') UNION ALL SELECT first, 'f', n FROM pr WHERE grp = 'sign' AND last IN (SELECT term FROM known WHERE slot = 'l')),
name AS MATERIALIZED ({scored('more')}),
tk AS (SELECT k, field, d, rid, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT k, field, d, row_number() OVER () AS rid, regexp_extract_all(text, '{token}') AS ts FROM r WHERE NOT ident)),
tp AS (SELECT k, field, d, rid, i, regexp_extract(t, '\pL.*$') AS w, left(t, length(t) - length(regexp_extract(t, '\pL.*$'))) AS sep, sum(length(t)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM tk),
nx AS (SELECT *, lead(w) OVER z AS w1, lead(sep) OVER z AS s1, lead(stop) OVER z AS e1, lead(w, 2) OVER z AS w2, lead(sep, 2) OVER z AS s2, lead(stop, 2) OVER z AS e2 FROM tp WINDOW z AS (PARTITION BY rid ORDER BY i)),
two AS (SELECT k, field, d, stop - length(w) AS start, e1 AS stop, w AS a, w1 AS b, s1 AS gap FROM nx WHERE regexp_full_match(s1, ',?{ws}|/') UNION ALL SELECT k, field, d, stop - length(w), e2, w, w2, s1 || w1 || s2 FROM nx WHERE regexp_full_match(s1 || w1 || s2, ',?{ws}\pL\.{ws}')),
low AS (SELECT k, field, d, start, stop, string_split(lower(CASE WHEN contains(gap, ',') OR gap = '/' THEN b ELSE a END), '-')[1] AS first, string_split(lower(CASE WHEN contains(gap, ',') OR gap = '/' THEN a ELSE b END), '-')[1] AS last FROM two
  UNION ALL SELECT k, field, d, 0, length(text), CASE WHEN regexp_matches(text, {names[0]}) THEN {part(names[0], 1)} ELSE {part(names[1], 2)} END, CASE WHEN regexp_matches(text, {names[0]}) THEN {part(names[0], 2)} ELSE {part(names[1], 1)} END FROM r WHERE ident AND (regexp_matches(text, {names[0]}) OR regexp_matches(text, {names[1]}))),
named AS (SELECT DISTINCT k, field, d, start, stop, 'name' AS kind FROM low WHERE first IN (SELECT term FROM name WHERE slot = 'f') AND last IN (SELECT term FROM name WHERE slot = 'l')),
gone AS MATERIALIZED (SELECT * FROM judged UNION ALL SELECT * FROM named AS n WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.k = n.k AND j.field = n.field AND j.d = n.d AND n.start < j.stop AND n.stop > j.start))"""


P4_FOUND = f"WITH {_p4()} SELECT DISTINCT k AS episode_id, field AS field_name, kind AS pii_kind FROM gone"
_MARK = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in privacy.PLACEHOLDER.items()) + " END"
P4_REDACTED = f"""WITH {_p4()}, s AS (SELECT *, max(stop) OVER (PARTITION BY k, field, d ORDER BY start, stop, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gone),
g AS (SELECT *, count(*) FILTER (before IS NULL OR start >= before) OVER (PARTITION BY k, field, d ORDER BY start, stop, kind) AS island FROM s),
o AS (SELECT k, field, d, island, min(start) AS start, max(stop) AS stop, arg_min(kind, (start, stop, kind)) AS kind FROM g GROUP BY ALL),
e AS (SELECT o.*, lag(stop, 1, 0) OVER (PARTITION BY k, field, d ORDER BY island) AS upto FROM o),
v AS (SELECT DISTINCT k, field, d, text FROM r),
a AS (SELECT v.k, v.field, v.text, string_agg(substr(v.text, (upto + 1)::BIGINT, (start - upto)::BIGINT) || {_MARK}, '' ORDER BY island) AS head, max(stop) AS stop, count(island) AS found FROM v LEFT JOIN e USING (k, field, d) GROUP BY ALL)
SELECT k, field, CASE WHEN found = 0 THEN text ELSE head || substr(text, (stop + 1)::BIGINT) END AS text, found FROM a
UNION ALL SELECT DISTINCT k, field, raw, 0 FROM u WHERE ident AND k IS NOT NULL AND regexp_full_match(raw, '[0-9]+')"""

_INTENTS = ", ".join(f"'{x}'" for x in consensus.INTENTS)
_usable = lambda x: rf"regexp_replace(lower(regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '[\s-]+', '_', 'g')"
_GIVEN = " UNION ALL ".join(
    f"SELECT episode_id AS item, {rater} AS rater, {_usable(label)} AS label, {step} AS step, TIMESTAMP '0001-01-01' AS given, 0 AS nr FROM golden"
    for step, (label, rater) in enumerate((("pass_a_intent", "coalesce(pass_a_by, 'pass_a')"), ("pass_b_intent", "coalesce(pass_b_by, 'pass_b')"), ("human_intent", "human_by"), ("gold_intent", "gold_by")))
)
P6_AGREEMENT = f"""WITH g AS ({_GIVEN} UNION ALL SELECT episode_id, annotator_id, {_usable('intent')}, 4, coalesce(labelled_at, TIMESTAMP '0001-01-01'), coalesce(audit_id, -1) FROM audits WHERE episode_id IN (SELECT episode_id FROM golden)),
l AS (SELECT * FROM g WHERE item IS NOT NULL AND rater IS NOT NULL AND label IN ({_INTENTS}) QUALIFY row_number() OVER (PARTITION BY item, rater ORDER BY step DESC, given DESC, nr DESC, label DESC) = 1),
v AS (SELECT item, label, count(*) AS v FROM l GROUP BY ALL)
SELECT item, sum(v)::BIGINT AS labels, CASE WHEN sum(v) > 1 THEN round(sum(v * (v - 1))::DOUBLE / (sum(v) * (sum(v) - 1)), 9) END AS pair_agreement FROM v GROUP BY 1"""
#: What must hold of packing and mixing whatever they choose.
P8_CHECKS = "SELECT spec_name, count(*) AS items, sum(n_chars)::BIGINT AS size, count(*) FILTER (n_chars > capacity_tokens) AS split, 0::BIGINT AS overfull FROM documents, pack_specs WHERE n_chars > 0 GROUP BY 1"
P9_CHECKS = "SELECT source, 0::BIGINT AS over_used, 0::BIGINT AS cut FROM mix_targets"

ORACLES = {"p1_found": P1_FOUND, "p1_classes": P1_CLASSES, "p1_forms": P1_FORMS, "p2_found": FOUND_SQL, "p2_threads": THREADS_SQL, "p2_sessions": SESSIONS_SQL, "p3_found": P3_FOUND, "p3_groups": P3_GROUPS, "p4_found": P4_FOUND, "p4_redacted": P4_REDACTED, "p6_agreement": P6_AGREEMENT, "p7_found": P7_FOUND, "p7_report": P7_REPORT, "p8_checks": P8_CHECKS, "p9_checks": P9_CHECKS}
