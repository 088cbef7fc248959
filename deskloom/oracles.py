"""SQL twins of the core queries, for DuckDB."""

from __future__ import annotations

from deskloom.functions.text import ALIASES, INTENTS, SPACE, STOPWORDS
from deskloom.operators.metrics import BOOTSTRAP, EDGES, EXACT, Z, poisson_table
from deskloom.operators.policy import DEFAULT_RULES
from deskloom.operators.systems import CANNED

LABELS = list(INTENTS)
BRAND = "AeroLumen"


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(x: str) -> str:
    s = f"replace(replace({x}, '&#39;', ''''), '&amp;', '&')"
    s = f"regexp_replace({s}, 'https?://\\S+|\\bt\\.co/\\S+', '<url>', 'g')"
    s = f"regexp_replace({s}, '@[0-9]{{4,}}', '', 'g')"
    return trim(f"regexp_replace({s}, '\\s+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{Nd}}'']+'), lambda w: trim(w, '''')), lambda w: strlen(w) >= 2 AND NOT list_contains({_list(STOPWORDS)}, w))"


def terms(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || '_' || {t}[i + 1]))"


def intent(x: str) -> str:
    s = f"translate(lower({trim(f'coalesce({x}, {chr(39)}{chr(39)})')}), ' -', '__')"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**ALIASES, **{i: i for i in INTENTS}}.items())
    return f"CASE {s} {whens} ELSE 'other' END"


def route(x: str) -> str:
    return f"CASE WHEN lower({trim(x)}) LIKE 'auto%' THEN 'auto' ELSE 'escalate' END"


def draw(key: str, seed: int) -> str:
    return f"('0x' || substr(md5(({key}) || '|{seed}'), 1, 8))::BIGINT"


def r(x: str, places: int = 6) -> str:
    return f"round(({x})::DOUBLE, {places})"


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


EP = "e AS (SELECT DISTINCT episode_id, brand, customer_id, created_at, customer_text, brand_reply, n_turns FROM episodes)"
NUMBER = "regexp_extract({}, '([0-9]+)$', 1)::BIGINT"
SPLIT = "s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY created_at NULLS FIRST, episode_id) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'history' ELSE 'eval_pool' END AS split FROM e WHERE {})"
ORACLES: dict[str, str] = {}

# ---- text ----
ORACLES["clean_text"] = f"SELECT row_no, {clean('text')} AS cleaned FROM messages"
ORACLES["tokenize_counts"] = f"WITH {EP} SELECT token, count(*) AS n FROM (SELECT unnest({tokens('customer_text')}) AS token FROM e) GROUP BY token"
TERMS_E = f"k AS (SELECT episode_id, {tokens('customer_text')} AS t FROM e), c AS (SELECT doc, term, count(*) AS tf FROM (SELECT episode_id AS doc, unnest({terms('t')}) AS term FROM k) GROUP BY ALL)"
ORACLES["bigrams"] = f"WITH {EP}, {TERMS_E} SELECT term, sum(tf)::BIGINT AS n FROM c WHERE contains(term, '_') GROUP BY term"
ORACLES["reply_signature"] = f"WITH {EP} SELECT array_to_string({tokens('brand_reply')}[1:6], ' ') AS signature, count(*) AS n FROM e GROUP BY ALL"
ORACLES["usable_filter_dedupe"] = f"""WITH {EP}, u AS (SELECT *, array_to_string({tokens('customer_text')}, ' ') AS k FROM e WHERE length({trim('customer_text')}) >= 25 AND regexp_matches(customer_text, '[A-Za-z]{{3,}}'))
SELECT episode_id FROM u WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_at NULLS FIRST, episode_id) = 1"""
ORACLES["normalise_intent"] = f"SELECT audit_id, {intent('intent')} AS intent FROM audits"
ORACLES["normalise_route"] = f"SELECT episode_id, system, {route(chr(39) + ' ' + chr(39) + ' || upper(route)')} AS route FROM system_outputs"
ORACLES["parse_label_cmd"] = f"""WITH c AS (SELECT audit_id, CASE audit_id % 3 WHEN 0 THEN list_position({_list(LABELS)}, i) || ' e' WHEN 1 THEN 'zz a ' || i ELSE coalesce(intent, '12') END AS cmd FROM (SELECT *, {intent('intent')} AS i FROM audits)),
t AS (SELECT audit_id, regexp_split_to_array({trim('cmd')}, '\\s+') AS ts FROM c),
p AS (SELECT audit_id, list_filter(list_transform(ts, lambda x: CASE WHEN try_cast(x AS INT) BETWEEN 1 AND 11 THEN {_list(LABELS)}[try_cast(x AS INT)] WHEN list_contains({_list(LABELS)}, x) THEN x END), lambda x: x IS NOT NULL) AS i, list_filter(ts, lambda x: x IN ('a', 'e')) AS r FROM t)
SELECT audit_id, i[-1] AS intent, CASE r[-1] WHEN 'a' THEN 'auto' WHEN 'e' THEN 'escalate' END AS route, len(i) > 0 OR len(r) > 0 AS valid FROM p"""
_GOOD = "grounding BETWEEN 1 AND 5 AND resolution BETWEEN 1 AND 5 AND tone BETWEEN 1 AND 5"
ORACLES["parse_rating"] = "SELECT DISTINCT episode_id, system, " + ", ".join(f"CASE WHEN {_GOOD} THEN {c} END AS {c}" for c in ("grounding", "resolution", "tone", "sendable")) + " FROM judge_scores"
ORACLES["extract_json"] = "SELECT episode_id, system, intent, reply FROM system_outputs"
ORACLES["thread_render"] = """WITH t AS (SELECT episode_id, arg_max(thread, ingested_at) AS thread FROM episodes GROUP BY 1)
SELECT g.episode_id, coalesce(array_to_string(list_transform(thread, lambda x: '  ' || rpad(upper(x.role) || ':', 10, ' ') || coalesce(x.text, '')), chr(10)), '(thread unavailable)') AS shown FROM golden g LEFT JOIN t USING (episode_id)"""

# ---- threads ----
_M = """m AS (SELECT try_cast(trim(tweet_id) AS BIGINT) AS id, author_id AS author, lower(trim(coalesce(inbound, ''))) = 'true' AS inbound,
  coalesce(try_strptime(created_at, '%a %b %d %H:%M:%S %z %Y')::TIMESTAMP, TIMESTAMP '0001-01-01') AS ts, coalesce(text, '') AS text, coalesce(trunc(try_cast(trim(in_response_to_tweet_id) AS DOUBLE))::BIGINT, 0) AS parent
  FROM messages WHERE regexp_matches(trim(tweet_id), '^[+-]?[0-9]+$') QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no DESC) = 1),
f AS (SELECT m.id, CASE WHEN m.parent <> 0 AND p.id IS NOT NULL THEN m.parent ELSE m.id END AS nxt FROM m LEFT JOIN m AS p ON p.id = m.parent),
walk AS (SELECT id, id AS cur, [id] AS path, 0 AS step, false AS stop FROM m
  UNION ALL SELECT w.id, f.nxt, list_append(w.path, f.nxt), w.step + 1, f.nxt = w.cur OR list_contains(w.path, f.nxt) FROM walk w JOIN f ON f.id = w.cur WHERE NOT w.stop AND w.step < 64),
roots AS (SELECT id, cur AS root FROM walk WHERE stop OR step = 64)"""
ORACLES["thread_roots"] = f"WITH RECURSIVE {_M} SELECT id, root FROM roots"
_B = f"""{_M}, j AS (SELECT m.*, root, {clean('text')} AS cleaned FROM m JOIN roots USING (id)),
b AS (SELECT * FROM j WHERE root IN (SELECT root FROM j WHERE author = '{BRAND}')),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts, id) AS k FROM b),
o AS (SELECT root, count(*)::INT AS n_turns, count_if(author = '{BRAND}')::INT AS n_brand_turns, count_if(author <> '{BRAND}' AND inbound)::INT AS n_customer_turns,
  min_by({{'id': id, 'author': author, 'ts': ts, 'inbound': inbound, 'text': cleaned}}, k) AS f, min_by(cleaned, k) FILTER (k > 1 AND author = '{BRAND}') AS reply FROM n GROUP BY root),
built AS (SELECT * FROM o WHERE f.inbound AND reply IS NOT NULL AND length(f.text) >= 15 AND length(reply) >= 15)"""
ORACLES["build_episodes"] = f"""WITH RECURSIVE {_B} SELECT '{BRAND}-' || f.id AS episode_id, '{BRAND}' AS brand, f.author AS customer_id, nullif(f.ts, TIMESTAMP '0001-01-01') AS created_at, f.text AS customer_text, reply AS brand_reply, n_turns, n_brand_turns, n_customer_turns FROM built"""
ORACLES["episode_turn_counts"] = f"WITH RECURSIVE {_B} SELECT n_turns, n_brand_turns, n_customer_turns, count(*) AS episodes FROM built GROUP BY ALL"
ORACLES["temporal_split"] = f"WITH {EP}, {SPLIT.format('true')} SELECT episode_id, split FROM s"

# ---- TF-IDF and search ----
_DF = "df AS (SELECT term, count(*) AS df FROM c GROUP BY term)"


def _fit(n: str, min_df: int, cap: int | None = None) -> str:
    limit = f" ORDER BY df DESC, term LIMIT {cap}" if cap else ""
    return f"{_DF}, v AS (SELECT term, df, (ln((1 + ({n}))::DOUBLE / (1 + df)) + 1)::FLOAT AS idf FROM df WHERE df >= {min_df}{limit})"


def _weigh(counts: str, out: str) -> str:
    return f"{out}_x AS (SELECT doc, term, (1 + ln(tf::DOUBLE)) * idf::DOUBLE AS x FROM {counts} JOIN v USING (term)), {out} AS (SELECT doc, term, (x::FLOAT * (1 / sqrt(sum(x * x) OVER (PARTITION BY doc)))::FLOAT)::FLOAT AS w FROM {out}_x)"


_N = "SELECT count(*) FROM e"
ORACLES["document_frequency"] = f"WITH {EP}, {TERMS_E}, {_DF} SELECT term, df FROM df"
ORACLES["vocabulary_topn"] = f"WITH {EP}, {TERMS_E}, {_fit(_N, 2, 500)} SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM v"
ORACLES["idf"] = f"WITH {EP}, {TERMS_E}, {_fit(_N, 3)} SELECT term, df, {r('idf', 4)} AS idf FROM v"
ORACLES["tfidf_weights"] = f"WITH {EP}, {TERMS_E}, {_fit(_N, 2)}, {_weigh('c', 'w')} SELECT doc AS episode_id, count(*) AS terms, {r('sum(w::DOUBLE * w)', 4)} AS norm, {r('max(w)', 4)} AS top FROM w GROUP BY doc"
_R = f"""{EP}, {SPLIT.format('customer_text IS NOT NULL')}, k AS (SELECT episode_id, split, {tokens('customer_text')} AS t FROM s),
a AS (SELECT split, doc, term, count(*) AS tf FROM (SELECT split, episode_id AS doc, unnest({terms('t')}) AS term FROM k) GROUP BY ALL), c AS (SELECT doc, term, tf FROM a WHERE split = 'history'),
asked AS (SELECT doc, term, tf FROM a WHERE split = 'eval_pool' AND {NUMBER.format('doc')} % 20 = 0), {_fit("SELECT count(*) FROM s WHERE split = 'history'", 2, 60000)}, {_weigh('c', 'h')}, {_weigh('asked', 'q')},
sc AS (SELECT q.doc AS q, h.doc AS doc, sum(q.w::DOUBLE * h.w::DOUBLE) AS score FROM q JOIN h USING (term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) AS rank FROM sc WHERE score > 0)"""
ORACLES["cosine_topk"] = f"WITH {_R} SELECT q AS query_id, doc AS episode_id, {r('score', 4)} AS score, rank FROM rk WHERE rank <= 5"
ORACLES["cosine_topk_allowed"] = f"""WITH {_R}, al AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) AS place FROM sc WHERE score > 0 AND doc IN (SELECT episode_id FROM episodes WHERE n_brand_turns > 1))
SELECT q AS query_id, doc AS episode_id, {r('score', 4)} AS score, place AS rank FROM al WHERE place <= 5"""
ORACLES["top_score"] = f"WITH {_R} SELECT s.episode_id, {r('coalesce(score, 0)', 4)} AS top_score FROM s LEFT JOIN rk ON rk.q = s.episode_id AND rank = 1 WHERE split = 'eval_pool' AND {NUMBER.format('s.episode_id')} % 20 = 0"
ORACLES["precedents_dedup"] = f"""WITH {_R}, g AS (SELECT episode_id AS doc, array_to_string({tokens('brand_reply')}[1:6], ' ') AS signature FROM s),
d AS (SELECT rk.*, row_number() OVER (PARTITION BY q, signature ORDER BY rank) AS twin FROM rk JOIN g USING (doc) WHERE rank <= 48)
SELECT q AS query_id, doc AS episode_id, {r('score', 4)} AS score, row_number() OVER (PARTITION BY q ORDER BY d.rank) AS rank FROM d WHERE twin = 1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY d.rank) <= 6"""
_DENSE = """l AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len, embedding FROM embeddings),
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x::DOUBLE / len)::FLOAT::DOUBLE) AS v FROM l WHERE len > 0),
sc AS (SELECT a.vec_id AS q, b.vec_id AS doc, b.label, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc::VARCHAR) AS rank FROM sc WHERE score > 0)"""
ORACLES["dense_cosine_topk"] = f"WITH {_DENSE} SELECT q, doc, {r('score', 3)} AS score FROM rk WHERE rank <= 3"
ORACLES["knn_majority"] = f"WITH {_DENSE}, n AS (SELECT q, label, count(*) AS n FROM rk WHERE rank <= 5 GROUP BY ALL) SELECT q, label FROM n QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, label) = 1"

# ---- clustering and classification ----
_UNIT = """l AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len, embedding FROM embeddings),
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / len) AS v FROM l WHERE len > 0)"""
ORACLES["kmeans_assign_step"] = f"""WITH {_UNIT}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, v FROM (SELECT * FROM u ORDER BY vec_id LIMIT 10)),
s AS (SELECT u.vec_id, cluster, list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * c.v[i])) AS similarity FROM u, c)
SELECT vec_id, cluster, {r('similarity', 4)} AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, cluster) = 1"""
ORACLES["kmeans_update_step"] = f"""WITH {_UNIT}, x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM u), s AS (SELECT label, dim, sum(x) AS s, count(*) AS size FROM x GROUP BY ALL)
SELECT label::BIGINT AS cluster, dim, {r('s / sqrt(sum(s * s) OVER (PARTITION BY label))', 4)} AS value, size FROM s"""
_DOT = "list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * {}.v[i]))"


def _kmeans_rounds(n: int) -> str:
    sql = f"WITH {_UNIT}, c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, v FROM (SELECT * FROM u ORDER BY vec_id LIMIT 10))"
    for i in range(n):
        sql += f""", a{i} AS (SELECT vec_id, cluster FROM (SELECT u.vec_id, cluster, {_DOT.format(f'c{i}')} AS s FROM u, c{i}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, cluster) = 1),
s{i} AS (SELECT cluster, dim, sum(x) AS s FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM u JOIN a{i} USING (vec_id)) GROUP BY ALL),
c{i + 1} AS (SELECT cluster, coalesce(n.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT cluster, list(x ORDER BY dim) AS v FROM (SELECT cluster, dim, s / sqrt(sum(s * s) OVER (PARTITION BY cluster)) AS x FROM s{i}) GROUP BY 1) n USING (cluster))"""
    return sql + f" SELECT vec_id, cluster FROM a{n - 1}"


ORACLES["kmeans_rounds"] = _kmeans_rounds(3)
ORACLES["kmeans_top_terms"] = f"""WITH {EP}, {TERMS_E}, {_fit(_N, 3, 30000)}, {_weigh('c', 'w')}, s AS (SELECT brand, term, sum(w::DOUBLE) AS s FROM w JOIN e ON e.episode_id = w.doc GROUP BY ALL),
x AS (SELECT brand AS cluster, term, s / sqrt(sum(s * s) OVER (PARTITION BY brand)) AS weight FROM s) SELECT cluster, term, {r('weight', 3)} AS weight FROM x WHERE weight > 0 AND cluster IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 6) DESC, term) <= 12"""
ORACLES["stratified_folds"] = f"""WITH g AS (SELECT episode_id, {intent('gold_intent')} AS label, {draw('episode_id', 3)} AS d FROM golden WHERE gold_intent IS NOT NULL)
SELECT episode_id, label, (row_number() OVER (PARTITION BY label ORDER BY d, episode_id) - 1) % 5 AS fold FROM g"""
ORACLES["softmax_score"] = f"""WITH {_UNIT}, x AS (SELECT vec_id, label, unnest(v) AS w, unnest(range(len(v))) AS dim FROM u), m AS (SELECT label, dim, 4 * avg(w) AS weight FROM x GROUP BY ALL), b AS (SELECT label, ln(count(*)) AS bias FROM embeddings GROUP BY 1),
z AS (SELECT x.vec_id, m.label, sum(w * weight) + any_value(bias) AS z FROM x JOIN m USING (dim) JOIN b ON b.label = m.label GROUP BY ALL), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z)
SELECT vec_id, label::BIGINT AS label, {r('e / sum(e) OVER (PARTITION BY vec_id)', 4)} AS p FROM e"""

# ---- samples ----
ORACLES["uniform_sample"] = f"WITH {EP} SELECT episode_id FROM e ORDER BY {draw('episode_id', 7)}, episode_id LIMIT 120"
ORACLES["balanced_tasks"] = f"""WITH x AS (SELECT system, episode_id, {draw("system || '|' || episode_id", 23)} AS d FROM system_outputs),
n AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY d, episode_id) AS n FROM x)
SELECT system, episode_id, row_number() OVER (ORDER BY d, system, episode_id) AS position FROM n WHERE n <= floor(60 / (SELECT count(DISTINCT system) FROM system_outputs))"""
_FIRED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(customer_text, ''), '{x.re2()}') THEN '{x.name}' END" for x in DEFAULT_RULES) + "], lambda x: x IS NOT NULL)"


def _quota() -> str:
    parts, taken = [], []
    for rule in sorted(x.name for x in DEFAULT_RULES):
        free = "".join(f" AND episode_id NOT IN (SELECT episode_id FROM p_{t})" for t in taken)
        parts.append(f"p_{rule} AS (SELECT '{rule}' AS rule, episode_id FROM f WHERE list_contains(fired, '{rule}'){free} ORDER BY d, episode_id LIMIT 10)")
        taken.append(rule)
    return f"WITH {EP}, f AS (SELECT episode_id, {_FIRED} AS fired, {draw('episode_id', 7)} AS d FROM e WHERE customer_text IS NOT NULL), {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM p_{t}" for t in taken)


ORACLES["rule_quota_sample"] = _quota()
ORACLES["round_robin_clusters"] = "WITH x AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS round FROM embeddings) SELECT * FROM x WHERE round <= 50 ORDER BY round, label LIMIT 40"

# ---- policy and systems ----
ORACLES["rule_hits"] = f"WITH {EP} SELECT rule, count(*) AS n FROM (SELECT unnest({_FIRED}) AS rule FROM e WHERE customer_text IS NOT NULL) GROUP BY rule"
_ESC = _list([i for i, x in INTENTS.items() if x == "escalate"])
_REASON = "CASE x " + " ".join(f"WHEN '{x.name}' THEN '{x.reason}'" for x in DEFAULT_RULES) + " END"
_JOIN = "CASE WHEN len(rs) <= 1 THEN array_to_string(rs, '') WHEN len(rs) = 2 THEN array_to_string(rs, ' and ') ELSE array_to_string(rs[1:len(rs) - 1], ', ') || ', and ' || rs[len(rs)] END"
ORACLES["route_decide"] = f"""WITH a AS (SELECT *, {_FIRED} AS hard, coalesce(confidence, 0) < 0.6 AS g1, coalesce(retrieval_top, 0) < 0.12 AS g2, coalesce(list_contains({_ESC}, intent), false) AS g3 FROM system_outputs),
b AS (SELECT *, list_concat(hard, list_filter([CASE WHEN g1 THEN 'low_intent_confidence' END, CASE WHEN g2 THEN 'no_precedent' END, CASE WHEN g3 THEN 'intent_default_escalate' END], lambda x: x IS NOT NULL)) AS names,
  list_concat(list_transform(hard, lambda x: {_REASON}), list_filter([CASE WHEN g1 THEN 'was classified with little confidence' END, CASE WHEN g2 THEN 'has no similar precedent' END, CASE WHEN g3 THEN 'has intent ' || intent || ', which people handle' END], lambda x: x IS NOT NULL)) AS rs, coalesce(model_route = 'escalate', false) AS me, trim(coalesce(model_reason, '')) AS own FROM a)
SELECT episode_id, system, CASE WHEN len(names) > 0 OR me THEN 'escalate' ELSE 'auto' END AS route,
  CASE WHEN len(names) > 0 THEN 'A person should answer: it ' || {_JOIN} || '.' WHEN me THEN CASE WHEN own = '' THEN 'The model asked for a person.' ELSE own END ELSE 'Answered: intent ' || coalesce(intent, 'other') || ' needs no person and no rule fired.' END AS route_reason,
  CASE WHEN len(names) > 0 THEN array_to_string(names, ',') WHEN me THEN 'model_judgement' ELSE '' END AS fired, len(names) > 0 AND coalesce(model_route = 'auto', false) AS overridden FROM b"""
_J = f"j AS (SELECT o.*, g.gold_intent AS raw_gold, {intent('g.gold_intent')} AS gold_intent, g.gold_route, g.stratum FROM system_outputs o JOIN golden g USING (episode_id) WHERE g.gold_intent IS NOT NULL AND g.gold_intent <> '' AND g.gold_route IS NOT NULL AND g.gold_route <> '')"
ORACLES["rule_precision"] = f"WITH {_J} SELECT system, rule, count(*) AS n, {r('avg(hit)')} AS precision FROM (SELECT system, unnest(fired_rules) AS rule, (gold_route = 'escalate')::INT AS hit FROM j) GROUP BY ALL"


def _route(rows: str, by: str, pred: str) -> str:
    return f"SELECT {by}, count(*) AS n, count_if(gold_route = 'escalate' AND {pred} = 'escalate') AS tp, count_if(gold_route = 'auto' AND {pred} = 'escalate') AS fp, count_if(gold_route = 'escalate' AND {pred} = 'auto') AS fn, count_if(gold_route = 'auto' AND {pred} = 'auto') AS tn FROM {rows} WHERE gold_route IN ('auto', 'escalate') AND {pred} IN ('auto', 'escalate') GROUP BY ALL"


ORACLES["ablation_model_only"] = f"""WITH {_J}, x AS (SELECT *, CASE WHEN trim(coalesce(model_route, '')) = '' THEN route ELSE model_route END AS alone FROM j), o AS (SELECT system, count_if(overridden) AS overrides FROM x GROUP BY 1),
t AS (SELECT *, 'with_rules' AS variant FROM ({_route('x', 'system', 'route')}) UNION ALL SELECT *, 'model_only' AS variant FROM ({_route('x', 'system', 'alone')}))
SELECT system, variant, n, tp, fp, fn, tn, {r(div('fn', 'tn + fn'))} AS false_auto_rate, overrides FROM t JOIN o USING (system)"""
_TOP = f"SELECT x FROM (SELECT {intent('gold_intent')} AS x, count(*) AS n FROM golden WHERE gold_intent IS NOT NULL GROUP BY 1) ORDER BY n DESC, x LIMIT 1"
ORACLES["majority_label"] = f"SELECT coalesce(({_TOP}), 'other') AS label"
ORACLES["trivial_system"] = f"SELECT episode_id, 'trivial-' || route AS system, coalesce(({_TOP}), 'other') AS intent, 1.0::DOUBLE AS confidence, '{CANNED}' AS reply, route FROM golden, (VALUES ('auto'), ('escalate')) AS r(route)"
ORACLES["request_keys"] = """SELECT episode_id, sha256('{"model":"m","system":"s","prompt":"' || episode_id || '","max_tokens":16,"temperature":0.0}') AS key FROM golden WHERE customer_text IS NOT NULL"""
ORACLES["cache_hits_misses"] = """WITH a AS (SELECT DISTINCT customer_text FROM golden WHERE customer_text IS NOT NULL), k AS (SELECT DISTINCT customer_text FROM golden WHERE stratum = 'random' AND customer_text IS NOT NULL)
SELECT hit, count(*) AS n, count_if(NOT hit) AS failed FROM (SELECT a.customer_text IN (SELECT customer_text FROM k) AS hit FROM a) GROUP BY hit"""
_MENU = f"chr(10) || chr(10) || 'Intents: {', '.join(LABELS)}' || chr(10) || 'Answer as JSON with intent, route, reason, reply and confidence.'"
_STUB = f"""('0x' || substr(md5(prompt), 1, 8))::BIGINT"""


def _ask(shown: str) -> str:
    return f"'Message:' || chr(10) || customer_text || chr(10) || chr(10) || 'Earlier answers:' || chr(10) || {shown} || {_MENU}"


ORACLES["stub_complete"] = f"""WITH p AS (SELECT episode_id, {_ask("'(none)'")} AS prompt FROM golden WHERE customer_text IS NOT NULL)
SELECT episode_id, {_list(LABELS)}[{_STUB} % {len(LABELS)} + 1] AS intent, NULL::VARCHAR AS error FROM p"""


def _agent(name: str, shown: str) -> str:
    """The agent over its nearest precedents of all history; the stub answers by the prompt's hash."""
    return f"""WITH {EP}, {SPLIT.format('customer_text IS NOT NULL')}, k AS (SELECT episode_id, split, {tokens('customer_text')} AS t FROM s),
c AS (SELECT doc, term, count(*) AS tf FROM (SELECT episode_id AS doc, unnest({terms('t')}) AS term FROM k WHERE split = 'history') GROUP BY ALL), g AS (SELECT DISTINCT episode_id, customer_text FROM golden WHERE customer_text IS NOT NULL),
gk AS (SELECT episode_id, {tokens('customer_text')} AS t FROM g), asked AS (SELECT doc, term, count(*) AS tf FROM (SELECT episode_id AS doc, unnest({terms('t')}) AS term FROM gk) GROUP BY ALL),
{_fit("SELECT count(*) FROM s WHERE split = 'history'", 2, 60000)}, {_weigh('c', 'h')}, {_weigh('asked', 'q')},
sc AS (SELECT q.doc AS q, h.doc AS doc, sum(q.w::DOUBLE * h.w::DOUBLE) AS score FROM q JOIN h USING (term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 48),
d AS (SELECT rk.*, s.customer_text AS customer, coalesce(s.brand_reply, '') AS reply, row_number() OVER (PARTITION BY q, array_to_string({tokens("coalesce(s.brand_reply, '')")}[1:6], ' ') ORDER BY rank) AS twin FROM rk JOIN s ON s.episode_id = rk.doc),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS place FROM d WHERE twin = 1 QUALIFY place <= 6),
li AS (SELECT q AS episode_id, string_agg(format('{{}}. ({{:.2f}}) customer: {{}}' || chr(10) || '   reply: {{}}', place, score, customer, reply), chr(10) ORDER BY place) AS lines, max(score) FILTER (place = 1) AS best FROM n GROUP BY 1),
p AS (SELECT g.episode_id, customer_text, {_ask(shown)} AS prompt, coalesce(best, 0) AS top_score FROM g LEFT JOIN li USING (episode_id)),
b AS (SELECT *, {_list(LABELS)}[{_STUB} % {len(LABELS)} + 1] AS intent, CASE WHEN {_STUB} % 3 = 0 THEN 'escalate' ELSE 'auto' END AS model_route, ({_STUB} % 100) / 100 AS confidence, {_FIRED} AS hard FROM p),
e2 AS (SELECT *, list_concat(hard, list_filter([CASE WHEN confidence < 0.6 THEN 'low_intent_confidence' END, CASE WHEN top_score < 0.12 THEN 'no_precedent' END, CASE WHEN list_contains({_ESC}, intent) THEN 'intent_default_escalate' END], lambda x: x IS NOT NULL)) AS names,
  list_concat(list_transform(hard, lambda x: {_REASON}), list_filter([CASE WHEN confidence < 0.6 THEN 'was classified with little confidence' END, CASE WHEN top_score < 0.12 THEN 'has no similar precedent' END, CASE WHEN list_contains({_ESC}, intent) THEN 'has intent ' || intent || ', which people handle' END], lambda x: x IS NOT NULL)) AS rs FROM b)
SELECT episode_id, customer_text, '{name}' AS system, intent, confidence, '' AS reply, CASE WHEN len(names) > 0 OR model_route = 'escalate' THEN 'escalate' ELSE 'auto' END AS route,
  CASE WHEN len(names) > 0 THEN 'A person should answer: it ' || {_JOIN} || '.' WHEN model_route = 'escalate' THEN 'The model asked for a person.' ELSE 'Answered: intent ' || intent || ' needs no person and no rule fired.' END AS route_reason,
  CASE WHEN len(names) > 0 THEN array_to_string(names, ',') WHEN model_route = 'escalate' THEN 'model_judgement' ELSE '' END AS fired_rules, len(names) > 0 AND model_route = 'auto' AS overridden, model_route, {r('top_score', 4)} AS top_score, NULL::VARCHAR AS error FROM e2"""


ORACLES["agent_system"] = _agent("agent", "coalesce(lines, '(none)')")
ORACLES["agent_no_retrieval"] = _agent("agent-no-retrieval", "'(none)'")
ORACLES["system_driver"] = "SELECT episode_id, system, 'other' AS intent, substr(system, 9) AS route FROM golden, (VALUES ('trivial-auto'), ('trivial-escalate')) AS t(system)"
ORACLES["selected_systems"] = "SELECT episode_id, system, route FROM system_outputs WHERE system IN ('agent', 'simple')"
ORACLES["first_messages"] = "SELECT episode_id, stratum FROM golden ORDER BY episode_id LIMIT 25"
ORACLES["auto_shares"] = f"SELECT system, count(*) AS n, {r('coalesce(avg((route = ' + chr(39) + 'auto' + chr(39) + ')::INT), 0)')} AS auto_share FROM system_outputs GROUP BY 1"
_TOLD = f"t AS (SELECT episode_id, {trim('coalesce(delta_reply, ' + chr(39) * 2 + ')')} AS reference FROM golden)"
ORACLES["reference_rows"] = f"WITH {_TOLD} SELECT o.episode_id, system, reply, reference FROM system_outputs o LEFT JOIN t USING (episode_id) UNION ALL SELECT episode_id, 'human-reference', reference, NULL FROM t"
ORACLES["golden_rows"] = f"""WITH {EP}, d AS (SELECT episode_id FROM e ORDER BY {draw('episode_id', 7)}, episode_id LIMIT 120)
SELECT episode_id, 'random' AS stratum, 'uniform draw' AS stratum_note, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, customer_text, brand_reply AS delta_reply, n_turns, '' AS gold_intent, '' AS gold_route, '' AS gold_reason, '' AS label_source FROM d JOIN e USING (episode_id) ORDER BY episode_id"""
ORACLES["draft_summary"] = f"""WITH x AS (SELECT stratum, {intent('draft_intent')} AS intent, {route("coalesce(draft_route, '')")} AS route, passes_agreed::INT AS agreed FROM golden),
z AS (SELECT stratum, intent, route, grouping(stratum, intent, route) AS gid, count(*) AS n, {r('avg(agreed)')} AS agree FROM x GROUP BY GROUPING SETS ((intent), (route), (stratum, route)))
SELECT CASE gid WHEN 5 THEN 'intent' WHEN 6 THEN 'route' ELSE 'stratum_route' END AS kind, stratum, intent, route, n, agree FROM z"""
_D = {p: (f"({intent(i)})", f"({route('coalesce(' + t + ', ' + chr(39) * 2 + ')')})") for p, i, t in (("a", "pass_a_intent", "pass_a_route"), ("b", "pass_b_intent", "pass_b_route"), ("c", "human_intent", "human_route"))}
_AGREE = f"({_D['a'][0]} = {_D['b'][0]} AND {_D['a'][1]} = {_D['b'][1]})"
ORACLES["draft_labels"] = f"""SELECT episode_id, {_D['a'][0]} AS pass_a_intent, {_D['a'][1]} AS pass_a_route, {_D['b'][0]} AS pass_b_intent, {_D['b'][1]} AS pass_b_route, {_AGREE} AS passes_agreed, CASE WHEN {_AGREE} THEN 'easy' ELSE 'hard' END AS difficulty,
  CASE WHEN {_AGREE} OR human_intent IS NULL THEN {_D['a'][0]} ELSE {_D['c'][0]} END AS draft_intent, CASE WHEN {_AGREE} THEN {_D['a'][1]} WHEN human_intent IS NULL THEN 'escalate' ELSE {_D['c'][1]} END AS draft_route, pass_a_intent IS NULL OR pass_b_intent IS NULL AS pass_error FROM golden"""
_G1 = "g AS (SELECT episode_id, system, max({'composite': composite, 'grounding': grounding, 'resolution': resolution, 'tone': tone, 'sendable': sendable}) AS g FROM judge_scores GROUP BY ALL)"
_BLANK = f"({trim('coalesce(reply, ' + chr(39) * 2 + ')')} = '')"
ORACLES["judge_replies"] = f"""WITH {_G1}, x AS (SELECT o.episode_id, o.system, {', '.join(f"CASE WHEN {_BLANK} THEN 1 WHEN g.g IS NULL THEN NULL ELSE least(greatest(g.g.{c}, 1), 5) END::INT AS {c}" for c in ('grounding', 'resolution', 'tone'))}, CASE WHEN {_BLANK} THEN false ELSE coalesce(g.g.sendable, false) END AS sendable FROM system_outputs o LEFT JOIN g USING (episode_id, system) WHERE system LIKE 'agent%')
SELECT *, {r('0.5 * grounding + 0.3 * resolution + 0.2 * tone')} AS composite FROM x"""
ORACLES["resume_upsert"] = "SELECT episode_id, CASE WHEN reviewed THEN human_intent ELSE draft_intent END AS intent, coalesce(reviewed, false) AS reviewed FROM golden"
ORACLES["anti_done"] = "SELECT episode_id FROM golden WHERE episode_id NOT IN (SELECT episode_id FROM audits WHERE episode_id IS NOT NULL)"

# ---- metrics ----
_CELLS = f"c AS (SELECT system, gold_intent AS gold, intent AS pred, count(*) AS n FROM j WHERE list_contains({_list(LABELS)}, gold_intent) AND list_contains({_list(LABELS)}, intent) GROUP BY ALL)"
ORACLES["confusion"] = f"WITH {_J}, {_CELLS} SELECT system, gold, pred, n FROM c"


def _report(cells: str, by: str) -> str:
    on = " AND ".join(f"z.{b} = {{0}}.{b}" for b in by.split(", "))
    return f"""rg AS (SELECT {by}, gold AS label, sum(n) AS support, sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS hits FROM {cells} GROUP BY ALL), rp AS (SELECT {by}, pred AS label, sum(n) AS predicted FROM {cells} GROUP BY ALL),
z AS (SELECT DISTINCT {', '.join(by.split(', '))}, l.label FROM {cells}, (SELECT unnest({_list(LABELS)}) AS label) l),
y AS (SELECT z.*, coalesce(support, 0)::BIGINT AS support, coalesce(predicted, 0)::BIGINT AS predicted, coalesce(hits, 0)::BIGINT AS hits FROM z LEFT JOIN rg ON {on.format('rg')} AND z.label = rg.label LEFT JOIN rp ON {on.format('rp')} AND z.label = rp.label),
rep AS (SELECT *, {div('hits', 'predicted')} AS precision, {div('hits', 'support')} AS recall, {div('2 * (' + div('hits', 'predicted') + ') * (' + div('hits', 'support') + ')', '(' + div('hits', 'predicted') + ') + (' + div('hits', 'support') + ')')} AS f1 FROM y)"""


ORACLES["class_report"] = f"WITH {_J}, {_CELLS}, {_report('c', 'system')} SELECT system, label, support, predicted, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM rep"
_PARTS = "p AS (SELECT *, unnest(['overall', CASE WHEN stratum = 'random' THEN 'random' ELSE 'targeted' END]) AS part FROM j)"
_CELLS2 = _CELLS.replace("SELECT system,", "SELECT system, part,").replace("FROM j", "FROM p")
ORACLES["system_metrics"] = f"""WITH {_J}, {_PARTS}, {_CELLS2}, {_report('c', 'system, part')},
m AS (SELECT system, part, sum(support)::BIGINT AS n_intent, {div('sum(hits)', 'sum(support)')} AS acc, coalesce(avg(f1) FILTER (support > 0), 0) AS mf, {div('sum(f1 * support)', 'sum(support)')} AS wf FROM rep GROUP BY ALL), t AS ({_route('p', 'system, part', 'route')})
SELECT system, part, n_intent, {r('acc')} AS intent_accuracy, {r('mf')} AS macro_f1, {r('wf')} AS weighted_f1, {r(div('tn + fn', 'n'))} AS auto_rate, {r(div('fn', 'tn + fn'))} AS false_auto_rate, {r(div('tp', 'tp + fn'))} AS escalation_recall FROM m FULL JOIN t USING (system, part)"""
ORACLES["routing_metrics"] = f"""WITH {_J}, t AS ({_route('j', 'system', 'route')}) SELECT system, n, tp, fp, fn, tn, {r(div('tn + fn', 'n'))} AS auto_rate, {r(div('fn', 'tn + fn'))} AS false_auto_rate, {r(div('tp', 'tp + fn'))} AS escalation_recall, {r(div('tp', 'tp + fp'))} AS escalation_precision,
{r(div('2 * tp', '2 * tp + fp + fn'))} AS escalation_f1, {r(div('fp', 'fp + tn'))} AS over_escalation, {r(div('tp + tn', 'n'))} AS accuracy, {r(div('tn', 'tn + fn'))} AS auto_precision FROM t"""


def _wilson(k: str, n: str, sign: str) -> str:
    p = div(k, n)
    edge = f"({p} + {Z * Z} / (2 * {n}) {sign} {Z}::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4.0 * {n} * {n}))) / (1 + {Z * Z} / {n})"
    return f"CASE WHEN {n} > 0 THEN {'greatest(0, ' if sign == '-' else 'least(1, '}{edge}) ELSE 0 END"


ORACLES["wilson_ci"] = f"WITH x AS (SELECT system, count_if(sendable) AS k, count(*) AS n FROM judge_scores GROUP BY 1) SELECT system, k, n, {r(_wilson('k', 'n', '-'))} AS low, {r(_wilson('k', 'n', '+'))} AS high FROM x"
_TABLE = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in poisson_table()) + "]"


def _resampled(n: str, key: str, seed: int) -> str:
    u, v = f"(({draw(key, seed)} + 0.5) / 4294967296.0::DOUBLE)", f"(({draw('(' + key + ') || chr(39)', seed)} + 0.5) / 4294967296.0::DOUBLE)"
    few = f"len(list_filter(poisson.t[least({n}, {EXACT}) + 1], lambda x: x < {u}))"
    return f"CASE WHEN {n} <= {EXACT} THEN {few} ELSE greatest(0, round({n} + sqrt({n}::DOUBLE) * sqrt(-2 * ln({u})) * cos(2 * pi() * {v})))::BIGINT END"


def _bootstrap(values: str) -> str:
    """``system, n, mean, low, high`` of ``v`` by system in ``values``."""
    return f"""poisson AS (SELECT {_TABLE} AS t), bv AS (SELECT system, round(v::DOUBLE * 1000000)::BIGINT AS v, count(*) AS c FROM {values} WHERE v IS NOT NULL GROUP BY ALL), bz AS (SELECT system, sum(c)::BIGINT AS n, sum(c * v)::DOUBLE / sum(c) / 1e6 AS mean FROM bv GROUP BY 1),
bw AS (SELECT system, b, v, {_resampled('c', "system || ':' || b || ':' || v", 29)} AS w FROM bv, poisson, (SELECT unnest(range({BOOTSTRAP})) AS b)),
bm AS (SELECT system, b, coalesce(sum(w * v)::DOUBLE / nullif(sum(w), 0) / 1e6, any_value(mean)) AS m FROM bw JOIN bz USING (system) GROUP BY ALL), bo AS (SELECT system, list_sort(list(m)) AS ms FROM bm GROUP BY 1)
SELECT system, n, {r('mean', 4)} AS mean, {r(f'ms[{int(0.025 * BOOTSTRAP) + 1}]', 4)} AS low, {r(f'ms[{int(0.975 * BOOTSTRAP) + 1}]', 4)} AS high FROM bz JOIN bo USING (system)"""


ORACLES["bootstrap_ci"] = f"WITH b0 AS (SELECT system, episode_id, max(composite) AS v FROM judge_scores WHERE grounding > 0 GROUP BY ALL), {_bootstrap('b0')}"
ORACLES["composite_intervals"] = f"WITH b0 AS (SELECT system, episode_id, max(composite) AS v FROM judge_scores WHERE (error IS NULL OR error = '') AND grounding > 0 GROUP BY ALL), {_bootstrap('b0')}"
_CELL = "system || ':' || part || ':' || gold || ':' || pred || ':' || b"
ORACLES["system_intervals"] = f"""WITH {_J}, {_PARTS}, {_CELLS2}, poisson AS (SELECT {_TABLE} AS t),
x AS (SELECT system, part, gold, pred, b, {_resampled('n', _CELL, 17)} AS s, {_resampled('n', _CELL, 19)} AS w FROM c, poisson, (SELECT unnest(range({BOOTSTRAP})) AS b)),
a AS (SELECT system, part, b, {div('sum(CASE WHEN gold = pred THEN s ELSE 0 END)', 'sum(s)')} AS a FROM x GROUP BY ALL),
l AS (SELECT system, part, b, label, sum(su) AS su, sum(pr) AS pr, sum(h) AS h FROM (SELECT system, part, b, gold AS label, w AS su, 0 AS pr, CASE WHEN gold = pred THEN w ELSE 0 END AS h FROM x UNION ALL SELECT system, part, b, pred, 0, w, 0 FROM x) GROUP BY ALL),
f AS (SELECT system, part, b, coalesce(avg({div('2 * h', 'su + pr')}) FILTER (su > 0), 0) AS f FROM l GROUP BY ALL),
o AS (SELECT system, part, list_sort(list(a)) AS aa, list_sort(list(f)) AS ff FROM a JOIN f USING (system, part, b) GROUP BY ALL)
SELECT system, part, {', '.join(f"{r(f'{xs}[{int(q * BOOTSTRAP) + 1}]', 4)} AS {name}_{end}" for xs, name in (('aa', 'accuracy'), ('ff', 'macro_f1')) for q, end in ((0.025, 'low'), (0.975, 'high')))} FROM o"""
_P = f"p AS (SELECT stratum, {intent('pass_a_intent')} AS a, {intent('pass_b_intent')} AS b FROM golden WHERE pass_a_intent IS NOT NULL AND pass_b_intent IS NOT NULL)"
ORACLES["agreement"] = f"WITH {_P} SELECT stratum, count(*) AS n, {r('avg((a = b)::INT)')} AS agree FROM p GROUP BY 1"


def _kappa(rows: str, by: str) -> str:
    return f"""t AS (SELECT {by}, count(*) AS n, count_if(a = b) AS same FROM {rows} GROUP BY 1), xa AS (SELECT {by}, a AS l, count(*) AS na FROM {rows} GROUP BY ALL), xb AS (SELECT {by}, b AS l, count(*) AS nb FROM {rows} GROUP BY ALL),
pr AS (SELECT {by}, sum(na::DOUBLE * nb) AS s FROM xa JOIN xb USING ({by}, l) GROUP BY 1), kk AS (SELECT {by}, n, same::DOUBLE / n AS po, coalesce(s, 0) / (n::DOUBLE * n) AS pe FROM t LEFT JOIN pr USING ({by}))"""


_KV = "CASE WHEN pe >= 1 - 1e-12 THEN 1 ELSE (po - pe) / (1 - pe) END"
ORACLES["cohen_kappa"] = f"WITH {_P}, {_kappa('p', 'stratum')} SELECT stratum, n, {r(_KV)} AS kappa FROM kk"
_O = "x AS (SELECT system, grounding AS a, tone AS b, composite AS c FROM judge_scores WHERE grounding > 0)"
ORACLES["ordinal_agreement"] = f"WITH {_O} SELECT system, count(*) AS n, {r('avg((a = b)::INT)')} AS exact, {r('avg((abs(a - b) <= 1)::INT)')} AS within_one, {r('avg(abs(a - b))')} AS mae, {r('avg(a)')} AS mean_a, {r('avg(b)')} AS mean_b, {r('avg(a - b)')} AS bias FROM x WHERE a - b IS NOT NULL GROUP BY 1"


def _qk(rows: str, by: str) -> str:
    level = "least(greatest(round({}::DOUBLE), 1), 5)"
    return f"""ql AS (SELECT {by}, {level.format('a')} AS x, {level.format('b')} AS y FROM {rows} WHERE a IS NOT NULL AND b IS NOT NULL), qo AS (SELECT {by}, avg((x - y) ^ 2) AS seen, count(*) AS n FROM ql GROUP BY 1),
qx AS (SELECT {by}, x, count(*) AS nx FROM ql GROUP BY ALL), qy AS (SELECT {by}, y, count(*) AS ny FROM ql GROUP BY ALL), qe AS (SELECT {by}, sum(nx::DOUBLE * ny * (x - y) ^ 2) AS e FROM qx JOIN qy USING ({by}) GROUP BY 1),
qk AS (SELECT {by}, n, CASE WHEN e = 0 THEN 1 ELSE 1 - seen / (e / (n::DOUBLE * n)) END AS kappa FROM qo JOIN qe USING ({by}))"""


ORACLES["quadratic_kappa"] = f"WITH {_O}, {_qk('x', 'system')} SELECT system, n, {r('kappa')} AS kappa FROM qk"
_CORR = "CASE WHEN min({0}) = max({0}) OR min({1}) = max({1}) THEN 0 ELSE corr({0}::DOUBLE, {1}::DOUBLE) END"
ORACLES["pearson"] = f"WITH {_O} SELECT system, count(*) AS n, {r(_CORR.format('a', 'c'))} AS pearson FROM x WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY 1"
ORACLES["spearman"] = f"""WITH {_O}, k AS (SELECT system, rank() OVER (PARTITION BY system ORDER BY a) + (count(*) OVER (PARTITION BY system, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY system ORDER BY c) + (count(*) OVER (PARTITION BY system, c) - 1) / 2.0 AS rc FROM x WHERE a IS NOT NULL AND c IS NOT NULL)
SELECT system, count(*) AS n, {r(_CORR.format('ra', 'rc'))} AS spearman FROM k GROUP BY 1"""
_BINS = "VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
ORACLES["calibration_bins"] = f"""WITH {_J}, b AS (SELECT * FROM ({_BINS}) AS b(bin, lo, hi)), s AS (SELECT DISTINCT system FROM j)
SELECT s.system, bin::BIGINT AS bin, count(j.confidence) AS n, {r('coalesce(avg(j.confidence), 0)')} AS mean_confidence, {r('coalesce(avg((j.intent = j.gold_intent)::INT), 0)')} AS accuracy FROM s CROSS JOIN b LEFT JOIN j ON j.system = s.system AND confidence >= lo AND confidence < hi GROUP BY ALL"""
_BEST = "best AS (SELECT system, episode_id, max({'composite': composite, 'grounding': grounding, 'resolution': resolution, 'tone': tone, 'sendable': sendable, 'violation': coalesce(violation, '')}) AS s FROM judge_scores WHERE (error IS NULL OR error = '') AND grounding > 0 GROUP BY ALL)"
ORACLES["judge_aggregate"] = f"""WITH {_BEST}, o AS (SELECT DISTINCT system, episode_id, route FROM system_outputs), x AS (SELECT best.system, s, route FROM best LEFT JOIN o USING (system, episode_id)),
a AS (SELECT system, count(*) AS n, count_if(s.sendable) AS k, count_if(route = 'auto') AS auto_n, count_if(route = 'auto' AND s.sendable) AS ak, avg(s.grounding) AS g, avg(s.resolution) AS re, avg(s.tone) AS t, avg(s.composite) AS c, count_if(s.violation <> '') AS v FROM x GROUP BY 1)
SELECT system, n, auto_n, {r('g')} AS grounding, {r('re')} AS resolution, {r('t')} AS tone, {r('c')} AS composite, {r(div('k', 'n'))} AS sendable, {r(_wilson('k', 'n', '-'))} AS sendable_low, {r(_wilson('k', 'n', '+'))} AS sendable_high, {r(div('v', 'n'))} AS violations, {r(div('ak', 'auto_n'))} AS auto_sendable FROM a"""
ORACLES["judge_human_agreement"] = f"""WITH s AS (SELECT system, episode_id, max({{'composite': composite, 'grounding': grounding, 'resolution': resolution, 'tone': tone, 'sendable': sendable}}) AS g FROM judge_scores WHERE grounding > 0 GROUP BY ALL),
w AS (SELECT a.g AS x, b.g AS y FROM s a JOIN s b USING (episode_id) WHERE a.system = 'agent' AND b.system = 'agent-no-retrieval'),
x AS (SELECT 'grounding' AS dimension, x.grounding AS a, y.grounding AS b FROM w UNION ALL SELECT 'resolution', x.resolution, y.resolution FROM w UNION ALL SELECT 'tone', x.tone, y.tone FROM w), {_qk('x', 'dimension')},
o AS (SELECT dimension, count(*) AS n, {r('avg((a = b)::INT)')} AS exact, {r('avg(abs(a - b))')} AS mae FROM x WHERE a - b IS NOT NULL GROUP BY 1),
rk AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM (SELECT x.composite AS a, y.composite AS b FROM w WHERE x.composite IS NOT NULL AND y.composite IS NOT NULL)),
se AS (SELECT 'sendable' AS dimension, x.sendable AS a, y.sendable AS b FROM w WHERE x.sendable IS NOT NULL AND y.sendable IS NOT NULL), {_kappa('se', 'dimension')}
SELECT dimension, o.n, exact, mae, {r('kappa')} AS kappa, NULL::DOUBLE AS rho FROM o JOIN qk USING (dimension)
UNION ALL SELECT 'composite', count(*), NULL, NULL, NULL, {r(_CORR.format('ra', 'rb'))} FROM rk HAVING count(*) > 0
UNION ALL SELECT dimension, n, {r('po')}, NULL, {r(_KV)}, NULL FROM kk"""
ORACLES["label_quality"] = f"""WITH p AS (SELECT 'anchored' AS kind, {intent('draft_intent')} AS a, {intent('human_intent')} AS b FROM golden WHERE reviewed AND draft_intent IS NOT NULL AND human_intent IS NOT NULL
UNION ALL SELECT 'blind', {intent('base')}, {intent('i')} FROM (SELECT a.intent AS i, coalesce(nullif(g.draft_intent, ''), g.gold_intent) AS base FROM audits a JOIN golden g USING (episode_id) WHERE a.intent IS NOT NULL) WHERE base IS NOT NULL), {_kappa('p', 'kind')} SELECT kind, n, {r('po')} AS agree, {r(_KV)} AS kappa FROM kk"""
ORACLES["golden_stats"] = f"""WITH g AS (SELECT stratum, CASE WHEN gold_intent IS NOT NULL THEN {intent('gold_intent')} END AS intent, gold_route AS route, reviewed, human_changed, passes_agreed FROM golden), x AS (SELECT grouping(stratum, intent, route) AS gid, stratum, intent, route, count(*) AS n, count_if(reviewed) AS reviewed, count_if(human_changed) AS changed, count_if(passes_agreed) AS agreed FROM g GROUP BY GROUPING SETS ((stratum), (intent), (route), (stratum, route)))
SELECT CASE gid WHEN 3 THEN 'stratum' WHEN 5 THEN 'intent' WHEN 6 THEN 'route' ELSE 'stratum_route' END AS kind, stratum, intent, route, n, reviewed, changed, agreed FROM x"""
ORACLES["failure_gallery"] = f"""WITH {_J}, l AS (SELECT DISTINCT system, episode_id FROM judge_scores WHERE grounding BETWEEN 1 AND 2), x AS (SELECT j.*, l.system IS NOT NULL AS low FROM j LEFT JOIN l ON l.system = j.system AND l.episode_id = j.episode_id),
k AS (SELECT episode_id, system, intent, gold_intent, route, gold_route, unnest(list_filter([CASE WHEN route = 'auto' AND gold_route = 'escalate' THEN 'false_auto' END, CASE WHEN low THEN 'ungrounded' END, CASE WHEN intent <> gold_intent AND confidence >= 0.9 THEN 'confident_mistake' END, CASE WHEN route = 'escalate' AND gold_route = 'auto' THEN 'over_escalation' END, CASE WHEN retrieval_top < 0.12 THEN 'no_precedent' END], lambda x: x IS NOT NULL)) AS kind FROM x)
SELECT kind, system, episode_id, intent, gold_intent, route, gold_route FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY system, episode_id, intent) <= CASE kind WHEN 'no_precedent' THEN 4 ELSE 5 END"""
ORACLES["confusion_pivot"] = f"WITH {_J}, {_CELLS} SELECT system, gold, " + ", ".join(f"coalesce(sum(n) FILTER (pred = '{x}'), 0)::BIGINT AS {x}" for x in LABELS) + " FROM c GROUP BY ALL"
ORACLES["jsonl_round_trip"] = f"WITH {EP} SELECT episode_id, customer_text, brand_reply, n_turns::BIGINT AS n_turns FROM e"
ORACLES["triage_rates"] = f"""WITH x AS (SELECT ingested_at, {_FIRED.replace('customer_text', 'text')} AS fired FROM messages WHERE text IS NOT NULL AND ingested_at IS NOT NULL)
SELECT date_trunc('day', ingested_at)::TIMESTAMP AS start, count(*) AS n, count_if(len(fired) > 0) AS escalated FROM x GROUP BY 1"""

# counts as BIGINT, like Spark's
ORACLES = {name: sql.replace("count_if(", "count(*) FILTER (") for name, sql in ORACLES.items()}
