"""The query catalogue of the core operators. Every query runs over its whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.functions import text
from deskloom.operators import complete, learning, metrics, policy, sampling, search, systems, threads, tfidf
from deskloom.plans import pipelines, report
from deskloom.runtime import cut, shared_dir, table
from deskloom.sources import io
from deskloom.streaming import intake

BRAND = "AeroLumen"
#: Terms of the retrieval vocabulary at most: a table of so many rows is broadcast.
VOCABULARY = 60_000
LABELS = list(text.INTENTS)
EPISODE = ["brand", "customer_id", "created_at", "customer_text", "brand_reply", "n_turns"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def episodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each episode once, however often it was delivered; only ``columns`` beside the id are read and shuffled."""
    return table(spark, d, "episodes").select("episode_id", *columns).distinct()


def long(c: Column) -> Column:
    return c.cast("long")


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c.cast("double"), places)


# ---- text ----


@query
def clean_text(spark, d):
    return table(spark, d, "messages").select("row_no", text.clean(F.col("text")).alias("cleaned"))


@query
def tokenize_counts(spark, d):
    return episodes(spark, d, "customer_text").select(F.explode(text.tokenize(F.col("customer_text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def bigrams(spark, d):
    terms = text.analyze(text.tokenize(F.col("customer_text")))
    return episodes(spark, d, "customer_text").select(F.explode(terms).alias("term")).where(F.col("term").contains("_")).groupBy("term").agg(F.count("*").alias("n"))


@query
def reply_signature(spark, d):
    return episodes(spark, d, "brand_reply").groupBy(text.signature(text.tokenize(F.col("brand_reply"))).alias("signature")).agg(F.count("*").alias("n"))


@query
def usable_filter_dedupe(spark, d):
    """Messages worth labelling, one per wording, the earliest."""
    usable = episodes(spark, d, "created_at", "customer_text").where((F.length(text.trim_space(F.col("customer_text"))) >= 25) & F.col("customer_text").rlike("[A-Za-z]{3,}"))
    return sampling.keep_first(usable, key=text.dedupe_key(text.tokenize(F.col("customer_text"))), order=["created_at", "episode_id"]).select("episode_id")


@query
def normalise_intent(spark, d):
    return table(spark, d, "audits").select("audit_id", text.normalise_intent(F.col("intent")).alias("intent"))


@query
def normalise_route(spark, d):
    return table(spark, d, "system_outputs").select("episode_id", "system", text.normalise_route(F.concat(F.lit(" "), F.upper("route"), F.lit("-reply"))).alias("route"))


@query
def parse_label_cmd(spark, d):
    """Commands made from the audits: the intent's name or place, and a route."""
    place = F.array_position(F.array(*map(F.lit, LABELS)), text.normalise_intent(F.col("intent")))
    command = F.when(F.col("audit_id") % 3 == 0, F.concat(place.cast("string"), F.lit(" e"))).when(F.col("audit_id") % 3 == 1, F.concat(F.lit("zz a "), text.normalise_intent(F.col("intent")))).otherwise(F.coalesce("intent", F.lit("12")))
    x = table(spark, d, "audits").select("audit_id", text.parse_label_command(command).alias("p"))
    return x.select("audit_id", "p.intent", "p.route", "p.valid")


@query
def parse_rating(spark, d):
    typed = F.concat_ws(" ", "grounding", "resolution", "tone", F.when(F.col("sendable"), "y").otherwise("n"))
    return table(spark, d, "judge_scores").select("episode_id", "system", text.parse_rating(typed).alias("p")).select("episode_id", "system", "p.grounding", "p.resolution", "p.tone", "p.sendable").distinct()


@query
def extract_json(spark, d):
    """Answers in a code fence, in prose and bare; the object comes back out."""
    body = F.to_json(F.struct("intent", F.col("reply").alias("reply")))
    wrapped = F.when(F.length("episode_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(F.length("episode_id") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" as asked }"))).otherwise(body)
    x = table(spark, d, "system_outputs").select("episode_id", "system", text.extract_json(wrapped).alias("j"))
    return x.select("episode_id", "system", F.get_json_object("j", "$.intent").alias("intent"), F.get_json_object("j", "$.reply").alias("reply"))


@query
def thread_render(spark, d):
    """Golden items with their thread as text."""
    t = table(spark, d, "episodes").select("episode_id", "thread", "ingested_at").groupBy("episode_id").agg(F.max_by("thread", "ingested_at").alias("thread"))
    return table(spark, d, "golden").select("episode_id").join(t, "episode_id", "left").select("episode_id", systems.thread_text(F.col("thread")).alias("shown"))


# ---- threads ----


@query
def thread_roots(spark, d):
    return threads.thread_roots(cut(threads.parse_messages(table(spark, d, "messages"))))


def _built(spark, d):
    m = cut(threads.parse_messages(table(spark, d, "messages")))
    return threads.build_episodes(m, threads.thread_roots(m), brand=BRAND)


@query
def build_episodes(spark, d):
    return _built(spark, d).drop("thread")


@query
def episode_turn_counts(spark, d):
    return _built(spark, d).groupBy("n_turns", "n_brand_turns", "n_customer_turns").agg(F.count("*").alias("episodes"))


@query
def temporal_split(spark, d):
    return threads.temporal_split(episodes(spark, d, "created_at")).select("episode_id", "split")


# ---- TF-IDF and search ----


def _history(spark, d) -> Column:
    """Whether an episode with a text belongs to history."""
    x = table(spark, d, "episodes").where("customer_text IS NOT NULL")
    return threads.history_mark(x.select("episode_id", "created_at", F.xxhash64("customer_text").alias("text"), F.xxhash64("brand_reply").alias("reply")).distinct())


def _split_rows(spark, d, history: Column, *columns: Column) -> DataFrame:
    """Each episode with a text once: ``episode_id``, ``split`` and ``columns``, spread by id. Of texts that aren't among ``columns`` only digests are shuffled."""
    x = table(spark, d, "episodes").where("customer_text IS NOT NULL")
    split = F.when(history, "history").otherwise("eval_pool").alias("split")
    rows = x.select("episode_id", split, *columns, F.col("created_at").alias("_at"), F.xxhash64("customer_text").alias("_text"), F.xxhash64("brand_reply").alias("_reply"))
    return rows.repartition("episode_id").distinct().drop("_at", "_text", "_reply")


def _line() -> Column:
    return tfidf.line(text.tokenize(F.col("customer_text"))).alias("line")


def _index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vocabulary, vectors)`` of history, from rows with ``line``."""
    past = rows.where("split = 'history'")
    docs = tfidf.documents(past, doc="episode_id")
    vocabulary = cut(tfidf.fit(tfidf.line_terms(docs), past.count(), min_df=2, max_features=VOCABULARY))
    return vocabulary, tfidf.weigh(docs, vocabulary)


def _all_terms(spark, d):
    return tfidf.terms_of(episodes(spark, d, "customer_text"), doc="episode_id", terms=text.analyze(text.tokenize(F.col("customer_text"))))


@query
def document_frequency(spark, d):
    return tfidf.document_frequency(_all_terms(spark, d))


@query
def vocabulary_topn(spark, d):
    """A top-k report: the 500 most frequent terms with their ids."""
    v = tfidf.fit(_all_terms(spark, d), episodes(spark, d), min_df=2, max_features=500)
    return tfidf.vocabulary_ids(v).select("term", "df", "term_id")


@query
def idf(spark, d):
    v = tfidf.fit(_all_terms(spark, d), episodes(spark, d), min_df=3)
    return v.select("term", "df", rounded(F.col("idf"), 4).alias("idf"))


@query
def tfidf_weights(spark, d):
    """Length and heaviest weight of every vector."""
    counts = cut(_all_terms(spark, d))
    w = tfidf.transform(counts, tfidf.fit(counts, episodes(spark, d), min_df=2))
    return w.groupBy(F.col("doc").alias("episode_id")).agg(F.count("*").alias("terms"), rounded(F.sum(F.col("w").cast("double") * F.col("w")), 4).alias("norm"), rounded(F.max("w"), 4).alias("top"))


def _asked_pool() -> Column:
    """The stated query set: episodes of the evaluation pool whose number is divisible by 20."""
    return (F.col("split") == "eval_pool") & (F.regexp_extract("episode_id", r"(\d+)$", 1).cast("long") % 20 == 0)


def _retrieval(spark, d):
    """``(history, asked, queries, index)``: the mark of history, ids of the query set, its vectors and those of all history."""
    history = _history(spark, d)
    rows = cut(_split_rows(spark, d, history, _line()).where((F.col("split") == "history") | _asked_pool()))
    vocabulary, index = _index(rows)
    asked = rows.where("split = 'eval_pool'")
    return history, asked.select(F.col("episode_id").alias("doc")), tfidf.weigh(tfidf.documents(asked, doc="episode_id"), vocabulary), index


def _signatures(spark, d, history: Column) -> DataFrame:
    """``doc, signature`` of the replies of history."""
    signature = text.signature(text.tokenize(F.col("brand_reply"))).alias("signature")
    return _split_rows(spark, d, history, signature).where("split = 'history'").select(F.col("episode_id").alias("doc"), "signature")


@query
def cosine_topk(spark, d):
    """Queries are the pool's episodes whose number is divisible by 20, against all history."""
    _, _, q, index = _retrieval(spark, d)
    near = search.top_k(q, index, 5)
    return near.select(F.col("q").alias("query_id"), F.col("doc").alias("episode_id"), rounded(F.col("score"), 4).alias("score"), long(F.col("rank")).alias("rank"))


@query
def cosine_topk_allowed(spark, d):
    """The same queries against history that the brand answered more than once."""
    _, _, q, index = _retrieval(spark, d)
    allow = episodes(spark, d, "n_brand_turns").where("n_brand_turns > 1").select(F.col("episode_id").alias("doc"))
    near = search.top_k(q, index, 5, allow=allow)
    return near.select(F.col("q").alias("query_id"), F.col("doc").alias("episode_id"), rounded(F.col("score"), 4).alias("score"), long(F.col("rank")).alias("rank"))


@query
def top_score(spark, d):
    _, asked, q, index = _retrieval(spark, d)
    return tfidf.top_score(q, asked, index).select(F.col("q").alias("episode_id"), rounded(F.col("top_score"), 4).alias("top_score"))


@query
def precedents_dedup(spark, d):
    history, _, q, index = _retrieval(spark, d)
    p = tfidf.precedents(q, index, _signatures(spark, d, history), systems.TOP_PRECEDENTS)
    return p.select(F.col("q").alias("query_id"), F.col("doc").alias("episode_id"), rounded(F.col("score"), 4).alias("score"), long(F.col("rank")).alias("rank"))


def _dense(spark, d, k):
    e = table(spark, d, "embeddings")
    rows = cut(search.vectors(tfidf.dense_terms(e, doc="vec_id", vector="embedding")))
    return search.top_k(rows.where(F.col("doc").cast("long") % 20 == 0), rows, k, drop_self=True)


@query
def dense_cosine_topk(spark, d):
    """Vectors whose id is divisible by 20 against all others."""
    return _dense(spark, d, 3).select(long(F.col("q")).alias("q"), long(F.col("doc")).alias("doc"), rounded(F.col("score"), 3).alias("score"))


@query
def knn_majority(spark, d):
    near = _dense(spark, d, 5).join(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("doc"), "label"), "doc")
    votes = near.groupBy("q", "label").agg(F.count("*").alias("n"))
    return votes.groupBy(long(F.col("q")).alias("q")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


# ---- clustering and classification ----


def _centroids(spark, d, k=10):
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").orderBy("vec_id").limit(k).collect()  # k rows, the starting centroids
    return [list(r["embedding"]) for r in rows]


@query
def kmeans_assign_step(spark, d):
    a = learning.assign(table(spark, d, "embeddings"), _centroids(spark, d), doc="vec_id", vector="embedding")
    return a.select(F.col("doc").alias("vec_id"), long(F.col("cluster")).alias("cluster"), rounded(F.col("similarity"), 4).alias("similarity"))


@query
def kmeans_update_step(spark, d):
    e = table(spark, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("doc"), F.col("label").alias("cluster"))
    u = learning.update(e, labels, doc="vec_id", vector="embedding")
    return u.select(long(F.col("cluster")).alias("cluster"), long(F.col("dim")).alias("dim"), rounded(F.col("value"), 4).alias("value"), "size")


@query
def kmeans_fit(spark, d):
    labels, _ = learning.kmeans(table(spark, d, "embeddings"), 10, doc="vec_id", vector="embedding")
    return labels.select(F.col("doc").alias("vec_id"), "cluster")


@query
def kmeans_rounds(spark, d):
    """Three rounds from the first ten vectors."""
    labels, _ = learning.kmeans(table(spark, d, "embeddings"), 10, doc="vec_id", vector="embedding", start=_centroids(spark, d), max_iter=3)
    return labels.select(F.col("doc").alias("vec_id"), long(F.col("cluster")).alias("cluster"))


@query
def kmeans_top_terms(spark, d):
    """The 12 heaviest terms of the centroid of every brand's messages."""
    counts = cut(_all_terms(spark, d))
    w = tfidf.transform(counts, tfidf.fit(counts, episodes(spark, d), min_df=3, max_features=30_000))
    labels = episodes(spark, d, "brand").select(F.col("episode_id").alias("doc"), F.col("brand").alias("cluster"))
    t = learning.top_terms(w, labels, 12)
    return t.select("cluster", "term", rounded(F.col("weight"), 3).alias("weight"))


def _golden_folds(spark, d):
    g = table(spark, d, "golden").where("gold_intent IS NOT NULL").select("episode_id", "customer_text", text.normalise_intent(F.col("gold_intent")).alias("label"))
    return g, sampling.folds(g, 5, label="label", key="episode_id", seed=3)


def _golden_vectors(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documents, vectors)`` of the golden messages by a vocabulary of their own."""
    own = cut(tfidf.documents(g.select("episode_id", _line()), doc="episode_id"))
    return own, tfidf.weigh(own, cut(tfidf.fit(tfidf.line_terms(own), g.count(), min_df=1, max_features=20_000)))


@query
def stratified_folds(spark, d):
    return _golden_folds(spark, d)[1].select("episode_id", "label", long(F.col("fold")).alias("fold"))


@query
def logreg_oof(spark, d):
    g, folded = _golden_folds(spark, d)
    _, w = _golden_vectors(g)
    return learning.out_of_fold(folded.select(F.col("episode_id").alias("doc"), "label", "fold"), w)


@query
def softmax_score(spark, d):
    """Scores from fixed weights: the mean vector of every label as a linear model."""
    e = table(spark, d, "embeddings")
    v = tfidf.dense_terms(e, doc="vec_id", vector="embedding")
    model = v.join(e.select(F.col("vec_id").alias("doc"), "label"), "doc").groupBy("label", "term").agg((4 * F.avg("w")).alias("weight"))
    bias = e.groupBy("label").agg(F.log(F.count("*")).alias("bias"))
    return learning.softmax_scores(v, model, bias).select(F.col("doc").alias("vec_id"), long(F.col("label")).alias("label"), rounded(F.col("p"), 4).alias("p"))


# ---- samples ----


@query
def uniform_sample(spark, d):
    return sampling.uniform(episodes(spark, d), 120, key="episode_id", seed=7).select("episode_id")


@query
def balanced_tasks(spark, d):
    return sampling.balanced(table(spark, d, "system_outputs"), 60, group="system", key="episode_id", seed=23).select("system", "episode_id", long(F.col("position")).alias("position"))


def _fired(spark, d):
    return episodes(spark, d, "customer_text").where("customer_text IS NOT NULL").withColumn("fired", policy.fired_rules(F.col("customer_text")))


@query
def rule_quota_sample(spark, d):
    x = sampling.rule_quota(_fired(spark, d), [r.name for r in policy.DEFAULT_RULES], 80, key="episode_id", fired="fired", seed=7)
    return x.select("rule", "episode_id")


@query
def round_robin_clusters(spark, d):
    return sampling.round_robin(table(spark, d, "embeddings"), 40, group="label", order=["vec_id"]).select("vec_id", "label", long(F.col("round")).alias("round"))


@query
def discover_intents(spark, d):
    return pipelines.discover_intents(episodes(spark, d, "customer_text"))


@query
def golden_sample(spark, d):
    return pipelines.golden_sample(episodes(spark, d, "created_at", "customer_text"))


# ---- policy and systems ----


@query
def rule_hits(spark, d):
    return _fired(spark, d).select(F.explode("fired").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query
def route_decide(spark, d):
    x = table(spark, d, "system_outputs").select("episode_id", "system", "customer_text", "intent", "confidence", F.col("retrieval_top").alias("top_score"), "model_route", "model_reason")
    y = policy.decide(x, text="customer_text")
    return y.select("episode_id", "system", "route", "route_reason", F.array_join("fired_rules", ",").alias("fired"), "overridden")


def _joined(spark, d):
    return report.outputs_with_gold(table(spark, d, "system_outputs"), table(spark, d, "golden"))


def _spelled(df):
    return df.withColumn("gold_intent", text.normalise_intent(F.col("gold_intent")))


@query
def rule_precision(spark, d):
    x = _joined(spark, d).select("system", F.explode("fired_rules").alias("rule"), (F.col("gold_route") == "escalate").alias("right"))
    return x.groupBy("system", "rule").agg(F.count("*").alias("n"), rounded(F.avg(F.col("right").cast("double"))).alias("precision"))


@query
def ablation_model_only(spark, d):
    """Routing with rules against the model's own proposal; a blank one falls back to the final route."""
    x = _joined(spark, d).withColumn("alone", F.when(F.trim(F.coalesce("model_route", F.lit(""))) == "", F.col("route")).otherwise(F.col("model_route")))
    both = [metrics.routing(x, by=["system"], gold="gold_route", pred=p).withColumn("variant", F.lit(v)) for p, v in (("route", "with_rules"), ("alone", "model_only"))]
    over = x.groupBy("system").agg(F.count_if("overridden").alias("overrides"))
    return both[0].unionByName(both[1]).join(over, "system").select("system", "variant", "n", "tp", "fp", "fn", "tn", rounded(F.col("false_auto_rate")).alias("false_auto_rate"), "overrides")


@query
def trivial_system(spark, d):
    g = table(spark, d, "golden").select("episode_id", "customer_text", F.col("gold_intent"))
    top = metrics.majority(g.where("gold_intent IS NOT NULL").select(text.normalise_intent(F.col("gold_intent")).alias("x")), "x")
    both = systems.trivial(g, route="auto", intent=top).unionByName(systems.trivial(g, route="escalate", intent=top))
    return both.select("episode_id", "system", "intent", "confidence", "reply", "route")


@query
def simple_system(spark, d):
    """Out-of-fold intent, nearest reply of history, rules."""
    g, folded = _golden_folds(spark, d)
    own, w = _golden_vectors(g)
    said = learning.out_of_fold(folded.select(F.col("episode_id").alias("doc"), "label", "fold"), w)
    history = _history(spark, d)
    vocabulary, index = _index(cut(_split_rows(spark, d, history, _line()).where("split = 'history'")))
    near = search.top_k(tfidf.weigh(own, vocabulary), index, 1)
    past = _split_rows(spark, d, history, F.col("brand_reply")).where("split = 'history'").select(F.col("episode_id").alias("doc"), "brand_reply")
    best = near.join(past, "doc").select(F.col("q").alias("episode_id"), "brand_reply", F.col("score").alias("top_score"))
    guesses = said.select(F.col("doc").alias("episode_id"), F.col("predicted").alias("intent"), F.col("probability").alias("confidence")).join(g.select("episode_id", "customer_text"), "episode_id")
    return systems.simple(guesses, best, rules=policy.DEFAULT_RULES)


def _asked(spark, d):
    """The golden messages and their requests without precedents."""
    g = table(spark, d, "golden").select("episode_id", "customer_text").where("customer_text IS NOT NULL")
    return g, systems.requests(g, systems.agent_prompt(F.col("customer_text"), F.array().cast(NO_PRECEDENT)), key="episode_id", model="stub")


@query
def request_keys(spark, d):
    g = table(spark, d, "golden").where("customer_text IS NOT NULL")
    one = F.lit("m"), F.lit("s"), F.col("episode_id"), F.lit(16), F.lit(0.0)
    return g.select("episode_id", text.request_key(*one).alias("key"))


@query
def stub_complete(spark, d):
    _, asked = _asked(spark, d)
    done = complete.complete(asked, complete.Stub(LABELS))
    return done.join(asked.select("key", F.col("item").alias("episode_id")), "key").select("episode_id", F.get_json_object("json", "$.intent").alias("intent"), "error")


@query
def cache_hits_misses(spark, d):
    """The cache holds the answers of one stratum; an offline client fails on the others."""
    g, asked = _asked(spark, d)
    stratum = table(spark, d, "golden").select(F.col("episode_id").alias("item"), "stratum")
    known = asked.join(stratum, "item").where("stratum = 'random'").select("key", F.lit('{"intent": "other"}').alias("response"), F.lit("stub").alias("provider"), F.lit("2024-01-01").alias("at"))
    answers, _ = complete.complete_cached(asked, known, complete.Offline())
    return answers.groupBy("hit").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"))


NO_PRECEDENT = "array<struct<customer string, brand_reply string, score double>>"


def _golden_search(spark, d):
    """``(golden messages, mark of history, their vectors, vectors of all history)``."""
    g = table(spark, d, "golden").select("episode_id", "customer_text").where("customer_text IS NOT NULL").distinct()
    history = _history(spark, d)
    vocabulary, index = _index(cut(_split_rows(spark, d, history, _line()).where("split = 'history'")))
    return g, history, tfidf.weigh(tfidf.documents(g.select("episode_id", _line()), doc="episode_id"), vocabulary), index


def _with_precedents(spark, d):
    """The golden messages with ``precedents``, the best first, and ``top_score``, from all history."""
    g, history, own, index = _golden_search(spark, d)
    near = cut(tfidf.precedents(own, index, _signatures(spark, d, history), systems.TOP_PRECEDENTS))
    replies = _split_rows(spark, d, history, F.col("customer_text").alias("customer"), F.coalesce("brand_reply", F.lit("")).alias("brand_reply")).where("split = 'history'").withColumnRenamed("episode_id", "doc").drop("split")
    lists = near.join(replies, "doc").groupBy(F.col("q").alias("episode_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "customer", "brand_reply", F.col("score").cast("double").alias("score")))).alias("found"))
    shown = F.transform("found", lambda p: F.struct(p["customer"].alias("customer"), p["brand_reply"].alias("brand_reply"), p["score"].alias("score")))
    return g.join(lists, "episode_id", "left").select("episode_id", "customer_text", F.coalesce(shown, F.array().cast(NO_PRECEDENT)).alias("precedents"), F.coalesce(F.get("found", F.lit(0))["score"], F.lit(0.0)).alias("top_score"))


def _with_top_score(spark, d):
    """The golden messages with the score of the best precedent alone, which is the nearest row whatever its reply."""
    g, _, own, index = _golden_search(spark, d)
    best = tfidf.top_score(own, g.select(F.col("episode_id").alias("doc")).distinct(), index).withColumnRenamed("q", "episode_id")
    return g.join(best, "episode_id", "left").withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))


def _agent(g, name, shown):
    g = cut(g)
    asked = systems.requests(g, systems.agent_prompt(F.col("customer_text"), shown), key="episode_id", model="stub")
    answers = complete.complete(asked, complete.Stub(LABELS)).select("key", "json", "error")
    return systems.agent(g, asked, answers, rules=policy.DEFAULT_RULES, name=name).withColumn("fired_rules", F.array_join("fired_rules", ",")).withColumn("top_score", rounded(F.col("top_score"), 4))


@query
def agent_system(spark, d):
    return _agent(_with_precedents(spark, d), "agent", F.col("precedents"))


@query
def agent_no_retrieval(spark, d):
    """The prompt shows no precedent; the best score still feeds the gate."""
    return _agent(_with_top_score(spark, d), "agent-no-retrieval", F.array().cast(NO_PRECEDENT))


@query
def system_driver(spark, d):
    """Selected systems over all golden messages."""
    g = table(spark, d, "golden").select("episode_id", "customer_text")
    builders = {f"trivial-{r}": lambda m, r=r: systems.trivial(m, route=r, intent="other") for r in ("auto", "escalate")}
    return systems.run_systems(g, builders, only="trivial-escalate, trivial-auto").select("episode_id", "system", "intent", "route")


@query
def selected_systems(spark, d):
    return systems.selected(table(spark, d, "system_outputs"), "agent, simple").select("episode_id", "system", "route")


@query
def first_messages(spark, d):
    """The smoke-run limit: the first 25 golden messages by id."""
    return systems.first_n(table(spark, d, "golden").select("episode_id", "stratum"), 25, order=["episode_id"])


@query
def auto_shares(spark, d):
    return io.auto_shares(table(spark, d, "system_outputs")).select("system", "n", rounded(F.col("auto_share")).alias("auto_share"))


@query
def reference_rows(spark, d):
    """Replies to grade, people's own among them with the reference withheld."""
    return systems.with_reference(table(spark, d, "system_outputs"), table(spark, d, "golden"))


@query
def golden_rows(spark, d):
    """The uniform stratum of the golden set, projected and in order of id."""
    drawn = sampling.uniform(episodes(spark, d), 120, key="episode_id", seed=7).select("episode_id", F.lit("random").alias("stratum"), F.lit("uniform draw").alias("stratum_note"))
    return pipelines.golden_rows(drawn, episodes(spark, d, "created_at", "customer_text", "brand_reply", "n_turns"))


@query
def draft_summary(spark, d):
    """Drafts by intent, by route, and by stratum and route, with the share of agreeing passes."""
    x = table(spark, d, "golden").select("stratum", text.normalise_intent(F.col("draft_intent")).alias("intent"), text.normalise_route(F.coalesce("draft_route", F.lit(""))).alias("route"), F.col("passes_agreed").cast("int").alias("agreed"))
    sets = x.groupingSets([["intent"], ["route"], ["stratum", "route"]], "stratum", "intent", "route").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), rounded(F.avg("agreed")).alias("agree"))
    return sets.select(F.when(F.col("gid") == 5, "intent").when(F.col("gid") == 6, "route").otherwise("stratum_route").alias("kind"), "stratum", "intent", "route", "n", "agree")


@query
def draft_labels(spark, d):
    g = table(spark, d, "golden")
    x = g.select("episode_id", F.col("pass_a_intent").alias("a_intent"), F.col("pass_a_route").alias("a_route"), F.col("pass_b_intent").alias("b_intent"), F.col("pass_b_route").alias("b_route"), F.col("human_intent").alias("c_intent"), F.col("human_route").alias("c_route"))
    return systems.draft_labels(x)


@query
def judge_replies(spark, d):
    """Blank replies are graded without a call; the stored grades stand in for the judge's answers."""
    o = table(spark, d, "system_outputs").where("system LIKE 'agent%'").select("episode_id", "system", "reply")
    s = table(spark, d, "judge_scores").groupBy("episode_id", "system").agg(F.max(F.struct("composite", "grounding", "resolution", "tone", "sendable")).alias("g"))
    answers = s.select("episode_id", "system", F.to_json(F.struct("g.grounding", "g.resolution", "g.tone", "g.sendable")).alias("json"), F.lit(None).cast("string").alias("error"))
    return systems.judge(o, answers).select("episode_id", "system", "grounding", "resolution", "tone", "sendable", rounded(F.col("composite")).alias("composite"))


@query
def resume_upsert(spark, d):
    g = table(spark, d, "golden")
    drafts = g.select("episode_id", F.col("draft_intent").alias("intent"), F.lit(False).alias("reviewed"))
    return systems.resume(drafts, g.select("episode_id", F.col("human_intent").alias("intent"), "reviewed"), key="episode_id")


@query
def anti_done(spark, d):
    done = table(spark, d, "audits").select("episode_id")
    return systems.not_done(table(spark, d, "golden").select("episode_id"), done, keys=["episode_id"])


# ---- metrics ----


def _labelled(spark, d):
    return _spelled(_joined(spark, d))


@query
def confusion(spark, d):
    return metrics.confusion(_labelled(spark, d), by=["system"], gold="gold_intent", pred="intent", labels=LABELS)


@query
def class_report(spark, d):
    cells = metrics.confusion(_labelled(spark, d), by=["system"], gold="gold_intent", pred="intent", labels=LABELS)
    r = metrics.class_report(cells, by=["system"], labels=LABELS)
    return r.select("system", "label", "support", "predicted", *(rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query
def system_metrics(spark, d):
    m = report.system_metrics(_labelled(spark, d))
    return m.select("system", "part", "n_intent", *(rounded(F.col(c)).alias(c) for c in ("intent_accuracy", "macro_f1", "weighted_f1", "auto_rate", "false_auto_rate", "escalation_recall")))


@query
def system_intervals(spark, d):
    """Bootstrap intervals of accuracy and macro F1 per system, over all and by part of the sample."""
    i = report.system_intervals(_labelled(spark, d))
    return i.select("system", "part", *(rounded(F.col(c), 4).alias(c) for c in ("accuracy_low", "accuracy_high", "macro_f1_low", "macro_f1_high")))


@query
def composite_intervals(spark, d):
    c = report.composite_intervals(table(spark, d, "judge_scores"))
    return c.select("system", "n", *(rounded(F.col(x), 4).alias(x) for x in ("mean", "low", "high")))


@query
def routing_metrics(spark, d):
    r = metrics.routing(_joined(spark, d), by=["system"], gold="gold_route", pred="route")
    return r.select("system", "n", "tp", "fp", "fn", "tn", *(rounded(F.col(c)).alias(c) for c in ("auto_rate", "false_auto_rate", "escalation_recall", "escalation_precision", "escalation_f1", "over_escalation", "accuracy", "auto_precision")))


@query
def majority_label(spark, d):
    return metrics.majority(table(spark, d, "golden").where("gold_intent IS NOT NULL").select(text.normalise_intent(F.col("gold_intent")).alias("x")), "x")


@query
def wilson_ci(spark, d):
    x = table(spark, d, "judge_scores").groupBy("system").agg(F.count_if("sendable").alias("k"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return x.select("system", "k", "n", rounded(low).alias("low"), rounded(high).alias("high"))


@query
def bootstrap_ci(spark, d):
    """Composite of every system's graded replies; a resample has as many draws as there are replies."""
    best = table(spark, d, "judge_scores").where("grounding > 0").groupBy("system", "episode_id").agg(F.max("composite").alias("composite"))
    b = metrics.bootstrap_mean(best, "composite", by=["system"], seed=29)
    return b.select("system", "n", *(rounded(F.col(c), 4).alias(c) for c in ("mean", "low", "high")))


def _passes(spark, d):
    g = table(spark, d, "golden").where("pass_a_intent IS NOT NULL AND pass_b_intent IS NOT NULL")
    return g.select("stratum", text.normalise_intent(F.col("pass_a_intent")).alias("a"), text.normalise_intent(F.col("pass_b_intent")).alias("b"))


@query
def agreement(spark, d):
    return metrics.agreement(_passes(spark, d), "a", "b", by=["stratum"]).select("stratum", "n", rounded(F.col("agree")).alias("agree"))


@query
def cohen_kappa(spark, d):
    return metrics.cohen_kappa(_passes(spark, d), "a", "b", by=["stratum"]).select("stratum", "n", rounded(F.col("kappa")).alias("kappa"))


def _pairs(spark, d):
    """Two grades of a reply: grounding and tone."""
    return table(spark, d, "judge_scores").where("grounding > 0").select("system", "grounding", "tone", "composite")


@query
def ordinal_agreement(spark, d):
    o = metrics.ordinal_agreement(_pairs(spark, d), "grounding", "tone", by=["system"])
    return o.select("system", "n", *(rounded(F.col(c)).alias(c) for c in ("exact", "within_one", "mae", "mean_a", "mean_b", "bias")))


@query
def quadratic_kappa(spark, d):
    return metrics.quadratic_kappa(_pairs(spark, d), "grounding", "tone", by=["system"]).select("system", "n", rounded(F.col("quadratic_kappa")).alias("kappa"))


@query
def pearson(spark, d):
    return metrics.pearson(_pairs(spark, d), "grounding", "composite", by=["system"]).select("system", "n", rounded(F.col("pearson")).alias("pearson"))


@query
def spearman(spark, d):
    return metrics.spearman(_pairs(spark, d), "grounding", "composite", by=["system"]).select("system", "n", rounded(F.col("spearman")).alias("spearman"))


@query
def calibration_bins(spark, d):
    x = _labelled(spark, d)
    c = metrics.calibration(x, by=["system"], confidence="confidence", correct=F.col("intent") == F.col("gold_intent"))
    return c.select("system", long(F.col("bin")).alias("bin"), "n", rounded(F.col("mean_confidence")).alias("mean_confidence"), rounded(F.col("accuracy")).alias("accuracy"))


@query
def judge_aggregate(spark, d):
    j = report.judge_aggregate(table(spark, d, "judge_scores"), table(spark, d, "system_outputs"))
    return j.select("system", "n", "auto_n", *(rounded(F.col(c)).alias(c) for c in ("grounding", "resolution", "tone", "composite", "sendable", "sendable_low", "sendable_high", "violations", "auto_sendable")))


@query
def judge_human_agreement(spark, d):
    """Grades of one message's two agent variants, the second in the place of people's: no ratings by people are in the tables."""
    s = table(spark, d, "judge_scores").where("grounding > 0").groupBy("system", "episode_id").agg(F.max(F.struct("composite", "grounding", "resolution", "tone", "sendable")).alias("g")).select("system", "episode_id", "g.*")
    one = lambda name: s.where(F.col("system") == name).withColumn("system", F.lit("any"))
    j = report.judge_human(one("agent"), one("agent-no-retrieval"))
    return j.select("dimension", "n", *(rounded(F.col(c)).alias(c) for c in ("exact", "mae", "kappa", "rho")))


@query
def label_quality(spark, d):
    """Reviewed labels against their drafts, and blind audits against drafts or, without one, gold."""
    g = table(spark, d, "golden")
    anchored = g.where("reviewed AND draft_intent IS NOT NULL AND human_intent IS NOT NULL").select(F.lit("anchored").alias("kind"), text.normalise_intent(F.col("draft_intent")).alias("x"), text.normalise_intent(F.col("human_intent")).alias("y"))
    base = g.select("episode_id", F.coalesce(F.when(F.col("draft_intent") != "", F.col("draft_intent")), F.col("gold_intent")).alias("base"))
    blind = table(spark, d, "audits").where("intent IS NOT NULL").join(base.where("base IS NOT NULL"), "episode_id").select(F.lit("blind").alias("kind"), text.normalise_intent(F.col("base")).alias("x"), text.normalise_intent(F.col("intent")).alias("y"))
    k = metrics.cohen_kappa(anchored.union(blind), "x", "y", by=["kind"])
    return k.select("kind", "n", rounded(F.col("agree")).alias("agree"), rounded(F.col("kappa")).alias("kappa"))


@query
def golden_stats(spark, d):
    """Counts of the golden set by stratum, intent and route in one pass over its cells."""
    g = table(spark, d, "golden").select("stratum", F.when(F.col("gold_intent").isNotNull(), text.normalise_intent(F.col("gold_intent"))).alias("intent"), F.col("gold_route").alias("route"), "reviewed", "human_changed", "passes_agreed")
    sets = g.groupingSets([["stratum"], ["intent"], ["route"], ["stratum", "route"]], "stratum", "intent", "route")
    x = sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count_if("reviewed").alias("reviewed"), F.count_if("human_changed").alias("changed"), F.count_if("passes_agreed").alias("agreed"))
    return x.select(F.when(F.col("gid") == 3, "stratum").when(F.col("gid") == 5, "intent").when(F.col("gid") == 6, "route").otherwise("stratum_route").alias("kind"), "stratum", "intent", "route", "n", "reviewed", "changed", "agreed")


@query
def failure_gallery(spark, d):
    x = report.failure_gallery(_labelled(spark, d), table(spark, d, "judge_scores"))
    return x.select("kind", "system", "episode_id", "intent", "gold_intent", "route", "gold_route")


@query
def confusion_pivot(spark, d):
    cells = metrics.confusion(_labelled(spark, d), by=["system"], gold="gold_intent", pred="intent", labels=LABELS)
    return cells.groupBy("system", "gold").pivot("pred", LABELS).agg(F.sum("n")).fillna(0)


@query
def report_bundle(spark, d):
    """The report as one row of Markdown: nine sections from metric tables of fixed size."""
    joined = cut(_labelled(spark, d))
    scores, outputs = table(spark, d, "judge_scores"), table(spark, d, "system_outputs")
    sections = [
        ("Labelled set", golden_stats(spark, d), ["kind", "stratum", "intent", "route"]),
        ("Label quality", label_quality(spark, d), ["kind"]),
        ("Intent and routing", report.system_metrics(joined).join(report.system_intervals(joined), ["system", "part"], "left"), ["system", "part"]),
        ("Confusion", confusion_pivot(spark, d), ["system", "gold"]),
        ("Replies", report.judge_aggregate(scores, outputs).join(report.composite_intervals(scores).select("system", "low", "high"), "system", "left"), ["system"]),
        ("Judge against a second grader", judge_human_agreement(spark, d), ["dimension"]),
        ("Guardrails", ablation_model_only(spark, d).withColumn("what", F.lit("routing")).select("what", "system", F.col("variant").alias("name"), "n", F.col("false_auto_rate").alias("value")).union(rule_precision(spark, d).select(F.lit("rule precision"), "system", "rule", "n", "precision")), ["what", "system", "name"]),
        ("Calibration", metrics.calibration(joined, by=["system"], confidence="confidence", correct=F.col("intent") == F.col("gold_intent")), ["system", "bin"]),
        ("Failures", report.failure_gallery(joined, scores), ["kind", "place"]),
    ]
    return spark.createDataFrame([(report.markdown("Evaluation", sections),)], "markdown string")


@query
def jsonl_round_trip(spark, d):
    """Episodes through the JSON lines sink and the strict reader."""
    path = f"{shared_dir(spark)}/jsonl-{hashlib.md5(d.encode()).hexdigest()[:12]}"
    io.write_jsonl(episodes(spark, d, *EPISODE), path)
    schema = "episode_id string, brand string, customer_id string, created_at timestamp, customer_text string, brand_reply string, n_turns int"
    return io.read_jsonl(spark, path, schema).select("episode_id", "customer_text", "brand_reply", long(F.col("n_turns")).alias("n_turns"))


@query
def triage_rates(spark, d):
    """The streaming intake's plan on a batch: messages and escalations per day of arrival."""
    x = table(spark, d, "messages").where("text IS NOT NULL")
    return intake.rates(x, time="ingested_at", text="text", window="1 day")
