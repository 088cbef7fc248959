"""Whole stages: discovering intents, drawing the labelled sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.functions.text import analyze, dedupe_key, tokenize, trim_space
from deskloom.operators import learning, sampling, tfidf
from deskloom.operators.policy import DEFAULT_RULES, Rule, fired_rules
from deskloom.runtime import cut

SAMPLE, CLUSTERS, TERMS, EXAMPLES = 6000, 30, 12, 8
RANDOM, TARGETED, TOPICS, LEAST = 120, 80, 20, 25


def _clustered(docs: DataFrame, k: int, *, min_df: int, cap: int, seed: int, max_iter: int) -> tuple[DataFrame, DataFrame]:
    """``(labels, weights)`` of ``doc, text``; documents without a known term go to cluster 0."""
    counts = cut(tfidf.terms_of(docs, doc="doc", terms=analyze(tokenize(F.col("text")))))
    vocabulary = cut(tfidf.vocabulary_ids(tfidf.fit(counts, docs, min_df=min_df, max_features=cap)))
    weights = cut(tfidf.transform(counts, vocabulary))
    found, _ = learning.sparse_kmeans(learning.sparse_rows(weights, vocabulary), k, max(1, vocabulary.count()), seed=seed, max_iter=max_iter)
    return docs.select("doc").join(found, "doc", "left").select("doc", F.coalesce("cluster", F.lit(0)).alias("cluster")), weights


def discover_intents(history: DataFrame, *, sample: int = SAMPLE, k: int = CLUSTERS, seed: int = 42, max_iter: int = 40) -> DataFrame:
    """``cluster, size, top_terms, examples, proposed_name, rationale`` of a seeded sample of ``episode_id, customer_text``: a report of ``k`` rows.

    A cluster is named after its two heaviest single words.
    """
    docs = cut(sampling.uniform(history.where("customer_text IS NOT NULL"), sample, key="episode_id", seed=seed).select(F.col("episode_id").alias("doc"), F.col("customer_text").alias("text")))
    labels, weights = _clustered(docs, k, min_df=3, cap=30_000, seed=seed, max_iter=max_iter)
    labels = cut(labels)
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    terms = learning.top_terms(weights, labels, TERMS).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_terms"))
    w = Window.partitionBy("cluster").orderBy("doc")
    some = labels.join(docs, "doc").withColumn("n", F.row_number().over(w)).where(F.col("n") <= EXAMPLES)
    examples = some.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("examples"))
    x = sizes.join(terms, "cluster", "left").join(examples, "cluster", "left")
    words = F.slice(F.filter("top_terms", lambda t: ~t.contains("_")), 1, 2)
    name = F.coalesce(F.nullif(F.array_join(words, "_"), F.lit("")), F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    return x.withColumn("proposed_name", name).withColumn("rationale", F.concat(F.lit("most telling: "), F.coalesce(F.array_join(F.slice("top_terms", 1, 5), ", "), F.lit("nothing"))))


def golden_rows(sample: DataFrame, episodes: DataFrame) -> DataFrame:
    """The unlabelled golden set in order of ``episode_id`` (a sample of fixed size): ``sample`` is ``episode_id, stratum, stratum_note``."""
    e = episodes.select("episode_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "customer_text", F.col("brand_reply").alias("delta_reply"), "n_turns")
    blank = [F.lit("").alias(c) for c in ("gold_intent", "gold_route", "gold_reason", "label_source")]
    return sample.join(e, "episode_id").select("episode_id", "stratum", "stratum_note", "created_at", "customer_text", "delta_reply", "n_turns", *blank).orderBy("episode_id")


def golden_sample(pool: DataFrame, *, n_random: int = RANDOM, n_targeted: int = TARGETED, topics: int = TOPICS, rules: tuple[Rule, ...] = DEFAULT_RULES, seed: int = 7, max_iter: int = 30) -> DataFrame:
    """``episode_id, stratum, stratum_note``: a uniform draw, then a quota per rule, then rounds over topics up to the budget.

    ``pool`` is ``episode_id, created_at, customer_text``. Messages too short
    to judge, or worded like an earlier one, are left out first.
    """
    usable = pool.where((F.length(trim_space(F.col("customer_text"))) >= LEAST) & F.col("customer_text").rlike("[A-Za-z]{3,}"))
    pool = cut(sampling.keep_first(usable, key=dedupe_key(tokenize(F.col("customer_text"))), order=["created_at", "episode_id"]).select("episode_id", "customer_text"))
    drawn = cut(sampling.uniform(pool, n_random, key="episode_id", seed=seed).select("episode_id"))
    rest = pool.join(drawn, "episode_id", "left_anti").withColumn("fired", fired_rules(F.col("customer_text"), rules))
    ruled = cut(sampling.rule_quota(rest, [r.name for r in rules], n_targeted, key="episode_id", fired="fired", seed=seed).select("episode_id", "rule"))
    free = cut(rest.join(ruled.select("episode_id"), "episode_id", "left_anti").select(F.col("episode_id").alias("doc"), F.col("customer_text").alias("text")))
    labels, _ = _clustered(free, topics, min_df=3, cap=20_000, seed=seed, max_iter=max_iter)
    budget = max(0, n_targeted - ruled.count())
    order = labels.withColumn("draw", sampling.hash_draw(F.col("doc"), seed))
    spread = sampling.round_robin(order, budget, group="cluster", order=["draw", "doc"])
    return (
        drawn.select("episode_id", F.lit("random").alias("stratum"), F.lit("uniform draw").alias("stratum_note"))
        .unionByName(ruled.select("episode_id", F.lit("targeted_rule").alias("stratum"), F.col("rule").alias("stratum_note")))
        .unionByName(spread.select(F.col("doc").alias("episode_id"), F.lit("targeted_cluster").alias("stratum"), F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("stratum_note")))
    )
