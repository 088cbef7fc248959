"""Queries of the training-text operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.llm import abuse, consensus, conversations, formatting, lookalike, mixing, overlap, packing, privacy, tokens, truncation
from deskloom.llm.oracles import ORACLES
from deskloom.runtime import table

__all__ = ["ORACLES", "QUERIES"]

FIELDS = ["customer_text", "brand_reply"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_pairs(table(spark, d, "episodes"), key="episode_id", fields=FIELDS)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_classes(table(spark, d, "episodes"), key="episode_id", fields=FIELDS)


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_text(table(spark, d, "episodes").select("episode_id", *FIELDS), FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.turns(table(spark, d, "messages"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "messages"))


def p2_threads(spark: SparkSession, d: str) -> DataFrame:
    return conversations.threads(table(spark, d, "messages"))


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Not the required result: what participants and gaps give."""
    return conversations.sessions(table(spark, d, "messages"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return formatting.formatting_groups(table(spark, d, "episodes"), key="episode_id", text="customer_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_groups(spark, d).where("copies > 1 AND episode_id <> first_id").select("first_id", "episode_id")


PRIVATE = {"key": "episode_id", "texts": ["customer_text"], "idents": ["customer_id"]}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, spans = privacy.protected_spans(table(spark, d, "episodes"), **PRIVATE)
    return spans.select(F.col("k").alias("episode_id"), F.col("field").alias("field_name"), F.col("kind").alias("pii_kind")).distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return privacy.redact(table(spark, d, "episodes"), **PRIVATE)


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """One row per episode: the highest score of the texts it was delivered with."""
    scores = abuse.abuse_scores(table(spark, d, "episodes"), text="customer_text", keep=["episode_id", "brand"])
    most = F.max(F.struct("abuse_score", "abuse_kind"))
    return scores.groupBy("episode_id").agg(F.min("brand").alias("brand"), most.alias("s")).select("episode_id", "brand", "s.abuse_score", "s.abuse_kind")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(p5_scores(spark, d), "brand")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_scores(spark, d).where(F.col("abuse_score") >= abuse.FLAG_AT).where("episode_id IS NOT NULL").select("episode_id")


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return consensus.consensus(consensus.collect_labels(table(spark, d, "golden"), table(spark, d, "audits")))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0]


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    """What of the items doesn't depend on the raters' reliability."""
    return p6_items(spark, d).select("item", "labels", F.round("pair_agreement", 9).alias("pair_agreement"))


def p6_raters(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_items(spark, d).where(F.col("labels") >= consensus.LEAST_RATERS).select(F.col("item").alias("episode_id"), "intent")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return overlap.with_split(table(spark, d, "episodes").select("episode_id", "brand", "created_at", "customer_text"), table(spark, d, "splits"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(_splits(spark, d), key="episode_id", text="customer_text", side="side")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("a_id", "b_id").alias("episode_a"), F.greatest("a_id", "b_id").alias("episode_b")).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and brand of the evaluation record."""
    where = _splits(spark, d).where("side = 'b'").select(F.col("episode_id").alias("b_id"), "split_name", "brand").distinct()
    return _overlaps(spark, d).join(where, "b_id").groupBy("split_name", "brand").agg(F.count("*").alias("pairs"), F.count_if("same").alias("same_pairs"), F.count_distinct("b_id").alias("evaluation_records"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.count_tokens(table(spark, d, "documents"), text="text", keep=["doc_id"])
    return packing.pack(sized, table(spark, d, "pack_specs"), key="doc_id", size="tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_containers(spark, d), table(spark, d, "pack_specs"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per spec, packed by characters: what is placed, containers beyond their capacity, and items that are split."""
    specs = table(spark, d, "pack_specs")
    packed = packing.pack(table(spark, d, "documents").select("doc_id", "n_chars"), specs, key="doc_id", size="n_chars")
    over = packed.groupBy("spec_name", "container").agg(F.sum("tokens").alias("held")).join(F.broadcast(specs), "spec_name").groupBy("spec_name").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"))
    items = packed.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("size"), F.count("*").alias("pieces"))
    return items.groupBy("spec_name").agg(F.count("*").alias("items"), F.sum("size").alias("size"), F.count_if(F.col("pieces") > 1).alias("split")).join(over, "spec_name")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target source, mixed by characters: records used too often, and uses that aren't whole records."""
    documents = table(spark, d, "documents").select("doc_id", "n_chars", tokens.clean_source(F.col("source")).alias("source"))
    targets = table(spark, d, "mix_targets")
    mixed = mixing.mix(documents, targets, key="doc_id", source="source", size="n_chars").join(documents.select("doc_id", "n_chars"), "doc_id")
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.count_if(F.col("tokens") != F.col("n_chars")).alias("cut"))
    x = targets.select("source", "max_repeats").join(uses, "source", "left")
    return x.groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("over_used"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").withColumn("source", tokens.clean_source(F.col("source")))
    sized = tokens.count_tokens(documents, text="text", keep=["doc_id", "source"])
    return mixing.mix(sized, table(spark, d, "mix_targets"), key="doc_id", source="source", size="tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_reached(p9_mix(spark, d), table(spark, d, "mix_targets"), key="doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_scores(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_rates(p10_scores(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_classes, p1_forms, p2_found, p2_conversations, p2_threads, p2_sessions, p3_found, p3_groups, p4_found, p4_redacted, p5_found, p5_scores, p5_rates, p6_found, p6_items, p6_agreement, p6_raters, p7_found, p7_report, p8_containers, p8_fill, p8_checks, p9_mix, p9_shares, p9_checks, p10_found, p10_scores, p10_rates)
}
