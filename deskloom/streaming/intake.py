"""Structured Streaming intake: guardrails on messages as they arrive. Beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from deskloom.operators.policy import DEFAULT_RULES, Rule, fired_rules
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_messages(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 16) -> DataFrame:
    """A stream of parquet files dropped into ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def triage(messages: DataFrame, *, text: str, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Add ``fired_rules`` and ``route``; stateless, so late rows need no watermark. Also works on a batch."""
    fired = fired_rules(F.col(text), rules)
    return messages.withColumn("fired_rules", fired).withColumn("route", F.when(F.size(fired) > 0, "escalate").otherwise("auto"))


def rates(messages: DataFrame, *, time: str, text: str, window: str = "1 hour", late: str = "2 hours", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Messages and escalations per time window; rows later than ``late`` are left out."""
    x = triage(messages.where(F.col(time).isNotNull()), text=text, rules=rules)
    x = x.withWatermark(time, late) if x.isStreaming else x
    return x.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("route") == "escalate").alias("escalated")).select(F.col("w.start").alias("start"), "n", "escalated")


def write(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Append to parquet, exactly once, until what is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()



