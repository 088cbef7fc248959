"""Readers and writers: tolerant CSV, strict JSON lines, atomic replacement, a response cache."""

from __future__ import annotations

import csv
import io as _io
import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string"
EPISODE = "episode_id string, brand string, customer_id string, created_at timestamp, customer_text string, brand_reply string, n_turns int, n_brand_turns int, n_customer_turns int, thread array<struct<role string, text string>>"
CACHE = "key string, request struct<model string, system string, prompt string, max_tokens int, temperature double>, response string, provider string, at string"
#: Longest line that is read, as in the reference formats.
EPISODE_LINE, CACHE_LINE = 16 << 20, 32 << 20


def read_messages_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw message rows in header order, with ``row_no`` for the order of delivery.

    Loose quotes are tolerated and rows with more fields than the header keep
    their first ones; rows of fewer than seven fields are skipped. The header
    names the columns.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    columns, wanted = reader.csv(path).columns, [f.name for f in T._parse_datatype_string(RAW)]
    if len(columns) < len(wanted):
        raise ValueError(f"a message file has at least {len(wanted)} columns, this one {len(columns)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _BAD]])
    df = reader.schema(schema).option("columnNameOfCorruptRecord", _BAD).option("enforceSchema", True).csv(path).withColumn("row_no", F.monotonically_increasing_id())
    # only ragged rows come with their record, whose fields are counted
    ragged = F.col(_BAD)
    whole = df.where(ragged.isNull() | (_fields(F.when(ragged.isNotNull(), ragged)) >= len(wanted)))
    return whole.select(*(F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in wanted), "row_no")


_BAD = "_ragged_record"


@F.pandas_udf(T.IntegerType())
def _fields(records: pd.Series) -> pd.Series:
    return records.map(lambda x: len(next(csv.reader(_io.StringIO(x, newline="")), [])), na_action="ignore").astype("Int32")


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = True, line_limit: int = EPISODE_LINE) -> DataFrame:
    """JSON lines of ``schema``. Blank lines are skipped; a bad line fails the read, or is dropped if not ``strict``."""
    lines = spark.read.option("maxRecordSize", line_limit).text(path).where(F.trim("value") != "")
    mode = "FAILFAST" if strict else "PERMISSIVE"
    parsed = lines.select(F.from_json("value", T._parse_datatype_string(schema + ", _bad string"), {"mode": mode, "columnNameOfCorruptRecord": "_bad"} if not strict else {"mode": mode}).alias("x"))
    if not strict:
        parsed = parsed.where("x IS NOT NULL AND x._bad IS NULL")
    return parsed.select("x.*").drop("_bad")


def write_jsonl(df: DataFrame, path: str, *, partition_by: Iterable[str] = ()) -> None:
    """JSON lines in ``path``, replacing what was there; ``partition_by`` splits by column."""
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_by_system(outputs: DataFrame, path: str) -> DataFrame:
    """Outputs as JSON lines, a folder per system; returns ``system, n, auto_share`` of what was written."""
    write_jsonl(outputs, path, partition_by=["system"])
    return auto_shares(outputs)


def auto_shares(outputs: DataFrame) -> DataFrame:
    """``system, n, auto_share``: outputs of each system, and how many of them go out by themselves."""
    return outputs.groupBy("system").agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("route") == "auto").cast("double")), F.lit(0.0)).alias("auto_share"))


def write_text_atomically(path: str, text: str) -> None:
    """A driver-side file of small size, replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(handle, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def write_json_report(path: str, value: object) -> None:
    write_text_atomically(path, json.dumps(value, indent=2, default=str) + "\n")


def latest_by_key(cache: DataFrame) -> DataFrame:
    """One response per key, the last one appended (``at``, then ``provider``)."""
    w = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("provider"))
    return cache.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The response cache; bad lines are ignored."""
    return latest_by_key(read_jsonl(spark, path, CACHE, strict=False, line_limit=CACHE_LINE))


def split_by_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` of requests by ``key``; hits carry ``response``."""
    known = latest_by_key(cache).select("key", "response")
    return requests.join(known, "key"), requests.join(known, "key", "left_anti")


def append_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
