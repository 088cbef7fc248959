"""Threads of one brand: parsing, root resolution, episodes, temporal split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.functions.text import clean, unescape
from deskloom.operators.sampling import rank_within
from deskloom.runtime import cut

MIN_LENGTH = 15
HISTORY_SHARE = 0.70
MAX_STEPS = 64
#: Stands for a time that can't be read, before all others.
ZERO_TIME = "0001-01-01 00:00:00"


def parse_messages(raw: DataFrame) -> DataFrame:
    """``id, author, inbound, ts, text, parent``; rows without a numeric id leave, the last row of an id wins.

    A parent is read as a float and cut to a whole number, 0 where blank or no
    number; an unreadable time becomes the zero time.
    """
    zero = F.lit(ZERO_TIME).cast("timestamp")
    rows = raw.select(
        F.expr(r"CASE WHEN trim(tweet_id) RLIKE '^[+-]?[0-9]+$' THEN try_cast(trim(tweet_id) AS BIGINT) END").alias("id"),
        F.struct(
            "row_no",
            F.col("author_id").alias("author"),
            (F.lower(F.trim(F.coalesce("inbound", F.lit("")))) == "true").alias("inbound"),
            F.coalesce(F.try_to_timestamp(F.substring(F.trim("created_at"), 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy")), zero).alias("ts"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.expr("cast(try_cast(trim(in_response_to_tweet_id) AS DOUBLE) AS BIGINT)"), F.lit(0)).alias("parent"),
        ).alias("row"),
    )
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.max("row").alias("row")).select("id", "row.*").drop("row_no")


def thread_roots(messages: DataFrame, *, max_steps: int = MAX_STEPS) -> DataFrame:
    """``id, root`` by following parents at most ``max_steps`` (a power of two) times.

    A missing parent makes the message itself the root. In a circle the root is
    the first message met twice on the way. Pointer doubling settles every chain;
    only what still moves after it, long chains and circles, is walked step by step.
    """
    nodes = messages.select("id", "parent")
    known = nodes.select(F.col("id").alias("known"))
    linked = nodes.join(known, F.col("parent") == F.col("known"), "left")
    step = cut(linked.select("id", F.when((F.col("parent") != 0) & F.col("known").isNotNull(), F.col("parent")).otherwise(F.col("id")).alias("to")).withColumn("fixed", F.col("to") == F.col("id")))
    # what is settled is written once and only looked up from then on
    settled, moving = step.where("fixed"), step.where("NOT fixed")
    left, done, limit = moving.count(), 1, None
    while left:
        ahead = settled.union(moving).select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("fixed").alias("end"))
        moved = cut(moving.join(ahead, "to").select("id", F.col("further").alias("to"), F.col("end").alias("fixed")))
        settled, moving = settled.union(moved.where("fixed")), moved.where("NOT fixed")
        done *= 2
        if done == max_steps:
            limit = moving.select("id", F.col("to").alias("reached"))
        now = moving.count()
        if now == left:  # only ways into circles are left
            break
        left = now
    out = settled.select("id", F.col("to").alias("root"))
    if limit is not None:  # longer chains end where the steps do
        out = out.join(limit, "id", "left").select("id", F.coalesce("reached", "root").alias("root"))
    if not left:
        return out
    after = step.select(F.col("id").alias("at"), F.col("to").alias("next"))
    walking = moving.select("id", F.col("id").alias("at"), F.array("id").alias("path"))
    for n in range(max_steps):
        moved = cut(walking.join(after, "at").select("id", F.col("next").alias("at"), F.array_contains("path", F.col("next")).alias("stop"), F.concat("path", F.array("next")).alias("path")))
        stop = F.col("stop") if n + 1 < max_steps else F.lit(True)
        out = out.union(moved.where(stop).select("id", F.col("at").alias("root")))
        walking = moved.where(~stop).select("id", "at", "path")
        if not moved.where(~stop).limit(1).count():
            break
    return out


def turn_table(messages: DataFrame, roots: DataFrame, *, brand: str) -> DataFrame:
    """Messages with their root, of threads in which ``brand`` takes part."""
    joined = messages.join(roots, "id")
    with_brand = joined.where(F.col("author") == brand).select("root").distinct()
    return joined.join(with_brand, "root", "left_semi")


def build_episodes(messages: DataFrame, roots: DataFrame, *, brand: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """Episodes of ``brand``: threads opened by a customer and answered by the brand, texts cleaned.

    Turns are in order of time, then id. Threads are dropped whose opening or
    first answer is shorter than ``min_length`` characters after cleaning. Turns
    of others that aren't inbound are shown as the customer's but not counted.
    ``created_at`` is null where the opening's time can't be read.
    """
    rows = turn_table(messages, roots, brand=brand).withColumn("text", unescape(F.col("text")))
    rows = rows.withColumn("text", clean(F.col("text"), unescaped=True))
    turns = F.array_sort(F.collect_list(F.struct("ts", "id", "author", "inbound", "text")))
    threads = rows.groupBy("root").agg(turns.alias("turns")).withColumn("first", F.get("turns", F.lit(0)))
    answers = F.filter(F.slice("turns", F.lit(2), F.greatest(F.size("turns"), F.lit(1))), lambda t: t["author"] == brand)
    threads = threads.withColumn("reply", F.try_element_at(answers, F.lit(1)))
    kept = threads.where(F.col("first.inbound") & F.col("reply").isNotNull() & (F.length("first.text") >= min_length) & (F.length("reply.text") >= min_length))
    return kept.select(
        F.concat(F.lit(brand + "-"), F.col("first.id").cast("string")).alias("episode_id"),
        F.lit(brand).alias("brand"),
        F.col("first.author").alias("customer_id"),
        F.nullif("first.ts", F.lit(ZERO_TIME).cast("timestamp")).alias("created_at"),
        F.col("first.text").alias("customer_text"),
        F.col("reply.text").alias("brand_reply"),
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["author"] == brand)).alias("n_brand_turns"),
        F.size(F.filter("turns", lambda t: (t["author"] != brand) & t["inbound"])).alias("n_customer_turns"),
        F.transform("turns", lambda t: F.struct(F.when(t["author"] == brand, "brand").otherwise("customer").alias("role"), t["text"].alias("text"))).alias("thread"),
    )


def temporal_split(episodes: DataFrame, *, share: float = HISTORY_SHARE) -> DataFrame:
    """Add ``split``: ``history`` for the first ``floor(n * share)`` rows by time and id, else ``eval_pool``.

    Rows without a time come first. Days are counted, and only the rows of the
    day that holds the cut are ranked, over ranges, so no task sorts everything.
    """
    own = [c for c in episodes.columns if c != "split"]
    rows = episodes.select(*own, F.coalesce(F.col("created_at").cast("timestamp"), F.lit(ZERO_TIME).cast("timestamp")).alias("_t"))
    day = F.to_date("_t")
    days = rows.groupBy(day.alias("_day")).agg(F.count("*").alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("_day"))  # one row for each day
    marks = cut(days.select("_day", (F.floor(F.sum("_size").over(Window.partitionBy()) * F.lit(share)) - (upto - F.col("_size"))).alias("_take"), "_size"))
    whole = F.when(F.col("_take") >= F.col("_size"), "history").when(F.col("_take") <= 0, "eval_pool")
    marked = rows.withColumn("_day", day).join(marks, "_day").withColumn("split", whole)
    inside = marked.where("split IS NULL").drop("split")
    ranked = rank_within(inside, [], ["_t", "episode_id"], "_rank").withColumn("split", F.when(F.col("_rank") <= F.col("_take"), "history").otherwise("eval_pool"))
    return marked.where("split IS NOT NULL").select(*own, "split").unionByName(ranked.select(*own, "split"))


def history_mark(episodes: DataFrame, *, share: float = HISTORY_SHARE) -> Column:
    """Whether a row is among the first ``floor(n * share)`` by time and id, as :func:`temporal_split` has it.

    ``episodes`` is ``episode_id, created_at`` with a row for each row that counts;
    the mark is the last row of history, so nothing but times and ids is moved.
    """
    time = F.unix_micros(F.coalesce(F.col("created_at").cast("timestamp"), F.lit(ZERO_TIME).cast("timestamp")))
    rows = cut(episodes.select("episode_id", time.alias("_t")))
    days = rows.groupBy(F.floor(F.col("_t") / 86_400_000_000).alias("_day")).agg(F.count("*").alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("_day"))  # one row for each day
    take = F.floor(F.sum("_size").over(Window.partitionBy()) * F.lit(share)) - (upto - F.col("_size"))
    day = days.select("_day", "_size", take.alias("_take")).where("_take BETWEEN 1 AND _size").first()
    if day is None:
        return F.lit(False)
    inside = rows.where(F.floor(F.col("_t") / 86_400_000_000) == day["_day"])
    last = rank_within(inside, [], ["_t", "episode_id"], "_rank").where(F.col("_rank") == day["_take"]).first()
    return F.coalesce((time < last["_t"]) | ((time == last["_t"]) & (F.col("episode_id") <= last["episode_id"])), F.lit(False))
