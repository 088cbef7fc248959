import random

from pyspark.sql import functions as F

from deskloom.operators import threads

RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, in_response_to_tweet_id string, row_no long"
T = "Tue Jan 02 15:04:{:02d} +0000 2024"


def walk(parents, start):
    """Brute force: follow parents for at most 64 steps, stop at what was seen."""
    seen, at = set(), start
    for _ in range(64):
        if at in seen or parents[at] == 0 or parents[at] not in parents:
            break
        seen.add(at)
        at = parents[at]
    return at


def test_roots_against_brute_force(spark):
    random.seed(4)
    parents = {}
    base = 0
    for _ in range(60):  # random graphs with circles, tails, loops and dangling parents
        n = random.randint(1, 12)
        for i in range(1, n + 1):
            parents[base + i] = random.choice([0, base + random.randint(1, n), base + random.randint(1, n), base + i, 10**6])
        base += 20
    for depth in (63, 64, 65, 66, 90, 150):  # chains around and beyond the limit
        for i in range(depth + 1):
            parents[base + i + 1] = 0 if i == 0 else base + i
        base += 200
    df = spark.createDataFrame(list(parents.items()), "id long, parent long")
    got = {r["id"]: r["root"] for r in threads.thread_roots(df).collect()}
    assert got == {i: walk(parents, i) for i in parents}


def test_roots_of_nothing(spark):
    assert threads.thread_roots(spark.createDataFrame([], "id long, parent long")).count() == 0


def build(spark, rows, **options):
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RAW)
    m = threads.parse_messages(raw)
    return {r["episode_id"]: r for r in threads.build_episodes(m, threads.thread_roots(m), brand="B", **options).collect()}


def test_episodes(spark):
    long = "this is long enough"
    rows = [
        ("1", "c", "True", T.format(1), long, None),
        ("2", "B", "False", T.format(2), long + " &amp; more", "1.0"),
        ("3", "x", "False", T.format(3), "aside", "2"),
        ("4", "c", " TRUE", T.format(4), "thanks", " 2 "),
        ("2", "B", "False", T.format(2), long + " again", "1.0"),  # the last row of an id wins
        ("10", "B", "False", T.format(1), long, None),  # opened by the brand
        ("11", "c", "True", T.format(2), long, "10"),
        ("20", "c", "True", T.format(1), long, None),  # never answered
        ("30", "c", "True", T.format(1), "x" * 15, None),
        ("31", "B", "False", T.format(2), "y" * 14, "30"),  # too short an answer
        ("40", "c", "True", T.format(5), long, None),  # an answer without a time comes first
        ("41", "B", "False", "n/a", long, "40"),
        ("50", "c", "True", T.format(5), long, None),  # equal times: order by id
        ("51", "B", "False", T.format(5), long, "50"),
        ("see below", "c", "True", T.format(5), long, None),
        (None, None, None, None, None, None),
    ]
    got = build(spark, rows)
    assert set(got) == {"B-1", "B-50"}
    one = got["B-1"]
    assert (one["n_turns"], one["n_brand_turns"], one["n_customer_turns"]) == (4, 1, 2)
    assert one["brand_reply"] == long + " again" and one["customer_id"] == "c"
    assert [t["role"] for t in one["thread"]] == ["customer", "brand", "customer", "customer"]
    assert set(build(spark, rows, min_length=14)) == {"B-1", "B-50", "B-30"}


def test_no_messages(spark):
    assert build(spark, []) == {}


def test_temporal_split(spark):
    rows = [(f"e{i:02d}", None if i < 2 else f"2024-01-{1 + i // 3:02d}") for i in range(23)]
    df = spark.createDataFrame(rows, "episode_id string, d string").select("episode_id", F.to_timestamp("d").alias("created_at"))
    got = threads.temporal_split(df).orderBy(F.col("created_at").asc_nulls_first(), "episode_id").collect()
    assert [r["split"] for r in got] == ["history"] * 16 + ["eval_pool"] * 7
    assert threads.temporal_split(df.where("false")).count() == 0


def test_history_mark_is_the_split(spark):
    rows = [(f"e{i:02d}", None if i % 9 == 0 else f"2024-01-0{1 + i % 3} 10:00:0{i % 7}") for i in range(43)]
    df = spark.createDataFrame(rows, "episode_id string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    for n in (0, 1, 2, 43):
        some = df.orderBy("episode_id").limit(n)
        want = {r["episode_id"]: r["split"] == "history" for r in threads.temporal_split(some).collect()}
        assert {r["episode_id"]: r["m"] for r in some.withColumn("m", threads.history_mark(some)).collect()} == want
