from pyspark.sql import functions as F

from deskloom.plans import pipelines

TOPICS = ["the lost suitcase with my winter coat came out broken number {}", "please refund the seat upgrade payment twice charged number {}", "the website login page freezes whenever opened number {}"]


def frame(spark, n):
    rows = [(f"e{i:03d}", TOPICS[i % 3].format(f"x{i}y")) for i in range(n)] + [("short", "no"), ("null", None), ("twin", TOPICS[0].format("x0y"))]
    return spark.createDataFrame(rows, "episode_id string, customer_text string").withColumn("created_at", F.lit(None).cast("timestamp"))


def test_discovery(spark):
    got = pipelines.discover_intents(frame(spark, 60), k=3).collect()
    assert sum(r["size"] for r in got) == 62 and max(len(r["examples"]) for r in got) <= 8 and all(len(r["top_terms"]) <= 12 for r in got if r["top_terms"])


def test_golden_sample(spark):
    got = pipelines.golden_sample(frame(spark, 60), n_random=10, n_targeted=12, topics=3).collect()
    ids = [r["episode_id"] for r in got]
    assert len(ids) == 22 == len(set(ids)) and not {"short", "null", "twin"} & set(ids)
    assert {r["stratum"] for r in got} == {"random", "targeted_rule", "targeted_cluster"}
