from deskloom.streaming import intake


def test_intake_matches_batch(spark, tmp_path):
    rows = [(1, "the app is down", "2024-01-01 10:00:00"), (2, "thanks", "2024-01-01 10:30:00"), (3, None, "2024-01-01 12:00:00")]
    df = spark.createDataFrame(rows, "id long, text string, at string").selectExpr("id", "text", "cast(at as timestamp) at")
    df.write.parquet(str(tmp_path / "in"))
    stream = intake.triage(intake.read_messages(spark, str(tmp_path / "in"), "id long, text string, at timestamp"), text="text")
    intake.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {r["id"]: r["route"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "escalate", 2: "auto", 3: "auto"}
    assert [(r["n"], r["escalated"]) for r in intake.rates(df, time="at", text="text").orderBy("start").collect()] == [(2, 1), (1, 0)]
