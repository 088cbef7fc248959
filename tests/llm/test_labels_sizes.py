import json
import random
import subprocess
import sys
from itertools import product
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskloom.llm import consensus, mixing, packing, tokens, truncation

GOLDEN = "episode_id string, pass_a_intent string, pass_a_by string, pass_b_intent string, pass_b_by string, human_intent string, human_by string, gold_intent string, gold_by string, label string"


def test_labels_are_collected(spark):
    g = spark.createDataFrame([("i", "Baggage ", "d1", "flight-disruption", None, "PRAISE", "r1", "unsure", "r2", "x"), ("j", None, "d1", "", "d2", "other", None, None, None, "x")], GOLDEN)
    a = spark.createDataFrame([(1, "i", "r1", "baggage", "2024-01-02"), (2, "i", "r1", "n/a", "2024-01-03"), (3, "i", "r1", "praise", "2024-01-01"), (4, "zz", "r1", "praise", None), (5, "j", None, "praise", None), (6, "j", "r3", "praise", None)], "audit_id long, episode_id string, annotator_id string, intent string, t string").withColumn("labelled_at", F.to_timestamp("t"))
    got = {(r["item"], r["rater"], r["label"], r["link"]) for r in consensus.collect_labels(g, a).collect()}
    assert got == {("i", "d1", "baggage", "passes"), ("i", "pass_b", "flight_disruption", "passes"), ("i", "r1", "baggage", None), ("j", "r3", "praise", None)}


def test_reliable_raters_outvote(spark):
    random.seed(7)
    intents = consensus.INTENTS[:4]
    truth = {f"i{n}": random.choice(intents) for n in range(300)}
    skill = {"good1": 0.95, "good2": 0.93, "good3": 0.9, "bad1": 0.2, "bad2": 0.2, "bad3": 0.25, "rare": 0.9}
    rows = []
    for item, t in truth.items():
        for rater, p in skill.items():
            if (rater == "rare" and random.random() < 0.97) or (rater != "rare" and random.random() < 0.35):
                continue
            rows.append((item, rater, t if random.random() < p else random.choice([x for x in intents if x != t]), None))
    df = spark.createDataFrame(rows, "item string, rater string, label string, link string")
    items, raters = consensus.consensus(df)
    got = {r["item"]: r for r in items.collect()}
    right = sum(got[i]["intent"] == t for i, t in truth.items() if i in got) / len(got)
    votes = {}
    for item, _, label, _ in rows:
        votes.setdefault(item, []).append(label)
    plain = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items()) / len(votes)
    assert right > 0.9 and right > plain + 0.03
    rel = {r["rater"]: r["reliability"] for r in raters.collect()}
    assert min(rel["good1"], rel["good2"], rel["good3"]) > 0.8 > 0.5 > max(rel["bad1"], rel["bad2"], rel["bad3"])
    assert all(0 <= r["agreement"] <= 1 and (r["labels"] == 1) == (r["pair_agreement"] is None) for r in got.values())


def test_no_labels(spark):
    items, raters = consensus.consensus(spark.createDataFrame([], "item string, rater string, label string, link string"))
    assert items.count() == 0 and raters.count() == 0


RATERS_ROWS = {"rater": ["r"], "labels": [3], "said": [[{"code": 1, "qs": [1.0, 2.0]}]]}
SUMS_ROWS = {"counts": [[1.0, 2.0], [3.0, 4.0]], "types": [[0.5, 0.5], [1.0, 0.0]]}


@pytest.mark.parametrize("call, rows, column, want", [("_raters(np.ones((1, 2, 2)), np.ones(1), 2)", RATERS_ROWS, "counts", [0, 1, 0, 2]), ("_sums", SUMS_ROWS, "part", [3.5, 5, 0.5, 1, 1.5, 0.5, 4, 6])])
def test_first_batch_of_a_worker(call, rows, column, want):
    """A new worker's first batch comes from a stream, before anything else has loaded more of pyarrow than consensus does."""
    rows, sink = pa.table(rows), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows)
    code = f"import json, sys; import numpy as np, pyarrow as pa; from deskloom.llm.consensus import _raters, _sums; print(json.dumps([b.column({column!r}).to_pylist() for b in {call}(pa.ipc.open_stream(sys.stdin.buffer))]))"
    run = subprocess.run([sys.executable, "-c", code], input=sink.getvalue().to_pybytes(), capture_output=True, cwd=Path(consensus.__file__).parents[2])
    assert run.returncode == 0, run.stderr.decode()[-500:]
    assert json.loads(run.stdout) == [[want]]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "é😀 <|endoftext|>"), (5, "a" * 50_000)], "tokens_of long, t string")
    got = {r["tokens_of"]: r["tokens"] for r in tokens.count_tokens(df, text="t", keep=["tokens_of"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3 and got[5] > 1000


SPECS = "spec_name string, capacity_tokens int"


def test_packing(spark):
    random.seed(3)
    sizes = [random.randint(1, 90) for _ in range(700)] + [100, 250, 1000, 0, None]
    df = spark.createDataFrame([*((i, s) for i, s in enumerate(sizes)), (0, sizes[0]), (None, 5)], "row long, piece long")
    specs = spark.createDataFrame([("s", 100), ("l", 500), ("none", None), ("zero", 0)], SPECS)
    packed = packing.pack(df.withColumnsRenamed({"row": "doc", "piece": "n"}), specs, key="doc", size="n").collect()
    want = sum(s or 0 for s in sizes) + sizes[0]
    for spec, cap in (("s", 100), ("l", 500)):
        rows = [r for r in packed if r["spec_name"] == spec]
        assert sum(r["tokens"] for r in rows) == want
        fill = {}
        for r in rows:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        rests = [x % cap for x in (*(x or 0 for x in sizes), sizes[0])]
        least = max(-(-want // cap), sum((x or 0) // cap for x in (*sizes, sizes[0])) + sum(x > cap / 2 for x in rests))  # no packing needs fewer
        assert max(fill.values()) <= cap and least <= len(fill) <= 1.04 * least + 1
        pieces = {}
        for r in rows:
            pieces.setdefault(r["doc"], []).append((r["start"], r["tokens"]))
        assert all(len(p) == 1 for d, p in pieces.items() if sizes[d] <= cap and d != 0)
        for d, p in pieces.items():  # pieces of a large item lie end to end
            if sizes[d] > cap:
                p.sort()
                assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:]))
    empty = packing.pack(df.where("false").withColumnsRenamed({"row": "doc", "piece": "n"}), specs, key="doc", size="n")
    assert empty.count() == 0


def test_windows_are_whole_and_within():
    random.seed(1)
    for _ in range(30):
        sizes = [random.randint(1, 50) for _ in range(random.randint(0, 60))]
        ws = packing.windows(sizes, 50)
        assert sorted(i for w in ws for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 50 for w in ws)
    assert packing.windows([50, 50, 1], 50) and len(packing.windows([25, 25, 25, 25], 50)) == 2


def test_schedule_stays_within_a_block():
    for shares in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.97, "b": 0.02, "c": 0.01}, {"a": 1 / 3, "b": 2 / 3}, {"x": 1.0}):
        slots, period = mixing.weights_of(shares)
        assert sum(slots.values()) == period
        table = mixing.schedule(slots, period)
        assert sorted(t for ts in table.values() for t in ts) == list(range(period))
        for k, ts in table.items():
            for t in range(1, period + 1):
                assert abs(sum(x < t for x in ts) - t * slots[k] / period) < 1


def test_mixing(spark):
    random.seed(2)
    docs = [(i, random.choice("aaaaaabbbc"), random.randint(1, 60)) for i in range(3000)] + [(9001, "zz", 5), (9002, None, 5), (9003, "a", None), (None, "a", 5), (9004, "c", 0)]
    df = spark.createDataFrame(docs, "slot long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df.withColumnRenamed("slot", "doc"), targets, key="doc", source="source", size="tokens", block_tokens=200).orderBy("slot", "start").collect()
    total = sum(r["tokens"] for r in mixed)
    for source, share, repeats in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)):
        rows = [r for r in mixed if r["source"] == source]
        assert abs(sum(r["tokens"] for r in rows) / total - share) < 0.003
        uses = {}
        for r in rows:
            uses[r["doc"]] = uses.get(r["doc"], 0) + 1
        assert max(uses.values()) <= repeats and len({(r["doc"], r["pass_no"]) for r in rows}) == len(rows)
    got = {"a": 0, "b": 0, "c": 0}
    for n, r in enumerate(mixed):  # never more than a block and a record away from the shares
        got[r["source"]] += r["tokens"]
        if n % 50 == 0:
            assert all(abs(got[k] - s * sum(got.values())) < 2 * 200 + 60 for k, s in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    s = {r["source"]: r for r in mixing.shares_reached(mixing.mix(df.withColumnRenamed("slot", "doc"), targets, key="doc", source="source", size="tokens"), targets, key="doc").collect()}
    assert s["gone"]["records"] == 0 and s["c"]["most_uses"] <= 3
    assert mixing.mix(df.withColumnRenamed("slot", "doc").where("false"), targets, key="doc", source="source", size="tokens").count() == 0


SENTENCES = ["The crew was kind to us.", "We waited for three hours.", "My suitcase came out broken.", "Nobody answered the phone.", "The lounge was closed again."]


def corpus(n, seed=1):
    random.seed(seed)
    return [" ".join(random.choices(SENTENCES, k=random.randint(2, 6))) for _ in range(n)]


@pytest.mark.parametrize("end", ["The crew was ki", "My suitc", "The crew was…", "We waited for thr [truncated]", "Nobody answered the &#3", "My suitcase came out"])
def test_truncated(spark, end):
    rows = [(i, t, " Web-Form") for i, t in enumerate(corpus(400))] + [(900, SENTENCES[0] + " " + end, "web_form"), (901, None, "x"), (902, " ", None), (903, SENTENCES[1] + " " + end, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1))
    got = {r["doc_id"]: r["truncated"] for r in truncation.truncation_scores(df).collect()}
    assert {d for d, t in got.items() if t} == {900, 903} and not {901, 902} & set(got)


def test_complete_endings(spark):
    ends = ["We waited for three hours", "The crew was kind to us 😀", "The crew was kind to us #fly", "The crew was kind to us https://pic.example/AB12", "So it goes...", "The crew was kind to us.\n\nRegards", "My suitcase came out broken"]
    rows = [(i, t, "chat") for i, t in enumerate(corpus(400))] + [(1000 + 10 * i + j, f"{s} {e}", "chat") for i, e in enumerate(ends) for j, s in product(range(6), SENTENCES[:1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert truncation.truncation_scores(df).where("truncated").count() == 0
    assert truncation.truncation_scores(df.where("false")).count() == 0
    assert truncation.source_rates(truncation.truncation_scores(df)).first()["rate"] == 0


def test_prefixes_of_long_words(spark):
    """Words of any length are found by what they begin with, without an entry for each of their prefixes."""
    long = "x" * 5000
    words = spark.createDataFrame([("cat", 5), ("car", 2), (long + "yz", 7), (long + "q", 4), ("a", 9)], "one string, uses long")
    ends = spark.createDataFrame([("ca",), (long,), (long + "y",), (long + "yz",), ("zzz",)], "one string")
    table = {r["one"]: r["below"] for r in truncation.prefix_table(words, ends).collect()}
    assert table["ca"] == 7 and table["c"] == 7 and table[long] == 11 and table[long + "y"] == 7 and long + "yz" not in table and "a" not in table
    assert max(len(k) for k in table if k not in (long, long + "y")) == truncation.HEAD
