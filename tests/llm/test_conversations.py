import random
from datetime import datetime, timedelta

from deskloom.llm import conversations as C

RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, row_no long"


def stamp(s):
    return (datetime(2024, 1, 2) + timedelta(seconds=s)).strftime("%a %b %d %H:%M:%S +0000 %Y")


def frame(spark, rows):
    return spark.createDataFrame([(*r[:5], None, r[5], i) for i, r in enumerate(rows)], RAW)


def run(spark, rows, **o):
    got = {}
    for r in C.turns(frame(spark, rows), **o).orderBy("episode_id", "turn_no").collect():
        got.setdefault(r["episode_id"], []).append((r["tweet_id"], r["speaker"]))
    return got


def msg(i, author, inbound, s, text="some words", parent=None):
    return (str(i), author, inbound, stamp(s) if isinstance(s, int) else s, text, parent)


def test_rules(spark):
    rows = [
        msg(1, "c", "True", 0), msg(2, "B", " False", 5, parent="1.0"), msg(3, "c", "TRUE", 5, None, " 2 "), msg(4, "x", "False", 9, parent="2"),
        msg(10, "c", "True", 0, parent="999"), msg(11, "B", "False", 1, parent="10"),  # a parent that isn't there
        msg(20, "c", "True", 0, parent="22"), msg(21, "B", "False", 1, parent="20"), msg(22, "c", "True", 2, parent="21"),  # a circle
        msg(30, "c", "True", 0), msg(31, "B", "False", "n/a", parent="30"),  # an unreadable time
        msg(40, "B", "False", 0), msg(41, "c", "True", 1, parent="40"),  # opened by the brand
        msg(50, "c", "True", 0), msg(51, "c", "True", 1, parent="50"),  # unanswered
        msg(60, "c", "True", 0, "@B https://x.y &nbsp;"), msg(61, "B", "False", 1, parent="60"),  # nothing said
        msg(70, "c", "True", 0), msg(71, "B", "False", 1, "@70 ", "70"), msg(72, "B", "False", 2, parent="71"),  # nothing answered first
        msg(80, "c", "True", 3, "old"), msg(81, "B", "False", 4, parent="80"), msg(80, "c", "True", 5, "new"),  # the latest row of an id counts: 81 comes first
        msg(90, "c", "True", 0, parent="90"), ("see below", "c", "True", stamp(0), "x", None), (None,) * 6,
        msg(100, "c", "True", 0, "é" * 20_000), msg(101, "B", "False", 0, parent="100"),  # equal times: by number
    ]
    want = {"B-1": [(1, "customer"), (2, "brand"), (3, "customer"), (4, "customer")], "B-100": [(100, "customer"), (101, "brand")]}
    assert run(spark, rows) == want
    assert run(spark, rows, window_turns=1) == want
    c = {r["episode_id"]: r for r in C.conversations(frame(spark, rows)).collect()}
    assert (c["B-1"]["n_turns"], c["B-1"]["n_brand_turns"], c["B-1"]["n_customer_turns"]) == (4, 1, 2) and c["B-1"]["customer_text"] == "some words"


def test_nothing(spark):
    assert run(spark, []) == {}


def test_long_chains_and_hubs(spark):
    random.seed(1)
    rows = [msg(i, "B" if i % 2 == 0 else "c", str(i % 2 == 1), i, parent=None if i == 1 else str(i - 1)) for i in range(1, 301)]
    rows += [msg(1000, "c", "True", 0)] + [msg(1000 + i, "B", "False", random.randint(1, 50), parent="1000") for i in range(1, 400)]
    random.shuffle(rows)
    got = run(spark, rows, window_turns=350)
    assert [t for t, _ in got["B-1"]] == list(range(1, 301))
    times = {int(r[0]): r[3] for r in rows}
    assert [t for t, _ in got["B-1000"]] == sorted((t for t in times if t >= 1000), key=lambda t: (datetime.strptime(times[t], "%a %b %d %H:%M:%S %z %Y"), t))


def test_threads_have_every_text(spark):
    rows = [msg(1, "c", "True", 0, "one"), msg(2, "B", "False", 1, "two", "1"), msg(3, "c", "True", 2, None, "2"), msg(5, "x", "False", 3, "five", "3"), msg(4, "B", "False", 3, "four", "3")]
    df = frame(spark, rows)
    for x in (df, df.union(df)):
        (r,) = C.conversations(x).collect()
        assert [tuple(t) for t in r["thread"]] == [("customer", "one"), ("brand", "two"), ("customer", None), ("brand", "four"), ("customer", "five")]
        assert (r["brand"], r["customer"], r["customer_text"], r["brand_reply"], r["n_turns"], r["n_brand_turns"], r["n_customer_turns"]) == ("B", "c", "one", "two", 5, 2, 2)


def test_ids_up_to_the_greatest_bigint(spark):
    a, b, top = 1234567890123456789, 1234567890123456790, 2**63 - 1
    rows = [msg(a, "c", "True", 0), msg(b, "B", "False", 1, parent=f"{a}.0"), msg("000" + str(top), "c", "True", 2, parent=b), msg(top + 1, "c", "True", 3), msg(5, "c", "True", 0, parent=top + 1), msg(6, "B", "False", 1, parent=5)]
    rows = [(*r[:5], None if r[5] is None else str(r[5])) for r in rows]
    assert run(spark, rows) == {f"B-{a}": [(a, "customer"), (b, "brand"), (top, "customer")]}


def sessions(spark, rows):
    got = {}
    for r in C.sessions(frame(spark, rows)).orderBy("episode_id", "turn_no").collect():
        got.setdefault(r["episode_id"], []).append((r["turn_no"], r["tweet_id"], r["speaker"]))
    return got


def test_sessions(spark):
    day = 86_400
    # replies within minutes and openings after days calibrate the gap
    rows = []
    for i in range(12):
        at = i * 3 * day + (day - 120 if i % 3 == 0 else 0)  # some run over midnight
        rows += [msg(100 + 10 * i, "c", "True", at, "@B hello"), msg(101 + 10 * i, "B", "False", at + 60, "@c yes", str(100 + 10 * i)), msg(102 + 10 * i, "c", "True", at + 200, "@B thanks", str(101 + 10 * i))]
    rows += [msg(900, "d", "True", 50, "@B anyone"), msg(901, "d", "True", 90, "@B nobody?", "900")]  # no reply
    rows += [msg(910, "B", "False", 50, "@e news"), msg(911, "e", "True", 90, "@B oh", "910")]  # opened by the brand
    rows += [msg(920, "f", "True", 50, "@B"), msg(921, "B", "False", 60, "@f hm", "920")]  # nothing said
    rows += [msg(930, "g", "True", "n/a", "@B x"), msg(931, None, "True", 5, "@B x"), msg(932, "B", "False", 5, "to nobody"), ("nan", "h", "True", stamp(0), "x", None)]
    rows += [msg(940, "i", "True", 70, "no handle"), msg(941, "B", "False", 70, "no handle", "940"), msg(942, "i", "True", 70, None, "941")]  # equal times, partner by the links
    got = sessions(spark, rows + rows[:3])
    want = {f"B-{100 + 10 * i}": [(1, 100 + 10 * i, "customer"), (2, 101 + 10 * i, "brand"), (3, 102 + 10 * i, "customer")] for i in range(12)}
    assert got == {**want, "B-940": [(1, 940, "customer"), (2, 941, "brand"), (3, 942, "customer")]}
    assert sessions(spark, []) == {}


def test_texts_of_shared_row_numbers(spark):
    """Rows that share a number, or have none, keep their texts."""
    rows = [("1", "c", "True", stamp(0), "opening words", None, None, 7), ("2", "B", "False", stamp(5), "an answer", None, "1", 7), ("3", "c", "True", stamp(9), "more words", None, "2", None)]
    got = C.conversations(spark.createDataFrame(rows, RAW)).collect()
    assert [(t["role"], t["text"]) for t in got[0]["thread"]] == [("customer", "opening words"), ("brand", "an answer"), ("customer", "more words")]
    assert [(r["turn_no"], r["role"], r["text"]) for r in C.threads(spark.createDataFrame(rows, RAW)).orderBy("turn_no").collect()] == [(1, "customer", "opening words"), (2, "brand", "an answer"), (3, "customer", "more words")]
