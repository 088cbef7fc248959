import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.llm import formatting, overlap

FORM = ["Seat: 3A", "Flight = XY1", "Issue - the seat: broken", "When: 2:15pm"]


def groups(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string, entries int")
    return {r["episode_id"]: (r["first_id"], r["copies"]) for r in formatting.formatting_groups(df, key="id", text="text").collect()}


def test_formatting(spark):
    same = ["Hello, World 12", "hello world   12!!", '"HELLO\tWORLD 1 2"', "hellо world 12", "hello, wor​ld 12", "Hello, World 12"]
    rows = [(f"a{i}", t, i) for i, t in enumerate(same)]
    rows += [("b1", " | ".join(FORM), 0), ("b2", "\n".join(reversed(FORM)).upper().replace(":", " ="), 1), ("b3", ", ".join(FORM[1:] + FORM[:1]), 2)]
    rows += [("c1", "Hello, World 13", 0), ("c2", "Héllo, World 12", 0), ("c3", "World hello 12", 0), ("c4", " | ".join([*FORM[:3], "When: 2:16pm"]), 0)]
    rows += [("d", None, 0), ("e", "  !! ", 0), (None, "Hello, World 12", 0), ("a0", same[0], 7), ("g", "Straße", 0), ("h", "STRASSE", 0), ("i", "x" * 60_000, 0), ("j", "X" * 60_000 + ".", 0)]
    rows += [("k1", "Name: Bob; City: Rome", 0), ("k2", "city: rome\nNAME: bob", 0), ("k3", "City: Bob; Name: Rome", 0)]
    got = groups(spark, rows)
    assert got["k1"] == got["k2"] == ("k1", 2) and got["k3"] == ("k3", 1)
    assert {k for k, v in got.items() if v == ("a0", 6)} == {f"a{i}" for i in range(6)}
    assert {k for k, v in got.items() if v == ("b1", 3)} == {"b1", "b2", "b3"}
    assert all(got[c] == (c, 1) for c in ("c1", "c2", "c3", "c4")) and got["h"] == ("g", 2) and got["j"] == ("i", 2) and not {"d", "e", None} & set(got)
    assert groups(spark, []) == {}


def test_fields():
    assert [(a, b.strip()) for a, b in formatting.fields_of("Seat: 3A / Flight = XY1 / Issue - late")] == [("Seat", "3A"), ("Flight", "XY1"), ("Issue", "late")]
    assert formatting.fields_of("Name: Bob; City: Rome") == [("Name", "Bob"), ("City", "Rome")]
    assert formatting.fields_of("Well, seat: 3A") is None and formatting.fields_of("a: 1, a: 2, a: 3") is None


def near(spark, rows, **o):
    df = spark.createDataFrame(rows, "id string, text string, side string, n int")
    return {(r["a_id"], r["b_id"]): r["same"] for r in overlap.cross_split_pairs(df, key="id", text="text", side="side", **o).collect()}


def test_overlap_edges(spark):
    rows = [("a1", "one two three", "a", 1), ("b1", "One, two three!", "b", 1), ("b2", "one two", "b", 1), ("a2", "x", "a", 1), ("b3", "X", "b", 1), ("a3", None, "a", 1), ("b4", " ", "b", 1), (None, "x", "b", 1), ("a1", "one two three", "a", 2), ("b5", "x", None, 1), ("a1", "one two three", "b", 3)]
    assert near(spark, rows) == {("a1", "b1"): True, ("a2", "b3"): True}
    assert near(spark, []) == {}
    assert near(spark, [r for r in rows if r[2] == "a"]) == {}


@pytest.mark.parametrize("share", [0.9, 0.8])
def test_overlap_against_brute_force(spark, share):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        base = random.choices(vocabulary, k=random.choice([1, 2, 3, 8, 9, 10, 11, 20, 31, 75, 160]))
        for _ in range(3):
            t = list(base)
            for _ in range(random.randint(0, max(4, len(t) // 7))):
                i = random.randrange(len(t))
                random.choice([lambda: t.__setitem__(i, random.choice(vocabulary)), lambda: t.insert(i, random.choice(vocabulary)), lambda: t.pop(i) if len(t) > 1 else None, lambda: random.shuffle(t)])()
            texts.append(" ".join(t))
    rows = [(f"k{i:03d}", t, "ab"[i % 2], 0) for i, t in enumerate(texts)]
    want = set()
    for (i, s, x, _), (j, t, y, _) in itertools.product(rows, rows):
        if x == "a" and y == "b":
            p, q = Counter(s.split()), Counter(t.split())
            n = max(p.total(), q.total())
            if s.replace(" ", "") == t.replace(" ", "") or (p & q).total() >= share * n - 1e-9:
                want.add((i, j))
    assert len(want) > 30 and set(near(spark, rows, share=share)) == want


def test_blocks_grow_with_length_alone():
    """Cut texts agree in a block whenever they are within the share, and have about as many blocks as a fixed part of their words."""
    draw = np.random.default_rng(3)
    vocabulary = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    bits = 1024 * np.minimum(np.log2(np.arange(1, 3001) + 1), 11).astype(np.int64)
    by_token = dict(zip(vocabulary.tolist(), bits.tolist()))
    edges = overlap.band_edges(0.9, 4000)

    def blocks(tokens, band):
        return set(overlap.block_codes(tokens, np.array([len(tokens)]), np.array([band]), np.array([by_token[t] for t in tokens.tolist()]), edges, 0.9, 100_000)[0].tolist())

    for size in (10, 25, 90, 400, 1500) * 4:
        a = draw.choice(vocabulary, size, replace=False)
        change = int(0.1 * size)
        b = np.concatenate([a[change:], draw.choice(vocabulary[~np.isin(vocabulary, a)], change, replace=False)])
        band = int(np.searchsorted(edges, size, side="right")) - 1
        one, two = blocks(np.sort(a), band), blocks(np.sort(b), band)
        assert one & two and len(one) <= 0.9 * size + 16


def test_periods(spark):
    e = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-02-01"), ("c", None), ("d", "1970-01-01")], "id string, t string").select("id", F.to_timestamp("t").alias("created_at"))
    s = spark.createDataFrame([("tr", "training", "2024-01-01", "2024-02-01"), ("ev", "evaluation", "2024-02-01", "2024-03-01")], "split_name string, purpose string, x string, y string").select("split_name", "purpose", F.to_timestamp("x").alias("starts_at"), F.to_timestamp("y").alias("ends_at"))
    assert {(r["id"], r["side"]) for r in overlap.with_split(e, s).collect()} == {("a", "a"), ("b", "b")}
    clash = overlap.with_split(e.withColumns({"side": F.lit("z"), "starts_at": F.lit(1), "purpose": F.lit("p")}), s)
    assert {(r["id"], r["side"], r["split_name"], r["starts_at"]) for r in clash.collect()} == {("a", "a", "tr", 1), ("b", "b", "ev", 1)}
