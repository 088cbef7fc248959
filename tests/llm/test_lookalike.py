import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskloom.llm import lookalike as L


def forms(texts):
    return L.run_sql(pa.table({"x": pa.array(texts, pa.string())}), f"SELECT {L.own_script_sql('y')} AS y FROM (SELECT {L.form_sql('x')} AS y FROM batch)").column("y").to_pylist()


@pytest.mark.parametrize(
    "a, b",
    [("Ｆｕｌｌ　１２", "Full 12"), ("é", "é"), ("a​b", "ab"), ("a b c d", "a b c d"), ("ﬁne ﬂow oﬀ", "fine flow off"), ("сору", "copy"), ("nο Αu", "no Au"), ("ｅ́", "é"), ("e​́", "é"), ("😀‍ x", "😀 x"), ("ԝaѕ ɡone", "was gone"), ("cпacибo", "спасибо"), ("nо\u0308", "nö"), ("ёӓ", "ëä"), ("Έ", "É"), ("𝐇𝐞𝐥𝐥𝐨 𝟚", "Hello 2"), ("𝛼b", "ab")],
)
def test_same_look(a, b):
    x, y = forms([a, b])
    assert x == y


@pytest.mark.parametrize("a, b", [("A", "a"), ("a b", "a  b"), ("a\tb", "a b"), ("a\nb", "a b"), ("é", "e"), ("O", "0"), ("a.", "a"), ("1", "2"), ("👩‍✈️", "👩✈️")])
def test_different_look(a, b):
    x, y = forms([a, b])
    assert x != y


def test_real_scripts_stay_readable():
    assert forms(["спасибо", "καλημέρα", "谢谢 شكرا ありがとう", None, ""]) == ["спасибо", "καλημέρα", "谢谢 شكرا ありがとう", None, ""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_a_form_is_its_own_form(texts):
    texts = [t.replace("\x00", "").replace("﷑", "").replace("﷒", "") for t in texts]
    once = forms(texts)
    assert forms(once) == once
    assert all(unicodedata.is_normalized("NFC", x) for x in once)


def test_pairs(spark):
    rows = [("a", "сору", None, 1), ("b", "copy", "x", 2), ("b", "copy", "x", 3), ("c", "copy", "Ｘ", 4), ("d", "copy", " ", 5), ("e", None, " ", 6), (None, "сору", "x", 7), ("f", "", "", 8), ("g", "z" * 50_000, "q", 9), ("h", "z" * 49_999 + "​z", "q", 9)]
    df = spark.createDataFrame(rows, "id string, customer_text string, brand_reply string, form int")
    got = {tuple(r) for r in L.same_looking_pairs(df, key="id", fields=["customer_text", "brand_reply"]).collect()}
    assert got == {("a", "b", "customer_text"), ("a", "c", "customer_text"), ("a", "d", "customer_text"), ("g", "h", "customer_text")}
    assert L.same_looking_pairs(df.where("false"), key="id", fields=["customer_text"]).count() == 0


def test_other_columns_pass(spark):
    df = spark.createDataFrame([(1, "nο", [1, 2]), (2, None, None)], "batch long, x string, y array<int>")
    assert sorted(map(tuple, L.consistent_text(df, ["x"]).collect())) == [(1, "no", [1, 2]), (2, None, None)]


def test_classes(spark):
    rows = [("a", "copy", 1), ("b", "сору", 1), ("c", "copy", 2), ("c", "copy", 3), ("d", "Copy", 1), ("e", None, 1), (None, "copy", 1), ("f", "\u200b ", 1), ("g", "x" * 50_000, 1)]
    df = spark.createDataFrame(rows, "id string, t string, members int")
    got = {r["episode_id"]: (r["first_id"], r["members"], r["spellings"]) for r in L.same_looking_classes(df, key="id", fields=["t"]).collect()}
    assert got == {"a": ("a", 3, 2), "b": ("a", 3, 2), "c": ("a", 3, 2), "d": ("d", 1, 1), "g": ("g", 1, 1)}
    assert L.same_looking_classes(df.where("false"), key="id", fields=["t"]).count() == 0


def test_large_batches_are_taken_in_parts(monkeypatch):
    texts = [f"ｔｅｘｔ {i} " + "é" * (i * 50) for i in range(60)] + [None, ""]
    whole = forms(texts)
    monkeypatch.setattr(L, "PART_BYTES", 2_000)
    assert forms(texts) == whole
