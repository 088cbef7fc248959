import pytest
from pyspark.sql import functions as F

from deskloom.functions import text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("A &amp; B &#39;c&#39; &eacute;", "A & B 'c' é"),
        ("see https://x.y/z now", "see <url> now"),
        ("HTTPS://x.y stays, t.co/abc goes", "HTTPS://x.y stays, <url> goes"),
        ("@123 stays @1234 goes @1234abc", "@123 stays goes abc"),
        ("  a \t\n b ", "a b"),
        ("a b", "a b"),
        ("", ""),
        (None, None),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, text.clean) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("The flight to ATL was delayed 5 hours, url!", ["flight", "atl", "delayed", "hours"]),
        ("é x 字", ["é", "字"]),
        ("don't dont don’t", ["don't", "don"]),
        ("'quoted'", ["quoted"]),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(spark, raw, want):
    assert one(spark, raw, text.tokenize) == want


def test_analyze(spark):
    f = lambda c: text.analyze(text.tokenize(c))
    assert one(spark, "lost bag", f) == ["lost", "bag", "lost_bag"]
    assert one(spark, "bag", f) == ["bag"]
    assert one(spark, None, f) == []


def test_long_text(spark):
    assert len(one(spark, "bag " * 50_000, text.tokenize)) == 50_000


@pytest.mark.parametrize("raw, want", [(" Flight-Delay ", "flight_disruption"), ("REFUND COMPENSATION", "refund_compensation"), ("n/a", "other"), ("what", "other"), (None, "other")])
def test_normalise_intent(spark, raw, want):
    assert one(spark, raw, text.normalise_intent) == want


@pytest.mark.parametrize(
    "raw, want",
    [("3 e", ("booking_change", "escalate", True)), ("e 3", ("booking_change", "escalate", True)), ("12", (None, None, False)), ("praise", ("praise", None, True)), ("zz", (None, None, False)), ("zz a 1 2", ("baggage", "auto", True)), ("A", (None, None, False))],
)
def test_parse_label_command(spark, raw, want):
    assert tuple(one(spark, raw, text.parse_label_command)) == want


@pytest.mark.parametrize("raw, want", [("434n", (4, 3, 4, False)), ("4 3 4 y", (4, 3, 4, True)), ("4345y", (4, 3, 4, True)), ("634y", None), ("43y", None), ("", None), (None, None)])
def test_parse_rating(spark, raw, want):
    got = one(spark, raw, text.parse_rating)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('Sure:\n```\n{"a": {"b": 2}}\n``` done', '{"a": {"b": 2}}'),
        ('Here {"a": "} {"} and {"b": 1}', '{"a": "} {"}'),
        (r'{"a": "say \"}\" now"}', r'{"a": "say \"}\" now"}'),
        ("none", None),
        ('{"a": 1', None),
        (None, None),
    ],
)
def test_first_json_object(raw, want):
    assert text.first_json_object(raw) == want


def test_join_reasons(spark):
    f = text.join_reasons
    assert [one(spark, x, f, "array<string>") for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a and b", "a, b, and c"]


def test_request_key(spark):
    rows = spark.createDataFrame([("m", "s", "p", 1, 0.0), ("m", "s", "p", 1, 0.0), ("m", "s", "q", 1, 0.0)], "a string, b string, c string, d int, e double")
    keys = [r[0] for r in rows.select(text.request_key(*(F.col(c) for c in "abcde"))).collect()]
    assert keys[0] == keys[1] != keys[2]
