import pytest

from tessera.plans.filters import Compiler, numeric_range, where

ROWS = [("r1", 10, "deepinfra", False, "Neural Network basics", "2024-01-01T00:00:00Z"), ("r2", 60, "openai", True, "cooking", "2024-06-01T00:00:00Z"), ("r3", None, None, None, None, None), ("r4", 120, "openai", False, "neural search", "2025-01-01T00:00:00Z")]
SCHEMA = "row string, tokens int, provider string, is_truncated boolean, text string, created_at string"


def c(key, value):
    return {"key": key, "match": {"value": value}}


def r(key, **bounds):
    return {"key": key, "range": bounds}


CASES = [
    ({}, "r1 r2 r3 r4"),
    (None, "r1 r2 r3 r4"),
    ({"must": []}, "r1 r2 r3 r4"),
    ({"must": [r("tokens", gt=50)]}, "r2 r4"),
    ({"must_not": [c("is_truncated", True)]}, "r1 r3 r4"),
    ({"must": [{"key": "text", "match": {"text": "NEURAL"}}]}, "r1 r4"),
    ({"should": [c("provider", "deepinfra"), c("provider", "openai")]}, "r1 r2 r4"),
    ({"should": [{"must": [c("provider", "deepinfra")]}, {"must": [c("provider", "openai"), r("tokens", gt=100)]}]}, "r1 r4"),
    ({"tokens": ">=10 & <100"}, "r1 r2"),
    ({"tokens": ">10 & >20"}, "r2 r4"),
    ({"is_truncated": False}, "r1 r4"),
    ({"must": [r("created_at", gte="2024-06-01T00:00:00Z")]}, "r2 r4"),
    ({"must": [r("created_at", lt="2024-06-01")]}, "r1"),
    ({"must": [c("tokens", "10")]}, ""),
    ({"must": [c("absent", 1)]}, ""),
    ({"must_not": [c("absent", 1)]}, "r1 r2 r3 r4"),
    ({"must": [r("tokens", gt=5)], "should": [c("provider", "openai")], "must_not": [c("row", "r4")]}, "r2"),
    ({"must_not": [{"should": [c("row", "r1"), c("row", "r2")]}]}, "r3 r4"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.mark.parametrize("spec,expected", CASES)
def test_cases(rows, spec, expected):
    assert " ".join(sorted(x["row"] for x in where(rows, spec).collect())) == expected


def test_namespace(spark):
    df = spark.sql("select 1 as id, named_struct('tokens', 5, 'a', named_struct('b', 'x')) as metadata")
    assert where(df, {"must": [r("tokens", gte=5), c("a.b", "x")]}, "metadata").count() == 1


@pytest.mark.parametrize("bad", [{"must": [{"key": "a", "match": {"value": 1, "text": "x"}}]}, {"must": [{"key": "a", "match": {"value": 1}, "range": {"gt": 1}}]}, {"must": [{"key": "a", "range": {}}]}, {"must": [{"key": "a"}]}])
def test_rejected(rows, bad):
    with pytest.raises(ValueError):
        Compiler(rows.schema).compile(bad)


def test_numeric_range():
    assert numeric_range(" >= 10 & < 20.5 ") == {"gte": 10.0, "lt": 20.5}
    assert numeric_range("10") is None and numeric_range("> x") is None
