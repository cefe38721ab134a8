from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.filters import clean_needle

CLEAN = [("check this https://t.co/abc", "check this"), ("@user @other hello world", "hello world"), ("hello @user world", "hello @user world"), ("@user: hi", ": hi"), ("  a \t\n b  ", "a b"), ("https://x.y", ""), (None, ""), ("", ""), ("“curly”", "“curly”")]


def test_clean(spark):
    df = spark.createDataFrame([(a, b) for a, b in CLEAN], "a string, b string").select(text.clean(F.col("a")).alias("x"), "b")
    assert [r for r in df.collect() if r.x != r.b] == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab @_:/hts. \n\t"))
def test_clean_settles_after_leading_mentions(value):
    once = clean_needle(value)
    assert not once.startswith(" ") and "  " not in once


def test_combine(spark):
    cases = [(1024, None, 1024, False, False), (1025, None, 1024, False, True), (500, 514, 1024, True, False), (500, 515, 808, True, True), (800, 800, 1024, True, True), (800, 0, 800, False, False)]
    rows = [("m" * m, None if q is None else "q" * q or "  ", n, hq, t) for m, q, n, hq, t in cases]
    df = spark.createDataFrame(rows, "m string, q string, n int, hq boolean, t boolean").select(text.combine(F.col("m"), F.col("q")).alias("c"), "n", "hq", "t")
    for r in df.collect():
        assert (r.c.n_chars, r.c.has_quotes, r.c.is_truncated) == (r.n, r.hq, r.t)
    small = spark.createDataFrame([("m" * 60, "q" * 60)], "m string, q string").select(text.combine(F.col("m"), F.col("q"), 100).alias("c")).first().c
    assert (small.text, small.has_quotes, small.is_truncated) == ("m" * 60, False, True)


def test_fit_parts(spark):
    rows = [(["a" * 10, "b" * 10, "c" * 10, "d" * 10], ["<...>", "c" * 10, "d" * 10]), (["r", "x" * 50, "y" * 50, "p", "c"], ["r", "<...>", "p", "c"]), (["only"], ["only"]), ([], []), (["root", "cur"], ["root", "cur"])]
    df = spark.createDataFrame(rows, "p array<string>, e array<string>").select(text.fit_parts(F.col("p"), 25).alias("x"), "e")
    for r in df.collect():
        assert r.x == r.e


def test_urls_and_keys(spark):
    rows = [("https://a.b/x.PNG?y=1", True, ".png"), ("ftp://a.b/x.png", False, ".png"), ("nonsense", False, ".jpg"), (None, False, ".jpg"), ("http://a.b", True, ".jpg")]
    df = spark.createDataFrame(rows, "u string, w boolean, e string").select(text.is_web_url(F.col("u")).alias("x"), text.url_extension(F.col("u")).alias("y"), "w", "e")
    for r in df.collect():
        assert (r.x, r.y) == (r.w, r.e)
    one = spark.createDataFrame([("image/PNG; q=1", "12345", "ab")], "c string, k string, s string").select(text.content_type_extension(F.col("c")).alias("c"), text.shard_prefix(F.col("k")).alias("k"), text.shard_prefix(F.col("s")).alias("s"), text.labelled(F.lit("root"), F.col("k"), F.lit("2024-03-05").cast("date")).alias("l")).first()
    assert tuple(one) == (".png", "123", "misc", "[root Mar 05, 2024] 12345")
