"""Forms and names in pages; posteriors of the quality classifier recomputed in plain Python."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import html, quality


def test_forms_around_articles(spark):
    pages = [
        (1, "http://a/1", "<body><form action=x>Search here<input><article><h1>Title</h1><p>Text of it.</p></article>and a login</form></body>"),
        (2, "http://a/2", "<main><p>Before.</p><form>Your name <button>Go</button></form><p>After.</p></main>"),
        (3, "http://a/3", "<article><p>One.</p><form><p>Not this</p></form><div class='social'><p>The social question.</p></div><p>Two.</p></article>"),
        (4, "http://a/4", "<form class='comment-form'><article><p>A reader's words</p></article></form><article><p>Real.</p></article>"),
        (5, "http://a/5", "<form><form><main><p>Deep.</p></main></form></form>"),
        (6, "http://a/6", "<form><p>Only a form</p></form>"),
        (7, "http://a/7", "<article><nav>menu</nav><p class='hidden-gem'>Kept.</p><p class='share'>Share of the market.</p></article>"),
    ]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "Title\nText of it.", 2: "Before.\nAfter.", 3: "One.\nThe social question.\nTwo.", 4: "Real.", 5: "Deep.", 6: "", 7: "Kept.\nShare of the market."}


def strength(groups, means):
    """Prior strength of groups (n, sum) around their means, by moments."""
    spread = sum(n * (s / n - m) ** 2 for (n, s), m in zip(groups, means))
    error = sum(m * (1 - m) for m in means)
    between = max((spread - error) / sum(n * m * (1 - m) for (n, _), m in zip(groups, means)), 1e-4)
    return min(max(1 / between - 1, 1.0), 1e4)


def posteriors(rows):
    """(host_p, path_p, posterior) of rows (source, lang, document_p, evidence)."""
    n, s = defaultdict(int), defaultdict(float)
    for source, lang, p, _ in rows:
        for key in ((), (source,), (source, lang)):
            n[key] += 1
            s[key] += p
    mean = min(max(s[()] / n[()], 1e-6), 1 - 1e-6)
    hosts, paths = [k for k in n if len(k) == 1], [k for k in n if len(k) == 2]
    k1 = strength([(n[h], s[h]) for h in hosts], [mean] * len(hosts))
    host = {h: (s[h] + k1 * mean) / (n[h] + k1) for h in hosts}
    k2 = strength([(n[g], s[g]) for g in paths], [host[g[:1]] for g in paths])
    out = []
    for source, lang, p, e in rows:
        h, g = (source,), (source, lang)
        without = (s[h] - p + k1 * mean) / (n[h] - 1 + k1)
        rest = min(max((s[g] - p + k2 * without) / (n[g] - 1 + k2), 1e-4), 1 - 1e-4)
        odds = e + quality.WEIGHT * (np.log(rest / (1 - rest)) - np.log(mean / (1 - mean)))
        out.append((host[h], (s[g] + k2 * host[h]) / (n[g] + k2), 1 / (1 + np.exp(-odds))))
    return out


def test_posteriors_by_hand(spark):
    """host_p and path_p of every document from document_p, with groups of one row, null names and rows that repeat an id."""
    r = np.random.default_rng(4)
    words = ["good", "text", "of", "some", "length", "and", "more", "noise", "xx", "1234"]
    rows, labels = [], []
    for i in range(240):
        source = [None, "big", "big", "big", "s1", "s2", f"only{i}"][int(r.integers(0, 7))]
        lang = [None, "en", "de", f"l{i}"][int(r.integers(0, 4))]
        rows.append((i, " ".join(r.choice(words, int(r.integers(0, 60)))), lang, source))
        if i % 2:
            labels.append((i, int(r.integers(0, 2)), 0))
    rows += [rows[3], (None, "good text", "en", "big"), (1000, None, "en", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), columns=["doc_id", "source", "lang"]).collect()
    assert len(found) == len(rows)
    want = posteriors([(x["source"], x["lang"], x["document_p"], x["evidence"]) for x in found])
    for x, (host, path, posterior) in zip(found, want):
        assert abs(x["host_p"] - host) < 1e-9 and abs(x["path_p"] - path) < 1e-9 and abs(x["posterior"] - posterior) < 1e-9
        assert x["keep"] == (posterior >= quality.THRESHOLD) or abs(posterior - quality.THRESHOLD) < 1e-9
