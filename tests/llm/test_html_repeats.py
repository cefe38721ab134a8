"""Repeated substrings of a host's pages: maximal intervals, their ends and pages, against brute force; texts that repetition changes."""

from collections import defaultdict

import numpy as np

from tessera.llm import html

SCHEMA = "page_id long, url string, html string"


def words(seed, n, pool=10**6):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, pool, n)]


def test_long_repeat_is_one_row(spark):
    """A repeat of 201 tokens inside texts of their own is one interval; ends are exact whatever the length."""
    want, pages = set(), []
    for n, seed in ((8, 1), (13, 2), (16, 3), (201, 4)):
        same = words(seed, n)
        pages += [(i, f"http://x{n}/{i}", f"<div>{' '.join(words(10 * i + 100, 5) + same + words(10 * i + 101, 7))}</div>") for i in range(4)]
        want.add((f"x{n}", n, 4, " ".join(same)))
    got = html.repeats(spark.createDataFrame(pages, SCHEMA)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def longest(blocks_of, need, run=8):
    """By brute force: of every (page, block, position) the longest prefix that `need` pages hold."""
    seen = defaultdict(set)
    for p, blocks in blocks_of.items():
        for b in blocks:
            for i in range(len(b)):
                for j in range(i + run, len(b) + 1):
                    seen[tuple(b[i:j])].add(p)
            if len(b) < run:
                seen[(None, *b)].add(p)
    out = {}
    for p, blocks in blocks_of.items():
        for k, b in enumerate(blocks):
            reached = 0
            for i in range(len(b)):
                best = max((j for j in range(i + run, len(b) + 1) if len(seen[tuple(b[i:j])]) >= need), default=0)
                if len(b) < run and i == 0 and len(seen[(None, *b)]) >= need:
                    best = len(b)
                if best > reached:
                    reached = best
                    out[p, k, i, best] = tuple(b[i:best])
    return out


def test_intervals_against_brute_force(spark):
    """Nested, overlapping and self-repeating substrings."""
    rng = np.random.default_rng(5)
    base = words(1, 60)
    blocks_of = {}
    for p in range(9):
        blocks = []
        for k in range(3):
            b = []
            for _ in range(rng.integers(1, 4)):
                lo, n = rng.integers(0, 50), rng.integers(2, 40)
                b += base[lo : lo + n] if rng.random() < 0.7 else words(int(rng.integers(1 << 30)), int(n) // 4 + 1)
            blocks.append(b if rng.random() < 0.8 else b[:4])
        blocks_of[p] = blocks + [["again"] * (12 + p % 3), ["short", "one"]]
    pages = [(p, f"http://y/{p}", "".join(f"<div>{' '.join(b)}</div>" for b in blocks)) for p, blocks in blocks_of.items()]
    want = defaultdict(set)
    for (p, *_), t in longest(blocks_of, 3).items():
        want[t].add(p)
    got = html.repeats(spark.createDataFrame(pages, SCHEMA)).collect()
    assert {(r.n_tokens, r.n_pages, r.text) for r in got} == {(len(t), len(ps), " ".join(t)) for t, ps in want.items()} and len(got) == len(want)


def test_repetition_decides(spark):
    """Menus and notices without a name that says so go only by repetition; without it they would stay."""
    notice = " ".join(words(7, 30))
    pages = [(i, f"http://z/{i}", f"<div>{notice}</div><div>{' '.join(words(50 + i, 40))}</div>") for i in range(5)]
    df = spark.createDataFrame(pages, SCHEMA)
    own = {i: " ".join(words(50 + i, 40)) for i in range(5)}
    assert {r.page_id: r.text for r in html.extract(df).collect()} == own
    assert {r.page_id: r.text for r in html.extract(df, min_pages=10**9).collect()} == {i: f"{notice}\n{t}" for i, t in own.items()}


def test_very_long_blocks(spark):
    """A repeated block of 3,000 tokens with a token of its own in the middle."""
    same = words(9, 3_000)
    pages = [(i, f"http://l/{i}", f"<div>{' '.join(same[:1_500] + [f'own{i}'] + same[1_500:])}</div>") for i in range(3)]
    got = html.extract(spark.createDataFrame(pages, SCHEMA)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own{i}" for i in range(3)}


def test_no_repeats(spark):
    assert html.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, None, "<p>one two three</p>"), (1, None, None), (None, "http://a/", "")], SCHEMA)
    assert html.repeats(one).count() == 0 and html.extract(one).count() == 3
