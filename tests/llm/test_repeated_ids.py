"""Rows of one doc_id with different texts, and added tokens in two spellings."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import packing, substrings


def words(seed, n):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("abcdefgh"), 9)) for _ in range(n)]


def test_cut_leaves_other_texts_of_the_id(spark):
    shared, own, other = words(1, 80), words(2, 120), words(3, 60)
    rows = [(1, " ".join(shared + words(4, 30))), (2, " ".join(shared)), (2, " ".join(own)), (3, " ".join(other + own[:70])), (2, " ".join(own)), (2, None), (2, ""), (4, "a b c"), (4, "d"), (4, " ".join(shared + other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = substrings.passages(df)
    kept = substrings.cut(df, found).collect()
    texts = [(r.doc_id, r.text) for r in kept]
    assert len(texts) == len(rows)
    assert (1, rows[0][1]) in texts and (2, None) in texts and (4, "a b c") in texts and (4, "d") in texts
    # Each shared passage stays once; nothing else goes.
    left = [w for _, t in texts if t for w in t.split()]
    assert left.count(shared[40]) == 1 and 1 <= left.count(own[40]) <= 2  # a row that repeats its id and text is one document
    assert all(w in left for w in set(own[70:]) | set(other) | set(shared))
    assert {r.text_key is None for r in found.where("doc_id in (1, 3)").collect()} <= {True}


def test_short_texts_of_one_id(spark):
    long = words(5, 90)
    rows = [(1, " ".join(long)), (1, "three little words"), (1, "x"), (2, " ".join(long)), (2, "three little words"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted((r.doc_id, r.text) for r in substrings.cut(df, substrings.passages(df)).collect())
    assert sum(t.count(long[50]) for _, t in texts) == 1 and (1, "x") in texts and (1, "three little words") in texts


def test_added_tokens_in_every_order():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["<|startoftext|> a", "<|STARTOFTEXT|> a", "x<|endoftext|>y <|EndOfText|>", "<|endoftext|>", "a|<b <| |>"]
    for order in itertools.permutations(texts, 3):
        table = packing.Words(path)
        for text in order:
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, hashes, per = packing.C.words(raw, np.array([0, len(raw)]))
            ids, _ = table.encode(raw, starts, ends, hashes, per)
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, (order, text)


def test_packing_rows_of_both_spellings(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = {1: "<|STARTOFTEXT|> a", 2: "<|startoftext|> a", 3: "<|StartOfText|> a"}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(1).sortWithinPartitions(F.desc("doc_id"))
    for r in packing.pack(df).collect():
        assert r.doc_tokens == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
