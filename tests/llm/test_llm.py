"""Corpus operators against brute force, round trips and defined edge cases."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, html, licenses, media, mixing, near_vectors, ngram_join, packing, quality, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, g string, bucket int, n long, keep string, evidence string"


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(n))


def edited(text, at, words):
    w = text.split()
    w[at : at + len(words)] = words
    return " ".join(w)


BASE = prose(1, 200)
SHARED = prose(2, 70)
TEXTS = {
    0: BASE,
    1: BASE,
    2: BASE.upper(),
    3: edited(BASE, 50, ["changed", "words"]),
    4: edited(edited(BASE, 50, ["changed", "words"]), 150, ["more", "changes", "here"]),
    5: None,
    6: "",
    7: " \t\n ",
    8: "three little words",
    9: "Three little\nwords",
    10: prose(3, 100) + "\n" + SHARED + "\n" + prose(4, 60),
    11: SHARED + " " + prose(5, 30),
    12: prose(6, 20) + "\n\n" + edited(SHARED, 35, ["odd"]),
    13: prose(7, 9000),
    14: "é ü ß 漢字 😀   x" * 40,
    15: "<|startoftext|> it's 12 O'Clock<|endoftext|> \x1c \x85 end",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k == 3 else "en", None if k in (8, 13) else "" if k == 9 else f"s{k % 2}", None, "g", 1, 2, "k", "e") for k, t in TEXTS.items()]
    rows += [rows[10], (None, BASE, "en", "s0", None, "g", 1, 2, "k", "e")]  # a repeated row, a null id
    return common.written(spark.createDataFrame(rows, DOC))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def shingles(text):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for k, s in sets.items():
        for j, n in Counter(j for g in s for j in index[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            index[g].add(k)
    return {k: find(k) for k in sets}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [tuple(map(int, x)) for x in rng.integers(2000, 2400, (250, 2))] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == find(k) for k in parent) and len(got) == len(set(got))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_shingles():
    import pyarrow as pa

    texts = list(TEXTS.values())
    seen = []
    for _, data, offs in common.chunks(pa.array(texts), 500):
        starts, ends, hashes, per = common.words(data, offs)
        sh, cuts = common.shingles(hashes, per)
        for i in range(len(offs) - 1):
            seen.append((per[i + 1] - per[i], len(np.unique(sh[cuts[i] : cuts[i + 1]]))))
    assert seen == [(len(WORD.findall(t or "")), len(shingles(t))) for t in texts]


def test_ngram_join(docs, none):
    want = groups({k: shingles(t) for k, t in TEXTS.items()})
    got = ngram_join.join(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == len(shingles(BASE))
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(shingles(TEXTS[r.doc_id])))
    assert ngram_join.join(none).count() == 0


def test_ngram_chain_and_tree(spark):
    """A chain of small edits: ends are far apart, neighbours link; plus texts that nearly link."""
    texts, t = {}, prose(20, 120)
    for i in range(30):
        texts[i] = t
        t = edited(t, (i * 7) % 110, ["step", f"n{i}"])
    for i in range(30, 45):
        texts[i] = edited(edited(prose(21, 60), (i * 3) % 50, [f"x{i}"]), (i * 5 + 20) % 50, [f"y{i}", "z"])
    more = [(0, prose(22, 80)), (99, edited(prose(22, 80), 3, ["other"])), (98, texts[0]), (98, prose(23, 50)), (97, edited(prose(23, 50), 48, ["other"]))]  # ids with two texts
    df = spark.createDataFrame([*texts.items(), *more], "doc_id long, text string")
    want = groups({k: shingles(t) for k, t in texts.items()})
    want |= {99: 0, 98: 0, 97: 0}
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == want and want[0] == 0


def test_traverse_is_complete():
    """Leaves that hold a linking pair of different components meet, and the pairs are found; none below the threshold is."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(20, 60)).astype(np.uint64)) for _ in range(40)]
    for _ in range(60):
        s = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.r_[s[rng.random(len(s)) > 0.08], rng.integers(0, 400, 2).astype(np.uint64)]))
    order = sorted(range(100), key=lambda i: len(sets[i]))
    none = np.zeros(0, np.uint64)
    leaves = [order[i : i + 7] for i in range(0, 100, 7)]
    nodes = [ngram_join.node(k, [(i, i, len(sets[i]), ngram_join._prefix(sets[i], none, none, 80)) for i in leaf]) for k, leaf in enumerate(leaves)]
    met = {(p, q): (a, b) for part in (ngram_join.traverse(nodes[:8], None), ngram_join.traverse(nodes[8:], None), ngram_join.traverse(nodes[:8], nodes[8:])) for p, q, a, b in part}
    assert len(met) < len(leaves) * (len(leaves) + 1) // 2
    side = lambda ids: (ids, ids, [sets[i] for i in ids])
    found = {frozenset(p) for a, b in met.values() for p in ngram_join.links(side(a), side(b))}
    asked = {frozenset((i, j)) for a, b in met.values() for i in a for j in b}
    parent = list(range(100))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in map(tuple, found):
        parent[find(x)] = find(y)
    for i in range(100):
        for j in range(i + 1, 100):
            k = len(np.intersect1d(sets[i], sets[j]))
            good = 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k)
            assert k == ngram_join.overlaps([sets[i]], [sets[j]], columns=16)[0, 0]
            assert good or frozenset((i, j)) not in found
            if good:
                assert find(i) == find(j) and frozenset((i, j)) in asked


def test_near_copies_that_miss_each_other(spark):
    """Heavily edited copies link with the original only, next to copies of another, some long and some short texts."""
    rng = np.random.default_rng(8)
    texts = {}
    for g in range(3):
        base = prose(700 + g, 150)
        texts[g * 100 + 50] = base
        for i in range(45):
            t = base.split()
            for at in rng.choice(150, 1 + i % 6, replace=False):
                t[at] = f"e{g}x{i}x{at}"
            texts[g * 100 + i] = " ".join(t)
    texts[900], texts[901] = prose(800, 30_000), edited(prose(800, 30_000), 15_000, ["other"] * 40)
    texts |= {1000 + i: prose(900, 4 + i % 3) for i in range(6)}
    want = groups({k: shingles(t) for k, t in texts.items()})
    got = ngram_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_one_of_each(docs):
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(docs).where("doc_id is not null").collect())
    want = groups({k: shingles(t) for k, t in TEXTS.items()})
    assert kept == sorted(k for k in TEXTS if want[k] == k)


def test_substrings(docs, none):
    found = substrings.passages(docs.where("doc_id >= 5")).collect()
    spans = {(r.doc_id, r.first_doc_id): (r.start_word, r.end_word, r.first_word) for r in found}
    assert spans[(11, 10)] == (0, 70, 100) and spans[(12, 10)][:2] == (20, 90) and set(spans) == {(11, 10), (12, 10)}
    cut = {r.doc_id: r.text for r in substrings.cut(docs.where("doc_id >= 10 and doc_id < 15"), substrings.passages(docs.where("doc_id >= 5"))).collect()}
    assert cut[11] == prose(5, 30) and cut[12] == prose(6, 20) and cut[10] == TEXTS[10] and cut[14] == TEXTS[14]
    assert substrings.passages(none).count() == 0


def test_exact_passages_are_found(spark):
    """Every run of 51 words that an earlier document has is covered, over random splices."""
    rng = np.random.default_rng(5)
    pool = [prose(100 + i, 51 + i * 3) for i in range(6)]
    texts = {i: " ".join(prose(1000 + 10 * i + j, int(rng.integers(5, 80))) if rng.random() < 0.6 else pool[rng.integers(6)] for j in range(8)) for i in range(25)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cover = {i: np.zeros(len(t.split()), bool) for i, t in texts.items()}
    for r in substrings.passages(df).collect():
        cover[r.doc_id][r.start_word : r.end_word] = True
    seen: dict = {}
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 50):
            if seen.setdefault(tuple(w[k : k + 51]), i) != i:
                assert cover[i][k : k + 51].all()


def test_passages_behind_partial_copies(spark):
    """Documents that share a passage meet even if earlier ones hold only parts of it, each of under 50 words."""
    rows, at = [], 0
    for i in range(12):
        p = prose(3000 + i, 51 if i % 2 else 60).split()
        parts = [p[:40], p[-40:]] if i % 3 else [p[:30], p[10:48], p[-30:]]
        rows += [(at + j, " ".join([prose(4000 + 10 * i + j, 60), *x, prose(5000 + 10 * i + j, 60)])) for j, x in enumerate([*parts, p, p])]
        at += len(parts) + 2
        # An earlier place of the first document itself holds a part.
        rows += [(at, " ".join([*p[::-1][:40], prose(6000 + i, 70), *p[::-1], prose(7000 + i, 60)])), (at + 1, " ".join([prose(8000 + i, 60), *p[::-1]]))]
        at += 2
    found = {(r.doc_id, r.first_doc_id) for r in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).where("end_word - start_word >= 50").collect()}
    want, at = set(), 0
    for i in range(12):
        n = 2 if i % 3 else 3
        want |= {(at + n + 1, at + n), (at + n + 3, at + n + 2)}
        at += n + 4
    assert found == want


def test_passages_with_inserted_and_deleted_words(spark):
    """An 80-word passage with a word more or less in the middle is found whole."""
    rows = []
    for i in range(20):
        p = prose(9000 + i, 80).split()
        q = p[:40] + ["between"] + p[40:] if i % 2 else p[:40] + p[41:]
        rows += [(2 * i, " ".join([prose(9100 + i, 60), *p, prose(9200 + i, 60)])), (2 * i + 1, " ".join([prose(9300 + i, 50), *q, prose(9400 + i, 60)]))]
    found = {r.doc_id: r for r in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = [i for i in range(20) if (r := found.get(2 * i + 1)) and r.first_doc_id == 2 * i and r.start_word <= 52 and r.end_word >= 127 and r.similarity >= 0.8]
    assert len(whole) >= 18
    assert all(r.doc_id == r.first_doc_id + 1 for r in found.values())


def test_near_passages_against_brute_force(spark):
    """Passages with a word changed here and there: those whose shingle sets reach 0.8 by brute force are found, nearly all of them."""
    rng = np.random.default_rng(12)
    rows, want = [], set()
    for i in range(60):
        p = prose(20_000 + i, int(rng.integers(70, 160))).split()
        q = list(p)
        for k in range(int(rng.integers(1, 5))):
            q[rng.integers(5, len(q) - 5)] = f"x{k}"
        a, b = shingles(" ".join(p)), shingles(" ".join(q))
        rows += [(2 * i, " ".join([prose(21_000 + i, 60), *p, prose(22_000 + i, 60)])), (2 * i + 1, " ".join([prose(23_000 + i, 50), *q, prose(24_000 + i, 60)]))]
        if len(a & b) >= 0.8 * len(a | b):
            want.add(2 * i + 1)
    texts = dict(rows)
    found = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        a, b = texts[r.doc_id].split()[r.start_word : r.end_word], texts[r.first_doc_id].split()
        assert r.end_word - r.start_word >= 50 and r.doc_id == r.first_doc_id + 1
        if r.similarity == 1.0:
            assert a == b[r.first_word : r.first_word + len(a)]
    assert len(want & {r.doc_id for r in found}) >= 0.95 * len(want) and len(want) > 20


def test_texts_that_repeat_themselves(spark):
    """A line that one text holds a thousand times and another once: all its places are found, in few rows."""
    line = prose(1, 60)
    rows = [(0, prose(2, 40) + " " + line), (1, " ".join([line] * 1000)), (2, prose(3, 30) + " " + " ".join([line] * 3))]
    covered = np.zeros(60_000, bool)
    found = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        if r.doc_id == 1:
            covered[r.start_word : r.end_word] = True
    assert covered.reshape(1000, 60).all(1).mean() > 0.99 and len(found) < 5000


def test_extents():
    rng = np.random.default_rng(1)
    keys = common.mix(rng.permutation(500).astype(np.uint64))
    per = np.array([0, 180, 200, 500])
    spots = substrings.window_minima(keys, per, 20)
    want = {int(np.argmin(keys[s : s + 20]) + s) for a, b in zip(per, per[1:]) for s in range(a, b - 19)}
    assert set(spots.tolist()) == want
    for a, b in zip(per, per[1:]):
        own = spots[(spots >= a) & (spots < b)]
        for p, l, r in zip(own, *substrings.extents(keys, own, a, b)):
            assert keys[l : r + 1].min() == keys[p] and (l == a or keys[l - 1] < keys[p]) and (r == b - 1 or keys[r + 1] < keys[p])


def test_mixing(docs, none):
    rows = mixing.mixed(docs, block=16).collect()
    assert len(rows) == len(TEXTS) + 2
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.size == len(WORD.findall(TEXTS[r.doc_id] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    assert order[0] == ""
    weight = {s: 1.0 + i % 3 for i, s in enumerate(order)}
    level = 0.0
    while True:
        held = sum(3 * sizes[s] for s in order if 3 * sizes[s] < weight[s] * level)
        new = (sum(sizes.values()) - held) / sum(weight[s] for s in order if 3 * sizes[s] >= weight[s] * level)
        if new <= level:
            break
        level = new
    for s in order:
        assert abs(targets[s] - min(3 * sizes[s], weight[s] * level)) < 1e-6 and abs(taken[s] - targets[s]) <= 0.5
    again = mixing.mixed(docs, block=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows)) and mixing.mixed(none).count() == 0


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        p = mixing.permuted(np.arange(n), n, 99)
        assert sorted(p) == list(range(n)) and all(mixing._position(int(p[i]), n, 99) == i for i in range(0, n, 7))


def test_mixed_texts(docs):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.mixed(one, block=16).collect()}
    words = Counter()
    for r in mixing.mixed_texts(one, block=16).collect():
        w, whole = WORD.findall(r.text), WORD.findall(TEXTS[r.doc_id])
        words[r.doc_id] += len(w)
        assert set(w) <= set(whole) and r.n_chars == len(r.text)
    assert dict(words) == {k: v for k, v in taken.items() if v}


def test_mixed_texts_of_null_and_repeated_ids(docs):
    """Rows without an id, or with one that others have, are documents like others: the mix has as many words as the plan takes."""
    plan = Counter()
    for r in mixing.mixed(docs, block=16).collect():
        plan[r.doc_id] += r.taken
    got = Counter()
    for r in mixing.mixed_texts(docs, block=16).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert dict(got) == {k: v for k, v in plan.items() if v} and got[None]


def test_taken_words_by_brute_force(spark):
    """Each document's taken words, from the blocks and permutations themselves."""
    texts = {i: (prose(i, 7 + i * 3), "ab"[i % 2]) for i in range(20)}
    df = spark.createDataFrame([(k, t, s) for k, (t, s) in texts.items()], "doc_id long, text string, source string")
    placed, _, slots = mixing.mix(df, block=8, shards=4)
    read = Counter()
    for r in slots.collect():
        for w in range(8 if r.whole else r.part):
            read[r.g, r.block * 8 + w] += 1
    want = {r.doc_id: sum(read[r.g, r.start + i] for i in range(r.size)) for r in placed.collect()}
    assert {r.doc_id: r.taken for r in mixing.mixed(df, block=8, shards=4).collect()} == want


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [1] for k, t in [*TEXTS.items(), (None, BASE)]}
    rows = packing.pack(docs).collect()
    cover, sequences = Counter(), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        cover[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(cover[k] == len(x) * (2 if k == 10 else 1) for k, x in ids.items())
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(none).count() == 0


def test_hilbert_is_a_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    h = packing.hilbert(grid, 3)
    order = grid[np.argsort(h)].astype(int)
    assert sorted(h.tolist()) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_media(docs, none, spark, tmp_path):
    folder = media.store(docs, str(tmp_path / "a"), archive_bytes=2000)
    rows = media.described(spark, folder, rangeBytes=700).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        raw = ((BASE if r.doc_id is None else TEXTS[r.doc_id]) or "").encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    same = {(r.media_sha256, r.feature, r.media_bytes) for r in rows if r.doc_id in (0, 1, None)}
    assert len(same) == 1 and media.described(spark, media.store(none)).count() == 0


def test_media_folder_must_exist(spark, tmp_path):
    with pytest.raises(Exception):
        media.described(spark, str(tmp_path / "nowhere")).count()
    assert media.arrow_uri("s3a://bucket/x") == "s3://bucket/x" and media.arrow_uri("/a/b") == "/a/b"


def test_media_retries(docs, tmp_path, monkeypatch):
    media.store(docs, str(tmp_path / "a"), archive_bytes=1 << 30)
    reader = media.ArchiveReader({"path": str(tmp_path / "a"), "retries": "2"})
    spans = reader.partitions()
    total = sum(b.num_rows for s in spans for b in reader.read(s))
    assert total == len(TEXTS) + 2
    span = max(spans, key=lambda s: s.size)
    calls = []

    class Flaky:
        def open_input_file(self, path):
            calls.append(path)
            if len(calls) < 3:
                raise OSError("lost")
            return media._open(str(tmp_path))[0].open_input_file(path)

    first = open(span.archive, "rb").read(40)
    assert reader._member(Flaky(), span, 0, 40, zlib.crc32(first)) == first and len(calls) == 3
    raw = bytearray(open(span.archive, "rb").read())
    raw[20] ^= 1
    open(span.archive, "wb").write(raw)
    with pytest.raises(OSError):
        list(reader.read(span))


def test_licenses(spark, docs, none):
    texts = ["Licensed under the Apache-License, Version 2.0.", "released under the MIT license; GNU GENERAL\nPublic license", "cc by cc by-NC 4.0 and licensed under CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3 or (at your option) any later version", "apache  lic license", None, "", "mit xlicense", "é mit license", licenses.TEMPLATES["mit-text"][0].replace("<<any 1 6 /.*/>>", "fine font").replace("<<any 1 2 /.*/>>", "Font").replace("<<optional>>(including the next paragraph)<<end>>", "")]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    base = [(1, 3, 3, "apache", "apache,apache-2.0", 1.0), (2, 3, 5, "gpl,mit", "gpl,mit,mit-notice", 1.0), (3, 0, 10, "cc-by", "cc-by,cc-by-nc-4.0", 1.0), (1, 6, 6, "gpl", "gpl,gpl-3.0", 1.0), (0, None, None, "", "", 0.0), (0, None, None, "", "", 0.0), (0, None, None, "", "", 0.0), (0, None, None, "", "", 0.0), (1, 1, 1, "mit", "mit", 0.5), (0, None, None, "", "mit-text", 1.0)]
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows] == base
    for r in licenses.scan(docs).collect():
        t = BASE if r.doc_id is None else TEXTS[r.doc_id]
        assert r.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)))
    assert licenses.scan(none).count() == 0


def _naive(parts, words, at):
    """All ends of a template, given as nested parts, from a place on."""
    if not parts:
        return {at}
    (kind, *rest), after = parts[0], parts[1:]
    if kind == "word":
        return _naive(after, words, at + 1) if at < len(words) and words[at] == rest[0] else set()
    if kind == "optional":
        return _naive(after, words, at).union(*(_naive(after, words, e) for e in _naive(rest[0], words, at)))
    low, high, pattern = rest
    ends = set()
    for n in range(high + 1):
        if n and (at + n > len(words) or not re.fullmatch(pattern, words[at + n - 1])):
            break
        if n >= low:
            ends |= _naive(after, words, at + n)
    return ends


def test_automata_against_a_naive_matcher():
    rng = np.random.default_rng(7)

    def made(depth):
        out = []
        for _ in range(rng.integers(1, 4)):
            k = rng.random()
            if k < 0.55 or depth == 2:
                out.append(("word", "abc"[rng.integers(3)]))
            elif k < 0.8:
                out.append(("optional", made(depth + 1)))
            else:
                low_ = int(rng.integers(0, 2))
                out.append(("any", low_, low_ + int(rng.integers(1, 3)), ("a|b", ".*", "c")[rng.integers(3)]))
        return out

    def text(parts):
        return " ".join(p[1] if p[0] == "word" else f"<<optional>>{text(p[1])}<<end>>" if p[0] == "optional" else f"<<any {p[1]} {p[2]} /{p[3]}/>>" for p in parts)

    for _ in range(60):
        templates = {f"t{i}": [("word", "abc"[rng.integers(3)]), *made(0)] for i in range(4)}
        machine = licenses.compiled({k: [text(p)] for k, p in templates.items()}, {})
        words = ["abcd"[i] for i in rng.integers(0, 4, 40)]
        want = {(k, i, max(e)) for k, p in templates.items() for i in range(40) if (e := _naive(p, words, i))}
        assert {(k[1], i, e) for k, i, e in machine.find([w.encode() for w in words])} == want


def test_license_library(spark):
    """Every template is found in its own wording, with regions filled or left out, and not when a mandatory word is changed."""
    rows, want = [], []
    for label, some in licenses.TEMPLATES.items():
        for t in some:
            full = re.sub(r"<<any (\d+) \d+ /(.*?)/>>", lambda m: " ".join([m[2].split("|")[0] if m[2] != ".*" else "Someone"] * int(m[1])), t)
            plain_ = re.sub("<<(optional|end)>>", " ", full)
            rows.append(plain_)
            want.append(label)
    rows.append(rows[want.index("isc-text")].replace("consequential", "other"))
    got = licenses.scan(spark.createDataFrame([(i, f"start {t} stop") for i, t in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(w in r.labels.split(",") for w, r in zip(want, got)) and got[-1].labels == ""
    long = licenses.scan(spark.createDataFrame([(0, prose(1, 100_000) + " mit license")], "doc_id long, text string")).first()
    assert (long.n_words, long.n_base, long.first_word) == (100_002, 1, 100_000)


def test_quality(spark, docs, none):
    good = [(i, prose(300 + i, 120 + i), "en", f"s{i % 4}", i % 10 != 0) for i in range(120)]
    bad = [(1000 + i, prose(600 + i, 100 + i).upper().replace(" ", "!! "), "en", f"s{i % 4}", i % 10 != 0) for i in range(60)]
    df = spark.createDataFrame([x[:4] for x in good + bad], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(x[0], int(x[0] < 1000)) for x in good + bad if x[4]] + [(None, 1), (5, None)], "doc_id long, quality int")
    held = {x[0] for x in good + bad if not x[4]}
    out = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(out) == 180 and all(out[k].keep == (k < 1000) for k in held)
    some = quality.classify(docs, labels)
    assert some.count() == len(TEXTS) + 2 and some.where("posterior is null or keep is null").count() == 0
    assert some.columns.count("keep") == 1
    assert quality.classify(none, labels).count() == 0 and quality.classify(docs, labels.where("false")).where("keep").count() == len(TEXTS) + 2


def test_shrinkage(spark):
    """A site of one document stays near its parent; a large one keeps its own mean."""
    rows = [("a", "x", 0.9)] * 500 + [("b", "x", 0.1)] * 500 + [("c", "x", 0.0)]
    got, mean = quality.sites(spark.createDataFrame(rows, "source_key string, lang_key string, p double"))
    path = {r.source_key: r.path for r in got.collect()}
    assert abs(path["a"] - 0.9) < 0.02 and abs(path["b"] - 0.1) < 0.02 and path["c"] > 0.05


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    hot = rng.standard_normal(16)
    x[50:150] = hot + 0.12 * rng.standard_normal((100, 16)) * np.linalg.norm(hot) / 4
    x[150:160] = x[40] + 0.2 * rng.standard_normal((10, 16))
    x[160] = x[41] * 7
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, []), (405, [float("inf")] * 16), (406, x[0][:8].tolist()), (None, x[0].tolist()), (160, x[160].tolist())]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    label = np.arange(300)
    while ((new := np.minimum(label, np.where(links, label[None], 999).min(1))) != label).any():
        label = new
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    found = 0
    for r in got:
        if r.vec_id is None or r.vec_id >= 400:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept
        else:
            assert r.n_links <= links[r.vec_id].sum() and r.kept == (r.component_id == r.vec_id) and label[r.component_id] == label[r.vec_id]
            found += r.n_links
    assert found >= 0.97 * (links.sum() + links[160].sum())
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_links_between_members_of_different_balls(spark):
    """Members near the edges of two balls link, though the balls' centres are 46 degrees apart."""
    rng = np.random.default_rng(6)
    rows, groups = [], 150
    for i in range(groups):
        u, v = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for j, angle in enumerate((0, 46, 12, 34)):
            rows.append((i + j * groups, (np.cos(np.radians(angle)) * u + np.sin(np.radians(angle)) * v).tolist()))
    got = {r.vec_id: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = [all(got[i + j * groups].component_id == i for j in range(4)) and got[i + 2 * groups].n_links == 2 for i in range(groups)]
    assert sum(whole) >= 0.98 * groups


def test_collision_windows_cross_batches():
    import pyarrow as pa

    line, region = np.zeros(40, np.int64), np.repeat([1, 2], 20)
    value = np.r_[np.sort(np.random.default_rng(0).random(20)), np.sort(np.random.default_rng(1).random(20))]
    ids = np.arange(40)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 3]) for c in (ids, line, region, value)], ["vec_id", "line", "region", "value"]) for i in range(0, 40, 3)]
    got = Counter((a, b) for r in near_vectors._collisions(0.2)(batches) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist()))
    want = Counter((i, j) for i in range(40) for j in range(i + 1, 40) if region[i] == region[j] and value[j] - value[i] <= 0.2)
    assert got == want


PAGES = [
    ("<html><head><title>t</title><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav><article><h1>Head &amp; &#65;</h1><div class='ad'>buy</div><p>One <b>two</b>\n three<br><p>four<aside>x</aside><form><p>mail</p></form><section class='comments'><p>nice</p></section></article><footer>&copy;</footer></body>", "Head & A\nOne two three\nfour"),
    ("<body><main><p>a&nbsp;b</p><div hidden>no</div><div role=navigation><p>n</p></div><p class='side-bar notice'>n</p><p>c &lt;d&gt;</p></main><p>after", "a b\nc <d>"),
    (None, ""),
    ("", ""),
    ("<p>only<!-- x --> text", "only text"),
    ("<article><p>open <p class=ad>advert<p>closed</article><article class='comment'><p>me</p></article>", "open\nclosed"),
    ("plain 1 < 2 text", "plain 1 < 2 text"),
    ("<article><div class='post-header'><h1>T</h1></div><p>one <span class='ad'>x <b>y</b></span>two <a href='#' class=q>three</a>.</p></article>", "T\none two three."),
]


def test_html(spark):
    rows = [(i, f"http://h{i}.x/a", p, i) for i, (p, _) in enumerate(PAGES)] + [(0, "http://h0.x/a", PAGES[0][0], 0), (None, None, PAGES[4][0], 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[4][1] if r.page_id is None else PAGES[r.page_id][1]
        assert (r.text, r.n_chars) == (want, len(want))
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_host_boilerplate(spark):
    """Without an article, what other pages of the host repeat goes and the unique runs stay; other hosts don't count."""
    same = "welcome to our site please read the terms of use before you go on"
    pages = [(i, f"https://h.x/{i}", f"<div>{same}</div><div>{prose(50 + i, 30)} {same} {prose(80 + i, 5)}</div><div>Home</div>") for i in range(4)]
    pages += [(9, "https://other.x/1", f"<div>{same}</div>")]
    pages += [(20 + i, f"https://h.x/a{i}", f"<article><p>{same}</p></article>") for i in range(4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == prose(50 + i, 30) + "\n" + prose(80 + i, 5) and got[20 + i] == same
    assert got[9] == same


BROKEN = [
    ("<article><p>Hi <a title=it's>link</a> one</p><p>don't drop this</p></article>", "Hi link one\ndon't drop this"),
    ('<article><p class="x>broken quote</p><p>and more</p></article>', "broken quote\nand more"),
    ("<article><p>one</p><iframe src=x><p>two</p><video><p>three</p></article>", "one\ntwo\nthree"),
    ("<article><header><h1>T</h1><p>The lead.</p></header><section id='discussion'><p>We discuss.</p></section><div class='related-work'><p>Others did.</p></div><div class='widget-content'>Kept too.</div></article>", "T\nThe lead.\nWe discuss.\nOthers did.\nKept too."),
    ("<article><p>a<div class='ad'>buy<p>now</div>b</p><ul><li>x<li class='ad-box'>y<li>z</ul><svg><svg></svg><text>no</text></svg><p>end</article><div>out</div>", "a\nb\nx\nz\nend"),
    ("<main><p>1 <!-- > --> 2<!--> 3 <b>4</p></b><script>'</p>'</script ><p>5 &lt; 6 &nonentity;</main", "1 2 3 4\n5 < 6 &nonentity;"),
    ("<main><table><tr><td>a<td>b<tr><td>c</table><p>d</main><p>later", "a\nb\nc\nd"),
    ("<article><p>x</p></div></section><p>y</p></article></p>", "x\ny"),
]


def test_html_broken(spark):
    got = html.extract(spark.createDataFrame([(i, f"http://b{i}.x/", p) for i, (p, _) in enumerate(BROKEN)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: t for i, (_, t) in enumerate(BROKEN)}


@pytest.mark.parametrize("unit", ["<a ", "<a <p>", "<p class='", '<p x="', "<!--", "<iframe>", "<svg>", "<svg><svg></svg>", "</div>", "<div>", "<b><p>", "<article><b></div>", "<li><ul>", "<", "</", "<![CDATA[", "&amp", "<td><tr>", "<script>", "<option>"])
def test_html_long_broken_pages_take_linear_time(unit):
    import time

    began = time.process_time()
    html.blocks("<article><p>start " + unit * (1_000_000 // len(unit)) + " end")
    assert time.process_time() - began < 20


def test_html_repeats(spark):
    """Copies make no boilerplate; repeats inside one page don't either; menus and notices inside main go by repetition."""
    same = "one two three four five six seven eight"
    menu = "<div><a href=/>Home</a> <a href=/x>News and all the other things here now</a></div><p>We use cookies on all of our pages, please accept them before.</p>"
    pages = [(i, "http://c.x/1", f"<p>{prose(1, 20)}</p><p>short</p>") for i in range(3)]
    pages += [(10, "http://d.x/1", "".join(f"<p>{same} {prose(i, 5)}</p>" for i in range(3)))]
    pages += [(20 + i, f"http://e.x/{i}", f"<main>{menu}<p>{prose(30 + i, 30)}</p><p>Introduction</p></main>") for i in range(6)]
    pages += [(40 + i, f"http://f.x/{i}", f"<article><div class='related'>{same} nine</div><div class='related'>{prose(60 + i, 12)}</div><div class='related'><a>{prose(70 + i, 3)}</a></div></article>") for i in range(4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(1, 20) + "\nshort" for i in range(3))
    assert got[10] == "\n".join(f"{same} {prose(i, 5)}" for i in range(3))
    assert all(got[20 + i] == prose(30 + i, 30) + "\nIntroduction" for i in range(6))
    assert all(got[40 + i] == prose(60 + i, 12) for i in range(4))


def test_html_runs_against_brute_force(spark):
    """Open blocks lose exactly the tokens inside runs of 8 that enough distinct pages of the host have."""
    rng = np.random.default_rng(4)
    pool = [prose(200 + i, 6 + 2 * i) for i in range(8)]
    pages = [(i, f"http://h{i % 2}.x/{i}", "".join("<div>" + " ".join(prose(int(rng.integers(1 << 30)), int(rng.integers(1, 9))) if rng.random() < 0.5 else pool[rng.integers(8)] for _ in range(rng.integers(1, 5))) + "</div>" for _ in range(3))) for i in range(24)]
    split = lambda p: [b.split() for b in re.findall("<div>(.*?)</div>", p)]
    runs = lambda t: {(True, *t)} if len(t) < 8 else {(False, *t[i : i + 8]) for i in range(len(t) - 7)}
    seen = Counter((i % 2, r) for i, _, p in pages for r in set().union(*(runs(t) for t in split(p))))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, p in pages:
        left = []
        for t in split(p):
            gone = [False] * len(t)
            for k in range(max(1, len(t) - 7)):
                r = (len(t) < 8, *t[k : k + 8])
                if seen[i % 2, r] >= 3:
                    gone[k : k + 8] = [True] * len(t[k : k + 8])
            line = " ".join("\n" if g else w for w, g in zip(t, gone))
            left += [x.strip() for x in line.split("\n") if x.strip()]
        assert got[i] == "\n".join(left)


def test_chat(spark):
    c = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "b", "c"], 5: ["a", "x"], 6: [None], 7: ["b", "a"], 8: ["a", "b", ""]}
    rows = [(k, i, "user", t, 0) for k, ts in c.items() for i, t in enumerate(ts)] + [(None, 0, "user", "a", 0), (9, None, None, "z", 0), (9, 1, "user", "y", 0), (5, 1, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, pos int")
    got = {r.conv_id: (r.n_turns, r.n_equal, r.rendered) for r in chat.render(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8, 9} and got[3] == (3, 2, "<|user|>\na\n<|user|>\nb\n<|user|>\nc\n<|end|>")
    assert got[6][2] == "<|user|>\n\n<|end|>" and got[9][2] == "<||>\nz\n<|user|>\ny\n<|end|>" and got[5][0] == 3
    assert chat.render(df.where("false")).count() == 0
    # Long conversations: positions and sums over several ranges.
    long = [(k, i, "user", f"t{i}") for k, n in ((1, 700), (2, 600)) for i in range(n)]
    assert [(r.conv_id, r.n_turns) for r in chat.collapse(spark.createDataFrame(long, "conv_id long, turn int, role string, text string")).collect()] == [(1, 700)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kinds = [f.__name__ for _, f in p.STAGES]
    assert kinds == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "source_mixing", "curve_packing"]
    frames = [docs]
    for _, stage in p.STAGES:
        frames.append(common.written(stage(spark, frames[-1], sf)))
    for f in frames[1:-1]:
        assert f.columns == p.COLUMNS
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    kept = {r.doc_id: r.text for r in frames[1].collect()}
    assert all((k in kept) == (q == 1) for k, q in labels.items())
    want = groups({k: shingles(t) for k, t in sorted(kept.items())})
    assert sorted(r.doc_id for r in frames[2].collect()) == sorted(k for k in kept if want[k] == k)
    seen: dict = {}
    for r in frames[3].orderBy("doc_id").collect():
        w = WORD.findall(low(r.text))
        for k in range(len(w) - 50):
            assert seen.setdefault(tuple(w[k : k + 51]), r.doc_id) == r.doc_id
    n = frames[3].select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    mixed = frames[4].select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(n - mixed) <= 20 and frames[5].count() > 0


def test_columns_of_the_same_names(spark):
    """Columns that the operators use inside don't disturb them."""
    names = "v at reach f last host block blocks spans windows words k open first_doc_id n component u mins s p q side doc slot key tokens g size bucket start row evidence weight unit centre rep line region ids media archive lang source".split()
    text = prose(1, 80)
    rows = [(i, text if i < 2 else prose(i, 60), f"<p>{prose(i, 9)}</p>", f"http://x.y/{i}", [1.0, float(i)], *["z"] * len(names)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, html string, url string, embedding array<double>, " + ", ".join(f"`{n}` string" for n in names))
    assert substrings.cut(df, substrings.passages(df)).columns == df.columns and substrings.passages(df).count() == 1
    assert html.extract(df.withColumn("page_id", F.col("doc_id"))).count() == 4 and ngram_join.one_of_each(df).count() == 3
    assert media.described(spark, media.store(df)).count() == 4 and packing.pack(df).select("doc_id").distinct().count() == 4
    assert mixing.mixed(df).count() == 4 and mixing.mixed_texts(df).count() >= 1 and licenses.scan(df).count() == 4
    assert near_vectors.near_vectors(df.withColumn("vec_id", F.col("doc_id"))).count() == 4
    assert quality.classify(df, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).columns[: len(df.columns) - 1] == [c for c in df.columns if c != "evidence"]
