import hashlib
import random
import tracemalloc
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftspan.llm import jaccard, lm, quality, substrings, words
from driftspan.llm.components import connected_components


def test_words_of_awkward_texts():
    texts = ["", None, " a  b\u00a0c\t", "x" * 10_000, "é è", "\n", "a b a b"]
    got = []
    for block in words.blocks(pa.array(texts), size=16):
        raw = block.data.tobytes()
        for i in range(len(block)):
            own = slice(block.first[i], block.first[i + 1])
            got.append([raw[a:b].decode() for a, b in zip(block.starts[own], block.ends[own], strict=True)])
    assert got == [brute.words(t) for t in texts]
    (block,) = words.blocks(pa.array(["a b a", "b A"]), lower=True)
    assert block.hashes[0] == block.hashes[2] == block.hashes[4] and block.hashes[1] == block.hashes[3]
    assert len(block.windows(2)[0]) == 3
    assert [len(b) for b in words.blocks(pa.array(["ab", "cd"], pa.string()).slice(1, 1))] == [1]


def test_long_texts_are_walked_in_blocks(monkeypatch):
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    text = " ".join(f"word{i}" for i in range(300)) + " " + "y" * 500 + " end"
    whole = words._hash_all(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64), False)
    assert len(whole[0]) == 302 and len(set(whole[0])) == 302
    monkeypatch.undo()
    assert (whole[0] == words._hash_all(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64), False)[0]).all()


def test_quality_counts(docs, pairs, empty):
    rows = quality.quality_verdicts(docs, quality.language_references(docs)).collect()
    text = dict(pairs)
    assert len(rows) == len(pairs)
    for r in rows:
        n, chars, symbols, lines, repeated = brute.base_counts(text[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["kept"] and r["base_failed"])
    assert quality.quality_verdicts(empty, {}).count() == 0 and quality.language_references(empty) == {}
    kept = quality.keep_quality(docs, {})
    assert kept.columns == docs.columns and kept.count() == sum(not r["base_failed"] for r in rows)


def test_quality_divergence(spark):
    rng = random.Random(0)
    plain = [" ".join(rng.choices(["the", "of", "and", "garden", "river", "stone", "to"], k=150)) for _ in range(40)]
    junk = [" ".join(w + "###$$$" for w in t.split()) for t in plain[:3]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(plain + junk)], "doc_id long, text string, lang string")
    limits = quality.Limits(word_distance=0.5)
    got = {r["doc_id"]: (r["class_distance"], r["word_distance"]) for r in quality.quality_verdicts(df, quality.language_references(df.where("doc_id < 40")), limits).collect()}
    assert max(max(got[i]) for i in range(40)) < 0.28 < min(got[i][0] for i in (40, 41, 42))
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.5, 0.0, 0.5])
    assert quality.js_distance(p, q)[0] == pytest.approx(np.sqrt(0.5)) and quality.js_distance(p, p[0])[0] == 0


def test_quality_of_other_languages(spark):
    rng = random.Random(1)
    text = lambda words: " ".join(rng.choices(words, k=150))
    made = lambda letters, n: ["".join(rng.choices(letters, k=5)) for _ in range(n)]
    english, russian, italian = ["the", "of", "and", "to"] * 5 + made("abcdefghij", 60), made("абвгдежзий", 60), made("aeilmnorst", 60)
    rows = [(i, text(english), "en") for i in range(20)] + [(i, text(russian), "ru") for i in range(20, 40)]
    rows += [(40, " ".join(w + "###$$$%%%***" for w in text(russian).split()), "ru"), (41, text(russian), None), (42, text(italian), "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.language_references(df.where("doc_id <> 42"))
    kept = {r["doc_id"] for r in quality.quality_verdicts(df, refs).where("kept").collect()}
    assert set(range(20, 40)) | {41, 42} <= kept and 40 not in kept
    assert {r["doc_id"] for r in quality.keep_quality(df, refs).collect()} == kept


@pytest.mark.parametrize("window", [1, 5, 13, 30, 50])
def test_substrings(docs, pairs, window):
    expected = brute.repeats([p for p in pairs if p[1] is not None], window)
    for r in substrings.removal_report(docs, window).collect():
        n, gone, digest, _ = expected.get(r["doc_id"], (0, 0, hashlib.sha256(b"").hexdigest(), []))
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, digest)


def test_removed_texts(spark, docs, pairs, empty):
    expected = brute.repeats([p for p in pairs if p[1] is not None], 20)
    out = substrings.remove_repeats(docs, 20)
    assert out.columns == docs.columns and out.count() == len(pairs)
    for r in out.collect():
        before = dict(pairs)[r["doc_id"]]
        if before is None:
            assert r["text"] is None
        else:
            n, gone, _, kept = expected[r["doc_id"]]
            assert brute.words(r["text"]) == kept and r["n_chars"] == len(r["text"])
            assert gone or r["text"] == before
    assert substrings.remove_repeats(empty).count() == 0 and substrings.removal_report(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.removal_report(same, 3).collect()) == [(0, 0), (1, 0), (1, 0), (2, 4)]
    assert substrings.level_lengths(13) == [7, 13] and substrings.level_lengths(50) == [7, 13, 25, 50]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard(docs, pairs, size, percent):
    expected = brute.components(pairs, size, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, size, percent).collect()}
    assert got == expected


def test_jaccard_in_blocks(spark, monkeypatch):
    """One large group near the threshold, cut into blocks: no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for d in range(60):
        w = list(base) + [f"u{d % 5}"] * (d % 4)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"e{rng.randrange(9)}"
        rows.append((d, " ".join(w)))
    sets = [(d, brute.shingles(t, 3)) for d, t in rows]
    expected = brute.components(rows, 3, 75)
    units = {}
    members = {}
    for d, s in sets:
        cls = int(jaccard._class_of(np.array([len(s)]), 75)[0])
        members[cls] = members.get(cls, 0) + 1
    for d, s in sets:
        cls = int(jaccard._class_of(np.array([len(s)]), 75)[0])
        for unit, side in jaccard._units(1, d, cls, members, 75, jaccard.BLOCK):
            units.setdefault(unit, []).append((d, side))
    edges = []
    numbers = {g: i for i, g in enumerate(sorted({g for _, s in sets for g in s}))}
    hashed = {d: np.array(sorted(numbers[g] for g in s), np.uint64) for d, s in sets}
    for own in units.values():
        sides = np.array([s for _, s in own])
        a, b = jaccard.similar_forest([hashed[d] for d, _ in own], 75, sides if sides.max() > 0 else None)
        edges += [(own[i][0], own[j][0]) for i, j in zip(a, b, strict=True)]
    found = brute.linked(edges)
    assert {d: found.get(d, d) for d, _ in rows} == {d: c for d, (_, c) in expected.items()}


def test_large_groups_are_drawn_apart(spark, docs, pairs, monkeypatch):
    """Every group counts as large: sketches must not separate what is similar."""
    monkeypatch.setattr(jaccard, "BLOCK", 1)
    expected = brute.components(pairs, 3, 70)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, 3, 70).collect()}
    assert got == expected


class Recorder:
    """Keeps the functions that a plan would run in its tasks."""

    def __init__(self, spark):
        self.sparkSession, self.given = spark, []

    def mapInArrow(self, function, schema):
        self.given.append(function)
        return self

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition


def test_nodes_of_large_groups_are_dealt_out_in_pieces(spark):
    plan, percent = Recorder(spark), 80
    jaccard._drawn_apart(plan, percent)
    cls = int(jaccard._class_of(np.array([90]), percent)[0])
    members = {cls: 2_000_000, cls + 1: 1000}
    nodes = [n * 0x9E3779B97F4A7C15 % (1 << 63) for n in range(60)]
    rows = [{"node": n, "gid": 7, "n": 90, "sketch": n.to_bytes(8) * 2, "classes": [{"cls": c, "members": m} for c, m in members.items()]} for n in nodes]
    kinds = pa.schema([("node", pa.int64()), ("gid", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("classes", pa.list_(pa.struct([("cls", pa.int32()), ("members", pa.int32())])))])
    out = list(plan.given[0](iter([pa.RecordBatch.from_pylist(rows, kinds), pa.RecordBatch.from_pylist([], kinds)])))
    assert max(b.num_rows for b in out) <= 4096
    got = [(*u, n, k, s) for b in out for *u, n, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == [(*u, n, 90, n.to_bytes(8) * 2) for n in nodes for u in jaccard._units(7, n, cls, members, percent, jaccard.SKETCH_BLOCK, whole=False)]
    assert len(got) > 50_000


def test_tasks_hold_a_small_part_of_their_texts(spark):
    rng, plan = random.Random(4), Recorder(spark)
    texts = pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(3000)])
    jaccard._candidates(plan, 5, 80)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), texts], ["doc", "row", "text"])
    vocabulary, own = quality._vocabulary()
    took = {}
    for name, run in {
        "shingles": lambda: sum(b.num_rows for b in plan.given[0](iter([batch]))),
        "quality": lambda: len(quality._verdicts(texts, np.full(len(texts), "en", object), {}, quality.Limits(), vocabulary, own)["kept"]),
    }.items():
        words._powers.clear()
        tracemalloc.start()
        assert run() >= len(texts)
        took[name] = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
    assert texts.nbytes > 6 << 20 and max(took.values()) < 64, took


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (1, 40, 64, 65, 500, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 4 :], rng.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)]))
        x, y = jaccard.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        words = min(len(x), len(y)) // 8
        bits = int(np.bitwise_count(jaccard.fold(x, words) ^ jaccard.fold(y, words)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(3)
    for n in (7, 20, 60, 300):
        for _ in range(60):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1), dtype=np.uint64)]))
            b = np.unique(np.concatenate([common[: max(1, n - int(rng.integers(0, n // 6 + 1)))], rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 85 * (len(a) + len(b) - shared) and not np.array_equal(a, b):
                keys, docs = jaccard.candidate_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85)
                assert set(keys[docs == 0]) & set(keys[docs == 1])


def test_keep_one_and_awkward_ids(spark, docs, pairs, empty):
    first = {c for _, c in brute.components(pairs, 5, 80).values()}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == first
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c D e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.near_duplicates(df).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == brute.linked(edges)
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_backoff(spark, docs, pairs, empty, order):
    expected = dict(zip([d for d, _ in pairs], brute.backoff(pairs, order), strict=True))
    for r in lm.backoff_scores(docs, order=order, block_bytes=20_000).collect():
        n, score = expected[r["doc_id"]]
        assert r["n_words"] == n and r["log_score"] == pytest.approx(score)
        assert (r["mean_log_score"] is None) == (n == 0)
    assert lm.backoff_scores(empty, order=order).count() == 0
    assert lm.backoff_scores(docs.where(F.col("text").isNull())).count() == 1


def test_ngram_counts(docs, pairs):
    got = {(r["length"], r["ngram"]): r["n"] for r in lm.ngram_counts(docs).collect()}
    expected = Counter((n, " ".join(g)) for _, t in pairs for n in (1, 2, 3) for g in brute.ngrams(brute.words(brute.lower(t)), n))
    assert got == expected


def test_rows_that_repeat_an_id_lose_no_link(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(80))
    rows, groups = [], []
    for i in range(10):
        near = text()
        groups.append((2 * i + 1, 2 * i + 2))
        rows += [(2 * i + 1, text()), (2 * i + 1, near), (2 * i + 2, near + " end"), (2 * i + 2, near + " end")]
    rows += [(None, rows[0][1]), (None, rows[0][1] + " more"), (None, "of its own " + text()), (7, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, node long")
    got = jaccard.near_duplicates(df)
    assert got.count() == len(rows)
    found = {(r["doc_id"], r["component_id"]) for r in got.collect()}
    assert all((b, a) in found for a, b in groups) and (None, 1) in found and (None, None) in found
    kept = sorted((r["node"] for r in jaccard.keep_one(df).collect()))
    firsts = {0, 1, *(4 * i + k for i in range(1, 10) for k in (0, 1)), 42, 43}
    assert set(kept) == firsts


@pytest.mark.parametrize("small", [0, 100_000])
def test_heavy_keys(spark, monkeypatch, small):
    from driftspan.llm import components

    monkeypatch.setattr(components, "SMALL", small)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, v long")
    table = spark.createDataFrame([(i, f"x{i}") for i in range(0, 2000, 2)] + [(1, "one")], "k long, name string")
    got = {(r["k"], r["v"]): r["name"] for r in components.join_heavy(rows, table, "k", F.col("v"), 3001).collect()}
    assert len(got) == 3001 and all(n == ("one" if k == 1 else f"x{k}" if k is not None and k % 2 == 0 and k < 2000 else None) for (k, _), n in got.items())
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(20)]
    assert {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == brute.linked(edges)
