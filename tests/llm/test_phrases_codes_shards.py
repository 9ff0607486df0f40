"""Collocations, vector codes and shards against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftspan.llm import codes, collocations, queries, sharding
from oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_count_tries", "op12_delta_lloyd"])
def test_sql(spark, name):
    assert differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


# collocations


def plain_collocations(rows, least, top, cover=80, scale=2_000_000):
    counts, n = defaultdict(Counter), Counter()
    for text, given in rows:
        lang = "und" if given is None else given
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= cover * f[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("shard_bytes", [700, 1 << 20])
def test_collocations_by_brute_force(spark, shard_bytes):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Of", "new", "york", "été", "Größe", "日本", "a\x01b", "a", "b c", *(f"w{i}" for i in range(12))]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" "] * 6 + ["\t", ", ", ".", "\n", " ; ", "  "]) for _ in range(k))
    passage = "new york is the city of the new people"
    rows = [(text(rng.randrange(0, 60)) + (passage if i % 3 == 0 else "") + text(9), rng.choice(["en", "de", None, "und", ""])) for i in range(150)]
    rows += [(None, "en"), ("", None), ("x" * 3000, "en"), (text(900), "de"), rows[0], rows[0], ("...", "fr"), ("one two", "fr")]
    docs = spark.createDataFrame([(None if i % 5 == 0 else i, t, g, "k", 1, "w", 0) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, shard string, place int, words string, k12 int").repartition(4)
    for least, top in ((4, 1000), (6, 7)):
        got = collocations.collocations(docs, least, top, shard_bytes=shard_bytes)
        assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == plain_collocations(rows, least, top)
    assert collocations.collocations(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n_words", [50, 70_000])
def test_paths_count_all_runs(n_words):
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, n_words, 4000), np.arange(n_words), rng.integers(0, 5, 3000)]).astype(np.uint64) * np.uint64(3)
    new = rng.random(len(words)) < 0.1
    expected = Counter()
    for i in range(len(words)):
        path = []
        for j in range(i, min(i + 4, len(words))):
            if words[j] == 0 or (j > i and new[j]):
                break
            path.append(int(words[j]))
        if len(path) > 1:
            expected[tuple(path + [0] * (4 - len(path)))] += 1
    k12, k34, counts = collocations._paths(words, new)
    paths = [(int(a) >> 32, int(a) & 0xFFFFFFFF, int(b) >> 32, int(b) & 0xFFFFFFFF) for a, b in zip(k12, k34, strict=True)]
    assert paths == sorted(paths) and dict(zip(paths, counts.tolist(), strict=True)) == expected


def test_merge_in_small_steps(monkeypatch):
    """Ranges cut anywhere, chunks of five paths, merged in steps of twenty: the same nodes."""
    monkeypatch.setattr(collocations, "CHUNK", 5)
    monkeypatch.setattr(collocations, "STEP", 20)
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 4, 300).astype(np.uint64) for _ in range(6)]
    new = [rng.random(300) < 0.2 for _ in words]
    chunks = [c for w, b in zip(words, new, strict=True) for c in collocations._chunks(*collocations._paths(w, b))]
    bounds = sorted({tuple(c[:2]) for c in chunks[::17]})
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*chunks, strict=True)], ["a12", "a34", "z12", "z34", "data"])
    dealt = pa.Table.from_batches(collocations._deal(bounds)([batch])).to_pylist()
    got = Counter()
    for r in range(len(bounds) + 1):
        own = sorted((c for c in dealt if c["range"] == r), key=lambda c: (c["a12"], c["a34"]))
        if own:
            one = pa.Table.from_pylist(own).select(["a12", "a34", "data"]).to_batches()
            for node in pa.Table.from_batches(collocations._merge(1)(one)).to_pylist():
                got[node["k12"], node["k34"]] += node["a"]
    expected = Counter()
    for w, b in zip(words, new, strict=True):
        for k12, k34, n in zip(*(x.tolist() for x in collocations._paths(w, b)), strict=True):
            expected[k12, 0] += n
            if k34:
                expected[k12, k34 >> 32 << 32] += n
            if k34 & 0xFFFFFFFF:
                expected[k12, k34] += n
    assert got == expected and len({d["range"] for d in dealt}) > 3


# vector codes


def plain_codes(rows, parts, entries, rounds):
    usable = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in usable]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ints[0][1])
    edges = [i * width // parts for i in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(edges, edges[1:])] for _, v, _ in ints]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda c: [min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        told = [nearest(c) for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, t in zip(cut, told, strict=True) if t[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], Counter()
    for (i, _, label), c in zip(ints, cut, strict=True):
        t = nearest(c)
        error = sum(far(c[p], books[p][t[p]]) for p in range(parts))
        sums[label] += error
        out.append((i, "".join(f"{e:02x}" for e in t), error, label))
    return sorted([(i, code, error, sums[label], digest) for i, code, error, label in out], key=repr)


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    kinds = rng.normal(0, 1, (5, width))
    rows = [(int(i), (kinds[i % 5] + rng.normal(0, 0.3, width)).round(2).tolist(), None if i % 4 == 0 else int(i) % 3) for i in rng.permutation(n)]
    rows += [(None, kinds[0].tolist(), 1), (None, kinds[0].tolist(), 1), rows[0], (rows[1][0], kinds[1].tolist(), None)]  # null ids, a repeated row, a repeated id
    return rows + [(900, None, 1), (-5, [float("nan")] * width, 1), (-4, [float("inf")] + [0.0] * (width - 1), 1), (-3, [None] + [0.0] * (width - 1), 1)]


@pytest.mark.parametrize(("n", "entries", "few"), [(120, 8, 100_000), (10, 64, 0)])
def test_codes_by_brute_force(spark, monkeypatch, n, entries, few):
    monkeypatch.setattr(codes, "FEW_LABELS", few)
    rows = vectors(n, 12, n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, ints int, codes string").repartition(5)
    got = codes.code_report(df, parts=4, entries=entries)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows, 4, entries, 2)


def test_codes_of_other_lengths_huge_components_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(1, [0.0, 1.0, 2.0, 3.0], 1), (2, [1e30, 1.0, 2.0, 3.0], 1), (3, [1.0], 2), (4, [], 2)]
    got = {r.vec_id: r for r in codes.code_report(spark.createDataFrame(rows, schema), parts=2, entries=4).collect()}
    assert got[1].code == "0000" and got[3].code is None and got[3].error is None and got[4].code is None and got[2].error >= 0
    assert codes.code_report(spark.createDataFrame([], schema)).collect() == []
    assert codes.code_report(spark.createDataFrame([(1, None, 1), (2, [None], 1)], schema)).collect() == []


def test_rounds_shuffle_only_what_moved(spark):
    df = spark.createDataFrame(vectors(200, 8, 2), "vec_id long, embedding array<double>, label int")
    ints = codes.checkpoint(codes._integers(df, "vec_id", "embedding", "label"))
    books, state = codes.fit_codes(ints, parts=2, entries=4, rounds=6)
    before, _ = codes.fit_codes(ints, parts=2, entries=4, rounds=5)
    delta = state.where("before is null or before <> codes").mapInArrow(codes._contributions(before), "part int, entry int, place int, amount long")
    changed = sum(x != y for r in state.collect() for x, y in zip(r.before, r.codes, strict=True))
    assert delta.where("place = -1").agg({"amount": "sum"}).first()[0] in (None, 0) and changed < state.count() / 2
    seen = codes.decode(codes.encode(state, books), books).collect()
    units = {tuple(r.ints): r for r in state.collect()}
    assert len(seen) == state.count() and all(len(r.vector) == 8 for r in seen) and units
    for r in seen[:20]:
        flat = [int(b[r.codes[p]][j]) for p, b in enumerate(books.books) for j in range(4)]
        assert [x * 256 for x in r.vector] == flat


# shards


def plain_capacity(sizes, shards):
    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= shards

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def rows_of(kind):
    rng = random.Random(7)
    texts = ["w" * rng.randrange(1, 90) + str(rng.randrange(10**6)) for _ in range(700)]
    if kind == "hot":
        texts += ["the same text " * 9] * 400 + ["another"] * 150
    if kind == "few":
        texts = ["a", "b" * 50, "c"]
    rows = list(enumerate(texts)) + [(None, None), (None, ""), (None, "w"), (None, "w"), (5, texts[0]), (5, texts[0]), (None, "Größe")]
    return rows if kind != "none" else []


@pytest.mark.parametrize("kind", ["even", "hot", "few", "none"])
@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_by_brute_force(spark, kind, shards):
    rows = rows_of(kind)
    docs = spark.createDataFrame([(i, t, "s", 3, "d") for i, t in rows], "doc_id long, text string, shard string, size int, digest string").repartition(6)
    got = sharding.shard_report(docs, shards).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    slots, shard_of, held = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32].add(r.shard)
        held[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard_of.values())
    cuts = sharding.cut_documents(docs, shards)
    groups = Counter()
    for _, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()[: sharding.DIGEST]] += len((t or "").encode()) + 1
    rest = [groups[d] for d in sorted(groups) if d not in cuts.alone]
    least = max([plain_capacity(rest, shards - len(cuts.alone)), *(groups[d] for d in cuts.alone)])
    assert cuts.capacity == least and max(held.values(), default=0) <= least
    if kind == "even":
        assert max(held.values()) - min(held[s] for s in range(shards)) <= 2 * max(groups.values())


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows_of("hot")], "doc_id long, text string, source string").repartition(6)
    cuts = sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(map(tuple, back.select("doc_id", "text", "source").collect())) == Counter(map(tuple, docs.collect()))
    placed = {(r.doc_id, r.text_crc32): r.shard for r in sharding.place_documents(docs, 4).collect()}
    assert all(placed[r.doc_id, zlib.crc32((r.text or "").encode())] == r.shard for r in back.collect())
    assert cuts.shards == 4
