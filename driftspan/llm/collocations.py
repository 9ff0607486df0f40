"""Phrases of two to four words that occur more often than their parts suggest, from count tries of depth four.

A shard is a run of texts of one language, of bounded bytes. Its words are told apart exactly; words that the whole
corpus has too seldom end a path, as no phrase with them is frequent. The other words are numbered in their order, by
language. A shard's trie then is its sorted paths of up to four numbers with counts: a path is two 64-bit keys, sorted
paths have their common beginnings side by side, and these beginnings are the inner nodes. Tries are serialised in
sorted chunks, cut at prefix bounds, and each prefix range is merged from all shards as a stream that takes chunks by
their first path: what lies before the next chunk's first path is complete. Only nodes that are frequent leave the
merge, and the partial counts of nodes that lie across its steps.

Of a node, the left parts are the nodes on its way from the root. The right parts are those on its chain of suffix
links: the suffix of (w1 .. wk) is (w2 .. wk), a node of the level before. Each level is joined to the level before for
both, so it inherits the left parts of its parent and the right parts of its suffix.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftspan.llm.cluster import checkpoint
from driftspan.llm.components import join_heavy
from driftspan.llm.words import text_buffers

SHARD_BYTES, CHUNK, STEP = 16 << 20, 1 << 13, 1 << 20
PER_RANGE, RANKED = 64, 64
DEPTH = 4
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_HARD, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_HARD[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _squeeze(*columns: np.ndarray) -> bytes:
    """Byte planes of equally long columns of integers, compressed."""
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _expand(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `size`: whole texts, or whole pieces of a text that is longer."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        cut = int(offsets[np.searchsorted(offsets, at + size, "right") - 1])
        if cut <= at:
            within = min(int(offsets[np.searchsorted(offsets, at, "right")]), end)
            cut = within
            if within - at > size:
                back = np.flatnonzero(_HARD[data[at : at + size]])
                step = at + size
                while not len(back) and step < within:  # one piece longer than a run
                    back = np.flatnonzero(_HARD[data[step : step + size]]) + (step - at)
                    back = back[:1]
                    step += size
                cut = at + int(back[-1]) + 1 if len(back) else within
        yield at, cut
        at = cut


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some bytes, lower-cased, and whether each begins a piece; breaks: positions at which a text begins."""
    word = ~(_HARD[data] | _BLANK[data])
    before = np.concatenate([[False], word[:-1]])
    before[breaks] = False
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]])
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = _LOWER[data[word]]
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    place = np.cumsum(_HARD[data])[starts] + np.searchsorted(breaks, starts, "right") if len(starts) else starts
    return found, np.concatenate([[True], place[1:] != place[:-1]]) if len(starts) else np.zeros(0, bool)


def _shards(size: int):
    """(lang, text) -> a row a shard: its words and their counts, and the text as places in words with a bit for a new piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lang in pc.unique(batch.column("lang")):
                data, offsets = text_buffers(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))
                for a, b in _runs(data, offsets, size):
                    breaks = np.unique(offsets[(offsets >= a) & (offsets < b)]) - a
                    found, new = _words(data[a:b], breaks)
                    if not len(found):
                        continue
                    codes = found.indices.to_numpy().astype(np.uint32)
                    counts = np.bincount(codes, minlength=len(found.dictionary))
                    row = [[base + number], [lang.as_py()], None, [counts], [_squeeze(codes << np.uint32(1) | new)]]
                    row[2] = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), found.dictionary)
                    kinds = [pa.int64(), pa.string(), None, pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([x if k is None else pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["shard", "lang", "words", "counts", "stream"])
                    number += 1

    return cut


def _chunks(k12: np.ndarray, k34: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    for a in range(0, len(k12), CHUNK):
        x, y, n = k12[a : a + CHUNK], k34[a : a + CHUNK], counts[a : a + CHUNK]
        yield int(x[0]), int(y[0]), int(x[-1]), int(y[-1]), _squeeze(np.diff(x, prepend=np.uint64(0)), y, n)


def _unchunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, k34, counts = _expand(data, np.uint64, np.uint64, np.uint64)
    return np.cumsum(steps, dtype=np.uint64), k34, counts


_CHUNK = pa.schema([("a12", pa.int64()), ("a34", pa.int64()), ("z12", pa.int64()), ("z34", pa.int64()), ("data", pa.binary())])
_DEALT = pa.schema([("range", pa.int32()), ("a12", pa.int64()), ("a34", pa.int64()), ("data", pa.binary())])
_NODE = pa.schema([("k12", pa.int64()), ("k34", pa.int64()), ("a", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _paths(words: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct paths of up to four numbers (0: none) that start at a word, of two at least, with counts."""
    known, local = np.unique(words[words > 0], return_inverse=True)
    rank = np.zeros(len(words), np.uint64)
    rank[words > 0] = local + 1
    following, levels = np.concatenate([np.where(new[1:], 0, rank[1:]), [0]]).astype(np.uint64) if len(words) else rank, [rank]
    for _ in range(DEPTH - 1):
        levels.append(np.where(levels[-1] > 0, following, 0).astype(np.uint64))
        following = np.concatenate([levels[-1][1:], [0]]).astype(np.uint64) if len(words) else following
    keep = (levels[0] > 0) & (levels[1] > 0)
    levels = [x[keep] for x in levels]
    bits = np.uint64(int(len(known)).bit_length())
    if DEPTH * int(bits) <= 64:  # one key sorts faster than two
        key = levels[0]
        for x in levels[1:]:
            key = key << bits | x
        key, counts = np.unique(key, return_counts=True)
        mask = (np.uint64(1) << bits) - np.uint64(1)
        levels = [key >> bits * np.uint64(i) & mask for i in (3, 2, 1, 0)]
    else:
        order = np.lexsort(levels[::-1])
        levels = [x[order] for x in levels]
        first = np.ones(len(order), bool)
        first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in levels])
        counts = np.diff(np.append(np.flatnonzero(first), len(order)))
        levels = [x[first] for x in levels]
    ids = np.concatenate([[0], known]).astype(np.uint64)
    w = [ids[x] for x in levels]
    return w[0] << _HALF | w[1], w[2] << _HALF | w[3], counts.astype(np.uint64)


def _trie(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard and the numbers of its frequent words -> its trie in chunks."""
    rows = []
    for stream in left["stream"]:
        (coded,) = _expand(stream.as_py(), np.uint32)
        ids = np.zeros(int(coded.max(initial=0) >> 1) + 1, np.uint64)
        ids[right["place"].to_numpy()] = right["id"].to_numpy()
        rows += _chunks(*_paths(ids[coded >> 1], (coded & 1).astype(bool)))
    return _table(rows, _CHUNK)


def _deal(bounds: list[tuple[int, int]]):
    """Chunks by prefix range; one that lies across bounds is cut there."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a12, a34, z12, z34, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = bisect_right(bounds, (a12, a34)), bisect_right(bounds, (z12, z34))
                if low == high:
                    rows.append((low, a12, a34, data))
                    continue
                k12, k34, counts = _unchunk(data)
                at = 0
                for r in range(low, high + 1):
                    end = len(k12)
                    if r < high:
                        b, c = np.uint64(bounds[r][0]), np.uint64(bounds[r][1])
                        lo, hi = np.searchsorted(k12, b, "left"), np.searchsorted(k12, b, "right")
                        end = lo + np.searchsorted(k34[lo:hi], c, "left")
                    rows += [(r, *x[:2], x[4]) for x in _chunks(k12[at:end], k34[at:end], counts[at:end])]
                    at = end
            yield from _table(rows, _DEALT).to_batches()

    return deal


def _add_up(k12: np.ndarray, k34: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((k34, k12))
    k12, k34 = k12[order], k34[order]
    starts = np.flatnonzero(np.concatenate([[True], (k12[1:] != k12[:-1]) | (k34[1:] != k34[:-1])]))
    return k12[starts], k34[starts], np.add.reduceat(counts[order], starts)


def _nodes(k12: np.ndarray, k34: np.ndarray, counts: np.ndarray, least: int) -> pa.RecordBatch:
    """Nodes of depth two and more below sorted paths: those of `least` occurrences, and the first and last of a depth,
    which may go on in other paths."""
    out = []
    for depth, tail in ((2, np.zeros_like(k34)), (3, k34 >> _HALF << _HALF), (4, k34)):
        has = np.ones(len(k12), bool) if depth == 2 else tail > 0 if depth == 3 else (tail & _LOW) > 0
        starts = np.flatnonzero(np.concatenate([[True], (k12[1:] != k12[:-1]) | (tail[1:] != tail[:-1])]))
        total = np.add.reduceat(counts, starts)
        chosen = total >= least
        if depth < DEPTH:
            chosen[[0, -1]] = True
        chosen &= has[starts]
        out.append((k12[starts[chosen]], tail[starts[chosen]], total[chosen]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], schema=_NODE)


def _merge(least: int):
    """Merges the chunks of a range, which come by first path, into frequent nodes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held, limit = [], 0, STEP

        def flush(before: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
            nonlocal pending, held, limit
            k12, k34, counts = _add_up(*(np.concatenate(x) for x in zip(*pending, strict=True)))
            end = len(k12)
            if before:
                lo, hi = np.searchsorted(k12, np.uint64(before[0]), "left"), np.searchsorted(k12, np.uint64(before[0]), "right")
                end = int(lo + np.searchsorted(k34[lo:hi], np.uint64(before[1]), "left"))
            pending, held = ([(k12[end:], k34[end:], counts[end:])] if end < len(k12) else []), len(k12) - end
            limit = max(STEP, 2 * held)
            if end:
                yield _nodes(k12[:end], k34[:end], counts[:end], least)

        for batch in batches:
            for a12, a34, data in zip(batch.column("a12").to_pylist(), batch.column("a34").to_pylist(), batch.column("data"), strict=True):
                if held >= limit:
                    yield from flush((a12, a34))
                pending.append(_unchunk(data.as_py()))
                held += len(pending[-1][0])
        if pending:
            yield from flush(None)

    return merge


def _numbered(words: DataFrame) -> DataFrame:
    """words (lang, word, n) and id: from 1, in the order of lang and word."""
    spark = words.sparkSession
    ordered = checkpoint(words.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted(ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect())  # a row a partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    if total >= 1 << 31:
        raise ValueError(f"{total} frequent words; a path holds numbers below 2**31")
    first = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    joined = ordered.withColumn("part", F.shiftright("at", 33)).join(first, "part")
    return joined.select("lang", "word", "n", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("id"))


def _bounds(chunks: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Paths that cut the chunks into about `parts` even ranges, from PER_RANGE * parts of their first paths: it is only
    the ranges' sizes that a sample decides."""
    n = chunks.count()
    if not n:
        return []
    few = sorted(tuple(r) for r in chunks.select("a12", "a34").sample(min(1.0, PER_RANGE * parts / n), seed=1).collect())
    return sorted({few[len(few) * i // parts] for i in range(1, parts)}) if few else []


def count_phrases(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, n, id; nodes: k12, k34, a; totals: lang, n): all words and paths of two to four words that occur
    `least` times or more in their language, and each language's occurrences of any words.

    A path is the ids of its words, 32 bits each from the left over k12 and k34, 0 where it has fewer.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where("text is not null")
    shards = checkpoint(texts.mapInArrow(_shards(shard_bytes), "shard long, lang string, words array<string>, counts array<long>, stream binary"))
    totals = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    each = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    frequent = each.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n")).where(F.col("n") >= least)
    words = checkpoint(_numbered(frequent))
    asked = shards.select(F.col("shard").alias("of"), "lang", F.posexplode("words").alias("place", "word"))
    told = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).select("of", "place", "id")
    tries = shards.select("shard", "stream").groupBy("shard").cogroup(told.groupBy("of"))
    chunks = checkpoint(tries.applyInArrow(_trie, "a12 long, a34 long, z12 long, z34 long, data binary"))
    dealt = chunks.mapInArrow(_deal(_bounds(chunks, parts)), "range int, a12 long, a34 long, data binary")
    sorted_ = dealt.repartitionById(parts, "range").sortWithinPartitions("a12", "a34").select("a12", "a34", "data")
    merged = sorted_.mapInArrow(_merge(least), "k12 long, k34 long, a long")
    nodes = checkpoint(merged.groupBy("k12", "k34").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    return words, nodes, totals


def _level(nodes: DataFrame, before: DataFrame, parent: Column, suffix: Column) -> DataFrame:
    """Nodes of a level with lang, phrase, last, lefts and rights, from the level before (key, lang, phrase, last, lefts,
    rights, a)."""
    n = nodes.count()
    rows = nodes.withColumns({"pk": parent, "sk": suffix})
    own = lambda k: F.struct((-1 - F.pmod(F.xxhash64("k12", "k34"), F.lit(1 << 62))).alias("k12"), F.lit(0).cast("long").alias("k34"))
    up = before.select(F.col("key").alias("pk"), "lang", F.col("phrase").alias("head"), F.col("lefts").alias("pl"), F.col("a").alias("pa"))
    link = before.select(F.col("key").alias("sk"), "last", F.col("rights").alias("sr"), F.col("a").alias("sa"))
    rows = join_heavy(rows, up, "pk", own("pk"), n)
    rows = join_heavy(rows, link, "sk", own("sk"), n)
    return checkpoint(rows.select(
        F.struct("k12", "k34").alias("key"), "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "pk", "sk", "pa", "sa",
        F.concat("pl", F.array("pa")).alias("lefts"), F.concat(F.array("sa"), "sr").alias("rights"),
    ))


def _candidates(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """All frequent phrases with the counts of their left and right parts, by length of the left part."""
    pair = lambda high, low: F.shiftleft(high, 32).bitwiseOR(low)
    half = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    key = lambda x, y: F.struct(x.cast("long").alias("k12"), y.cast("long").alias("k34"))
    none, w1, w2, w3, w4 = F.lit(0), F.shiftright("k12", 32), half("k12"), F.shiftright("k34", 32), half("k34")
    none_yet = F.array().cast("array<long>")
    level = words.select(key(F.col("id"), none).alias("key"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"), none_yet.alias("lefts"), none_yet.alias("rights"))
    two = _level(nodes.where("k34 = 0"), level, key(w1, none), key(w2, none))
    three = _level(nodes.where("k34 > 0").where(half("k34") == 0), two, key(F.col("k12"), none), key(pair(w2, w3), none))
    four = _level(nodes.where(half("k34") > 0), three, key(F.col("k12"), F.shiftleft(w3, 32)), key(pair(w2, w3), F.shiftleft(w4, 32)))
    return two.unionByName(three).unionByName(four)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, scale: int = 2_000_000, text: str = "text", lang: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by score, then a, then phrase.

    Texts are lower-cased (A-Z), cut into pieces at [.,;:!?] and line ends, and those into words at blanks and tabs. A
    phrase has two to four words of one piece and occurs a >= `least` times in its language. Cut after its first k words,
    it has parts of l and r occurrences and score floor(scale * a / (l + r)); the lowest score counts, of equal ones that
    of the smallest k. A phrase within a longer one that has at least `cover` per cent of its occurrences is left out; n
    counts the language's words. A null text is empty, a null language is `und`; rows of equal or null ids, and repeated rows, all count.
    A language without such phrases, and an empty table, give no rows.
    """
    words, nodes, totals = count_phrases(docs, least, text, lang, shard_bytes)
    found = _candidates(words, nodes)
    longer = found.where(F.size("lefts") > 1).select(F.explode(F.array(F.struct(F.col("pk").alias("key"), "a", F.col("pa").alias("of")), F.struct(F.col("sk").alias("key"), "a", F.col("sa").alias("of")))).alias("x"))
    # what a phrase two words longer covers, the phrase between them covers too
    covered = longer.where(F.col("x.a").cast("decimal(20,0)") * 100 >= F.col("x.of").cast("decimal(20,0)") * cover).select("x.key").distinct()
    score = F.expr(f"transform(sequence(0, size(lefts) - 1), i -> struct(cast(a as decimal(20,0)) * {scale} div (cast(lefts[i] as decimal(20,0)) + cast(rights[i] as decimal(20,0))) as score, i as k, lefts[i] as l, rights[i] as r))")
    scored = found.join(covered, "key", "left_anti").select("lang", "phrase", "a", F.array_min(score).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rank = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(*best))
    few = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).withColumn("own", rank("part")).where(F.col("own") <= top)
    first = few.withColumn("rank", rank()).where(F.col("rank") <= top)  # of RANKED * top rows a language at most
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
