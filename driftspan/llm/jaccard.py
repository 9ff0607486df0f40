"""Exact Jaccard join of word-shingle sets by blocked products of the document by n-gram incidence matrix.

1. A document becomes the set of its shingles' hashes; equal sets are one node.
2. Candidates: sizes fall into classes. In a class, similar sets differ in at most H shingles, so of more than
   H ranges of the hash space one holds the same shingles in both. A hash of each range's contents is the key.
   The emptiest ranges are spare (there are that many more than H), so a key stands for several shingles.
3. Nodes that meet in a key are linked to its least node only; components of these links are groups. Large groups,
   chained by passages that many documents share, are drawn apart by parity sketches: two sketches differ in
   no more bits than their sets differ in shingles, so pairs whose sketches differ by more are never similar.
4. Groups are cut into blocks, bounded in sets and in bytes, by size class. The product of two blocks' incidence matrices
   holds all overlap counts; blocks whose sizes rule the threshold out are never paired. A product returns
   a spanning forest of its similar pairs, not the pairs.
5. Components of the forests are the result.

Within a large group work grows with the square of its different sets: each sketch meets all others of its sizes once, a
sketch in N / SKETCH_BLOCK units, and each set of what stays together is in N / BLOCK units. Equal sets are one node.
"""

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspan.llm.cluster import checkpoint
from driftspan.llm.components import connected_components, join_heavy
from driftspan.llm.words import SCAN_BYTES, Words, blocks, mix

BLOCK, SKETCH_BLOCK, BLOCK_BYTES = 512, 2048, 32 << 20
DEALT, SKETCHES_DEALT = 64, 4096  # sets, and sketches, that a task sends to units at once
KEY, LINK, DOCUMENT = 0, 1, 2
_FOUND = "kind byte, a long, b long, n long, row long, sketch binary"
_C = np.uint64(0xA0761D6478BD642F)


def shingle_sets(block: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents in turn, first of each document).

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    hashes, at = block.windows(size)
    doc = block.doc[at]
    for k in range(1, size):
        short = np.flatnonzero(block.counts == k)
        if len(short):
            hashes = np.concatenate([hashes, mix(block.window_hashes(k)[block.first[short]] + np.uint64(k))])
            doc = np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(block) + 1))


def sketches(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A parity sketch of each set: bit i tells whether an odd number of its hashes are i modulo the sketch's bits.

    The number of bits is the least power of two from 64 on that the size does not exceed. A sketch folds into one of
    half the bits by exclusive or.
    """
    sizes = np.diff(first)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(begin[:-1], sizes) + (mix(hashes ^ _C) & (np.repeat(bits, sizes) - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[a // 8 : b // 8] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def fold(sketch: bytes, words: int) -> np.ndarray:
    """A sketch as that many 64-bit words."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


@cache
def size_classes(percent: int) -> np.ndarray:
    """Least size of each class; sizes that can reach the threshold are at most a class or two apart."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, -(-100 * bounds[-1] // percent)))
    return np.array(bounds, np.int64)


def _class_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(size_classes(percent), sizes, "right") - 1


def _digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=total[1:])
    other = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ _C), out=other[1:])
    return mix((total[first[1:]] - total[first[:-1]]) ^ mix((other[first[1:]] - other[first[:-1]]) + np.diff(first).astype(np.uint64)))


def candidate_keys(hashes: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) such that any two different sets of enough similarity have a key in common."""
    sizes = np.diff(first)
    own, last = _class_of(sizes, percent), _class_of(100 * sizes // percent, percent)
    bounds, total = size_classes(percent), np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + _C), out=total[1:])
    keys, docs = [], []
    for step in range(int((last - own).max(initial=-1)) + 1):
        cls = own + step
        apart = (100 - percent) * 2 * (bounds[np.minimum(cls + 1, len(bounds) - 1)] - 1) // (100 + percent)
        apart = np.where((cls <= last) & (sizes > 0), apart, 0)
        spare = -(-apart // 4)
        ranges = np.where(apart > 0, apart + 1 + spare, 0)
        base = np.concatenate([[0], np.cumsum(ranges)])
        if not base[-1]:
            continue
        doc = np.repeat(np.arange(len(sizes)), ranges)
        number = np.arange(base[-1]) - base[doc]
        use = np.repeat(ranges > 0, sizes)
        m = np.repeat(ranges, sizes)[use].astype(np.uint64)
        slot = np.repeat(base[:-1], sizes)[use] + (((hashes[use] >> np.uint64(32)) * m) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(slot, minlength=base[-1])
        ends = np.repeat(first[:-1], ranges) + np.cumsum(held) - np.repeat((np.cumsum(held) - held)[base[:-1].clip(max=base[-1] - 1)], ranges)
        content = total[ends] - total[ends - held]
        least = held[np.lexsort((held, doc))][(base[:-1] + spare).clip(max=base[-1] - 1)]
        keep = held >= least[doc]
        keys.append(mix(content ^ mix((cls[doc] << 32 | number).astype(np.uint64)))[keep])
        docs.append(doc[keep])
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, least node of each key, then for every row its key's least node), from rows in any order."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    lead = nodes[head][np.cumsum(head) - 1] if len(nodes) else nodes
    other = nodes != lead
    pairs = np.unique(np.stack([lead[other], nodes[other]]), axis=1)
    return keys[head], nodes[head], pairs


def _candidates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """kind, a, b, n, row, sketch: DOCUMENT rows (id, node, set size, row key, parity sketch) and LINK rows (least node of a key, node)."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("row", pa.int64()), ("sketch", pa.binary())])

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, sketch: list[bytes] | None = None) -> pa.RecordBatch:
        signed = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *signed, pa.nulls(len(a), pa.int64()) if n is None else pa.array(n), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary()) if sketch is None else pa.array(sketch, pa.binary())], schema=schema)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), lower=True, size=SCAN_BYTES):
                hashes, first = shingle_sets(block, size)
                nodes = _digests(hashes, first)
                out = batch_of(DOCUMENT, np.zeros(len(block), np.int64), nodes, np.diff(first), sketches(hashes, first))
                yield out.set_column(1, "a", batch.column(0).slice(block.rows.start, len(block))).set_column(4, "row", batch.column(1).slice(block.rows.start, len(block)))
                _, once = np.unique(nodes, return_index=True)
                lone = np.zeros(len(block), bool)
                lone[once] = True
                sizes = np.diff(first)
                kept = np.repeat(lone, sizes)
                key, doc = candidate_keys(hashes[kept], np.concatenate([[0], np.cumsum(np.where(lone, sizes, 0))]), percent)
                key, node, pairs = _stars(key, nodes[doc])
                yield batch_of(LINK, *pairs)
                yield batch_of(KEY, key, node)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node = [], []
        for batch in batches:
            own = batch.column(0).to_numpy() == KEY
            if (~own).any():
                yield batch.filter(pa.array(~own))
            key.append(batch.column(1).fill_null(0).to_numpy()[own].view(np.uint64))
            node.append(batch.column(2).to_numpy()[own].view(np.uint64))
        if key:
            _, _, pairs = _stars(np.concatenate(key), np.concatenate(node))
            yield batch_of(LINK, *pairs)

    rows = docs.mapInArrow(keys, _FOUND)
    deal = F.when(F.col("kind") == KEY, F.col("a")).otherwise(F.xxhash64("a", "b"))
    return rows.repartition(deal).mapInArrow(meet, _FOUND)


def _forest(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, other) for each component of a symmetric matrix."""
    left, roots, others = np.ones(len(adjacent), bool), [], []
    for i in range(len(adjacent)):
        if left[i]:
            left[i] = False
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(adjacent[front].any(0) & left)
                left[front] = False
                roots.append(np.full(len(front), i))
                others.append(front)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *roots]), np.concatenate([none, *others])


def overlap_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections: the incidence matrix times its transpose, `columns` n-grams at a time."""
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column = np.unique(flat, return_inverse=True)
    shared = (np.bincount(column) > 1)[column]
    _, column = np.unique(column[shared], return_inverse=True)
    rows, total = rows[shared], np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[rows[a:b], column[a:b] - lo] = 1
        total += (part @ part.T).astype(np.int64)  # of at most `columns` ones each: exact
    return total


def similar_forest(sets: list[np.ndarray], percent: int, across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that reach the threshold; with across (0, 1), of pairs with one set of either."""
    sizes = np.array([len(x) for x in sets])
    common = overlap_counts(sets)
    similar = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if across is not None:
        similar &= across[:, None] != across[None, :]
    return _forest(similar)


def _sets(texts: DataFrame, grouped: DataFrame, size: int) -> DataFrame:
    """node, gid, n, classes, grams (sorted shingle hashes) of the nodes of grouped, which names a row for each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), lower=True, size=SCAN_BYTES):
                hashes, first = shingle_sets(block, size)
                rows = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                own = [c.slice(block.rows.start, len(block)) for c in batch.columns[1:]]
                same = pa.array(own[0].to_numpy().view(np.uint64) == _digests(hashes, first))  # not a row with another text
                yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.binary())], [*batch.schema.names[1:], "grams"]).filter(same)

    members = texts.select("row", "text").join(grouped.hint("shuffle_hash"), "row").select("text", "node", "gid", "n", "classes")
    return members.mapInArrow(found, "node long, gid long, n long, classes array<struct<cls: int, members: int>>, grams binary")


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one unit after another, from batches in which they come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column(0).to_numpy()
        for part in np.split(np.arange(len(unit)), np.flatnonzero(np.diff(unit)) + 1):
            if len(part):
                if held and held[0].column(0)[0].as_py() != unit[part[0]]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(part[0], len(part)))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(batch: pa.RecordBatch, percent: int, block: int, most: int, whole: bool = True) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(row of the batch, unit, side), `most` at a time: a node of a large group goes to many units."""
    node, gid, n = (batch.column(c).to_numpy() for c in ("node", "gid", "n"))
    cls, held = _class_of(n, percent), []
    for i, classes in enumerate(batch.column("classes")):
        members = {x["cls"]: x["members"] for x in classes.as_py()}
        held += [(i, *x) for x in _units(int(gid[i]), int(node[i]), int(cls[i]), members, percent, block, whole)]
        while len(held) >= most or held and i + 1 == len(node):
            at, unit, side = zip(*held[:most], strict=True)
            yield pa.array(at), pa.array(unit, pa.int64()), pa.array(side, pa.int8())
            held = held[most:]


def _spread(units: DataFrame) -> DataFrame:
    """By unit, sorted, over a fixed number of tasks: a unit is much work for few bytes, so small tasks must not be put together."""
    return units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """sets: as of _sets. -> a, b: a forest that joins all similar nodes of each group."""
    schema = pa.schema([("unit", pa.int64()), ("side", pa.int8()), ("node", pa.int64()), ("grams", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit, side in _dealt(batch, percent, BLOCK, DEALT):
                yield pa.RecordBatch.from_arrays([unit, side, *(batch.column(c).take(at) for c in ("node", "grams"))], schema=schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_unit(batches):
            nodes, sides = table["node"].to_numpy(), table["side"].to_numpy()
            own = np.unique(nodes, return_index=True)[1]  # repeated rows stand for one node
            sets = [np.frombuffer(table["grams"][int(i)].as_buffer(), np.uint64) for i in own]
            a, b = similar_forest(sets, percent, sides[own] if sides[own].max() > 0 else None)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own][x]) for x in (a, b)], ["a", "b"])

    return _spread(sets.mapInArrow(deal, "unit long, side byte, node long, grams binary")).mapInArrow(multiply, "a long, b long")


def close_sketches(left: np.ndarray, right: np.ndarray, sizes_left: np.ndarray, sizes_right: np.ndarray, percent: int, tile: int = 256) -> np.ndarray:
    """Which pairs of sketches (rows of words) differ in no more bits than sets of these sizes may."""
    out = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(left), tile):
        part = left[lo : lo + tile]
        apart = np.zeros((len(part), len(right)), np.int32)
        for w in range(left.shape[1]):
            apart += np.bitwise_count(part[:, w, None] ^ right[None, :, w])
        out[lo : lo + tile] = (100 + percent) * apart <= (100 - percent) * (sizes_left[lo : lo + tile, None] + sizes_right[None, :])
    return out


def _drawn_apart(members: DataFrame, percent: int) -> DataFrame:
    """members: node, gid, n, sketch, classes. -> a, b: a forest that joins all pairs whose sketches are close enough."""
    schema = pa.schema([("unit", pa.int64()), ("side", pa.int8()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit, side in _dealt(batch, percent, SKETCH_BLOCK, SKETCHES_DEALT, whole=False):
                yield pa.RecordBatch.from_arrays([unit, side, *(batch.column(c).take(at) for c in ("node", "n", "sketch"))], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_unit(batches):
            nodes, sides, sizes = (table[c].to_numpy() for c in ("node", "side", "n"))
            raw = table["sketch"].to_pylist()
            words = min(map(len, raw)) // 8
            rows = np.stack([fold(x, words) for x in raw])
            near = np.zeros((len(nodes), len(nodes)), bool)
            a, b = (np.flatnonzero(sides <= 0), np.flatnonzero(sides != 0))
            near[np.ix_(a, b)] = close_sketches(rows[a], rows[b], sizes[a], sizes[b], percent)
            x, y = _forest(near | near.T)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[z]) for z in (x, y)], ["a", "b"])

    spread = members.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")  # a group came together by its key
    return _spread(spread.mapInArrow(deal, "unit long, side byte, node long, n long, sketch binary")).mapInArrow(compare, "a long, b long")


def _signed(*parts: int) -> int:
    x = np.uint64(0)
    for p in parts:
        x = mix(np.array([x ^ np.uint64(p % (1 << 64))], np.uint64) + _C)[0]
    return int(x.view(np.int64))


def _block(cls: int, percent: int, most: int) -> int:
    """How many sets of a size class are a block."""
    return max(1, min(most, BLOCK_BYTES // (8 * int(size_classes(percent)[cls + 1]))))


def _units(gid: int, node: int, cls: int, members: dict[int, int], percent: int, block: int, whole: bool = True) -> list[tuple[int, int]]:
    """(unit, side) for each product that this node takes part in; side -1: all pairs of the unit count.

    A group of at most a block is one unit if `whole`.
    """
    if whole and sum(n / _block(c, percent, block) for c, n in members.items()) <= 1:
        return [(_signed(gid), -1)]
    part = (node * 0x9E3779B97F4A7C15 >> 32 & 0xFFFFFFFF) % -(-members[cls] // _block(cls, percent, block))
    return _block_units(gid, cls, part, tuple(sorted(members.items())), percent, block)


@lru_cache(1 << 14)
def _block_units(gid: int, cls: int, part: int, members: tuple[tuple[int, int], ...], percent: int, block: int) -> list[tuple[int, int]]:
    mine, out = (cls, part), [(_signed(gid, cls, part), -1)]
    reach = lambda c: int(_class_of(np.array([100 * (size_classes(percent)[c + 1] - 1) // percent]), percent)[0])
    for c, n in members:
        if cls <= c <= reach(cls) or c <= cls <= reach(c):
            for r in range(-(-n // _block(c, percent, block))):
                if (c, r) != mine:
                    low, high = sorted([mine, (c, r)])
                    out.append((_signed(gid, *low, *high), int(mine == high)))
    return out


def _class_column(n: Column, percent: int) -> Column:
    bounds = F.array(*(F.lit(int(x)) for x in size_classes(percent)))
    return F.size(F.filter(bounds, lambda x: x <= n)) - 1


def _class_counts(grouped: DataFrame) -> DataFrame:
    """gid, classes: the number of members by size class, of which there are a few dozen at most."""
    return grouped.groupBy("gid", "cls").agg(F.count("*").cast("int").alias("members")).groupBy("gid").agg(F.collect_list(F.struct("cls", "members")).alias("classes"))


def _with_classes(grouped: DataFrame, percent: int) -> DataFrame:
    """grouped (node, gid, n, and others) with classes."""
    grouped = checkpoint(grouped.withColumn("cls", _class_column(F.col("n"), percent)))
    return join_heavy(grouped, _class_counts(grouped), "gid", F.col("node"), grouped.count()).drop("cls")


def _is_large(classes: Column, percent: int) -> Column:
    """Whether a group is more than one block."""
    blocks_of = F.array(*(F.lit(1 / _block(c, percent, BLOCK)) for c in range(len(size_classes(percent)) - 1)))
    return F.aggregate(classes, F.lit(0.0), lambda s, x: s + x["members"] * F.element_at(blocks_of, x["cls"] + 1)) > 1 + 1e-9


def _joined(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """a, b: forests that join all similar nodes of sets."""
    is_large = _is_large(F.col("classes"), percent)
    large = sets.where(is_large)
    if large.isEmpty():
        return _links(sets, percent)
    members = checkpoint(large.select("node", "gid", "n").dropDuplicates(["node"]))
    sketched = found.where((F.col("kind") == DOCUMENT) & (F.col("n") > 0)).select(F.col("b").alias("node"), "sketch").dropDuplicates(["node"])
    close = connected_components(_drawn_apart(_with_classes(members, percent).join(sketched, "node").select("node", "gid", "n", "sketch", "classes"), percent))
    fine = close.join(members.select("node", "n"), "node").select("node", F.col("component").alias("gid"), "n")
    placed = large.select("node", "grams").join(_with_classes(fine, percent).hint("shuffle_hash"), "node").select("node", "gid", "n", "classes", "grams")
    return _links(sets.where(~is_large).unionByName(placed), percent)


def _placed(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc, row (a digest of id and text), n, component (null without words), least and first (least id and first row key of the component)."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).select("doc", F.xxhash64("doc", "text").alias("row"), "text")
    found = checkpoint(_candidates(texts, size, percent))
    info = found.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("doc"), F.col("b").alias("node"), "n", "row")
    groups = connected_components(found.where(F.col("kind") == LINK).select("a", "b")).withColumnRenamed("component", "gid")
    nodes = info.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("n").alias("n"))
    sets = checkpoint(_sets(texts, _with_classes(groups.join(nodes, "node"), percent), size))
    similar = connected_components(_joined(sets, found, percent))
    placed = checkpoint(info.join(similar, "node", "left").select("doc", "row", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component")))
    first = placed.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("x")).select("component", F.col("x.doc").alias("least"), F.col("x.row").alias("first"))
    return join_heavy(placed, first, "component", F.col("row"), placed.count())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), one row for each row of docs.

    Sets of `size`-word shingles of the text with A-Z lower-cased are linked from a similarity of `percent` on.
    Null and empty texts are linked with nothing. Rows are linked by their texts alone: rows that repeat an id with
    other texts, or have none, lose no link; where no row of a component has an id, component_id is null. No rows give
    no rows. Node keys are 64-bit digests of whole sets.
    """
    placed = _placed(docs, size, percent, doc_id, text)
    return placed.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, all columns, of each group of near-duplicates: that of the least id, one without an id if there is no other.

    Rows without words stay. Of rows with equal id and text, any one stays.
    """
    placed = checkpoint(_placed(docs, size, percent, doc_id, text))
    later = placed.where("component is not null and row <> first").select(F.col("row").alias("__later"), F.col("doc").alias("__doc")).distinct()
    key = F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    kept = docs.join(later.hint("shuffle_hash"), (key == F.col("__later")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__doc")), "left_anti")
    if placed.where("row = first").groupBy("row").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return kept
    repeated = placed.where("row = first").groupBy("row").agg(F.count("*").alias("k")).where("k > 1").select(F.col("row").alias("__row"))
    once = kept.join(repeated.hint("shuffle_hash"), key == F.col("__row"), "left").withColumn("__key", key)
    return once.where("__row is null").select(*docs.columns).unionByName(once.where("__row is not null").dropDuplicates(["__key"]).select(*docs.columns))
