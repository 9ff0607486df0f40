"""Removal of passages that an earlier document has too, by level-wise doubling.

A window is `window` consecutive words. Level lengths double up to it (13: 7, 13; 50: 7, 13, 25, 50).
At the first level each window is stood for by the least hash among its runs of that length, so two equal
windows name the same run and a fraction of all runs is counted. Runs found in one document only end
their windows; what survives is looked at again at twice the length. The last level counts whole windows,
so earlier levels only save work. At every level a block of documents settles its own repeats before the
shuffle: a run that a third of all documents hold costs one row a block.
"""

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspan.llm.words import Words, blocks, mix

SHORTEST = 7
OPEN, SETTLED, WITNESS = 0, 1, 2
_ROWS = pa.schema([("deal", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("state", pa.int8())])
_FOUND = pa.schema([("doc", pa.int64()), ("key", pa.int64())])


def level_lengths(window: int) -> list[int]:
    """Lengths from SHORTEST or a little more, each at most twice the one before, up to window."""
    lengths = [window]
    while (half := (lengths[0] + 1) // 2) >= SHORTEST:
        lengths.insert(0, half)
    return lengths


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """At i, the least of values[i:i + span]; shorter than values by span - 1."""
    least, width = values, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.minimum(least[: len(values) - span + 1], least[span - width :]) if len(values) >= span else values[:0]


def _first_keys(block: Words, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window's start, key of the run that stands for it)."""
    at = block.window_starts(window)
    return at, (_sliding_min(block.window_hashes(length), window - length + 1)[at] if len(at) else np.zeros(0, np.uint64))


def _pairs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, document) in order of both."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], docs[new]


def _rows(deal: np.ndarray, keys: np.ndarray, docs: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(docs), pa.array(state.astype(np.int8))], schema=_ROWS)


def _settle(keys: np.ndarray, docs: np.ndarray, last: bool) -> pa.RecordBatch:
    """Rows of one block, its own repeats settled. At the last level a row stands for 'this document, this window'."""
    keys, docs = _pairs(keys, docs)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    shared = ~first
    shared[:-1] |= ~first[1:]
    state = np.where(first, OPEN, SETTLED) if last else np.where(shared, SETTLED, OPEN)
    deal = np.where(state == SETTLED, mix(docs.view(np.uint64)), keys)
    if last:
        return _rows(deal, keys, docs, state)
    witness = first & shared
    return _rows(*(np.concatenate(x) for x in ((deal, keys[witness]), (keys, keys[witness]), (docs, docs[witness]), (state, np.full(witness.sum(), WITNESS)))))


def _meet(last: bool) -> Callable:
    """All rows of a key are in one partition: keep (document, key) of what repeats."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        _, keys, docs, state = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        done = state == SETTLED
        found = [(docs[done], keys[done])]
        keys, docs, state = keys[~done], docs[~done], state[~done]
        order = np.lexsort((docs, keys))
        keys, docs, state = keys[order], docs[order], state[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(head) - 1
        if last:
            keep = docs > docs[head][group]
        else:
            several = np.zeros(int(head.sum()), bool)
            several[group[docs != docs[head][group]]] = True
            several[group[state == WITNESS]] = True
            keep = several[group] & (state == OPEN)
        found.append((docs[keep], keys[keep]))
        docs, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        for i in range(0, len(docs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + (1 << 16)]), pa.array(keys[i : i + (1 << 16)])], schema=_FOUND)

    return meet


def _listed(rows: DataFrame, last: bool) -> DataFrame:
    """By document, the keys that repeat."""
    return rows.repartition(F.col("deal")).mapInArrow(_meet(last), "doc long, key long").groupBy("doc").agg(F.collect_list("key").alias("keys"))


def _marked(block: Words, lists: pa.Array, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of these runs (hash, first word) are in the list of their own document."""
    own = lists.slice(block.rows.start, len(block))
    sizes = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    salt = np.arange(len(block), dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    keys = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.repeat(salt, sizes)
    return np.isin(hashes ^ salt[block.doc[at]], keys)


def _candidates(block: Words, lists: pa.Array, window: int, length: int, first: bool) -> np.ndarray:
    """Starts of the windows that the level of this length left over."""
    at = block.window_starts(window)
    if not len(at):
        return at
    if first:
        at, keys = _first_keys(block, window, length)
        return at[_marked(block, lists, keys, at)]
    hashes = block.window_hashes(length)
    there = _marked(block, lists, hashes, np.arange(len(hashes)))
    return at[there[at] & there[at + window - length]]


def _next_level(window: int, before: int, length: int, first: bool) -> Callable:
    """Rows of the runs of `length` words that the windows left over at the level before begin and end with."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for block in blocks(batch.column(1)):
                at = _candidates(block, batch.column(2), window, before, first)
                if len(at):
                    at = np.union1d(at, at + window - length)
                    yield _settle(block.window_hashes(length)[at], ids[block.rows][block.doc[at]], length == window)

    return rows


def _first_level(window: int, length: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                at, keys = _first_keys(block, window, length)
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (block.doc[at[1:]] != block.doc[at[:-1]])
                yield _settle(keys[new], ids[block.rows][block.doc[at[new]]], length == window)

    return rows


def repeated_windows(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc long, keys array<long>: hashes of the document's windows that also start in a document of smaller id.

    Rows without an id or a text take no part. Rows of the same id never make each other repeat.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    lengths = level_lengths(window)
    schema = "deal long, key long, doc long, state byte"
    lists = _listed(texts.where("doc is not null and text is not null").mapInArrow(_first_level(window, lengths[0]), schema), lengths[0] == window)
    for i, length in enumerate(lengths[1:]):
        held = _with_lists(texts, lists, "doc").select("doc", "text", "__keys")
        lists = _listed(held.mapInArrow(_next_level(window, lengths[i], length, i == 0), schema), length == window)
    return lists


def _covered(block: Words, lists: pa.Array, window: int) -> np.ndarray:
    hashes, at = block.windows(window)
    depth = np.zeros(len(block.hashes) + 1, np.int64)
    if len(at):
        hit = at[_marked(block, lists, hashes, at)]
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + window, -1)
    return np.cumsum(depth[:-1]) > 0


def _with_lists(docs: DataFrame, lists: DataFrame, doc_id: str) -> DataFrame:
    """docs with the lists as column __keys; every row stays, those without an id too.

    Always a left join of the same shape, so that one shuffle of the texts serves every level.
    """
    return docs.join(lists.select(F.col("doc").alias("__doc"), F.col("keys").alias("__keys")).hint("shuffle_hash"), F.col(doc_id).cast("long") == F.col("__doc"), "left").drop("__doc")


def removal_report(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (the kept words joined by one space), a row for each row of docs.

    A null text has no words. Words of removed windows go; windows are judged on the input.
    """
    lists = repeated_windows(docs, window, doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()
    held = _with_lists(docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")), lists, "doc")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                gone = _covered(block, batch.column(2), window)
                removed, raw, digests = block.per_doc(gone), block.data.tobytes(), []
                for i in range(len(block)):
                    words = raw[block.doc_bytes[i] : block.doc_bytes[i + 1]].split()
                    if removed[i]:
                        words = [w for w, g in zip(words, gone[block.first[i] : block.first[i + 1]], strict=True) if not g]
                    digests.append(sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(block)), pa.array(block.counts), pa.array(removed), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return held.select("doc", "text", "__keys").mapInArrow(report, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated passages cut from their texts, all columns and rows kept; n_chars, if there, follows.

    The white space around what stays is left as it was. A null text stays null; a text that is all repeats becomes empty.
    """
    lists = repeated_windows(docs, window, doc_id, text)
    held = _with_lists(docs, lists, doc_id)
    at, keys = docs.columns.index(text), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for block in blocks(batch.column(at)):
                gone = _covered(block, batch.column(keys), window)
                removed, raw = block.per_doc(gone), block.data.tobytes()
                for i in range(len(block)):
                    lo, hi = block.doc_bytes[i], block.doc_bytes[i + 1]
                    if not removed[i]:
                        texts.append(raw[lo:hi])
                        continue
                    own = slice(block.first[i], block.first[i + 1])
                    begins = block.starts[own]
                    until = np.append(begins[1:], hi)
                    stay = ~gone[own]
                    texts.append((raw[lo : begins[0]] + b"".join(raw[a:b] for a, b in zip(begins[stay], until[stay], strict=True))).strip())
            column = pa.array(texts, pa.binary()).cast(pa.string())
            column = pc.if_else(batch.column(at).is_valid(), column, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(keys)], names=batch.schema.names[:keys])

    out = held.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
