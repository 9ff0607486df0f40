"""Stupid-backoff scores of documents by relational n-gram counts.

Documents are dealt into blocks of bounded bytes. A block's distinct n-grams of all lengths up to the order, with its own
counts, are sorted and cut by hash range into the partitions of the count table, as many as Spark shuffles into. There
the counts of all blocks are added up, and each block is joined to the sums of its own n-grams; a last pass explodes the
block's n-grams again and sums their scores by document. The table's rows are (part, block, keys, counts) with keys and
counts packed: a row a key took 3 to 4 times the bytes. Their number is blocks times partitions, as of a shuffle's
own pieces; their volume follows the corpus. ngram_counts() gives the same counts as plain rows.

A document is scored by the counts of all other documents: its own are taken off first. A word w after the words h has
S(w | h) = c(h w) / c(h) if c(h w) > 0, else BACKOFF * S(w | h without its first word); S(w) = c(w) / N, with half
a count for a word no other document has.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspan.llm.words import blocks, mix, text_buffers

BACKOFF = 0.4
ORDER = 3
BLOCK_BYTES = 4 << 20
KEY_BITS = 56
_STEP = np.uint64(0xD1B54A32D192ED03)
_ASK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TELL = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])


def _squeeze(values: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def _expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


@dataclass
class Ngrams:
    """The n-grams of some texts: keys (sorted, distinct) and counts, and of the n-grams that end at each word, by length,
    their place in keys (-1: the text has fewer words before) and how often their own document has them."""

    keys: np.ndarray
    counts: np.ndarray
    place: list[np.ndarray]
    own: list[np.ndarray]
    doc: np.ndarray


def _ngrams(texts: pa.Array, order: int) -> Ngrams:
    """Of lower-cased texts."""
    hashes, doc, depth, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for block in blocks(texts, lower=True):
        hashes.append(block.hashes)
        doc.append(block.doc + base)
        depth.append(np.arange(len(block.hashes)) - np.repeat(block.first[:-1], block.counts))
        base += len(block)
    words, doc, depth = np.concatenate(hashes), np.concatenate(doc), np.concatenate(depth)
    ends, grams, chain = [], [], words
    for n in range(order):
        if n:
            chain = mix(np.concatenate([chain[:1], chain[:-1]]) * _STEP + words)
        ends.append(np.flatnonzero(depth >= n))
        grams.append(chain[ends[n]] >> np.uint64(64 - KEY_BITS))
    key, owner = np.concatenate(grams), doc[np.concatenate(ends)]
    sort = np.argsort(key, kind="stable")  # documents of equal keys stay in order
    new = np.ones(len(key), bool)
    new[1:] = key[sort[1:]] != key[sort[:-1]]
    run = new.copy()
    run[1:] |= owner[sort[1:]] != owner[sort[:-1]]
    at, own = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    at[sort] = np.cumsum(new) - 1
    starts = np.flatnonzero(run)
    own[sort] = np.diff(np.append(starts, len(key)))[np.cumsum(run) - 1]
    out, lo = Ngrams(key[sort[new]], np.diff(np.append(np.flatnonzero(new), len(key))), [], [], doc), 0
    for e in ends:
        for values, found in ((at, out.place), (own, out.own)):
            whole = np.full(len(words), -1)
            whole[e] = values[lo : lo + len(e)]
            found.append(whole)
        lo += len(e)
    return out


def _texts(column: pa.Array) -> pa.Array:
    loose = zstandard.ZstdDecompressor()
    return pa.array([loose.decompress(x.as_py()) for x in column], pa.large_binary())


def _ask(parts: int, order: int):
    edges = (np.arange(parts + 1, dtype=object) * (1 << KEY_BITS) // parts).astype(np.uint64)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        found = _ngrams(_texts(table["data"]), order)
        cuts, rows = np.searchsorted(found.keys, edges), []
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                rows.append((p, key[0].as_py(), _squeeze(np.diff(found.keys[a:b], prepend=np.uint64(0))), _squeeze(found.counts[a:b].astype(np.uint32))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _ASK.types, strict=True)], schema=_ASK)

    return ask


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corpus's counts of each block's keys, in their order; one partition of the table after another."""
    table = pa.Table.from_batches(list(batches), _ASK)
    part = table["part"].to_numpy()
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        keys = [np.cumsum(_expand(table["keys"][int(i)].as_py(), np.uint64), dtype=np.uint64) for i in own]
        counts = [_expand(table["counts"][int(i)].as_py(), np.uint32) for i in own]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts)).astype(np.uint64)[place]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        told = [_squeeze(x) for x in np.split(total, cuts)]
        yield pa.RecordBatch.from_arrays([table["block"].take(pa.array(own)).combine_chunks(), pa.array(part[own]), pa.array(told, pa.binary())], schema=_TELL)


def _score(words_in_corpus: int, order: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _ngrams(_texts(left["data"]), order)
        right = right.sort_by("part")
        corpus = np.concatenate([np.zeros(0, np.uint64), *(_expand(x.as_py(), np.uint64) for x in right["counts"])]).astype(np.int64)
        n = np.bincount(found.doc, minlength=len(left))
        others = [np.where(p >= 0, corpus[p] - o, 0) if len(p) else p for p, o in zip(found.place, found.own, strict=True)]
        logs = np.log(np.maximum(others[0], 0.5) / np.maximum(n[found.doc] * -1 + words_in_corpus, 1)) if len(found.doc) else np.zeros(0)
        for k in range(1, order):
            there, context = found.place[k] >= 0, np.concatenate([others[k - 1][:1], others[k - 1][:-1]])
            seen = np.log(np.maximum(others[k], 1) / np.maximum(context, 1))
            logs = np.where(there, np.where(others[k] > 0, seen, np.log(BACKOFF) + logs), logs)
        total = np.bincount(found.doc, logs, minlength=len(left)).astype(float)
        return pa.table({"doc_id": left["doc_id"].combine_chunks(), "n_words": pa.array(n), "log_score": pa.array(total), "mean_log_score": pa.array(np.where(n > 0, total / np.maximum(n, 1), np.nan), from_pandas=True)})

    return score


def ngram_counts(docs: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """length, ngram (words joined by one space), n: the count table of the corpus as plain rows, words lower-cased (A-Z).

    Null and empty texts have no n-grams. For looking at and for tests: a row an n-gram.
    """
    lower = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.regexp_extract_all(lower, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w")).where("size(w) > 0")

    def grams(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1))), lambda i: F.struct(F.lit(k).alias("length"), F.slice("w", i, k).alias("g")))

    rows = words.select(F.explode(F.concat(*map(grams, range(1, order + 1)))).alias("x")).where("size(x.g) = x.length")
    return rows.groupBy("x.length", F.array_join("x.g", " ").alias("ngram")).agg(F.count("*").alias("n"))


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithms, summed over words) and mean_log_score, a row for each row of docs.

    Words are those of lower-cased (A-Z) texts. A null or empty text has no words, score 0 and no mean. Rows of the
    same id, and null ids, are documents of their own; rows of equal id and text lie in one block. The first words of a
    text have as many words before them as there are. No rows give no rows.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    id_kind = docs.schema[doc_id].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size, words = docs.select(F.sum(F.octet_length(whole) + 64), F.sum(F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")))).first()
    n_blocks = max(1, -(-(size or 0) // block_bytes))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            small = [compressor.compress(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(small, pa.binary())], ["block", "doc_id", "data"])

    dealt = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(n_blocks)).alias("block"), F.col(doc_id).alias("doc_id"), whole.alias("text"))
    dealt = dealt.mapInArrow(press, f"block long, doc_id {id_kind}, data binary").groupBy("block")
    asked = dealt.applyInArrow(_ask(parts, order), "part int, block long, keys binary, counts binary")
    told = asked.repartitionById(parts, "part").mapInArrow(_sum, "block long, part int, counts binary")
    return dealt.cogroup(told.groupBy("block")).applyInArrow(_score(words or 0, order), f"doc_id {id_kind}, n_words long, log_score double, mean_log_score double")
