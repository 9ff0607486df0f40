"""Byte-pair encoding by content-defined chunks, and decoding.

A rolling hash over the last words cuts a text before a word, wherever the same words stand in any text, so
passages that documents share fall into equal chunks.

1. Documents are cut, and the digests of their chunks counted. A digest of two documents or more has an owner,
   the least key among these.
2. Owners encode their shared chunks, each once: the chunk table (digest, check, ids).
3. The table is joined to all documents that have the chunk, and what a document is told comes together under its key.
4. A document takes the ids of its shared chunks from there and encodes the others. The joins between chunks are
   encoded again until they agree with the text.

Texts are shuffled once, compressed, to meet what 2 and 4 tell them; ids of a vocabulary under 65,536 have 16 bits.
"""

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspan.llm.cluster import checkpoint
from driftspan.llm.tokens import chunk_encoder, library_tokenizer
from driftspan.llm.words import Words, blocks, byte_runs, text_buffers

ROLL, ONE_IN = 4, 64
HOT_SHARE, SALTS = 1000, 64


def cut_points(block: Words) -> np.ndarray:
    """Bytes at which a chunk begins: the hash of the ROLL words before a word says so, and not the word before. One space before it goes with it."""
    starts = np.arange(len(block.hashes))
    hashes = np.ones(len(starts), np.uint64)
    if len(starts) > ROLL:
        hashes[ROLL:] = block.window_hashes(ROLL)[:-ROLL]
    inside = (starts >= ROLL) & (starts - ROLL >= np.repeat(block.first[:-1], block.counts))
    cut = inside & (hashes % np.uint64(ONE_IN) == 0)
    cut[1:] &= ~cut[:-1]
    begin = block.starts[cut]
    return begin - (block.data[begin - 1] == 32)


def chunks_of(block: Words) -> Iterator[list[bytes]]:
    """By document, its bytes in chunks; an empty text is one empty chunk."""
    raw, cuts = block.data.tobytes(), cut_points(block)
    for lo, hi in zip(block.doc_bytes[:-1], block.doc_bytes[1:], strict=True):
        a, b = np.searchsorted(cuts, [lo, hi])
        ends = [int(lo), *cuts[a:b].tolist(), int(hi)]
        yield [raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _digest(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def _check(chunk: bytes) -> int:
    """A second digest: chunks are equal if both are."""
    return xxhash.xxh3_64_intdigest(chunk, seed=1) - (1 << 63)


def _occurrences(keyed: DataFrame) -> DataFrame:
    """digest, key: the distinct chunks of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = [list({_digest(c) for c in chunks}) for chunks in chunks_of(block)]
                keys = batch.column(0).slice(block.rows.start, len(block)).to_numpy()
                digests = np.array([d for own in found for d in own], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(np.repeat(keys, [len(own) for own in found]))], ["digest", "key"])

    return keyed.where("text <> ''").select("key", "text").mapInArrow(cut, "digest long, key long")


def _compressed(keyed: DataFrame, kind: str) -> DataFrame:
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in byte_runs(offsets):
                small = [press.compress(data[a:b]) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), pa.array(small, pa.binary())], ["key", "doc_id", "data"])

    return keyed.mapInArrow(squeeze, f"key long, doc_id {kind}, data binary")


def _unpacked(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, chunks by document) of runs of compressed texts."""
    loose = zstandard.ZstdDecompressor()
    data, offsets = text_buffers(texts)
    for lo, hi in byte_runs(offsets):
        raw = pa.array([loose.decompress(data[a:b]) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)], pa.large_binary())
        for block in blocks(raw):
            yield lo + block.rows.start, list(chunks_of(block))


def _told(docs: DataFrame, path: str, doc_id: str, text: str) -> DataFrame:
    """doc_id, data (the text, compressed), told: digest, check and ids of its chunks that another document has too; null if none."""
    kind, spark = docs.schema[doc_id].dataType.simpleString(), docs.sparkSession
    width = "<u2" if library_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(F.col(doc_id), whole).alias("key"), F.col(doc_id).alias("doc_id"), whole.alias("text"))
    places = checkpoint(_occurrences(keyed))
    shared = checkpoint(places.groupBy("digest").agg(F.min("key").alias("owner"), F.count("*").alias("n")).where("n > 1"))
    every = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(shared.where(F.col("n") * HOT_SHARE > every).select("digest", F.lit(True).alias("hot")))  # under HOT_SHARE rows
    texts = _compressed(keyed, kind)

    def with_lists(lists: DataFrame) -> DataFrame:
        """Always a left join of the same shape, and all columns of the texts in use, so that one shuffle of the texts serves both."""
        return texts.join(lists.withColumnRenamed("key", "__key").hint("shuffle_hash"), F.col("key") == F.col("__key"), "left")

    def own_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            for at, documents in _unpacked(batch.column(1)):
                rows = []
                for i, chunks in enumerate(documents):
                    wanted = set(batch.column(2)[at + i].as_py())
                    for digest, chunk in {_digest(c): c for c in chunks}.items():
                        if digest in wanted:
                            ids = np.frombuffer(encoder.encode([chunk]), "<u4").astype(width).tobytes()
                            rows.append((digest, _check(chunk), ids))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["digest", "check", "ids"])

    owners = shared.groupBy(F.col("owner").alias("key")).agg(F.collect_list("digest").alias("wanted"))
    table = with_lists(owners).select("doc_id", "data", "wanted").mapInArrow(own_chunks, "digest long, check long, ids binary").dropDuplicates(["digest"])
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    salted = table.join(hot, "digest", "left").select("digest", "check", "ids", copies.alias("salt"))
    salt = F.when(F.col("hot"), F.pmod("key", F.lit(SALTS)).cast("int")).otherwise(0)
    asked = places.join(hot, "digest", "left").select("digest", "key", salt.alias("salt"))
    lists = asked.join(salted, ["digest", "salt"]).groupBy("key").agg(F.collect_list(F.struct("digest", "check", "ids")).alias("told"))
    return with_lists(lists).select("doc_id", "data", "told")


def _encoded(told: DataFrame, path: str, columns: str, answer: Callable[[bytes], tuple]) -> DataFrame:
    """doc_id and, by `columns`, the answer to each document's packed ids."""
    width = "<u2" if library_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
    kind = told.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for batch in batches:
            for at, documents in _unpacked(batch.column(1)):
                rows = []
                for i, chunks in enumerate(documents):
                    known, heard = {}, batch.column(2)[at + i].as_py()
                    if heard:
                        table = {x["digest"]: (x["check"], x["ids"]) for x in heard}
                        for chunk in chunks:
                            check, ids = table.get(_digest(chunk), (None, b""))
                            if check is not None and check == _check(chunk):
                                known[chunk] = np.frombuffer(ids, width).astype("<u4").tobytes()
                    rows.append(answer(encoder.encode(chunks, known)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *map(pa.array, zip(*rows, strict=True))], names)

    schema = T.StructType.fromDDL(f"doc_id {kind}, {columns}")
    names = schema.names
    return told.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit integers), a row for each row of docs.

    A null text is empty and has no ids. Null ids and repeated rows are documents like others; rows with the same id
    and text lie in one task. No rows give no rows.
    """
    return _encoded(_told(docs, path, doc_id, text), path, "ids binary", lambda ids: (ids,))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column text that its ids stand for; no ids are the empty text, no rows give no rows."""
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for batch in batches:
            texts = pa.array([encoder.decode(x.as_py()) for x in batch.column(at)], pa.binary()).cast(pa.string())
            yield batch.append_column("text", texts)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, from its ids and their decoding, one document at a time.

    As encode(): a row for each row of docs, a null text is empty.
    """

    def answer(ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, sha256(ids).hexdigest(), sha256(chunk_encoder(path).decode(ids)).hexdigest()

    return _encoded(_told(docs, path, doc_id, text), path, "n_tokens long, ids_sha256 string, decoded_sha256 string", answer)
