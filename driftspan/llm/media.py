"""Media columns: payloads of documents as FLAC streams, and back as blocks of samples with their offsets."""

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspan.llm import flac
from driftspan.llm.words import byte_runs, text_buffers

def payload(text: bytes) -> bytes:
    """The text with spaces added up to a positive multiple of a frame."""
    return text.ljust(max(1, -(-len(text) // flac.BLOCK)) * flac.BLOCK)


def encode_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (without padding), media binary (a FLAC stream), a row for each row of docs; a null text is empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in byte_runs(offsets):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                media = flac.encode([payload(x) for x in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _decoded(column: pa.Array) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    data, offsets = text_buffers(column)
    for lo, hi in byte_runs(offsets):
        media = [data[a:b].tobytes() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
        yield lo, media, flac.decode(media)


def pcm_blocks(media: DataFrame, frames: int = 64) -> DataFrame:
    """doc_id, sample_offset, pcm binary: the samples of each stream in blocks of `frames` frames.

    A block begins at a multiple of `frames` times the frame length, so a range of samples names its blocks.
    media: rows of encode_media; a null stream raises, for it is no stream.
    """
    kind, size = media.schema["doc_id"].dataType.simpleString(), frames * flac.BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, payloads in _decoded(batch.column(1)):
                rows = [(lo + i, at, p[at : at + size]) for i, p in enumerate(payloads) for at in range(0, len(p), size)]
                own, offsets, pcm = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(offsets, pa.int64()), pa.array(pcm, pa.binary())], ["doc_id", "sample_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, sample_offset long, pcm binary")


def feature(samples: bytes) -> str:
    """Mean, energy and sign changes of the samples, as integers: 'mean:energy:crossings'."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    return f"{int(x.sum()) // len(x)}:{int((x * x).sum(dtype=np.int64)) // len(x)}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def media_report(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and, of each stream read back: payload_bytes, payload_sha256, tail_crc32 (last 16 bytes), media_bytes, media_sha256, feature."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, stored, payloads in _decoded(batch.column(2)):
                n = len(stored)
                columns = [[len(p) for p in payloads], [sha256(p).hexdigest() for p in payloads], [crc32(p[-16:]) for p in payloads], [len(m) for m in stored], [sha256(m).hexdigest() for m in stored], [feature(p) for p in payloads]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), *map(pa.array, columns)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
