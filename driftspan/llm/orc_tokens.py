"""Token ids of documents in ORC files: ascending ids, integer run-length encoding, row indexes, Bloom filters.

A file holds one range of document ids, in order. Beside its ids a row says where it starts within its file,
so readers of single stripes need no other row; a filter on doc_id skips stripes and row groups by
their minima, maxima and Bloom filters.
"""

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspan.llm.cluster import shared_dir
from driftspan.llm.tokens import END_ID, library_tokenizer, packed, word_encoder
from driftspan.llm.words import byte_runs, text_buffers

STRIPE_BYTES = 16 << 20
ROW_GROUP = 1000
ROW = "doc_id long, start_in_file long, n_tokens long, tokens array<int>"
_NULL = -(1 << 63)


def _cuts(docs: DataFrame, doc_id: str, parts: int) -> np.ndarray:
    """Quantiles of the ids, a null as the least of all, that cut the rows into `parts` ranges; a narrow scan."""
    known = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL))
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)), F.lit(1.0))
    found = docs.agg(F.percentile_approx(known, shares, 50 * parts)).first()[0]  # a number for each part
    return np.array(found[:-1] if found else [], np.int64)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_in_file, n_tokens, tokens (with the end id) in ascending order of doc_id over the partitions and within each.

    Texts are encoded where they lie; what is shuffled are ids, of 16 bits where the vocabulary allows it. A null
    text is empty; null ids come first; rows of one id lie side by side. An id that fills several partitions is dealt
    over these by a checksum of its tokens, otherwise its rows are in order of their tokens. No rows give no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(docs, doc_id, parts)
    kind = np.dtype("<u2" if library_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), packed([END_ID])
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in byte_runs(offsets):
                ids = [encoder.encode(data[a:b].tobytes()) + end for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                own = batch.column(0).slice(lo, hi - lo)
                known = own.fill_null(_NULL).to_numpy()
                first, last = (np.searchsorted(cuts, known, side) for side in ("left", "right"))
                spread = np.array([crc32(x) for x in ids])
                small = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array((first + spread % (last - first + 1)).astype(np.int32)), own, pa.array(small, pa.binary())], ["part", "doc_id", "ids"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            cut = (offsets - offsets[0]) // kind.itemsize
            values = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), kind).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total + cut[:-1]), pa.array(np.diff(cut)), lists], ["doc_id", "start_in_file", "n_tokens", "tokens"])
            total += int(cut[-1])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = source.mapInArrow(tokenize, "part int, doc_id long, ids binary").repartitionById(parts, "part").sortWithinPartitions("doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(widen, ROW)


def write(encoded: DataFrame, folder: str) -> None:
    """One file a partition, replacing what the folder holds; a task that runs again writes the same rows. No rows, no rows in the files."""
    options = {"compression": "zstd", "maxRecordsPerFile": 0, "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": ROW_GROUP, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    encoded.write.mode("overwrite").options(**options).orc(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start_in_file, n_tokens, tokens and file, from the files; filters on doc_id prune stripes and row groups."""
    return spark.read.schema(ROW).orc(folder).withColumn("file", F.col("_metadata.file_name"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of little-endian 32-bit ids), read from the files.

    A row for each row written, repeated ids and null ids too; a folder without rows gives none.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            values, offsets = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
            sums = [crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], ["doc_id", "start_in_file", "n_tokens", "file", "ids_crc32"])

    rows = read(spark, folder).select("doc_id", "start_in_file", "n_tokens", "file", "tokens").mapInArrow(digest, "doc_id long, start_in_file long, n_tokens long, file string, ids_crc32 long")
    files = read(spark, folder).groupBy("file").agg(F.max(F.col("start_in_file") + F.col("n_tokens")).alias("ids"))  # two narrow columns
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
    files = files.withColumn("before", F.sum("ids").over(Window.orderBy(number)) - F.col("ids"))  # a row a file, of which there is one a partition
    return rows.join(F.broadcast(files), "file").select("doc_id", (F.col("start_in_file") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_documents(docs: DataFrame, path: str, folder: str | None = None) -> str:
    """Writes the ids of docs to folder (a new one in shared storage by default) and returns the folder."""
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(encode(docs, path), folder)
    return folder
