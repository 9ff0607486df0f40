"""Packing of documents into sequences, shortest pack first over the histogram of lengths.

Documents are cut at multiples of the sequence length; what is left is never cut. Only the histogram (a row
for each length up to the sequence length) reaches the driver. There, lengths are placed longest first, each
into the emptiest pack that takes it, as counts of packing patterns. The patterns are joined back to the
pieces by their rank among pieces of equal length.
"""

import heapq
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspan.llm.cluster import checkpoint
from driftspan.llm.tokens import END_ID, packed, word_encoder
from driftspan.llm.words import text_buffers

LENGTH = 4096
RANKED = 100_000
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of packs, [(length, how many of it in a pack)])] that hold histogram's counts of lengths."""
    by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, count: int, pattern: tuple) -> None:
        if not by_room[room]:
            heapq.heappush(rooms, -room)
        by_room[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            count, pattern = by_room[room].pop()
            if not by_room[room]:
                heapq.heappop(rooms)
            used = min(count, left)
            if count > used:
                put(room, count - used, pattern)
            last = pattern[-1] if pattern[-1][0] == length else (length, 0)
            put(room - length, used, pattern[: len(pattern) - bool(last[1])] + ((length, last[1] + 1),))
            left -= used
        fit = capacity // length  # no open pack takes one more: a new pack is filled before the next is opened
        for count, times in ((left // fit, fit), (1, left % fit)):
            if count and times:
                put(capacity - times * length, count, ((length, times),))
    return [(count, list(pattern)) for room in sorted(by_room) for count, pattern in by_room[room]]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Rows sorted by length and first rank: the ranks of a length that a run of equal packs takes."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, taken[length], count, sequence, offset))
            taken[length] += count * times
            offset += length * times
        sequence += count
    rows.sort()
    return dict(zip(("length", "rank", "packs", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; a null text is empty and has the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), packed([END_ID])
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            rows: list[list[int]] = []
            for i in range(len(offsets) - 1):
                ids = encoder.encode(data[offsets[i] : offsets[i + 1]].tobytes()) + end
                for start in range(0, len(ids), 4 * length):
                    piece = ids[start : start + 4 * length]
                    rows.append((i, start // 4, len(piece) // 4, crc32(piece), len(ids) // 4))
            if rows:
                at, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, columns)], schema=_PIECE)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """pieces (any columns, among them length from 1 to capacity) with sequence_id and offset, gapless from 0 in a sequence.

    No pieces give no rows. Equal rows, and rows of a null id, are placed apart. pieces is read more than once: pass it kept or cheap.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    slots = _slots(shortest_pack_first(histogram, capacity))
    names = pieces.columns
    salts = 16 + sum(histogram.values()) // RANKED
    dealt = pieces.withColumn("__salt", F.pmod(F.xxhash64(*(c for c in names)), F.lit(salts)))
    counts = dealt.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).drop("__n")
    order = [F.xxhash64(*names), *(c for c in ("doc_id", "start") if c in names)]  # a rank does not depend on when a row arrives
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1).join(before, ["length", "__salt"])
    ranked = ranked.select(*names, (F.col("__rank") + F.col("__before")).alias("__rank"))
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = {int(x): slice(*np.searchsorted(slots["length"], [x, x + 1])) for x in np.unique(slots["length"])}
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            row = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                part = by_length[int(x)]
                row[own] = part.start + np.searchsorted(slots["rank"][part], rank[own], "right") - 1
            inside = rank - slots["rank"][row]
            sequence = slots["sequence"][row] + inside % slots["packs"][row]
            offset = slots["offset"][row] + inside // slots["packs"][row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, placed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(checkpoint(token_pieces(docs, path, length, doc_id, text)), length)
