"""Short codes of vectors: a codebook for each part of the dimensions, fitted by Lloyd rounds over all vectors.

Vectors become integers first, so all sums are exact and the order in which tasks add up changes nothing. Every round
keeps each vector's codes, and the count and sum of every codebook entry, in the shared folder. The next round shuffles
only what differs: a part that moves from one entry to another takes its integers off the one and adds them to the
other; a task adds these up first and sends at most a row for each entry and position. Codebooks have entries * width
integers and go to the tasks with the function.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspan.llm.cluster import checkpoint
from driftspan.llm.components import join_heavy

SCALE = 256
FEW_LABELS = 100_000


@dataclass(frozen=True)
class Codebooks:
    """books[p][e] is entry e of part p; the parts follow each other along the dimensions."""

    books: tuple[np.ndarray, ...]

    @property
    def edges(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    @property
    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()

    def moved(self, counts: dict[tuple[int, int], int], sums: dict[tuple[int, int, int], int]) -> "Codebooks":
        """Each used entry becomes the floor of its mean."""
        new = [b.copy() for b in self.books]
        for (p, e), n in counts.items():
            if n:
                new[p][e] = [sums.get((p, e, i), 0) // n for i in range(new[p].shape[1])]
        return Codebooks(tuple(new))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of part; of equally near entries the first."""
    most = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if part.shape[1] * 4 * most * most < 1 << 53 else np.int64  # both exact
    x, c = part.astype(kind), book.astype(kind)
    far = (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    best = far.argmin(1)
    return best, (far[np.arange(len(x)), best] + (x * x).sum(1)).astype(np.int64)


def _assign(codebooks: Codebooks, round_: bool):
    """Adds codes and error; in a round, the codes there were are kept as `before`."""
    edges = codebooks.edges

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = _matrix(batch.column("ints"), int(edges[-1]))
            codes, error = np.zeros((len(ints), len(edges) - 1), np.uint8), np.zeros(len(ints), np.int64)
            for p, book in enumerate(codebooks.books):
                codes[:, p], far = _nearest(ints[:, edges[p] : edges[p + 1]], book)
                error += far
            told = pa.array([c.tobytes() for c in codes], pa.binary())
            if round_:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "ints")), batch.column("codes"), told], ["vec_id", "label", "ints", "before", "codes"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), told, pa.array(error)], ["vec_id", "label", "codes", "error"])

    return assign


def _contributions(codebooks: Codebooks):
    """part, entry, place (-1: the count), amount: plus and minus of the parts that changed their entry, added up by task."""
    edges = codebooks.edges

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in codebooks.books]
        for batch in batches:
            ints = _matrix(batch.column("ints"), int(edges[-1]))
            n = len(edges) - 1
            new = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(ints), n)
            known = batch.column("before").is_valid().to_numpy(zero_copy_only=False)
            old = np.frombuffer(b"".join(x or bytes(n) for x in batch.column("before").to_pylist()), np.uint8).reshape(len(ints), n)
            for p, sums in enumerate(total):
                changed = ~known | (old[:, p] != new[:, p])
                mine = np.column_stack([ints[:, edges[p] : edges[p + 1]], np.ones(len(ints), np.int64)]).astype(np.int64)
                np.add.at(sums, new[changed, p], mine[changed])
                np.subtract.at(sums, old[changed & known, p], mine[changed & known])
        for p, sums in enumerate(total):
            entry, place = np.nonzero(sums)
            shown = np.where(place == sums.shape[1] - 1, -1, place)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(shown.astype(np.int32)), pa.array(sums[entry, place])], ["part", "entry", "place", "amount"])

    return add


def _integers(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, ints: the rows whose vector is finite throughout."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & finite).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    bound = F.expr("shiftleft(1L, int((60 - length(bin(size(v)))) / 2))")  # squared distances stay below 2**62
    return kept.select("vec_id", "label", F.transform("v", lambda x: F.greatest(-bound, F.least(bound, F.floor(x.cast("double") * SCALE)))).cast("array<int>").alias("ints"))


def fit_codes(ints: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[Codebooks, DataFrame]:
    """The codebooks after `rounds`, and vec_id, label, ints, before, codes as assigned in the last of them.

    ints (vec_id, label, ints) is read more than once: keep it as a table. The first entries are the parts of the vectors
    of the smallest ids (of equal ids, the smallest vectors; null ids come last); with fewer vectors there are fewer
    entries. Vectors of another length than the first are left out. An entry that no part uses stays.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("parts of 1 to 256 entries")
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints").asc()]
    head = ints.orderBy(*order).select("ints").first()
    width = len(head[0]) if head else 0
    same = ints.where(F.size("ints") == width)
    first = [r[0] for r in same.orderBy(*order).select("ints").limit(entries).collect()]
    seeds = np.array(first, np.int64).reshape(len(first), width)
    edges = [i * width // parts for i in range(parts + 1)]
    books = Codebooks(tuple(seeds[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)))
    kinds = {c: ints.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, ints array<int>, before binary, codes binary"
    state, running = same.withColumns({"before": F.lit(None).cast("binary"), "codes": F.lit(None).cast("binary")}), None
    for _ in range(rounds if len(seeds) else 0):
        state = checkpoint(state.drop("before").mapInArrow(_assign(books, True), schema))
        delta = state.where("before is null or before <> codes").mapInArrow(_contributions(books), "part int, entry int, place int, amount long")
        added = delta if running is None else running.unionByName(delta)
        running = checkpoint(added.groupBy("part", "entry", "place").agg(F.sum("amount").alias("amount")))
        known = {(r.part, r.entry, r.place): r.amount for r in running.collect()}  # at most parts * entries * (width + 1)
        books = books.moved({k[:2]: n for k, n in known.items() if k[2] < 0}, {k: n for k, n in known.items() if k[2] >= 0})
    return books, state


def encode(state: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, codes (a byte a part) and error (squared distance) of vectors (vec_id, label, ints) of the codebooks' length."""
    kinds = {c: state.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return state.mapInArrow(_assign(codebooks, False), f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long")


def decode(coded: DataFrame, codebooks: Codebooks) -> DataFrame:
    """coded and `vector`: the entries that its codes name, in the input's units (array<double>)."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(batch), -1)
            whole = np.hstack([b[codes[:, p]] for p, b in enumerate(codebooks.books)]) / SCALE
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * whole.shape[1]), pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(look_up, f"{fields}, vector array<double>")


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """coded and label_error; null labels count as one label."""
    totals = checkpoint(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")))
    totals = totals.select("label", F.least("sum", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    if totals.count() <= FEW_LABELS:
        right = F.broadcast(totals.withColumnRenamed("label", "__label"))
        return coded.join(right, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("__key")
    spread = F.concat(F.lit("-"), F.hex(F.xxhash64("codes", "vec_id")))
    return join_heavy(coded.select("*", key), totals.select(key, "label_error"), "__key", spread, coded.count()).drop("__key")


def code_report(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256: a row for each row with a usable vector.

    Rows whose vector is null or holds a null or a component that is not finite are left out. Rows of equal or null ids are
    vectors of their own; null labels are one label. A vector of another length than that of the smallest id has no code
    and no error. Scaled components beyond a bound (2**26 for 64 dimensions) count as the bound, so that all sums fit 64 bits.
    No rows give no rows.
    """
    ints = checkpoint(_integers(rows, vec_id, vector, label))
    books, state = fit_codes(ints, parts, entries, rounds)
    coded = encode(state.select("vec_id", "label", "ints"), books)
    other = ints.where(F.size("ints") != int(books.edges[-1])).select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error"))
    whole = _with_label_errors(checkpoint(coded.unionByName(other)))
    return whole.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
