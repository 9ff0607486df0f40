"""Shards of near equal bytes: the minimax cut of ordered atomic groups into contiguous runs.

Rows of equal text are one group and never part. Groups stand in the order of their text's digest, which mixes sources
and makes ranges of digests even. Groups above the mean shard take a shard each; the others are cut by the smallest
capacity with which greedy filling needs no more than the shards left, found by binary search.

The driver never sees the groups. It sees sums over ranges of digests, 4096 at first: a range is filled either as if it
could be cut anywhere (no smaller capacity can do) or not at all (that capacity surely does). Where the two differ, the
ranges in which a cut may fall are summed again at 256 times the resolution, until a range is one group. So the driver
holds thousands of sums at any size of the corpus, and the capacity is that of the single groups. Greedy filling leaves
what is short to the last shard, so within this capacity the cuts are then put next to the mean of what is left.
"""

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftspan.llm.cluster import checkpoint

LAW = "bytes"
DIGEST, FIRST, MORE = 32, 3, 2
CELLS = 1024


@dataclass(frozen=True)
class Cuts:
    """shard = the place in `alone`, or the number of `starts` up to the digest after these."""

    shards: int
    capacity: int
    alone: tuple[str, ...]
    starts: tuple[str, ...]

    def shard(self, digest: Column) -> Column:
        found = F.lit(len(self.alone))
        for s in self.starts:
            found = found + (digest >= s).cast("int")
        for i, d in enumerate(self.alone):
            found = F.when(digest == d, i).otherwise(found)
        return found.cast("int")


def _fill(ends: list[int], whole: list[bool], capacity: int, shards: int, divide: bool, at: int = 0) -> list[int] | None:
    """Greedy starts of the shards after the first, from byte `at`; None if they don't hold all. Ranges that are not one
    group are cut anywhere if divide, else nowhere."""
    starts = []
    while at + capacity < ends[-1]:
        if len(starts) == shards - 1:
            return None
        i = bisect_right(ends, at + capacity) - 1
        at = at + capacity if divide and not whole[i] else ends[i]
        starts.append(at)
    return starts


def _least(ends: list[int], whole: list[bool], shards: int, divide: bool) -> int:
    low, high = 0, ends[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _fill(ends, whole, middle, shards, divide) is not None else (middle + 1, high)
    return low


def _even(ends: list[int], whole: list[bool], capacity: int, shards: int) -> list[int]:
    """Starts of the shards after the first: each shard ends at the end of a range next to the mean of what is left, or
    after it where the others could not hold the rest."""
    at, starts = 0, []
    for left in range(shards - 1, 0, -1):
        now, last = bisect_right(ends, at) - 1, bisect_right(ends, at + capacity) - 1
        mean = at + (ends[-1] - at) // (left + 1)
        i = bisect_right(ends, mean) - 1
        i = min(last, max(now + 1, i + (i + 1 < len(ends) and ends[i + 1] - mean < mean - ends[i])))
        while i < last and _fill(ends, whole, capacity, left, False, ends[i]) is None:
            i += 1
        if ends[i] == ends[-1]:
            break
        at = ends[i]
        starts.append(at)
    return starts


def _doubtful(cells: list[tuple[str, int, int]], ends: list[int], whole: list[bool], low: int, high: int, shards: int) -> list[str]:
    """The ranges of several groups in which a cut falls for some capacity from low to high."""
    cautious, hopeful, found, at, reach = 0, 0, set(), 0, 0
    for _ in range(shards - 1):
        at, reach = ends[bisect_right(ends, at + low) - 1], reach + high
        if at >= ends[-1]:
            break
        i = bisect_right(ends, min(reach, ends[-1] - 1)) - 1
        reach = reach if not whole[i] else ends[i]
        cautious, hopeful = bisect_right(ends, at) - 1, i
        found.update(c[0] for c, w in zip(cells[cautious : hopeful + 1], whole[cautious : hopeful + 1], strict=True) if not w)
    return sorted(found)


def cut_groups(groups: DataFrame, shards: int) -> Cuts:
    """The cut of groups (digest: lower-case hex of DIGEST digits, bytes above 0), a row a group. No rows give no starts."""
    if shards < 1:
        raise ValueError("at least one shard")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left = [], shards
    for row in groups.orderBy(F.col("bytes").desc(), "digest").select("digest", "bytes").limit(shards).collect():
        if row.bytes * left <= total:
            break
        alone.append(row)
        total, left = total - row.bytes, left - 1
    own = tuple(r.digest for r in alone)
    largest = max((r.bytes for r in alone), default=0)
    if not total:
        return Cuts(shards, largest, own, ())
    rest = groups.where(~F.col("digest").isin(*own)) if own else groups

    def sums(rows: DataFrame, width: int) -> dict[str, tuple[str, int, int]]:
        key = F.substring("digest", 1, width).alias("p")
        return {r.p: tuple(r) for r in rows.groupBy(key).agg(F.sum("bytes"), F.count("*")).collect()}

    found = sums(rest, FIRST)
    while True:
        cells = [found[p] for p in sorted(found)]
        ends, whole = [0, *accumulate(c[1] for c in cells)], [c[2] == 1 for c in cells]
        low, high = _least(ends, whole, left, True), _least(ends, whole, left, False)
        doubtful = _doubtful(cells, ends, whole, low, high, left)
        if not doubtful:
            starts = _even(ends, whole, high, left)
            return Cuts(shards, max(largest, high), own, tuple(cells[ends.index(s)][0] for s in starts))
        for width in {len(p) for p in doubtful}:
            chosen = [p for p in doubtful if len(p) == width]
            for p in chosen:
                del found[p]
            found |= sums(rest.where(F.substring("digest", 1, width).isin(*chosen)), width + MORE)


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.substring(F.sha2(whole, 256), 1, DIGEST).alias("digest"), F.monotonically_increasing_id().alias("row"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    return checkpoint(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))


def cut_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> Cuts:
    """The cut of docs by the bytes of their texts, one more a row."""
    return cut_groups(_groups(_measured(docs, doc_id, text)), shards)


def place_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and one more), text_crc32, digest, shard (from 0), slot (in the shard, gapless from 0).

    A null text is an empty one. Rows of equal text share a shard, also if their ids are equal or null: each row has a slot
    of its own. A shard may stay empty, as all do without rows. Slots follow hashed cells of the ids, numbered beside each
    other, so no task numbers a whole shard or a whole group; rows without id are dealt by their place in the input.
    """
    rows = checkpoint(_measured(docs, doc_id, text))
    cuts = cut_groups(_groups(rows), shards)
    spread = F.xxhash64("digest", "doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))
    placed = rows.withColumns({"shard": cuts.shard(F.col("digest")), "cell": F.pmod(spread, F.lit(cells)).cast("int")})
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # at most shards * cells rows
    number = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "digest", "row"))
    numbered = placed.withColumn("number", number).join(F.broadcast(starts), ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("number") - 1).alias("slot"))


def shard_report(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law says nothing of one more shard)."""
    placed = place_documents(docs, shards, doc_id, text)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int, text: str = "text", doc_id: str = "doc_id", parts: int | None = None) -> Cuts:
    """Writes all rows and columns of docs as Parquet, a folder shard=N in `folder` for each shard that has rows.

    Rows are dealt to files by hash of text, id and place, so that many tasks write a shard, or a group, of any size. A
    column of docs named shard is not written: the folder's name takes its place. The folder must not exist yet.
    """
    cuts = cut_documents(docs, shards, doc_id, text)
    digest = F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), 1, DIGEST)
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = F.lit(max(1, n // shards))
    marked = docs.withColumns({"shard": cuts.shard(digest), "__cell": F.pmod(F.xxhash64(text, doc_id, F.monotonically_increasing_id()), per)})
    marked.repartition(n, "shard", "__cell").drop("__cell").write.partitionBy("shard").parquet(folder)
    return cuts
