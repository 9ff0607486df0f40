"""Connected components of a graph of any size, by alternating large and small stars."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspan.llm.cluster import checkpoint

HEAVY, SMALL = 1000, 100_000


def join_heavy(rows: DataFrame, table: DataFrame, key: str, spread: Column, n: int) -> DataFrame:
    """rows (n of them, or fewer), left-joined to table, which has one row a key; no task gets all rows of a heavy key.

    Keys of more than one in HEAVY rows, of which there are fewer than HEAVY, are joined by broadcast, and their rows
    and those without a key are then dealt by `spread`, of the key's type. Up to SMALL rows, which one task could take
    as a whole, are joined plainly.
    """
    if n <= SMALL:
        return rows.join(table, key, "left").select(*rows.columns, *(c for c in table.columns if c != key))
    value = table.select(F.col(key).alias("__key"), F.struct(*(c for c in table.columns if c != key)).alias("__value"))
    heavy = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where(F.col("__n") * HEAVY > n)
    few = F.broadcast(value.join(F.broadcast(heavy.select("__key")), "__key").select(F.col("__key").alias(key), F.col("__value").alias("__few")))
    marked = rows.join(few, key, "left")
    plain = F.col("__few").isNull() & F.col(key).isNotNull()
    joined = marked.withColumns({"__plain": plain, "__key": F.when(plain, F.col(key)).otherwise(spread)}).join(value, "__key", "left")
    found = F.when(F.col("__plain"), F.col("__value")).otherwise(F.col("__few"))
    return joined.withColumn("__found", found).select(*rows.columns, "__found.*")


def _star(pairs: DataFrame, n: int) -> DataFrame:
    """(a, b), an edge for each end -> (a, b, least): the least of a and its neighbours, counted before the join."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return join_heavy(pairs, least, "a", F.col("b"), n)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it), for edges a, b of one orderable type.

    Loops and repeated edges change nothing, edges with a null end are left out, no edges give no rows.
    Each round is kept in shared storage; the number of rounds grows with the logarithm of the longest path.
    """
    known = checkpoint(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    forest, loops = known.where("a <> b"), known.where("a = b").select("a")
    before, n = None, known.count()
    while n:
        both = forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = large if n <= SMALL else checkpoint(large)
        small = _star(large, n)
        small = small.select(F.explode(F.array(F.struct("b", "least"), F.struct(F.col("a").alias("b"), "least"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.least").alias("b"))
        forest = checkpoint(small.where("a <> b").distinct())
        now = forest.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    own = forest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = forest.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    nodes = own.unionByName(roots)
    alone = loops.withColumnRenamed("a", "node").join(nodes.select("node"), "node", "left_anti")
    return nodes.unionByName(alone.withColumn("component", F.col("node")))
