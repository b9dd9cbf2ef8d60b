"""Connected components of an edge table by alternating large and small stars.

Each round keeps the components and moves edges towards the smallest id; minima are
pre-aggregated before the shuffle.  Rounds are cut by written tables, never by local
checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.scratch import drop, stage

MAX_ROUNDS = 60
#: Rows of a key from which on it is joined apart: this number, or one in HOT_SHARE of all rows if that is more.
HOT_ROWS, HOT_SHARE = 100, 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, a row for each key with the number ``c`` of its rows, without hot tasks.

    Keys with at least max(HOT_ROWS, n / HOT_SHARE) of the n rows are at most HOT_SHARE of them, so their part
    of the table is broadcast; no other key holds more than that share of the rows that are shuffled.  Where there
    is no such key, it is a plain join.  ``table`` is read twice: a staged one is best.
    """
    least = max(HOT_ROWS, -(-n // HOT_SHARE))
    if (table.agg(F.max("c")).first()[0] or 0) < least:
        return rows.join(table.drop("c"), key)
    hot = F.col("c") >= least
    few, rest = F.broadcast(table.where(hot).drop("c")), table.where(~hot).drop("c")
    cold = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(rest, key)
    return rows.join(few, key).unionByName(cold)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("c"))
    return spread_join(both.where("b > a"), least.where("c > 0"), "a", n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
    others = spread_join(edges, least.where("c > 1"), "a", n).where("b <> m")
    return others.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Roots themselves are listed too.  Nulls and loops are dropped; repeats don't matter.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = stage(tidy, "edges")
    state, seen = count(now), None
    for _ in range(MAX_ROUNDS):
        if state == seen or not state.n:
            break
        large = stage(_large_star(now, state.n).where("a <> b").distinct(), "stars")
        before, now = now, stage(_small_star(large, state.n).where("a <> b").distinct(), "edges")
        state, seen = count(now), state
        drop(before)
        drop(large)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
