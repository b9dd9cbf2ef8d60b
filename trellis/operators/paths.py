"""Traversals of edge tables: hops of variable length and shortest paths.

Edges come as (s, t).  Results are (start, end, hops): one row for each pair that is
reachable in that number of hops, however many paths there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.storage import shared_dir

#: Hops after which an unbounded pattern stops.
MAX_HOPS = 20
#: Hops whose plan is kept in one piece; longer ones are cut by a written table.
CUT_EVERY = 4


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it survives lost executors and fixes what was not deterministic."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def expand(starts: DataFrame, edges: DataFrame, least: int, most: int | None) -> DataFrame:
    """From each ``start``, the ends at least..most hops away; repeats of (start, end) in a hop are dropped before the next."""
    spark = starts.sparkSession
    edges = edges.select("s", "t")
    frontier = starts.select("start", F.col("start").alias("end")).distinct()
    found = [frontier.withColumn("hops", F.lit(0))] if least == 0 else []
    top = MAX_HOPS if most is None else most
    for hop in range(1, top + 1):
        frontier = frontier.join(edges, F.col("end") == F.col("s")).select("start", F.col("t").alias("end")).distinct()
        if hop % CUT_EVERY == 0 and hop < top:
            frontier = _cut(frontier)
            if frontier.isEmpty():
                break
        if hop >= least:
            found.append(frontier.withColumn("hops", F.lit(hop)))
    if not found:
        return spark.createDataFrame([], starts.select("start", F.col("start").alias("end"), F.lit(0).alias("hops")).schema)
    return reduce(DataFrame.unionAll, found)


def shortest(starts: DataFrame, edges: DataFrame, least: int, most: int | None) -> DataFrame:
    """From each ``start``, every end with the least number of hops to it within least..most."""
    edges = edges.select("s", "t")
    frontier = starts.select("start", F.col("start").alias("end")).distinct()
    reached = frontier.withColumn("hops", F.lit(0)).where(F.lit(least == 0))
    for hop in range(1, (MAX_HOPS if most is None else most) + 1):
        step = frontier.join(edges, F.col("end") == F.col("s")).select("start", F.col("t").alias("end")).distinct()
        if hop < least:
            frontier = step
            continue
        frontier = _cut(step.join(reached.select("start", "end"), ["start", "end"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionAll(frontier.withColumn("hops", F.lit(hop)))
    return reached
