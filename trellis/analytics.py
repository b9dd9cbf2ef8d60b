"""Times of queries: a log, its statistics, and what has become slower."""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "at timestamp, fingerprint string, query string, seconds double, failed boolean"


def fingerprint(query: str) -> str:
    """Equal for queries that differ in literals, case of keywords and white space only."""
    shape = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\b\d[\d_.]*(?:[eE][+-]?\d+)?\b", "?", query)
    return hashlib.sha256(re.sub(r"\s+", " ", shape).strip().lower().encode()).hexdigest()[:16]


@dataclass
class QueryLog:
    """The last ``size`` queries with their seconds."""

    size: int = 10_000
    rows: deque = field(default_factory=deque)

    def add(self, query: str, seconds: float, failed: bool = False, at: float | None = None) -> None:
        self.rows.append((float(time.time() if at is None else at), fingerprint(query), query, float(seconds), failed))
        while len(self.rows) > self.size:
            self.rows.popleft()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame([tuple(r) for r in self.rows], _SCHEMA.replace("at timestamp", "at double"))
        return rows.withColumn("at", F.timestamp_seconds("at"))


def latencies(log: DataFrame) -> DataFrame:
    """Per fingerprint: runs, failures, mean and exact percentiles of the seconds, share of all time."""
    shares = [F.expr(f"percentile(seconds, {p})").alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    out = log.groupBy("fingerprint").agg(F.min("query").alias("query"), F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"), F.avg("seconds").alias("mean"), *shares, F.sum("seconds").alias("total"))
    whole = log.agg(F.sum("seconds").alias("whole"))
    return out.join(F.broadcast(whole)).withColumn("share", F.col("total") / F.nullif("whole", F.lit(0.0))).drop("whole")


def trends(log: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Runs, mean and failures by time buckets."""
    grouped = log.groupBy(F.window("at", bucket).alias("w")).agg(F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean"), F.count_if("failed").alias("failures"))
    return grouped.select(F.col("w.start").alias("start"), "runs", "mean", "failures")


def slowest(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("seconds"), "at").limit(n)


def regressions(log: DataFrame, recent: int = 20, factor: float = 1.5, least_runs: int = 5) -> DataFrame:
    """Fingerprints whose last ``recent`` runs take ``factor`` times the mean of those before, with at least ``least_runs`` in each."""
    ranked = log.where("not failed").withColumn("back", F.expr("row_number() OVER (PARTITION BY fingerprint ORDER BY at DESC, seconds)"))
    now = F.col("back") <= recent
    out = ranked.groupBy("fingerprint").agg(
        F.min("query").alias("query"), F.count_if(now).alias("recent_runs"), F.count_if(~now).alias("earlier_runs"),
        F.avg(F.when(now, F.col("seconds"))).alias("recent_mean"), F.avg(F.when(~now, F.col("seconds"))).alias("earlier_mean"),
    )
    enough = (F.col("recent_runs") >= least_runs) & (F.col("earlier_runs") >= least_runs)
    return out.where(enough & (F.col("recent_mean") >= factor * F.col("earlier_mean"))).withColumn("factor", F.col("recent_mean") / F.col("earlier_mean"))
