"""Event-time windows over streams and tables: tumbling, sliding and session.

Each function works on a streaming or a static DataFrame with a timestamp column; on a
stream a watermark bounds the state and drops late rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LATENESS = "5 seconds"


def watermarked(df: DataFrame, time_col: str = "event_time", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    return df.withWatermark(time_col, lateness) if df.isStreaming else df


def deduplicated(df: DataFrame, keys: list[str], time_col: str = "event_time", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """The first row of each key; on a stream, keys are remembered as long as the watermark allows."""
    if df.isStreaming:
        return watermarked(df, time_col, lateness).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def punctuated(df: DataFrame, kind_col: str = "record_type", kind: str = "WATERMARK", time_col: str = "event_time", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Explicit watermark records: rows of that kind advance the watermark by their time and are no data themselves."""
    return watermarked(df, time_col, lateness).where(F.col(kind_col).isNull() | (F.col(kind_col) != kind))


def records(df: DataFrame, window: Column, time_col: str = "event_time", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Whole window records: ``__window_start__``, ``__window_end__``, ``__window_count__`` and the rows as ``__window_records__``."""
    rows = F.collect_list(F.struct(*[F.col(c) for c in df.columns]))
    out = watermarked(df, time_col, lateness).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("__window_count__"), rows.alias("__window_records__"))
    return out.select(F.col("w.start").alias("__window_start__"), F.col("w.end").alias("__window_end__"), "__window_count__", "__window_records__")


def metrics(query) -> dict[str, float]:
    """Of a running or ended streaming query: rows read, rows dropped as late, state rows, rows a second, batches."""
    progress = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    state = [s for p in progress for s in p.get("stateOperators", [])]
    return {
        "batches": len(progress),
        "processed": sum(p.get("numInputRows", 0) for p in progress),
        "late": sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
        "state_rows": sum(s.get("numRowsTotal", 0) for s in (progress[-1].get("stateOperators", []) if progress else [])),
        "rows_per_second": progress[-1].get("processedRowsPerSecond", 0.0) if progress else 0.0,
    }


def _windowed(df: DataFrame, window: Column, keys: list[str], aggregates: dict[str, Column] | None, time_col: str, lateness: str) -> DataFrame:
    aggs = [c.alias(n) for n, c in (aggregates or {}).items()]
    grouped = watermarked(df, time_col, lateness).groupBy(window.alias("w"), *keys)
    out = grouped.agg(F.count(F.lit(1)).alias("window_count"), *aggs)
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "window_count", *(aggregates or {}))


def tumbling(df: DataFrame, size: str, keys: list[str] = (), aggregates: dict[str, Column] | None = None, time_col: str = "event_time", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    return _windowed(df, F.window(time_col, size), list(keys), aggregates, time_col, lateness)


def sliding(df: DataFrame, size: str, slide: str, keys: list[str] = (), aggregates: dict[str, Column] | None = None, time_col: str = "event_time", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """All windows that contain a row's time."""
    return _windowed(df, F.window(time_col, size, slide), list(keys), aggregates, time_col, lateness)


def session(df: DataFrame, gap: str, keys: list[str] = (), aggregates: dict[str, Column] | None = None, time_col: str = "event_time", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Rows less than ``gap`` apart, or touching, share a session."""
    return _windowed(df, F.session_window(time_col, gap), list(keys), aggregates, time_col, lateness)
