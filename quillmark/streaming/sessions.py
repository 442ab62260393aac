"""An extension: runs of flagged events in time, the streaming counterpart of runs of flagged sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagged_sessions(events: DataFrame, flag: str, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", at: str = "ts") -> DataFrame:
    """key, start, end and number of the runs of events that pass `flag` (SQL), no two further apart than `gap`.

    Works on streams and on tables. State is one open session a key; events later than `late` are left out of a stream.
    """
    rows = events.where(F.expr(flag))
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
