"""Event clocks as streams. The batch operators define the semantics; these are extensions for unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def energy_blocks(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling level blocks per series of a stream (series, ts, x), closed by the watermark."""
    blocks = events.withWatermark("ts", late).groupBy("series", F.window("ts", width))
    return blocks.agg(F.count(F.lit(1)).alias("n"), (20 * F.log10(F.greatest(F.sqrt(F.avg(F.col("x") * F.col("x"))), F.lit(1e-8)))).alias("rms_db")).select("series", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "rms_db")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a series without a gap."""
    runs = events.withWatermark("ts", late).groupBy("series", F.session_window("ts", gap))
    return runs.agg(F.count(F.lit(1)).alias("n")).select("series", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


PERIOD = "series string, seconds double, period double"


def track_period(events: DataFrame, keep: float = 0.65) -> DataFrame:
    """A smoothed period per series (series, seconds), updated by every event; the last time and period are the state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, period = state.get if state.exists else (None, None)
        out = []
        for t in sorted(t for pdf in batches for t in pdf["seconds"]):
            if last is not None and t > last:
                gap = t - last
                period = gap if period is None else keep * period + (1 - keep) * gap
                out.append((key[0], t, period))
            last = t if last is None else max(last, t)
        state.update((last, period))
        yield pd.DataFrame(out, columns=["series", "seconds", "period"])

    return events.groupBy("series").applyInPandasWithState(update, PERIOD, "last double, period double", "append", "NoTimeout")
