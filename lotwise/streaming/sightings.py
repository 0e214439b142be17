"""Observations and statuses as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_sightings(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """One row for each object and day; what comes later than `late` is not looked for again."""
    return stream.withColumns({ts: F.col(ts).cast("timestamp"), "seen_date": F.to_date(ts)}).withWatermark(ts, late).dropDuplicatesWithinWatermark([key, "seen_date"])


def activity(stream: DataFrame, ts: str, window: str, by: str, late: str = "1 day") -> DataFrame:
    """Observations by time window and kind."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def status_changes(stream: DataFrame, key: str, seq: str, status: str) -> DataFrame:
    """(key, seq, status) whenever an object's status differs from the one it had; a status seen again wakes a final one."""
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, now = state.get if state.exists else (-1, None)
        out = []
        for s, v in sorted((r for f in frames for r in zip(f[seq], f[status])), key=lambda r: r[0]):
            if s > at:
                if v != now:
                    out.append((group[0], s, v))
                at, now = s, v
        state.update((int(at), now))
        yield pd.DataFrame(out, columns=["key", "seq", "status"])

    rows = stream.select(key, F.col(seq).cast("long").alias(seq), status)
    return rows.groupBy(key).applyInPandasWithState(step, f"key {kind}, seq long, status string", "at long, now string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there now, in batches, each given to an idempotent sink."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
