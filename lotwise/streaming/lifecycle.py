"""The life of an object by the gaps between its observations, with timers for what is not seen again."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# fixed values: days without an observation until an object is looked up, and until nobody waits for it
STALE, FINAL = timedelta(days=2), timedelta(days=7)


def lifecycle(stream: DataFrame, key: str, ts: str, stale: timedelta = STALE, final: timedelta = FINAL, late: str = "1 hour") -> DataFrame:
    """(key, at, status): 'seen' when an object appears or comes back, 'stale' and 'final' when it has not been seen for so long.

    A gap between two observations tells both by itself; for the last one a
    timer of the watermark does.  An object's state is its last observation and
    whether it is stale; once it is final the state is dropped, so what is kept
    is bounded by the objects of the last `final` days.  Observations before
    the last one of their object, and those without a key or a time, are passed
    over.
    """
    first, second = (int(x.total_seconds() * 1000) for x in (stale, final))

    def out(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"key": [r[0] for r in rows], "at": pd.to_datetime([r[1] for r in rows], unit="ms", utc=True).tz_localize(None), "status": [r[2] for r in rows]})

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, rows = group[0], []
        last, is_stale = state.get if state.exists else (None, False)
        if not state.hasTimedOut:
            for t in sorted(x for f in frames for x in f["ms"].tolist()):
                if last is not None and t <= last:
                    continue
                gap = t - last if last is not None else None
                if gap is not None and gap > first and not is_stale:
                    rows.append((k, last + first, "stale"))
                if gap is not None and gap > second:
                    rows.append((k, last + second, "final"))
                if gap is None or is_stale or gap > first:
                    rows.append((k, t, "seen"))
                last, is_stale = t, False
        now = state.getCurrentWatermarkMs()
        if last + first < now and not is_stale:
            rows.append((k, last + first, "stale"))
            is_stale = True
        if last + second < now:
            rows.append((k, last + second, "final"))
            if state.exists:
                state.remove()
        else:
            state.update((int(last), bool(is_stale)))
            state.setTimeoutTimestamp(max(last + (second if is_stale else first), now) + 1)
        yield out(rows)

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null")
    rows = rows.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at timestamp, status string", "last long, is_stale boolean", "append", GroupStateTimeout.EventTimeTimeout)


def lifecycle_batch(df: DataFrame, key: str, ts: str, until: int, stale: timedelta = STALE, final: timedelta = FINAL) -> DataFrame:
    """The same of a whole table, for a clock that stands at `until` (milliseconds)."""
    first, second = (int(x.total_seconds() * 1000) for x in (stale, final))
    rows = df.select(F.col(key).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")).where("key is not null and ms is not null").distinct()
    w = Window.partitionBy("key").orderBy("ms")
    rows = rows.withColumns({"gap": F.col("ms") - F.lag("ms").over(w), "next": F.lead("ms").over(w)})
    ends = F.when(F.col("next").isNull(), until).otherwise(F.col("next"))
    marks = [F.when(F.col("gap").isNull() | (F.col("gap") > first), F.struct(F.col("ms").alias("at"), F.lit("seen").alias("status")))]
    marks += [F.when(ends - F.col("ms") > wait, F.struct((F.col("ms") + wait).alias("at"), F.lit(name).alias("status"))) for wait, name in ((first, "stale"), (second, "final"))]
    found = rows.select("key", F.explode(F.array_compact(F.array(*marks))).alias("m"))
    return found.select("key", F.timestamp_millis("m.at").alias("at"), "m.status")
