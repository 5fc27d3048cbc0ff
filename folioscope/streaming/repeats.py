"""The repeat detector on a stream of searches, with the results of the batch one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "event_id long, session string, top string, ts timestamp, repeat boolean"
STATE = "last double"


def repeats(events: DataFrame, within: int = 120, late: str = "10 minutes") -> DataFrame:
    """Streamed events (event_id, ts timestamp, session, top) with ``repeat``.

    One state for each session and top result: the time of the last search.  It goes once the watermark has passed it by
    the window, so the state grows with what is active.  Events must come in order within what the watermark allows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        flags = []
        for t in rows["ts"].map(lambda x: x.timestamp()):
            flags.append(last is not None and t - last <= within)
            last = t
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + within + 1) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "session": key[0], "top": key[1], "ts": rows["ts"], "repeat": flags})

    known = events.where(F.col("top").isNotNull()).withWatermark("ts", late)
    return known.groupBy(F.coalesce(F.col("session").cast("string"), F.lit("")).alias("session"), F.col("top")).applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and misses by window of event time and event, late rows dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")
