"""Session windows, and late rows as an output of their own instead of rows that vanish."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap: str = "2 hours", lateness: str = "2 hours", key: str = "user_id") -> DataFrame:
    """(key, start, last, events, value): runs of a key's events that are less than the gap apart, for streams and tables.

    On a stream the state of a session goes once the watermark has passed it; spending is summed as a decimal, so
    that no order of merging shows.
    """
    marked = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = marked.filter(F.col(key).isNotNull()).groupBy(F.session_window("ts", gap).alias("w"), key)
    value = F.sum(F.col("value").cast("decimal(18,6)"))
    return grouped.agg(F.max("ts").alias("last"), F.count("*").alias("events"), value.alias("value")).select(key, F.col("w.start").alias("start"), "last", "events", "value")


def mark_late(events: DataFrame, lateness_s: float, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """events with late: whether a row is older than the latest its key had before this batch, less the lateness.

    Each row comes out once, in time or late, so the two outputs add up to the input. A key's state is one time; its rows
    pass in bounded batches. Rows without a key or a time are never late.
    """
    columns, schema = events.columns, events.schema.simpleString()[7:-1].replace(":", " ") + ", late boolean"
    keyed = events.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        latest = before
        for rows in batches:
            at = rows[ts].to_numpy().astype("datetime64[us]")
            timed = ~np.isnat(at) & rows[key].notna().to_numpy()
            at = at.astype("int64")
            late = timed & (at < before - lateness_s * 1e6) if before is not None else np.zeros(len(rows), bool)
            if timed.any():
                top = int(at[timed].max())
                latest = top if latest is None else max(latest, top)
            yield rows[columns].assign(late=late)
        if latest is not None:
            state.update((latest,))

    return keyed.groupBy("_key").applyInPandasWithState(step, schema, "latest bigint", "append", GroupStateTimeout.NoTimeout)
