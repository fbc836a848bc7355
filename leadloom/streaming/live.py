"""Streaming forms of the incremental jobs: live ingest, windowed ledger, circuit breaker, duplicate removal."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadloom.storage import shared_path

#: Breaker limits.
FAILURES, WINDOW_S, COOLDOWN_S, TIMEOUT_WEIGHT = 5.0, 60.0, 120.0, 0.5
#: Groups into which users are dealt, as each call of Python costs more than a user's events.
BUCKETS = 1024


def event_stream(spark: SparkSession, path: str, schema: Any, files_per_trigger: int | None = 1) -> DataFrame:
    """A growing folder (or one file's folder) of Parquet as a stream; without a number, a batch is all that is new.

    Files that were written side by side have no order in time: in batches of one file each, rows of the later ones are late
    by chance. A table that is there at once is therefore one batch.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_ledger(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, provider, calls, errors, cost): tumbling windows under a watermark; later rows are left out."""
    w = F.window("ts", width)
    grouped = events.withWatermark("ts", lateness).groupBy(w.alias("w"), F.col("event_type").alias("provider"))
    return grouped.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("cost")).select(F.col("w.start").alias("start"), "provider", "calls", "errors", "cost")


def unique_events(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def breaker_step(state: tuple[list[float], float], at: float, failed: bool, timeout: bool) -> tuple[tuple[list[float], float], bool]:
    """((times of weighted half failures, open until), let through) after a call at a time in seconds."""
    halves, until = state
    if at < until:
        return (halves, until), False
    halves = [t for t in halves if at - t < WINDOW_S]
    if failed:
        halves = halves + [at] * (1 if timeout else 2)
        if len(halves) * TIMEOUT_WEIGHT >= FAILURES:
            return ([], at + COOLDOWN_S), True
    return (halves, until), True


def breaker(events: DataFrame, lateness: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, calls, rejected) of each batch: a breaker for each user, whose state is bounded by its window.

    Users are grouped into buckets by a hash, so that Python is called for each bucket, not for each user.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        parts = [tuple(rows[c].to_numpy() for c in ("user_id", "ts", "event_id", "value")) for rows in batches]
        users, ts, ids, values = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, ts, users))
        users, values, at = users[order], values[order].tolist(), (ts[order].astype("datetime64[ns]").astype("int64") / 1e9).tolist()
        first = np.flatnonzero(np.append(True, users[1:] != users[:-1]))
        names, rejected = users[first], []
        for user, lo, hi in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
            halves, until = held.get(str(user), ([], 0.0))
            own, shut = (halves, until), 0
            for k in range(lo, hi):
                own, through = breaker_step(own, at[k], values[k] < 20, values[k] < 5)
                shut += not through
            held[str(user)] = own
            rejected.append(shut)
        state.update((json.dumps(held),))
        yield pd.DataFrame({"user_id": names, "calls": np.diff(np.append(first, len(at))), "rejected": rejected})

    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")
    stamped = events.filter("user_id is not null").select(bucket, "user_id", "ts", "event_id", "value")
    return stamped.groupBy("bucket").applyInPandasWithState(step, "user_id bigint, calls bigint, rejected bigint", "held string", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, out: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table; with the folder of an earlier run, goes on from there."""
    spark = stream.sparkSession
    out = out or shared_path(spark, name)
    mark = f"{out}-progress"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # a batch that runs again replaces itself

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def live_upsert(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key after all batches, by foreachBatch."""
    spark = stream.sparkSession
    out = shared_path(spark, "live")

    def merge(batch: DataFrame, n: int) -> None:
        parts = batch if n == 0 else batch.unionByName(spark.read.parquet(f"{out}/v={n - 1}").select(*batch.columns))
        latest = parts.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{out}/v={n}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", shared_path(spark, "live-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{out}/v={last}")
