"""Ingestion jobs: what a log of their events comes to, and which are to be tried again."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds to wait after the first, second and third failure; a job has as many tries.
BACKOFF = (30, 300, 1800)
_STATE = "struct<status: string, attempts: int, due: timestamp>"


def job_states(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, status, attempts, due`` from a job log (key, at, event: queued, started, done, failed).

    A job is pending when queued, processing when started, then completed or failed. It may be queued anew only when failed, which
    starts its tries afresh, and started again when failed for less than as many times as there are waits, after the wait; ``due`` is that time, null if there is none. Events that do
    not fit the state are passed over; those of one time count in the order of their names.
    """

    def step(s: Column, x: Column) -> Column:
        event, status, tries = x["event"], s["status"], s["attempts"]
        wait = F.element_at(F.array(*[F.lit(b) for b in BACKOFF]), F.greatest(tries, F.lit(1)))
        none = F.lit(None).cast("timestamp")
        to = lambda name, attempts, due: F.struct(F.lit(name).alias("status"), attempts.cast("int").alias("attempts"), due.alias("due"))
        again = (status == "failed") & s["due"].isNotNull() & (x["at"] >= s["due"])
        return (
            F.when((event == "queued") & status.isin("none", "failed"), to("pending", F.lit(0), none))
            .when((event == "started") & ((status == "pending") | again), to("processing", tries + 1, none))
            .when((event == "done") & (status == "processing"), to("completed", tries, none))
            .when((event == "failed") & (status == "processing"), to("failed", tries, F.when(tries < len(BACKOFF), F.timestamp_seconds(F.unix_micros(x["at"]) / 1_000_000 + wait))))
            .otherwise(s)
        )

    events = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("timestamp").alias("at"), "event"))).alias("events"))
    start = F.struct(F.lit("none").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("due")).cast(_STATE)
    return events.select(key, F.aggregate("events", start, lambda s, x: step(s, x).cast(_STATE)).alias("s")).select(key, "s.*")


def due_jobs(states: DataFrame, now: Column) -> DataFrame:
    """Failed jobs whose wait is over."""
    return states.where((F.col("status") == "failed") & (F.col("due") <= now))


def next_state(state: tuple[str, int, pd.Timestamp | None], at: pd.Timestamp, event: str) -> tuple[str, int, pd.Timestamp | None]:
    """The rule of ``job_states`` for one event."""
    status, attempts, due = state
    if event == "queued" and status in ("none", "failed"):
        return "pending", 0, None
    if event == "started" and (status == "pending" or status == "failed" and due is not None and at >= due):
        return "processing", attempts + 1, None
    if event == "done" and status == "processing":
        return "completed", attempts, None
    if event == "failed" and status == "processing":
        return "failed", attempts, at + timedelta(seconds=BACKOFF[attempts - 1]) if attempts < len(BACKOFF) else None
    return state


def job_stream(log: DataFrame, late: str = "1 minute", key: str = "doc_id") -> DataFrame:
    """The same over a stream of the log, with the state kept by key: a row for each job that changes, ``retry`` false and ``at`` its
    last event's time, and one with ``retry`` true when the watermark passes its ``due``. A late event counts when it comes.
    """
    kind = log.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, at timestamp, status string, attempts int, due timestamp, retry boolean"

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ("none", 0, None)
        now = (held[0], int(held[1]), pd.Timestamp(held[2]) if held[2] is not None and not pd.isna(held[2]) else None)
        row = lambda at, retry: pd.DataFrame({key: [keys[0]], "at": pd.to_datetime([at]), "status": [now[0]], "attempts": [now[1]], "due": pd.to_datetime([now[2]]), "retry": [retry]})
        if state.hasTimedOut:
            yield row(now[2], True)
            return
        rows = pd.concat(list(frames)).sort_values(["at", "event"], kind="stable")
        for at, event in zip(rows["at"], rows["event"], strict=True):
            now = next_state(now, at, event)
        state.update((now[0], now[1], now[2].to_pydatetime() if now[2] is not None else None))
        if now[2] is not None and now[2].timestamp() * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(now[2].timestamp() * 1000))
        elif now[2] is not None:
            yield row(now[2], True)
        yield row(rows["at"].iloc[-1], False)

    timed = log.select(key, F.col("at").cast("timestamp").alias("at"), "event").withWatermark("at", late)
    return timed.groupBy(key).applyInPandasWithState(run, schema, "status string, attempts int, due timestamp", "append", GroupStateTimeout.EventTimeTimeout)
