"""Run monitoring over a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def failure_windows(calls: DataFrame, width: str = "5 minutes", late: str = "10 minutes", share: float = 0.5, least: int = 20) -> DataFrame:
    """run_id, start, calls, failed, warn for each window of a run's calls, once it can't change any more.

    Calls later than ``late`` behind the newest are dropped by the watermark;
    the same function runs on a batch.
    """
    windows = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("run_id", F.window("ts", width)).agg(F.count("*").alias("calls"), F.count_if("failed").alias("failed"))
    return windows.select("run_id", F.col("window.start").alias("start"), "calls", "failed", ((F.col("calls") >= least) & (F.col("failed") > share * F.col("calls"))).alias("warn"))


class Outcomes:
    """What a run's last calls were, and whether the next ones are a breach: failures in a row, or over a share of a window."""

    def __init__(self, in_a_row: int, window: int, share: float, recent: np.ndarray | None = None):
        self.in_a_row, self.window, self.share = in_a_row, window, share
        self.recent = np.zeros(0, bool) if recent is None else recent

    def add(self, failed: np.ndarray) -> tuple[int, str] | None:
        """Takes calls in their order; the place and reason of the first that is a breach."""
        old = len(self.recent)
        seen = np.concatenate([self.recent, failed])
        self.recent = seen[-max(self.window, self.in_a_row) :]
        fails = np.concatenate([[0], np.cumsum(seen)])
        at = np.arange(old, len(seen)) + 1
        streak = (at >= self.in_a_row) & (fails[at] - fails[np.maximum(at - self.in_a_row, 0)] == self.in_a_row)
        many = (at >= self.window) & (fails[at] - fails[np.maximum(at - self.window, 0)] > self.share * self.window)
        hit = np.flatnonzero(streak | many)
        return (int(hit[0]), "consecutive" if streak[hit[0]] else "share") if len(hit) else None


_CALL = np.dtype([("ts", "i8"), ("call_id", "i8"), ("failed", "?")])
_STATE = "ts long, call_id long, recent binary, waiting binary, breached boolean"


def online_breaches(calls: DataFrame, in_a_row: int = 20, window: int = 100, share: float = 0.5, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """run_id, call_id, ts, reason: each run's first breach, as soon as no earlier call can come any more.

    calls is a stream of run_id, call_id (long), ts, failed.  A call waits in its
    run's state until the watermark, ``late`` behind the newest call of all runs,
    has passed it, so calls are judged in the order of (ts, call_id) however they
    arrive: the breaches are those of :func:`panelspark.operators.monitor.first_breach`.
    A call that comes twice counts once; one that comes after later ones were
    judged is too late and left out; one whose outcome is null only moves the
    watermark.  A run's state holds its last calls and those that wait; calls
    after the breach are ignored.  After ``idle`` without a call the state goes,
    and a run that goes on after that starts anew.
    """
    idle_us = int(pd.Timedelta(idle) / pd.Timedelta(1, "us"))

    def judge(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            mark_ts, mark_id, recent, waiting, breached = state.get
            mark, wait = (mark_ts, mark_id), np.frombuffer(waiting, _CALL)
        else:
            mark, recent, wait, breached = (-(1 << 63), 0), b"", np.zeros(0, _CALL), False
        newest = mark[0]
        parts = [wait]
        if not state.hasTimedOut:
            for pdf in chunks:
                ts = pdf["ts"].to_numpy().astype("datetime64[us]").astype("i8")
                newest = max(newest, int(ts.max()))
                real = pdf["failed"].notna().to_numpy()
                rows = np.zeros(int(real.sum()), _CALL)
                rows["ts"], rows["call_id"], rows["failed"] = ts[real], pdf["call_id"].to_numpy()[real].astype("i8"), pdf["failed"].to_numpy()[real].astype(bool)
                parts.append(rows[(rows["ts"] > mark[0]) | ((rows["ts"] == mark[0]) & (rows["call_id"] > mark[1]))])
        passed = state.getCurrentWatermarkMs() * 1000
        wait = np.concatenate(parts)
        wait = wait[np.lexsort((wait["call_id"], wait["ts"]))]
        wait = wait[np.append(True, (np.diff(wait["ts"]) != 0) | (np.diff(wait["call_id"]) != 0))[: len(wait)]]
        due = int(np.searchsorted(wait["ts"], passed, "right"))
        now, wait = wait[:due], wait[due:]
        outcomes = Outcomes(in_a_row, window, share, np.frombuffer(recent, bool))
        rests = np.flatnonzero(np.diff(now["ts"], prepend=mark[0] if state.exists else now["ts"][:1]) > idle_us)
        for k, some in enumerate(np.split(now, rests)):
            if k:  # the run has been idle before these
                breached, outcomes = False, Outcomes(in_a_row, window, share)
            if not breached and (hit := outcomes.add(some["failed"])):
                breached, at = True, hit[0]
                yield pd.DataFrame({"run_id": [key[0]], "call_id": [int(some["call_id"][at])], "ts": [pd.Timestamp(int(some["ts"][at]), unit="us")], "reason": [hit[1]]})
        if len(now):
            mark = int(now["ts"][-1]), int(now["call_id"][-1])
        until = max(newest, mark[0]) + idle_us
        if not len(wait) and passed >= until:
            state.remove()
            return
        state.update((*mark, outcomes.recent.tobytes(), wait.tobytes(), breached))
        wake = int(wait["ts"][0]) if len(wait) else until
        state.setTimeoutTimestamp(max(-(-wake // 1000), state.getCurrentWatermarkMs() + 1))

    kind = calls.schema["run_id"].dataType.simpleString()
    timely = calls.select("run_id", F.col("call_id").cast("long").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), "failed").withWatermark("ts", late)
    return timely.groupBy("run_id").applyInPandasWithState(judge, f"run_id {kind}, call_id long, ts timestamp, reason string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
