"""The online failure detector against the batch one, on the same calls in many orders of arrival."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from panelspark.operators.monitor import first_breach
from panelspark.streaming.monitor import Outcomes, online_breaches

SCHEMA = "run_id string, call_id long, ts timestamp, failed boolean"
START = datetime(2024, 3, 1)


def plain_breach(failed, in_a_row, window, share):
    """Call by call, as the rule reads."""
    recent, streak = [], 0
    for i, f in enumerate(failed):
        streak = streak + 1 if f else 0
        recent = [*recent, f][-window:]
        if streak >= in_a_row:
            return i, "consecutive"
        if len(recent) >= window and sum(recent) > share * window:
            return i, "share"
    return None


@pytest.mark.parametrize(("in_a_row", "window", "share"), [(4, 10, 0.4), (3, 2, 0.5), (20, 100, 0.5), (1, 1, 0.0)])
def test_outcomes_equal_the_rule(in_a_row, window, share):
    rnd = np.random.default_rng(in_a_row)
    for rate in (0.05, 0.3, 0.5, 0.9):
        for _ in range(60):
            failed = rnd.random(rnd.integers(0, 200)) < rate
            found, at, outcomes = None, 0, Outcomes(in_a_row, window, share)
            for part in np.array_split(failed, rnd.integers(1, 8)):
                hit = outcomes.add(part)
                if hit and found is None:
                    found = at + hit[0], hit[1]
                at += len(part)
            assert found == plain_breach(failed.tolist(), in_a_row, window, share)


def calls_of(seed, runs=6, n=240):
    """Runs with quiet and bad stretches; some calls share a time."""
    rnd = random.Random(seed)
    out, number = [], 0
    for r in range(runs):
        at, rate = START + timedelta(seconds=rnd.randrange(60)), 0.1
        for _ in range(n):
            if rnd.random() < 0.03:
                rate = rnd.choice([0.05, 0.3, 0.6, 0.9]) if r else 0.0
            number += 1
            out.append((f"run{r}", number, at, rnd.random() < rate))
            at += timedelta(seconds=rnd.randrange(3))
    return out


def arrivals(calls, seed, seconds, batches):
    """The calls in batches, each at most ``seconds`` out of order, a third of them twice, and at the end a sign of life from later."""
    rnd = random.Random(seed)
    by_arrival = sorted(calls, key=lambda c: c[2] + timedelta(seconds=rnd.random() * seconds))
    size = -(-len(by_arrival) // batches)
    parts = [by_arrival[i : i + size] for i in range(0, len(by_arrival), size)]
    for i, part in enumerate(parts):
        again = [c for c in part if rnd.random() < 0.33]
        parts[min(i + rnd.randrange(2), len(parts) - 1)] += again
    parts.append([("life", 0, START + timedelta(days=1), None)])
    return parts


def streamed(spark, folder, parts, name, **settings):
    """Each part is one micro-batch; the stream is stopped and taken up again in the middle."""
    source, found = f"{folder}/source", f"{folder}/found"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{i}")
        if i in (len(parts) // 2, len(parts) - 1):
            calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
            stream = online_breaches(calls, **settings).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(found)
            stream.awaitTermination(240)
            assert stream.exception() is None
    return sorted((r["run_id"], r["call_id"], r["reason"]) for r in spark.read.parquet(found).collect())


def test_stream_equals_batch_on_late_and_repeated_calls(spark, tmp_path):
    rule = {"in_a_row": 5, "window": 20, "share": 0.5}
    calls = calls_of(3)
    batch = first_breach(spark.createDataFrame(calls, SCHEMA), **rule).collect()
    assert len(batch) > 2 and {r["reason"] for r in batch} == {"consecutive", "share"}
    got = streamed(spark, tmp_path, arrivals(calls, 4, 50, 6), "late", late="60 seconds", **rule)
    assert got == sorted((r["run_id"], r["call_id"], r["reason"]) for r in batch)


def test_calls_too_late_are_left_out_and_idle_runs_go(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    parts = [
        [("a", i, at(i), i % 2 == 0) for i in range(4)],
        [("life", 0, at(3_600), None)],
        [("life", 4, at(3_600), None)],  # with the watermark of the batch before, the first four are judged
        [("a", 9, at(1), True), ("a", 10, at(3_601), True)],  # the first is an hour late
        [("life", 1, at(7_200), None)],
        [("a", 11, at(200_000), True), ("life", 2, at(400_000), None)],  # after a day without calls the run starts anew
        [("life", 3, at(500_000), None)],
    ]
    assert streamed(spark, tmp_path, parts, "idle", in_a_row=2, window=50, share=0.5, late="10 seconds", idle="1 day") == []
    parts.insert(4, [("a", 13, at(3_700), True), ("a", 14, at(80_000), True), ("a", 15, at(160_000), True)])  # after the breach, without a day's rest
    parts[3].append(("a", 12, at(3_602), True))
    more = tmp_path / "more"
    assert streamed(spark, more, parts, "two", in_a_row=2, window=50, share=0.5, late="10 seconds", idle="1 day") == [("a", 12, "consecutive")]
