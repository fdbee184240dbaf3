"""Stateful streams against their batch twins and plain loops: any split of the events, timers, and what stays in the state."""

import datetime as dt
import random

import pytest

from topicloom.streaming import issues as log
from topicloom.streaming import stateful

T0 = dt.datetime(2026, 1, 1)


def run(spark, tmp_path, rows, splits, stream, **options):
    """Events by files in the given splits, then one that moves the watermark past all; what the stream wrote, and its last progress."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    end = max(r[3] for r in rows) + dt.timedelta(days=400)
    for part in [*splits, [(-1, "closing", "closing", end)]]:
        spark.createDataFrame(part, log.EVENTS).coalesce(1).write.mode("append").parquet(source)
        with stateful.rocksdb(spark):
            events = log.read_events(spark, source, late=options.pop("late", None) or run.late)
            q = stream(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.parquet(out), q.lastProgress


run.late = "10 days"


def made(seed, issues=6, n=120):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = T0 + dt.timedelta(seconds=rng.choice([0, 1, 59, 60, 61, 90]) * rng.randrange(1, 40), microseconds=rng.choice([0, 1, 999_999]))
        rows.append((k, rng.choice([f"i{rng.randrange(issues)}", None]) if k % 9 == 0 else "hot" if k % 3 == 0 else f"i{rng.randrange(issues)}", rng.choice(["pending", "sending", "sending", "failed", "sent", "edited", "resolved"]), at))
    return rows


def plain_retries(rows):
    out = []
    for k, issue, action, at in rows:
        if action in ("pending", "failed"):
            out.append((k, issue, action, at))
        elif action == "sending":
            end = at + dt.timedelta(seconds=60)
            if not any(i == issue and (at, k) < (b, e) and b <= end for e, i, _, b in rows):
                out.append((k, issue, "timeout", end))
    return sorted(map(str, out))


def as_rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_retries_by_any_split(spark, tmp_path, seed):
    rows = made(seed)
    shuffled = random.Random(seed).sample(rows, len(rows))
    splits = [shuffled[:7], shuffled[7:80], shuffled[60:]] if seed == 1 else [sorted(rows, key=lambda r: r[3])]  # some rows come twice
    got, last = run(spark, tmp_path, rows, splits, stateful.retry_stream)
    want = plain_retries(rows)
    assert sorted(str(tuple(r)) for r in got.where("event_id >= 0").select("event_id", "issue_id", "reason", "due_at").collect()) == want
    twin = stateful.retries(spark.createDataFrame(rows + [(999, "x", "sending", None)], log.EVENTS))
    assert as_rows(twin) == want and len(want) > 10
    assert any("timeout" in r for r in want)


def test_states_by_any_split_and_what_stays(spark, tmp_path):
    rows = made(3)
    rows += [(500 + k, f"done{k}", "resolved", T0) for k in range(40)]
    rows += [(600, "done1", "edited", T0 + dt.timedelta(days=200)), (601, "done2", "resolved", T0 + dt.timedelta(days=200)), (602, "open", "edited", T0 + dt.timedelta(days=200))]
    early, late = [r for r in rows if r[3] < T0 + dt.timedelta(days=9)], [r for r in rows if r[3] >= T0 + dt.timedelta(days=9)]
    mover = (603, "mover", "edited", T0 + dt.timedelta(days=100))
    rows.append(mover)
    got, last = run(spark, tmp_path, rows, [early[::2], early[1::2], [mover], late], stateful.state_stream)
    want = as_rows(log.state(spark.createDataFrame(rows, log.EVENTS)))
    assert as_rows(stateful.current_state(got.where("issue_id is distinct from 'closing'"))) == want
    assert as_rows(stateful.current_state(got.union(got).where("issue_id is distinct from 'closing'"))) == want
    gone = {r[0]: r[1] for r in got.groupBy("issue_id").agg({"gone": "max"}).collect()}
    assert gone["done0"] and gone["done2"] and not gone["open"]
    assert got.where("issue_id = 'done1'").select("spell").distinct().count() == 2
    stays = {r[0] for r in log.state(spark.createDataFrame(rows, log.EVENTS)).where("status <> 'resolved'").select("issue_id").collect()} | {"closing"}
    kept = [s["numRowsTotal"] for s in last.stateOperators if s["operatorName"].startswith("transformWithState")]
    assert kept == [len(stays)], (kept, stays)


def test_nothing_arrives(spark):
    none = spark.createDataFrame([], log.EVENTS)
    assert stateful.retries(none).count() == 0
    assert stateful.current_state(spark.createDataFrame([], "issue_id string, spell bigint, status string, updated bigint, last_event_id bigint, n_events bigint, edits bigint, opened bigint, gone boolean")).count() == 0
