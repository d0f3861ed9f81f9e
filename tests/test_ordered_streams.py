"""Status changes in order of event time, over files that come out of order."""

import random
from datetime import datetime, timedelta

from procatlas.streaming import flows

START = datetime(2024, 3, 1)
SCHEMA = "event_id long, user_id long, event_type string, ts timestamp_ntz"


def run(spark, folder, batches, flow):
    found = None
    for batch in batches:
        rows = [(i, u, s, START + timedelta(seconds=at)) for i, u, s, at in batch]
        spark.createDataFrame(rows, SCHEMA).selectExpr("event_id", "ts", "user_id", "event_type", "0D AS value", "'' AS props").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found = flows.drain(flow(flows.read_events(spark, f"{folder}/in", "*.parquet")), path=f"{folder}/out", by=None)
    return found.collect()


def expected(batches, patience, width, expire):
    """By a loop over batches: what is late, and the changes among the rest that the horizon has passed."""
    seen, kept, late = None, [], []
    for batch in batches:
        for row in batch:
            (late if seen is not None and row[3] <= seen - patience else kept).append(row)
        seen = max([r[3] for r in batch] + ([] if seen is None else [seen]))
    # A bucket is handed out once its last millisecond is behind the horizon.
    due = [r for r in kept if r[3] // width * width + width - 0.001 <= seen - patience]
    out, last = [], {}
    for i, user, status, at in sorted(due, key=lambda r: (r[3], r[0])):
        before = last.get(user)
        if before and before[0] != status and (expire is None or at - before[1] <= expire):
            out.append(("change", user, i, before[0], status))
        last[user] = (status, at)
    return sorted(out + [("late", u, i, None, s) for i, u, s, _ in late], key=str)


def test_changes_in_order(spark, tmp_path):
    """A hot key with a third of the events, equal times, late events and a key that falls silent."""
    rng = random.Random(7)
    rows = [(i, 1 if i % 3 == 0 else rng.randrange(2, 6), rng.choice("abc"), rng.randrange(0, 3600)) for i in range(240)]
    rows += [(900, 9, "a", 10), (901, 9, "b", 20), (902, 9, "c", 3000), (903, 9, "c", 3000), (904, 9, "a", 3000)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[3] // 900 + rng.choice((0, 0, 0, 1)))  # mostly in order of quarters, some a quarter late
    batches = [rows[:80], rows[80:160], rows[160:]]
    found = run(spark, str(tmp_path / "a"), batches, lambda e: flows.stream_ordered_changes(e, "user_id", "5 minutes", "1 minute", "20 minutes"))
    got = sorted(((r["kind"], r["subject"], r["event_id"], r["from_status"], r["to_status"]) for r in found), key=str)
    wanted = expected(batches, 300, 60, 1200)
    assert got == wanted and {k for k, *_ in got} == {"late", "change"}


def test_late_rows_are_kept_apart(spark, tmp_path):
    batches = [[(1, 1, "a", 0), (2, 1, "a", 1000)], [(3, 1, "a", 400), (4, 1, "a", 401), (5, 2, "b", 2000)], [(6, 2, "b", 1400), (7, 2, "b", 1401), (7, 2, "b", 1401)]]
    found = run(spark, str(tmp_path / "b"), batches, lambda e: flows.stream_with_late(e, "10 minutes"))
    assert sorted((r["event_id"], r["late"]) for r in found) == [(1, False), (2, False), (3, True), (4, False), (5, False), (6, True), (7, False), (7, False)]
