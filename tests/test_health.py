import random
from datetime import datetime, timedelta

from wirelens.operators import feeds
from wirelens.streaming import health, jobs

START = datetime(2024, 1, 1)


def machine(events):
    """State per feed, fetch by fetch."""
    out = {}
    for url, day, success, n in events:
        s = out.setdefault(url, dict(errors=0, first=None, ok=None, status="ok", total=0, good=0, entries=0))
        s["total"] += 1
        if success and n > 0:
            s.update(errors=0, first=None, ok=day, status="ok", good=s["good"] + 1, entries=s["entries"] + n)
        elif success:
            s["good"] += 1
            if s["ok"] is not None and day - s["ok"] >= 30:
                s["status"] = "stale"
            elif s["ok"] is None and s["good"] >= 10:
                s["status"] = "silent"
        else:
            if s["errors"] == 0:
                s["first"] = day
            s["errors"] += 1
            age = day - s["first"]
            s["status"] = "dead" if age >= 7 else "suspect" if age >= 3 else "error"
    return {u: (s["status"], s["errors"], s["total"], s["good"], s["entries"]) for u, s in out.items()}


def history(seed):
    rng = random.Random(seed)
    rows, day = [], 0.0
    for _ in range(500):
        day += rng.choice([0.05, 0.2, 0.5])
        url = rng.choice(["a", "b", "c", "quiet", "broken", "once"])
        success = rng.random() < {"broken": 0.1, "quiet": 0.9}.get(url, 0.8)
        n = 0 if url in ("quiet", "broken") or (url == "once" and day > 2) else rng.choice([0, 3])
        rows.append((url, day, success, n))
    return rows


def frame(spark, rows, base=0):
    data = [(u, START + timedelta(days=d), base + i, s, n) for i, (u, d, s, n) in enumerate(rows)]
    return spark.createDataFrame(data, "url string, ts timestamp, event_id long, success boolean, entry_count int")


def summary(df):
    return {r.url: (r.status, r.consecutive_errors, r.fetches_total, r.fetches_successful, r.entries_total) for r in df.collect()}


def test_health_equals_the_state_machine(spark):
    for seed in (1, 2, 3):
        rows = history(seed)
        assert summary(feeds.feed_health(frame(spark, rows))) == machine(rows)


def test_shuffled_and_late_files_give_the_batch_result(spark, tmp_path):
    rows = history(4)
    fetches = frame(spark, rows)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fetches.schema.fields)
    for name, part in {"late": lambda i: (i // 125 + 3) % 4, "dealt": lambda i: i * 7 % 4}.items():
        for n in range(4):
            fetches.filter(f"event_id in ({','.join(str(i) for i in range(500) if part(i) == n)})").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = jobs.read_landing(spark, str(tmp_path / name / "in"), schema, files_per_trigger=1)
        got = jobs.feed_health_stream(stream, str(tmp_path / name / "state"), str(tmp_path / name / "ck"))
        assert summary(got) == machine(rows), name
        assert sorted(map(str, got.collect())) == sorted(map(str, feeds.feed_health(fetches).collect()))
    state = health.Health(spark, str(tmp_path / "late" / "state"))
    state.add(fetches.filter("event_id >= 375"), 1)  # a batch that was stored before comes again
    assert summary(state.table()) == machine(rows)


def test_scores_and_report(spark):
    df = spark.createDataFrame([("a", "ok", 10, 10, 200), ("b", "dead", 10, 5, 10), ("c", "ok", 0, 0, 0)], "url string, status string, fetches_total long, fetches_successful long, entries_total long")
    scores = {r.url: round(r.signal_score, 3) for r in feeds.signal_scores(df).collect()}
    assert scores == {"a": 100.0, "b": 0.5, "c": 0.0}
    report = feeds.health_report(df).first()
    assert (report.total_tracked, report.ok, report.dead, report.stale) == (3, 2, 1, 0)


def test_streak_age(spark):
    rows = [("a", 0.0, True, 3), ("a", 1.0, False, 0), ("a", 2.0, True, 0), ("a", 5.0, False, 0)]
    row = feeds.error_streaks(frame(spark, rows), "2024-01-11 00:00:00").first()
    assert (row.consecutive_errors, row.error_days) == (2, 9.0)
