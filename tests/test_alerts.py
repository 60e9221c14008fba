from wirelens.streaming import alerts, jobs

AS_OF = "2024-02-01 00:00:00"
ITEMS = "pos long, title string, kev_listed boolean, kev_entries array<struct<cve_id: string, date_added: string>>"


def item(pos, *entries):
    return (pos, f"t{pos}", bool(entries), [(f"CVE-2024-{1000 + n}", day) for n, day in entries])


def land(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, ITEMS).coalesce(1).write.mode("append").parquet(path)
    return jobs.read_landing(spark, path, ITEMS, files_per_trigger=1)


def test_alerts_over_the_cap_wait_and_fire_once(spark, tmp_path):
    fresh = "2024-01-30"
    first = [item(9, *[(n, fresh) for n in range(8)]), item(1, (7, "2024-01-25")), item(2, (50, "2023-01-01")), item(3, (60, "soon"))]
    parts = [first, [item(20, (7, fresh), (1, fresh), (50, fresh))], [item(30, (8, fresh))]]
    stream = land(spark, str(tmp_path / "in"), parts)
    sent = jobs.once_alerts_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), AS_OF)
    got = {r.cve_id: (r.round, r.date_added, r.articles, r.titles) for r in sent.collect()}
    assert {c[-1] for c, r in got.items() if r[0] == 0} == set("01234") and sent.count() == 10
    assert got["CVE-2024-1007"] == (1, "2024-01-25", 3, ["t1", "t9"])  # what came while it waited counts
    assert got["CVE-2024-1060"][:2] == (1, "soon") and "CVE-2024-1050" not in got
    assert got["CVE-2024-1008"][0] == 2
    state = alerts.OnceAlerts(spark, str(tmp_path / "out"), str(tmp_path / "state"), AS_OF)
    state.round(spark.createDataFrame(parts[1], ITEMS), 1)  # a batch that was stored before comes again
    assert {r.cve_id: r.round for r in state.sent().collect()} == {c: r[0] for c, r in got.items()}


def test_waiting_alerts_fire_without_new_items(spark, tmp_path):
    stream = land(spark, str(tmp_path / "in"), [[item(i, (i, "2024-01-30")) for i in range(12)]])
    jobs.once_alerts_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), AS_OF)
    state = alerts.OnceAlerts(spark, str(tmp_path / "out"), str(tmp_path / "state"), AS_OF)
    assert [r.cve_id[-1] for r in state.waiting().collect()] == list("5678901")
    state.drain()
    assert sorted((r.round, r.cve_id) for r in state.sent().collect()) == [(i // 5, f"CVE-2024-{1000 + i}") for i in range(12)]
