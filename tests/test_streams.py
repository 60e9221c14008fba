import random

from pyspark.sql import functions as F

from wirelens.operators import corpus, similar
from wirelens.streaming import jobs, titles


def land(spark, tmp_path, parts, schema):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return jobs.read_landing(spark, str(tmp_path / "in"), schema, files_per_trigger=1)


def test_fuzzy_dedup_across_batches(spark, tmp_path):
    parts = [[(0, "Acme bank hit by ransomware gang attack"), (1, "Cloud leak at city college")], [(2, "Update: Acme bank hit by ransomware gang attack"), (3, "Another fresh story about vpn flaw")]]
    stream = land(spark, tmp_path, parts, "pos long, title string")
    out = jobs.fuzzy_dedup_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"))
    assert {r.pos: r.is_duplicate for r in out.collect()} == {0: False, 1: False, 2: True, 3: False}


def mixed_titles(seed, n=160):
    rng = random.Random(seed)
    words = ["acme", "breach", "leak", "bank", "hack", "the", "of", "group", "data", "zero", "day", "flaw", "cloud", "in", "vpn", "bug"]
    rows = []
    for pos in range(n):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        if rows and rng.random() < 0.2:
            title = "BREAKING: " + rng.choice(rows)[1] + "!"
        rows.append((pos, title + (f" CVE-2024-{rng.randint(1, 3)}" if rng.random() < 0.2 else ""), rng.random() < 0.1))
    return rows


def test_fuzzy_dedup_equals_the_batch_for_any_split(spark, tmp_path, monkeypatch):
    rows = mixed_titles(3)
    schema = "pos long, title string, exempt boolean"
    want = {r.pos: (r.is_duplicate, r.verdict) for r in similar.duplicate_titles(spark.createDataFrame(rows, schema), exempt=F.col("exempt")).collect()}
    tokenised, whole = [], similar.distinct_titles
    monkeypatch.setattr(similar, "distinct_titles", lambda df, *a, **k: tokenised.append(df.count()) or whole(df, *a, **k))
    for name, ends in {"even": [40, 80, 120, 160], "ragged": [1, 110, 115, 160]}.items():
        root = tmp_path / name
        stream = land(spark, root, [rows[a:b] for a, b in zip([0, *ends], ends)], schema)
        out = jobs.fuzzy_dedup_stream(stream, str(root / "out"), str(root / "state"), str(root / "ck"))
        assert {r.pos: (r.is_duplicate, r.verdict) for r in out.collect()} == want, name
        assert tokenised == [b - a for a, b in zip([0, *ends], ends)]  # no stored title is tokenised again
        tokenised.clear()
    seen = titles.SeenTitles(spark, str(tmp_path / "even" / "state"), None)
    last = spark.createDataFrame(rows[120:], schema).withColumn("day", F.lit("1970-01-01").cast("date"))
    assert {r.pos: (r.is_duplicate, r.verdict) for r in seen.judge(last, 3).collect()} == {p: v for p, v in want.items() if p >= 120}  # the same batch again


def test_titles_expire_by_event_time(spark, tmp_path):
    story = "Acme bank hit by ransomware gang attack"
    days = ["2024-01-01", "2024-01-05", "2024-01-20", "2024-01-22", None]
    parts = [[(i, story + (" again" if i == 3 else ""), False, d and f"{d} 10:00:00")] for i, d in enumerate(days)]
    stream = land(spark, tmp_path, parts, "pos long, title string, exempt boolean, t string").withColumn("ts", F.to_timestamp("t"))
    out = jobs.fuzzy_dedup_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"))
    got = {r.pos: (r.verdict, r.match_pos) for r in out.collect()}
    assert {p: got[p] for p in range(4)} == {0: ("new", None), 1: ("copy", 0), 2: ("new", None), 3: ("near", 2)}
    kept = {str(r.day) for r in titles.SeenTitles(spark, str(tmp_path / "state")).titles.read().select("day").distinct().collect()}
    assert kept >= {"2024-01-20", "2024-01-22"} and not kept & {"2024-01-01", "2024-01-05"}


def test_late_rows_and_daily_counts(spark, tmp_path):
    parts = [[("2024-01-20 01:00:00", "a", "h1")], [("2024-01-20 02:00:00", "a", "h1"), ("2024-01-21 00:00:00", "a", "h2")], [("2024-01-02 00:00:00", "a", "h3"), ("2024-01-21 05:00:00", "a", "h4")]]
    stream = land(spark, tmp_path, parts, "t string, k string, hash string").withColumn("ts", F.to_timestamp("t"))
    counts = jobs.daily_counts_stream(stream, "k", str(tmp_path / "c"), str(tmp_path / "ck1"))
    assert {str(r.day): r.n for r in counts.collect()} == {"2024-01-20": 2, "2024-01-21": 2}  # the row 19 days late is dropped
    unique = jobs.run_to_table(jobs.dedup_stream(stream), str(tmp_path / "d"), str(tmp_path / "ck2"))
    assert sorted(r.hash for r in unique.collect()) == ["h1", "h2", "h4"]


def test_ingest_restarts_without_repeats(spark, tmp_path):
    stream = land(spark, tmp_path, [[(1, "a")]], "pos long, title string")
    jobs.ingest(stream, str(tmp_path / "t"), str(tmp_path / "ck"))
    again = land(spark, tmp_path, [[(2, "b")]], "pos long, title string")
    assert sorted(r.pos for r in jobs.ingest(again, str(tmp_path / "t"), str(tmp_path / "ck")).collect()) == [1, 2]


def test_merge_keeps_new_before_old(spark):
    schema = "pos long, hash string, title string, published string, feed_region string"
    new = spark.createDataFrame([(0, "h1", "A", "2024-01-30", "US"), (1, None, "B", None, "a,b,c"), (2, "h9", "old", "2024-01-01", "US")], schema)
    old = spark.createDataFrame([(0, "h1", "A", "2024-01-29", "UK"), (1, "h2", "B", "bad date", "UK"), (2, "h3", "C", "2024-01-24 00:00:00", "UK")], schema)
    got = {r.title: r.feed_region for r in corpus.rolling_corpus(new, old, "2024-01-31 00:00:00").collect()}
    assert got == {"A": "US", "B": "Global", "C": "UK"}


def test_cursor_pages_lose_nothing(spark):
    df = spark.range(25).select(F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("ts"), F.lpad(F.col("id").cast("string"), 3, "0").alias("hash"))
    cursor, seen = (None, ""), []
    for _ in range(5):
        page = corpus.since_page(df, cursor[0], cursor[1], 10).collect()
        if not page:
            break
        seen += [r.hash for r in page]
        cursor = (str(page[-1].ts), page[-1].hash)
    assert seen == sorted(r.hash for r in df.collect())
