import random

from pyspark.sql import functions as F

from tests.test_clusters import items, sequential_cover, story
from wirelens.operators import clusters as cl
from wirelens.sinks.tables import BucketTable
from wirelens.streaming import campaigns, jobs

NAMES = ["Microsoft", "Oracle", "Cisco", "LockBit", "APT28", "Okta", "SolarWinds", "VMware"]
AS_OF = "2024-02-01 00:00:00"


def stories(seed, n=60):
    rng = random.Random(seed)
    return [story(i, " and ".join(rng.sample(NAMES, rng.choice([1, 1, 2, 3]))) + f" CVE-2024-{1000 + rng.randrange(5)} outage", rng.choice([None, *range(1, 29)])) for i in range(n)]


def facts(df):
    return sorted((r.campaign_id, r.entity_type, r.entity_name, str(r.first_observed), str(r.last_observed), r.total_observed_articles, r.status) for r in df.collect())


def test_any_split_gives_the_rows_of_the_batch_twin(spark, tmp_path):
    rows = stories(2)
    df = items(spark, rows)
    want = facts(campaigns.campaigns_of(df, AS_OF))
    assert want
    orders = {"in order, last file late": [rows[20:35], rows[35:50], rows[50:], rows[:20]], "dealt": [rows[2::4], rows[0::4], rows[3::4], rows[1::4]]}
    for name, parts in orders.items():
        root = tmp_path / name.replace(" ", "_").replace(",", "")
        for part in parts:
            items(spark, part).coalesce(1).write.mode("append").parquet(str(root / "in"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        stream = jobs.read_landing(spark, str(root / "in"), schema, files_per_trigger=1)
        table = jobs.campaign_stream(stream, str(root / "state"), str(root / "ck"), AS_OF)
        assert facts(table.filter("current")) == want, name
        state = campaigns.Campaigns(spark, str(root / "state"))
        assert state.edges.read().count() == cl.entity_edges(df).count()
        sizes = {(r.entity_type, r.entity_name): r.total_observed_articles for r in table.filter("current").collect()}
        assert {(r.entity_type, r.entity_name): r.n for r in state.members().groupBy("entity_type", "entity_name").agg(F.count("*").alias("n")).collect()} == sizes


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = stories(5, 30)
    state = campaigns.Campaigns(spark, str(tmp_path / "s"))
    state.add(items(spark, rows[:15]), 0)
    state.add(items(spark, rows[15:]), 1)
    before = facts(state.table(AS_OF))
    state.add(items(spark, rows[15:]), 1)
    assert facts(state.table(AS_OF)) == before
    assert facts(state.table(AS_OF).filter("current")) == facts(campaigns.campaigns_of(items(spark, rows), AS_OF))
    previews = campaigns.recent_hashes(state.members(), 4).collect()
    assert previews and all(1 <= len(r.article_hashes) <= 4 for r in previews)


def test_a_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k long, v long", ["k"], buckets=8)
    table.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")), 0)
    files = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    touched = table.upsert(spark.createDataFrame([(5, 2), (200, 2)], "k long, v long"), 1)
    assert len(touched) <= 2
    other = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert other and other <= files() and not (before - other) & files()
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {**{k: 1 for k in range(100)}, 5: 2, 200: 2}
    assert table.upsert(spark.createDataFrame([(5, 9)], "k long, v long"), 1) == []  # the same merge again
    table.merge(spark.createDataFrame([(5, 0)], "k long, v long"), lambda old, new: old.join(new.select("k"), "k", "left_anti"), 2)
    assert 5 not in {r.k for r in table.read().collect()}


def test_long_chains_settle(spark, monkeypatch):
    """Entity n shares items with entity n + 1 only, sizes falling: every decision waits for the one before."""
    rows, order = [], 0
    for n in range(500):
        for pos in (2 * n, 2 * n + 1, 2 * n + 2, 2 * n + 3):
            rows.append((f"e{n:03d}", pos, order))
            order += 1
    df = spark.createDataFrame([("t", n, p, o) for n, p, o in rows], "entity_type string, entity_name string, pos long, ord int")
    want = sequential_cover(rows)
    assert {r.entity_name for r in cl.greedy_cover(df).collect()} == want
    monkeypatch.setattr(cl, "SCAN_EDGES", 0)
    short = [r for r in rows if r[0] < "e030"]
    df = spark.createDataFrame([("t", n, p, o) for n, p, o in short], "entity_type string, entity_name string, pos long, ord int")
    assert {r.entity_name for r in cl.greedy_cover(df).collect()} == sequential_cover(short)
