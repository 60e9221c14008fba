import random

from pyspark.sql import functions as F

from wirelens.operators import clusters as cl


def sequential_cover(edges):
    """Largest entity first, in order of first appearance; kept with two uncovered members."""
    members, first = {}, {}
    for name, pos, order in edges:
        members.setdefault(name, set()).add(pos)
        first[name] = min(first.get(name, (pos, order)), (pos, order))
    covered, kept = set(), []
    for name in sorted(members, key=lambda n: (-len(members[n]), first[n], n)):
        if len(members[name]) >= 3 and len(members[name] - covered) >= 2:
            covered |= members[name]
            kept.append(name)
    return set(kept)


def test_cover_equals_the_sequential_rule(spark):
    rng = random.Random(11)
    for size in (12, 20):
        edges = sorted({(f"e{rng.randint(0, size):02d}", rng.randint(0, size)) for _ in range(size * 6)}, key=lambda e: (e[1], e[0]))
        rows = [(name, pos, i) for i, (name, pos) in enumerate(edges)]
        df = spark.createDataFrame([("t", n, p, o) for n, p, o in rows], "entity_type string, entity_name string, pos long, ord int")
        assert {r.entity_name for r in cl.greedy_cover(df).collect()} == sequential_cover(rows)


def items(spark, rows):
    return spark.createDataFrame(rows, "pos long, title string, summary string, link string, source string, hash string, published string, category string, event_ts string") \
        .withColumn("feed_region", F.lit("US")) \
        .withColumn("event_ts", F.to_timestamp("event_ts"))


def story(pos, title, day):
    return (pos, title, "", f"l{pos}", "s", f"h{pos:03d}", None, "Malware", None if day is None else f"2024-01-{day:02d} 00:00:00")


def test_clusters_and_campaigns(spark):
    df = items(spark, [story(i, "Microsoft outage", 20 - i if i else None) for i in range(12)] + [story(20, "Oracle bug", 1), story(21, "Oracle bug", 2)])
    summary, members = cl.build_clusters(df, cl.entity_edges(df))
    rows = summary.collect()
    assert [(r.entity_name, r.article_count, len(r.articles)) for r in rows] == [("Microsoft", 12, 10)]
    assert str(rows[0].first_seen) == "2024-01-09 00:00:00" and rows[0].articles[0].link == "l11"
    assert members.count() == 12

    first = cl.upsert_campaigns(cl.empty_campaigns(spark), summary, members, "2024-02-01 00:00:00", cap=5)
    row = first.collect()[0]
    assert row.status == "active" and row.total_observed_articles == 12 and len(row.article_hashes) == 5
    again = cl.upsert_campaigns(first, summary, members, "2024-02-10 00:00:00", cap=500).collect()[0]
    assert again.campaign_id == row.campaign_id and len(again.article_hashes) == 12 and str(again.last_observed) == "2024-02-10 00:00:00"
    aged = cl.upsert_campaigns(first, summary.limit(0), members.limit(0), "2024-06-01 00:00:00").collect()[0]
    assert aged.status == "archived" and aged.total_observed_articles == 12

    story_rows = cl.annotate_clusters(df, summary, members).filter("cluster is not null").collect()
    assert len(story_rows) == 12 and story_rows[0].cluster.entity_name == "Microsoft"
    view = cl.campaign_view(first, df).orderBy("seq").collect()
    assert [r.seq for r in view] == [1, 2, 3, 4, 5] and view[0].articles_in_window == 5
    whole = cl.campaign_view(first, df, members=members).orderBy("seq").collect()
    assert [r.seq for r in whole] == list(range(1, 13)) and whole[0].articles_in_window == 12
