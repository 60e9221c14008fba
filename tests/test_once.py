"""Costly expressions are computed once per row, and anchors are found in one pass."""

from pyspark.sql import functions as F

from wirelens import rules
from wirelens.functions import jsonfix
from wirelens.operators import clusters, filters, tagging
from wirelens.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def items(spark):
    return spark.createDataFrame([
        (1, "LockBit ransomware hits Cisco", "CVE-2024-1", "h1", "2024-01-01"), (2, "Cisco cafe opens", "", "h2", "2024-01-02"),
        (3, "Lockbit again: Cisco", None, "h3", "2024-01-03")], "pos long, title string, summary string, hash string, event_ts string").withColumns(
        {c: F.lit("x") for c in ("link", "source", "published", "category")})


def test_anchors_are_found_wherever_they_occur(spark):
    rows = [{"pattern": "abcd|zz", "anchors": ["abcd", "zz"]}, {"pattern": "bcde", "anchors": ["bcde"]}, {"pattern": "é day", "anchors": ["é day"]},
            {"pattern": "end$", "anchors": ["end"]}]
    texts = ["xABCDEx", "", None, "ab", "cd zz", "é day", "the end", "en", "d", "bcd", "e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2)
    found = df.select("i", F.transform(rules.matching(F.col("text"), rows, "pattern"), lambda r: r["order"]).alias("f"))
    assert {r.i: r.f for r in found.collect()} == {0: [0, 1], 1: [], 2: [], 3: [], 4: [0], 5: [2], 6: [3], 7: [], 8: [], 9: [], 10: []}


def test_filters_on_the_label_do_not_classify_again(spark):
    kept = filters.drop_irrelevant(tagging.classify(items(spark))).select("pos", "category")
    assert plan(kept).count("unpatched (flaw|bug|hole)") <= 2  # over the text, and over the title
    assert {r.pos for r in kept.collect()} == {1, 3}


def test_replies_are_parsed_once(spark, sf):
    assert plan(QUERIES["d16_valid_extraction"](spark, sf)).count("from_json(") <= 1


def test_texts_are_tagged_once_for_clusters_and_profiles(spark):
    summary, members = clusters.build_clusters(items(spark), clusters.entity_edges(items(spark)))
    assert "CVE-" not in plan(summary) + plan(members)
    assert [(r.entity_name, r.article_count) for r in summary.collect()] == [("Cisco", 3)]
    profiles = clusters.actor_profiles(tagging.tag_techniques(items(spark)))
    assert "lockbit" not in plan(profiles).lower()
    assert [(r.name, r.article_count) for r in profiles.collect()] == [("LockBit", 2)]


def test_json_steps_run_only_where_the_ones_before_failed(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(['{"k": 1}', '{"k": 2, }', 'So: {"k": 3} ok', 'So: {"k": 4,} ok', "no json here", None])], "i int, raw string")
    parsed = jsonfix.tolerant_json(rows, "raw").select("i", "parsed_from", F.try_variant_get("parsed", "$.k", "int").alias("k"))
    assert "filter(array(" not in plan(parsed).lower()  # an array of all steps ran them all
    assert {r.i: (r.parsed_from, r.k) for r in parsed.collect()} == {
        0: ("strict", 1), 1: ("repaired", 2), 2: ("block", 3), 3: ("block_repaired", 4), 4: ("quarantine", None), 5: ("quarantine", None)}
