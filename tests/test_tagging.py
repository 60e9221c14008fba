import re

import pytest
from pyspark.sql import functions as F

from wirelens import rules
from wirelens.functions import text as tx
from wirelens.operators import audits, digest, enrich, filters, grounding, tagging, trends
from wirelens.plans.headlines import headlines


def items(spark, rows, schema="title string, summary string"):
    return spark.createDataFrame(rows, schema)


def test_templates_reach_the_rules(spark, sf):
    """The derived items must fire rules, or the checks would pass on empty output."""
    rows = headlines(spark.read.parquet(f"{sf}/documents.parquet"))
    seen = {r.category for r in tagging.classify(rows).select("category").distinct().collect()}
    assert len(seen) >= 14 and "Noise" in seen
    hits = rows.select(F.explode(rules.matching(F.col("title"), rules.load("categories"), "label")).alias("r")).select("r.label").distinct()
    assert hits.count() >= 18
    for table, fn, column in (("techniques", tagging.tag_techniques, "attack_techniques"), ("sectors", tagging.tag_sectors, "victim_sectors"), ("actors", tagging.match_actors, "actors")):
        assert fn(rows).filter(F.col(column).isNotNull()).count() > 20, table


CASES = [
    ("Acme hit by ransomware", "Ransomware", 92), ("Phishing wave imitates banks", "Phishing", 85), ("APT28 phishing against ministries", "Nation-State Attack", 88),
    ("Ransomware gang leaks records: data breach at Acme", "Data Breach", 88), ("Webinar: ransomware defence", "Noise", 0),
    ("Garden cafe opens downtown", "General Cyber Threat", 0), ("New botnet hits routers", "Malware", 87), ("Firewall settings explained", "General Cyber Threat", 60),
]


def test_classifier_labels(spark):
    df = tagging.classify(items(spark, [(t, None) for t, _, _ in CASES]))
    assert [(r.category, r.confidence) for r in df.collect()] == [(c, k) for _, c, k in CASES]


def test_given_labels_win(spark):
    df = items(spark, [("Acme hit by ransomware", "", True, 70, "DDoS"), ("Acme hit by ransomware", "", True, 0, "DDoS"), ("Acme hit by ransomware", "", None, None, None)],
               "title string, summary string, is_cyber_attack boolean, confidence int, category string")
    assert [(r.category, r.confidence) for r in filters.classified(df).collect()] == [("DDoS", 70), ("Ransomware", 92), ("Ransomware", 92)]


def test_techniques(spark):
    df = items(spark, [("Malicious attachment campaign", "", None), ("Plain", "", "x" * 2000 + " ransomware"), ("Plain", "", None)], "title string, summary string, full_content string")
    ids = lambda d: [None if r[0] is None else [t.technique_id for t in r[0]] for r in d.select("attack_techniques").collect()]
    assert ids(tagging.tag_techniques(df)) == [["T1566.001", "T1566"], ["T1486"], None]
    assert ids(tagging.tag_techniques(df, body_chars=2000)) == [["T1566.001", "T1566"], None, None]


def test_sectors_regions_names(spark):
    df = items(spark, [("Hospital and bank hit", "university too", False), ("Frost Bank", "hospital university", True)], "title string, summary string, darkweb boolean")
    assert [r.victim_sectors for r in tagging.tag_sectors(df).collect()] == [["Healthcare", "Finance", "Education"], ["Finance"]]
    cases = [("Chinese hackers attack US company in United States", None, "Global", "US"), ("Attack on German firm", None, "Japan", "Europe"),
             ("Brazil and Germany sign pact", None, "Global", "LATAM"), ("Outage", "Seen in Israel", "Global", "Middle East"), ("Outage", "Seen in Israel and Japan", "US", "US"),
             ("Attack in Egypt", None, "Narnia", "Narnia"), ("Attack in Egypt", None, "Global", "Middle East")]
    places = items(spark, [(t, s, r, "x", False) for t, s, r, _ in cases], "title string, summary string, feed_region string, source string, darkweb boolean")
    assert [r.feed_region for r in tagging.infer_region(places).collect()] == [c[3] for c in cases]
    named = tagging.tag_names(items(spark, [("Microsoft Exchange and xF5x bug", ""), ("F5, AT&T!", ""), ("Palo-Alto Networks", "")]), ["Microsoft", "Microsoft Exchange", "F5", "AT&T", "Palo Alto Networks"])
    assert [r.asset_tags for r in named.collect()] == [["Microsoft Exchange", "Microsoft"], ["AT&T", "F5"], None]


def test_iocs(spark):
    h64, h40, h32 = "a" * 64, "b" * 40, "c" * 32
    texts = [f"sample hash {h64} {h40} {h32} at hxxp://bad[.]example[.]com/x. and 8[.]8[.]4[.]4 or 10.0.0.1", f"commit {h40} by X@Y.example.com see www.github.com", "", None]
    rows = [r.iocs for r in tagging.extract_iocs(items(spark, [(t, None) for t in texts])).collect()]
    assert rows[0].ipv4 == ["8.8.4.4"] and rows[0].urls == ["http://bad.example.com/x"] and rows[0].domains == ["bad.example.com"]
    assert (rows[0].sha256, rows[0].sha1, rows[0].md5) == ([h64], [h40], [h32])
    assert rows[1].sha1 == [] and rows[1].emails == ["x@y.example.com"] and rows[1].domains == ["y.example.com"] and rows[2] is None and rows[3] is None


def test_ipv6_of_any_spelling(spark):
    text = "beacons to 2606:4700:4700::1111, then 2A00:1450:4001:81b:0:0:0:200e. At 12:30:45 from aa:bb:cc:dd:ee:ff or fe80::1 (see [2001:67c::7]:443)"
    assert tagging.extract_iocs(items(spark, [(text, None)])).first().iocs.ipv6 == ["2001:67c::7", "2606:4700:4700::1111", "2A00:1450:4001:81b:0:0:0:200e"]


def test_a_title_that_speaks_of_one_category_decides(spark):
    rows = [("APT5 spreads ransomware", ""), ("Ransomware hits clinic", "the work of APT5"), ("APT41 phishing wave", "a phishing campaign")]
    got = [r.category for r in tagging.classify(items(spark, rows)).collect()]
    assert got == ["Nation-State Attack", "Ransomware", "Nation-State Attack"]


def test_bare_names_of_groups(spark):
    found = tagging.match_actors(tagging.tracked_keywords(items(spark, [("Clop hackers breach firm", ""), ("BEC losses rise", ""), ("Eclopsed becomes", "")]))).collect()
    assert [[a.name for a in r.actors or []] for r in found] == [["Cl0p"], [], []]
    assert [r.tracked for r in found] == [["Cl0p"], ["BEC/Wire Fraud"], None]


def test_no_pattern_of_a_rule_is_a_column(spark):
    """Patterns that are no literals would be compiled once a row."""
    plan = tagging.tag_techniques(tagging.classify(items(spark, [("x", "y")])))._jdf.queryExecution().optimizedPlan().toString()
    assert "pattern" not in plan


def test_reply_validation(spark):
    reply = '{"techniques":[{"technique_id":"t1059","technique_name":"","tactic":"Execution"},{"technique_id":"T1059"},{"technique_id":"X1"},{"technique_id":"T1566.001"}]}'
    df = spark.createDataFrame([(reply,), ("no json",)], "raw string")
    got = [[(t.technique_id, t.technique_name, t.tactic) for t in r[0]] for r in df.select(tagging.valid_techniques(F.col("raw"))).collect()]
    assert got == [[("T1059", "T1059", "Execution"), ("T1566.001", "T1566.001", "Unknown")], []]
    replies = ['{"summary": " s ", "ttps": ["a", " ", "b", "c", "d", "e", "f", "g"], "other": ["x"], "impact": [], "confidence": "High"}', '{"confidence": "low"}', "no json"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in replies], "raw string").select(tagging.valid_extraction(F.col("raw"))).collect()]
    assert got[0].asDict() == {"summary": "s", "ttps": ["a", "b", "c", "d", "e", "f"], "persistence": None, "lateral_movement": None, "impact": None, "confidence": "high"}
    assert got[1:] == [None, None]


def test_rules_of_plain_words():
    row = rules.spelled_out({"label": "x", "stems": ["fancy bear"], "near": ["attack"]})
    assert row["starts"] == ["fancy"]
    for text, want in (("Fancy-Bear\nlong ago attacks", True), ("attack by fancybear", False), ("unfancy bear attack", False)):
        assert bool(re.search("(?i)" + row["pattern"], text)) is want


def test_grounding(spark):
    stories = spark.createDataFrame([(1, "ShinyHunters hit Acme via CVE-2024-1"), (2, "LockBit hit Acme"), (3, "Acme")], "i long, story string")
    sources = spark.createDataFrame([(1, "shinyhunters breach at ACME, cve-2024-1"), (2, "Acme outage")], "i long, source_text string")
    got = {r.i: (r.grounded, r.missing_nouns) for r in grounding.story_grounding(stories, sources, ["i"]).collect()}
    assert got == {1: (True, []), 2: (False, ["LockBit"]), 3: (False, ["Acme"])}
    body = "Flaw tracked as CVE-2024-9 (CVE-2024-8), now fixed; see CVE-2024-1."
    df = grounding.strip_ungrounded(spark.createDataFrame([(body,)], "body string"), tx.strings(["CVE-2024-1"]))
    assert df.first().body == "Flaw, now fixed; see CVE-2024-1." and not df.first().publishable


def test_risk_joins_and_alerts(spark):
    df = spark.createDataFrame([(i, f"h{i}", t, "") for i, t in enumerate(["CVE-2024-1000 and cve-2024-1001", "none", "CVE-2024-1001", "CVE-2024-1002"])], "pos long, hash string, title string, summary string")
    epss = spark.createDataFrame([("CVE-2024-1000", 0.02, 0.5), ("CVE-2024-1001", 0.6, 0.9)], "cve_id string, epss_score double, epss_percentile double")
    kev = spark.createDataFrame([("CVE-2024-1001", "v", "2024-01-30", "Known"), ("CVE-2024-1002", "v", "2023-01-01", "Unknown")], "cve_id string, vendor string, date_added string, ransomware_use string")
    rated = enrich.join_kev(enrich.join_epss(df, epss), kev)
    rows = {r.pos: r for r in rated.collect()}
    assert rows[0].epss_max_score == 0.6 and rows[0].epss_risk == "VERY HIGH" and len(rows[0].epss_scores) == 2 and rows[1].epss_scores is None
    assert rows[2].kev_ransomware_use == "Known" and rows[1].kev_listed is False and rows[3].kev_min_date_added == "2023-01-01"
    alerts, marks = enrich.kev_alerts(rated, spark.createDataFrame([], "cve_id string"), "2024-01-31 00:00:00")
    assert [(r.cve_id, r.articles, len(r.titles)) for r in alerts.collect()] == [("CVE-2024-1001", 2, 2)]
    assert {r.cve_id for r in marks.collect()} == {"CVE-2024-1001", "CVE-2024-1002"}
    assert enrich.kev_alerts(rated, marks, "2024-01-31 00:00:00")[0].count() == 0


@pytest.mark.parametrize("today,past,expected", [(4, [2, 2, 2], ["k"]), (3, [2, 2, 2], []), (2, [0, 0, 0], []), (3, [0, 0, 0], ["new_emergence"])])
def test_spike_rules(spark, today, past, expected):
    days = [(f"2024-01-{d:02d}", "tracked_keyword", "k", n) for d, n in zip((1, 2, 5), past) if n] + [(f"2024-01-{d:02d}", "category", "filler", 1) for d in (1, 2, 5, 9)]
    rows = days + [("2024-01-09", "tracked_keyword", "k", today)]
    counts = spark.createDataFrame(rows, "day string, kind string, key string, n long").withColumn("day", F.to_date("day"))
    got = [r.type if r.type == "new_emergence" else r.key for r in trends.spikes(counts, "2024-01-09").collect()]
    assert got == expected


def test_digest_fill(spark):
    rows = [(i, "day1" if i < 3 else "day3", f"2024-01-{30 - i // 10:02d} 00:00:00", False) for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, bucket string, event_ts string, kev_listed boolean").withColumn("event_ts", F.to_timestamp("event_ts"))
    got = digest.digest_candidates(digest.hoist_kev(df, "2024-01-31 00:00:00")).orderBy("slot").collect()
    assert len(got) == 30 and [r.pos for r in got[:4]] == [0, 1, 2, 3]
    only_old = df.withColumn("bucket", F.lit("older"))
    assert digest.digest_candidates(only_old).count() == 30 or digest.digest_candidates(only_old).count() == 40


def test_health_ladder(spark):
    rows = [(None, None, False, 0, 0, 0, 1.0), (9e3, 10.0, False, 0, 0, 0, 1.0), (10.0, 10.0, False, 10, 3, 0, 1.0), (10.0, 10.0, False, 10, 0, 25, 7.0), (10.0, 10.0, False, 10, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "heartbeat_age double, last_run_age double, budget_exceeded boolean, enriched int, failures int, dead_feeds int, report_age_hours double")
    got = [(r.status, len(r.reasons)) for r in audits.health_status(df).collect()]
    assert got == [("unknown", 1), ("stale", 1), ("degraded", 1), ("degraded", 3), ("ok", 0)]


def test_misfiled_titles_name_any_group_number(spark):
    titles = ["APT5 spies on carriers", "APT 29 returns", "Hackers of APT-99", "APT41 again", "Apt for the task", "Adapt 5 habits"]
    df = spark.createDataFrame([(t, "Phishing", 90) for t in titles], "title string, category string, confidence int")
    assert {r.title for r in audits.misfiled(df).collect()} == set(titles[:4])
