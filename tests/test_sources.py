import json

from pyspark.sql import Observation, functions as F

from wirelens.functions import regions
from wirelens.sinks import writers
from wirelens.sources import readers

AS_OF = "2024-01-31 00:00:00"


def record(cve="CVE-2024-1", v31=None, v30=None, v2=None, lang="en", text="A flaw.", criteria=("cpe:2.3:a:acme_corp:big_tool:1",), cwe=("CWE-79", "noinfo")):
    score = lambda s: None if s is None else [{"cvssData": {"baseScore": s, "vectorString": f"AV{s}"}}]
    return json.dumps({
        "id": cve, "published": "2024-01-01T00:00:00.000", "descriptions": [{"lang": lang, "value": text}],
        "metrics": {"cvssMetricV31": score(v31), "cvssMetricV30": score(v30), "cvssMetricV2": score(v2)},
        "configurations": [{"nodes": [{"cpeMatch": [{"criteria": c} for c in criteria]}]}],
        "weaknesses": [{"description": [{"value": c} for c in cwe]}], "references": []})


def test_cve_records(spark):
    raw = [record(v31=9.8, v2=5.0), record("CVE-2024-2", v30=7.0, criteria=()), record("CVE-2024-3", v2=6.9), record("", v31=9.9), record("CVE-2024-4", v2=8.0, lang="es", text="x " * 200)]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(F.from_json("raw", readers.CVE_SCHEMA).alias("r")).select("r.*")
    rows = {r.cve_id: r for r in readers.flatten_cve_records(df).collect()}
    assert set(rows) == {"CVE-2024-1", "CVE-2024-2", "CVE-2024-4"}
    one = rows["CVE-2024-1"]
    assert (one.cvss_score, one.cvss_severity, one.cvss_vector, one.cwe_ids, one.affected_products) == (9.8, "CRITICAL", "AV9.8", ["CWE-79"], ["Acme Corp Big Tool"])
    assert one.title == "CVE-2024-1: CRITICAL (9.8) — A flaw." and "Affected: Acme Corp Big Tool." in one.summary
    many = [f"cpe:2.3:a:acme:tool_{n}:1" for n in range(12)]
    wide = spark.createDataFrame([(record("CVE-2024-9", v31=9.0, criteria=(*many, many[0])),)], "raw string").select(F.from_json("raw", readers.CVE_SCHEMA).alias("r")).select("r.*")
    all_of = readers.flatten_cve_records(wide).first()
    assert all_of.affected_products == [f"Acme Tool {n}" for n in range(12)] and "Acme Tool 4. " in all_of.summary and "Tool 5" not in all_of.summary
    assert rows["CVE-2024-2"].affected_products is None and "multiple products" in rows["CVE-2024-2"].summary
    assert rows["CVE-2024-4"].title.endswith("...") and len(rows["CVE-2024-4"].title) <= 155


def test_victims(spark):
    rows = [("Acme", "lockbit", "2024-01-30 10:00:00", "http://x.onion/a", "US"), ("Old", "g", "2023-01-01", "", "de"), ("Undated", "g", "", "", ""),
            ("Beta", "g", "2024-01-29", "https://ok.example/b", "germany"), ("Gamma", "g", "2024-01-29", None, "xx")]
    df = spark.createDataFrame(rows, "victim string, group_name string, discovered string, post_url string, country string")
    got = {r.title: (r.link, r.feed_region) for r in readers.normalize_victims(df, AS_OF, regions.country_lookup(spark)).collect()}
    assert got == {
        "lockbit ransomware: new victim 'Acme' (US)": ("https://ransomware.live/#/victims", "US"),
        "g ransomware: new victim 'Beta' (germany)": ("https://ok.example/b", "Europe"),
        "g ransomware: new victim 'Gamma' (xx)": ("https://ransomware.live/#/victims", "Global")}


def test_ioc_feed(spark):
    entry = lambda fam, v, day: {"ioc_type": "domain", "ioc_value": v, "malware_printable": fam, "threat_type": "c2", "first_seen_utc": day}
    feed = {str(i): [entry("Emo Tet", f"v{i}", "2024-01-30 01:00:00 UTC")] for i in range(12)}
    feed["x"] = [entry("Other", "o1", "2024-01-30 01:00:00"), entry("Other", "o2", None), entry("Old", "z", "2023-01-01 00:00:00")]
    schema = "feed map<string,array<struct<ioc_type:string,ioc_value:string,malware_printable:string,threat_type:string,first_seen_utc:string>>>"
    rows = readers.explode_ioc_feed(spark.createDataFrame([(feed,)], schema))
    got = {r.darkweb_group: r for r in readers.rollup_ioc_feed(rows, AS_OF).collect()}
    assert {k: v.ioc_count for k, v in got.items()} == {"Emo Tet": 10, "Other": 1}
    assert "10 new IOCs" in got["Emo Tet"].title and got["Emo Tet"].link.endswith("/emo-tet/") and "1 new IOC detected" in got["Other"].title


def test_kev_last_row_wins(spark):
    v = [{"cveID": "cve-2024-1", "product": "a", "knownRansomwareCampaignUse": ""}, {"cveID": "CVE-2024-1", "product": "b", "knownRansomwareCampaignUse": "Known"}, {"cveID": None}]
    schema = "vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,dueDate:string,requiredAction:string,knownRansomwareCampaignUse:string>>"
    rows = readers.load_kev(spark.createDataFrame([(v,)], schema)).collect()
    assert [(r.cve_id, r.product, r.vendor, r.ransomware_use) for r in rows] == [("CVE-2024-1", "b", "", "Known")]


def test_rss_and_feedback_files(spark, tmp_path):
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss" / "a.xml").write_text(
        "<rss><channel><item><title>Hack &amp; leak</title><link>https://n.example/x?utm=1</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"
        "<item><title></title><link>https://n.example/y</link></item><item><title>Dark</title><link>http://abc.onion/</link></item></channel></rss>")
    rows = readers.read_rss(spark, str(tmp_path / "rss"), "https://n.example/rss", "US").collect()
    assert [(r.title, r.link, r.feed_region) for r in rows] == [("Hack & leak", "https://n.example/x?utm=1", "US")]
    (tmp_path / "f.jsonl").write_text('{"article_hash": "a", "correct_category": "DDoS"}\nnot json\n{"article_hash": "b"}\n')
    assert sorted(r.article_hash for r in readers.read_feedback(spark, str(tmp_path / "f.jsonl")).collect()) == ["a", "b"]


def test_main_text(spark):
    p = "<p>" + "A long enough paragraph of text. " * 3 + "</p>"
    pages = [f"<html><nav><p>{'menu ' * 50}</p></nav><article>{p}<p>short</p>{p}</article><footer>{p}</footer></html>", "<main>" + p * 2 + "</main>", "<p>tiny</p>"]
    got = [r.text for r in readers.html_main_text(spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i long, html string")).orderBy("i").collect()]
    assert got[0].count("A long enough") == 6 and "menu" not in got[0] and "short" not in got[0] and got[1] and got[2] is None


def test_outbox_and_stix(spark):
    df = spark.createDataFrame([(i, f"t{i}", f"https://l/{i}", "Malware", 90, "US", "s", "2024-01-01", "src") for i in range(7)],
                               "pos long, title string, link string, category string, confidence int, feed_region string, summary string, published string, source string")
    chat = writers.alert_outbox(df, "chat").first()
    assert chat.alert_count == 7 and chat.payload.count("•") == 5 and "and 2 more" in chat.payload
    assert len(json.loads(writers.alert_outbox(df, "generic").first().payload)) == 7
    assert writers.alert_outbox(df.limit(0)).count() == 0
    iocs = spark.createDataFrame([("a'b].example", "domain", "Fam", "2024-01-01"), ("x", "mutex", "Fam", None)], "value string, kind string, malware string, published string")
    objects = writers.stix_objects(df, iocs, AS_OF)
    parsed = [json.loads(r.object) for r in objects.collect()]
    assert sorted(o["type"] for o in parsed) == ["identity", "indicator"] + ["report"] * 7
    assert next(o for o in parsed if o["type"] == "indicator")["pattern"] == "[domain-name:value = 'ab.example']"
    first, again = (writers.stix_bundle_id(objects).first().bundle_id for _ in range(2))
    assert first == again and first != writers.stix_bundle_id(objects.limit(3)).first().bundle_id


def test_a_broken_feed_gives_items_quarantine_and_counts(spark, tmp_path):
    good = "<rss><channel><item><title>One</title><link>https://a.example/1</link></item>"
    (tmp_path / "a.xml").write_text(good + "<item><title>Two</link></item><item><title></title><link>https://a.example/2</link></item>"
                                    "<item><title>Three</title><link>http://x.onion/</link></item><item><title>Four</title><link>https://a.example/4</link></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<html><body>Checking your browser</body></html>")
    read = readers.read_feed(spark, str(tmp_path), "https://a.example/rss")
    assert sorted(r.title for r in read.items.collect()) == ["Four", "One"]
    bad = sorted((r.file.rsplit("/", 1)[1], r.reason) for r in read.quarantine.collect())
    assert bad == [("a.xml", readers.HIDDEN_LINK), ("a.xml", readers.NO_TITLE), ("a.xml", readers.UNREADABLE), ("b.xml", readers.NO_ENTRY)]
    assert "Two" in read.quarantine.filter(F.col("reason") == readers.UNREADABLE).first().record
    seen = Observation()
    read.counted(seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"entries": 5, "unreadable": 1, "untitled": 1, "hidden": 1}


def test_retention_drops_by_value_and_copies_nothing(spark, tmp_path):
    days = ["2022-12-01", "2023-06-01", "2023-12-30", "2024-01-20"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "k long, date string")
    for name in ("daily", "reports", "clusters"):
        rows.write.partitionBy("date").parquet(str(tmp_path / name))
    kept_before = {p for p in tmp_path.rglob("*.parquet")}
    gone = writers.retain_outputs(spark, str(tmp_path), AS_OF)
    assert gone == {"daily": days[:3], "reports": days[:1]}
    kept = {p for p in tmp_path.rglob("*.parquet")}
    assert kept < kept_before and len(kept) == 12 - 4
    assert writers.apply_retention(spark, str(tmp_path / "missing"), AS_OF) == []


def test_latest_is_replaced_and_the_old_copy_goes(spark, tmp_path):
    path = str(tmp_path / "t" / "latest")
    for n in (5, 3):
        writers.replace_latest(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["latest"]


def test_state_files_become_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"url": "u1", "n": 1},\n {"url": "u2", "n": null}]')
    (tmp_path / "in" / "b.json").write_text('{"url": "u3", "n": 3, "more": true}')
    for _ in range(2):  # an import may be repeated
        got = readers.import_state(spark, str(tmp_path / "in"), str(tmp_path / "out"), "url string, n long")
        assert sorted((r.url, r.n) for r in got.collect()) == [("u1", 1), ("u2", None), ("u3", 3)]
