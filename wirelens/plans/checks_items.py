"""Checked queries for filters (C), tagging (D), rankings (G), ordering (H) and sets (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import fixed, rules
from wirelens.functions import text as tx, times
from wirelens.operators import corpus, enrich, filters, joins, tagging
from wirelens.plans import headlines as hl
from wirelens.plans.registry import AS_OF, Tables, query


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, row: dict) -> str:
    return f"regexp_matches({column}, {lit(row['pattern'])}, '{'c' if row.get('case_sensitive') else 'i'}')"


def rule_hits(rows, column: str, source: str, extra=lambda i, r: f"{i} AS rule, {lit(r.get('label', ''))} AS label") -> str:
    """One literal-pattern branch per rule: (pos, rule, label)."""
    return " UNION ALL ".join(f"SELECT pos, {extra(i, r)} FROM {source} WHERE {matches(column, r)}" for i, r in enumerate(rows))


def any_of(column: str, rows) -> str:
    return "(" + " OR ".join(matches(column, r) for r in rows) + ")"


def fmt(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def shown(column, name: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)


def timed(t: Tables):
    """Item view with its event time."""
    items = t.headlines()
    return items.withColumn("event_ts", filters.best_time(items))


@query("c01_ingest_window", "SELECT pos FROM headlines WHERE pub_ts >= TIMESTAMP '2024-01-24 00:00:00'")
def _(t: Tables):
    return filters.ingest_window(t.headlines(), AS_OF).select("pos")


@query("c02_retained", "SELECT pos FROM headlines WHERE coalesce(pub_ts, TIMESTAMP '2024-01-31') >= TIMESTAMP '2024-01-24 00:00:00'")
def _(t: Tables):
    return filters.retained(t.headlines(), AS_OF).select("pos")


TEXTS = "x AS (SELECT pos, title, title || ' ' || summary AS text FROM headlines)"


@query("c03_is_relevant", f"WITH {TEXTS} SELECT pos, {any_of('text', rules.load('relevance'))} OR {any_of('text', rules.load('categories'))} AS relevant FROM x")
def _(t: Tables):
    return t.headlines().select("pos", filters.is_relevant(F.concat("title", F.lit(" "), "summary")).alias("relevant"))


@query("c04_is_noise", f"WITH {TEXTS} SELECT pos, {any_of('text', rules.load('noise'))} AS noise FROM x")
def _(t: Tables):
    return t.headlines().select("pos", filters.is_noise(F.concat("title", F.lit(" "), "summary")).alias("noise"))


@query("c06_drop_benign_domains", """
WITH d AS (SELECT page_id, lower(split_part(split_part(url, '/', 3), ':', 1)) AS domain FROM pages),
b AS (SELECT DISTINCT domain FROM d WHERE page_id % 5 = 0)
SELECT page_id, domain FROM d WHERE domain NOT IN (SELECT domain FROM b)
  AND regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) NOT IN (SELECT domain FROM b) AND regexp_matches(domain, '\\.(com|net|org)$')""")
def _(t: Tables):
    from wirelens.functions import urls

    named = t("pages").select("page_id", urls.host(F.col("url")).alias("domain"))
    benign = named.filter("page_id % 5 = 0").select("domain")
    return filters.drop_benign_domains(named, "domain", benign).select("page_id", "domain")


@query("c07_hash_context", r"""
SELECT doc_id, regexp_matches(text, '\bmd5\b|\bsha-?1\b|\bsha-?256\b|\bhash(es)?\b|\bchecksum\b|\bsample\b|\bioc\b|\bindicator', 'i') AS context FROM (
  SELECT doc_id, text || (CASE WHEN doc_id % 3 = 0 THEN ' SHA-256 of the sample' ELSE '' END) AS text FROM documents)""")
def _(t: Tables):
    extra = F.when(F.col("doc_id") % 3 == 0, " SHA-256 of the sample").otherwise("")
    return t("documents").select("doc_id", tagging.hash_context(F.concat("text", extra)).alias("context"))


@query("c08_alertable", "SELECT pos FROM headlines WHERE is_cyber_attack AND confidence >= 80")
def _(t: Tables):
    return filters.alertable(t.headlines()).select("pos")


@query("c09_escalation_queue", """
SELECT pos, confidence FROM headlines WHERE is_cyber_attack AND ((category = 'General Cyber Threat' AND confidence <= 60) OR confidence < 70)
ORDER BY confidence, pos LIMIT 20""")
def _(t: Tables):
    return filters.work_queue(t.headlines(), "escalation", [F.col("confidence"), F.col("pos")]).select("pos", "confidence")


@query("c10_narrative_queue", """
WITH r AS (SELECT i.pos, max(e.epss_percentile) AS pct FROM item_cves i LEFT JOIN epss e USING (cve_id) GROUP BY i.pos)
SELECT r.pos FROM r JOIN headlines h USING (pos) WHERE h.confidence / 10 >= 8 OR r.pct >= 0.8 ORDER BY r.pos LIMIT 30""")
def _(t: Tables):
    scored = enrich.join_epss(tagging.extract_cves(t.headlines()), hl.epss_scores(t("documents"))).withColumn(
        "cvss_score", F.col("confidence") / 10).withColumn("epss_percentile", F.array_max(F.col("epss_scores.epss_percentile")))
    return filters.work_queue(scored, "narrative", [F.col("pos")]).select("pos")


@query("c11_deep_extract_queue", "SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 40")
def _(t: Tables):
    docs = t("documents").withColumnRenamed("text", "full_content").withColumn("is_cyber_attack", F.col("doc_id") % 6 != 0)
    return filters.work_queue(docs, "deep_extract", [F.desc("n_chars"), F.col("doc_id")]).select("doc_id")


@query("c12_missing_summary_queue", """
WITH q AS (SELECT pos FROM headlines WHERE pos % 4 = 0 ORDER BY pos LIMIT 150) SELECT pos, (row_number() OVER (ORDER BY pos) - 1) // 10 AS batch_id FROM q""")
def _(t: Tables):
    blank = t.headlines().withColumn("summary", F.when(F.col("pos") % 4 == 0, "  ").otherwise(F.col("summary")))
    return filters.work_queue(blank, "missing_summary", [F.col("pos")], batch=10).select("pos", "batch_id")


@query("c13_macro_regions", """
SELECT pos, 'na' AS macro FROM headlines WHERE list_has_any(string_split(feed_region, ','), ['US', 'Canada', 'Mexico', 'NA'])
UNION ALL SELECT pos, 'emea' FROM headlines WHERE list_has_any(string_split(feed_region, ','), ['UK', 'Germany', 'France', 'Europe'])
UNION ALL SELECT pos, 'apac' FROM headlines WHERE list_has_any(string_split(feed_region, ','), ['Japan', 'APAC'])""")
def _(t: Tables):
    parts = [filters.by_macro_region(t.headlines(), key).select("pos", F.lit(key).alias("macro")) for key in fixed.MACRO_REGIONS]
    return corpus.union_sources(*parts)


@query("c14_digest_filter", """
WITH k AS (SELECT pos, regexp_replace(regexp_replace(lower(trim(title)), '^(.*) - .*$', '\\1'), '^(.*) \\| .*$', '\\1') AS key
  FROM headlines WHERE NOT darkweb AND category <> 'Noise' AND confidence <> 0)
SELECT min(pos) AS pos, key FROM k GROUP BY key""")
def _(t: Tables):
    return filters.digest_filter(t.headlines()).select("pos", tx.title_key(F.col("title")).alias("key"))


@query("c15_since", "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-01-01', 4000)")
def _(t: Tables):
    orders = t("orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("hash"), "o_orderkey")
    return filters.since(orders, "1997-01-01 00:00:00", "000000004000").select("o_orderkey")


@query("c16_with_status", "SELECT o_orderkey FROM orders WHERE date_diff('day', o_orderdate, TIMESTAMP '1998-12-01') BETWEEN 15 AND 90")
def _(t: Tables):
    from wirelens.functions import bands

    rows = t("orders").select("o_orderkey", bands.campaign_status(F.col("o_orderdate").cast("timestamp"), times.as_timestamp("1998-12-01 00:00:00")).alias("status"))
    return filters.with_status(rows, "dormant").select("o_orderkey")


@query("c17_mentions_cve", "SELECT pos FROM item_cves WHERE cve_id = 'CVE-2024-1008'")
def _(t: Tables):
    return filters.mentions_cve(tagging.extract_cves(t.headlines()), "cve-2024-1008").select("pos")


def classify_sql() -> str:
    cats, bonus = rules.load("categories"), {b["label"]: b["bonus"] for b in rules.load("bonuses")}
    hits = " UNION ALL ".join(
        f"SELECT pos, {i} AS rule, {lit(r['label'])} AS label, {r['confidence']} AS conf, {r['confidence'] + bonus.get(r['label'], 0)}"
        f" + (CASE WHEN {matches('title', r)} THEN 10 ELSE 0 END) AS score FROM x WHERE {matches('text', r)}" for i, r in enumerate(cats))
    wins = " ".join(
        f"WHEN list_contains(l, {lit(a)}) AND list_contains(l, {lit(b)}) AND {any_of('title', [r for r in cats if r['label'] == winner])} THEN {lit(winner)}"
        for a, b, winner in fixed.DECIDED_PAIRS)
    return f"""WITH {TEXTS},
hits AS ({hits}),
labels AS (SELECT pos, list(label) AS l FROM hits GROUP BY pos),
wins AS (SELECT pos, CASE {wins} END AS winner FROM labels JOIN x USING (pos)),
best AS (SELECT pos, arg_max({{'label': label, 'conf': conf}}, (score + (CASE WHEN label = winner THEN 50 ELSE 0 END), -rule)) AS b FROM hits JOIN wins USING (pos) GROUP BY pos),
judged AS (SELECT x.pos, b, b IS NOT NULL OR {any_of('text', rules.load('relevance'))} AS relevant, {any_of('text', rules.load('noise'))} AS noise FROM x LEFT JOIN best USING (pos)),
labelled AS (SELECT pos, relevant AND NOT noise AS is_cyber_attack,
  CASE WHEN relevant AND noise THEN 'Noise' WHEN relevant THEN coalesce(b.label, 'General Cyber Threat') ELSE 'General Cyber Threat' END AS category,
  CASE WHEN relevant AND NOT noise THEN coalesce(b.conf, 60) ELSE 0 END AS confidence FROM judged)
"""


CLASSIFY = classify_sql()


@query("d11_d12_classify", CLASSIFY + "SELECT pos, is_cyber_attack, category, confidence FROM labelled")
def _(t: Tables):
    return tagging.classify(t.headlines()).select("pos", "is_cyber_attack", "category", "confidence")


@query("c18_keep_given_label", CLASSIFY + """
SELECT l.pos, CASE WHEN h.is_cyber_attack THEN h.category ELSE l.category END AS category,
  CASE WHEN h.is_cyber_attack THEN h.confidence ELSE l.confidence END AS confidence FROM labelled l JOIN headlines h USING (pos)""")
def _(t: Tables):
    return filters.classified(t.headlines()).select("pos", "category", "confidence")


@query("c19_drop_irrelevant", CLASSIFY + "SELECT pos, category FROM labelled WHERE is_cyber_attack")
def _(t: Tables):
    return filters.drop_irrelevant(tagging.classify(t.headlines())).select("pos", "category")


@query("d01_extract_cves", "SELECT pos, string_agg(cve_id, ',' ORDER BY cve_id) AS ids FROM headlines LEFT JOIN item_cves USING (pos) GROUP BY pos")
def _(t: Tables):
    return tagging.extract_cves(t.headlines()).select("pos", F.array_join("cve_ids", ",").alias("ids"))


@query("d02_extract_all_cves", """
WITH a AS (SELECT pos, cve_id FROM item_cves UNION SELECT pos, 'CVE-2020-' || (5000 + pos % 7) FROM headlines WHERE pos % 3 = 0)
SELECT pos, string_agg(cve_id, ',' ORDER BY cve_id) AS ids FROM headlines LEFT JOIN a USING (pos) GROUP BY pos""")
def _(t: Tables):
    given = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("cve-2020-"), (5000 + F.col("pos") % 7).cast("string")))
    return tagging.extract_all_cves(t.headlines().withColumn("cve_id", given)).select("pos", F.array_join("all_cves", ",").alias("ids"))


@query("d03_match_actors", f"WITH {TEXTS}, h AS ({rule_hits(rules.load('actors'), 'text', 'x')}) SELECT pos, string_agg(label, ',' ORDER BY rule) AS names FROM headlines LEFT JOIN h USING (pos) GROUP BY pos")
def _(t: Tables):
    return tagging.match_actors(t.headlines()).select("pos", F.array_join(F.col("actors.name"), ",").alias("names"))


@query("d04_match_orgs", "WITH h AS (" + " UNION ALL ".join(
    f"SELECT pos, {i} AS g, regexp_extract(title, {lit(r['pattern'])}, 1) AS org FROM headlines" for i, r in enumerate(rules.load("orgs")))
    + ") SELECT pos, string_agg(nullif(org, ''), ',' ORDER BY g) AS orgs FROM h GROUP BY pos")
def _(t: Tables):
    return tagging.match_orgs(t.headlines()).select("pos", F.array_join("orgs", ",").alias("orgs"))


@query("d05_extract_iocs", r"""
WITH d AS (SELECT doc_id, text FROM documents),
v4 AS (SELECT DISTINCT doc_id, 'ipv4' AS kind, x[2] AS v FROM (SELECT doc_id, unnest(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', '[^\d.](\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})[^\d.]', 1)) AS ip FROM d) q, LATERAL (SELECT ['', ip] AS x)
  WHERE list_aggregate(list_transform(string_split(ip, '.'), lambda o: CAST(o AS INTEGER)), 'max') < 256),
p AS (SELECT *, string_split(v, '.')[1]::INT AS a, string_split(v, '.')[2]::INT AS b, string_split(v, '.')[3]::INT AS c FROM v4),
ok AS (SELECT doc_id, kind, v FROM p WHERE NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
  OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AND v NOT IN ('1.2.3.4', '4.3.2.1')),
e AS (SELECT DISTINCT doc_id, 'emails' AS kind, lower(unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b'))) AS v FROM d),
s AS (SELECT DISTINCT doc_id, 'sha256' AS kind, lower(unnest(regexp_extract_all(text, '\b[a-fA-F0-9]{64}\b'))) AS v FROM d)
SELECT * FROM ok UNION ALL SELECT * FROM e UNION ALL SELECT * FROM s""")
def _(t: Tables):
    found = tagging.extract_iocs(t("documents").select("doc_id", F.col("text").alias("summary")))
    kinds = F.map_from_arrays(tx.strings(["ipv4", "emails", "sha256"]), F.array("iocs.ipv4", "iocs.emails", "iocs.sha256"))
    return found.select("doc_id", F.explode_outer(kinds).alias("kind", "vs")).select("doc_id", "kind", F.explode_outer("vs").alias("v")).filter("v is not null")


def technique_sql() -> str:
    rows = rules.load("techniques")
    by_id = {r["technique_id"]: r for r in rows}
    parts = []
    for i, r in enumerate(rows):
        for k, x in enumerate([r, by_id[r["technique_id"].split(".")[0]]] if "." in r["technique_id"] else [r]):
            parts.append(f"SELECT pos, {2 * i + k} AS o, '{x['technique_id']}' AS id, '{x['tactic']}' AS tactic FROM x WHERE {matches('text', r)}")
    return (f"WITH {TEXTS}, h AS ({' UNION ALL '.join(parts)}), u AS (SELECT pos, id, any_value(tactic) AS tactic, min(o) AS o FROM h GROUP BY pos, id)"
            " SELECT pos, string_agg(id, ',' ORDER BY o) AS ids, array_to_string(list_sort(list_distinct(list(tactic) FILTER (WHERE tactic IS NOT NULL))), ',') AS tactics"
            " FROM headlines LEFT JOIN u USING (pos) GROUP BY pos")


@query("d06_tag_techniques", technique_sql())
def _(t: Tables):
    return tagging.tag_techniques(t.headlines()).select(
        "pos", F.array_join(F.col("attack_techniques.technique_id"), ",").alias("ids"), F.array_join("attack_tactics", ",").alias("tactics"))


@query("d07_tag_sectors", f"""WITH x AS (SELECT pos, CASE WHEN darkweb THEN title ELSE title || ' ' || summary END AS text FROM headlines),
h AS ({rule_hits(rules.load('sectors'), 'text', 'x')}) SELECT pos, string_agg(label, ',' ORDER BY rule) AS sectors FROM headlines LEFT JOIN h USING (pos) GROUP BY pos""")
def _(t: Tables):
    return tagging.tag_sectors(t.headlines()).select("pos", F.array_join("victim_sectors", ",").alias("sectors"))


@query("d08_tag_names_parts", """
WITH k AS (SELECT unnest(['red', 'blue bolt', 'small', 'small ring', 'widget', 'ECONOMY', 'gear', 'Brand#2']) AS name),
h AS (SELECT p_partkey, name FROM part, k WHERE regexp_matches(p_name || ' ' || p_brand || ' ' || p_type, '(^|[^A-Za-z0-9])' || name || '($|[^A-Za-z0-9])', 'i'))
SELECT p_partkey, string_agg(name, ',' ORDER BY name) AS names FROM h GROUP BY p_partkey""")
def _(t: Tables):
    names = ["red", "blue bolt", "small", "small ring", "widget", "ECONOMY", "gear", "Brand#2"]
    tagged = tagging.tag_names(t("part"), names, columns=("p_name", "p_brand", "p_type"))
    return tagged.filter("asset_tags is not null").select("p_partkey", F.array_join(F.array_sort("asset_tags"), ",").alias("names"))


VENDORS = [r["label"] for r in rules.load("vendors")]


@query("d08_tag_names", f"WITH {TEXTS}, h AS (" + " UNION ALL ".join(
    f"SELECT pos, {lit(v)} AS name FROM x WHERE regexp_matches(text, {lit('(^|[^A-Za-z0-9])' + v + '($|[^A-Za-z0-9])')}, 'i')" for v in VENDORS)
    + ") SELECT pos, string_agg(name, ',' ORDER BY name) AS names FROM headlines LEFT JOIN h USING (pos) GROUP BY pos")
def _(t: Tables):
    return tagging.tag_names(t.headlines(), VENDORS).select("pos", F.array_join(F.array_sort("asset_tags"), ",").alias("names"))


def region_sql() -> str:
    places, origins = rules.places(), rules.load("origins")
    over = ", ".join(lit(r) for r in fixed.OVERRIDABLE_REGIONS)
    return f"""WITH pt AS (SELECT pos, list(DISTINCT label) AS l FROM ({rule_hits(places, 'title', 'headlines')}) GROUP BY pos),
ps AS (SELECT pos, list(DISTINCT label) AS l FROM ({rule_hits(places, 'summary', 'headlines')}) GROUP BY pos),
po AS (SELECT pos, list(DISTINCT label) AS l FROM ({rule_hits(origins, 'title', 'headlines')}) GROUP BY pos),
j AS (SELECT h.pos, h.darkweb, h.feed_region, coalesce(pt.l, []) AS t, coalesce(ps.l, []) AS s, coalesce(po.l, []) AS o
  FROM headlines h LEFT JOIN pt USING (pos) LEFT JOIN ps USING (pos) LEFT JOIN po USING (pos)),
i AS (SELECT *, list_filter(t, lambda x: NOT list_contains(o, x)) AS n, list_filter(t, lambda x: x NOT IN ('Middle East', 'APAC', 'Europe')) AS u FROM j)
SELECT pos, CASE WHEN darkweb OR feed_region NOT IN ({over}) THEN feed_region
  WHEN len(t) = 1 THEN t[1]
  WHEN len(t) > 1 THEN CASE WHEN len(o) > 0 AND len(n) = 1 THEN n[1] WHEN len(o) > 0 AND len(n) = 0 THEN 'Global' WHEN len(u) = 1 THEN u[1] ELSE 'Global' END
  WHEN len(s) = 1 THEN s[1] ELSE feed_region END AS feed_region FROM i"""


@query("d09_infer_region", region_sql())
def _(t: Tables):
    return tagging.infer_region(t.headlines()).select("pos", "feed_region")


@query("d10_tracked_keywords", f"WITH {TEXTS}, h AS ({rule_hits(rules.load('keywords'), 'text', 'x')}) SELECT pos, string_agg(label, ',' ORDER BY rule) AS words FROM headlines LEFT JOIN h USING (pos) GROUP BY pos")
def _(t: Tables):
    return tagging.tracked_keywords(t.headlines()).select("pos", F.array_join("tracked", ",").alias("words"))


@query("d13_proper_nouns", r"""
SELECT pos, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(title, '\b[A-Z][\w\-''.]{2,}\b'), lambda x: x NOT IN (""" + ", ".join(
    lit(r["label"]) for r in rules.load("common_nouns")) + ")))), ',') AS nouns FROM headlines")
def _(t: Tables):
    stop = tuple(r["label"] for r in rules.load("common_nouns"))
    return t.headlines().select("pos", F.array_join(F.array_sort(tx.proper_nouns(F.col("title"), stop)), ",").alias("nouns"))


@query("d14_merge_techniques", f"""
SELECT pos, ids AS base, concat_ws(',', ids, CASE WHEN NOT list_contains(l, 'T1486') THEN 'T1486' END, CASE WHEN NOT list_contains(l, 'T1059.003') THEN 'T1059.003' END) AS merged,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN coalesce(tactics, '') = '' THEN [] ELSE string_split(tactics, ',') END, ['Impact', 'Unknown']))), ',') AS tactics
FROM (SELECT *, string_split(coalesce(ids, ''), ',') AS l FROM ({technique_sql()}))""")
def _(t: Tables):
    reply = F.lit('{"techniques":[{"technique_id":"t1486","tactic":"Impact"},{"technique_id":"T1059.003"},{"technique_id":"bad"}]}')
    tagged = tagging.tag_techniques(t.headlines()).withColumn("extra", tagging.valid_techniques(reply))
    merged = F.transform(tagging.merge_techniques(F.col("attack_techniques"), F.col("extra")), lambda x: x["technique_id"])
    return tagged.select("pos", F.array_join(F.col("attack_techniques.technique_id"), ",").alias("base"), F.array_join(merged, ",").alias("merged"),
                         F.array_join(tagging.merged_tactics(F.col("attack_tactics"), F.col("extra")), ",").alias("tactics"))


@query("d15_valid_techniques", """
SELECT pos, 'T' || (1000 + pos % 900) || CASE WHEN pos % 2 = 0 THEN ',T1059.003' ELSE '' END AS ids FROM headlines""")
def _(t: Tables):
    reply = F.format_string(
        '{"techniques":[{"technique_id":"t%d","tactic":""},{"technique_id":"%s"},{"technique_id":"T%d"},{"technique_id":"T12"}]}',
        1000 + F.col("pos") % 900, F.when(F.col("pos") % 2 == 0, "T1059.003").otherwise("T1059.3"), 1000 + F.col("pos") % 900)
    return t.headlines().select("pos", F.array_join(F.transform(tagging.valid_techniques(reply), lambda x: x["technique_id"]), ",").alias("ids"))


@query("d16_valid_extraction", r"""
WITH w AS (SELECT pos, list_filter(list_transform(string_split(summary, ' '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS words,
  nullif(substring(regexp_replace(summary, '^\s+|\s+$', '', 'g'), 1, 400), '') AS summary, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title FROM headlines)
SELECT pos, summary, nullif(array_to_string(list_transform(words[1:6], lambda x: substring(x, 1, 160)), '|'), '') AS ttps, nullif(substring(title, 1, 160), '') AS impact,
  CASE pos % 3 WHEN 0 THEN 'high' END AS confidence FROM w WHERE summary IS NOT NULL OR len(words) > 0 OR title <> ''""")
def _(t: Tables):
    reply = F.to_json(F.struct("summary", F.split("summary", " ").alias("ttps"), F.array("title", F.lit(" ")).alias("impact"), F.array("title").alias("unknown_key"),
                               F.when(F.col("pos") % 3 == 0, " HIGH").when(F.col("pos") % 3 == 1, "certain").alias("confidence")))
    found = rules.once(t.headlines(), "x", tagging.valid_extraction(reply)).select("pos", "x").filter("x is not null")
    return found.select("pos", "x.summary", F.array_join("x.ttps", "|").alias("ttps"), F.array_join("x.impact", "|").alias("impact"), "x.confidence")


@query("g02_keep_first", "WITH k AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) SELECT doc_id FROM k")
def _(t: Tables):
    return corpus.keep_first(t("documents"), ["text"], [F.col("doc_id")]).select("doc_id")


@query("i01_merge_corpus", """
WITH a AS (SELECT doc_id AS pos, text AS title, CASE WHEN doc_id % 10 <> 9 THEN sha256(text) END AS hash, doc_id % 3 <> 0 AS old FROM documents),
h AS (SELECT *, row_number() OVER (PARTITION BY coalesce(hash, 'none' || pos) ORDER BY old, pos) AS r FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY old, pos) AS q FROM h WHERE r = 1) SELECT pos FROM k WHERE q = 1""")
def _(t: Tables):
    docs = t("documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("title"), F.when(F.col("doc_id") % 10 != 9, F.sha2("text", 256)).alias("hash"))
    return corpus.merge_corpus(docs.filter("pos % 3 = 0"), docs.filter("pos % 3 <> 0")).select("pos")


@query("g05_max_risk", """
WITH s AS (SELECT i.pos, e.cve_id, e.epss_score FROM item_cves i JOIN epss e USING (cve_id))
SELECT pos, arg_max(cve_id, (epss_score, -CAST(cve_id[10:] AS INTEGER))) AS cve_id FROM s GROUP BY pos""")
def _(t: Tables):
    scored = enrich.join_epss(t.headlines(), hl.epss_scores(t("documents"))).filter("epss_scores is not null")
    return scored.select("pos", enrich.max_risk(F.col("epss_scores"))["cve_id"].alias("cve_id"))


@query("g10_rank_vulns", """
WITH c AS (SELECT h.pos, 'CVE-2024-' || (1000 + h.pos % 37) AS cve_id, h.confidence / 10 AS cvss FROM headlines h WHERE h.pos % 4 = 0),
r AS (SELECT c.*, k.cve_id IS NOT NULL AS kev, coalesce(e.epss_score, 0) AS score FROM c LEFT JOIN kev k USING (cve_id) LEFT JOIN epss e USING (cve_id))
SELECT pos, cve_id FROM r ORDER BY kev DESC, score DESC, cvss DESC, pos LIMIT 8""")
def _(t: Tables):
    first = F.concat(F.lit("CVE-2024-"), (1000 + F.col("pos") % 37).cast("string"))
    items = t.headlines().withColumn("cve_id", F.when(F.col("pos") % 4 == 0, first)).withColumn("cvss_score", F.col("confidence") / 10)
    own = items.withColumn("summary", F.lit("")).withColumn("title", F.lit(""))
    rated = enrich.join_kev(enrich.join_epss(own, hl.epss_scores(t("documents"))), hl.kev_catalog(t("documents")))
    return enrich.rank_vulns(rated).select("pos", "cve_id")


@query("h01_newest_first", f"SELECT pos, {fmt('pub_ts')} AS ts FROM headlines")
def _(t: Tables):
    items = t.headlines().withColumn("event_ts", times.parse_event_time(F.col("published")))
    return corpus.newest_first(items).select("pos", shown(F.col("event_ts"), "ts"))


@query("h02_page", """
SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, TRUE AS has_more FROM orders ORDER BY o_orderdate DESC, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') LIMIT 100 OFFSET 250""")
def _(t: Tables):
    orders = t("orders").select(F.col("o_orderdate").cast("timestamp").alias("event_ts"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("hash"), "o_orderkey")
    return corpus.page(orders, 250, 500).select("o_orderkey", "total", "has_more")


@query("h03_since_page", """
WITH f AS (SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01')
SELECT o_orderkey, (SELECT count(*) FROM f) AS total_new, (SELECT count(*) FROM f) > 200 AS truncated FROM f ORDER BY o_orderdate, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') LIMIT 200""")
def _(t: Tables):
    orders = t("orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("hash"), "o_orderkey")
    return corpus.since_page(orders, "1998-01-01 00:00:00", "9").select("o_orderkey", "total_new", "truncated")


@query("h05_top_k", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def _(t: Tables):
    return corpus.top_k(t("lineitem"), "l_partkey", 20)


@query("g12_keep_last", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def _(t: Tables):
    return corpus.keep_last(t.events(), [F.desc("ts"), F.desc("event_id")], 5000).select("event_id")


@query("g13_batch_caps", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10")
def _(t: Tables):
    return corpus.top_n(t.events(), ["user_id"], [F.col("ts"), F.col("event_id")], 10).select("user_id", "event_id")


@query("g07_age_bucket", f"""
SELECT pos, CASE WHEN event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 'day1' WHEN event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY THEN 'day3' ELSE 'older' END AS bucket FROM headlines""")
def _(t: Tables):
    from wirelens.operators import digest

    return timed(t).select("pos", digest.age_bucket(F.col("event_ts"), AS_OF).alias("bucket"))


@query("i03_union_tail", """
WITH k AS (SELECT o_custkey, list_sort(list(CAST(o_orderkey AS VARCHAR)))[1:35] AS keys FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(keys[greatest(len(keys) - 11, 1):], ',') AS tail FROM k""")
def _(t: Tables):
    lists = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("keys"))
    return lists.select("o_custkey", F.array_join(corpus.union_tail(F.slice("keys", 1, 10), F.slice("keys", 6, 30), 12), ",").alias("tail"))


@query("i04_cited_minus_allowed", """
WITH r AS (SELECT pos, string_agg(cve_id, ',' ORDER BY cve_id) AS rest FROM item_cves WHERE cve_id NOT IN (SELECT cve_id FROM kev) GROUP BY pos)
SELECT pos, coalesce(rest, '') AS rest FROM headlines LEFT JOIN r USING (pos)""")
def _(t: Tables):
    allowed = hl.kev_catalog(t("documents")).agg(F.collect_set("cve_id").alias("ids")).scalar()  # at most 37 ids
    rows = t.headlines().withColumn("cited", tx.cve_ids(F.concat("title", F.lit(" "), "summary"))).withColumn("allowed", allowed)
    return rows.select("pos", F.array_join(F.array_sort(corpus.cited_minus_allowed(F.col("cited"), F.col("allowed"))), ",").alias("rest"))


@query("i05_delete_absent", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t: Tables):
    keep = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.delete_absent(t("orders"), keep, ["o_custkey"]).select("o_orderkey")


@query("j15_memo_misses", """
SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1)""")
def _(t: Tables):
    docs = t("documents")
    memo = docs.filter("doc_id % 3 = 0").select(
        F.sha2(F.concat(F.lit("v1"), "text"), 256).alias("memo_key"),
        F.when(F.col("doc_id") % 2 == 1, times.as_timestamp("2024-01-20 00:00:00")).otherwise(times.as_timestamp("2023-12-01 00:00:00")).alias("cached_at"))
    return corpus.memo_misses(docs, memo, AS_OF, "v1").select("doc_id")
