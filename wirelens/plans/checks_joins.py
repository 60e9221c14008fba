"""Checked queries for joins (E), clusters and campaigns, and the windowed computations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import fixed, rules
from wirelens.functions import text as tx, times, urls
from wirelens.operators import clusters, corpus, digest, enrich, feeds, filters, grounding, joins, tagging, trends
from wirelens.plans import headlines as hl
from wirelens.plans.checks_items import fmt, lit, matches, rule_hits, shown, timed, TEXTS
from wirelens.plans.registry import AS_OF, Tables, query
from wirelens.session import cut


def rated(t: Tables):
    """Items with CVE ids, scores and known-exploited entries."""
    items = tagging.extract_cves(timed(t))
    return enrich.join_kev(enrich.join_epss(items, hl.epss_scores(t("documents"))), hl.kev_catalog(t("documents")))


RISK = """(SELECT pos, string_agg(cve_id || ':' || CAST(CAST(round(epss_score * 100) AS INTEGER) AS VARCHAR), ',' ORDER BY cve_id) AS scores,
  max(epss_score) AS epss_max_score FROM item_cves JOIN epss USING (cve_id) GROUP BY pos)"""


@query("e03_join_epss", f"""SELECT pos, scores, epss_max_score, CASE WHEN epss_max_score >= 0.5 THEN 'VERY HIGH' WHEN epss_max_score >= 0.1 THEN 'HIGH'
  WHEN epss_max_score >= 0.01 THEN 'MODERATE' WHEN epss_max_score IS NOT NULL THEN 'LOW' END AS epss_risk FROM headlines LEFT JOIN {RISK} USING (pos)""")
def _(t: Tables):
    scored = enrich.join_epss(t.headlines(), hl.epss_scores(t("documents")))
    packed = F.transform("epss_scores", lambda s: F.concat(s["cve_id"], F.lit(":"), F.round(s["epss_score"] * 100).cast("int").cast("string")))
    return scored.select("pos", F.array_join(packed, ",").alias("scores"), "epss_max_score", "epss_risk")


@query("e04_join_kev", """
WITH k AS (SELECT pos, string_agg(cve_id, ',' ORDER BY cve_id) AS ids, min(date_added) AS kev_min_date_added, bool_or(ransomware_use = 'Known') AS known
  FROM item_cves JOIN kev USING (cve_id) GROUP BY pos)
SELECT pos, ids IS NOT NULL AS kev_listed, ids, kev_min_date_added, CASE WHEN known THEN 'Known' WHEN ids IS NOT NULL THEN 'Unknown' END AS kev_ransomware_use
FROM headlines LEFT JOIN k USING (pos)""")
def _(t: Tables):
    listed = enrich.join_kev(t.headlines(), hl.kev_catalog(t("documents")))
    return listed.select("pos", "kev_listed", F.array_join(F.col("kev_entries.cve_id"), ",").alias("ids"), "kev_min_date_added", "kev_ransomware_use")


EDGES = f"""WITH {TEXTS},
edges AS (SELECT DISTINCT 'cve' AS entity_type, cve_id AS entity_name, pos FROM item_cves
  UNION SELECT 'actor', label, pos FROM ({rule_hits(rules.load('actors'), 'text', 'x')})
  UNION SELECT 'org', org, pos FROM (""" + " UNION ALL ".join(
    f"SELECT pos, regexp_extract(title, {lit(r['pattern'])}, 1) AS org FROM headlines" for r in rules.load("orgs")) + """) WHERE org <> '')
"""


@query("f05_entity_sizes", EDGES + "SELECT entity_type, entity_name, count(*) AS article_count, min(pos) AS first_pos FROM edges GROUP BY 1, 2")
def _(t: Tables):
    return clusters.entity_sizes(clusters.entity_edges(t.headlines())).select("entity_type", "entity_name", "article_count", F.col("first.pos").alias("first_pos"))


def cover_sql(only: str = "TRUE") -> str:
    """The sequential rule over the items of a condition, one entity after the other, for the checking engine."""
    orgs = " UNION ALL ".join(
        f"SELECT pos, {i} AS g, regexp_extract(title, {lit(r['pattern'])}, 1) AS org FROM headlines" for i, r in enumerate(rules.load("orgs")))
    return f"""WITH RECURSIVE {TEXTS},
raw AS (SELECT 'cve' AS entity_type, cve_id AS entity_name, pos, 0 AS kind, cve_id AS k FROM item_cves
  UNION ALL SELECT 'actor', label, pos, 1, lpad(CAST(rule AS VARCHAR), 4, '0') FROM ({rule_hits(rules.load('actors'), 'text', 'x')})
  UNION ALL SELECT 'org', org, pos, 2, lpad(CAST(g AS VARCHAR), 4, '0') FROM ({orgs}) WHERE org <> ''),
ent AS (SELECT entity_type, entity_name, list(DISTINCT pos) AS members, min((pos, kind, k)) AS head FROM raw WHERE {only} GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY len(members) DESC, head) AS r FROM ent WHERE len(members) >= 3),
step AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS covered, false AS keep
  UNION ALL SELECT n.r, CASE WHEN len(list_filter(n.members, lambda m: NOT list_contains(s.covered, m))) >= 2 THEN list_distinct(s.covered || n.members) ELSE s.covered END,
    len(list_filter(n.members, lambda m: NOT list_contains(s.covered, m))) >= 2 FROM step s JOIN ranked n ON n.r = s.r + 1),
kept AS (SELECT entity_type, entity_name, len(members) AS article_count, members FROM ranked JOIN step USING (r) WHERE keep)
"""


COVER = cover_sql()


@query("g14_greedy_cover", COVER + "SELECT entity_type, entity_name, article_count FROM kept")
def _(t: Tables):
    return clusters.greedy_cover(clusters.entity_edges(t.headlines()))


@query("f06_build_clusters", COVER + f"""
, m AS (SELECT entity_type, entity_name, article_count, unnest(members) AS pos FROM kept)
SELECT entity_type, entity_name, article_count, {fmt('min(event_ts)')} AS first_seen, least(article_count, 10) AS shown FROM m JOIN headlines USING (pos) GROUP BY ALL""")
def _(t: Tables):
    items = timed(t)
    summary, _members = clusters.build_clusters(items, clusters.entity_edges(items))
    return summary.select("entity_type", "entity_name", "article_count", shown(F.col("first_seen"), "first_seen"), F.size("articles").alias("shown"))


BIG = EDGES + """, sized AS (SELECT entity_type, entity_name, count(*) AS n FROM edges GROUP BY 1, 2 HAVING count(*) >= 3),
member AS (SELECT e.*, s.n, h.event_ts, h.hash FROM edges e JOIN sized s USING (entity_type, entity_name) JOIN headlines h USING (pos))
"""


@query("g03_cluster_preview", BIG + """
SELECT entity_type, entity_name, pos FROM member QUALIFY row_number() OVER (PARTITION BY entity_type, entity_name ORDER BY event_ts NULLS LAST, pos) <= 10""")
def _(t: Tables):
    edges = clusters.entity_edges(t.headlines())
    big = clusters.entity_sizes(edges).filter("article_count >= 3")
    members = edges.join(big.select(*clusters.ENTITY), clusters.ENTITY).join(timed(t).select("pos", "event_ts"), "pos")
    return corpus.top_n(members, clusters.ENTITY, [F.col("event_ts").asc_nulls_last(), F.col("pos")], 10).select(*clusters.ENTITY, "pos")


@query("e05_annotate_clusters", BIG + f"""
, c AS (SELECT entity_type, entity_name, any_value(n) AS n, min(event_ts) AS first_seen FROM member GROUP BY 1, 2),
b AS (SELECT hash, arg_min(entity_name, (first_seen, -c.n, entity_type, entity_name)) AS entity_name, min(first_seen) AS first_seen FROM member JOIN c USING (entity_type, entity_name) GROUP BY hash)
SELECT pos, b.entity_name, {fmt('b.first_seen')} AS first_seen FROM headlines LEFT JOIN b USING (hash)""")
def _(t: Tables):
    items = timed(t)
    edges = clusters.entity_edges(items)
    big = clusters.entity_sizes(edges).filter("article_count >= 3")
    members = edges.join(big.select(*clusters.ENTITY), clusters.ENTITY).join(items.select("pos", "hash", "event_ts"), "pos")
    dated = members.groupBy(*clusters.ENTITY).agg(F.min("event_ts").alias("first_seen")).join(big, clusters.ENTITY)
    out = clusters.annotate_clusters(items, dated, members)
    return out.select("pos", F.col("cluster.entity_name").alias("entity_name"), shown(F.col("cluster.first_seen"), "first_seen"))


def _campaigns(t: Tables):
    items = timed(t)
    summary, members = clusters.build_clusters(items, clusters.entity_edges(items))
    return clusters.upsert_campaigns(clusters.empty_campaigns(t.spark), summary, members, AS_OF), items


@query("e06_campaign_sizes", COVER + """
, h AS (SELECT sha256(entity_type || ':' || entity_name) AS h, entity_name, article_count FROM kept)
SELECT 'campaign--' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS campaign_id, entity_name, least(article_count, 500) AS articles_in_window FROM h""")
def _(t: Tables):
    campaigns, items = _campaigns(t)
    return clusters.campaign_view(campaigns, items).groupBy("campaign_id", "entity_name").agg(F.max("articles_in_window").alias("articles_in_window"))


CAMPAIGN_ID = "'campaign--' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]"


def upsert_sql() -> str:
    """Campaigns of all items, then of every second one at a later day."""
    def facts(only: str) -> str:
        return f"""({cover_sql(only)}, m AS (SELECT entity_type, entity_name, article_count, unnest(members) AS pos FROM kept)
SELECT entity_type, entity_name, article_count AS n, min(event_ts) AS f FROM m JOIN headlines USING (pos) GROUP BY ALL)"""

    known = f"coalesce(a.f, TIMESTAMP '{AS_OF}')"
    days = f"date_diff('day', {known}, TIMESTAMP '2024-02-20') - CASE WHEN CAST({known} AS TIME) > TIME '00:00:00' THEN 1 ELSE 0 END"
    return f"""SELECT {CAMPAIGN_ID} AS campaign_id, * EXCLUDE h FROM (SELECT sha256(entity_type || ':' || entity_name) AS h, entity_type, entity_name,
  {fmt(f"CASE WHEN a.n IS NULL THEN coalesce(b.f, TIMESTAMP '2024-02-20') WHEN b.n IS NULL THEN {known} ELSE least({known}, b.f) END")} AS first_observed,
  {fmt(f"CASE WHEN a.n IS NULL THEN coalesce(b.f, TIMESTAMP '2024-02-20') WHEN b.n IS NULL THEN {known} ELSE TIMESTAMP '2024-02-20' END")} AS last_observed,
  greatest(a.n, b.n) AS total_observed_articles, least(500, greatest(a.n, b.n)) AS hashes,
  CASE WHEN b.n IS NOT NULL OR {days} <= 14 THEN 'active' WHEN {days} <= 90 THEN 'dormant' ELSE 'archived' END AS status
  FROM {facts("TRUE")} a FULL JOIN {facts("pos % 2 = 0")} b USING (entity_type, entity_name))"""


@query("f07_upsert_campaigns", upsert_sql())
def _(t: Tables):
    items = timed(t)
    first, _ = _campaigns(t)
    late = items.filter("pos % 2 = 0")
    summary, members = clusters.build_clusters(late, clusters.entity_edges(late))
    merged = clusters.upsert_campaigns(first, summary, members, "2024-02-20 00:00:00")
    return merged.select("campaign_id", "entity_type", "entity_name", shown(F.col("first_observed"), "first_observed"),
                         shown(F.col("last_observed"), "last_observed"), "total_observed_articles", F.size("article_hashes").alias("hashes"), "status")


@query("e06_campaign_view", COVER + f"""
, m AS (SELECT entity_type, entity_name, unnest(list_sort(members)[-500:]) AS pos FROM kept),
j AS (SELECT sha256(entity_type || ':' || entity_name) AS h, entity_name, hash, event_ts, source FROM m JOIN headlines USING (pos))
SELECT {CAMPAIGN_ID} AS campaign_id, entity_name, row_number() OVER w AS seq, hash, first_value(source) OVER w AS first_source, count(*) OVER (PARTITION BY h) AS articles_in_window
FROM j WINDOW w AS (PARTITION BY h ORDER BY event_ts NULLS LAST, hash)""")
def _(t: Tables):
    campaigns, items = _campaigns(t)
    return clusters.campaign_view(campaigns, items).select("campaign_id", "entity_name", "seq", "hash", "first_source", "articles_in_window")


@query("e07_cve_view", f"""
WITH m AS (SELECT h.pos, h.event_ts, h.hash, h.source FROM headlines h JOIN item_cves c USING (pos) WHERE c.cve_id = 'CVE-2024-1008')
SELECT pos, (SELECT count(*) FROM m) AS article_count, (SELECT source FROM m ORDER BY event_ts, hash LIMIT 1) AS first_source,
  (SELECT epss_score FROM epss WHERE cve_id = 'CVE-2024-1008') AS epss_score FROM m""")
def _(t: Tables):
    return enrich.cve_view(rated(t), "cve-2024-1008").select("pos", "article_count", "first_source", "epss_score")


@query("g04_first_reporter", f"""
SELECT cve_id, arg_min(source, (event_ts, hash)) AS first_source, {fmt('min(event_ts)')} AS first_ts FROM item_cves JOIN headlines USING (pos) GROUP BY cve_id""")
def _(t: Tables):
    named = tagging.extract_cves(timed(t)).select(F.explode("cve_ids").alias("cve_id"), "event_ts", "source", "hash")
    return enrich.first_reporter(named, "cve_id").select("cve_id", "first_source", shown(F.col("first_ts"), "first_ts"))


CANON = "rtrim(split_part(split_part(url, '#', 1), '?', 1), '/')"


@query("e08_attach_text", f"""
WITH p AS (SELECT {CANON} AS link, arg_max(html, (length(html), html)) AS body FROM pages GROUP BY 1)
SELECT g.page_id, sha256(p.body) AS body FROM pages g JOIN p ON p.link = {CANON.replace('url', 'g.url')}""")
def _(t: Tables):
    texts = t("pages").select("url", F.col("html").alias("text"))
    return joins.attach_text(t("pages").select("page_id", F.col("url").alias("link")), texts).select("page_id", F.sha2("full_content", 256).alias("body"))


@query("e09_backfill", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'patched ' || p_brand ELSE '  ' END ELSE p_name END AS p_name FROM part""")
def _(t: Tables):
    part = t("part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_name")).alias("p_name"))
    patch = t("part").filter("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("patched "), "p_brand").alias("p_name"))
    return joins.backfill(part, patch, "p_partkey", ["p_name"])


@query("e10_silent_feeds", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _(t: Tables):
    return joins.silent_feeds(t("customer"), t("orders").filter("o_totalprice > 100000"), "c_custkey", "o_custkey").select("c_custkey")


@query("e10_prune", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def _(t: Tables):
    keep = t("customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return joins.prune(t("orders"), keep, "o_custkey").select("o_orderkey")


@query("e11_mirror", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'inserted' WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE 'same' END AS change FROM orders WHERE o_orderstatus <> 'P'""")
def _(t: Tables):
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = orders.filter("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    return joins.mirror(old, orders.filter("o_orderstatus <> 'P'"), "o_orderkey").select("o_orderkey", "change")


@query("e12_ungrounded_ids", r"""
WITH a AS (SELECT DISTINCT conv_id, upper(unnest(regexp_extract_all(text, '\b[A-Z][a-z]{4,}\b'))) AS id FROM conversations WHERE role = 'assistant'),
u AS (SELECT DISTINCT conv_id, upper(unnest(regexp_extract_all(text, '\b[A-Z][a-z]{4,}\b'))) AS id FROM conversations WHERE role = 'user')
SELECT * FROM a EXCEPT SELECT * FROM u""")
def _(t: Tables):
    c = t("conversations")
    # ASCII word boundaries, as the checking engine has them
    return joins.ungrounded_ids(c.filter("role = 'assistant'"), c.filter("role = 'user'"), "conv_id", r"(?<![A-Za-z0-9_])[A-Z][a-z]{4,}(?![A-Za-z0-9_])")


@query("e13_story_grounding")
def _(t: Tables):
    c = t("conversations")
    stories = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("story"))
    sources = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source_text"))
    return grounding.story_grounding(stories, sources, ["conv_id", "turn"]).select("conv_id", "turn", F.array_sort("missing_nouns").alias("missing"), "grounded")


@query("e13_item_grounding", """
WITH c AS (SELECT pos, list(cve_id) AS ids FROM item_cves GROUP BY pos)
SELECT a.pos, len(list_filter(coalesce(a.ids, []), lambda x: NOT list_contains(coalesce(b.ids, []), x))) AS missing_cves
FROM (SELECT pos, ids FROM headlines LEFT JOIN c USING (pos)) a LEFT JOIN c b ON b.pos = a.pos - 1""")
def _(t: Tables):
    items = t.headlines().select("pos", F.concat("title", F.lit(" "), "summary").alias("text"))
    stories = items.select("pos", F.col("text").alias("story"))
    return grounding.story_grounding(stories, items.select((F.col("pos") + 1).alias("pos"), F.col("text").alias("source_text")), ["pos"]).select(
        "pos", F.size("missing_cves").alias("missing_cves"))


@query("e14_strip_ungrounded")
def _(t: Tables):
    items = t.headlines().withColumn("body", F.concat(F.lit("Bug (CVE-2024-9999) tracked as CVE-2024-1001, noted: "), "title"))
    return grounding.strip_ungrounded(items, tx.strings(["CVE-2024-1001"])).select("pos", "body", "stripped", "publishable")


@query("e14_validate_synthesis", """
SELECT pos, CASE WHEN pos % 4 <> 0 THEN CASE WHEN length(x) > 500 THEN regexp_replace(x[1:500], '(?s)^(.*) .*$', '\\1') || '…' ELSE x END END AS synthesis
FROM (SELECT pos, trim(title) AS x FROM headlines)""")
def _(t: Tables):
    rows = t.headlines().select("pos", F.when(F.col("pos") % 4 == 0, F.concat("title", F.lit(" cve-2024-77777"))).otherwise(F.col("title")).alias("reply"),
                                F.col("summary").alias("digest"))
    return grounding.validate_synthesis(rows).select("pos", "synthesis")


@query("e15_watchlist_hits", """
WITH k AS (SELECT DISTINCT lower(p_brand) AS k FROM part WHERE p_size = 7 ORDER BY 1 LIMIT 50)
SELECT p_partkey, string_agg(k, ',' ORDER BY k) AS hits FROM part, k WHERE contains(lower(p_name || ' ' || p_brand), k) GROUP BY p_partkey""")
def _(t: Tables):
    from wirelens.sources import readers

    watch = readers.load_watchlist(t("part").filter("p_size = 7").select(F.lit("brand").alias("kind"), F.lower("p_brand").alias("keyword")))
    return joins.watchlist_hits(t("part"), watch, ("p_name", "p_brand")).filter("brand_tags is not null").select("p_partkey", F.array_join("brand_tags", ",").alias("hits"))


@query("e16_with_feed_meta", """
SELECT pos, CASE WHEN CAST(regexp_extract(source, 'src(\\d+)', 1) AS INTEGER) % 2 = 0 THEN 'native' END AS feed_kind FROM headlines""")
def _(t: Tables):
    number = F.regexp_extract("source", r"src(\d+)", 1).cast("int")
    feeds_table = t.headlines().select(F.col("source").alias("url")).distinct().withColumn("source", F.col("url")).filter(number % 2 == 0).select(
        "url", F.lit("news").alias("category"), F.lit("native").alias("kind"))
    return joins.with_feed_meta(t.headlines(), feeds_table).select("pos", "feed_kind")


@query("a08_upsert_epss", """
SELECT p_partkey AS cve_id, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 ELSE p_size END AS epss_score FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0""")
def _(t: Tables):
    part = t("part").select(F.col("p_partkey").alias("cve_id"), F.col("p_size").alias("epss_score"))
    return enrich.upsert_epss(part.filter("cve_id % 2 = 0"), part.filter("cve_id % 3 = 0").withColumn("epss_score", F.col("epss_score") * 2))


@query("f04_actor_profiles", EDGES + f"""
, m AS (SELECT entity_name AS name, count(*) AS article_count FROM edges WHERE entity_type = 'actor' GROUP BY 1 HAVING count(*) >= 2),
tech AS ({' UNION ALL '.join(f"SELECT pos, '{x}' AS id FROM x WHERE {matches('text', r)}" for r in rules.load('techniques')
   for x in ([r['technique_id'], r['technique_id'].split('.')[0]] if '.' in r['technique_id'] else [r['technique_id']]))}),
tc AS (SELECT entity_name AS name, id, count(DISTINCT pos) AS c FROM edges JOIN tech USING (pos) WHERE entity_type = 'actor' GROUP BY 1, 2),
top AS (SELECT name, id, c FROM tc QUALIFY row_number() OVER (PARTITION BY name ORDER BY c DESC, id) <= 8)
SELECT name, article_count, (SELECT string_agg(id || '=' || c, ',' ORDER BY c DESC, id) FROM top WHERE top.name = m.name) AS techniques FROM m""")
def _(t: Tables):
    profiles = clusters.actor_profiles(tagging.tag_techniques(t.headlines()))
    packed = F.transform("observed_techniques", lambda s: F.concat(s["id"], F.lit("="), s["count"].cast("string")))
    return profiles.select("name", "article_count", F.array_join(packed, ",").alias("techniques"))


@query("g06_top_tactics_per_actor", EDGES + f"""
, tech AS ({' UNION '.join(f"SELECT pos, '{r['tactic']}' AS tactic FROM x WHERE {matches('text', r)}" for r in rules.load('techniques'))}),
a AS (SELECT entity_name AS name, pos, count(*) OVER (PARTITION BY entity_name) AS n FROM edges WHERE entity_type = 'actor'),
c AS (SELECT name, tactic, count(*) AS count FROM a JOIN tech USING (pos) WHERE n >= 2 GROUP BY 1, 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY count DESC, tactic) <= 6""")
def _(t: Tables):
    return clusters.actor_profiles(tagging.tag_techniques(t.headlines())).select("name", F.inline("observed_tactics"))


BUCKETS = f"""WITH b AS (SELECT pos, event_ts, category, title, pos IN (SELECT pos FROM item_cves JOIN kev USING (cve_id)) AS kev,
  CASE WHEN event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 'day1' WHEN event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY THEN 'day3' ELSE 'older' END AS bucket0 FROM headlines),
h AS (SELECT *, bucket0 = 'day3' AND kev AND event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AS hoisted FROM b),
buckets AS (SELECT *, CASE WHEN hoisted THEN 'day1' ELSE bucket0 END AS bucket FROM h)
"""


def _buckets(t: Tables):
    items = rated(t)
    return digest.hoist_kev(items.withColumn("bucket", digest.age_bucket(F.col("event_ts"), AS_OF)), AS_OF, hours=48)


@query("g08_hoist_kev", BUCKETS + "SELECT pos, bucket, hoisted FROM buckets")
def _(t: Tables):
    return _buckets(t).select("pos", "bucket", "hoisted")


@query("g09_digest_candidates", BUCKETS + """
, s AS (SELECT *, CASE WHEN bucket = 'day1' THEN CASE WHEN hoisted THEN 1 ELSE 0 END WHEN bucket = 'day3' THEN 2 END AS sec FROM buckets WHERE bucket <> 'older'),
r AS (SELECT *, row_number() OVER (ORDER BY sec, event_ts DESC NULLS LAST, pos) AS slot, count(*) FILTER (WHERE bucket = 'day1') OVER () AS fresh FROM s)
SELECT pos, slot FROM r WHERE slot <= 200 AND (sec < 2 OR slot <= CASE WHEN fresh < 120 THEN greatest(fresh, 120) ELSE fresh END)""")
def _(t: Tables):
    return digest.digest_candidates(_buckets(t), cap=200, trigger=120, fill=120).select("pos", "slot")


@query("f27_trailing_context", BUCKETS + """
, s AS (SELECT *, CASE WHEN bucket = 'day1' THEN CASE WHEN hoisted THEN 1 ELSE 0 END WHEN bucket = 'day3' THEN 2 END AS sec FROM buckets),
r AS (SELECT *, row_number() OVER (ORDER BY sec NULLS LAST, event_ts DESC NULLS LAST, pos) AS slot, count(*) FILTER (WHERE bucket = 'day1') OVER () AS fresh FROM s),
d AS (SELECT pos FROM r WHERE slot <= 40 AND sec IS NOT NULL AND (sec < 2 OR slot <= CASE WHEN fresh < 30 THEN greatest(fresh, 30) ELSE fresh END))
SELECT category, count(*) AS n FROM buckets WHERE bucket <> 'day1' AND pos NOT IN (SELECT pos FROM d) GROUP BY category ORDER BY n DESC, category LIMIT 5""")
def _(t: Tables):
    rows = _buckets(t)
    return digest.trailing_context(rows, digest.digest_candidates(rows))["categories"]


@query("f26_kev_alerts", """
WITH p AS (SELECT pos, title, k.cve_id, k.date_added FROM item_cves c JOIN kev k USING (cve_id) JOIN headlines USING (pos)),
g AS (SELECT cve_id, min(date_added) AS date_added, count(*) AS articles, array_to_string(list(title ORDER BY pos)[1:2], '|') AS titles FROM p
  WHERE date_added >= '2024-01-17' AND cve_id <> 'CVE-2024-1018' GROUP BY cve_id)
SELECT * FROM g ORDER BY cve_id LIMIT 5""")
def _(t: Tables):
    already = hl.kev_catalog(t("documents")).filter("cve_id = 'CVE-2024-1018'").select("cve_id")
    alerts, _marks = enrich.kev_alerts(rated(t), already, AS_OF)
    return alerts.select("cve_id", "date_added", "articles", F.array_join("titles", "|").alias("titles"))


COUNTS = "WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2)"


@query("f01_daily_counts", COUNTS + " SELECT CAST(day AS VARCHAR) AS day, 'category' AS kind, key, n FROM c")
def _(t: Tables):
    return trends.daily_counts(t.events(), "event_type", "category").withColumn("day", F.col("day").cast("string"))


@query("f02_keyword_counts", f"""WITH {TEXTS}, h AS ({rule_hits(rules.load('keywords'), 'text', 'x')})
SELECT CAST(CAST(event_ts AS DATE) AS VARCHAR) AS day, label AS key, count(*) AS n FROM h JOIN headlines USING (pos) GROUP BY 1, 2""")
def _(t: Tables):
    return trends.keyword_counts(timed(t), "event_ts").select(F.col("day").cast("string").alias("day"), "key", "n")


@query("f03_trend_report", COUNTS + """
SELECT key, sum(n) FILTER (WHERE day >= DATE '2024-01-21') AS n_7d, sum(n) AS n_30d FROM c WHERE day >= DATE '2023-12-29' GROUP BY key""")
def _(t: Tables):
    return trends.trend_report(trends.daily_counts(t.events(), "event_type", "category"), "2024-01-28")["categories"].select("key", "n_7d", "n_30d")


@query("g01_spikes", """
WITH c AS (SELECT CAST(ts AS DATE) AS day, 'u' || user_id AS key, count(*) AS n FROM events GROUP BY 1, 2),
d AS (SELECT DISTINCT day FROM c WHERE day < DATE '2024-01-28' ORDER BY day DESC LIMIT 14),
s AS (SELECT key, coalesce(sum(n) FILTER (WHERE day = DATE '2024-01-28'), 0) AS today_count, coalesce(sum(n) FILTER (WHERE day IN (SELECT day FROM d)), 0) AS past FROM c GROUP BY key)
SELECT key, CASE WHEN past = 0 THEN 'new_emergence' ELSE 'tracked_keyword' END AS type, today_count, past / 14 AS avg_count,
  CASE WHEN past = 0 THEN today_count ELSE today_count / (past / 14) END AS spike_ratio
FROM s WHERE today_count >= 3 AND (past = 0 OR today_count >= past / 14 * 2)""")
def _(t: Tables):
    users = t.events().withColumn("key0", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return trends.spikes(cut(trends.daily_counts(users, "key0", "tracked_keyword")), "2024-01-28")


@query("flagship_category_spikes", f"""
WITH k AS (SELECT category, CAST(event_ts AS DATE) AS day FROM headlines QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos) = 1),
c AS (SELECT day, category AS key, count(*) AS n FROM k GROUP BY 1, 2),
d AS (SELECT DISTINCT day FROM c WHERE day < DATE '2024-01-18' ORDER BY day DESC LIMIT 14),
s AS (SELECT key, coalesce(sum(n) FILTER (WHERE day = DATE '2024-01-18'), 0) AS today_count, coalesce(sum(n) FILTER (WHERE day IN (SELECT day FROM d)), 0) AS past FROM c GROUP BY key)
SELECT key, 'category' AS type, today_count, past / (SELECT count(*) FROM d) AS avg_count, today_count / (past / (SELECT count(*) FROM d)) AS spike_ratio
FROM s WHERE today_count >= 3 AND past > 0 AND today_count >= past / (SELECT count(*) FROM d) * 2""")
def _(t: Tables):
    kept = corpus.keep_first(timed(t), ["title"], [F.col("pos")])
    return trends.spikes(cut(trends.daily_counts(kept, "category", "category", "event_ts")), "2024-01-18")


@query("g11_escalations", """
WITH l AS (SELECT user_id, date_trunc('hour', ts) AS hour, arg_max((['LOW', 'GUARDED', 'MODERATE', 'ELEVATED', 'CRITICAL'])[CAST(event_id % 5 AS INTEGER) + 1], ts) AS level FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY hour) AS previous_level FROM l),
r AS (SELECT *, list_position(['LOW', 'GUARDED', 'MODERATE', 'ELEVATED', 'CRITICAL'], level) - list_position(['LOW', 'GUARDED', 'MODERATE', 'ELEVATED', 'CRITICAL'], previous_level) AS d FROM p)
SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, level, previous_level, CASE WHEN d IS NULL THEN 'first' WHEN d > 0 THEN 'escalation' WHEN d < 0 THEN 'de-escalation' ELSE 'same' END AS change FROM r""")
def _(t: Tables):
    levels = t.events().withColumn("level", F.get(tx.strings(["LOW", "GUARDED", "MODERATE", "ELEVATED", "CRITICAL"]), (F.col("event_id") % 5).cast("int")))
    return trends.escalations(levels, "user_id").select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "level", "previous_level", "change")


FETCHES = """WITH e AS (SELECT user_id AS url, ts, event_id, event_type <> 'error' AS success, CASE WHEN event_type IN ('click', 'purchase') AND user_id % 10 <> 3 THEN CAST(value AS INTEGER) + 1 ELSE 0 END AS n FROM events),
ok AS (SELECT url, max((ts, event_id)) FILTER (WHERE success AND n > 0) AS m FROM e GROUP BY url)
"""


def fetch_events(t: Tables):
    """Events read as feed fetches: errors fail, some event types bring entries."""
    brings = F.col("event_type").isin("click", "purchase") & (F.col("user_id") % 10 != 3)
    return t.events().select(F.col("user_id").alias("url"), "ts", "event_id", (F.col("event_type") != "error").alias("success"),
                             F.when(brings, F.col("value").cast("int") + 1).otherwise(0).alias("entry_count"))


@query("g15_error_streaks", FETCHES.replace("CAST(value AS INTEGER)", "CAST(trunc(value) AS INTEGER)") + """
SELECT e.url, count(*) AS consecutive_errors, strftime(min(e.ts), '%Y-%m-%d %H:%M:%S') AS first_error
FROM e JOIN ok USING (url) WHERE NOT e.success AND (ok.m IS NULL OR (e.ts, e.event_id) > ok.m) GROUP BY e.url""")
def _(t: Tables):
    return feeds.error_streaks(fetch_events(t), AS_OF).select("url", "consecutive_errors", shown(F.col("first_error"), "first_error"))


@query("f09_health_report", FETCHES.replace("CAST(value AS INTEGER)", "CAST(trunc(value) AS INTEGER)") + """
, l AS (SELECT e.*, ok.m FROM e JOIN ok USING (url) WHERE ok.m IS NULL OR (e.ts, e.event_id) > ok.m),
s AS (SELECT ok.url, ok.m, min(l.ts) FILTER (WHERE NOT l.success) AS fe, max((l.ts, l.event_id)) FILTER (WHERE NOT l.success) AS le, max((l.ts, l.event_id)) FILTER (WHERE l.success) AS lq FROM ok LEFT JOIN l USING (url) GROUP BY ALL),
k AS (SELECT url, count(*) FILTER (WHERE success) AS succ FROM e GROUP BY url),
st AS (SELECT s.url, CASE WHEN lq IS NOT NULL AND (le IS NULL OR lq > le) AND m IS NULL AND succ >= 10 THEN 'silent'
   WHEN le IS NULL THEN 'ok' WHEN epoch(le[1]) - epoch(fe) >= 7 * 86400 THEN 'dead' WHEN epoch(le[1]) - epoch(fe) >= 3 * 86400 THEN 'suspect' ELSE 'error' END AS status FROM s JOIN k USING (url))
SELECT count(*) AS total_tracked, count_if(status = 'ok') AS ok, count_if(status = 'error') AS error, count_if(status = 'suspect') AS suspect,
  count_if(status = 'stale') AS stale, count_if(status = 'silent') AS silent, count_if(status = 'dead') AS dead FROM st""")
def _(t: Tables):
    return feeds.health_report(feeds.feed_health(fetch_events(t)))


@query("f08_signal_scores", FETCHES.replace("CAST(value AS INTEGER)", "CAST(trunc(value) AS INTEGER)") + """
, l AS (SELECT e.*, ok.m FROM e JOIN ok USING (url) WHERE ok.m IS NULL OR (e.ts, e.event_id) > ok.m),
s AS (SELECT ok.url, ok.m, min(l.ts) FILTER (WHERE NOT l.success) AS fe, max((l.ts, l.event_id)) FILTER (WHERE NOT l.success) AS le, max((l.ts, l.event_id)) FILTER (WHERE l.success) AS lq FROM ok LEFT JOIN l USING (url) GROUP BY ALL),
k AS (SELECT url, count(*) AS total, count(*) FILTER (WHERE success) AS succ, sum(CASE WHEN success THEN n ELSE 0 END) AS entries FROM e GROUP BY url),
st AS (SELECT s.url, total, succ, entries, CASE WHEN lq IS NOT NULL AND (le IS NULL OR lq > le) AND m IS NULL AND succ >= 10 THEN 'silent'
   WHEN le IS NULL THEN 'ok' WHEN epoch(le[1]) - epoch(fe) >= 7 * 86400 THEN 'dead' WHEN epoch(le[1]) - epoch(fe) >= 3 * 86400 THEN 'suspect' ELSE 'error' END AS status FROM s JOIN k USING (url))
SELECT url, status, total AS fetches_total, succ AS fetches_successful, CAST(entries AS BIGINT) AS entries_total, coalesce(entries / nullif(succ, 0), 0) AS avg_entries_per_fetch,
  coalesce(succ / total * least(entries / nullif(succ, 0) / 20, 1.0) * CASE status WHEN 'ok' THEN 1.0 WHEN 'error' THEN 0.7 WHEN 'suspect' THEN 0.5 WHEN 'stale' THEN 0.3 WHEN 'silent' THEN 0.2 ELSE 0.1 END * 100, 0) AS signal_score FROM st""")
def _(t: Tables):
    return feeds.signal_scores(feeds.feed_health(fetch_events(t))).select("url", "status", "fetches_total", "fetches_successful", "entries_total", "avg_entries_per_fetch", "signal_score")


@query("f08_signal_scores_part", """
SELECT l_suppkey AS url, (count_if(l_returnflag <> 'R') / count(*)) * least(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INTEGER) ELSE 0 END) / count_if(l_returnflag <> 'R') / 20, 1.0) * 0.7 * 100 AS signal_score
FROM lineitem GROUP BY 1""")
def _(t: Tables):
    fine = F.col("l_returnflag") != "R"
    health = t("lineitem").groupBy(F.col("l_suppkey").alias("url")).agg(
        F.count("*").alias("fetches_total"), F.count_if(fine).alias("fetches_successful"),
        F.sum(F.when(fine, F.col("l_quantity").cast("int")).otherwise(0)).alias("entries_total")).withColumn("status", F.lit("error"))
    return feeds.signal_scores(health).select("url", "signal_score")
