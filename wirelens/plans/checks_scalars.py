"""Checked queries for the scalar columns (section B) and array operators (section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import fixed
from wirelens.functions import bands, jsonfix, net, regions, text, times, urls
from wirelens.plans.registry import AS_OF, Tables, query
from wirelens.session import spread

STOP = ", ".join(f"'{w}'" for w in fixed.TITLE_STOP_WORDS)
# the title normal form written once for the checking engine, as a scalar over column x
NORM = (
    "trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g'), '^breaking:\\s*', ''), '^update:\\s*', ''),"
    " '^exclusive:\\s*', ''), '^just in:\\s*', ''), '^alert:\\s*', ''),"
    " '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g'))"
)


@query("b01_canonical_url", "SELECT page_id, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') AS canonical FROM pages")
def _(t: Tables):
    return t("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("b02_is_clearnet", """
WITH u AS (SELECT page_id, url FROM pages
  UNION ALL SELECT page_id + 1000000, replace(url, '.example.', '.onion.example.') FROM pages
  UNION ALL SELECT page_id + 2000000, regexp_replace(url, '\\.(com|net|org)/', '.onion/') FROM pages
  UNION ALL SELECT page_id + 3000000, regexp_replace(url, '^https?', 'ftp') FROM pages)
SELECT page_id, coalesce((url LIKE 'http://%' OR url LIKE 'https://%')
  AND split_part(split_part(url, '/', 3), ':', 1) <> ''
  AND NOT split_part(url, '/', 3) LIKE '%.onion' AND NOT split_part(url, '/', 3) LIKE '%.i2p', FALSE) AS clearnet FROM u""")
def _(t: Tables):
    p = t("pages").select("page_id", "url")
    variants = p.select(F.inline(F.array(
        F.struct("page_id", "url"),
        F.struct((F.col("page_id") + 1000000).alias("page_id"), F.replace("url", F.lit(".example."), F.lit(".onion.example.")).alias("url")),
        F.struct((F.col("page_id") + 2000000).alias("page_id"), F.regexp_replace("url", r"\.(com|net|org)/", ".onion/").alias("url")),
        F.struct((F.col("page_id") + 3000000).alias("page_id"), F.regexp_replace("url", "^https?", "ftp").alias("url")),
    )))
    return variants.select("page_id", urls.is_clearnet(F.col("url")).alias("clearnet"))


@query("b03_embedded_url", """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url_decode(regexp_extract(
  'https://redirect.example.com/?x=1&url=' || url_encode(url) || '&y=2', '[?&]url=([^&#]+)', 1)) END AS target FROM pages""")
def _(t: Tables):
    wrapped = F.when(F.col("page_id") % 3 != 0, F.concat(
        F.lit("https://redirect.example.com/?x=1&url="), F.url_encode("url"), F.lit("&y=2"))).otherwise(F.lit("https://redirect.example.com/?x=1"))
    return t("pages").select("page_id", urls.embedded_url(wrapped).alias("target"))


@query("b04_unwrap_link", """
SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN regexp_extract(url, 'https?://[a-zA-Z0-9\\-._~:/?#\\[\\]@!$&''()*+,;=%]+') END AS target FROM pages""")
def _(t: Tables):
    inside = F.concat(F.unhex(F.lit("0813220a")), F.encode("url", "utf-8"), F.unhex(F.lit("d20100")))
    segment = F.translate(F.rtrim(F.translate(F.base64(inside), "=\r\n", " ")), "+/", "-_")
    link = F.when(F.col("page_id") % 4 != 0, F.concat(
        F.lit("https://news.google.com/rss/articles/"), segment, F.lit("?hl=en"))).otherwise(F.col("url"))
    return t("pages").select("page_id", urls.unwrap_link(link).alias("target"))


@query("b05_first_href", """
WITH h AS (SELECT page_id, regexp_extract_all(html || '<a class="o" href="' || url || '">x</a><a href=''https://z.example''>z</a>',
  '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS hrefs FROM pages)
SELECT page_id, list_filter(hrefs, lambda x: starts_with(x, 'http') AND NOT contains(x, 'news.google.com'))[1] AS href FROM h""")
def _(t: Tables):
    html = F.concat("html", F.lit('<a class="o" href="'), "url", F.lit("\">x</a><a href='https://z.example'>z</a>"))
    return t("pages").select("page_id", urls.first_href(html).alias("href"))


@query("b06_content_hash", "SELECT pos, CASE WHEN pos % 7 = 0 THEN 'given' || pos ELSE hash END AS hash FROM headlines")
def _(t: Tables):
    given = F.when(F.col("pos") % 7 == 0, F.concat(F.lit("given"), F.col("pos").cast("string")))
    return t.headlines().select("pos", urls.content_hash(F.col("title"), F.col("link"), given).alias("hash"))


@query("b07_normalize_title", f"""
WITH x AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN '  BREAKING: Update: ' WHEN doc_id % 3 = 1 THEN 'Just in:' ELSE '' END) || text AS t FROM documents)
SELECT doc_id, {NORM.format(x='t')} AS normalized FROM x""")
def _(t: Tables):
    prefix = F.when(F.col("doc_id") % 3 == 0, "  BREAKING: Update: ").when(F.col("doc_id") % 3 == 1, "Just in:").otherwise("")
    return t("documents").select("doc_id", text.normalize_title(F.concat(prefix, "text")).alias("normalized"))


@query("b08_word_shingles", f"""
WITH n AS (SELECT doc_id, list_filter(string_split({NORM.format(x='text')}, ' '), lambda w: w <> '' AND w NOT IN ({STOP})) AS w FROM documents),
s AS (SELECT doc_id, unnest(w) AS s FROM n UNION
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM n)
SELECT n.doc_id, count(s.s) AS shingles, len(any_value(w)) AS words, coalesce(min(s.s), '') AS lowest, coalesce(max(s.s), '') AS highest
FROM n LEFT JOIN s USING (doc_id) GROUP BY n.doc_id""")
def _(t: Tables):
    return text.with_shingles(t("documents").select("doc_id", "text"), "text").select(
        "doc_id", F.size("shingles").cast("long").alias("shingles"), F.size("words").cast("long").alias("words"),
        F.coalesce(F.array_min("shingles"), F.lit("")).alias("lowest"), F.coalesce(F.array_max("shingles"), F.lit("")).alias("highest"))


@query("b09_overlap_coefficient", f"""
WITH n AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({NORM.format(x='text')}, ' '), lambda w: w <> '' AND w NOT IN ({STOP}))) AS w FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN least(len(a.w), len(b.w)) = 0 THEN 0.0
  ELSE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) END AS overlap
FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def _(t: Tables):
    words = t("conversations").select("conv_id", "turn", F.array_distinct(text.content_words(text.normalize_title(F.col("text")))).alias("w"))
    prior = words.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v"))
    return words.join(prior, ["conv_id", "turn"]).select("conv_id", "turn", text.overlap_coefficient(F.col("w"), F.col("v")).alias("overlap"))


@query("b10_parse_event_time", "SELECT pos, strftime(pub_ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM headlines")
def _(t: Tables):
    return t.headlines().select("pos", F.date_format(times.parse_event_time(F.col("published")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("b11_event_time", """
SELECT pos, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_time,
  strftime(least(event_ts, TIMESTAMP '2024-01-15 00:00:00'), '%Y-%m-%d %H:%M:%S') AS earliest FROM headlines""")
def _(t: Tables):
    ts = times.event_time(F.col("published"), F.col("ingested_at"))
    return t.headlines().select(
        "pos", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.date_format(times.earliest(ts, F.lit(None).cast("timestamp"), times.as_timestamp("2024-01-15 00:00:00")), "yyyy-MM-dd HH:mm:ss").alias("earliest"))


@query("b12_collapse_regions", """
WITH r AS (SELECT pos, list_sort(list_distinct(list_filter(string_split(feed_region, ',') || ['Global', 'US'], lambda x: x <> 'Global'))) AS l FROM headlines)
SELECT pos, CASE WHEN len(l) BETWEEN 1 AND 2 THEN array_to_string(l, ',') ELSE 'Global' END AS region FROM r""")
def _(t: Tables):
    labels = F.concat(regions.split_regions(F.col("feed_region")), text.strings(["Global", "US"]))
    return t.headlines().select("pos", regions.collapse_regions(labels).alias("region"))


@query("b13_country_to_region", """
WITH c AS (SELECT c_custkey, (['us', 'DE', ' Japan ', 'Brazil', 'il', 'zz', 'South Africa', NULL, 'Atlantis', 'mx'])[c_nationkey % 10 + 1] AS country FROM customer)
SELECT c_custkey, CASE lower(trim(country)) WHEN 'us' THEN 'US' WHEN 'de' THEN 'Europe' WHEN 'japan' THEN 'APAC' WHEN 'brazil' THEN 'LATAM'
  WHEN 'il' THEN 'Middle East' WHEN 'south africa' THEN 'Europe' WHEN 'mx' THEN 'LATAM' ELSE 'Global' END AS region FROM c""")
def _(t: Tables):
    names = F.array(*[F.lit(v) for v in ("us", "DE", " Japan ", "Brazil", "il", "zz", "South Africa", None, "Atlantis", "mx")])
    rows = t("customer").select("c_custkey", F.get(names, F.col("c_nationkey") % 10).alias("country"))
    return regions.country_to_region(rows, "country", regions.country_lookup(t.spark)).select("c_custkey", "region")


@query("b14_refang", """
SELECT doc_id, replace(replace(text, 'fang', 'fang'), '[.]', '.') AS text FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'http://evil.example.com/' || text ELSE 'a@b.example ' || text END AS text FROM documents)""")
def _(t: Tables):
    defanged = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("hXXp://evil[.]example(.)com[/]"), "text")).otherwise(
        F.concat(F.lit("a[at]b{.}example "), "text"))
    from wirelens.operators import tagging
    return t("documents").select("doc_id", tagging.refang(defanged).alias("text"))


@query("b15_lead_summary", """
WITH p AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents),
l AS (SELECT doc_id, array_to_string(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' ') AS l FROM p)
SELECT doc_id, CASE WHEN length(l) > 500 THEN l[1:497] || '...' ELSE l END AS summary FROM l""")
def _(t: Tables):
    return t("documents").select("doc_id", text.lead_summary(F.col("text")).alias("summary"))


@query("b16_bands", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity / 5 >= 9 THEN 'CRITICAL' WHEN l_quantity / 5 >= 7 THEN 'HIGH' WHEN l_quantity / 5 >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN l_discount * 6 >= 0.5 THEN 'VERY HIGH' WHEN l_discount * 6 >= 0.1 THEN 'HIGH' WHEN l_discount * 6 >= 0.01 THEN 'MODERATE' ELSE 'LOW' END AS risk,
  CASE WHEN date_diff('day', l_shipdate, TIMESTAMP '1998-12-01') <= 14 THEN 'active'
       WHEN date_diff('day', l_shipdate, TIMESTAMP '1998-12-01') <= 90 THEN 'dormant' ELSE 'archived' END AS status FROM lineitem""")
def _(t: Tables):
    shipped = F.col("l_shipdate").cast("timestamp")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", bands.severity(F.col("l_quantity") / 5).alias("severity"),
        bands.epss_risk(F.col("l_discount") * 6).alias("risk"),
        bands.campaign_status(shipped, times.as_timestamp("1998-12-01 00:00:00")).alias("status"))


@query("b17_title_key", """
SELECT pos, regexp_replace(regexp_replace(lower(trim(title)), '^(.*) - .*$', '\\1'), '^(.*) \\| .*$', '\\1') AS key
FROM (SELECT pos, title || (CASE WHEN pos % 2 = 0 THEN ' | Net - Desk' WHEN pos % 3 = 0 THEN ' - Wire | Net' ELSE '' END) AS title FROM headlines)""")
def _(t: Tables):
    suffix = F.when(F.col("pos") % 2 == 0, " | Net - Desk").when(F.col("pos") % 3 == 0, " - Wire | Net").otherwise("")
    return t.headlines().select("pos", text.title_key(F.concat("title", suffix)).alias("key"))


@query("b18_source_name", """
WITH h AS (SELECT page_id, split_part(replace(replace(lower(split_part(split_part(url, '/', 3), '?', 1)), 'www.', ''), 'feeds.', ''), '.', 1) AS l FROM pages)
SELECT page_id, upper(l[1]) || lower(l[2:]) AS source_name FROM h""")
def _(t: Tables):
    return t("pages").select("page_id", urls.source_name(F.col("url")).alias("source_name"))


@query("b19_tolerant_json", """
SELECT event_id, (['strict', 'repaired', 'repaired', 'block', 'quarantine'])[event_id % 5 + 1] AS step,
  CASE WHEN event_id % 5 IN (2, 4) THEN NULL ELSE CAST(props->>'k' AS INTEGER) END AS k FROM events""")
def _(t: Tables):
    i, props = F.col("event_id") % 5, F.col("props")
    raw = (F.when(i == 0, props).when(i == 1, F.regexp_replace(props, "}$", ", }")).when(i == 2, F.lit('{"k": None}'))
           .when(i == 3, F.concat(F.lit("Answer: "), props, F.lit(" done"))).otherwise(F.lit("no json here")))
    parsed = jsonfix.tolerant_json(spread(t("events")).select("event_id", raw.alias("raw")), "raw")
    return parsed.select("event_id", F.col("parsed_from").alias("step"), F.try_variant_get("parsed", "$.k", "int").alias("k"))


@query("b20_enum_normalisation", """
WITH w AS (SELECT o_orderkey, (['critical', ' High', 'SEVERE', 'medium', 'low', 'extreme', 'urgent', NULL])[o_orderkey % 8 + 1] AS x,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'critical threat' WHEN o_orderpriority LIKE '2%' THEN 'severe' ELSE o_orderpriority END AS s FROM orders)
SELECT o_orderkey, CASE upper(trim(x)) WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'LOW' THEN 'LOW' WHEN 'HIGH' THEN 'ELEVATED' WHEN 'SEVERE' THEN 'ELEVATED'
    WHEN 'MEDIUM' THEN 'MODERATE' WHEN 'EXTREME' THEN 'CRITICAL' ELSE 'MODERATE' END AS level,
  CASE WHEN upper(trim(x)) IN ('CRITICAL', 'LOW') THEN 'model' WHEN upper(trim(x)) IN ('HIGH', 'SEVERE', 'MEDIUM', 'EXTREME') THEN 'model_alias'
    ELSE 'fallback_invalid' END AS source,
  CASE WHEN contains(upper(s), 'CRITICAL') THEN 'CRITICAL' WHEN regexp_matches(upper(s), 'HIGH|SEVERE|ELEVATED') THEN 'HIGH' ELSE 'MODERATE' END AS significance FROM w""")
def _(t: Tables):
    words = F.array(*[F.lit(v) for v in ("critical", " High", "SEVERE", "medium", "low", "extreme", "urgent", None)])
    raw = F.get(words, (F.col("o_orderkey") % 8).cast("int"))
    sig = (F.when(F.col("o_orderpriority").startswith("1"), "critical threat")
           .when(F.col("o_orderpriority").startswith("2"), "severe").otherwise(F.col("o_orderpriority")))
    return t("orders").select("o_orderkey", bands.normalize_level(raw).alias("n"), bands.normalize_significance(sig).alias("significance")) \
        .select("o_orderkey", "n.level", "n.source", "significance")


@query("b21_clip_headline", """
WITH c AS (SELECT pos, trim(title || ', ' || summary) AS x FROM headlines),
k AS (SELECT pos, x, x[1:160] AS cut, regexp_extract(x[1:160], '(?s)^(.*)[,;.] ', 1) AS head FROM c)
SELECT pos, CASE WHEN length(x) <= 160 THEN x WHEN length(head) >= 100 THEN head || '…' ELSE rtrim(cut, chr(32) || chr(10) || chr(9) || chr(13)) || '…' END AS clipped FROM k""")
def _(t: Tables):
    return t.headlines().select("pos", text.clip_headline(F.concat("title", F.lit(", "), "summary")).alias("clipped"))


@query("b22_mask_secret", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'unknown' ELSE c_name[1:8] || '…' END AS masked FROM customer")
def _(t: Tables):
    return t("customer").select("c_custkey", text.mask_secret(F.when(F.col("c_custkey") % 10 != 0, F.col("c_name"))).alias("masked"))


@query("b23_typed_id", """
WITH h AS (SELECT o_orderkey, sha256('order' || o_orderkey) AS h FROM orders)
SELECT o_orderkey, 'report--' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id FROM h""")
def _(t: Tables):
    return t("orders").select("o_orderkey", text.typed_id("report", F.concat(F.lit("order"), F.col("o_orderkey").cast("string"))).alias("id"))


@query("b24_time_slugs", """
SELECT event_id, strftime(ts, '%Y-%m-%d_%H') AS hour_slug, strftime(ts, '%Y-%m-%d') AS day_slug, strftime(ts, '%Y-W%U') AS week_slug,
  strftime(ts, '%Y-%m') AS month_slug, strftime(ts, '%Y') AS year_slug FROM events""")
def _(t: Tables):
    return t.events().select("event_id", *[times.time_slug(F.col("ts"), u).alias(f"{u}_slug") for u in ("hour", "day", "week", "month", "year")])


@query("b25_reporting_window", """
WITH d AS (SELECT count(DISTINCT published[1:10]) AS days, min(published[1:10]) AS first_day, max(published[1:10]) AS last_day
  FROM headlines WHERE regexp_matches(published, '^\\d{4}'))
SELECT days, first_day, last_day, 'Last ' || days || ' days (' || first_day || ' to ' || last_day || ')' AS label FROM d""")
def _(t: Tables):
    return times.reporting_window(t.headlines())


def _profile_sql() -> str:
    union = " UNION ALL ".join(f"SELECT '{lang}' AS language, unnest({list(words)!r}) AS word" for lang, words in text.LANGUAGE_PROFILES.items())
    return f"""
WITH p AS ({union}),
w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM documents),
s AS (SELECT doc_id, language, count(*) AS hits FROM w JOIN p USING (word) GROUP BY ALL),
b AS (SELECT doc_id, arg_min(language, (-hits, language)) AS language FROM s GROUP BY doc_id)
SELECT d.doc_id, b.language FROM documents d LEFT JOIN b USING (doc_id)"""


@query("b26_tag_language", _profile_sql())
def _(t: Tables):
    return text.tag_language(t("documents")).select("doc_id", "language")


@query("b27_payload_round_trip", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def _(t: Tables):
    part = t("part").withColumn("full_content", F.lit("hidden"))
    packed = text.to_payload(part).select("payload")
    return packed.select(F.from_json("payload", "p_partkey long, p_name string, p_brand string, p_size int, full_content string").alias("r")) \
        .filter("r.full_content is null").select("r.p_partkey", "r.p_name", "r.p_brand", "r.p_size")


@query("b28_digest_line", """
SELECT pos, '[' || pos || '] [' || category || '] [' || feed_region || '] ' || title
  || chr(10) || '    ' || concat_ws(' | ', 'Source: Src', 'Published: ' || published[1:16],
     CASE WHEN pos % 4 = 0 THEN 'CVE: CVE-2024-' || (1000 + pos % 37) END,
     CASE WHEN pos % 2 = 0 THEN 'KEV-listed 2024-01-05' || (CASE WHEN pos % 6 = 0 THEN ' (ransomware-linked)' ELSE '' END) END,
     CASE WHEN pos % 3 = 0 THEN 'ATT&CK: Impact, Execution' END)
  || (CASE WHEN trim(summary, ' ') = '' THEN '' ELSE chr(10) || '    ' || summary END) AS line FROM headlines""")
def _(t: Tables):
    p = F.col("pos")
    items = t.headlines().select(
        "pos", "title", "category", "feed_region", "published", "summary", F.lit("Src").alias("source_name"), F.lit("").alias("translated_title"),
        F.when(p % 4 == 0, F.concat(F.lit("CVE-2024-"), (1000 + p % 37).cast("string"))).alias("cve_id"),
        F.lit(None).cast("double").alias("cvss_score"), F.lit(0.0).alias("epss_max_score"), F.lit("LOW").alias("epss_risk"),
        (p % 2 == 0).alias("kev_listed"), F.lit("2024-01-05").alias("kev_min_date_added"),
        F.when(p % 6 == 0, "Known").otherwise("Unknown").alias("kev_ransomware_use"),
        F.when(p % 3 == 0, text.strings(["Impact", "Execution"])).alias("attack_tactics"))
    return items.select("pos", text.digest_line(p).alias("line"))


@query("b29_stix_literal", """
WITH i AS (SELECT pos, (['md5_hash', 'ip:port', 'domain', 'url', 'other'])[pos % 5 + 1] AS kind, title || '[x]''' AS v FROM headlines),
s AS (SELECT pos, kind, regexp_replace(v, '[''\\\\\\[\\]]', '', 'g') AS v FROM i)
SELECT pos, CASE kind WHEN 'md5_hash' THEN '[file:hashes.''MD5'' = ''' || v || ''']'
  WHEN 'ip:port' THEN '[network-traffic:dst_ref.type = ''ipv4-addr'' AND network-traffic:dst_ref.value = ''' || split_part(v, ':', 1) || ''']'
  WHEN 'domain' THEN '[domain-name:value = ''' || v || ''']' WHEN 'url' THEN '[url:value = ''' || v || ''']' END AS pattern FROM s""")
def _(t: Tables):
    kinds = text.strings(["md5_hash", "ip:port", "domain", "url", "other"])
    return t.headlines().select("pos", text.stix_pattern(F.get(kinds, (F.col("pos") % 5).cast("int")), F.concat("title", F.lit("[x]'"))).alias("pattern"))


@query("c05_is_public_ip", """
WITH i AS (SELECT event_id, [event_id * 7 % 256, event_id * 13 % 256, event_id * 29 % 256, event_id % 256] AS o FROM events),
n AS (SELECT event_id, o, o[1]*16777216 + o[2]*65536 + o[3]*256 + o[4] AS n FROM i)
SELECT event_id, NOT (o[1] IN (0, 10, 127) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31)
  OR (n BETWEEN 3221225472 AND 3221225479) OR n IN (3221225642, 3221225643) OR (o[1] = 192 AND o[2] = 0 AND o[3] = 2)
  OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100)
  OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113) OR o[1] >= 224 OR n IN (16909060, 67305985)) AS public FROM n""")
def _(t: Tables):
    e = F.col("event_id")
    ip = F.concat_ws(".", *[(x % 256).cast("string") for x in (e * 7, e * 13, e * 29, e)])
    return t("events").select("event_id", net.is_public_ip(ip).alias("public"))


@query("i02_region_sets", """
WITH r AS (SELECT pos, string_split(feed_region, ',') AS l FROM headlines),
u AS (SELECT pos, l, list_sort(list_distinct(list_filter(l || ['Europe', 'US'], lambda x: x <> 'Global'))) AS m FROM r)
SELECT pos, CASE WHEN list_contains(l, 'Global') THEN 'Global' WHEN len(m) > 2 THEN 'Global' ELSE array_to_string(m, ',') END AS merged,
  array_to_string(list_sort(list_filter(l, lambda x: x NOT IN ('US', 'Japan'))), ',') AS rest FROM u""")
def _(t: Tables):
    label = F.col("feed_region")
    return t.headlines().select(
        "pos", regions.union_regions(label, F.lit("Europe,US")).alias("merged"),
        F.array_join(F.array_sort(F.array_except(regions.split_regions(label), text.strings(["US", "Japan"]))), ",").alias("rest"))
