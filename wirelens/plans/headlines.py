"""News items derived from the documents table by arithmetic on doc_id.

The documents are invented words, so security rules would never fire on them;
each becomes one item with a templated title and its whole text as summary.
``ORACLE_WITH`` states the same view for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelens.functions import urls

TEMPLATES = (
    "{who} ransomware gang lists {org} as new victim in {place}",
    "{org} confirms data breach exposing customer records in {place}",
    "Breaking: zero-day in {org} VPN appliance exploited in the wild",
    "{place} hospital systems offline after ransomware attack by {who}",
    "State-sponsored group {who} targets {org} staff with phishing",
    "New infostealer malware spreads through fake {org} installer",
    "Patch Tuesday: {org} security update fixes remote code execution",
    "DDoS attack knocks {place} government portal offline",
    "Supply chain attack: poisoned package hits {org} developers",
    "Update: credential stuffing leads to account takeover at {org}",
    "Researchers uncovered {who} espionage campaign in {place}",
    "Critical infrastructure: {place} power grid operator hit by wiper",
    "Former employee leaked {org} source code, insider threat warning",
    "Crypto wallet drain steals tokens from {org} users in {place}",
    "Exposed storage bucket: cloud misconfiguration at {org}",
    "IoT device flaw lets attackers hijack smart cameras in {place}",
    "Hacktivist group defaced website of {place} ministry",
    "Disinformation campaign on {place} election linked to {who}",
    "Annual threat report ranks {who} first across {place}",
    "Sigma rule and YARA rule for detecting {who} beaconing",
    "{place} privacy law: regulator fines {org} over password leak",
    "Webinar: five ways to stop ransomware with {org}",
    "{org} opens new garden cafe in {place}",
    "Hacker arrested in {place} after {org} intrusion - Daily Wire | Net Desk",
)
ORGS = ("Microsoft", "Cisco", "Fortinet", "Ivanti", "Oracle", "SolarWinds", "Okta", "Acme Bank", "VMware", "City College", "F5")
ACTORS = ("LockBit", "APT28", "Volt Typhoon", "Lazarus", "Akira", "MuddyWater", "Scattered Spider")
PLACES = ("United States", "Germany", "Japan", "Brazil", "Israel")
REGIONS = ("Global", "US", "Europe", "APAC", "LATAM", "Middle East", "US,UK", "France,Germany", "Japan,US,UK")
CATEGORIES = (
    "Ransomware", "Data Breach", "Zero-Day Exploit", "Phishing", "Malware", "Noise", "General Cyber Threat",
    "Nation-State Attack", "Supply Chain Attack", "DDoS", "Insider Threat", "Account Takeover", "Patch/Security Update",
)


def _pick(values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("doc_id"), F.lit(len(values))).cast("int"))


def headlines(documents: DataFrame) -> DataFrame:
    """One item per document; whole text, no sampling."""
    d = F.col("doc_id")

    def every(n: int, rest: int = 0) -> Column:
        return F.pmod(d, F.lit(n)) == rest

    first = F.nullif(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(""))
    second = F.nullif(F.regexp_extract("text", "^[^A-Za-z]*[A-Za-z]+[^A-Za-z]+([A-Za-z]+)", 1), F.lit(""))
    title = _pick(TEMPLATES)
    for slot, values in (("{who}", ACTORS), ("{org}", ORGS), ("{place}", PLACES)):
        title = F.replace(title, F.lit(slot), _pick(values))
    tail = F.concat_ws(" ", first, second)
    cve = F.concat(F.lit("CVE-2024-"), (1000 + F.pmod(d, F.lit(37))).cast("string"))
    other_cve = F.concat(F.lit(" cve-2024-"), (1000 + F.pmod(d * 7, F.lit(37))).cast("string"))
    minutes = F.pmod(d * F.pmod(d, F.lit(13)) * 997, F.lit(43200))
    when = F.timestamp_seconds(F.lit(1704067200) + minutes * 60)  # 2024-01-01 UTC

    published = (
        F.when(every(50, 0), F.lit("sometime last week")).when(every(50, 1), F.lit(None).cast("string"))
        .when(every(5, 0), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(every(5, 1), F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
        .when(every(5, 2), F.date_format(when, "yyyy-MM-dd"))
        .when(every(5, 3), F.date_format(when, "yyyy-MM-dd HH:mm:ss' UTC'"))
        .otherwise(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss' GMT'"))
    )
    link = F.concat(
        F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), d.cast("string"),
        F.when(every(3), "/").otherwise(""), F.when(every(2, 1), "?utm=x").otherwise(""),
    )
    items = documents.select(
        d.alias("pos"),
        F.concat(title, F.lit(" "), tail).alias("title"),
        F.concat(
            F.when(every(4), cve).otherwise(""), F.when(every(8), other_cve).otherwise(""),
            F.when(every(4), " ").otherwise(""), F.col("text"),
        ).alias("summary"),
        link.alias("link"),
        published.alias("published"),
        F.lit("2024-01-31T00:00:00Z").alias("ingested_at"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/rss")).alias("source"),
        _pick(REGIONS).alias("feed_region"),
        every(17).alias("darkweb"),
        F.when(every(34), F.lit("ransomware.live")).alias("darkweb_source"),
        (50 + F.pmod(d, F.lit(50))).cast("int").alias("confidence"),
        _pick(CATEGORIES).alias("category"),
        (~every(6)).alias("is_cyber_attack"),
    )
    return items.withColumn("hash", urls.content_hash(F.col("title"), F.col("link")))


def kev_catalog(documents: DataFrame) -> DataFrame:
    """Known-exploited rows for every third CVE number that the items can cite."""
    n = F.pmod(F.col("doc_id"), F.lit(37))
    numbers = documents.select(n.alias("n")).distinct().filter("n % 3 = 0")
    return numbers.select(
        F.concat(F.lit("CVE-2024-"), (1000 + F.col("n")).cast("string")).alias("cve_id"),
        F.concat(F.lit("Vendor"), (F.col("n") % 5).cast("string")).alias("vendor"),
        F.concat(F.lit("Product"), F.col("n").cast("string")).alias("product"),
        F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("n") % 28).cast("string"), 2, "0")).alias("date_added"),
        F.when(F.col("n") % 2 == 0, "Known").otherwise("Unknown").alias("ransomware_use"),
    )


def epss_scores(documents: DataFrame) -> DataFrame:
    """Exploit-likelihood rows for the CVE numbers the items can cite, but for every fifth."""
    n = F.pmod(F.col("doc_id"), F.lit(37))
    numbers = documents.select(n.alias("n")).distinct().filter("n % 5 <> 4")
    return numbers.select(
        F.concat(F.lit("CVE-2024-"), (1000 + F.col("n")).cast("string")).alias("cve_id"),
        (F.col("n") / 100).alias("epss_score"),
        ((F.col("n") + 50) / 100).alias("epss_percentile"),
    )


def _sql_pick(values: tuple[str, ...]) -> str:
    return "(" + repr(list(values)).replace('"', "'") + f")[doc_id % {len(values)} + 1]"


ORACLE_WITH = f"""
WITH base AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+') AS w,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id * (doc_id % 13) * 997) % 43200) AS t
  FROM documents),
headlines0 AS (
  SELECT doc_id AS pos,
    replace(replace(replace({_sql_pick(TEMPLATES)},
      '{{who}}', {_sql_pick(ACTORS)}), '{{org}}', {_sql_pick(ORGS)}), '{{place}}', {_sql_pick(PLACES)})
      || ' ' || concat_ws(' ', w[1], w[2]) AS title,
    (CASE WHEN doc_id % 4 = 0 THEN 'CVE-2024-' || (1000 + doc_id % 37) ELSE '' END)
      || (CASE WHEN doc_id % 8 = 0 THEN ' cve-2024-' || (1000 + (doc_id * 7) % 37) ELSE '' END)
      || (CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE '' END) || text AS summary,
    'https://' || source || '.example.com/a/' || doc_id || (CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END)
      || (CASE WHEN doc_id % 2 = 1 THEN '?utm=x' ELSE '' END) AS link,
    CASE WHEN doc_id % 50 = 0 THEN 'sometime last week' WHEN doc_id % 50 = 1 THEN NULL
      WHEN doc_id % 5 = 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ')
      WHEN doc_id % 5 = 1 THEN strftime(t, '%Y-%m-%d %H:%M:%S')
      WHEN doc_id % 5 = 2 THEN strftime(t, '%Y-%m-%d')
      WHEN doc_id % 5 = 3 THEN strftime(t, '%Y-%m-%d %H:%M:%S UTC')
      ELSE strftime(t, '%a, %d %b %Y %H:%M:%S GMT') END AS published,
    CASE WHEN doc_id % 50 IN (0, 1) THEN NULL
      WHEN doc_id % 5 = 2 THEN date_trunc('day', t) ELSE t END AS pub_ts,
    '2024-01-31T00:00:00Z' AS ingested_at,
    'https://' || source || '.example.com/rss' AS source,
    {_sql_pick(REGIONS)} AS feed_region,
    doc_id % 17 = 0 AS darkweb,
    CASE WHEN doc_id % 34 = 0 THEN 'ransomware.live' END AS darkweb_source,
    CAST(50 + doc_id % 50 AS INTEGER) AS confidence,
    {_sql_pick(CATEGORIES)} AS category,
    doc_id % 6 <> 0 AS is_cyber_attack
  FROM base),
headlines AS (
  SELECT *, sha256(title || regexp_replace(regexp_replace(link, '[?#].*$', ''), '/+$', '')) AS hash,
    coalesce(pub_ts, TIMESTAMP '2024-01-31 00:00:00') AS event_ts
  FROM headlines0),
item_cves AS (
  SELECT DISTINCT pos, upper(unnest(regexp_extract_all(title || ' ' || summary, '(?i)CVE-\\d{{4}}-\\d+'))) AS cve_id
  FROM headlines),
kev AS (
  SELECT 'CVE-2024-' || (1000 + n) AS cve_id, 'Vendor' || (n % 5) AS vendor, 'Product' || n AS product,
    '2024-01-' || lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0') AS date_added,
    CASE WHEN n % 2 = 0 THEN 'Known' ELSE 'Unknown' END AS ransomware_use
  FROM (SELECT DISTINCT doc_id % 37 AS n FROM documents) WHERE n % 3 = 0),
epss AS (
  SELECT 'CVE-2024-' || (1000 + n) AS cve_id, n / 100 AS epss_score, (n + 50) / 100 AS epss_percentile
  FROM (SELECT DISTINCT doc_id % 37 AS n FROM documents) WHERE n % 5 <> 4)
"""
