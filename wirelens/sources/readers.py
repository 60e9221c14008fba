"""Landed files and supplied tables as the raw item table, catalogs and state tables.

Every source is a ``normalize(df) -> df`` over what Spark has read, so a source
fails alone: bad rows are counted or dropped, never fatal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, Column, DataFrame, Observation, SparkSession, functions as F

from wirelens import fixed
from wirelens.functions import bands, regions, text as tx, times, urls
from wirelens.operators.corpus import top_n

RAW = "title string, link string, published string, summary string, hash string, source string, feed_region string"


#: Words in a link that promise a feed.
FEED_WORDS = ("rss", "feed", "atom", "xml")


# --- feeds, items, news ---------------------------------------------------------
def load_feeds(*tables: DataFrame) -> DataFrame:
    """Feed rows of all config tables that have a url, one per url: that of the earliest table, then the first by value."""
    merged = tables[0].withColumn("_table", F.lit(0))
    for number, other in enumerate(tables[1:], 1):
        merged = merged.unionByName(other.withColumn("_table", F.lit(number)), allowMissingColumns=True)
    named = merged.withColumn("url", F.trim("url")).filter(~tx.blank(F.col("url")))
    rest = [c for c in named.columns if c not in ("_table", "url")]
    first = Window.partitionBy("url").orderBy("_table", *[F.col(c).cast("string").asc_nulls_last() for c in rest])
    return named.withColumn("_turn", F.row_number().over(first)).filter("_turn = 1").drop("_turn", "_table")


@dataclass(frozen=True)
class FeedRead:
    """Landed feed files as read: ``items``, and in ``quarantine`` (file, reason, record) all that did not become one."""

    items: DataFrame
    quarantine: DataFrame
    rows: DataFrame

    def counted(self, observation: Observation) -> DataFrame:
        """The read entries; any job over them leaves entries, unreadable, untitled and hidden in ``observation``."""
        reason = F.col("reason")
        return self.rows.observe(observation, F.count(F.lit(1)).alias("entries"), *[
            F.count_if(reason == r).alias(name) for name, r in (("unreadable", UNREADABLE), ("untitled", NO_TITLE), ("hidden", HIDDEN_LINK))])


UNREADABLE, NO_TITLE, HIDDEN_LINK, NO_ENTRY = "unreadable entry", "no title", "hidden link", "no readable entry in file"


def read_feed(spark: SparkSession, path: str, source: str, region: str = "Global") -> FeedRead:
    """Landed RSS files with a quarantine: one bad entry costs only itself, a file without any entry is named."""
    schema = "title string, link string, pubDate string, description string, _corrupt_record string"
    # entries are cut out of the text and parsed one by one: a parser over the whole file would stop at the first bad one
    parts = spark.read.option("lineSep", "</item>").text(path).select(F.regexp_extract("value", r"(?s)^.*(<item[\s>].*)$", 1).alias("entry"), F.col("_metadata.file_path").alias("path"))
    entry = F.concat("entry", F.lit("</item>"))
    raw = parts.filter(F.col("entry") != "").select("path", F.from_xml(entry, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x")).select("path", "x.*")
    reason = F.when(F.col("_corrupt_record").isNotNull(), UNREADABLE).when(tx.blank(F.col("title")), NO_TITLE).when(~urls.is_clearnet(F.col("link")), HIDDEN_LINK)
    rows = raw.select("*", _file(F.col("path")).alias("file"), reason.alias("reason")).drop("path")
    bad = rows.filter(F.col("reason").isNotNull()).select("file", "reason", F.coalesce("_corrupt_record", F.to_json(F.struct("title", "link", "pubDate", "description"))).alias("record"))
    files = spark.read.format("binaryFile").load(path).select(_file(F.col("path")).alias("file"))
    empty = files.join(rows.select("file").distinct(), "file", "left_anti").select("file", F.lit(NO_ENTRY).alias("reason"), F.lit(None).cast("string").alias("record"))
    return FeedRead(normalize_rss(rows.filter(F.col("reason").isNull()), source, region), bad.unionByName(empty), rows)


def _file(path: Column) -> Column:
    """A file's address with one slash after its scheme, as both readers can spell it."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def read_rss(spark: SparkSession, path: str, source: str, region: str = "Global") -> DataFrame:
    """Items of landed RSS files; ``read_feed`` also gives what was left out."""
    return read_feed(spark, path, source, region).items


def normalize_rss(df: DataFrame, source: str, region: str = "Global") -> DataFrame:
    """Titled clear-net entries with resolved links and content hashes."""
    resolved = urls.resolve_link(F.col("link"), F.coalesce("description", F.lit("")))
    link = F.when(urls.is_clearnet(resolved), resolved).otherwise(F.col("link"))
    kept = df.filter(~tx.blank(F.col("title")) & urls.is_clearnet(F.col("link"))).withColumn("_link", link)
    return kept.select(
        "title", F.col("_link").alias("link"), F.coalesce("pubDate", F.lit("")).alias("published"),
        F.coalesce("description", F.lit("")).alias("summary"), urls.content_hash(F.col("title"), F.col("_link")).alias("hash"),
        F.lit(source).alias("source"), F.lit(region).alias("feed_region"))


def normalize_news(df: DataFrame) -> DataFrame:
    """News-search rows (title, url, publishedAt, description, source.name) as raw items."""
    title, link = tx.strip(F.coalesce("title", F.lit(""))), tx.strip(F.coalesce("url", F.lit("")))
    kept = df.filter((title != "") & (title != "[Removed]") & urls.is_clearnet(link))
    return kept.select(
        title.alias("title"), link.alias("link"), F.coalesce("publishedAt", F.lit("")).alias("published"),
        tx.strip(F.coalesce("description", F.lit(""))).alias("summary"), urls.content_hash(title, link).alias("hash"),
        F.concat(F.lit("newsapi:"), F.coalesce(F.nullif("source.name", F.lit("")), F.lit("NewsAPI"))).alias("source"), F.lit("Global").alias("feed_region"))


# --- vulnerability records ---------------------------------------------------------
CVE_SCHEMA = (
    "id string, published string, descriptions array<struct<lang:string,value:string>>,"
    " metrics struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,vectorString:string>>>,"
    "cvssMetricV30:array<struct<cvssData:struct<baseScore:double,vectorString:string>>>,"
    "cvssMetricV2:array<struct<cvssData:struct<baseScore:double,vectorString:string>>>>,"
    " configurations array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>,"
    " weaknesses array<struct<description:array<struct<value:string>>>>, references array<struct<url:string>>")


def flatten_cve_records(df: DataFrame, min_score: float = 7.0, shown: int = 5) -> DataFrame:
    """Severe vulnerability records as items; ``df`` has the columns of ``CVE_SCHEMA``.

    Products of all configurations are listed; the summary names the first ``shown`` of them.
    """
    versions = [F.get(F.col(f"metrics.{v}"), F.lit(0))["cvssData"] for v in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")]
    english = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    configs = F.coalesce("configurations", F.array().cast("array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>"))
    criteria = F.flatten(F.transform(configs, lambda c: F.flatten(F.transform(c["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))

    def product(text: Column) -> Column:
        parts = F.split(text, ":")
        def word(i: int) -> Column:
            return F.initcap(F.replace(F.get(parts, F.lit(i)), F.lit("_"), F.lit(" ")))
        return F.concat(word(3), F.lit(" "), word(4))

    picked = (
        df.filter(~tx.blank(F.col("id")))
        .withColumn("data", F.coalesce(*versions))
        .withColumn("score", F.coalesce("data.baseScore", F.lit(0.0))).filter(F.col("score") >= min_score)
        .withColumn("vector", F.coalesce("data.vectorString", F.lit("")))
        .withColumn("severity", bands.severity(F.col("score")))
        .withColumn("description", F.coalesce(english, F.get(F.col("descriptions"), F.lit(0))["value"], F.lit("")))
        .withColumn("products", F.transform(F.filter(criteria, lambda c: F.size(F.split(c, ":")) >= 5), product))
        .withColumn("cwes", F.filter(F.flatten(F.transform(
            F.coalesce("weaknesses", F.array().cast("array<struct<description:array<struct<value:string>>>>")),
            lambda w: F.transform(w["description"], lambda d: d["value"]))), lambda v: v.startswith("CWE-")))
    )
    affected = F.when(F.size("products") > 0, F.array_join(F.slice(F.array_distinct("products"), 1, shown), ", ")).otherwise("multiple products")
    head = F.concat("id", F.lit(": "), "severity", F.lit(" ("), F.col("score").cast("string"), F.lit(") — "))
    long = F.length("description") > 120
    title = F.concat(head, F.substring("description", 1, 120))
    link = F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), F.col("id"))
    return picked.select(
        F.when(long, F.concat(F.regexp_replace(title, r"(?s)^(.*) .*$", "$1"), F.lit("..."))).otherwise(title).alias("title"),
        link.alias("link"), "published",
        F.concat("id", F.lit(" (CVSS "), F.col("score").cast("string"), F.lit(" "), "severity", F.lit("): "), F.substring("description", 1, 400),
                 F.lit(" Affected: "), affected, F.lit(". "),
                 F.when(F.size("cwes") > 0, F.concat(F.lit("CWE: "), F.array_join("cwes", ", "), F.lit(". "))).otherwise(""),
                 F.lit("Vector: "), "vector").alias("summary"),
        F.sha2("id", 256).alias("hash"), F.lit("nvd:cve").alias("source"), F.lit("Global").alias("feed_region"),
        F.lit("Vulnerability Disclosure").alias("category"), F.lit(95).alias("confidence"), F.lit(True).alias("is_cyber_attack"),
        F.col("id").alias("cve_id"), F.col("score").alias("cvss_score"), F.col("severity").alias("cvss_severity"), F.col("vector").alias("cvss_vector"),
        tx.none_if_empty(F.col("cwes")).alias("cwe_ids"), tx.none_if_empty(F.array_distinct("products")).alias("affected_products"),
        F.coalesce(F.get(F.col("references"), F.lit(0))["url"], link).alias("ref_url"))


def load_kev(df: DataFrame, position: str | None = None) -> DataFrame:
    """Known-exploited catalog, one row per upper-case id; the last row of an id wins.

    ``df`` has the array column ``vulnerabilities`` (and ``position`` when it has several rows).
    """
    order = F.col(position) if position else F.lit(0)
    rows = df.select(order.alias("doc"), F.posexplode("vulnerabilities").alias("at", "v"))
    def field(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(f"v.{name}"), F.lit(default))
    named = rows.select(
        F.struct("doc", "at").alias("order"), F.upper("v.cveID").alias("cve_id"), field("vendorProject").alias("vendor"), field("product").alias("product"),
        field("vulnerabilityName").alias("vulnerability_name"), field("dateAdded").alias("date_added"), field("dueDate").alias("due_date"),
        field("requiredAction").alias("required_action"),
        F.coalesce(F.nullif("v.knownRansomwareCampaignUse", F.lit("")), F.lit("Unknown")).alias("ransomware_use"))
    return top_n(named.filter(~tx.blank(F.col("cve_id"))), ["cve_id"], [F.desc("order")], 1).drop("order")


# --- dark-web sources -----------------------------------------------------------------
def normalize_victims(df: DataFrame, as_of: str, lookup: DataFrame, cap: int | None = None, days: int = fixed.CUTOFF_DAYS) -> DataFrame:
    """Leak-site victim rows (victim, group_name, discovered, post_url, country) as items.

    Undated and old posts are dropped. ``cap`` keeps only the latest posts, as the source's own page does; ties go by
    group, victim and link.
    """
    latest = df.orderBy(F.desc("discovered"), "group_name", "victim", "post_url").limit(cap) if cap else df
    group, name = F.coalesce("group_name", F.lit("Unknown")), F.coalesce("victim", F.lit("Unknown"))
    country, url = F.coalesce("country", F.lit("")), F.coalesce("post_url", F.lit(""))
    found = times.parse_event_time(F.col("discovered"))
    cutoff = times.as_timestamp(as_of) - F.expr(f"INTERVAL {days} DAYS")
    dated = latest.filter(found >= cutoff)
    title = F.concat(group, F.lit(" ransomware: new victim '"), name, F.lit("'"), F.when(country != "", F.concat(F.lit(" ("), country, F.lit(")"))).otherwise(""))
    placed = regions.country_to_region(dated.withColumn("country", country), "country", lookup, "feed_region")
    return placed.select(
        title.alias("title"), F.when(urls.is_clearnet(url), url).otherwise("https://ransomware.live/#/victims").alias("link"),
        F.col("discovered").alias("published"),
        F.concat(F.lit("Ransomware group "), group, F.lit(" posted new victim '"), name, F.lit("' on their dark web leak site. "),
                 F.when(country != "", F.concat(F.lit("Country: "), country, F.lit(". "))).otherwise("")).alias("summary"),
        F.sha2(F.concat(title, F.when(url != "", url).otherwise(name)), 256).alias("hash"), F.lit("darkweb:ransomware.live").alias("source"),
        "feed_region", F.lit(True).alias("darkweb"), group.alias("darkweb_group"), F.lit(fixed.LEAK_SITE_SOURCE).alias("darkweb_source"))


def rollup_ioc_feed(df: DataFrame, as_of: str, days: int = fixed.CUTOFF_DAYS, per_family: int = 10, families: int = 20, sample: int = 5) -> DataFrame:
    """Indicator feed rows (pos, malware_printable, threat_type, ioc_type, ioc_value, first_seen_utc), one item per family and day.

    The first ``families`` by position are reported with their first
    ``per_family`` indicators; undated and old rows are dropped first.
    """
    cutoff = times.as_timestamp(as_of) - F.expr(f"INTERVAL {days} DAYS")
    live = df.filter(times.parse_event_time(F.col("first_seen_utc")) >= cutoff).withColumn("family", F.coalesce("malware_printable", F.lit("Unknown")))
    chosen = live.groupBy("family").agg(F.min(F.struct("pos", "threat_type", "first_seen_utc")).alias("head")).orderBy("head.pos").limit(families)
    firsts = top_n(live.join(chosen.select("family"), "family", "left_semi"), ["family"], [F.col("pos")], per_family)
    nested = firsts.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ioc_value", F.lit("")).alias("value")))), lambda s: s["value"]).alias("values"))
    n, day = F.size("values"), F.lit(as_of[:10])
    return chosen.join(nested, "family").select(
        F.concat(F.lit("Indicator feed: "), "family", F.lit(" — "), n.cast("string"), F.when(n == 1, " new IOC detected").otherwise(" new IOCs detected")).alias("title"),
        F.concat(F.lit("https://threatfox.abuse.ch/browse/malware/"), F.replace(F.lower("family"), F.lit(" "), F.lit("-")), F.lit("/")).alias("link"),
        F.col("head.first_seen_utc").alias("published"),
        F.concat(F.lit("New indicators of compromise for "), "family", F.lit(" ("), F.coalesce("head.threat_type", F.lit("")), F.lit("). Sample IOCs: "),
                 F.array_join(F.slice("values", 1, sample), ", "), F.lit(".")).alias("summary"),
        F.sha2(F.concat(F.lit("threatfox:"), "family", F.lit(":"), day), 256).alias("hash"), F.lit("darkweb:threatfox").alias("source"),
        F.lit("Global").alias("feed_region"), F.lit(True).alias("darkweb"), F.col("family").alias("darkweb_group"), F.lit("threatfox").alias("darkweb_source"), n.alias("ioc_count"))


def explode_ioc_feed(df: DataFrame, column: str = "feed") -> DataFrame:
    """Rows of a feed map (id -> indicators) with their position."""
    entries = df.select(F.posexplode(F.map_values(column)).alias("at", "entries")).select("at", F.posexplode("entries").alias("i", "e"))
    return entries.select((F.col("at").cast("long") * 100_000 + F.col("i")).alias("pos"), "e.*")


# --- state, feedback, watchlist ----------------------------------------------------------
def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback lines; lines that are no JSON are skipped."""
    schema = "article_hash string, correct_category string, note string, received_at string, source_ip string, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def load_watchlist(df: DataFrame, per_kind: int = 50, chars: int = 200) -> DataFrame:
    """Trimmed, non-blank keywords (kind, keyword), bounded in length and number per kind."""
    cut = F.substring(F.trim("keyword"), 1, chars)
    rows = df.filter(~tx.blank(F.col("keyword"))).select("kind", cut.alias("keyword")).distinct()
    return top_n(rows, ["kind"], [F.col("keyword")], per_kind)


def import_state(spark: SparkSession, source: str, target: str, schema: str) -> DataFrame:
    """JSON state files as a Parquet table; returns the table."""
    spark.read.schema(schema).option("multiLine", True).json(source).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


# --- pages and feed discovery ------------------------------------------------------------------
def html_main_text(df: DataFrame, html: str = "html", out: str = "text", min_paragraph: int = 20, min_text: int = 100) -> DataFrame:
    """Article text of whole pages: paragraphs of the article (or main) block without page furniture."""
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    staged = df.withColumn("_body", body)
    article = F.regexp_extract("_body", r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    main = F.regexp_extract("_body", r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1)
    region = F.when(article != "", article).when(main != "", main).otherwise(F.col("_body"))
    pieces = F.split(region, r"(?i)<p(?=[\s>])[^>]*>")

    def clean(piece: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(piece, r"(?is)</p\s*>.*$", ""), r"(?s)<[^>]*>", "")
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            text = F.replace(text, F.lit(name), F.lit(char))
        return tx.strip(text)

    paragraphs = F.filter(F.transform(F.slice(F.col("_pieces"), 2, F.greatest(F.size("_pieces"), F.lit(1))), clean), lambda p: F.length(p) > min_paragraph)
    joined = staged.withColumn("_pieces", pieces).withColumn("_text", F.array_join(paragraphs, " "))
    return joined.withColumn(out, F.when(F.length("_text") > min_text, F.col("_text"))).drop("_body", "_pieces", "_text")


def harvest_feed_urls(df: DataFrame, known: DataFrame, text: str = "text", day: str = "day", as_of: str | None = None, recent_days: int = 14) -> DataFrame:
    """Unknown feed links in raw text, scored recent * 3 + total."""
    link = r"""[^\s)>"'\]}]"""  # links end at white space, quotes and closing brackets
    pattern = rf"(?i)https?://{link}*?{link}(?:{'|'.join(FEED_WORDS)}){link}*"
    found = df.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)).alias("url"),
                      (F.col(day) if day in df.columns else F.lit(None).cast("date")).alias("day"))
    cleaned = found.withColumn("url", F.regexp_replace("url", "[.,;]+$", "")).join(known.select("url"), "url", "left_anti")
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), recent_days) if as_of else F.lit(None).cast("date")
    return cleaned.groupBy("url").agg(F.count("*").alias("total"), F.count_if(F.col("day") >= cutoff).alias("recent")).withColumn(
        "score", F.col("recent") * 3 + F.col("total"))
