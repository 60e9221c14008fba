"""Text columns: titles, shingles, summaries, ids, digest lines, proper nouns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from wirelens import fixed


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values])


def strip(text: Column) -> Column:
    """Drop white space (also non-ASCII) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    """True when the text is null or only spaces."""
    return text.isNull() | (F.trim(text) == "")


def normalize_title(title: Column) -> Column:
    """Lower case, drop leading news labels in order, drop ASCII punctuation, squeeze spaces."""
    text = strip(F.lower(title))
    for prefix in fixed.TITLE_PREFIXES:
        text = F.regexp_replace(text, rf"(?U)^{re.escape(prefix)}\s*", "")
    text = F.translate(text, fixed.PUNCTUATION, "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_words(normalized: Column) -> Column:
    """Words of a normalized title without stop words, in order."""
    words = F.split(normalized, " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*fixed.TITLE_STOP_WORDS))


def shingles_of(words: Column) -> Column:
    """Distinct words and neighbouring word pairs of an already tokenised title.

    Pass a materialised column: the expression reads it several times.
    """
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_union(words, F.array_compact(pairs))


def with_shingles(df: DataFrame, title: str, words: str = "words", out: str = "shingles") -> DataFrame:
    """Add the word list and shingle set of ``title`` in two projections."""
    tokenised = df.withColumn(words, content_words(normalize_title(F.col(title))))
    return tokenised.withColumn(out, shingles_of(F.col(words)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 when either set is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def lead_summary(text: Column, sentences: int = 3, limit: int = 500) -> Column:
    """First sentences joined by a space; beyond ``limit`` characters cut and marked."""
    lead = F.array_join(F.slice(F.split(strip(text), r"(?<=[.!?])\s+", sentences + 1), 1, sentences), " ")
    return F.when(blank(text), F.lit("")).when(
        F.length(lead) > limit, F.concat(F.substring(lead, 1, limit - 3), F.lit("..."))
    ).otherwise(lead)


def title_key(title: Column) -> Column:
    """Lower-cased title without the last " - Source" and then the last " | Source"."""
    text = strip(F.lower(title))
    no_dash = F.regexp_replace(text, r"(?s)^(.*) - .*$", "$1")
    return F.regexp_replace(no_dash, r"(?s)^(.*) \| .*$", "$1")


def clip_headline(text: Column, cap: int = 160, floor: int = 100) -> Column:
    """Cut at the last clause break before ``cap`` when it lies beyond ``floor``."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    cut = F.substring(trimmed, 1, cap)
    head = F.regexp_extract(cut, r"(?s)^(.*)[,;.] ", 1)
    return (
        F.when(F.length(trimmed) <= cap, trimmed)
        .when(F.length(head) >= floor, F.concat(head, F.lit("…")))
        .otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit("…")))
    )


def mask_secret(secret: Column) -> Column:
    """First eight characters and an ellipsis; ``unknown`` for a missing secret."""
    return F.when(blank(secret), F.lit("unknown")).otherwise(F.concat(F.substring(secret, 1, 8), F.lit("…")))


def typed_id(kind: str | Column, seed: Column) -> Column:
    """Deterministic ``kind--8-4-4-4-12`` id cut from the SHA-256 of the seed."""
    digest = F.sha2(seed, 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    body = F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts])
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("--"), body)


def campaign_id(entity_type: Column, entity_name: Column) -> Column:
    """Stable campaign id: the same (type, name) always gets the same id."""
    return typed_id("campaign", F.concat_ws(":", entity_type, entity_name))


def proper_nouns(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct capitalised tokens of three or more characters, minus the stop list."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b[A-Z][\w\-'.]{2,}\b"), 0))
    return F.array_except(found, strings(stop)) if stop else found


def cve_ids(text: Column) -> Column:
    """Distinct upper-case CVE ids in order; an empty array when none occurs."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.CVE_PATTERN), 0)
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def none_if_empty(items: Column) -> Column:
    """Null for an empty array: an absent field is null in every table."""
    return F.when(F.size(items) > 0, items)


def stix_literal(value: Column) -> Column:
    """Remove the characters that would end or escape a pattern literal."""
    return F.regexp_replace(value, r"['\\\[\]]", "")


def stix_pattern(kind: Column, value: Column) -> Column:
    """Indicator pattern of one typed value; null for an unsupported type."""
    k, safe = F.lower(F.coalesce(kind, F.lit(""))), stix_literal(value)
    return (
        F.when(k.isin("md5_hash", "sha1_hash", "sha256_hash"),
               F.concat(F.lit("[file:hashes.'"), F.upper(F.regexp_replace(k, "_hash$", "")),
                        F.lit("' = '"), safe, F.lit("']")))
        .when(k == "ip:port",
              F.concat(F.lit("[network-traffic:dst_ref.type = 'ipv4-addr' AND network-traffic:dst_ref.value = '"),
                       F.substring_index(safe, ":", 1), F.lit("']")))
        .when(k == "domain", F.concat(F.lit("[domain-name:value = '"), safe, F.lit("']")))
        .when(k == "url", F.concat(F.lit("[url:value = '"), safe, F.lit("']")))
    )


def digest_meta() -> Column:
    """Metadata part of a digest line: present fields joined by " | "."""
    def tagged(label: str, value: Column) -> Column:
        return F.when(~blank(value), F.concat(F.lit(label), value))

    kev = F.when(F.col("kev_listed"), F.concat(
        F.lit("KEV-listed"),
        F.when(~blank(F.col("kev_min_date_added")), F.concat(F.lit(" "), F.col("kev_min_date_added"))).otherwise(""),
        F.when(F.col("kev_ransomware_use") == "Known", F.lit(" (ransomware-linked)")).otherwise(""),
    ))
    return F.concat_ws(
        " | ",
        tagged("Source: ", F.col("source_name")),
        tagged("Published: ", F.substring(F.col("published"), 1, 16)),
        tagged("CVE: ", F.col("cve_id")),
        F.when(F.col("cvss_score") > 0, F.concat(F.lit("CVSS: "), F.col("cvss_score").cast("string"))),
        F.when(F.col("epss_max_score") > 0,
               F.concat(F.lit("EPSS: "), F.format_string("%.1f", F.col("epss_max_score") * 100), F.lit("%"))),
        F.when(F.col("epss_risk") != "LOW", tagged("Exploit risk: ", F.col("epss_risk"))),
        kev,
        F.when(F.size("attack_tactics") > 0,
               F.concat(F.lit("ATT&CK: "), F.array_join(F.slice("attack_tactics", 1, 3), ", "))),
    )


def digest_line(number: Column) -> Column:
    """Numbered digest line of one article with its tags, metadata and summary."""
    head = F.concat(
        F.lit("["), number.cast("string"), F.lit("] ["), F.coalesce(F.col("category"), F.lit("Unknown")),
        F.lit("] ["), F.coalesce(F.col("feed_region"), F.lit("Global")), F.lit("] "),
        F.coalesce(F.when(~blank(F.col("translated_title")), F.col("translated_title")), F.col("title"), F.lit("")),
    )
    indented = [F.when(~blank(part), F.concat(F.lit("    "), part)) for part in (digest_meta(), F.col("summary"))]
    return F.concat_ws("\n", head, *indented)


LANGUAGE_PROFILES = {
    # frequent function words that mark a language
    "en": ("the", "and", "of", "to", "in", "that", "is", "for", "with", "this", "by", "was", "are", "from", "at"),
    "fr": ("le", "la", "les", "des", "est", "une", "que", "dans", "pour", "du", "par", "sur", "avec", "un", "qui"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "von", "den", "ein", "eine", "zu", "sich", "für", "auf"),
    "es": ("el", "los", "las", "del", "y", "por", "con", "una", "para", "es", "se", "lo", "como", "su", "al"),
}


def tag_language(df: DataFrame, text: str = "text", out: str = "language",
                 profiles: dict[str, tuple[str, ...]] = LANGUAGE_PROFILES) -> DataFrame:
    """Language whose profile words occur most often; ties by name, null when none occurs."""
    tokens = df.withColumn("_tokens", F.split(F.lower(F.col(text)), r"(?U)[^\w]+"))

    def score(rank: int, name: str) -> Column:
        hits = F.filter(F.col("_tokens"), lambda w: w.isin(*profiles[name]))
        return F.struct(F.size(hits).alias("hits"), F.lit(-rank).alias("order"), F.lit(name).alias("name"))

    scores = F.array(*[score(rank, name) for rank, name in enumerate(sorted(profiles))])
    best = tokens.withColumn("_best", F.array_max(scores))
    return best.withColumn(out, F.when(F.col("_best.hits") > 0, F.col("_best.name"))).drop("_tokens", "_best")


def to_payload(df: DataFrame, hidden: tuple[str, ...] = ("full_content",), out: str = "payload") -> DataFrame:
    """Whole row as one JSON column next to the row; heavy fields are left out."""
    shown = [c for c in df.columns if c not in hidden]
    return df.withColumn(out, F.to_json(F.struct(*shown)))
