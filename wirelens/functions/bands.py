"""Banding of scores and normalisation of level words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wirelens import fixed


def severity(score: Column) -> Column:
    """Severity word of a CVSS base score."""
    return F.when(score >= 9.0, "CRITICAL").when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").otherwise("LOW")


def epss_risk(score: Column) -> Column:
    """Risk word of an exploit-likelihood score."""
    return F.when(score >= 0.5, "VERY HIGH").when(score >= 0.1, "HIGH").when(score >= 0.01, "MODERATE").otherwise("LOW")


def campaign_status(last_observed: Column, as_of: Column) -> Column:
    """active, dormant or archived by whole days since the last observation."""
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(last_observed)) / F.lit(86_400_000_000))
    return (
        F.when(last_observed.isNull(), "unknown")
        .when(days <= fixed.CAMPAIGN_ACTIVE_DAYS, "active")
        .when(days <= fixed.CAMPAIGN_ARCHIVED_DAYS, "dormant")
        .otherwise("archived")
    )


def normalize_level(raw: Column) -> Column:
    """Struct (level, source): valid word, recognised synonym, or the middle level."""
    word = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    valid = word.isin(*fixed.THREAT_LEVELS)
    aliases = F.create_map(*[F.lit(x) for pair in fixed.THREAT_LEVEL_ALIASES.items() for x in pair])
    mapped = F.try_element_at(aliases, word)
    level = F.when(valid, word).otherwise(F.coalesce(mapped, F.lit("MODERATE")))
    source = F.when(valid, "model").when(mapped.isNotNull(), "model_alias").otherwise("fallback_invalid")
    return F.struct(level.alias("level"), source.alias("source"))


def normalize_significance(raw: Column) -> Column:
    """CRITICAL, HIGH or MODERATE, also when the word is only contained."""
    word = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return (
        F.when(word.contains("CRITICAL"), "CRITICAL")
        .when(word.rlike("HIGH|SEVERE|ELEVATED"), "HIGH")
        .otherwise("MODERATE")
    )


def level_rank(level: Column) -> Column:
    """Order of a threat level, -1 when unknown."""
    ranks = F.create_map(*[F.lit(x) for pair in fixed.LEVEL_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.upper(F.coalesce(level, F.lit("")))), F.lit(-1))


def tier_rank(provider: Column, tiers: dict[str, int] = fixed.PROVIDER_TIERS) -> Column:
    """Quality rank of a ``tier/name`` label; lower is better, unknown is last."""
    ranks = F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.substring_index(F.coalesce(provider, F.lit("")), "/", 1)),
                      F.lit(fixed.UNKNOWN_TIER))
