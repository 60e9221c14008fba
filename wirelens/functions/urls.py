"""Link columns: canonical form, clear-net test, embedded and wrapped targets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty string when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def canonical_url(url: Column) -> Column:
    """Drop query, fragment and trailing slashes so that variants hash alike."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), "/+$", "")


def is_clearnet(url: Column) -> Column:
    """An http(s) link with a host outside the onion and i2p networks."""
    name = host(url)
    hidden = name.rlike(r"(^|\.)(onion|i2p)$")
    return F.coalesce(F.coalesce(url, F.lit("")).rlike("^(?i:https?)://") & (name != "") & ~hidden, F.lit(False))


def embedded_url(url: Column) -> Column:
    """Decoded value of a ``url=`` query parameter, null when absent."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]url=([^&#]+)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def unwrap_link(url: Column, aggregator: str = "news.google.com") -> Column:
    """First link inside the base64url article segment of an aggregator link."""
    segment = F.regexp_extract(F.coalesce(url, F.lit("")), r"/articles/([^?/]+)", 1)
    plain = F.rpad(F.translate(segment, "-_", "+/"), F.ceil(F.length(segment) / 4) * 4, F.lit("="))
    bytes_as_text = F.decode(F.try_to_binary(plain, F.lit("base64")), "ISO-8859-1")
    found = F.regexp_extract(bytes_as_text, r"https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+", 0)
    return F.when(F.coalesce(url, F.lit("")).contains(aggregator) & (segment != "") & (found != ""), found)


def first_href(html: Column, aggregator: str = "news.google.com") -> Column:
    """First absolute anchor target that does not point back to the aggregator."""
    targets = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1)
    outside = F.filter(targets, lambda t: t.startswith("http") & ~t.contains(aggregator))
    return F.get(outside, F.lit(0))


def resolve_link(url: Column, summary: Column, aggregator: str = "news.google.com") -> Column:
    """Best known target of a landed link, decided from the row alone."""
    wrapped = F.coalesce(url, F.lit("")).contains(aggregator)
    from_summary, from_path = first_href(summary, aggregator), unwrap_link(url, aggregator)
    return (
        F.when(wrapped & is_clearnet(from_summary), from_summary)
        .when(wrapped & is_clearnet(from_path), from_path)
        .when(~wrapped, F.coalesce(embedded_url(url), url))
        .otherwise(url)
    )


def content_hash(title: Column, url: Column, given: Column | None = None) -> Column:
    """SHA-256 over title and canonical link unless a hash was supplied."""
    made = F.sha2(F.concat(F.coalesce(title, F.lit("")), F.coalesce(canonical_url(url), F.lit(""))), 256)
    return made if given is None else F.coalesce(F.when(given != "", given), made)


def source_name(url: Column) -> Column:
    """Readable outlet name: first host label without www./feeds., capitalised."""
    label = F.substring_index(F.replace(F.replace(host(url), F.lit("www."), F.lit("")), F.lit("feeds."), F.lit("")), ".", 1)
    named = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1000)))
    return F.when(label != "", named).otherwise("Unknown")
