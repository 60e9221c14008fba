"""Tolerant JSON ingest: strict text, then repaired text, then the first block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelens.rules import let, once

QUOTED = r'"(?:[^"\\]|\\.)*"'
#: Bare words of other languages that mean "no value".
NO_VALUE = ("none", "None", "NONE", "undefined", "NaN")


def repaired(text: Column) -> Column:
    """Bare no-value words become null, a list of one null becomes empty, trailing commas go; strings stay as they are.

    Each pattern walks over whole strings from where the last match ended, so it never looks inside one.
    """
    bare = "|".join(NO_VALUE)
    before = rf"\G((?:{QUOTED}|[^\"A-Za-z]|(?!(?:{bare})\b)[A-Za-z]+)*?)\b"
    out = F.regexp_replace(text, rf"{before}(?:{bare})\b", "$1null")
    walk = rf"\G((?:{QUOTED}|[^\"])*?)"
    out = F.regexp_replace(out, rf"{walk}\[\s*null\s*\]", "$1[]")
    return F.regexp_replace(out, rf"{walk},(?=\s*[}}\]])", "$1")


def tolerant_json(df: DataFrame, raw: str, out: str = "parsed", how: str = "parsed_from") -> DataFrame:
    """Add a variant column and the name of the step that produced it.

    ``quarantine`` marks rows no step could read; their variant is null.
    """
    text, block = F.col(raw), F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0)
    steps = [("strict", text), ("repaired", repaired(text)),
             ("block", F.when(block != "", block)), ("block_repaired", F.when(block != "", repaired(block)))]

    def tried(name: str, value: Column) -> Column:
        return let(F.try_parse_json(value), lambda v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("step"), v.alias("value"))))

    # a step runs only where the ones before it failed
    best = once(df, "_json", F.coalesce(*[tried(name, value) for name, value in steps]))
    return (best.withColumn(out, F.col("_json.value"))
            .withColumn(how, F.coalesce("_json.step", F.lit("quarantine"))).drop("_json"))
