"""Licence scans: sentences become known identifiers, identifier sequences become licences by ordered rules.

Only DataFrame functions: a text is split, normalised and matched inside its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUED = "( as published by the free software foundation)? (either )?(v|version )"
#: Sentences of public licences, as patterns over normalised words (lower case, single blanks).
#: A version counts where its number ends; short identifiers (GPL-3.0-or-later) are sentences of their own.
SENTENCES = [
    ("notunder", "(^| )(not|never) (licen[sc]ed|released|available|distributed|published|covered) (under|by) (the terms of )?(the |an? )?"
                 "(gnu|apache|mit|bsd|mozilla|creative|agpl|lgpl|gpl|mpl|isc|cc)( |$)"),
    ("cc0", "(to the extent possible under law|cc0 1 0|creative commons zero)"),
    ("ccbyncsa", "(cc by nc sa|creative commons attribution noncommercial sharealike)"),
    ("ccbyncnd", "(cc by nc nd|creative commons attribution noncommercial noderivatives)"),
    ("ccbync", "(cc by nc|creative commons attribution noncommercial)"),
    ("ccbysa", "(cc by sa|creative commons attribution sharealike)"),
    ("ccbynd", "(cc by nd|creative commons attribution noderivatives)"),
    ("ccby", "(cc by|creative commons attribution)"),
    ("agpl3later", r"agpl ?v? ?3( 0)? or later\b"),
    ("agpl3", rf"(gnu affero general public licen[sc]e{ISSUED}3\b|agpl ?v? ?3\b)"),
    ("agplany", r"(gnu affero general public licen[sc]e|(^| )agpl\b)"),
    ("lgpl3later", r"lgpl ?v? ?3( 0)? or later\b"),
    ("lgpl3", rf"(gnu (lesser|library) general public licen[sc]e{ISSUED}3\b|lgpl ?v? ?3\b)"),
    ("lgpl21later", r"lgpl ?v? ?2 1 or later\b"),
    ("lgpl21", rf"(gnu (lesser|library) general public licen[sc]e{ISSUED}2 1\b|lgpl ?v? ?2 1\b)"),
    ("lgpl20later", r"lgpl ?v? ?2( 0)? or later\b"),
    ("lgpl20", rf"(gnu (lesser|library) general public licen[sc]e{ISSUED}2\b|lgpl ?v? ?2\b)"),
    ("lgplany", r"(gnu (lesser|library) general public licen[sc]e|(^| )lgpl\b)"),
    ("gpl3later", r"(^| )gpl ?v? ?3( 0)? or later\b"),
    ("gpl3", rf"(gnu general public licen[sc]e{ISSUED}3\b|(^| )gpl ?v? ?3\b)"),
    ("gpl2later", r"(^| )gpl ?v? ?2( 0)? or later\b"),
    ("gpl2", rf"(gnu general public licen[sc]e{ISSUED}2\b|(^| )gpl ?v? ?2\b)"),
    ("gplany", "gnu general public licen[sc]e"),
    ("orlater", "(or )?(at your option )?any later version"),
    ("apache2", r"(apache licen[sc]e( version)? 2\b|apache 2 0\b)"),
    ("apachecopy", "you may (not use this file except in compliance with|obtain a copy of) the licen[sc]e"),
    ("apacheasis", "distributed under the licen[sc]e is distributed on an as is basis"),
    ("mitname", r"((^| )mit licen[sc]e|identifier mit\b|(only|0|clause) or mit\b)"),
    ("mitgrant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mitnotice", "the above copyright notice and this permission notice shall be included"),
    ("asis", "the software is provided as is (without warranty|and .{1,60} disclaims? all warranties)"),
    ("noliability", "in no event shall the (authors|copyright holders|contributors).{0,40} be liable"),
    ("iscgrant", "permission to use copy modify and ?(or)? distribute this software for any purpose"),
    ("bsdname", "(^| )bsd licen[sc]e"),
    ("bsdgrant", "redistribution and use in source and binary forms"),
    ("bsdsource", "redistributions of source code must retain"),
    ("bsdbinary", "redistributions in binary form must reproduce"),
    ("bsdnames", "neither the name of .* may be used to endorse"),
    ("mpl2", r"(mozilla public licen[sc]e|(^| )mpl) ?(v|version)? ?2\b"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("publicdomain", "(in|into) the public domain"),
    ("reserved", "all rights reserved"),
    ("copyright", "(^| )copyright( c)? [0-9]{4}"),
]
#: Rules over identifier sequences, first rule first; identifiers stand in order, copyright lines between.
RULES = [
    ("BSD-3-Clause", ["bsdgrant", "bsdsource", "bsdbinary", "bsdnames"]),
    ("BSD-2-Clause", ["bsdgrant", "bsdsource", "bsdbinary"]),
    ("MIT", ["mitname", "mitgrant", "mitnotice"]),
    ("MIT", ["mitgrant", "mitnotice"]),
    ("MIT", ["mitname"]),
    ("ISC", ["iscgrant", "asis"]),
    ("Apache-2.0", ["apache2", "apachecopy", "apachecopy", "apacheasis"]),
    ("Apache-2.0", ["apache2", "apachecopy", "apacheasis"]),
    ("Apache-2.0", ["apache2"]),
    ("AGPL-3.0-or-later", ["agpl3later"]),
    ("AGPL-3.0-or-later", ["agpl3", "orlater"]),
    ("AGPL-3.0", ["agpl3"]),
    ("AGPL", ["agplany"]),
    ("LGPL-3.0-or-later", ["lgpl3later"]),
    ("LGPL-3.0-or-later", ["lgpl3", "orlater"]),
    ("LGPL-3.0", ["lgpl3"]),
    ("LGPL-2.1-or-later", ["lgpl21later"]),
    ("LGPL-2.1-or-later", ["lgpl21", "orlater"]),
    ("LGPL-2.1", ["lgpl21"]),
    ("LGPL-2.0-or-later", ["lgpl20later"]),
    ("LGPL-2.0-or-later", ["lgpl20", "orlater"]),
    ("LGPL-2.0", ["lgpl20"]),
    ("LGPL", ["lgplany"]),
    ("GPL-3.0-or-later", ["gpl3later"]),
    ("GPL-2.0-or-later", ["gpl2later"]),
    ("GPL-3.0-or-later", ["gpl3", "orlater"]),
    ("GPL-3.0", ["gpl3"]),
    ("GPL-2.0-or-later", ["gpl2", "orlater"]),
    ("GPL-2.0", ["gpl2"]),
    ("GPL", ["gplany"]),
    ("MPL-2.0", ["mpl2"]),
    ("CC0-1.0", ["cc0"]),
    ("CC-BY-NC-SA", ["ccbyncsa"]),
    ("CC-BY-NC-ND", ["ccbyncnd"]),
    ("CC-BY-NC", ["ccbync"]),
    ("CC-BY-SA", ["ccbysa"]),
    ("CC-BY-ND", ["ccbynd"]),
    ("CC-BY", ["ccby"]),
    ("BSD", ["bsdname"]),
    ("Unlicense", ["unlicense"]),
    ("Public-Domain", ["publicdomain"]),
    ("All-Rights-Reserved", ["reserved"]),
]
#: A sentence without any of these words has no identifier; most texts stop at this test.
WORDS = ["licen", "copyright", "rights reserved", "permission", "redistribution", "warranty", "liable", "public domain",
         "neither the name", "apache", "gpl", "cc by", "cc-by", "cc0", "creative commons", "bsd", "mpl", "any later version",
         "extent possible under law", "mozilla public", "permission", "(c) ", "mit "]


def sequence(rule: list[str]) -> str:
    """Pattern of a rule over a string of blank-enclosed identifiers."""
    return " " + "  (?:copyright  )*".join(rule) + " "


#: The same as a pattern over raw text, in which any run of blanks, line ends and comment marks stands between two words.
LIKELY = "|".join(w.replace("(", r"\(").replace(")", r"\)").replace(" ", "[^a-z0-9]+") for w in WORDS)


def _marked(sentence: Column) -> Column:
    """A sentence with the place of every identifier marked; of matches that overlap, the one first in SENTENCES stays."""
    for name, pattern in SENTENCES:
        sentence = F.regexp_replace(sentence, pattern, f" <{name.upper()}> ")  # no pattern has capitals
    return sentence


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in order, as one string `` a  b  c ``.

    A sentence ends at a stop or an empty line (one of comment marks alone is empty) and may go on over line ends. It has
    all identifiers whose patterns match, each as often as it does.
    """
    parts = F.split(text, r"(?<=[.!?])\s+|(?:\r\n|\n|\r(?!\n))[ \t*#/;%|>-]*(?=[\r\n])")
    likely = F.filter(parts, lambda s: F.lower(s).rlike(LIKELY))
    normal = F.transform(likely, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    found = F.flatten(F.transform(normal, lambda s: F.regexp_extract_all(_marked(s), F.lit("<([A-Z0-9]+)>"), F.lit(1))))
    return F.array_join(F.transform(found, lambda s: F.concat(F.lit(" "), F.lower(s), F.lit(" "))), "")


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus sentences, licences and n_unmatched for every row.

    ``sentences`` are the identifiers met, in text order; ``licences`` the distinct licences of the rules, by name;
    ``n_unmatched`` the identifiers that no rule used. Whole texts count; a null or empty text has none of them.
    """
    has = F.lower(F.col(text)).rlike(LIKELY)
    rows = docs.select(*keep, F.coalesce(F.when(has, sentence_ids(F.col(text))), F.lit("")).alias("__ids"))
    used = F.col("__ids")
    for name, rule in RULES:
        used = F.regexp_replace(used, sequence(rule), f" ={name} ")
    words = lambda c: F.filter(F.split(c, " +"), lambda x: x != "")
    rows = rows.withColumn("__used", used)
    named = F.filter(words(F.col("__used")), lambda x: x.startswith("="))
    return rows.select(*keep, words(F.col("__ids")).alias("sentences"),
                       F.array_sort(F.array_distinct(F.transform(named, lambda x: F.substring(x, 2, 60)))).alias("licences"),
                       F.size(F.filter(words(F.col("__used")), lambda x: ~x.startswith("="))).alias("n_unmatched"))


def oracle(table: str, key: str = "doc_id", text: str = "text") -> str:
    """The same scan as SQL with joins: one row per sentence, a table of patterns, a fold over the rules."""
    quoted = lambda x: x.replace("'", "''")
    patterns = ", ".join(f"({i}, '{name}', '{quoted(p)}')" for i, (name, p) in enumerate(SENTENCES))
    folded = "ids"
    for name, rule in RULES:
        folded = f"regexp_replace({folded}, '{quoted(sequence(rule))}', ' ={name} ', 'g')"
    return f"""WITH patterns(n, name, pattern) AS (VALUES {patterns}),
split AS (SELECT {key}, unnest(s) AS sentence, generate_subscripts(s, 1) AS place FROM (SELECT {key},
  string_split_regex(regexp_replace({text}, '([.;:!?])[ \\t]+', '\\1' || chr(10), 'g'), '[\\r\\n]+') AS s FROM {table})),
likely AS (SELECT {key}, place, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM split
  WHERE {" OR ".join(f"contains(lower(sentence), '{w}')" for w in WORDS)}),
known AS (SELECT {key}, place, arg_min(name, n) AS name FROM likely JOIN patterns ON regexp_matches(sentence, pattern) GROUP BY ALL),
lines AS (SELECT {key}, string_agg(' ' || name || ' ', '' ORDER BY place) AS ids FROM known GROUP BY ALL),
used AS (SELECT {key}, coalesce(ids, '') AS ids, coalesce({folded}, '') AS used FROM {table} LEFT JOIN lines USING ({key}))
SELECT {key}, list_filter(string_split_regex(ids, ' +'), lambda x: x <> '') AS sentences,
  list_sort(list_distinct(list_transform(list_filter(string_split_regex(used, ' +'), lambda x: starts_with(x, '=')), lambda x: x[2:]))) AS licences,
  len(list_filter(string_split_regex(used, ' +'), lambda x: x <> '' AND NOT starts_with(x, '=')))::INT AS n_unmatched FROM used"""
