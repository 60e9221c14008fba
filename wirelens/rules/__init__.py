"""Rule tables: rows of data, not code.

Every tagger takes its rules as an argument; ``load`` returns the defaults
shipped next to this file. Patterns are case-insensitive unless a row says
otherwise, avoid look-around, and are matched against whole texts. ``anchors``
are lower-case words of which a match must contain at least one; one pass over
the text finds all that occur, and the others' patterns are skipped. Rows may also list plain words instead
of a pattern: one pass over the text finds the rules of which a first word begins
somewhere, and only their patterns run. Plain words: ``stems`` begin a word,
``names`` are whole words, ``first_of`` captures one of its whole words, and
``near`` asks that one of its stems comes later in the text, however far.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import cache, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

HERE = Path(__file__).parent


def _any_of(words: Iterable[str]) -> str:
    """Alternation of plain words; a blank may also be missing or a hyphen."""
    return "|".join("[ -]?".join(re.escape(part) for part in word.split(" ")) for word in words)


def spelled_out(row: dict) -> dict:
    """A row with the pattern and the anchors that its plain words stand for."""
    starts = [(key, end) for key, end in (("stems", ""), ("names", r"\b"), ("first_of", r"\b")) if row.get(key)]
    if not starts:
        return row
    group = "(" if "first_of" in row else "(?:"
    first = "|".join(rf"\b{group}{_any_of(row[key])}){end}" for key, end in starts)
    pattern = rf"(?:{first})(?s:.*)\b(?:{_any_of(row['near'])})" if row.get("near") else first
    words = [word for key, _ in starts for word in row[key]]
    return {**row, "pattern": pattern, "first": first, "starts": sorted({word.lower().split(" ")[0] for word in words})}


@cache
def load(name: str) -> tuple[dict, ...]:
    """Rows of one default rule table, in declared order."""
    return tuple(spelled_out(row) for row in json.loads((HERE / f"{name}.json").read_text(encoding="utf-8")))


@cache
def places() -> tuple[dict, ...]:
    """Region rules over titles: country names, demonyms and other names, as written, region by region."""
    regions: dict[str, list[str]] = {}
    for row in load("countries"):
        words = regions.setdefault(row.get("title_region", row["region"]), [])
        words += [row["country"], *row["demonyms"], *row.get("other", ())]
    agencies = {"label": "US", "names": ["FBI", "CISA", "NSA", "Pentagon", "Homeland Security"], "case_sensitive": True}
    abroad = [{"label": region, "names": words, "case_sensitive": region != "US"} for region, words in regions.items()]
    abroad[0]["stems"] = ["U.S."]
    return tuple(spelled_out(row) for row in [abroad[0], agencies, *abroad[1:]])


def spark_pattern(row: dict) -> str:
    """Pattern of a rule row with its flag for the JVM engine."""
    return row["pattern"] if row.get("case_sensitive") else "(?i)" + row["pattern"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body reads it.

    A plain column may be inlined into every use by the optimizer; a lambda
    argument is bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row, also where later filters and projections read it.

    Unlike a projection, a generator is never merged into what reads it.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _trie(words: Iterable[str]) -> str:
    """Pattern of the longest of the words at a place; shared beginnings are read once."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        parts = [re.escape(letter) + spelled(child) for letter, child in sorted(node.items()) if letter]
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return "" if not parts else f"(?:{body})?" if "" in node else body

    return spelled(root)


def _started(text: Column, rows: list[dict]) -> Column:
    """Numbers of the rules of which a first word begins somewhere in the text: one pass, however many rules there are.

    The place is looked at, not consumed, so that words within words are seen too; of several at one place the longest is
    found and stands for its beginnings.
    """
    words = sorted({w for r in rows for w in r.get("starts", ())})
    if not words:
        return F.array().cast("array<int>")
    meant = {w: [i for i, r in enumerate(rows) if any(w.startswith(s) for s in r.get("starts", ()))] for w in words}
    by_word = F.create_map(*[x for w, own in meant.items() for x in (F.lit(w), F.array(*map(F.lit, own)))])
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?=({_trie(words)}))"), 1)
    return F.flatten(F.transform(F.array_distinct(F.transform(found, F.lower)), lambda w: F.element_at(by_word, w)))


def _anchored(text: Column, rows: list[dict]) -> Column:
    """Numbers of the rules of which an anchor occurs somewhere in the text, in letters of either case: one pass over the
    bytes of a batch of texts finds the places of all first three bytes, and only those are compared further.
    """
    anchors = [(a.lower().encode(), i) for i, r in enumerate(rows) if not r.get("starts") for a in r.get("anchors", ())]
    always = sorted({i for a, i in anchors if len(a) < 3})
    own: dict[bytes, list[int]] = {}
    for word, i in anchors:
        if i not in always:
            own.setdefault(word, []).append(i)
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    codes = {word: (word[0] * 961 + word[1] * 31 + word[2]) for word in own}
    n = len(rows)

    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        flat = np.frombuffer((texts.buffers()[2] or b"")[int(ends[0]):int(ends[-1])].to_pybytes().translate(lower) if len(texts) and ends[-1] > ends[0] else b"", np.uint8)
        ends = ends - ends[0]
        pairs = [np.arange(len(texts), dtype=np.int64) * n + i for i in always]
        if len(flat) > 2 and codes:
            wide = flat.astype(np.uint32)
            code = wide[:-2] * 961 + wide[1:-1] * 31 + wide[2:]
            wanted = np.zeros(255 * 993 + 1, bool)
            wanted[list(codes.values())] = True
            places = np.flatnonzero(wanted[code])
            order = np.argsort(code[places], kind="stable")
            places, sorted_codes = places[order], code[places][order]
            for word, at in codes.items():
                here = places[np.searchsorted(sorted_codes, at):np.searchsorted(sorted_codes, at, "right")]
                here = here[here + len(word) <= len(flat)]
                for k, byte in enumerate(word):
                    here = here[flat[here + k] == byte]
                rows_of = np.searchsorted(ends, here, "right") - 1
                rows_of = np.unique(rows_of[here + len(word) <= ends[rows_of + 1]])
                pairs += [rows_of * n + i for i in own[word]]
        met = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        offsets = np.searchsorted(met, np.arange(len(texts) + 1) * n).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((met % n).astype(np.int32)))

    return F.arrow_udf(run, "array<int>")(text) if anchors else F.array().cast("array<int>")


def _gated(row: dict, number: int, candidates: Column, verdict: Column) -> Column:
    """The verdict, looked for only where a first word or an anchor of the rule occurs."""
    return F.array_contains(candidates, number) & verdict if row.get("starts") or row.get("anchors") else verdict


def matches(text: Column, row: dict) -> Column:
    """True when the rule's literal pattern matches; what must come later in the text is looked for behind the first match."""
    flag = "" if row.get("case_sensitive") else "(?i)"
    if not row.get("near"):
        return F.regexp_like(text, F.lit(flag + row["pattern"]))
    behind = F.regexp_extract(text, rf"{flag}(?s)^.*?(?:{row['first']})(.*)$", 1)
    return F.regexp_like(behind, F.lit(rf"{flag}\b(?:{_any_of(row['near'])})"))


def _judged(text: Column, rows: list[dict], body: Callable[[Column, list[Column]], Column]) -> Column:
    """``body`` of the text and of each rule's verdict; a pattern runs only where the rule is a candidate."""
    whole = F.coalesce(text, F.lit(""))
    return let(F.struct(whole.alias("text"), _anchored(whole, rows).alias("anchored")), lambda x: let(
        F.concat(x["anchored"], _started(x["text"], rows)),
        lambda c: body(x["text"], [_gated(r, i, c, matches(x["text"], r)) for i, r in enumerate(rows)])))


def matching(text: Column, rows: Iterable[dict], *fields: str, also: Column | None = None) -> Column:
    """Rules that match the text, in declared order, with their order and the named fields.

    With ``also``, the field ``also`` tells whether the rule matches that text too.
    """
    rows = list(rows)

    def found(t: Column, hits: list[Column]) -> Column:
        return F.array_compact(F.array(*[
            F.when(hit, F.struct(F.lit(i).alias("order"), *[F.lit(r[f]).alias(f) for f in fields],
                                 *([] if also is None else [matches(also, r).alias("also")])))
            for i, (hit, r) in enumerate(zip(hits, rows))]))

    return _judged(text, rows, found)


def any_matches(text: Column, rows: Iterable[dict]) -> Column:
    """True when any rule matches the text."""
    return _judged(text, list(rows), lambda _t, hits: reduce(Column.__or__, hits))
