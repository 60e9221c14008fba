"""Main text of web pages by tag-path ratios.

A page is read as blocks in page order, each with its path of tags from the root. Text length and punctuation are
summed per path, so that a short paragraph shares the weight of the long ones beside it. The two ratios per block are
fused, smoothed along the page, and a threshold decides which paths are content.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wirelens.llm import columns as C

#: Fixed values of the public HTML standard: elements without content, elements whose content is no markup.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg annotation annotation-xml textarea title select object canvas audio video xmp".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var wbr "
             "math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
             "mtable mtd mtext mtr munder munderover semantics".split())
#: Opening one of these ends an open paragraph; opening a list item or cell ends the one before.
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
             "pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
BARRIER = {"ul", "ol", "menu", "table", "dl", "article", "section", "div", "main", "body", "html"}
#: Containers that hold no article, by element and by the words of their class, id or role.
APART = set("nav footer aside form head button dialog fieldset".split()) | RAW
APART_WORDS = ("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice "
               "notices alert popup modal newsletter subscribe signup comment comments respond disqus reply replies side sidebar menu nav "
               "navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended widget toolbar pagination "
               "pager login search complementary contentinfo dialog hidden").split()
#: Words that say nothing about a container's use; a name made of these and at least one of the above speaks for a container set apart.
FILLER_WORDS = ("all area article articles bar block blog body bottom box button buttons column container content desktop email form global "
                "group head inner item items left link links list mail main message mobile news outer page panel policy post posts primary "
                "reader readers right secondary section site slot sticky stories text this thread title top unit user users wrap wrapper").split()
WORDS = re.compile(rf"(?>{'|'.join(sorted(APART_WORDS + FILLER_WORDS, key=len, reverse=True))})|[-_\d]|.", re.S)
KNOWN_WORDS = {*APART_WORDS, *FILLER_WORDS}
HEADERS = {"header", "site-header", "page-header"}
KEEP_WORDS = {"article", "main", "content", "post", "story", "entry", "body", "text"}
#: Elements whose short text belongs to the prose around it, whatever its ratio.
PROSE = set("article main p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption figure pre blockquote summary".split())
#: A comment, a declaration, or a tag with its attributes, as the tokenizer of the public HTML standard ends them.
VALUE = r"""(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+)"""
NAME = r"(?>=[^\s/>=]*+|[^\s/>=]++)"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z]|\Z)[^>]*(?:>|\Z)"
                   rf"|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|{NAME}(?>\s*+=\s*+{VALUE})?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"({NAME})(?>\s*+=\s*+({VALUE}))?|[\s/]++", re.S)
PUNCTUATION = re.compile(r"[.,;:!?…、。¿¡]")


@dataclass
class Block:
    """Text of one block element, its tag and path, whether a container sets it apart, whether it is inside an article.

    ``named`` tells that only the name (class, id, role) of a container speaks against it. ``element`` is the number of the
    element in page order with those of the elements around it, innermost first.
    """

    path: int
    tag: str
    apart: bool
    named: bool
    inside: bool
    element: tuple
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _attributes(written: str) -> dict[str, str]:
    """Lower-cased names and values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(written):
        if name:
            quoted = value[:1] in ("'", '"')
            out.setdefault(name.lower(), references.unescape(value[1:].removesuffix(value[0]) if quoted else value).lower())
    return out


def _apart(tag: str, written: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is set apart by what it is, and whether by its name."""
    known = _attributes(written) if written.strip() else {}
    if tag in APART or (tag == "header" and not inside) or "hidden" in known or known.get("aria-hidden") == "true":
        return True, False
    names = " ".join(known.get(a, "") for a in ("class", "id", "role")).split()
    if tag in ("body", "html", "article", "main") or KEEP_WORDS & set(names):
        return False, False
    return False, any(_speaks_against(n) or (n in HEADERS and not inside) for n in names)


@lru_cache(maxsize=4096)
def _speaks_against(name: str) -> bool:
    """Whether a name falls into known words, one of which names what is no article."""
    words = {w for w in WORDS.findall(name) if w.isalpha()}
    return words <= KNOWN_WORDS and not words.isdisjoint(APART_WORDS)


def blocks(page: str) -> tuple[list[Block], dict[int, int]]:
    """Blocks of a page in page order, and the last element that each element holds.

    Unclosed elements end as browsers end them; cut-off tags are no text.
    """
    paths: dict[tuple[int, str], int] = {}
    stack = [("", 0, "", False, False, False, (0, 0, None))]  # tag; path, tag, apart, named, inside and element of its block
    places: dict[str, list[int]] = {}  # where in the stack elements of a tag stand
    out: list[Block] = []
    last: dict[int, int] = {}
    current: Block | None = None
    links, at, elements = 0, 0, 0

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(*stack[-1][1:])
            out.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(piece)

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set[str], barrier: set[str]) -> None:
        nonlocal current, links
        i = innermost(tags)
        if not i or i < innermost(barrier - tags):
            return
        for tag, *_, element in stack[i:]:
            links -= tag == "a"
            places[tag].pop()
            if tag not in INLINE:
                last[element[0]], current = elements, None
        if stack[-1][3:5] != stack[i - 1][3:5]:
            current = None
        del stack[i:]

    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            close({tag}, set() if tag not in ("p", "li") else BARRIER)
            if tag not in INLINE:
                current = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ENDS_P:
            close({"p"}, BARRIER | {"td", "th", "li"} - {"p"})
        if tag in SIBLINGS:
            close(SIBLINGS[tag], BARRIER - ({"table"} if tag == "tr" else set()))
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and current is not None:
                text(" ") if tag != "wbr" else None
            continue
        _, path, owner, apart, named, inside, element = stack[-1]
        own, by_name = _apart(tag, found[3], inside)
        if tag in INLINE:
            if (own and not apart) or (by_name and not named):
                current = None
        else:
            path, current, owner = paths.setdefault((path, f"{tag}!" if by_name else tag), len(paths) + 1), None, tag
            elements += 1
            element = (elements, element[1] + 1, element)
        links += tag == "a"
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, path, owner, apart or own, named or by_name, inside or tag in ("article", "main"), element))
    for *_, element in stack:
        last.setdefault(element[0], elements)
    return out, last


def _shared(a: tuple, b: tuple) -> tuple:
    """The innermost element around both."""
    while a[0] != b[0]:
        if a[1] >= b[1]:
            a = a[2]
        else:
            b = b[2]
    return a


def main_text(page: str, *, share: float = 0.25, overrule: float = 0.9, least: int = 500) -> str:
    """Content blocks of a page joined by an empty line.

    The ratio of a path is its unlinked text length per block (all text, where everything is linked), raised by its
    punctuation per block and smoothed along the page. A path is heavy if its ratio reaches ``share`` of the largest.

    Elements that hold no article by the HTML standard never count. A container whose name speaks against it counts only on
    pages without article text, where the paths under such names hold over ``overrule`` of all weight and ``least`` characters.
    Within article and main elements that hold text, heavy paths are content, and so are paths with punctuation and parts
    of prose (headings, items, cells); light paths of bare containers, such as bylines and share lines, are not. On other pages
    heavy paths show where the content is, and every block with unlinked text in the innermost element around them is content.
    """
    read, last = blocks(page)
    texts = ((b, " ".join(references.unescape("".join(b.parts)).split())) for b in read if not b.apart)
    found = [(b, w) for b, w in texts if w]
    if not found:
        return ""
    number = np.unique([b.path for b, _ in found], return_inverse=True)[1]
    many = np.bincount(number)
    size = np.array([len(w) for _, w in found], float)
    free = size * [1 - min(1.0, b.linked / max(1, sum(map(len, b.parts)))) for b, _ in found]
    named, inside = (np.array([getattr(b, k) for b, _ in found]) for k in ("named", "inside"))
    marks = np.array([len(PUNCTUATION.findall(w)) for _, w in found], float)

    def fused(length: np.ndarray) -> np.ndarray:
        return ((np.bincount(number, length) / many) * (1 + np.bincount(number, marks) / many))[number]

    open_ = ~named
    if not (inside & open_).any() and free[named].sum() >= least and fused(free)[named].sum() > overrule * fused(free).sum():
        open_ = np.ones_like(named)
    if not (free[open_] > 0).any():
        free = size
    weight = fused(free * open_)
    padded = np.pad(weight, 1, mode="edge")
    smooth = 0.2 * padded[:-2] + 0.6 * padded[1:-1] + 0.2 * padded[2:]
    ratio = (np.bincount(number, smooth) / many)[number] * (weight > 0)
    within = inside & open_
    if (weight[within] > 0).any():
        punctuated = np.bincount(number, marks)[number] > 0
        prose = np.array([b.tag in PROSE for b, _ in found])
        chosen = within & ((ratio >= share * ratio[within].max()) | punctuated | prose)
    else:
        chosen = (ratio >= share * ratio.max()) & (ratio > 0)
        if chosen.any():
            heavy = [found[i][0].element for i in np.flatnonzero(chosen)]
            around = _shared(min(heavy, key=itemgetter(0)), max(heavy, key=itemgetter(0)))[0]  # numbers follow page order
            chosen |= (free > 0) & open_ & [around <= b.element[0] <= last[around] for b, _ in found]
    return "\n\n".join(w for (_, w), good in zip(found, chosen) if good)


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns plus text and n_chars (code points) for every page; null or empty pages give the empty text.

    Whole pages are read, and nothing that is content is cut.
    """
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["text"] = [main_text(x) if isinstance(x, str) else "" for x in part.pop("__html")]
            part["n_chars"] = part["text"].str.len().astype("int64")
            yield part

    out = StructType([*pages.select(*keep).schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])
    C.session(pages.sparkSession)
    return pages.select(*keep, F.col(html).cast("string").alias("__html")).mapInPandas(task, out)
