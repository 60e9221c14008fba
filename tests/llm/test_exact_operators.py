"""Pieces, Jaccard join, repeated passages, search, fingerprints, licences and pages against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirelens.llm import columns as C
from wirelens.llm import fingerprints, html_text, jaccard_join, licences, pieces, queries, suffix_dedup, top_k
from wirelens.llm.components import components

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def frame(spark, rows, extra=True):
    C.session(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n_chars", F.lit("x")).withColumn("key", F.lit(1)).withColumn("a", F.lit(None).cast("int")) if extra else df


# -- 1: pieces


@pytest.fixture(scope="module")
def machines():
    sentencepiece = pytest.importorskip("sentencepiece")
    return pieces.load(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdehinorst  \n\té漢🙂.,019ÀZ\x00", max_size=60))
def test_paths_equal_the_library(machines, text):
    t, library = machines
    assert t.encode(text) == library.encode(text)


def test_pieces_of_odd_rows(spark, machines):
    rows = [(1, None), (2, ""), (3, "  two  blanks \n"), (4, "漢字 x 🙂"), (4, "漢字 x 🙂"), (5, "x" * 20_000), (6, "ab " * 20_000), (None, "z")]
    model = pieces.read_model(spark, f"file://{MODEL}")
    out = queries.encoded(frame(spark, rows), f"file://{MODEL}").collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    texts = collections.Counter((d, tuple(machines[1].encode(t or ""))) for d, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.pieces)) for r in out) == texts
    assert pieces.decode(pieces.encode(frame(spark, rows).limit(0), model), model).count() == 0
    strange = spark.createDataFrame([(1, None), (2, [None, -1, 99_999_999, 5])], "doc_id long, pieces array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode(strange, model).collect()} == {1: "", 2: "\x02"}


def test_unigram_path_is_the_cheapest():
    """A model of the other kind: best sum of scores, found by trying every split."""
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    vocabulary = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "ba": -9.0, "bab": -5.5}
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18\x01") for p, s in vocabulary.items())
    t = pieces.load(body + field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"))

    def best(text):
        if not text:
            return 0.0
        return max((vocabulary[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in vocabulary), default=-np.inf)

    for text in ("ab", "bab", "abab", "babab ab", "aabbab"):
        spelled = t.normalise(text)
        ids = t.encode(text)
        assert "".join(t.surface[i] for i in ids) == spelled
        assert np.isclose(sum(vocabulary[t.surface[i]] for i in ids), sum(best(w) for w in t.words(spelled)))


# -- 3: Jaccard join


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def joined(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 90, 3)])
def test_join_equals_all_pairs(spark, width, percent, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    rows, base = [], []
    for d in range(260):
        if base and rng.random() < 0.6:
            words = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words))
                words[at:at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14, 30, 60, 200]))) + (" " + line if rng.random() < 0.4 else "")
        base.append(text)
        rows.append((d, text.upper() if rng.random() < 0.2 else text))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two"), (906, " ".join(vocabulary * 60))]
    join = jaccard_join.Join(width=width, percent=percent)
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows).repartition(3), join=join).select("doc_id", "n_shingles", "component_id").collect())
    assert got == joined(rows, width, percent)
    kept = jaccard_join.without_near_copies(frame(spark, rows), join=join)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in joined(rows, width, percent) if d == c)
    assert kept.columns == frame(spark, rows).columns


def test_join_of_empty_and_repeated_rows(spark):
    assert jaccard_join.near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (8, "a b c d e")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [("3", "3"), ("3", "3"), ("8", "3"), ("None", "None")]
    assert [r.component_id for r in jaccard_join.near_duplicates(frame(spark, [(None, "a b c d e")])).collect()] == [None]


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(120)) for w in "xy")
    bridge = [(1, one), (3, two), (2, one), (2, two), (9, one + " more")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, bridge)).collect())
    assert got == [(1, 117, 1), (2, 117, 1), (2, 117, 2), (3, 117, 2), (9, 118, 1)]  # 1 and 3 have nothing in common
    tiny = [(1, one), (1, "short"), (2, one + " and some more words")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, tiny)).collect())
    assert got == [(1, 1, 1), (1, 117, 1), (2, 121, 1)]  # the tiny text takes no link away


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 6: repeated passages


def cleaned(rows, span=suffix_dedup.SPAN):
    seen = collections.Counter(b[i:i + span] for b in ((t or "").encode() for _, t in rows) for i in range(len(b) - span + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats_equal_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", hot)
    rng = random.Random(5)
    letters = "abcdefgh é漢\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 230, 400, 900)]
    rows = []
    for d in range(120):
        parts = [text(rng.choice([0, 1, 50, 300]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            a = rng.choice([0, 0, 3, 40])
            parts += [p[a:len(p) - rng.choice([0, 0, 1, 25])], text(rng.choice([0, 2, 80]))]
        rows.append((d, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "ab" * 400), (503, "x" * 199), (504, "x" * 200), (505, "yz" * 100), (506, rows[3][1]), (507, text(9000))]
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(3))
    assert sorted(tuple(r) for r in got.drop("kept").collect()) == cleaned(rows)
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


# -- 7: pages


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain words", "plain words"),
    ('<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy now.</div>'
     "<article><h1>Head &amp; line</h1><p>One  <b>bold</b>\n text.<br>More.<p>Two &lt;b&gt; here.</article><footer>&copy; x</footer></body></html>",
     "Head & line\n\nOne bold text. More.\n\nTwo <b> here."),
    ("<body><header>Site</header><main><p>Short.</p><div class='comments'><p>I disagree, strongly, with all of this.</p></div>"
     "<ul><li>First point</li><li>Second point</li></ul><form><p>Mail?</p></form><aside>Side</aside></main></body>",
     "Short.\n\nFirst point\n\nSecond point"),
    ("<body><div id=menu><a href=x>a</a></div><div><p>A long paragraph, of many words, that goes on and on.</p><p>Tiny.</p></div>"
     "<div class='cookie-notice'>We use cookies</div></body>", "A long paragraph, of many words, that goes on and on.\n\nTiny."),
    ("<article><p>a</p><script>var t='</p>';</script><!-- <p>no</p> --><p>b &#233; &unknown; <a href='/x'>link</a></p><p", "a\n\nb é &unknown; link"),
])
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


def test_main_text_keeps_whole_articles():
    paragraph = "Words, words, words, words, words. " .ljust(400, "w")
    prose, cells, items = [paragraph] * 10, [f"c{i:03d}" for i in range(40)], [f"short item number {i:02d}" for i in range(40)]
    tagged = lambda tag, texts: "".join(f"<{tag}>{x}</{tag}>" for x in texts)
    rows = "".join(f"<tr>{tagged('td', cells[i:i + 4])}</tr>" for i in range(0, 40, 4))
    for tag in ("article", "main"):
        assert html_text.main_text(f"<{tag}>{tagged('p', prose)}<table>{rows}</table></{tag}>").split("\n\n") == prose + cells
        assert html_text.main_text(f"<{tag}>{tagged('p', prose)}<ul>{tagged('li', items)}</ul></{tag}>").split("\n\n") == prose + items
        assert html_text.main_text(f"<{tag}>{tagged('p', prose)}<ul><li><a href=x>Source</a></ul></{tag}>").split("\n\n") == prose + ["Source"]
    head = "A heading of some fifty characters above the text."
    assert html_text.main_text(f"<body><div><a href=x>Away</a></div><div><h1>{head}</h1>{tagged('p', prose)}<table>{rows}</table></div></body>").split("\n\n") == [head, *prose, *cells]
    figure = "<article><p>Text.</p><figure><img src=x><figcaption>A caption.</figcaption></figure><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then.</p></article>"
    assert html_text.main_text(figure) == "Text.\n\nA caption.\n\nIf x=1 then."


@pytest.mark.parametrize(("page", "text"), [
    ("<main><p>Long paragraph, with words, here.</p><p class='notice-period'>Two months.</p><section id='side-effects'><p>Aches, often.</p></section></main>",
     "Long paragraph, with words, here.\n\nTwo months.\n\nAches, often."),
    ("<article><p>One.</p><p title=O'Brien>Two, it's here.</p><p>Three.</p></article>", "One.\n\nTwo, it's here.\n\nThree."),
    ("<article><p><a href=x>All is linked</a></p></article>", "All is linked"),
    ("<article><p>a<!--> b <!-- c --!> d</p></></article>", "a b d"),
    ("<article></article><div class=cookie-notice>We use cookies.</div>", ""),
    ("<div class='sidebar_2 x'><p>Side, text.</p></div><div class=site-header>Head, words.</div><div><p>The text, of the page.</p></div>", "The text, of the page."),
])
def test_names_and_attributes_of_pages(page, text):
    assert html_text.main_text(page) == text


def test_ratio_decides_inside_articles_too():
    prose = "Word after word, and so on. " * 20
    page = f"<article><h1>Title</h1><div>By X</div><div><span>3 comments</span></div><p>{prose}</p><div class=adbox>Buy, now.</div><div>Share this</div></article>"
    assert html_text.main_text(page) == f"Title\n\n{prose.strip()}"
    assert "By X" in html_text.main_text(page, share=0)  # without the ratio, bylines and share lines stay
    body = f"<div class='related'><p>{prose}</p><p>{prose}</p></div><div><a href=x>Home</a></div>"
    assert html_text.main_text(f"<body>{body}</body>") == f"{prose.strip()}\n\n{prose.strip()}"  # so much weight overrules a name
    assert html_text.main_text(f"<body>{body}<main><p>Short.</p></main></body>") == "Short."


def test_made_pages_by_labelled_blocks():
    """Pages put together from blocks known to be content or not, with and without an article element."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    for turn in range(200):
        content = [f"{words(5)}", *(". ".join(words(12) for _ in range(rng.randint(3, 8))) + "." for _ in range(rng.randint(2, 9)))]
        inner = f"<h1>{content[0]}</h1>" + "".join(f"<p>{c}" + rng.choice(["</p>", ""]) for c in content[1:])
        menu = "<ul>" + "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(rng.randint(1, 9))) + "</ul>"
        apart = [f"<nav>{menu}</nav>", menu, f"<div class=ad>{words(9)}, {words(4)}.</div>", f"<footer>{words(8)}. {words(3)}.</footer>", f"<div id=site-menu>{menu}</div>"]
        before, after = rng.sample(apart, 2), rng.sample(apart, 2)
        tag = ("article", "main", "div")[turn % 3]
        page = f"<body>{''.join(before)}<{tag}>{inner}</{tag}>{''.join(after)}</body>"
        assert html_text.main_text(page) == "\n\n".join(content), page


@pytest.mark.parametrize("page", ["<b>" * 20000 + "</i>" * 20000, "<div>x" * 20000, "<p><table>" + "<b>" * 20000 + "</p>" * 20000,
                                  "<div a='" * 20000, "<a b=c " * 20000, "<!--" * 20000, f"<div class={'sidebar' * 5000}x>y</div>"])
def test_time_of_nested_and_broken_pages(page):
    start = time.monotonic()
    html_text.main_text(page)
    assert time.monotonic() - start < 5


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "<p>x</p>"), (None, None, "<div>" * 3000 + "deep"), (2, "v", "")], "page_id long, url string, html string")
    rows = html_text.extract(pages.withColumn("text", F.lit(1))).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in rows) == [("1", "", 0), ("1", "x", 1), ("2", "", 0), ("None", "deep", 4)]
    assert html_text.extract(pages.limit(0)).count() == 0


# -- 8: search


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.2, (400, 8)).astype(np.float32)
    vectors[50:60] = vectors[40]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, []), (1100, [1.0, None] * 4), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in top_k.search(df.repartition(5), lambda k: k % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    grid = np.floor(vectors.astype(np.float64) * 1024)
    want = []
    for q in range(0, 400, 20):
        score = grid @ grid[q]
        best = sorted((-score[i], i) for i in range(400) if i != q)[:10]
        want += [(q, n + 1, i, int(-s)) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert top_k.search(few, lambda k: k == 0).count() == 2
    assert top_k.search(df.limit(0), lambda k: k == 0).count() == 0
    assert top_k.search(few, lambda k: k == 9).count() == 0


def test_search_of_large_and_equal_vectors(spark):
    large = [(1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [-1e300, 0.0]), (4, [0.5, 0.5]), (5, [3e12, -1.0])]
    got = top_k.search(spark.createDataFrame(large, "vec_id long, embedding array<double>"), lambda k: k < 5).collect()
    ends = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(got) == 16 and ends[1, 2] == 2 ** 63 - 1 and ends[1, 3] == -2 ** 63 and ends[4, 5] == 512 * 3 * 10 ** 12 * 1024 - 512 * 1024
    same = [(i, [0.1, 0.2]) for i in range(300)] + [(i, [0.3, -0.1]) for i in range(300, 500)]
    got = top_k.search(spark.createDataFrame(same, "vec_id long, embedding array<double>").repartition(4), lambda k: k % 100 == 0, k=5).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 200, 300, 400)}
    assert found == {0: [1, 2, 3, 4, 5], 200: [0, 1, 2, 3, 4], 300: [301, 302, 303, 304, 305], 400: [300, 301, 302, 303, 304]}


# -- 9: licences


@pytest.mark.parametrize(("text", "found"), [
    (None, []), ("", []), ("Nothing here.", []),
    ("Released under the MIT License.", ["MIT"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of it.\nThe above copyright notice and this permission notice shall be included in all copies.", ["MIT"]),
    ("The above copyright notice and this permission notice shall be included in all copies.", []),
    ("Redistribution and use in source and binary forms are permitted: x\nRedistributions of source code must retain this.\nRedistributions in binary form must reproduce this.", ["BSD-2-Clause"]),
    ("This work is licensed under the GNU General Public License, version 3. Or, at your option, any later version.", ["GPL-3.0-or-later"]),
    ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", ["All-Rights-Reserved", "CC-BY-NC"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
])
def test_licence_rules(spark, text, found):
    assert licences.scan(frame(spark, [(1, text)])).first().licences == found


WRAPPED = {
    "BSD-3-Clause": """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "ISC": """Copyright (c) 2020 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful.
""",
    "GPL-2.0-or-later": """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 *
 * It is free.
""",
    "MIT": """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
""",
}


def test_licences_wrapped_over_lines(spark):
    rows = [(i, t.replace("\n", end)) for i, (t, end) in enumerate((t, end) for t in WRAPPED.values() for end in ("\n", "\r\n"))]
    out = {r.doc_id: r.licences for r in licences.scan(frame(spark, rows)).collect()}
    for i, name in enumerate(name for name in WRAPPED for _ in range(2)):
        assert name in out[i] and set(out[i]) <= {name, "All-Rights-Reserved"}, (name, out[i])


@pytest.mark.parametrize(("text", "found"), [
    ("Dual-licensed under the MIT License or the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
    ("Take it under GPL v2 or BSD license", ["BSD", "GPL-2.0"]),
    ("It is under the GNU General Public License version 3", ["GPL-3.0"]),
    ("MPL 2.0, GPL v3, CC BY-SA 4.0 and CC0 1.0 parts", ["CC-BY-SA", "CC0-1.0", "GPL-3.0", "MPL-2.0"]),
])
def test_sentences_of_several_licences(spark, text, found):
    assert licences.scan(frame(spark, [(1, text)])).first().licences == found


def test_versions_identifiers_and_denials(spark):
    cases = [
        ("See GPL 2019.", []), ("Apache License 2019.", []), ("GNU Lesser General Public License.", ["LGPL"]),
        ("GNU Lesser General Public License, version 2.1 or any later version.", ["LGPL-2.1-or-later"]), ("LGPLv2 code", ["LGPL-2.0"]),
        ("GNU Affero General Public License, version 1.", ["AGPL"]), ("GNU Affero General Public License version 3.", ["AGPL-3.0"]),
        ("SPDX-License-Identifier: GPL-2.0-only OR MIT", ["GPL-2.0", "MIT"]), ("SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0-or-later"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("This is not licensed under the MIT License.", []),
        ("It is not released under the GNU General Public License, version 2, but under the Apache License 2.0.", ["Apache-2.0"]),
    ]
    out = {r.doc_id: r.licences for r in licences.scan(frame(spark, [(i, text) for i, (text, _) in enumerate(cases)])).collect()}
    assert [(text, out[i]) for i, (text, _) in enumerate(cases)] == cases


def test_licences_of_an_empty_table(spark):
    assert licences.scan(frame(spark, [(1, "x")]).limit(0)).count() == 0


# -- 10: fingerprints


def test_fingerprints_follow_generalised_jaccard(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = [(d * 3, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 80, 300])))) for d in range(60)] + [(1000, None), (1001, ""), (1002, "é漢 " * 500), (2000, "a b c"), (2001, "a b c")]
    out = {r.doc_id: r for r in fingerprints.against_edits(frame(spark, rows)).collect()}
    texts = {d: t or "" for d, t in rows}
    ids = sorted(texts, reverse=True)

    def jaccard(a, b):
        x, y = (collections.Counter(t.split() or [""]) for t in (a, b))
        return sum((x & y).values()) / sum((x | y).values())

    errors = []
    for i, d in enumerate(ids):
        t, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        edited = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12
    assert out[2000].fingerprint == out[2001].fingerprint and out[1000].fingerprint == out[1001].fingerprint
    assert out[2001].near_next == 1.0 and out[1001].near_next == 1.0


def test_fingerprints_of_skewed_weights(spark):
    """One word holds 90% of the weight or more: likeness follows the weight, not the number of words."""
    alike = [(i, "the " * 1000 + " ".join(f"a{i}x{j}" for j in range(9))) for i in range(12)]
    apart = [(100 + i, f"w{i} " * 1000 + " ".join(f"same{j}" for j in range(9))) for i in range(12)]
    out = {r.doc_id: r.near_next for r in fingerprints.against_edits(frame(spark, alike + apart)).collect()}
    assert abs(np.mean([out[i] for i in range(1, 12)]) - 1000 / 1018) < 0.02 and min(out[i] for i in range(1, 12)) > 0.85
    assert abs(np.mean([out[100 + i] for i in range(1, 12)]) - 9 / 2009) < 0.02 and max(out[100 + i] for i in range(1, 12)) < 0.15


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "z")]
    out = fingerprints.against_edits(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == [("1", 1), ("1", 3), ("None", 1)]
    assert fingerprints.against_edits(frame(spark, rows).limit(0)).count() == 0
    lone = fingerprints.against_edits(frame(spark, [(5, "abc def")])).first()
    assert lone.near_next == 1.0


def test_native_operators_use_no_python(spark, sf):
    for name in ("op9_licences", "op10_fingerprints"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
