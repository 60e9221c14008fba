"""The pipeline's stages: columns, what each takes out, and what it leaves alone."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_exact_operators import cleaned, joined
from wirelens.llm import jaccard_join
from wirelens.llm import stages as corpus_pipeline


def test_stages_one_after_another(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen[name] = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == seen["language"].columns
    start = seen["language"]
    lettered = {r.doc_id for r in start.collect() if re.search(r"[^\W\d_]", r.text or "")}
    known = seen["near_copies"].collect()
    assert len(known) >= 0.98 * len(lettered)
    pairs = [(r.doc_id, r.text) for r in known]
    groups = joined(pairs, 5, 80)
    single = seen["repeats"].collect()
    assert sorted(r.doc_id for r in single) == sorted(d for d, _, c in groups if d == c)
    want = {r[0]: r[2] for r in cleaned([(r.doc_id, r.text) for r in single])}
    left = seen["mixing"].collect()
    before = {r.doc_id: r.text for r in single}
    assert all(len((r.text or "").encode()) <= len(before[r.doc_id].encode()) - want[r.doc_id] for r in left) and len(left) == len(single)
    mixed = {r.doc_id for r in seen["pieces"].collect()}
    assert mixed <= set(before) and len(mixed) > 0.5 * len(before)
    assert docs.where("not round_trip").count() == 0 and docs.select("doc_id").distinct().count() == len(mixed)


def test_repeated_rows_leave_one(spark, sf):
    """A row given twice and a row without doc_id lose their copies in stage 2, and what stays keeps its text in stage 3."""
    clean, other, third = (" ".join(f"{w}{i}" for i in range(80)) for w in ("clean", "other", "third"))
    rows = [(1, clean), (1, clean), (2, other), (5, clean), (None, other), (None, third), (None, third), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    single = corpus_pipeline.one_of_near_copies(spark, docs, sf)
    want = sorted([("1", clean), ("2", other), ("None", third), ("7", ""), ("8", "")])
    assert single.columns == docs.columns and sorted((str(r.doc_id), r.text or "") for r in single.collect()) == want
    left = corpus_pipeline.without_repeats(spark, single, sf)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == want


def test_further_columns_pass_through_every_stage(spark, sf, tmp_path):
    """Columns that the operators do not know, named like their own results, keep their values."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    for name in ("rate", "kept", "__row", "lang_pred", "ranges", "doc", "copies", "__text", "n_tokens", "component_id"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    docs = docs.withColumn("many", F.array("doc_id"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns, name
        wrong = [F.col(c) != F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in docs.columns[5:-1]]
        assert now.count() and now.where(F.array_contains(F.array(*wrong), True) | (F.col("many")[0] != F.col("doc_id"))).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == now.count()


def test_near_copies_in_rounds_without_a_second_copy_of_texts(spark, sf, monkeypatch):
    """Comparisons in rounds leave the rows of brute force; texts are not stored again, and sets go when they are spent."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stored, rounds, dropped = [], [], []
    for name, seen in (("stored", stored), ("drop", dropped)):
        monkeypatch.setattr(jaccard_join.C, name, lambda *a, f=getattr(jaccard_join.C, name), seen=seen: seen.append(a[-1]) or f(*a))
    count = jaccard_join._rounds
    monkeypatch.setattr(jaccard_join, "_rounds", lambda bulk, room: rounds.append(3) or 3)
    several = sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect())
    assert several == sorted(d for d, _, c in joined([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if d == c)
    assert len(rounds) == 2 and not any("text" in df.columns for df in stored)
    assert any(str(path).endswith("/sets") for path in dropped)
    assert count(100, 100) == 2 and count(0, 100) == count(None, 0) == 1


def test_sets_without_a_common_shingle_share_no_key(spark):
    """Empty segments are no keys: sets of any size with nothing in common do not meet, linked ones still do."""
    rng = np.random.default_rng(3)
    for join in (corpus_pipeline.NEAR, jaccard_join.Join()):
        for size in (1, 2, 20, 30, 60, 140, 183, 240, 400, 700):
            keys = [jaccard_join._keys(rng.integers(0, 1 << 63, size).astype(np.uint64), size, join) for _ in range(60)]
            assert len(np.unique(np.concatenate(keys))) == sum(len(np.unique(k)) for k in keys), size
            for _ in range(20):
                one = rng.integers(0, 1 << 63, size).astype(np.uint64)
                gone = int(rng.integers(0, join.differ(size) + 1))
                other = one[gone:] if len(one[gone:]) * 100 >= size * join.percent else one
                met = np.intersect1d(*[jaccard_join._keys(x, len(x), join) for x in (one, other)])
                assert len(met) or len(other) == size, (size, gone)


def test_families_of_many_blocks_are_compared_as_they_met(spark, sf, monkeypatch):
    """Pairs of sets that met, or blocks of a family: either way the rows are those of brute force."""
    rng = random.Random(5)
    rows = []
    for d in range(240):  # chains of texts, each a little further from its first one, and texts with a common half
        at = d % 12
        base = [f"w{at}x{i}" for i in range(120)]
        for _ in range(rng.randint(0, 16)):
            base[rng.randrange(120)] = f"y{rng.randrange(10 ** 6)}"
        rows.append((d, " ".join(base)))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(d for d, _, c in joined(rows, 5, 80) if d == c)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    choose, seen = jaccard_join._sparse, []
    for every in (True, False):
        monkeypatch.setattr(jaccard_join, "_sparse", lambda members, apart: seen.append(choose(members, apart).count()) or (
            members.select("family").distinct() if every else members.select("family").limit(0)))
        assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()) == want
    assert len(seen) == 2
