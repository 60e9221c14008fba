"""Language, quality and mixing: accuracy on rows they did not learn from, and the defined results of odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelens.llm import columns as C
from wirelens.llm import language, mixing, quality, queries

ODD = [(1, None), (2, ""), (3, "   \n"), (4, "12 34 !!"), (5, "the house and the tree"), (5, "the house and the tree"), (None, "the house"),
       (6, "a" * 50_000), (7, "the " * 20_000)]


@pytest.fixture(scope="module")
def small(spark, sf):
    C.session(spark)
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    C.session(spark)
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))


def test_language_of_held_out_texts(spark, sf, small):
    docs, _ = small
    out = queries.op4_language(spark, sf)
    assert {c: t for c, t in out.dtypes} | {"doc_id": "bigint"} == dict(out.dtypes)
    found = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert found[0] >= 0.97 and found[1] > 20
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.count() == docs.count()


def test_marks_alone_are_no_language(spark, small):
    rows = [(1, "\u0301\u0302 \u0301"), (2, "\u0301 12 !"), (3, "\u0301a")]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), language.fit(small[0])).collect()}
    assert found[1] == found[2] == ("und", 0.0) and found[3][0] != "und"


def test_language_of_odd_rows(small, odd):
    model = language.fit(small[0])
    rows = language.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 4)) and 0 <= r.score <= 1
        assert r.rejected or r.lang_pred in model.languages
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 5}) == 1
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id < 5").count() == 0
    assert language.predict(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("learned", [("en", "de", "fr", "es"), ("en", "fr"), ("en",)])
def test_language_rejects_what_it_did_not_learn(spark, sf, learned):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    letters = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10))) for _ in range(60)), "none") for i in range(50)]
    C.session(spark)
    model = language.fit(docs.where(F.col("lang").isin(*learned) & ~C.held_out(F.col("doc_id"))))
    out = language.predict(docs.union(spark.createDataFrame(letters, docs.schema)), model, keep=("doc_id", "lang"))
    share = {r.lang: r.share for r in out.groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert all(share[x] > 0.9 for x in {"en", "de", "fr", "es", "none"} - set(learned)) and all(share[x] < 0.06 for x in learned)


def test_language_without_labels(small):
    docs = small[0].withColumn("lang", F.lit(None).cast("string"))
    rows = language.predict(docs.limit(5), language.fit(docs)).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in rows} == {("und", 0.0, True)}


def test_quality_ranks_held_out_texts(spark, sf):
    out = queries.op5_quality(spark, sf.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    good, poor = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert len(poor) > 5 and (good[:, None] > poor[None]).mean() + (good[:, None] == poor[None]).mean() / 2 > 0.9
    assert out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_quality_of_odd_rows(spark, small, odd):
    model = quality.fit(*small)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = quality.fit(small[0], small[1].limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_mix_meets_targets(spark, small):
    docs, labels = small
    model = mixing.fit(docs, queries.domains(labels))
    assert model.domains == ("clean", "poor", "toxic")
    out = mixing.mix(docs, model, queries.TARGETS)
    rows = out.toPandas()
    p, n, rate = np.stack(rows.posterior), rows.n_tokens.to_numpy(), rows.rate.to_numpy()
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1)
    share = (rate * n) @ p / n.sum()
    assert np.allclose(share, [queries.TARGETS[d] for d in model.domains], atol=0.02)
    assert (np.abs(rows["copies"] - rate) < 1).all()
    whole = mixing.mix(docs, model, queries.TARGETS, whole="clean").toPandas()
    clean = np.stack(whole.posterior).argmax(1) == 0
    assert (whole.rate[clean] >= 1).all() and (whole["copies"][clean] >= 1).all()


def test_rates_solve_the_least_squares_problem(spark):
    """Targets that can be met are met; of those that cannot, no small change of the rates comes closer."""
    rng = np.random.default_rng(1)
    p, n = rng.dirichlet([1, 1, 1], 200), rng.integers(1, 100, 200)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")

    def off(rate, want):
        return (rate * n) @ p / n.sum() - want

    for want, met in (([0.6, 0.3, 0.1], True), ([0.34, 0.33, 0.33], True), ([1.0, 0.0, 0.0], False)):
        rate = mixing.rates_from(p, mixing.fit_rates(table, np.array(want) * n.sum()))
        residual = off(rate, want)
        assert (rate >= 0).all()
        if met:
            assert np.abs(residual).max() < 2e-4
        else:
            slope = p @ residual  # no descent: zero where the rate is free, not negative at the bound
            assert np.linalg.norm(residual) < 0.2 and (slope > -0.02).all() and np.abs(slope[rate > 0.05]).max() < 0.05


def test_mix_of_odd_rows(spark, small, odd):
    model = mixing.fit(small[0], queries.domains(small[1]))
    rows = mixing.mix(odd, model, queries.TARGETS).collect()
    assert len(rows) == len(ODD) and all(r.rate >= 0 and r["copies"] >= 0 for r in rows)
    assert mixing.mix(odd.limit(0), model, queries.TARGETS).count() == 0
    none = mixing.fit(small[0], queries.domains(small[1]).limit(0))
    assert {(r.rate, r["copies"]) for r in mixing.mix(odd, none, queries.TARGETS).collect()} == {(1.0, 1)}


def test_held_out_quarter_is_that_of_the_contract(spark):
    import zlib

    rows = spark.range(200).withColumn("h", C.held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_licences_equal_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf.replace('0.001', '0.01')}/documents.parquet'")
    want = sorted((d, tuple(s), tuple(l), n) for d, s, l, n in c.sql(queries.ORACLES["op9_licences"]).fetchall())
    got = sorted((r.doc_id, tuple(r.sentences), tuple(r.licences), r.n_unmatched) for r in queries.op9_licences(spark, sf.replace("0.001", "0.01")).collect())
    assert got == want and sum(bool(r[2]) for r in got) > 5
