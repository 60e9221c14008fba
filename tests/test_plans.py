"""Plans that must hold at scale, and a sample of registered queries against their oracle."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests import compare
from wirelens.operators import corpus

SAMPLE = ["b07_normalize_title", "c14_digest_filter", "d11_d12_classify", "d08_tag_names", "e01_duplicate_titles", "e03_join_epss", "f09_health_report", "g01_spikes", "j12_thin", "flagship_category_spikes"]
PLANS = ["e03_join_epss", "e04_join_kev", "e15_watchlist_hits", "f05_entity_sizes", "f14_dominant_sources", "g02_keep_first", "h02_page", "i01_merge_corpus", "g09_digest_candidates", "c15_since"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, sf, name):
    state, n, _took, _oracle, detail = compare.check(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert state == "ok" and n > 0, detail


@pytest.mark.parametrize("name", PLANS)
def test_no_cross_join_and_no_python_in_plans(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "Python" not in text


def test_keep_first_is_cut_before_the_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert "WindowGroupLimit" in plan(corpus.keep_first(docs, ["text"], [docs.doc_id]))


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(entry.queries()["c08_alertable"](spark, sf))
    assert "n_chars" not in text.split("ReadSchema")[1][:120]
    orders = plan(entry.queries()["i05_delete_absent"](spark, sf))
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)" in orders


def test_keys_and_oracles_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 120
