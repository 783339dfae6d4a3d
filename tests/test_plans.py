"""The physical plans stay those the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import features, keyword
from lorekeep.plans import search_queries
from lorekeep.sources.corpus import corpus, notes
from lorekeep.sources.tables import table


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_feature_cells_take_two_exchanges_and_three_columns(spark, folder):
    for target, exchanges in ((5, 2), (10_000_000, 1)):
        cells = features.type_cells(table(spark, folder, "access_log"), "entry_id", "access_type", "accessed_at", 10**15, 10**12, target_rows=target)
        text = plan(cells)
        assert len(re.findall(r"Exchange hashpartitioning", text)) == exchanges
        assert "ingested_at" not in text and "Python" not in text


def test_scores_are_a_scan_without_shuffle(spark):
    docs = spark.createDataFrame([("1", "t", "replica lag", ["x"], "note")], "id string, title string, content string, tags array<string>, type string")
    text = plan(keyword.bm25(docs, "replica OR lag"))
    assert "Exchange" not in text and "Python" not in text


def test_facets_reach_the_scan(spark, folder, tmp_path):
    corpus(spark, folder).write.parquet(str(tmp_path / "c"))
    rows = keyword.Facets(type="note", category="how-to", after="2025-01-01").where(spark.read.parquet(str(tmp_path / "c"))).select("id")
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan(rows))[1]
    assert all(c in pushed for c in ("EqualTo(type", "EqualTo(category", "GreaterThanOrEqual(date"))
    assert re.search(r"ReadSchema: struct<id:string,type:string,category:string,date:string>", plan(rows))


TEXTS = ("content", "summary", "what_happened", "decisions", "insights")


@pytest.mark.parametrize("name", ["bm25_or", "bm25_phrase", "search_faceted", "hybrid_search", "tfidf_search"])
def test_searches_read_their_terms_and_shuffle_no_text(spark, folder, name):
    text = plan(search_queries.queries()[name](spark, folder))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*PushedFilters: \[([^\n]*)\], ReadSchema", text)
    stored = [(columns, pushed) for columns, pushed in scans if "term#" in columns]
    assert all("In(term" in pushed or "EqualTo(term" in pushed or "Or(" in pushed for _, pushed in stored)
    assert stored or name == "hybrid_search"
    if name != "search_faceted":  # it fetches the texts of its few hits
        assert not any(t in columns for columns, _ in scans for t in TEXTS)


def test_current_rows_are_chosen_on_keys(spark, folder):
    """Only rows of repeated ids go through an exchange with their texts."""
    text = plan(notes(spark, folder))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and len(re.findall(r"BroadcastHashJoin \[id[^\n]*LeftSemi", text)) == 1


def test_bloom_filter_is_broadcast_only_below_its_limit(spark):
    from lorekeep.operators.orphans import orphan_references

    parents = spark.range(1000).select(F.lit("s").alias("space"), F.col("id").cast("string").alias("key"))
    refs = parents.select(F.lit("t").alias("source"), "space", "key", F.lit(None).cast("string").alias("period"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(orphan_references(refs, parents))
        assert "BroadcastHashJoin" not in plan(orphan_references(refs, parents, most_broadcast_mb=-1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
