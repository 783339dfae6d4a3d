import sqlite3

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import keyword, weights
from lorekeep.operators.hybrid import fuse
from lorekeep.operators.index import SearchIndex, WeightIndex, postings_of, rows_of

DOCS = [
    ("1", "Row group cache", "the replica holds a row group of the café", ["api", "rest"]),
    ("2", "Replica lag", "replica replica lag in the queue", ["api"]),
    ("3", "Queue drain", "drain the queue until the group of rows is empty", []),
    ("4", "dev-orchestrator notes", "orchestrator of dev tasks", ["dev"]),
    ("5", None, None, None),
    ("6", "Checksum", "nothing but a checksum of the manifest", ["Rest", "replica"]),
    ("7", "Deadline", "deadlines and deadlocks", ["lock"]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "note", "c") for d in DOCS], "id string, title string, content string, tags array<string>, type string, category string")


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, title, content, tags)")
    db.executemany("insert into f values (?, ?, ?, ?)", [(i, t, c, " ".join(g or [])) for i, t, c, g in DOCS])
    return db


@pytest.mark.parametrize(
    "query", ["replica", "replica queue", "replica OR checksum", "queue NOT drain", "dead*", '"row group"', '"dev orchestrator"', "cafe", "replica queue OR manifest"]
)
def test_scores_equal_full_text_search(docs, fts, query):
    theirs = {i: -r for i, r in fts.execute("select id, rank from f where f match ?", (query,))}
    ours = {r["id"]: r["score"] for r in keyword.bm25(docs, query).collect()}
    assert ours.keys() == theirs.keys() and ours
    for i, score in theirs.items():
        assert ours[i] == pytest.approx(score, rel=1e-6)


def test_tag_filters(docs):
    found = {r["id"] for r in keyword.note_search(docs, "replica", tags=("REST",)).collect()}
    assert found == {"1", "6"}
    assert keyword.note_search(docs, "replica", tags=("api", "rest")).count() == 1


def test_unknown_order_is_an_error(docs):
    with pytest.raises(ValueError):
        keyword.search(docs, "x", sort="updated")


QUERIES = ["replica", "replica queue", "replica OR checksum", "queue NOT drain", "dead*", '"row group"', '"dev orchestrator"', "cafe", '"replica replica lag" OR "row gro"*', "none"]


def test_stored_index_scores_like_a_scan(spark, docs, tmp_path):
    postings_of(docs).write.parquet(str(tmp_path / "p"))
    rows_of(docs).write.parquet(str(tmp_path / "r"))
    index = SearchIndex(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "r")))
    row = index.postings.where("id = '2' and field = 'content' and term = 'replica'").first()
    assert (row["positions"], row["tf"], row["length"]) == ([0, 1], 2, 9)
    for query in QUERIES:
        scanned = {r["id"]: r["score"] for r in keyword.bm25(docs, query).collect()}
        assert {r["id"]: r["score"] for r in index.bm25(query).collect()} == pytest.approx(scanned), query


def test_later_generations_count(spark, docs):
    """Row 2 is rewritten and row 1 is gone: scores are those of the corpus as it is now."""
    new = spark.createDataFrame([("2", "Queue", "a queue", ["x"], "note", "c")], docs.schema)
    gone = rows_of(docs.where("id = '1'"), 2).withColumn("gone", F.lit(True))
    index = SearchIndex(postings_of(docs).unionByName(postings_of(new, 1)), rows_of(docs).unionByName(rows_of(new, 1)).unionByName(gone), changed=True)
    now = docs.where("id not in ('1', '2')").unionByName(new)
    for query in ("replica", "queue", "group OR queue"):
        assert {r["id"]: r["score"] for r in index.bm25(query).collect()} == pytest.approx({r["id"]: r["score"] for r in keyword.bm25(now, query).collect()})


def test_stored_weights(spark, tmp_path):
    rows = spark.createDataFrame([("a", "login session token"), ("b", "login queue drain"), ("c", "queue queue"), ("d", "")], "id string, text string")
    counts = weights.term_counts(rows, "id", F.col("text"))
    known = WeightIndex.vocabulary_of(counts, 4)
    index = WeightIndex(WeightIndex.weights_of(counts, known, 4), known, 4)
    hits = {r["id"]: r["similarity"] for r in index.similar("Login session, token unknownword").collect()}
    assert hits["a"] == pytest.approx(1) and set(hits) == {"a", "b"} and index.similar("unknownword").count() == 0 and index.similar("").count() == 0


def test_tfidf(spark):
    rows = spark.createDataFrame([("a", "login session token"), ("b", "login queue drain"), ("c", "queue queue"), ("d", "")], "id string, text string")
    counts = weights.term_counts(rows, "id", F.col("text"))
    w = weights.tfidf(counts, weights.document_frequency(counts), 4)
    norms = {r["id"]: r["n"] for r in w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()}
    assert norms.keys() == {"a", "b", "c"} and all(n == pytest.approx(1) for n in norms.values())
    hits = weights.similar_rows(w, w.where("id = 'a'").select("term", "w")).orderBy(F.desc("similarity")).collect()
    assert [h["id"] for h in hits] == ["a", "b"] and hits[0]["similarity"] == pytest.approx(1)


def test_single_row_corpus_has_no_weights(spark):
    counts = weights.term_counts(spark.createDataFrame([("a", "login token")], "id string, text string"), "id", F.col("text"))
    assert weights.tfidf(counts, weights.document_frequency(counts), 1).count() == 0


def test_fusion(spark):
    side = lambda rows: spark.createDataFrame(rows, "id string, score double")
    both = {r["id"]: r["score"] for r in fuse(side([("a", 4.0), ("b", 2.0)]), side([("b", 0.9), ("c", 0.1)])).collect()}
    assert both == pytest.approx({"a": 0.7, "b": 0.3, "c": 0.0})
    alone = {r["id"]: r["score"] for r in fuse(side([]), side([("b", 0.9), ("c", 0.1)])).collect()}
    assert alone == {"b": 0.9, "c": 0.1}
    assert fuse(side([]), side([])).count() == 0


def test_nearest(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", None)], "doc_id string, vector array<float>")
    assert [(r["doc_id"], round(r["similarity"], 3)) for r in weights.nearest_to(rows, [1.0, 0.0]).collect()] == [("a", 1.0), ("b", 0.6)]
