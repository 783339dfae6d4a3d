"""The stored indexes of a data folder, built when a query first needs them and kept while the tables stay the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import weights
from lorekeep.operators.index import SearchIndex, WeightIndex, formed, postings_of, rows_of
from lorekeep.session import cut
from lorekeep.sources.corpus import corpus

_built: dict[tuple, object] = {}


def _state(spark: SparkSession, folder: str, *names: str) -> tuple:
    """Path, size and time of the files behind tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in names:
        at = path(f"{folder}/{name}.parquet")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)]
    return (spark.sparkContext.applicationId, *sorted(found))


def _is_there(stored: DataFrame) -> bool:
    """Whether the files of a scratch table still exist; its folder may have been cleared meanwhile."""
    spark = stored.sparkSession
    files = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in stored.inputFiles()[:1]]
    return all(f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(f) for f in files)


def _kept(kind: str, spark: SparkSession, folder: str, build):
    key = (kind, _state(spark, folder, "notes", "sessions"))
    index = _built.get(key)
    if index is None or not _is_there(index.postings if isinstance(index, SearchIndex) else index.weights):
        index = _built[key] = build(corpus(spark, folder))
    return index


def search_index(spark: SparkSession, folder: str) -> SearchIndex:
    def build(docs: DataFrame) -> SearchIndex:
        forms = cut(formed(docs), "forms")
        return SearchIndex(cut(postings_of(forms), "postings"), cut(rows_of(forms), "rows"), docs)

    return _kept("words", spark, folder, build)


def weight_index(spark: SparkSession, folder: str) -> WeightIndex:
    def build(docs: DataFrame) -> WeightIndex:
        n = docs.count()
        counts = cut(weights.term_counts(docs, "id", F.col("content")), "counts")
        known = cut(WeightIndex.vocabulary_of(counts, n), "vocabulary")
        return WeightIndex(cut(WeightIndex.weights_of(counts, known, n), "weights"), known, n)

    return _kept("weights", spark, folder, build)
