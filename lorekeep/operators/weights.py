"""TF-IDF weights and dense vectors: building, cosine, nearest rows for a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lorekeep.functions.text import terms

LEAST_COSINE = 0.01


def term_counts(docs: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(id, term, tf)."""
    words = docs.select(F.col(id_column).alias("id"), F.explode(terms(text)).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df): in how many rows each term is."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(frequency: DataFrame, n_docs: int) -> DataFrame:
    """Terms that are in at most 95 % of the rows (rounded down; all of them where that is none)."""
    most = int(0.95 * n_docs) or n_docs
    return frequency.where(F.col("df") <= most)


def weighted(counts: DataFrame, known: DataFrame, n_docs: int) -> DataFrame:
    """(id, term, w): (1 + ln tf) * ln((N + 1) / (df + 1)), scaled to length 1 per row, by the vocabulary known (term,
    df). Rows stay sparse; terms outside the vocabulary are ignored, and a row without weight has no rows. The
    lengths are summed per row and joined back, so a long row is never sorted in one place."""
    raw = counts.join(known, "term").select("id", "term", ((1 + F.log("tf")) * F.log(F.lit(n_docs + 1) / (F.col("df") + 1))).alias("w"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    return raw.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(counts: DataFrame, frequency: DataFrame, n_docs: int) -> DataFrame:
    """weighted() by the vocabulary of term frequencies."""
    return weighted(counts, vocabulary(frequency, n_docs), n_docs)


def similar_rows(weights: DataFrame, query: DataFrame) -> DataFrame:
    """(id, similarity) of rows that share a term with the query's weights (term, w), above 0.01."""
    q = query.select("term", F.col("w").alias("qw"))
    dots = weights.join(q, "term").groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("similarity"))
    return dots.where(F.col("similarity") > LEAST_COSINE)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; 0 if their lengths differ or one is empty. Cosine for unit vectors."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), product).otherwise(F.lit(0.0))


def nearest_to(vectors: DataFrame, query: list[float], limit: int = 20, vector: str = "vector", key: str = "doc_id") -> DataFrame:
    """The rows most similar to one query vector, by dot product above 0.01. Rows of another length never match. The
    vectors of an Arrow batch are one matrix, multiplied at once."""
    q = np.asarray(query, dtype=np.float64)

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            fits = np.flatnonzero(pc.equal(pc.list_value_length(column), len(q)).fill_null(False).to_numpy(zero_copy_only=False))
            matrix = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            similarity = np.zeros(batch.num_rows)
            similarity[fits] = np.nan_to_num(matrix @ q, nan=0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(similarity)], [*batch.schema.names, "similarity"])

    schema = StructType([*vectors.schema.fields, StructField("similarity", DoubleType())])
    scored = vectors.mapInArrow(against, schema) if len(q) else vectors.withColumn("similarity", F.lit(0.0))
    return scored.where(F.col("similarity") > LEAST_COSINE).orderBy(F.desc("similarity"), key).limit(limit)


def truncated(vector: Column, dimensions: int) -> Column:
    """The first `dimensions` values; 0 keeps all."""
    return F.slice(vector, 1, dimensions) if dimensions else vector
