"""Counts, tags, usage and recent work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.keys import norm_id
from lorekeep.functions.times import instant_micros


def counts_by_type(docs: DataFrame) -> DataFrame:
    return docs.groupBy("type").agg(F.count("*").alias("n"))


def categories(notes: DataFrame) -> DataFrame:
    return notes.groupBy("category").agg(F.count("*").alias("n"))


def tag_counts(docs: DataFrame) -> DataFrame:
    """(tag, n): occurrences of each spelling."""
    return docs.select(F.explode("tags").alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


def top_tags(docs: DataFrame, limit: int = 10) -> DataFrame:
    return tag_counts(docs).orderBy(F.desc("n"), "tag").limit(limit)


def recent(docs: DataFrame, limit: int = 5, by: str = "created") -> DataFrame:
    return docs.orderBy(F.desc_nulls_last(by), "id").limit(limit)


def access_counts(log: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, title, type, n_accesses, last_access): the log is counted per id before it meets the entries;
    ids without entry stay as '(deleted)' and 'unknown'. last_access is in microseconds since 1970."""
    used = (
        log.select(norm_id(F.col("entry_id")).alias("entry_id"), instant_micros(F.col("accessed_at")).alias("at"))
        .where("entry_id is not null")
        .groupBy("entry_id")
        .agg(F.count("*").alias("n_accesses"), F.max("at").alias("last_access"))
    )
    names = entries.select(norm_id(F.col("id")).alias("entry_id"), "title", "type").groupBy("entry_id").agg(
        F.max(F.struct("title", "type")).alias("e")
    )
    return used.join(names, "entry_id", "left").select(
        "entry_id",
        F.coalesce("e.title", F.lit("(deleted)")).alias("title"),
        F.coalesce("e.type", F.lit("unknown")).alias("type"),
        "n_accesses",
        "last_access",
    )


def top_accessed(log: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    return access_counts(log, entries).orderBy(F.desc("n_accesses"), "entry_id").limit(limit)


def vectors_by_backend(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("backend", "model").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def storage(files: DataFrame) -> DataFrame:
    """(n_files, n_bytes) of the files that are there, the latest row of each path."""
    current = files.groupBy("filepath").agg(F.max_by(F.struct("n_bytes", "removed_at"), F.coalesce("removed_at", F.lit("9999-12-31").cast("timestamp_ntz"))).alias("f"))
    return current.where("f.removed_at is null").agg(F.count("*").alias("n_files"), F.sum("f.n_bytes").alias("n_bytes"))


def log_access(ids: DataFrame, access_type: str, path: str, at: str) -> None:
    """Appends an access of each id (a column entry_id) to the log at path; never a side effect of a search."""
    ids.select("entry_id", F.lit(at).alias("accessed_at"), F.lit(access_type).alias("access_type")).write.mode("append").parquet(path)
