"""Do entries, files, vectors and the text index agree?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.keys import norm_id, store_path


def _live_paths(files: DataFrame) -> DataFrame:
    return files.where("removed_at is null").select(store_path(F.col("filepath")).alias("path")).where("path is not null").distinct()


def _entry_paths(entries: DataFrame) -> DataFrame:
    return entries.select(norm_id(F.col("id")).alias("id"), store_path(F.col("filepath")).alias("path")).distinct()


def entries_without_file(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path) of entries whose file is gone or that name none."""
    return _entry_paths(entries).where("id is not null").join(_live_paths(files), "path", "left_anti").select("id", "path")


def files_without_entry(entries: DataFrame, files: DataFrame) -> DataFrame:
    return _live_paths(files).join(_entry_paths(entries).where("path is not null"), "path", "left_anti")


def without_orphans(entries: DataFrame, files: DataFrame) -> DataFrame:
    """The entries whose file exists: what a repair keeps."""
    keyed = entries.withColumn("_path", store_path(F.col("filepath")))
    return keyed.join(_live_paths(files).withColumnRenamed("path", "_path"), "_path", "left_semi").drop("_path")


def orphan_vectors(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, backend, model) of vectors of documents without entry."""
    ids = entries.select(norm_id(F.col("id")).alias("doc_id")).distinct()
    return vectors.select(norm_id(F.col("doc_id")).alias("doc_id"), "backend", "model").distinct().join(ids, "doc_id", "left_anti")


def unindexed(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, type) of notes and sessions that have no entry."""
    ids = entries.select(norm_id(F.col("id")).alias("id")).distinct()
    return docs.select(norm_id(F.col("id")).alias("id"), "type").distinct().join(ids, "id", "left_anti")


def side_by_side(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each part. Each is a distributed count; only single rows are put together."""
    rows = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().pivot("name", list(parts)).agg(F.first("n"))


def health(
    entries: DataFrame, files: DataFrame, docs: DataFrame, vectors: DataFrame, backend: str, model: str,
    indexed: DataFrame | None = None, recorded: str | None = None,
) -> DataFrame:
    """One row: counts of files, entries, documents and active vectors, of what is amiss, and whether all is well.

    With `indexed`, the rows (id) of the text index, it is held against the entries too. `recorded` is the backend and
    model, 'a:b', that the index was built with; another one than the active is amiss, none is not.
    """
    active = vectors.where((F.col("backend") == backend) & (F.col("model") == model))
    ids = entries.select(norm_id(F.col("id")).alias("id")).where("id is not null").distinct()
    parts = {
        "n_files": _live_paths(files),
        "n_entries": ids,
        "n_documents": docs.select("id").distinct(),
        "n_active_vectors": active.select(norm_id(F.col("doc_id")).alias("id")).distinct(),
    }
    amiss = {
        "n_entries_without_file": entries_without_file(entries, files),
        "n_files_without_entry": files_without_entry(entries, files),
        "n_unindexed": unindexed(docs, entries),
        "n_orphan_vectors": orphan_vectors(active, entries),
    }
    if indexed is not None:
        words = indexed.select(norm_id(F.col("id")).alias("id")).distinct()
        parts["n_indexed"] = words
        amiss |= {"n_without_postings": ids.join(words, "id", "left_anti"), "n_orphan_postings": words.join(ids, "id", "left_anti")}
    wide = side_by_side(parts | amiss)
    fine = sum((F.col(c) for c in amiss), F.lit(0)) == 0
    other = F.lit(bool(recorded) and recorded != f"{backend}:{model}")
    return wide.withColumn("other_backend", other).withColumn("healthy", fine & (F.col("n_files") == F.col("n_entries")) & ~other)
