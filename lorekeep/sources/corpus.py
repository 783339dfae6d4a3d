"""Notes and sessions as one corpus: one current row per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.session import cut
from lorekeep.sources.tables import table


def latest(df: DataFrame, keys: list[str], *order: str, most_broadcast_rows: int = 1_000_000) -> DataFrame:
    """The row of each key that comes first by `order`, descending with nulls last. Ties are decided by the
    columns named after, so name enough of them; rows with a null key are left out.

    Which keys have several rows is counted on the keys alone. All others, nearly all, pass where they are read; only
    rows of repeated keys, texts and all, are shuffled and ordered.
    """
    present = df.where(" and ".join(f"{k} is not null" for k in keys))
    repeated = cut(present.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated")
    if repeated.count() <= most_broadcast_rows:
        repeated = F.broadcast(repeated)
    by = W.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    first = present.join(repeated, keys, "left_semi").withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")
    return present.join(repeated, keys, "left_anti").unionByName(first)


def searchable(prefix: str = "") -> Column:
    """All text of a session, in one string."""
    c = lambda name: F.col(prefix + name)
    joined = lambda array, f: F.array_join(F.transform(array, f), " ")
    both = lambda a, b: F.concat_ws(" ", a, b)
    return F.concat_ws(
        " ",
        c("title"),
        c("summary"),
        c("what_happened"),
        F.array_join(c("decisions"), " "),
        joined(c("changes"), lambda x: both(x["path"], x["description"])),
        joined(c("problems"), lambda x: both(x["problem"], x["solution"])),
        F.array_join(c("insights"), " "),
        F.array_join(c("questions"), " "),
        F.array_join(c("next_steps"), " "),
        joined(c("related_notes"), lambda x: x["title"]),
        joined(c("extra_sections"), lambda x: both(x["name"], x["content"])),
        F.array_join(c("tags"), " "),
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "notes"), ["id"], "updated", "content", "title")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "sessions"), ["id"], "created", "summary", "what_happened", "title")


def as_corpus(notes: DataFrame, sessions: DataFrame) -> DataFrame:
    """id, type, category, title, content, tags, created, updated, date, branch, project, session_id of notes and
    sessions. A note's date is the day it was created; a session's content is all its text."""
    created = notes.schema["created"].dataType
    n = notes.select(
        "id", F.lit("note").alias("type"), "category", "title", "content", "tags", "created", "updated",
        F.date_format("created", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("branch"),
        F.lit(None).cast("string").alias("project"), F.col("metadata")["session_id"].alias("session_id"),
    )
    s = sessions.select(
        "id", F.lit("session").alias("type"), F.lit(None).cast("string").alias("category"), "title",
        searchable().alias("content"), "tags", F.col("created").cast(created), F.lit(None).cast(created).alias("updated"),
        "date", "branch", "project", "session_id",
    )
    return n.unionByName(s)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """as_corpus of the current rows of both tables."""
    return as_corpus(notes(spark, folder), sessions(spark, folder))
