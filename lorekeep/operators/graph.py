"""The knowledge graph of notes and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import id8
from lorekeep.operators.dedup import first_by


def nodes(notes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(node, type, title, category, date); node is the first eight characters of the id."""
    n = notes.select(id8(F.col("id")).alias("node"), F.lit("note").alias("type"), "title", "category", F.lit(None).cast("string").alias("date"))
    s = sessions.select(id8(F.col("id")).alias("node"), F.lit("session").alias("type"), "title", F.lit(None).cast("string").alias("category"), "date")
    return n.unionByName(s)


def edges(notes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(source, target, type): a note comes from the session its metadata name (the latest with that label), a
    session is related to the notes it lists, known by the first eight characters of their ids."""
    labels = first_by(
        sessions.where("session_id <> ''").select("session_id", "id", "created"), ["session_id"], F.desc_nulls_last("created"), F.desc("id")
    )
    origin = notes.select(id8(F.col("id")).alias("source"), F.col("metadata")["session_id"].alias("session_id")).join(
        labels, "session_id"
    )
    listed = sessions.select(id8(F.col("id")).alias("source"), F.explode("related_notes").alias("r")).select(
        "source", id8(F.lower(F.trim("r.id"))).alias("target")
    )
    known = notes.select(id8(F.col("id")).alias("target")).distinct()
    related = listed.join(known, "target", "left_semi").distinct()
    return origin.select("source", id8(F.col("id")).alias("target"), F.lit("from_session").alias("type")).unionByName(
        related.select("source", "target", F.lit("related").alias("type"))
    )


def dot_lines(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(line): the body of a DOT graph, one statement a row; write them between 'digraph {' and '}'."""
    escaped = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    colour = F.when(F.col("type") == "note", "lightblue").otherwise("lightgreen")
    n = node_rows.select(F.format_string('  "%s" [label="%s", fillcolor=%s, style=filled];', "node", escaped(F.col("title")), colour).alias("line"))
    e = edge_rows.select(F.format_string('  "%s" -> "%s" [label="%s"];', "source", "target", "type").alias("line"))
    return n.unionByName(e)
