"""Streaming forms: captured observations, the access log, and indexes kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lorekeep.functions.keys import norm_id
from lorekeep.functions.text import observation
from lorekeep.functions.times import instant_micros
from lorekeep.operators.capture import CAPTURED_TOOL, HOOK
from lorekeep.operators.index import postings_of, rows_of
from lorekeep.session import cut
from lorekeep.sources.sinks import Store


def captured(lines: DataFrame, minutes: int = 5) -> DataFrame:
    """(at, content, head): observations of a stream (value, at) of hook lines, one for each first 50 characters in
    `minutes`. The state is bounded by the watermark: repeats are known only while it lasts."""
    rows = lines.withWatermark("at", f"{minutes} minutes").select("at", F.from_json("value", HOOK).alias("h"))
    kept = rows.where(F.col("h.tool_name") == CAPTURED_TOOL).select("at", observation(F.col("h.output")).alias("content"))
    return kept.where("content <> ''").withColumn("head", F.substring("content", 1, 50)).dropDuplicatesWithinWatermark(["head"])


def access_windows(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Accesses per entry, type and window of a stream (entry_id, accessed_at, access_type); accesses that come later
    than `late` after the newest are left out."""
    rows = log.select(
        norm_id(F.col("entry_id")).alias("entry_id"), "access_type", F.timestamp_micros(instant_micros(F.col("accessed_at"))).alias("at")
    ).where("entry_id is not null and at is not null")
    return rows.withWatermark("at", late).groupBy(F.window("at", width), "entry_id", "access_type").agg(F.count("*").alias("n"))


def into_store(rows: DataFrame, store: Store, name: str, keys: list[str], checkpoint: str) -> DataStreamWriter:
    """Each micro-batch is upserted into a table of the store. Replaying a batch changes nothing."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.upsert(name, batch, keys))


def index_updates(docs: DataFrame, store: Store, checkpoint: str) -> DataStreamWriter:
    """Keeps the inverted index of the store: each micro-batch appends the postings of its rows as a generation, sorted
    by term like the rest, and older ones of these rows no longer count. Of rows that come twice in a batch any one
    counts. A batch that is replayed appends the same again under a higher generation."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            rows = cut(batch.dropDuplicates(["id"]), "batch")
            generation = store.version("index_rows") + 1
            store.append("postings", postings_of(rows, generation))
            store.append("index_rows", rows_of(rows, generation))

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def run_once(writer: DataStreamWriter) -> None:
    """Works off what is there and ends."""
    writer.trigger(availableNow=True).start().awaitTermination()
