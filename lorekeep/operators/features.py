"""One row per entity with statistics for every event type, from an event log of any skew."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.keys import BLANKS, norm_id
from lorekeep.functions.times import instant_micros
from lorekeep.session import cut


def norm_type(c: Column) -> Column:
    """Trimmed, lower case, '_' for '-'; blank and null types are null."""
    return F.nullif(F.translate(F.lower(F.btrim(c, F.lit(BLANKS))), "-", "_"), F.lit(""))


def heavy_groups(rows: DataFrame, keys: list[str], n_rows: int, target_rows: int, sample_rows: int = 200_000, least_seen: int = 16) -> DataFrame:
    """(*keys, n): the groups that seem to hold more than target_rows rows, with how many.

    They are counted in a sample of about sample_rows rows and scaled up. A group must be seen least_seen times, so
    at most sample_rows / least_seen come out. They steer where rows go, and no result depends on them.
    """
    share = min(1.0, sample_rows / max(1, n_rows))
    drawn = rows if share == 1.0 else rows.sample(share, seed=1)
    seen = drawn.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= max(least_seen * min(1, n_rows // sample_rows), share * target_rows))
    return seen.select(*keys, F.ceil(F.col("n") / share).alias("n"))


def type_cells(
    events: DataFrame,
    entity: str,
    event_type: str,
    at: str,
    as_of_micros: int,
    window_micros: int,
    target_rows: int = 2_000_000,
    sample_rows: int = 200_000,
) -> DataFrame:
    """The filled cells of the feature table: (entity, event_type, n_window, n_total, last_at).

    Events of the same entity, type and instant count once. Events at or after as_of do not count. n_window
    counts [as_of - window, as_of), n_total everything before as_of, last_at is the last instant (microseconds).
    Rows with a null or blank entity or type, or an unreadable time, are left out; an empty log gives no rows.

    Two stages: a group of more than target_rows rows gets as many salts as bring each below that, chosen by the
    instant, so that duplicates meet under one salt; each (entity, type, salt) is reduced to partial statistics
    behind one exchange, and a second, small one merges them (without heavy groups the first is enough). One access
    repeated over more than target_rows rows is taken out before the exchange and put back as the single row it
    counts as. Both kinds are looked for in a sample of bounded size, so the log itself is read once.
    """
    spark = events.sparkSession
    named = events.select(
        norm_id(F.col(entity)).alias("entity"), norm_type(F.col(event_type)).alias("event_type"), F.col(at).alias("time")
    ).where("entity is not null and event_type is not null and time is not null")
    group, access = ["entity", "event_type"], ["entity", "event_type", "time"]
    n_rows = events.count()
    repeated, heavy = [], []
    if n_rows > target_rows:
        repeated = heavy_groups(named, access, n_rows, target_rows, sample_rows).select(*access).collect()
        if repeated:
            once_each = spark.createDataFrame(repeated, "entity string, event_type string, time string")
            named = named.join(F.broadcast(once_each), access, "left_anti").unionByName(once_each)
        heavy = heavy_groups(named, group, n_rows, target_rows, sample_rows).collect()
    rows = named.select(*group, instant_micros(F.col("time")).alias("at")).where(F.col("at") < as_of_micros)
    keys = group
    if heavy:
        salts = [(r["entity"], r["event_type"], -(-r["n"] // target_rows)) for r in heavy]
        spread = F.broadcast(spark.createDataFrame(salts, "entity string, event_type string, salts long"))
        salt = F.coalesce(F.pmod(F.xxhash64("at"), F.col("salts")), F.lit(0)).alias("salt")
        rows, keys = rows.join(spread, group, "left").select(*group, "at", salt), [*group, "salt"]
    once = rows.repartition(*keys).dropDuplicates([*keys, "at"])
    partial = once.groupBy(*keys).agg(
        F.count_if(F.col("at") >= as_of_micros - window_micros).alias("n_window"),
        F.count("*").alias("n_total"),
        F.max("at").alias("last_at"),
    )
    if not heavy:
        return partial
    return partial.groupBy(*group).agg(F.sum("n_window").alias("n_window"), F.sum("n_total").alias("n_total"), F.max("last_at").alias("last_at"))


def feature_table(
    events: DataFrame,
    entity: str,
    event_type: str,
    at: str,
    as_of_micros: int,
    window_micros: int,
    most_types: int = 100_000,
    **options,
) -> DataFrame:
    """One row per entity: event_types and, aligned with it, n_window, n_total and seconds_since_last.

    Every row carries the complete sorted list of types seen anywhere; types an entity never had count 0 and
    have a null recency. The list is held by the driver, so more than most_types distinct types is an error.
    """
    cells = cut(type_cells(events, entity, event_type, at, as_of_micros, window_micros, **options), "cells")
    found = [r[0] for r in cells.select("event_type").distinct().limit(most_types + 1).collect()]
    if len(found) > most_types:
        raise ValueError(f"more than {most_types} event types")
    types = sorted(found)
    numbers = cells.sparkSession.createDataFrame(list(enumerate(types)), "at int, event_type string")
    cell = F.struct("at", "n_window", "n_total", "last_at")
    per = cells.join(F.broadcast(numbers), "event_type").groupBy("entity").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    # Between two filled cells stand as many empty ones as their places are apart.
    empty = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("n_window"), F.lit(0).cast("long").alias("n_total"), F.lit(None).cast("long").alias("last_at"))
    before = lambda i: F.coalesce(F.get(F.col("cells"), i - 1)["at"], F.lit(-1))
    filled = F.flatten(F.transform("cells", lambda c, i: F.concat(F.array_repeat(empty, c["at"] - before(i) - 1), F.array(c))))
    rest = F.array_repeat(empty, F.lit(len(types) - 1) - F.element_at("cells", -1)["at"])
    return per.select("entity", F.concat(filled, rest).alias("cells")).select(
        "entity",
        F.from_json(F.lit(json.dumps(types)), "array<string>").alias("event_types"),
        F.col("cells.n_window").alias("n_window"),
        F.col("cells.n_total").alias("n_total"),
        F.transform("cells.last_at", lambda t: F.floor((F.lit(as_of_micros) - t) / F.lit(1_000_000))).alias("seconds_since_last"),
    )
