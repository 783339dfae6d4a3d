"""Queries of problems 2 and 5 over the tables of a data folder, and their SQL for the oracle."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.keys import norm_id, store_path
from lorekeep.functions.times import instant_micros, month_of_micros
from lorekeep.operators.features import feature_table, type_cells
from lorekeep.operators.orphans import orphan_references, prefix_parents
from lorekeep.sources.tables import table

AS_OF = int(datetime(2025, 7, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000
WINDOW = 30 * 86_400 * 1_000_000
LEAST_ACCESSES = 5


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    cells = type_cells(table(spark, folder, "access_log"), "entry_id", "access_type", "accessed_at", AS_OF, WINDOW)
    return cells.where(F.col("n_window") >= LEAST_ACCESSES).select(
        F.col("entity").alias("entry_id"), F.col("event_type").alias("access_type")
    )


def p2_features(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "access_log")
    return feature_table(log, "entry_id", "access_type", "accessed_at", AS_OF, WINDOW).select(
        F.col("entity").alias("entry_id"),
        F.col("event_types").alias("access_types"),
        "n_window",
        "n_total",
        "seconds_since_last",
    )


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    entries, notes = table(spark, folder, "entries"), table(spark, folder, "notes")
    files, vectors = table(spark, folder, "store_files"), table(spark, folder, "vectors")
    log, sessions = table(spark, folder, "access_log"), table(spark, folder, "sessions")
    month = lambda c: month_of_micros(instant_micros(F.col(c)))

    def refs(source: str, space: str, df: DataFrame, key, period) -> DataFrame:
        return df.select(
            F.lit(source).alias("source"), F.lit(space).alias("space"), key.alias("key"), period.alias("period")
        )

    related = sessions.select(F.explode("related_notes").alias("r"), "created").select(
        norm_id(F.col("r.id")).alias("key"), F.date_format(F.col("created").cast("date"), "yyyy-MM").alias("period")
    )
    references = (
        refs("entries", "file", entries, store_path(F.col("filepath")), month("created"))
        .unionByName(refs("vectors", "entry", vectors, norm_id(F.col("doc_id")), month("created_at")))
        .unionByName(refs("access_log", "entry", log, norm_id(F.col("entry_id")), month("accessed_at")))
        .unionByName(refs("sessions", "note", related, F.col("key"), F.col("period")))
    )
    note_ids = notes.select(norm_id(F.col("id")).alias("key"))
    parent = lambda space, df, key: df.select(F.lit(space).alias("space"), key.alias("key"))
    parents = (
        parent("file", files.where("removed_at is null"), store_path(F.col("filepath")))
        .unionByName(parent("entry", entries, norm_id(F.col("id"))))
        .unionByName(parent("note", prefix_parents(note_ids, related), F.col("key")))
    )
    return references, parents


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(*_references(spark, folder)).select(
        "source", F.col("key").alias("missing_key"), "period"
    )


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return (
        orphan_references(*_references(spark, folder))
        .groupBy("source", "period")
        .agg(F.count("*").alias("n_missing_keys"), F.sum("n_references").alias("n_references"))
    )


def queries():
    return {"p2_found": p2_found, "p2_features": p2_features, "p5_found": p5_found, "p5_report": p5_report}


_INSTANT = r"""case when regexp_full_match(trim({c}), '[+-]?\d{{1,18}}')
    then case when abs(try_cast(trim({c}) as bigint)) <= 253402300799 then try_cast(trim({c}) as bigint) * 1000000 end
  when regexp_full_match(trim({c}), '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}(:\d{{2}}([.]\d+)?)?\s*(Z|[+-]\d{{2}}(:?\d{{2}})?)?')
    then epoch_us(try_cast(case when regexp_matches(trim({c}), '[T ].*(Z|[+-]\d{{2}}(:?\d{{2}})?)$') then trim({c}) else trim({c}) || 'Z' end as timestamptz)) end"""


def _instant(c: str) -> str:
    return _INSTANT.format(c=c)


def _month(micros: str) -> str:
    return f"coalesce(strftime(make_timestamp({micros}), '%Y-%m'), 'unknown')"


_ID = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_TYPE = "nullif(replace(lower(regexp_replace(access_type, '^\\s+|\\s+$', '', 'g')), '-', '_'), '')"

_CELLS = f"""log as (
    select distinct {_ID.format(c='entry_id')} as entry_id, {_TYPE} as access_type, {_instant('accessed_at')} as ts
    from access_log),
cells as (
    select entry_id, access_type, count(*) as n_total, max(ts) as last_at,
        count(*) filter (where ts >= {AS_OF - WINDOW}) as n_window
    from log where entry_id is not null and access_type is not null and ts < {AS_OF} group by all)"""

_PATH = r"""case when filepath is null or filepath = '' then null else
    list_reduce(list_prepend('', list_filter(string_split(
        case when replace(filepath, '\', '/') like '/%' then '' else '/srv/memstore/' end || replace(filepath, '\', '/'), '/'),
        lambda s: s not in ('', '.'))),
        lambda kept, s: case when s = '..' then regexp_replace(kept, '/[^/]*$', '') else kept || '/' || s end) end"""

_REFS = f"""paths as (
    select *, nullif(regexp_replace(full_path, '^/srv/memstore(/|$)', ''), '') as path
    from (select 'entries' as t, {_PATH} as full_path, created, null::timestamp as removed_at from entries
          union all select 'files', {_PATH}, null, removed_at from store_files)),
notes_ids as (select distinct {_ID.format(c='id')} as id from notes),
related as (
    select {_ID.format(c='r.id')} as key, coalesce(strftime(created, '%Y-%m'), 'unknown') as period
    from (select unnest(related_notes) as r, created from sessions)),
refs as (
    select 'entries' as source, 'file' as space, path as key, {_month(_instant('created'))} as period from paths where t = 'entries'
    union all select 'vectors', 'entry', {_ID.format(c='doc_id')}, {_month(_instant('created_at'))} from vectors
    union all select 'access_log', 'entry', {_ID.format(c='entry_id')}, {_month(_instant('accessed_at'))} from access_log
    union all select 'sessions', 'note', key, period from related),
parents as (
    select 'file' as space, path as key from paths where t = 'files' and removed_at is null
    union all select 'entry', {_ID.format(c='id')} from entries
    union all select 'note', id from notes_ids where length(id) >= 36
    union all select 'note', left(id, n) from notes_ids, (select distinct length(key) as n from related where length(key) between 1 and 35)
        where length(id) >= n),
missing as (
    select source, key, period, count(*) as n_references from refs
    where key is not null and not exists (select 1 from parents p where p.space = refs.space and p.key = refs.key)
    group by all)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"with {_CELLS} select entry_id, access_type from cells where n_window >= {LEAST_ACCESSES}",
        "p2_features": f"""with {_CELLS},
            types as (select distinct access_type from cells), grid as (
            select e.entry_id, t.access_type, c.n_window, c.n_total, c.last_at
            from (select distinct entry_id from cells) e cross join types t left join cells c using (entry_id, access_type))
            select entry_id, list(access_type order by access_type) as access_types,
              list(coalesce(n_window, 0) order by access_type) as n_window,
              list(coalesce(n_total, 0) order by access_type) as n_total,
              list(({AS_OF} - last_at) // 1000000 order by access_type) as seconds_since_last
            from grid group by entry_id""",
        "p5_found": f"with {_REFS} select source, key as missing_key, period from missing",
        "p5_report": f"""with {_REFS} select source, period, count(*) as n_missing_keys,
            sum(n_references)::bigint as n_references from missing group by all""",
    }
