"""Queries that list, count, merge, link and check notes, sessions, entries and files, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.keys import norm_id
from lorekeep.functions.text import (
    TITLE_STOP_WORDS,
    backend_pair,
    context_preview,
    embedding_input,
    for_embedding,
    human_bytes,
    language_of,
    observation,
    preview,
    recency_boosted,
    session_preview,
    slug_name,
    title_words,
)
from lorekeep.functions.times import instant_micros
from lorekeep.operators import capture, dedup, graph, integrity, stats, validate
from lorekeep.plans.core_problems import _ID, _PATH, _instant
from lorekeep.plans.search_queries import CORPUS
from lorekeep.sources.corpus import corpus, latest, notes, sessions
from lorekeep.sources.tables import table

AS_OF = datetime(2025, 7, 1)
AS_OF_MICROS = 1_751_328_000_000_000


def counts_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return stats.counts_by_type(corpus(spark, folder))


def categories(spark: SparkSession, folder: str) -> DataFrame:
    return stats.categories(notes(spark, folder))


def top_tags(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_tags(corpus(spark, folder))


def tags_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return stats.tag_counts(notes(spark, folder)).select("tag")


def recent_entries(spark: SparkSession, folder: str) -> DataFrame:
    return stats.recent(corpus(spark, folder)).select("id", "type", "title", "created")


def access_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.access_counts(table(spark, folder, "access_log"), table(spark, folder, "entries"))


def top_accessed(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_accessed(table(spark, folder, "access_log"), table(spark, folder, "entries"))


def vectors_by_backend(spark: SparkSession, folder: str) -> DataFrame:
    return stats.vectors_by_backend(table(spark, folder, "vectors"))


def storage_size(spark: SparkSession, folder: str) -> DataFrame:
    return stats.storage(table(spark, folder, "store_files")).select("n_files", "n_bytes", human_bytes(F.col("n_bytes")).alias("shown"))


def sessions_list(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a range of days on branches with 'fix' in their name, the newest first."""
    rows = sessions(spark, folder).where(F.col("date").between("2025-01-01", "2025-06-30") & F.col("branch").ilike("%fix%"))
    return rows.orderBy(F.desc("date"), F.desc_nulls_last("created"), "id").limit(10).select("id", "title", "date", "branch", "project")


def active_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest labelled report of each project that is less than four hours older than the project's last one."""
    rows = sessions(spark, folder).where("session_id <> '' and created is not null")
    last = rows.groupBy("project").agg(F.max("created").alias("last"))
    recent = rows.join(last, rows["project"].eqNullSafe(last["project"])).drop(last["project"])
    recent = recent.where(F.col("created") > F.col("last") - F.expr("interval 4 hours"))
    return dedup.first_by(recent, ["project"], F.desc("created"), F.col("id")).select("project", "session_id", "id")


def latest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "vectors").select(
        norm_id(F.col("doc_id")).alias("doc_id"), "backend", "model", "dim", instant_micros(F.col("created_at")).alias("at")
    )
    return rows.groupBy("doc_id", "backend", "model").agg(F.max("at").alias("at"), F.count("*").alias("n_rows")).where("doc_id is not null")


def id_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).where(F.startswith("id", F.lit("a"))).select("id", "type", "title")


def title_contains(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a category by title: an exact match first, then titles that contain the text."""
    rows = notes(spark, folder).where(F.col("category") == "how-to")
    text = "queue"
    rank = F.when(F.lower("title") == text, 1).when(F.contains(F.lower("title"), F.lit(text)), 2)
    return rows.withColumn("rank", rank).where("rank is not null").select("id", "title", "rank")


def entries_without_file(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.entries_without_file(table(spark, folder, "entries"), table(spark, folder, "store_files"))


def files_without_entry(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.files_without_entry(table(spark, folder, "entries"), table(spark, folder, "store_files"))


def orphan_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.orphan_vectors(table(spark, folder, "vectors"), table(spark, folder, "entries"))


def unindexed(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.unindexed(corpus(spark, folder), table(spark, folder, "entries"))


def repaired_entries(spark: SparkSession, folder: str) -> DataFrame:
    kept = integrity.without_orphans(table(spark, folder, "entries"), table(spark, folder, "store_files"))
    return kept.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct(norm_id(F.col("id"))).alias("n_ids"))


def health_report(spark: SparkSession, folder: str) -> DataFrame:
    names = ("entries", "store_files", "vectors")
    entries, files, vectors = (table(spark, folder, n) for n in names)
    return integrity.health(entries, files, corpus(spark, folder), vectors, "tfidf", "tfidf")


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.nodes(notes(spark, folder), sessions(spark, folder))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges(notes(spark, folder), sessions(spark, folder))


def graph_dot(spark: SparkSession, folder: str) -> DataFrame:
    n, s = notes(spark, folder), sessions(spark, folder)
    return graph.dot_lines(graph.nodes(n, s), graph.edges(n, s))


def context(spark: SparkSession, folder: str) -> DataFrame:
    """What a new session starts with: the five notes updated last and the five newest sessions."""
    n = stats.recent(notes(spark, folder), 5, "updated").select(
        F.lit("note").alias("type"), "id", "title", context_preview(F.col("content")).alias("preview")
    )
    s = sessions(spark, folder).orderBy(F.desc("date"), F.desc_nulls_last("created"), "id").limit(5).select(
        F.lit("session").alias("type"), "id", "title", context_preview(F.col("summary")).alias("preview")
    )
    return n.unionByName(s)


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return notes(spark, folder).select("id", slug_name(F.col("title")).alias("slug"))


def previews(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(spark, folder).select(
        "id", preview(F.col("what_happened")).alias("preview"), session_preview(F.col("summary"), F.col("decisions")).alias("line")
    )


def recency(spark: SparkSession, folder: str) -> DataFrame:
    boosted = recency_boosted(F.lit(1.0), F.col("created"), F.lit(AS_OF))
    return corpus(spark, folder).select("id", F.round(boosted, 6).alias("factor"))


def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    text = embedding_input(for_embedding(F.col("title"), F.col("content"), F.col("tags")))
    return notes(spark, folder).select("id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def limits(spark: SparkSession, folder: str) -> DataFrame:
    broken = validate.violations(F.col("title"), F.col("content"), F.col("tags"), F.col("category"))
    return notes(spark, folder).select("id", broken.alias("violations"))


def report_checks(spark: SparkSession, folder: str) -> DataFrame:
    return validate.validated(sessions(spark, folder))


def report_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of the session reports among the documents."""
    docs = table(spark, folder, "documents").where(F.contains("text", F.lit("## ")))
    return docs.select("doc_id", F.explode(validate.sections(F.col("text")))).select(
        "doc_id", F.col("key").alias("section"), F.length("value").alias("n_chars"), F.md5("value").alias("digest")
    )


def title_word_sets(spark: SparkSession, folder: str) -> DataFrame:
    return notes(spark, folder).select("id", F.sort_array(title_words(F.col("title"))).alias("words"))


def exact_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that several notes of a category or several sessions of a project carry."""
    return dedup.exact_titles(corpus(spark, folder).withColumn("category", F.coalesce("category", "project")))


def similar_titles(spark: SparkSession, folder: str) -> DataFrame:
    """For each class of equal titles how many other classes of its category have a similar title."""
    return dedup.similar_title_counts(notes(spark, folder)).withColumnRenamed("n", "n_rows")


def tag_unions(spark: SparkSession, folder: str) -> DataFrame:
    """The tags of each note united without regard to case and blanks."""
    empty = F.array().cast("array<string>")
    return notes(spark, folder).select("id", dedup.tag_union(F.col("tags"), empty).alias("tags"))


def sessions_merged(spark: SparkSession, folder: str) -> DataFrame:
    merged = dedup.merge_sessions(sessions(spark, folder))
    listed = lambda name, *fields: F.md5(F.array_join(F.transform(name, lambda x: F.concat_ws("=", *(F.coalesce(x[f], F.lit("")) for f in fields))), "|")).alias(name)
    return merged.select(
        "id", "title", "date", "branch", "project", "session_id", "created", "updated", "n_reports", "tags", F.md5("summary").alias("summary"), F.md5("what_happened").alias("what_happened"),
        "decisions", "insights", "questions", "next_steps", listed("changes", "path", "description"), listed("problems", "problem", "solution"), listed("related_notes", "id", "title", "category"),
        listed("extra_sections", "name", "content"),
    )


def note_fold(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.fold_notes(notes(spark, folder)).withColumnRenamed("into", "into_id")


def changed_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The changed files of each project with their descriptions in order of the sessions."""
    rows = sessions(spark, folder).where("project is not null").select(
        F.col("project").alias("key"), F.struct("created", "id").alias("s"), F.posexplode("changes").alias("at", "c")
    )
    rows = rows.select("key", F.struct("s.created", "s.id", "at").alias("seq"), "c.path", "c.description").where("path is not null")
    return dedup.merge_changes(rows).withColumnRenamed("key", "project")


def capture_observations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("kind = 'capture'")
    kept = docs.select("doc_id", observation(F.col("text")).alias("found")).where("found <> ''")
    return kept.select("doc_id", F.size(F.split("found", "\n")).alias("n_lines"), F.md5("found").alias("digest"))


def capture_window(spark: SparkSession, folder: str) -> DataFrame:
    """Events without another of the same user and type in the five minutes before."""
    rows = table(spark, folder, "events").select("event_id", F.col("ts").alias("at"), "user_id", "event_type")
    return capture.first_in_window(rows, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


def captured_once(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of captured documents without one that begins alike in the five minutes before."""
    docs = table(spark, folder, "documents").where("kind = 'capture' and created is not null")
    rows = docs.select(F.col("created").alias("at"), "doc_id", observation(F.col("text")).alias("content")).where("content <> ''")
    rows = rows.select("at", "doc_id", F.substring("content", 1, 12).alias("head"))
    return capture.first_in_window(rows, ["head"]).select("doc_id", "head")


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Changed files by programming language."""
    rows = sessions(spark, folder).select(F.explode("changes").alias("c")).where("c.path is not null")
    return rows.groupBy(language_of(F.col("c.path")).alias("language")).agg(F.count("*").alias("n"))


def backend_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "vectors").select(backend_pair(F.concat_ws(":", "backend", "model")).alias("p"))
    return rows.groupBy("p.backend", "p.model").agg(F.count("*").alias("n"))


QUERIES = (
    counts_by_type, categories, top_tags, tags_distinct, recent_entries, access_counts, top_accessed, vectors_by_backend, storage_size,
    sessions_list, active_sessions, latest_vectors, id_prefix, title_contains, entries_without_file, files_without_entry, orphan_vectors,
    unindexed, repaired_entries, health_report, graph_nodes, graph_edges, graph_dot, context, slugs, previews, recency, embedding_texts,
    limits, report_checks, report_sections, title_word_sets, exact_titles, similar_titles, tag_unions, sessions_merged, note_fold,
    changed_paths, capture_observations, captured_once, capture_window, languages, backend_pairs,
)


def queries():
    return {q.__name__: q for q in QUERIES}


_FILES = f"""live as (select distinct nullif(regexp_replace(p, '^/srv/memstore(/|$)', ''), '') as path
    from (select {_PATH} as p from store_files where removed_at is null) where p is not null and p <> '/srv/memstore'),
ent as (select distinct {_ID.format(c='id')} as id, nullif(regexp_replace(p, '^/srv/memstore(/|$)', ''), '') as path
    from (select id, {_PATH} as p from entries)),
eid as (select distinct {_ID.format(c='id')} as id from entries)"""
_CUT = "case when length({c}) > {most} then substr({c}, 1, {keep}) || '...' else {c} end"
_WORDS = "list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '\\s+'), lambda w: strlen(w) >= 3 and w not in ({})))".format(
    ", ".join(f"'{w}'" for w in TITLE_STOP_WORDS)
)
_EDGES = f"""labels as (select session_id, id from s where session_id <> '' qualify row_number() over
    (partition by session_id order by created desc nulls last, id desc) = 1),
e as (select substr(n.id, 1, 8) as source, substr(l.id, 1, 8) as target, 'from_session' as type from n join labels l on l.session_id = n.metadata['session_id']
    union all select distinct source, target, 'related' from (select substr(id, 1, 8) as source, substr(lower(trim(r.id)), 1, 8) as target
      from (select id, unnest(related_notes) as r from s)) where target in (select substr(id, 1, 8) from n))"""
_NODES = """v as (select substr(id, 1, 8) as node, 'note' as type, title, category, null as date from n
    union all select substr(id, 1, 8), 'session', title, null, date from s)"""
_USED = f"""used as (select {_ID.format(c='entry_id')} as entry_id, count(*) as n_accesses, max({_instant('accessed_at')}) as last_access
    from access_log where {_ID.format(c='entry_id')} is not null group by 1),
names as (select {_ID.format(c='id')} as entry_id, max(struct_pack(title := title, type := type)) as e from entries group by 1),
acc as (select entry_id, coalesce(e.title, '(deleted)') as title, coalesce(e.type, 'unknown') as type, n_accesses, last_access
    from used left join names using (entry_id))"""
_EMBED = """(select *, concat_ws(' ', title, content, array_to_string(tags, ' ')) as t from n)"""


def _once(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


_SEPARATOR = "chr(10) || chr(10) || '--- Updated ' || u || ' ---' || chr(10)"
_TEXT = f"""string_agg(case when {{n}} = 1 then {{c}} else {_SEPARATOR} || {{c}} end, '' order by seq) filter (where coalesce({{c}}, '') <> '')"""
# Reports with their session (key) and their place in time (seq), merged texts and lists (m), and each list of structs.
_MERGED = f"""k0 as (select *, coalesce(trim(session_id), '') = '' as blank, concat_ws(chr(31), 'day', coalesce(date, ''), coalesce(project, ''), coalesce(branch, '')) as day,
    coalesce(strftime(created, '%Y-%m-%d %H:%M'), date, 'unknown') as u, row_number() over (order by created nulls first, id) as seq from s),
  k1 as (select *, coalesce(min(case when blank then seq end) over (partition by day) < seq, false) as joins from k0),
  k2 as (select *, min(case when not joins and not blank then seq end) over (partition by session_id) as own from k1),
  k as (select *, case when not blank and coalesce(seq >= own, false) then 'id' || chr(31) || session_id else day end as key from k2),
  kt as (select *, sum(case when coalesce(summary, '') <> '' then 1 else 0 end) over (partition by key order by seq) as ns,
    sum(case when coalesce(what_happened, '') <> '' then 1 else 0 end) over (partition by key order by seq) as nw from k),
  m0 as (select key, arg_min(id, seq) as id, arg_min(seq, seq) as first, count(*) as n_reports, max(created) as updated,
    arg_max(title, seq) filter (where coalesce(trim(title), '') <> '') as title, {_TEXT.format(n='ns', c='summary')} as su, {_TEXT.format(n='nw', c='what_happened')} as wh,
    list_filter(list_transform(flatten(list(coalesce(tags, []) order by seq desc)), lambda t: trim(t)), lambda t: t is not null and t <> '') as tg,
    {', '.join(f"flatten(list(coalesce({x}, []) order by seq)) as {x}" for x in ('decisions', 'insights', 'questions', 'next_steps'))} from kt group by key),
  m as (select m0.*, k.date, k.branch, k.project, k.session_id, k.created,
    list_filter(tg, lambda t, i: list_position(list_transform(tg, lambda y: lower(y)), lower(t)) = i) as tags from m0 join k on k.key = m0.key and k.seq = m0.first),
  xc as (select key, u, c, row_number() over (order by seq, i) as o from (select key, u, seq, unnest(changes) as c, generate_subscripts(changes, 1) as i from k) where c is not null),
  c1 as (select key, c.path as path, c.description as d, min(o) as o from xc group by all),
  c2 as (select key, path, coalesce(string_agg(d, '; ' order by o), '') as d, min(o) as o from c1 group by key, path),
  m_ch as (select key, string_agg(coalesce(path, '') || '=' || d, '|' order by o) as ch from c2 group by key),
  xp as (select key, c, row_number() over (order by seq, i) as o from (select key, seq, unnest(problems) as c, generate_subscripts(problems, 1) as i from k) where c is not null),
  p1 as (select key, c.problem as problem, arg_min(coalesce(c.solution, ''), o) as solution, min(o) as o from xp group by key, c.problem),
  m_pr as (select key, string_agg(coalesce(problem, '') || '=' || solution, '|' order by o) as pr from p1 group by key),
  xr as (select key, c, row_number() over (order by seq, i) as o from (select key, seq, unnest(related_notes) as c, generate_subscripts(related_notes, 1) as i from k) where c is not null),
  r1 as (select key, c, o, min(o) over (partition by key, substr(c.id, 1, 8)) as place from xr qualify row_number() over (partition by key, substr(c.id, 1, 8) order by length(c.id) desc nulls last, o) = 1),
  m_rn as (select key, string_agg(coalesce(c.id, '') || '=' || coalesce(c.title, '') || '=' || coalesce(c.category, ''), '|' order by place) as rn from r1 group by key),
  xe as (select key, u, c, row_number() over (order by seq, i) as o from (select key, u, seq, unnest(extra_sections) as c, generate_subscripts(extra_sections, 1) as i from k) where c is not null),
  e1 as (select key, lower(c.name) as low, c.content as content, min(o) as o, arg_min(c.name, o) as name, arg_min(u, o) as u from xe group by key, lower(c.name), c.content),
  e2 as (select *, row_number() over (partition by key, low order by o) as nth from e1),
  e3 as (select key, low, arg_min(name, o) as name, string_agg(case when nth = 1 then content else {_SEPARATOR} || content end, '' order by o) as content, min(o) as o from e2 group by key, low),
  m_es as (select key, string_agg(coalesce(name, '') || '=' || coalesce(content, ''), '|' order by o) as es from e3 group by key)"""


def oracle_sql() -> dict[str, str]:
    c = f"with {CORPUS}"
    stop = "'(?i)error|fail|warning|passed|permission denied'"
    unit = "case when n_bytes >= 1099511627776 then printf('%.1f TB', n_bytes / 1099511627776.0) when n_bytes >= 1073741824 then printf('%.1f GB', n_bytes / 1073741824.0) when n_bytes >= 1048576 then printf('%.1f MB', n_bytes / 1048576.0) when n_bytes >= 1024 then printf('%.1f KB', n_bytes / 1024.0) else printf('%d B', n_bytes) end"
    boost = "(epoch(timestamp '2025-07-01') - floor(epoch(created))) / 86400"
    return {
        "counts_by_type": f"{c} select type, count(*) as n from c group by type",
        "categories": f"{c} select category, count(*) as n from n group by category",
        "top_tags": f"{c} select tag, count(*) as n from (select unnest(tags) as tag from c) where tag is not null group by tag order by n desc, tag limit 10",
        "tags_distinct": f"{c} select distinct tag from (select unnest(tags) as tag from n) where tag is not null",
        "recent_entries": f"{c} select id, type, title, created from c order by created desc nulls last, id limit 5",
        "access_counts": f"with {_USED} select * from acc",
        "top_accessed": f"with {_USED} select * from acc order by n_accesses desc, entry_id limit 10",
        "vectors_by_backend": "select backend, model, count(*) as n, count(distinct doc_id) as n_docs from vectors group by all",
        "storage_size": f"""with f as (select filepath, arg_max(struct_pack(b := n_bytes, r := removed_at), coalesce(removed_at, timestamp '9999-12-31')) as f from store_files group by filepath),
            t as (select count(*) as n_files, sum(f.b)::bigint as n_bytes from f where f.r is null) select n_files, n_bytes, {unit} as shown from t""",
        "sessions_list": f"""{c} select id, title, date, branch, project from s where date between '2025-01-01' and '2025-06-30' and branch ilike '%fix%'
            order by date desc, created desc nulls last, id limit 10""",
        "active_sessions": f"""{c}, r as (select * from s where session_id <> '' and created is not null),
            l as (select *, max(created) over (partition by project) as last from r)
            select project, session_id, id from l where created > last - interval 4 hours
            qualify row_number() over (partition by project order by created desc, id) = 1""",
        "latest_vectors": f"""select {_ID.format(c='doc_id')} as doc_id, backend, model, max({_instant('created_at')}) as at, count(*) as n_rows
            from vectors where {_ID.format(c='doc_id')} is not null group by all""",
        "id_prefix": f"{c} select id, type, title from c where starts_with(id, 'a')",
        "title_contains": f"""{c} select id, title, (case when lower(title) = 'queue' then 1 else 2 end)::int as rank from n
            where category = 'how-to' and contains(lower(title), 'queue')""",
        "entries_without_file": f"with {_FILES} select id, path from ent where id is not null and not exists (select 1 from live where live.path = ent.path)",
        "files_without_entry": f"with {_FILES} select path from live where path not in (select path from ent where path is not null)",
        "orphan_vectors": f"""with {_FILES} select distinct {_ID.format(c='doc_id')} as doc_id, backend, model from vectors
            where not exists (select 1 from eid where eid.id = {_ID.format(c='doc_id')})""",
        "unindexed": f"{c}, {_FILES} select distinct lower(trim(id)) as id, type from c where lower(trim(id)) not in (select id from eid where id is not null)",
        "repaired_entries": f"""with {_FILES}, k as (select *, nullif(regexp_replace({_PATH}, '^/srv/memstore(/|$)', ''), '') as path from entries)
            select type, count(*) as n, count(distinct {_ID.format(c='id')}) as n_ids from k where path in (select path from live) group by type""",
        "health_report": f"""{c}, {_FILES}, act as (select distinct {_ID.format(c='doc_id')} as id from vectors where backend = 'tfidf' and model = 'tfidf'),
            h as (select (select count(*) from live) as n_files, (select count(*) from eid where id is not null) as n_entries,
              (select count(distinct id) from c) as n_documents, (select count(*) from act) as n_active_vectors,
              (select count(*) from ent where id is not null and not exists (select 1 from live where live.path = ent.path)) as n_entries_without_file,
              (select count(*) from live where path not in (select path from ent where path is not null)) as n_files_without_entry,
              (select count(*) from (select distinct lower(trim(id)) as id, type from c) where id not in (select id from eid where id is not null)) as n_unindexed,
              (select count(*) from act where not exists (select 1 from eid where eid.id = act.id)) as n_orphan_vectors)
            select *, false as other_backend, n_entries_without_file + n_files_without_entry + n_unindexed + n_orphan_vectors = 0 and n_files = n_entries as healthy from h""",
        "graph_nodes": f"{c}, {_NODES} select * from v",
        "graph_edges": f"{c}, {_EDGES} select * from e",
        "graph_dot": rf"""{c}, {_NODES}, {_EDGES}
            select '  "' || node || '" [label="' || replace(replace(coalesce(title, ''), '\', '\\'), '"', '\"') || '", fillcolor='
              || case when type = 'note' then 'lightblue' else 'lightgreen' end || ', style=filled];' as line from v
            union all select '  "' || source || '" -> "' || target || '" [label="' || type || '"];' from e""",
        "context": f"""{c}, a as (select 'note' as type, id, title, content as t from n order by updated desc nulls last, id limit 5),
            b as (select 'session' as type, id, title, summary as t from s order by date desc nulls last, created desc nulls last, id limit 5)
            select type, id, title, replace({_CUT.format(c='t', most=120, keep=117)}, chr(10), ' ') as preview from (select * from a union all select * from b)""",
        "slugs": f"""{c} select id, coalesce(nullif(substr(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 100), ''), 'untitled') || '.md' as slug from n""",
        "previews": f"""{c}, t as (select id, trim(substr(what_happened, 1, 200)) as p, coalesce(nullif(summary, ''), 'Decisions: ' || decisions[1]) as l from s)
            select id, {_CUT.format(c='p', most=100, keep=100)} as preview, {_CUT.format(c='l', most=100, keep=97)} as line from t""",
        "recency": f"""{c} select id, round(1 + coalesce(case when {boost} < 7 then 0.2 when {boost} < 30 then 0.2 * (1 - ({boost} - 7) / 23) else 0 end, 0), 6)::double as factor from c""",
        "embedding_texts": rf"""{c}, t as (select id, t, substr(t, 1, 7500) as h, regexp_extract(substr(t, 7301, 200), '(?s)^(.*) [^ ]*$', 1) as b from {_EMBED}),
            u as (select id, case when length(t) <= 7500 then t when contains(substr(t, 7301, 200), ' ') then substr(t, 1, 7300) || b else h end as x from t)
            select id, length(x)::int as n_chars, md5(x) as digest from u""",
        "limits": rf"""{c} select id, list_filter([
              case when trim(coalesce(title, '')) = '' then 'title empty' end, case when strlen(title) > 500 then 'title too long' end,
              case when strlen(content) > 10485760 then 'content too long' end, case when len(tags) > 50 then 'too many tags' end,
              case when len(list_filter(tags, lambda t: strlen(t) > 100)) > 0 then 'tag too long' end,
              case when not coalesce(category <> '' and not contains(category, '..') and not regexp_matches(category, '[/\\\x00-\x1f\x7f]|^\.') and strlen(category) <= 200, false)
                then 'category not a path part' end], lambda x: x is not null) as violations from n""",
        "report_checks": rf"""{c}, k as (select id, len(list_filter(string_split_regex(coalesce(summary, ''), '\s+'), lambda w: w <> '')) as w,
              len(list_filter(string_split(coalesce(what_happened, ''), chr(10)), lambda x: regexp_matches(trim(x), '^[1-9]\.'))) as p,
              coalesce(len(list_filter(problems, lambda q: trim(coalesce(q.solution, '')) = '')), 0) as u, coalesce(len(insights), 0) as i, coalesce(len(next_steps), 0) as x from s)
            select id, 'Summary' as section, w >= 100 as passed, w::int as found from k union all select id, 'What Happened', p >= 3, p from k
            union all select id, 'Problems & Solutions', u = 0, u from k union all select id, 'Learning Insights', i > 0, i from k
            union all select id, 'Next Steps', x > 0, x from k""",
        "report_sections": rf"""with p as (select doc_id, unnest(list_slice(string_split_regex(text, '(?m)^## '), 2, 1000000)) as part,
              generate_subscripts(list_slice(string_split_regex(text, '(?m)^## '), 2, 1000000), 1) as i from documents where contains(text, '## ')),
            q as (select doc_id, i, regexp_extract(part, '^([^\n]*)', 1) as section, trim(regexp_replace(part, '^[^\n]*\n?', '')) as v from p)
            select doc_id, section, length(v)::int as n_chars, md5(v) as digest from q qualify row_number() over (partition by doc_id, section order by i desc) = 1""",
        "title_word_sets": f"{c} select id, list_sort({_WORDS}) as words from n",
        "exact_titles": f"{c} select coalesce(category, project) as category, title, count(*) as n, min(id) as first_id from c group by all having count(*) > 1",
        "similar_titles": f"""{c}, k as (select category, list_sort({_WORDS}) as words, id from n),
            k2 as (select category, words, min(id) as class_id, count(*) as n_rows from k where len(words) >= 2 group by all),
            l as (select a.category, a.class_id, count(*) as n_links from k2 a join k2 b on a.category = b.category and a.class_id <> b.class_id
              and len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) >= 0.5 group by all)
            select category, class_id, n_rows, coalesce(n_links, 0) as n_links from k2 left join l using (category, class_id)""",
        "tag_unions": f"""{c}, t as (select id, list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t is not null and t <> '') as x from n)
            select id, list_filter(x, lambda t, i: list_position(list_transform(x, lambda y: lower(y)), lower(t)) = i) as tags from t""",
        "sessions_merged": f"""{c}, {_MERGED}
            select id, title, date, branch, project, session_id, created, updated, n_reports, tags, md5(coalesce(su, '')) as summary, md5(coalesce(wh, '')) as what_happened,
              {_once('decisions')} as decisions, {_once('insights')} as insights, {_once('questions')} as questions, {_once('next_steps')} as next_steps,
              md5(coalesce(ch, '')) as changes, md5(coalesce(pr, '')) as problems, md5(coalesce(rn, '')) as related_notes, md5(coalesce(es, '')) as extra_sections
            from m left join m_ch using (key) left join m_pr using (key) left join m_rn using (key) left join m_es using (key)""",
        "note_fold": f"""with recursive {CORPUS}, r as (select id, category, coalesce(title, '') as title, {_WORDS} as words,
              row_number() over (partition by category order by created nulls first, id) as k from n),
            f as (select distinct category, 0::bigint as k, []::struct(id varchar, title varchar, words varchar[])[] as kept, null::varchar as id, null::varchar as into_id from n
              union all select category, k, case when t is null then list_append(kept, struct_pack(id := id, title := title, words := words)) else kept end, id, coalesce(t, id)
              from (select *, case when len(same) > 0 then same[1].id when mx >= 0.5 then kept[list_position(ov, mx)].id end as t
                from (select *, list_max(ov) as mx from (select r.category, r.k, f.kept, r.id, r.title, r.words, list_filter(f.kept, lambda x: x.title = r.title) as same,
                  list_transform(f.kept, lambda x: case when len(x.words) >= 2 and len(r.words) >= 2 then len(list_intersect(x.words, r.words)) / least(len(x.words), len(r.words)) else 0 end) as ov
                  from f join r on r.category is not distinct from f.category and r.k = f.k + 1))))
            select id, into_id, case when id = into_id then 'created' else 'merged' end as how from f where id is not null""",
        "changed_paths": f"""{c}, x as (select project, created, id, unnest(changes) as ch, generate_subscripts(changes, 1) as i from s where project is not null),
            y as (select project, ch.path as path, ch.description as d, row_number() over (order by created nulls first, id, i) as o from x where ch.path is not null),
            f as (select project, path, d, min(o) as o from y group by all)
            select project, path, coalesce(string_agg(d, '; ' order by o), '') as description from f group by project, path""",
        "capture_observations": f"""with f as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, {stop})) as l
              from documents where kind = 'capture' and strlen(text) between 20 and 2000)
            select doc_id, len(l)::int as n_lines, md5(array_to_string(l, chr(10))) as digest from f where array_to_string(l, chr(10)) <> ''""",
        "captured_once": f"""with f as (select doc_id, created, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, {stop})) as l
              from documents where kind = 'capture' and created is not null and strlen(text) between 20 and 2000),
            h as (select doc_id, created, substr(array_to_string(l, chr(10)), 1, 12) as head from f where array_to_string(l, chr(10)) <> ''),
            w as (select *, lag(created) over (partition by head order by created, doc_id) as p from h)
            select doc_id, head from w where p is null or epoch_us(created) - epoch_us(p) >= 300000000""",
        "capture_window": """with l as (select *, lag(ts) over (partition by user_id, event_type order by ts, event_id) as p from events)
            select event_id, user_id, event_type from l where p is null or epoch_us(ts) - epoch_us(p) >= 300000000""",
        "languages": f"""{c}, p as (select lower(regexp_extract(ch.path, '\\.([A-Za-z0-9]+)$', 1)) as e from (select unnest(changes) as ch from s) where ch.path is not null)
            select case when e = 'go' then 'go' when e = 'py' then 'python' when e in ('ts', 'tsx', 'js', 'jsx', 'mjs') then 'typescript' when e = 'rs' then 'rust' else '' end as language,
              count(*) as n from p group by 1""",
        "backend_pairs": "select backend, model, count(*) as n from vectors group by all",
    }
