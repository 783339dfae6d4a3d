"""Queries that write and read files, parse reports, cut, mask, update and encode, with their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.dates import date_range
from lorekeep.functions.text import is_secret, masked, slug_name, split_fields, title_words, word_overlap
from lorekeep.operators import capture, dedup, embed, keyword, outline, stats, weights
from lorekeep.operators.hybrid import fuse
from lorekeep.operators.index import WeightIndex
from lorekeep.plans.indexes import search_index, weight_index
from lorekeep.plans.search_queries import CORPUS, QUERY_TEXT, _SEMANTIC, _scored, _terms_sql, _tokens
from lorekeep.session import own_scratch
from lorekeep.sources import markdown, sinks
from lorekeep.sources.corpus import corpus, notes, sessions
from lorekeep.sources.tables import table

EPOCH = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))


def notes_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every note as a Markdown file and read again; times to the second, contents without blanks at their ends."""
    files = notes(spark, folder).select(sinks.note_path().alias("path"), sinks.note_markdown().alias("text"))
    rows = markdown.parse_notes(files)
    return rows.select(
        "id", "category", "title", F.md5("content").alias("digest"), "tags", EPOCH("created").alias("created"), EPOCH("updated").alias("updated"),
        F.size("metadata").alias("n_metadata"), F.col("metadata")["session_id"].alias("session_id"),
    )


def _pairs(column: str, *fields: str):
    """Structs of a list as 'a=b' texts."""
    return F.transform(column, lambda x: F.concat_ws("=", *(F.coalesce(x[f], F.lit("")) for f in fields))).alias(column)


def sessions_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every session as a Markdown report and read again, section by section."""
    files = sessions(spark, folder).select(F.lit("r.md").alias("path"), sinks.session_markdown().alias("text"))
    rows = markdown.parse_sessions(files)
    return rows.select(
        "id", "title", "date", "branch", "project", "session_id", "tags", F.md5("summary").alias("summary"), F.md5("what_happened").alias("what_happened"),
        "decisions", "insights", "questions", "next_steps", _pairs("changes", "path", "description"), _pairs("problems", "problem", "solution"),
        _pairs("related_notes", "id", "title", "category"), _pairs("extra_sections", "name", "content"),
    )


def document_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are Markdown files with front matter, as any files imported: title, category and tags."""
    docs = table(spark, folder, "documents").where("kind = 'note' and text is not null")
    files = docs.select(F.concat(F.lit("/store/"), F.coalesce("source", F.lit("none")), F.lit("/doc-"), "doc_id", F.lit(".md")).alias("path"), "text")
    known = spark.createDataFrame([], "id string")
    rows = markdown.import_plain(files, known, "/store")
    return rows.select("id", "category", "title", F.length("content").alias("n_chars"), "tags")


def archive_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of an archive by their file names; session ids that are there are left out."""
    rows = sessions(spark, folder).where("date is not null and branch <> ''")
    name = F.concat(F.lit("/a/"), F.concat_ws("_", "date", F.regexp_replace("branch", "[/_]", "-"), F.substring("id", 1, 8), F.substring_index(slug_name(F.col("title")), ".md", 1)), F.lit(".md"))
    files = rows.select(name.alias("path"), sinks.session_markdown().alias("text"))
    known = rows.where(F.col("project") == "harbor-ledger").select(F.substring("id", 1, 8).alias("session_id"))
    found = markdown.import_archive(files, known)
    return found.select("session_id", "date", "branch", F.md5("summary").alias("summary"), "decisions", "next_steps", _pairs("problems", "problem", "solution"), F.size("changes").alias("n_changes"), F.size("questions").alias("n_questions"))


def list_item_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Items of '- ' and '* ' lines of documents, with and without lines that go on."""
    docs = table(spark, folder, "documents").where("text is not null")
    glued, plain = markdown.list_items(F.col("text")), markdown.list_items(F.col("text"), glue=False)
    return docs.select("doc_id", F.size(glued).alias("n_glued"), F.size(plain).alias("n_plain"), F.md5(F.array_join(plain, "|")).alias("digest")).where("n_plain > 0")


def files_by_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files that are there, by top folder."""
    return sinks.count_files(table(spark, folder, "store_files").where("removed_at is null").select("filepath").distinct())


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Notes as JSON lines and read again."""
    rows = notes(spark, folder).select("id", "title", "tags", "metadata", "created")
    back = F.from_json(F.to_json(F.struct(*rows.columns)), rows.schema)
    read = rows.select(back.alias("j")).select("j.*")
    return read.select("id", "title", "tags", F.col("metadata")["origin"].alias("origin"), EPOCH("created").alias("created"))


def store_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Notes in a store: written, a third of them changed, a third deleted, and read."""
    store = sinks.Store(spark, f"{own_scratch(spark)}/store-{uuid.uuid4().hex}")
    rows = notes(spark, folder).select("id", "category", "title", F.length("content").alias("n_chars"))
    third = F.pmod(F.conv(F.substring("id", 1, 6), 16, 10).cast("long"), F.lit(3))
    store.upsert("notes", rows, ["id"])
    store.upsert("notes", rows.where(third == 0).withColumn("title", dedup.updated(F.col("title"), F.lit("changed"))), ["id"])
    store.delete("notes", rows.where(third == 1).select("id"), ["id"])
    return store.read("notes")


def note_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Each note with text appended, fields replaced, and merged with its own title and marks."""
    when = dedup.updated_at(F.col("updated"), F.lit(None).cast("string"))
    new = F.create_map(F.lit("origin"), F.lit("merge"), F.lit("session_id"), F.lit(""))
    merged = dedup.metadata_union(F.col("metadata"), new)
    return notes(spark, folder).select(
        "id", F.md5(dedup.appended(F.coalesce("content", F.lit("")), F.lit("more"))).alias("appended"), dedup.updated(F.col("category"), F.lit("")).alias("category"),
        dedup.updated(F.col("title"), F.col("category")).alias("title"), F.md5(dedup.content_union(F.col("content"), F.col("title"), when)).alias("content"),
        F.md5(dedup.text_union(F.col("title"), F.col("content"), when)).alias("text"), dedup.list_union(F.col("tags"), F.array(F.lit("api"), F.lit("new"))).alias("tags"),
        merged["origin"].alias("origin"), merged["session_id"].alias("session_id"),
    )


def title_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of title classes of a category by how much of their words they share."""
    return dedup.similar_titles(notes(spark, folder)).withColumn("overlap", F.round("overlap", 4))


def title_overlap_with_category(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the smaller of title and category a note's other shares."""
    overlap = word_overlap(title_words(F.col("title")), title_words(F.replace("category", F.lit("-"), F.lit(" "))))
    return notes(spark, folder).select("id", F.round(overlap, 4).alias("overlap"))


def sessions_of_month(spark: SparkSession, folder: str) -> DataFrame:
    first, last = date_range("month", date(2025, 6, 30))
    return keyword.Facets(after=first, before=last).where(sessions(spark, folder)).select("id", "date", "project")


def masked_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata as it would be shown: values of secret keys masked; session ids stand for keys that look secret."""
    rows = notes(spark, folder).select("id", F.explode("metadata").alias("key", "value"))
    rows = rows.withColumn("key", F.when(F.col("key") == "session_id", "api_token").otherwise(F.col("key")))
    return rows.select("id", "key", F.when(is_secret(F.col("key")), masked(F.col("value"))).otherwise(F.col("value")).alias("shown"))


def split_flags(spark: SparkSession, folder: str) -> DataFrame:
    """'path:description' and 'id:title:category' texts in their parts."""
    rows = sessions(spark, folder).select("id", F.explode("changes").alias("c")).where("c.path is not null")
    two = split_fields(F.concat_ws(":", "c.path", "c.description"), "path", "description")
    three = split_fields(F.concat_ws(":", "id", "c.path", "c.description"), "id", "title", "category")
    return rows.select("id", two["path"].alias("path"), two["description"].alias("description"), three["category"].alias("category")).distinct()


def notes_of_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, note, title, category): the notes that name a session by its label."""
    labels = sessions(spark, folder).where("session_id <> ''").select("session_id").distinct()
    rows = notes(spark, folder).withColumn("session_id", F.col("metadata")["session_id"])
    return rows.join(labels, "session_id", "left_semi").select("session_id", F.substring("id", 1, 8).alias("note"), "title", "category")


def categories_by_size(spark: SparkSession, folder: str) -> DataFrame:
    return stats.categories(notes(spark, folder)).orderBy(F.desc("n"), "category").limit(5)


def notes_by_category(spark: SparkSession, folder: str) -> DataFrame:
    grouped = notes(spark, folder).groupBy("category").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("title")).alias("t"))
    return grouped.select("category", "n", F.md5(F.array_join("t", "|")).alias("titles"))


def notes_list(spark: SparkSession, folder: str) -> DataFrame:
    """The first notes by category and title."""
    return notes(spark, folder).orderBy("category", "title", "id").limit(25).select("id", "category", "title")


def stats_overview(spark: SparkSession, folder: str) -> DataFrame:
    """What a store says of itself: (what, name, n)."""
    docs, n = corpus(spark, folder), notes(spark, folder)
    part = lambda what, df, name: df.select(F.lit(what).alias("what"), F.col(name).alias("name"), F.col("n").cast("long").alias("n"))
    size = stats.storage(table(spark, folder, "store_files")).select(F.lit("bytes").alias("name"), F.col("n_bytes").alias("n"))
    return part("type", stats.counts_by_type(docs), "type").unionByName(part("category", stats.categories(n), "category")).unionByName(part("tag", stats.top_tags(docs), "tag")).unionByName(part("storage", size, "name"))


def _code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of session reports as source files: each changed path with its description as the body of a symbol."""
    rows = sessions(spark, folder).select("id", F.posexplode("changes").alias("at", "c")).where("c.path is not null and c.description is not null")
    words = F.split("c.description", " ")
    name = F.concat(F.lit("f_"), F.regexp_replace(F.element_at(words, -1), r"\W", ""))
    head = F.regexp_replace(F.element_at(words, 1), r"\W", "")
    body = F.concat_ws(
        "\n", F.concat(F.lit("func "), name, F.lit("(x int) {")), F.concat(F.lit("def "), name, F.lit("(x):")), F.concat(F.lit("    def "), head, F.lit("(self):")),
        F.concat(F.lit("export function "), name, F.lit("(x) {")), F.concat(F.lit("pub fn "), name, F.lit("() {")), F.concat(F.lit("type "), head, F.lit(" struct {")), F.col("c.description"),
    )
    return rows.select(F.concat_ws("/", "id", "at", "c.path").alias("path"), body.alias("content"))


def outline_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return outline.outline(_code_files(spark, folder)).select("path", "language", "line", "kind", "name")


def outline_counts(spark: SparkSession, folder: str) -> DataFrame:
    return outline.symbol_counts(_code_files(spark, folder))


def hook_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON lines of a tool hook, of which those of one tool are kept."""
    docs = table(spark, folder, "documents").where("kind = 'capture'")
    tool = F.when(F.pmod("doc_id", F.lit(3)) == 0, "Read").otherwise("Bash")
    lines = docs.select(F.to_json(F.struct(tool.alias("tool_name"), F.col("text").alias("output"))).alias("value")).unionByName(docs.select(F.lit("no json").alias("value")))
    found = capture.observations(capture.hook_rows(lines))
    return found.select("title", F.md5("content").alias("digest")).groupBy("title", "digest").agg(F.count("*").alias("n"))


def note_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """For each of three names, the notes of a category by file name, title, or a part of the title; the best way counts."""
    rows = notes(spark, folder).where("category = 'api-notes'")
    asked = [("ideas-about-explicit-cache-entry-in-the-ingest-worker",), ("cache",), ("Checklist for",)]
    names = F.broadcast(spark.createDataFrame(asked, "asked string"))
    way = F.when(slug_name(F.col("title")) == slug_name(F.col("asked")), 1).when(F.col("title") == F.col("asked"), 2)
    found = rows.join(names, F.contains(F.lower("title"), F.lower("asked")) | (slug_name(F.col("title")) == slug_name(F.col("asked"))))
    found = found.withColumn("way", way.otherwise(3))
    best = found.groupBy("asked").agg(F.min("way").alias("way"))
    return found.join(F.broadcast(best), ["asked", "way"]).select("asked", "way", "id", "title")


def vectors_truncated(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings cut to their first 8 values, with their product with themselves."""
    short = weights.truncated(F.col("embedding"), 8)
    return table(spark, folder, "embeddings").select("vec_id", F.size(short).alias("dim"), F.round(weights.dot(short, short), 5).alias("product"))


def vectors_migrated(spark: SparkSession, folder: str) -> DataFrame:
    """An old table of vectors with backend, model and length."""
    old = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    return embed.migrated(old, "tfidf", "tfidf").select("doc_id", "backend", "model", "dim")


def knn_backend(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of one backend and model nearest to a given one."""
    rows = table(spark, folder, "vectors").where("backend = 'tfidf' and model = 'tfidf'").where("size(vector) = dim and not exists(vector, x -> isnan(x))")
    first = rows.orderBy("doc_id", "created_at", F.xxhash64("vector")).first()
    query = [float(i % 7 + 1) for i in range(first["dim"])] if first else []
    hits = weights.nearest_to(rows.select("doc_id", "vector"), query, 20)
    return hits.groupBy("doc_id").agg(F.round(F.max("similarity"), 3).alias("similarity"))


def index_terms(spark: SparkSession, folder: str) -> DataFrame:
    """What the stored index holds of each term: rows and occurrences by field."""
    return search_index(spark, folder).postings.groupBy("term", "field").agg(F.count("*").alias("n_rows"), F.sum("tf").alias("n"), F.sum(F.size("positions")).alias("n_places"))


def index_weights(spark: SparkSession, folder: str) -> DataFrame:
    """What the stored term weights hold of each term."""
    return weight_index(spark, folder).weights.groupBy("term").agg(F.count("*").alias("n_rows"), F.round(F.max("w"), 4).alias("largest"))


def weights_added(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of sessions by the vocabulary of the notes: rows added to an index without building it anew."""
    n = notes(spark, folder)
    counts = weights.term_counts(n, "id", F.concat_ws(" ", "title", "content"))
    total = n.count()
    known = WeightIndex.vocabulary_of(counts, total)
    added = weights.weighted(weights.term_counts(sessions(spark, folder), "id", F.col("what_happened")), known, total)
    return added.groupBy("id").agg(F.count("*").alias("n_terms"), F.round(F.max("w"), 4).alias("largest"))


def hybrid_faceted(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search in which both sides pass the facets."""
    index = search_index(spark, folder)
    facets = keyword.Facets(type="note", category="how-to")
    bare = type(index)(index.postings, index.rows)
    keyed = keyword.search(bare, "deadline OR queue", facets).select("id", "score")
    near = weight_index(spark, folder).similar(QUERY_TEXT).join(facets.where(index.rows).select("id"), "id")
    meaning = near.orderBy(F.desc("similarity"), "id").limit(20).select("id", F.col("similarity").alias("score"))
    return fuse(keyed, meaning).select("id", F.round("score", 4).alias("score"))


QUERIES = (
    notes_round_trip, sessions_round_trip, document_notes, archive_imports, list_item_counts, files_by_folder, json_round_trip, store_round_trip,
    note_updates, title_overlaps, title_overlap_with_category, sessions_of_month, masked_settings, split_flags, notes_of_sessions, categories_by_size,
    notes_by_category, notes_list, stats_overview, outline_symbols, outline_counts, hook_observations, note_lookup, vectors_truncated, vectors_migrated,
    knn_backend, index_terms, index_weights, weights_added, hybrid_faceted,
)


def queries():
    return {q.__name__: q for q in QUERIES}


def _trimmed(c: str) -> str:
    return f"trim({c}, ' ' || chr(10) || chr(9) || chr(13))"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _present(c: str) -> str:
    return f"list_filter(coalesce({c}, []), lambda x: x is not null and x <> '')"


def _rendered(c: str, *fields: str) -> str:
    joined = " || '=' || ".join(f"coalesce(x.{f}, '')" for f in fields)
    return f"list_transform(coalesce({c}, []), lambda x: {joined})"


_EPOCH = "floor(epoch({c}))::bigint"
_SLUG = "coalesce(nullif(substr(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 100), ''), 'untitled')"


_BODY = r"regexp_extract(text, '\A---\n(.*?)\n---(?:\n(.*))?\z', 2, 's')"


def _unquoted(c: str) -> str:
    inner = f"substr(trim({c}), 2, length(trim({c})) - 2)"
    double = rf"""replace(replace({inner}, '\"', '"'), '\', '')"""
    return f"""case when regexp_matches(trim({c}), '(?s)^".*"$') then {double} when regexp_matches(trim({c}), '(?s)^''.*''$') then replace({inner}, '''''', '''') else trim({c}) end"""


def _scalar(key: str) -> str:
    line = rf"regexp_extract(f || chr(10), '(?m)^{key}:[ \t]*(.*)$', 1)"
    return f"nullif({_unquoted(line)}, '')"


def _outline_sql() -> str:
    """The first pattern of a line's language that fits, from the same list of languages."""
    kinds, names = [], []
    for language, patterns in outline.PATTERNS.items():
        for kind, pattern, shown in patterns:
            fits = f"language = '{language}' and regexp_matches(line, '{pattern}')"
            for i in (3, 2, 1):
                shown = shown.replace(f"${i}", f"\\{i}")
            kinds.append(f"when {fits} then '{kind}'")
            names.append(f"when {fits} then regexp_replace(regexp_extract(line, '{pattern}'), '{pattern}', '{shown}')")
    return f"case {' '.join(kinds)} end as kind, case {' '.join(names)} end as name"


_FILES = r"""files as (select id || '/' || (i - 1) || '/' || c.path as path, c.path as p, 'f_' || regexp_replace(string_split(c.description, ' ')[-1], '\W', '', 'g') as name,
      regexp_replace(string_split(c.description, ' ')[1], '\W', '', 'g') as head, c.description as d
    from (select id, unnest(changes) as c, generate_subscripts(changes, 1) as i from s) where c.path is not null and c.description is not null),
  lines as (select path, unnest(x) as line, generate_subscripts(x, 1) as n, case lower(regexp_extract(p, '\.([A-Za-z0-9]+)$', 1)) when 'go' then 'go' when 'py' then 'python'
      when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'js' then 'typescript' when 'jsx' then 'typescript' when 'mjs' then 'typescript' when 'rs' then 'rust' else '' end as language
    from (select path, p, string_split('func ' || name || '(x int) {' || chr(10) || 'def ' || name || '(x):' || chr(10) || '    def ' || head || '(self):' || chr(10)
      || 'export function ' || name || '(x) {' || chr(10) || 'pub fn ' || name || '() {' || chr(10) || 'type ' || head || ' struct {' || chr(10) || d, chr(10)) as x from files))"""


def oracle_sql() -> dict[str, str]:
    c = f"with {CORPUS}"
    e = lambda x: _EPOCH.format(c=x)
    slug = lambda x: _SLUG.format(c=x)
    when = "coalesce(strftime(updated, '%Y-%m-%d %H:%M'), 'unknown')"
    sep = f"chr(10) || chr(10) || '--- Updated ' || {when} || ' ---' || chr(10)"
    return {
        "notes_round_trip": f"""{c} select id, nullif(category, '') as category, nullif(title, '') as title, md5({_trimmed("coalesce(content, '')")}) as digest, {_present('tags')} as tags,
            {e('created')} as created, {e('updated')} as updated, coalesce(cardinality(metadata), 0)::int as n_metadata, metadata['session_id'] as session_id from n""",
        "sessions_round_trip": f"""{c} select id, nullif(title, '') as title, nullif(date, '') as date, nullif(branch, '') as branch, nullif(project, '') as project, nullif(session_id, '') as session_id,
            {_present('tags')} as tags, md5({_trimmed("coalesce(summary, '')")}) as summary, md5({_trimmed("coalesce(what_happened, '')")}) as what_happened,
            coalesce(decisions, []) as decisions, coalesce(insights, []) as insights, coalesce(questions, []) as questions, coalesce(next_steps, []) as next_steps,
            {_rendered('changes', 'path', 'description')} as changes, {_rendered('problems', 'problem', 'solution')} as problems,
            {_rendered("list_filter(related_notes, lambda r: coalesce(r.id, '') <> '')", 'id', 'title', 'category')} as related_notes,
            {_rendered("list_filter(extra_sections, lambda r: coalesce(r.content, '') <> '')", 'name', 'content')} as extra_sections from s""",
        "files_by_folder": """select case when contains(p, '/') then regexp_extract(p, '^([^/]*)/', 1) else '' end as folder, count(*) as n_files
            from (select distinct filepath as p from store_files where removed_at is null) where p like '%.md' and not regexp_matches(p, '(^|/)\\._[^/]*$') group by 1""",
        "document_notes": rf"""with d as (select *, nullif(regexp_extract(text, '\A---\n(.*?)\n---(?:\n(.*))?\z', 1, 's'), '') as f,
              {_trimmed(_BODY)} as b, coalesce(source, 'none') as folder from documents where kind = 'note' and text is not null)
            select coalesce({_scalar('id')}, md5(folder || '/doc-' || doc_id || '.md')) as id, coalesce({_scalar('category')}, folder) as category, coalesce({_scalar('title')}, 'Doc ' || doc_id) as title,
              length(case when f is null then text else b end)::int as n_chars,
              list_filter(list_transform(case when f is null then [] when regexp_extract(f, '(?m)^tags:[ \t]*\[(.*)\][ \t]*$', 1) <> '' then string_split_regex(regexp_extract(f, '(?m)^tags:[ \t]*\[(.*)\][ \t]*$', 1), ',\s*')
                else list_transform(list_filter(string_split(regexp_extract(f || chr(10), '(?m)^tags:[ \t]*\n((?:(?:[ \t]+|- ).*\n)*)', 1), chr(10)), lambda x: trim(x) <> ''), lambda x: regexp_replace(x, '^\s*-\s*', '')) end,
                lambda x: {_unquoted('x')}), lambda x: x <> '') as tags from d""",
        "archive_imports": f"""{c}, t as (select *, substr(id, 1, 8) as k from s where date is not null and branch <> '')
            select k as session_id, date, regexp_replace(branch, '[/_]', '-', 'g') as branch, md5({_trimmed("coalesce(summary, '')")}) as summary, coalesce(decisions, []) as decisions, coalesce(next_steps, []) as next_steps,
              {_rendered('problems', 'problem', 'solution')} as problems, coalesce(len(changes), 0)::int as n_changes, coalesce(len(questions), 0)::int as n_questions
            from t where k not in (select k from t where project = 'harbor-ledger')""",
        "list_item_counts": """with d as (select doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[-*] ')), lambda x: trim(substr(x, 3))) as l from documents where text is not null)
            select doc_id, len(l)::int as n_glued, len(l)::int as n_plain, md5(array_to_string(l, '|')) as digest from d where len(l) > 0""",
        "knn_backend": """with v as (select doc_id, vector, dim from vectors where backend = 'tfidf' and model = 'tfidf' and len(vector) = dim and not list_bool_or([isnan(x) for x in vector])),
            q as (select list_transform(range(max(dim)), lambda i: (i % 7 + 1)::double) as q from v),
            h as (select doc_id, list_dot_product(vector::double[], q) as p from v, q where len(vector) = len(q)), b as (select * from h where p > 0.01 order by p desc, doc_id limit 20)
            select doc_id, round(max(p), 3) as similarity from b group by doc_id""",
        "json_round_trip": f"{c} select id, title, tags, metadata['origin'] as origin, {e('created')} as created from n",
        "store_round_trip": f"""{c}, t as (select id, category, title, length(content)::int as n_chars, ('0x' || substr(id, 1, 6))::bigint % 3 as third from n)
            select id, category, case when third = 0 then 'changed' else title end as title, n_chars from t where third <> 1""",
        "note_updates": f"""{c}, u as (select *, coalesce(content, '') as co, coalesce(title, '') as ti from n)
            select id, md5(co || case when co = '' or ends_with(co, chr(10)) then '' else chr(10) end || 'more') as appended, category, coalesce(nullif(category, ''), title) as title,
              md5(case when ti = '' or ti = co then co else co || {sep} || ti end) as content, md5(case when ti <> '' and co <> '' then ti || {sep} || co else ti || co end) as text,
              {_distinct("list_concat(coalesce(tags, []), ['api', 'new'])")} as tags, 'merge' as origin, metadata['session_id'] as session_id from u""",
        "title_overlaps": f"""{c}, {_title_classes()}
            select a.category, a.class_id as class_a, b.class_id as class_b, round(len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)), 4) as overlap
            from k2 a join k2 b on a.category = b.category and a.class_id < b.class_id and len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) >= 0.5""",
        "title_overlap_with_category": f"""{c}, t as (select id, {_title_word_list('title')} as a, {_title_word_list("replace(category, '-', ' ')")} as b from n)
            select id, round(case when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b)) / least(len(a), len(b)) end, 4)::double as overlap from t""",
        "sessions_of_month": f"{c} select id, date, project from s where date between '2025-05-31' and '2025-06-30'",
        "masked_settings": f"""{c}, t as (select id, unnest(map_entries(metadata)) as m from n), u as (select id, case when m.key = 'session_id' then 'api_token' else m.key end as key, m.value as value from t)
            select id, key, case when regexp_matches(lower(key), 'api_key|secret|password|token') and not ends_with(lower(key), 'api_key_env')
              then case when length(value) > 8 then substr(value, 1, 4) || '...' || right(value, 4) else '***' end else value end as shown from u""",
        "split_flags": f"""{c}, t as (select id, unnest(changes) as x from s), u as (select id, concat_ws(':', x.path, x.description) as f from t where x.path is not null)
            select distinct id, string_split(f, ':')[1] as path, case when contains(f, ':') then substr(f, strpos(f, ':') + 1) end as description,
              case when contains(f, ':') then substr(f, strpos(f, ':') + 1) end as category from u""",
        "notes_of_sessions": f"""{c} select metadata['session_id'] as session_id, substr(id, 1, 8) as note, title, category from n
            where metadata['session_id'] in (select session_id from s where session_id <> '')""",
        "categories_by_size": f"{c} select category, count(*) as n from n group by category order by n desc, category nulls first limit 5",
        "notes_by_category": f"{c} select category, count(*) as n, md5(coalesce(string_agg(title, '|' order by title), '')) as titles from n group by category",
        "notes_list": f"{c} select id, category, title from n order by category nulls first, title nulls first, id limit 25",
        "stats_overview": f"""{c}, f as (select filepath, arg_max(struct_pack(b := n_bytes, r := removed_at), coalesce(removed_at, timestamp '9999-12-31')) as f from store_files group by filepath)
            select 'type' as what, type as name, count(*) as n from c group by type union all select 'category', category, count(*) from n group by category
            union all (select 'tag', tag, count(*) as k from (select unnest(tags) as tag from c) where tag is not null group by tag order by k desc, tag limit 10)
            union all select 'storage', 'bytes', sum(f.b)::bigint from f where f.r is null""",
        "outline_symbols": f"""{c}, {_FILES}, o as (select path, language, n as line_no, {_outline_sql()} from lines where language <> '')
            select path, language, line_no::int as line, kind, name from o where kind is not null""",
        "outline_counts": f"""{c}, {_FILES}, o as (select path, language, {_outline_sql()} from lines where language <> '')
            select path, language, count(kind) as n_symbols from o group by all""",
        "hook_observations": r"""with f as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '(?i)error|fail|warning|passed|permission denied')) as l
              from documents where kind = 'capture' and strlen(text) between 20 and 2000 and doc_id % 3 <> 0)
            select 'Auto: Bash observation' as title, md5(array_to_string(l, chr(10))) as digest, count(*) as n from f where array_to_string(l, chr(10)) <> '' group by all""",
        "note_lookup": f"""{c}, q as (select unnest(['ideas-about-explicit-cache-entry-in-the-ingest-worker', 'cache', 'Checklist for']) as asked),
            t as (select asked, id, title, case when {slug('title')} = {slug('asked')} then 1 when title = asked then 2 when contains(lower(title), lower(asked)) then 3 end as way from n, q where category = 'api-notes')
            select asked, way::int as way, id, title from t where way is not null qualify way = min(way) over (partition by asked)""",
        "vectors_truncated": """select vec_id, len(embedding[1:8])::int as dim, round(list_dot_product(embedding[1:8]::double[], embedding[1:8]::double[]), 5) as product from embeddings""",
        "vectors_migrated": "select vec_id::varchar as doc_id, 'tfidf' as backend, 'tfidf' as model, len(embedding)::int as dim from embeddings",
        "index_terms": f"""{c}, w as (select id, unnest(['title', 'content', 'tags']) as field, unnest([{_tokens('title')}, {_tokens('content')}, {_tokens("array_to_string(tags, ' ')")}]) as t from c),
            x as (select id, field, unnest(t) as term from w)
            select term, field, count(distinct id) as n_rows, count(*) as n, count(*) as n_places from x group by all""",
        "index_weights": f"with {_SEMANTIC} select term, count(*) as n_rows, round(max(w), 4) as largest from tfidf group by term",
        "weights_added": f"""{c}, counts as (select id, term, count(*) as tf from (select id, unnest({_terms_sql("concat_ws(' ', title, content)")}) as term from n) group by all),
            df as (select term, count(*) as df from counts group by term), total as (select count(*) as n from n),
            vocab as (select df.* from df, total where df <= case when floor(0.95 * n) < 1 then n else floor(0.95 * n) end),
            own as (select id, term, count(*) as tf from (select id, unnest({_terms_sql('what_happened')}) as term from s) group by all),
            raw as (select id, term, (1 + ln(tf)) * ln((n + 1) / (df + 1)) as w from own join vocab using (term), total)
            select id, count(*) as n_terms, round(max(w) / sqrt(sum(w * w)), 4) as largest from raw group by id having sum(w * w) > 0""",
        "hybrid_faceted": f"""with {_scored('deadline OR queue').replace('tf as (', 'tfs as (').replace(' from tf)', ' from tfs)').replace('tf.*', 'tfs.*').replace('from tf,', 'from tfs,')},
            {_SEMANTIC.replace(CORPUS + ',', '')}, k0 as (select * from scored where type = 'note' and category = 'how-to' order by score desc, id limit 50),
            k as (select id, score from k0 order by score desc, id limit 20),
            m as (select semantic.id, similarity as score from semantic join c on c.id = semantic.id where c.type = 'note' and c.category = 'how-to' order by similarity desc, semantic.id limit 20),
            ks as (select id, (score - min(score) over ()) / case when max(score) over () > min(score) over () then max(score) over () - min(score) over () else 1 end as x from k),
            ms as (select id, (score - min(score) over ()) / case when max(score) over () > min(score) over () then max(score) over () - min(score) over () else 1 end as x from m),
            f as (select id, 0.7 * coalesce(ks.x, 0) + 0.3 * coalesce(ms.x, 0) as f from ks full join ms using (id))
            select id, round(f, 4) as score from f order by f.f desc, id limit 20""",
    }


def _title_word_list(column: str) -> str:
    from lorekeep.functions.text import TITLE_STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in TITLE_STOP_WORDS)
    return rf"list_distinct(list_filter(string_split_regex(lower(coalesce({column}, '')), '\s+'), lambda w: strlen(w) >= 3 and w not in ({stop})))"


def _title_classes() -> str:
    return f"""k as (select category, list_sort({_title_word_list('title')}) as words, id from n),
            k2 as (select category, words, min(id) as class_id, count(*) as n_rows from k where len(words) >= 2 group by all)"""
