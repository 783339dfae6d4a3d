"""A document memory in one folder: every command of the store as a method over DataFrames.

Tables: notes, sessions, entries (what is indexed), access_log, vectors, and the index: postings, index_rows,
term_weights, vocabulary, index_meta. Methods that write notes or sessions write their index too, by appending a
generation; reindex() builds it anew. Methods that read return DataFrames and never write.
"""

from __future__ import annotations

import uuid
import warnings
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.dates import date_range
from lorekeep.functions.text import for_embedding, id8, slug_name
from lorekeep.operators import capture, dedup, embed, graph, integrity, keyword, outline, stats, validate, weights
from lorekeep.operators.hybrid import fuse
from lorekeep.operators.index import SearchIndex, WeightIndex, live_rows, postings_of, rows_of
from lorekeep.session import cut
from lorekeep.sources import markdown, sinks
from lorekeep.sources.corpus import as_corpus


ENTRY = ("id", "type", "title", "category", "branch", "project", "session_id", "date", "created")


class Memory:
    def __init__(self, spark: SparkSession, root: str, embedder: embed.Embedder | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = sinks.Store(spark, root)
        self.embedder = embedder

    # Reading

    def corpus(self) -> DataFrame:
        return as_corpus(self.store.read("notes"), self.store.read("sessions"))

    def notes(self, category: str | None = None) -> DataFrame:
        """Notes by category and title."""
        rows = self.store.read("notes")
        return (rows.where(F.col("category") == category) if category else rows).orderBy("category", "title", "id")

    def note(self, key: str) -> DataFrame:
        """The note with this id, or the first whose id begins with it."""
        return self.store.read("notes").where(F.startswith("id", F.lit(key))).orderBy("id").limit(1)

    def session(self, key: str) -> DataFrame:
        return self.store.read("sessions").where(F.startswith("id", F.lit(key))).orderBy("id").limit(1)

    def note_by_title(self, category: str, title: str) -> DataFrame:
        """Notes of a category by title; of several ways the first that finds any: the file name that the title makes,
        the title itself, titles that contain it without regard to case."""
        rows = self.store.read("notes").where(F.col("category") == category)
        ways = F.when(slug_name(F.col("title")) == slug_name(F.lit(title)), 1).when(F.col("title") == title, 2)
        ranked = rows.withColumn("_way", ways.when(F.contains(F.lower("title"), F.lit(title.lower())), 3)).where("_way is not null")
        best = ranked.agg(F.min("_way")).first()[0]
        return ranked.where(F.col("_way") == best).drop("_way").orderBy("title", "id")

    def notes_by_category(self) -> DataFrame:
        """(category, n, titles): the notes of each category in order of title."""
        rows = self.store.read("notes").groupBy("category").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("title")).alias("titles"))
        return rows.orderBy("category")

    def categories(self) -> DataFrame:
        return stats.categories(self.store.read("notes")).orderBy("category")

    def tags(self) -> DataFrame:
        return stats.tag_counts(self.store.read("notes")).select("tag").orderBy("tag")

    def sessions(
        self, last: int = 10, days: str | None = None, branch: str | None = None, project: str | None = None, today: date | None = None
    ) -> DataFrame:
        """The newest sessions, of a range of days in words ('7d', 'week', 'A..B')."""
        rows = self.store.read("sessions")
        after, before = date_range(days, today or date.today()) if days else (None, None)
        facets = keyword.Facets(after=after, before=before, branch=branch, project=project)
        return facets.where(rows).orderBy(F.desc("date"), F.desc_nulls_last("created"), "id").limit(last)

    # Searching

    def index(self) -> SearchIndex:
        return SearchIndex(self.store.read("postings"), self.store.read("index_rows"), self.corpus(), self.store.is_grown("index_rows"))

    def search(self, query: str, facets: keyword.Facets | None = None, limit: int = 20, sort: str = "relevance", as_of: datetime | None = None) -> DataFrame:
        return keyword.search(self.index(), query, facets, as_of, limit, sort)

    def search_notes(self, query: str, category: str | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
        return keyword.note_search(self.index(), query, category, tags)

    def search_sessions(self, query: str, branch: str | None = None, days: str | None = None, today: date | None = None) -> DataFrame:
        after, before = date_range(days, today or date.today()) if days else (None, None)
        return keyword.session_search(self.index(), query, branch, after, before)

    def semantic(self, query: str, facets: keyword.Facets | None = None, limit: int = 20) -> DataFrame:
        """Rows of the corpus by similarity to the query in the active backend; without an embedder by TF-IDF. An
        embedder that cannot be reached is an error, never a silent fallback."""
        if self.embedder is None:
            hits = self._tfidf(query).select("id", "similarity")
        else:
            self.embedder.available()
            vector = self.embedder.embed([query], "query")[0]
            active = self.store.read("vectors", backend=self.embedder.name, model=self.embedder.model)
            hits = weights.nearest_to(active, vector, 2 * limit).select(F.col("doc_id").alias("id"), "similarity")
        docs = (facets or keyword.Facets()).where(self.corpus())
        return docs.join(hits, "id").orderBy(F.desc("similarity"), "id").limit(limit)

    def _tfidf(self, query: str) -> DataFrame:
        return self._weight_index().similar(query)

    def _weight_index(self) -> WeightIndex:
        found = self.store.read("term_weights")
        if self.store.is_grown("term_weights"):
            found = found.join(live_rows(self.store.read("index_rows")).select("id", "generation"), ["id", "generation"], "left_semi")
        return WeightIndex(found, self.store.read("vocabulary"), int(self._meta("n_docs") or 0))

    def _meta(self, key: str) -> str | None:
        row = self.store.read("index_meta").where(F.col("key") == key).first() if self.store.version("index_meta") else None
        return row["value"] if row else None

    def hybrid(self, query: str, facets: keyword.Facets | None = None, limit: int = 20, as_of: datetime | None = None, fallback: bool = False) -> DataFrame:
        """Keyword and semantic hits fused. If the embedder cannot be reached it is an error, or with `fallback` the
        keyword hits alone."""
        keyed = self.search(query, facets, limit, as_of=as_of).select("id", "score")
        try:
            meaning = self.semantic(query, facets, limit).select("id", F.col("similarity").alias("score"))
        except embed.EmbedderUnavailable:
            if not fallback:
                raise
            meaning = keyed.limit(0)
        return fuse(keyed, meaning, limit).join(self.corpus().select("id", "type", "title", "category", "date"), "id").orderBy(F.desc("score"), "id")

    # Writing

    def add_notes(self, rows: DataFrame) -> DataFrame:
        """Adds valid notes, merging those whose title or a similar one is there; (id, into, how), how also 'known' for
        ids that are there and 'refused' for broken limits."""
        rows = rows.withColumn("_broken", F.size(validate.violations(*(F.col(c) for c in ("title", "content", "tags", "category")))) > 0)
        refused = cut(rows.where("_broken").select("id", F.lit(None).cast("string").alias("into"), F.lit("refused").alias("how")), "refused")
        placed = self.store.add_notes(rows.where("not _broken").drop("_broken"))
        self._changed(placed.where("how <> 'known'").select(F.col("into").alias("id")))
        return placed.unionByName(refused)

    def append(self, key: str, text: str) -> None:
        row = self.note(key)
        self._rewrite(row.withColumn("content", dedup.appended(F.col("content"), F.lit(text))))

    def update(self, key: str, title: str = "", content: str = "", tags: list[str] | None = None) -> None:
        """New values for what is given; nothing given is an error."""
        if not (title or content or tags):
            raise ValueError("nothing to change")
        row = self.note(key).withColumns({c: dedup.updated(F.col(c), F.lit(v)) for c, v in (("title", title), ("content", content))})
        if tags:
            row = row.withColumn("tags", F.array(*[F.lit(t) for t in tags]))
        self._rewrite(row)

    def _rewrite(self, row: DataFrame) -> None:
        row = cut(row, "row")
        self.store.upsert("notes", row, ["id"])
        self._changed(row.select("id"))

    def delete(self, key: str) -> None:
        """The note, with its entry, its place in the index and all its vectors."""
        gone = cut(self.note(key).select("id"), "gone")
        self.store.delete("notes", gone, ["id"])
        for name, column in (("vectors", "doc_id"), ("entries", "id")):
            if self.store.version(name):
                self.store.delete(name, gone.withColumnRenamed("id", column), [column])
        if self.store.version("index_rows"):
            rows = self.store.read("index_rows")
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("id", "generation", "gone")]
            self.store.append("index_rows", gone.select("id", F.lit(self._next()).alias("generation"), F.lit(True).alias("gone"), *blank))

    def save_sessions(self, rows: DataFrame) -> DataFrame:
        """Saves reports, merging those of one session; (id, into, how)."""
        placed = cut(self.store.save_sessions(rows), "placed")
        self._changed(placed.select(F.col("into").alias("id")))
        return placed

    def _next(self) -> int:
        return self.store.version("index_rows") + 1

    def _changed(self, ids: DataFrame) -> None:
        """Writes entries, postings, weights by the vocabulary that is there, and vectors of these rows. Without an
        index, that is before the first reindex(), it does nothing. An embedder that cannot be reached is warned of:
        the rows stay findable by their words, and repair() adds their vectors."""
        if not self.store.version("index_rows"):
            return
        docs = cut(self.corpus().join(ids.distinct(), "id", "left_semi"), "docs")
        g = self._next()
        self.store.upsert("entries", docs.select(*ENTRY), ["id"])
        self.store.append("postings", postings_of(docs, g))
        self.store.append("index_rows", rows_of(docs, g))
        text = for_embedding(F.col("title"), F.col("content"), F.col("tags"))
        index = self._weight_index()
        own = weights.weighted(weights.term_counts(docs, "id", text), index.vocabulary, index.n_docs)
        self.store.append("term_weights", own.withColumn("generation", F.lit(g)))
        if self.embedder is not None and self.store.version("vectors"):
            try:
                self.embedder.available()
                at = F.coalesce(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
                self.store.upsert("vectors", embed.embedded(docs, "id", text, self.embedder, "").withColumn("created_at", at), ["doc_id", "backend", "model"], ("backend", "model"))
            except embed.EmbedderUnavailable as e:
                warnings.warn(f"no vectors written: {e}", stacklevel=2)

    def merged_sessions(self) -> DataFrame:
        return dedup.merge_sessions(self.store.read("sessions"))

    def log_access(self, ids: DataFrame, access_type: str, at: str) -> None:
        self.store.append("access_log", ids.select(F.col("id").alias("entry_id"), F.lit(at).alias("accessed_at"), F.lit(access_type).alias("access_type")))

    def resolve_session(self, project: str, now: datetime, window: timedelta = timedelta(hours=4)) -> str:
        """The label of the project's session of today that was active within the window, or a new one."""
        rows = self.store.read("sessions").where((F.col("project") == project) & (F.col("session_id") != ""))
        rows = rows.where((F.col("date") == now.date().isoformat()) & (F.col("created") > F.lit(now - window)))
        found = rows.orderBy(F.desc("created"), "id").first()
        return found["session_id"] if found else now.strftime("%Y%m%d-%H%M%S-") + uuid.uuid4().hex[:8]

    # Indexing and checking

    def reindex(self, as_of: str, vectors: bool = True) -> None:
        """Entries, postings, term weights and, with an embedder, the vectors of its own backend, all anew."""
        docs = cut(self.corpus(), "docs")
        n = docs.count()
        self.store.overwrite("entries", docs.select(*ENTRY), "id")
        self.store.overwrite("postings", postings_of(docs))
        self.store.overwrite("index_rows", rows_of(docs))
        text = for_embedding(F.col("title"), F.col("content"), F.col("tags"))
        counts = cut(weights.term_counts(docs, "id", text), "counts")
        known = cut(WeightIndex.vocabulary_of(counts, n), "vocabulary")
        self.store.overwrite("vocabulary", known)
        self.store.overwrite("term_weights", WeightIndex.weights_of(counts, known, n).withColumn("generation", F.lit(0)))
        meta = {"n_docs": str(n), "index_backend": self._meta("index_backend") or ""}
        if vectors and self.embedder is not None:
            fresh = embed.embedded(docs, "id", text, self.embedder, as_of)
            if self.store.version("vectors"):
                self.store.replace("vectors", fresh, backend=self.embedder.name, model=self.embedder.model)
            else:
                self.store.overwrite("vectors", fresh, "doc_id", ("backend", "model"))
            meta["index_backend"] = f"{self.embedder.name}:{self.embedder.model}"
        self.store.overwrite("index_meta", self.spark.createDataFrame(list(meta.items()), "key string, value string"))

    def verify(self) -> DataFrame:
        """One row: documents without entry, entries and indexed rows without document, entries that are not in the text
        index, and whether all agree."""
        ids = lambda df: df.select("id").distinct()
        docs, entries, indexed = ids(self.corpus()), ids(self.store.read("entries")), ids(live_rows(self.store.read("index_rows")))
        amiss = {
            "n_unindexed": docs.join(entries, "id", "left_anti"),
            "n_orphan_entries": entries.join(docs, "id", "left_anti"),
            "n_orphan_postings": indexed.join(docs, "id", "left_anti"),
            "n_without_postings": entries.join(indexed, "id", "left_anti"),
        }
        return integrity.side_by_side(amiss).withColumn("in_sync", sum((F.col(c) for c in amiss), F.lit(0)) == 0)

    def repair(self, as_of: str) -> DataFrame:
        """Reindexes if verify() finds a difference, drops vectors of documents that are gone, and verifies again."""
        if not self.verify().first()["in_sync"]:
            self.reindex(as_of)
        if self.store.version("vectors"):
            gone = self.store.read("vectors").select("doc_id").join(self.corpus().select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
            if not gone.isEmpty():
                self.store.delete("vectors", gone, ["doc_id"])
        return self.verify()

    def health(self, files: DataFrame, entries: DataFrame, backend: str, model: str) -> DataFrame:
        indexed = live_rows(self.store.read("index_rows"))
        return integrity.health(entries, files, self.corpus(), self.store.read("vectors"), backend, model, indexed, self._meta("index_backend"))

    # Overviews

    def graph(self) -> tuple[DataFrame, DataFrame]:
        n, s = self.store.read("notes"), self.store.read("sessions")
        return graph.nodes(n, s), graph.edges(n, s)

    def context(self, limit: int = 5, project: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The notes updated last, the newest sessions and the totals."""
        return stats.recent(self.store.read("notes"), limit, "updated"), self.sessions(limit, project=project), stats.counts_by_type(self.corpus())

    def stats(self) -> dict[str, DataFrame]:
        docs = self.corpus()
        return {
            "by_type": stats.counts_by_type(docs),
            "by_category": stats.categories(self.store.read("notes")).orderBy(F.desc("n"), "category"),
            "top_tags": stats.top_tags(docs),
            "recent": stats.recent(docs),
        }

    def top_accessed(self, limit: int = 10) -> DataFrame:
        return stats.top_accessed(self.store.read("access_log"), self.corpus(), limit)

    def notes_of_session(self, session_id: str) -> DataFrame:
        """(id, title, category) of the notes that name the session; ids by their first eight characters."""
        rows = self.store.read("notes").where(F.col("metadata")["session_id"] == session_id)
        return rows.select(id8(F.col("id")).alias("id"), "title", "category")

    # Files

    def import_notes(self, folder: str) -> DataFrame:
        rows = markdown.import_plain(markdown.read_files(self.spark, folder), self.store.read("notes"), folder)
        now = F.current_timestamp()
        return self.add_notes(rows.select("*", now.alias("created"), now.alias("updated"), F.create_map().cast("map<string,string>").alias("metadata")))

    def export_files(self, folder: str) -> None:
        """Every note and session as a Markdown file below folder."""
        sinks.write_files(self.store.read("notes").select(sinks.note_path().alias("path"), sinks.note_markdown().alias("text")), folder)
        sinks.write_files(self.store.read("sessions").select(sinks.session_path().alias("path"), sinks.session_markdown().alias("text")), folder)

    def observe(self, lines: DataFrame, now: datetime) -> DataFrame:
        """Observations of hook lines (value), added to the category auto-capture."""
        found = capture.observations(capture.hook_rows(lines)).groupBy("title").agg(F.array_join(F.collect_set("content"), "\n").alias("content"))
        rows = found.select(
            F.expr("uuid()").alias("id"), F.lit("note").alias("type"), F.lit("auto-capture").alias("category"), "title", "content",
            F.array(F.lit("auto-capture")).alias("tags"), F.lit(now).alias("created"), F.lit(now).alias("updated"),
            F.create_map().cast("map<string,string>").alias("metadata"),
        )
        return self.add_notes(cut(rows, "observed"))

    @staticmethod
    def outline(files: DataFrame) -> DataFrame:
        return outline.outline(files)

    @staticmethod
    def symbol_counts(files: DataFrame) -> DataFrame:
        return outline.symbol_counts(files)

    @staticmethod
    def validate_reports(sessions: DataFrame) -> DataFrame:
        return validate.validated(sessions)
