"""Search queries over notes, sessions, documents and vectors, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import TERM_STOP_WORDS, id8, note_preview
from lorekeep.operators import weights
from lorekeep.operators.hybrid import fuse
from lorekeep.operators.index import SearchIndex
from lorekeep.operators.keyword import Facets, Query, bm25, note_search, search, session_search
from lorekeep.plans.indexes import search_index, weight_index
from lorekeep.sources.corpus import corpus
from lorekeep.sources.tables import table

AS_OF = datetime(2025, 7, 1)
PROJECT = "harbor-ledger"
QUERY_TEXT = "deadline of the retry queue after a rollback"

BM25 = {
    "bm25_word": "replica",
    "bm25_and": "replica deadline",
    "bm25_or": "replica deadline OR checksum",
    "bm25_not": "replica NOT deadline",
    "bm25_prefix": "dead* lock",
    "bm25_phrase": '"row group" replica',
}


def _bm25(text: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        index = search_index(spark, folder)
        return index.rows.select("id", "type").join(index.bm25(text), "id").select("id", "type", F.round("score", 6).alias("score"))

    return run


def search_scanned(spark: SparkSession, folder: str) -> DataFrame:
    """A search of a corpus without an index."""
    return bm25(corpus(spark, folder), '"row group" OR check* NOT replica').select("id", F.round("score", 6).alias("score"))


def search_faceted(spark: SparkSession, folder: str) -> DataFrame:
    hits = search(search_index(spark, folder), "replica OR deadline", Facets(tags=("ap",), after="2024-09-01", before="2025-06-30"), AS_OF)
    return hits.select("id", "type", "title", "preview", F.round("score", 6).alias("score"))


def search_category(spark: SparkSession, folder: str) -> DataFrame:
    hits = search(search_index(spark, folder), "queue OR checksum", Facets(type="note", category="how-to"), limit=30)
    return hits.select("id", "category", F.round("score", 6).alias("score"))


def search_project(spark: SparkSession, folder: str) -> DataFrame:
    hits = search(search_index(spark, folder), "queue OR replica", Facets(project=PROJECT), AS_OF, limit=10)
    return hits.select("id", "project", F.round("score", 6).alias("score"))


def search_by_date(spark: SparkSession, folder: str) -> DataFrame:
    return search(search_index(spark, folder), "checksum OR lease", sort="date", limit=15).select("id", "created", F.round("score", 6).alias("score"))


def search_note_tags(spark: SparkSession, folder: str) -> DataFrame:
    hits = note_search(search_index(spark, folder), "queue", tags=("API",))
    return hits.select("id", "category", note_preview(F.col("title")).alias("title"), F.round("score", 6).alias("score"))


def search_sessions(spark: SparkSession, folder: str) -> DataFrame:
    hits = session_search(search_index(spark, folder), "queue OR lease", branch="FIX", after="2024-08-01")
    return hits.select(id8(F.col("id")).alias("id8"), "branch", "date", F.round("score", 6).alias("score"))


def _counts(spark: SparkSession, folder: str):
    docs = table(spark, folder, "documents")
    return weights.term_counts(docs, "doc_id", F.col("text")), docs.count()


def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    counts, _ = _counts(spark, folder)
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def vocab_filtered(spark: SparkSession, folder: str) -> DataFrame:
    counts, n = _counts(spark, folder)
    return weights.vocabulary(weights.document_frequency(counts), n)


def tfidf_norms(spark: SparkSession, folder: str) -> DataFrame:
    counts, n = _counts(spark, folder)
    w = weights.tfidf(counts, weights.document_frequency(counts), n)
    return w.groupBy("id").agg(
        F.count("*").alias("n_terms"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 4).alias("norm"), F.round(F.max("w"), 4).alias("largest")
    )


def _semantic(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """Rows of the corpus most similar to QUERY_TEXT by TF-IDF."""
    return weight_index(spark, folder).similar(QUERY_TEXT).orderBy(F.desc("similarity"), "id").limit(limit)


def tfidf_search(spark: SparkSession, folder: str) -> DataFrame:
    return _semantic(spark, folder, 40).select("id", F.round("similarity", 5).alias("similarity"))


def semantic_enriched(spark: SparkSession, folder: str) -> DataFrame:
    rows = search_index(spark, folder).rows.select("id", "type", "title", "date")
    hits = _semantic(spark, folder, 40).join(rows, "id").orderBy(F.desc("similarity"), "id").limit(20)
    return hits.select("id", "type", "title", "date", F.round("similarity", 5).alias("similarity"))


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    index = search_index(spark, folder)
    keyword = search(SearchIndex(index.postings, index.rows), "deadline retry OR rollback", as_of=AS_OF).select("id", "score")
    semantic = _semantic(spark, folder, 20).select("id", F.col("similarity").alias("score"))
    return fuse(keyword, semantic).select("id", F.round("score", 4).alias("score"))


def fuse_one_side(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion with a keyword side that finds nothing: the other side's raw scores."""
    index = search_index(spark, folder)
    keyword = search(SearchIndex(index.postings, index.rows), "zzqqxxunknown").select("id", "score")
    semantic = _semantic(spark, folder, 20).select("id", F.col("similarity").alias("score"))
    return fuse(keyword, semantic).select("id", F.round("score", 4).alias("score"))


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    query = vectors.orderBy("vec_id").first()["embedding"]
    return weights.nearest_to(vectors, query, 20, "embedding", "vec_id").select("vec_id", F.round("similarity", 5).alias("similarity"))


def queries():
    own = {name: _bm25(text) for name, text in BM25.items()}
    named = (
        search_scanned, search_faceted, search_category, search_project, search_by_date, search_note_tags, search_sessions, term_stats,
        vocab_filtered, tfidf_norms, tfidf_search, semantic_enriched, hybrid_search, fuse_one_side, knn_cosine,
    )
    return own | {q.__name__: q for q in named}


SESSION_TEXT = """concat_ws(' ', title, summary, what_happened, array_to_string(decisions, ' '),
  array_to_string(list_transform(changes, lambda x: concat_ws(' ', x.path, x.description)), ' '),
  array_to_string(list_transform(problems, lambda x: concat_ws(' ', x.problem, x.solution)), ' '),
  array_to_string(insights, ' '), array_to_string(questions, ' '), array_to_string(next_steps, ' '),
  array_to_string(list_transform(related_notes, lambda x: x.title), ' '),
  array_to_string(list_transform(extra_sections, lambda x: concat_ws(' ', x.name, x.content)), ' '),
  array_to_string(tags, ' '))"""
CORPUS = f"""n as (select * from notes where id is not null qualify row_number() over
    (partition by id order by updated desc nulls last, content desc nulls last, title desc nulls last) = 1),
s as (select * from sessions where id is not null qualify row_number() over
    (partition by id order by created desc nulls last, summary desc nulls last, what_happened desc nulls last, title desc nulls last) = 1),
c as (select id, 'note' as type, category, title, content, tags, created, updated, strftime(created, '%Y-%m-%d') as date,
        null as branch, null as project, metadata['session_id'] as session_id from n
    union all select id, 'session', null, title, {SESSION_TEXT}, tags, created, null, date, branch, project, session_id from s)"""


def _tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(lower(strip_accents(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _occurrences(unit: str) -> str:
    words = unit.removesuffix("*").split()
    parts = []
    for f in ("a", "b", "g"):
        if len(words) > 1:
            same = " and ".join(f"{f}[i + {k}] = '{w}'" for k, w in enumerate(words))
            parts.append(f"len(list_filter(range(1, len({f}) + 1), lambda i: {same}))")
        elif unit.endswith("*"):
            parts.append(f"len(list_filter({f}, lambda t: starts_with(t, '{words[0]}')))")
        else:
            parts.append(f"len(list_filter({f}, lambda t: t = '{words[0]}'))")
    return " + ".join(parts)


def _scored(text: str) -> str:
    """CTEs that end in `scored`: the matching corpus rows with their BM25 score."""
    q = Query.parse(text)
    units = q.units()
    tf = ", ".join(f"{_occurrences(u)} as tf{i}" for i, u in enumerate(units))
    gone = " and ".join([f"({_occurrences(u)}) = 0" for u in q.excluded] or ["true"])
    n = ", ".join(f"count(*) filter (where tf{i} > 0) as n{i}" for i in range(len(units)))

    def part(u: str) -> str:
        i = units.index(u)
        return f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))"

    hit = lambda g: " and ".join(f"tf{units.index(u)} > 0" for u in g)
    score = " + ".join(f"case when {hit(g)} then {' + '.join(part(u) for u in g)} else 0 end" for g in q.groups)
    return f"""{CORPUS},
w as (select *, {_tokens('title')} as a, {_tokens('content')} as b, {_tokens("array_to_string(tags, ' ')")} as g from c),
tf as (select *, len(a) + len(b) + len(g) as dl, {tf} from w),
st as (select count(*) as n, avg(dl) as mean, {n} from tf),
scored as (select tf.*, {score} as score from tf, st where ({' or '.join(f'({hit(g)})' for g in q.groups)}) and {gone})"""


_BOOST = """(1 + case when (epoch(timestamp '2025-07-01') - floor(epoch(created))) / 86400 < 7 then 0.2
    when (epoch(timestamp '2025-07-01') - floor(epoch(created))) / 86400 < 30
      then 0.2 * (1 - ((epoch(timestamp '2025-07-01') - floor(epoch(created))) / 86400 - 7) / 23) else 0 end)"""
_PREVIEW = "case when length(trim(substr(content, 1, 200))) > 100 then substr(trim(substr(content, 1, 200)), 1, 100) || '...' else trim(substr(content, 1, 200)) end"


def _terms_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in TERM_STOP_WORDS)
    return rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{Nd}}]+'), lambda t: strlen(t) >= 2 and t not in ({stop}))"


def _weights(source: str, key: str, text: str) -> str:
    return f"""counts as (select id, term, count(*) as tf from (select {key} as id, unnest({_terms_sql(text)}) as term from {source}) group by all),
df as (select term, count(*) as df from counts group by term),
total as (select count(*) as n from {source}),
vocab as (select df.* from df, total where df <= case when floor(0.95 * n) < 1 then n else floor(0.95 * n) end),
raw as (select id, term, (1 + ln(tf)) * ln((n + 1) / (df + 1)) as w from counts join vocab using (term), total),
norms as (select id, sqrt(sum(w * w)) as norm from raw group by id having norm > 0),
tfidf as (select id, term, w / norm as w from raw join norms using (id))"""


_SEMANTIC = f"""{CORPUS}, {_weights('c', 'id', 'content')},
q0 as (select term, count(*) as tf from (select unnest({_terms_sql(f"'{QUERY_TEXT}'")}) as term) group by term),
q1 as (select term, (1 + ln(tf)) * ln((n + 1) / (df + 1)) as w from q0 join vocab using (term), total),
q as (select term, w / (select sqrt(sum(w * w)) from q1) as qw from q1),
semantic as (select id, sum(w * qw) as similarity from tfidf join q using (term) group by id having similarity > 0.01)"""


def oracle_sql() -> dict[str, str]:
    sql = {name: f"with {_scored(text)} select id, type, round(score, 6) as score from scored" for name, text in BM25.items()}
    docs = _weights("documents", "doc_id", "text")
    top = "order by similarity desc, id limit"
    return sql | {
        "search_faceted": f"""with {_scored('replica OR deadline')},
            hits as (select * from scored where array_to_string(tags, ' ') ilike '%ap%' and date between '2024-09-01' and '2025-06-30'
              order by score desc, id limit 50)
            select id, type, title, {_PREVIEW} as preview, round(score * {_BOOST}, 6) as score from hits order by score * {_BOOST} desc, id limit 20""",
        "search_scanned": f"with {_scored('\"row group\" OR check* NOT replica')} select id, round(score, 6) as score from scored",
        "search_category": f"""with {_scored('queue OR checksum')} select id, category, round(score, 6) as score from scored
            where type = 'note' and category = 'how-to' order by scored.score desc, id limit 30""",
        "search_project": f"""with {_scored('queue OR replica')}, hits as (select * from scored where project = '{PROJECT}' order by score desc, id limit 50)
            select id, project, round(score * {_BOOST}, 6) as score from hits order by hits.score * {_BOOST} desc, id limit 10""",
        "fuse_one_side": f"with {_SEMANTIC} select id, round(similarity, 4) as score from semantic order by semantic.similarity desc, id limit 20",
        "search_by_date": f"""with {_scored('checksum OR lease')}, hits as (select * from scored order by score desc, id limit 50)
            select id, created, round(score, 6) as score from hits order by created desc nulls last, id limit 15""",
        "search_note_tags": f"""with {_scored('queue')}, hits as (select * from scored where type = 'note' order by score desc, id limit 50)
            select id, category, case when length(title) > 60 then substr(title, 1, 57) || '...' else title end as title, round(score, 6) as score
            from hits where list_contains(list_transform(tags, lambda t: lower(t)), 'api')""",
        "search_sessions": f"""with {_scored('queue OR lease')}
            select substr(id, 1, 8) as id8, branch, date, round(score, 6) as score from scored
            where type = 'session' and branch ilike '%FIX%' and date >= '2024-08-01' order by scored.score desc, id limit 50""",
        "term_stats": f"with {docs} select term, count(*) as df, sum(tf)::bigint as n from counts group by term",
        "vocab_filtered": f"with {docs} select term, df from vocab",
        "tfidf_norms": f"with {docs} select id, count(*) as n_terms, round(sqrt(sum(w * w)), 4) as norm, round(max(w), 4) as largest from tfidf group by id",
        "tfidf_search": f"with {_SEMANTIC} select id, round(similarity, 5) as similarity from semantic {top.replace('similarity', 'semantic.similarity')} 40",
        "semantic_enriched": f"""with {_SEMANTIC}, best as (select * from semantic {top} 40)
            select id, type, title, date, round(similarity, 5) as similarity from best join c using (id) order by best.similarity desc, id limit 20""",
        "hybrid_search": f"""with {_scored('deadline retry OR rollback').replace('tf as (', 'tfs as (').replace(' from tf)', ' from tfs)').replace('tf.*', 'tfs.*').replace('from tf,', 'from tfs,')},
            {_SEMANTIC.replace(CORPUS + ',', '')},
            k0 as (select * from scored order by score desc, id limit 50),
            k as (select id, score * {_BOOST} as score from k0 order by score * {_BOOST} desc, id limit 20),
            m as (select id, similarity as score from semantic order by similarity desc, id limit 20),
            ks as (select id, (score - min(score) over ()) / case when max(score) over () > min(score) over () then max(score) over () - min(score) over () else 1 end as x from k),
            ms as (select id, (score - min(score) over ()) / case when max(score) over () > min(score) over () then max(score) over () - min(score) over () else 1 end as x from m),
            f as (select id, 0.7 * coalesce(ks.x, 0) + 0.3 * coalesce(ms.x, 0) as f from ks full join ms using (id))
            select id, round(f, 4) as score from f order by f.f desc, id limit 20""",
        "knn_cosine": """with q as (select embedding as e from embeddings order by vec_id limit 1),
            d as (select vec_id, list_dot_product(embedding::double[], e::double[]) as d from embeddings, q where len(embedding) = len(e))
            select vec_id, round(d, 5) as similarity from d where d > 0.01 order by d desc, vec_id limit 20""",
    }
