"""Queries of the problems tagged llm, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.keys import norm_id
from lorekeep.llm.cooccurrence import PairCounts
from lorekeep.llm.leakage import leaked_spans, without_leaks
from lorekeep.llm.neighbours import VectorIndex
from lorekeep.llm.sanitise import Sanitiser, record_texts
from lorekeep.llm.spans import SharedSpans
from lorekeep.llm.tokens import encode_corpus
from lorekeep.sources.tables import table


LEAST_COSINE = 0.95


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = VectorIndex(table(spark, folder, "vectors")).document_pairs(LEAST_COSINE)
    return pairs.select("backend", "model", "doc_a", "doc_b")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of its vector and to how many other classes there is a link."""
    return VectorIndex(table(spark, folder, "vectors")).linked_classes(LEAST_COSINE)


def p1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar documents of each document of the query set (ids divisible by 50), copies included."""
    return VectorIndex(table(spark, folder, "vectors")).nearest_documents(10).withColumn("cosine", F.round("cosine", 4))


def _sanitiser(spark: SparkSession, folder: str) -> Sanitiser:
    texts = record_texts(table(spark, folder, "notes"), table(spark, folder, "sessions"))
    return Sanitiser(texts, table(spark, folder, "pii_labels"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sanitiser(spark, folder).found().select("source", "id", "field", "kind", "nth").distinct()


def p3_replaced(spark: SparkSession, folder: str) -> DataFrame:
    return _sanitiser(spark, folder).replaced().distinct()


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Notes and sessions as records; the source keeps an id of one apart from the same id of the other."""
    return table(spark, folder, "notes").select(_record("notes"), "tags").unionByName(
        table(spark, folder, "sessions").select(_record("sessions"), "tags")
    )


def _record(source: str):
    key = norm_id(F.col("id"))
    return F.when(key.isNotNull(), F.concat(F.lit(source + ":"), key)).alias("record")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = PairCounts(_tagged(spark, folder), "record", "tags", min_count=5).against_chance()
    often = pairs.where(F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b"))
    return often.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The exact counts behind p4_pairs, without the null model."""
    return PairCounts(_tagged(spark, folder), "record", "tags").counts().select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", "n"
    )


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = PairCounts(_tagged(spark, folder), "record", "tags").surprising()
    return pairs.select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", "n", "lift", "expected", "p_value", "surprising"
    )


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return spans.select("item_id", "doc_id").distinct()


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return without_leaks(docs, leaked_spans(docs, table(spark, folder, "eval_items")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents")).record_pairs()


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents")).shares()


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by passage that is in many of them, without pairs."""
    return SharedSpans(table(spark, folder, "documents")).passages()


def queries():
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p1_nearest": p1_nearest, "p3_found": p3_found, "p3_replaced": p3_replaced, "p4_found": p4_found, "p4_counts": p4_counts, "p4_pairs": p4_pairs, "p6_ids": p6_ids, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found, "p8_shares": p8_shares, "p8_passages": p8_passages}


def oracle_sql() -> dict[str, str]:
    key = lambda c: rf"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"
    tagged = f"""tagged as (
              select distinct source, {key('id')} as id, {key('tag')} as tag
              from (select 'notes' as source, id, unnest(tags) as tag from notes union all select 'sessions', id, unnest(tags) from sessions)),
            t as (select * from tagged where id is not null and tag is not null),
            n as (select count(distinct (source, id)) as n from t),
            per as (select tag, count(*) as c from t group by tag),
            pairs as (select a.tag as tag_a, b.tag as tag_b, count(*) as n_ab
              from t a join t b on a.source = b.source and a.id = b.id and a.tag < b.tag group by all)"""
    windows = """w as (select doc_id, i, hash(substr(text, i, 240)) as h, hash('x' || substr(text, i, 240)) as g
              from (select doc_id, text, unnest(range(1, length(text) - 238)) as i from documents where length(text) >= 240))"""
    usable = f"""latest as (
              select {key('doc_id')} as doc_id, backend, model, dim, vector, created_at from vectors where {key('doc_id')} is not null
              qualify row_number() over (partition by {key('doc_id')}, backend, model order by created_at desc) = 1),
            usable as (select * from latest where len(vector) = dim and dim > 0
              and not list_bool_or([x is null or isnan(x) for x in vector]) and list_bool_or([x <> 0 for x in vector]))"""
    return {
        "p1_classes": f"""with {usable}, classes as (select backend, model, vector, min(doc_id) as class_id from usable group by all),
            links as (select a.class_id, a.backend, a.model, count(*) as n from classes a join classes b
              on a.backend = b.backend and a.model = b.model and len(a.vector) = len(b.vector) and a.class_id <> b.class_id
              where list_cosine_similarity(a.vector, b.vector) >= {LEAST_COSINE} group by all)
            select u.backend, u.model, doc_id, class_id, coalesce(links.n, 0) as n_links
            from usable u join classes using (backend, model, vector) left join links using (backend, model, class_id)""",
        "p1_found": f"""with {usable} select a.backend, a.model, a.doc_id as doc_a, b.doc_id as doc_b
            from usable a join usable b on a.backend = b.backend and a.model = b.model and a.dim = b.dim and a.doc_id < b.doc_id
            where list_cosine_similarity(a.vector, b.vector) >= {LEAST_COSINE}""",
        "p4_counts": f"""with {tagged} select tag_a, tag_b, n_ab, pa.c as n_a, pb.c as n_b, n.n as n from pairs, n, per pa, per pb
            where pa.tag = tag_a and pb.tag = tag_b""",
        "p4_found": f"""with {tagged} select tag_a, tag_b from pairs, n, per pa, per pb
            where pa.tag = tag_a and pb.tag = tag_b and n_ab >= 5 and n_ab * n.n >= 3 * pa.c * pb.c""",
        "p8_shares": f"""with {windows}, shared as (select h, g from w group by h, g having count(distinct doc_id) > 1),
            x as (select doc_id, i - lag(i) over (partition by doc_id order by i) as gap from w semi join shared using (h, g)),
            y as (select doc_id, sum(least(240, coalesce(gap, 240)))::bigint as n_shared from x group by doc_id)
            select doc_id, length(text) as n_chars, n_shared, n_shared / length(text) as share from y join documents using (doc_id)""",
        "p8_found": f"""with {windows}
            select distinct a.doc_id as doc_a, b.doc_id as doc_b from w a join w b on a.h = b.h and a.g = b.g and a.doc_id < b.doc_id""",
    }
