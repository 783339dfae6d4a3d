"""Keyword search: queries, BM25 over title, content and tags, facets and recency."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import n_words, preview, recency_boosted, search_form

# BM25's parameters, and the weight of a term that is in half of the rows or more.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("title", "content", "tags")


@dataclass
class Query:
    """Groups of which one must match; a group matches if all its units do. A row with an excluded unit never
    matches. A unit is a word, a prefix ('tok*') or a phrase (words with blanks between)."""

    groups: list[list[str]]
    excluded: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Query:
        """From 'a b OR "c d" NOT e*': adjacent units belong together, OR separates groups, marks inside a word
        make it a phrase. Text without a word is an error."""
        query, negative = cls([[]]), False
        for quoted, word in re.findall(r'"([^"]*)"|(\S+)', text):
            if not quoted and word.upper() in ("AND", "NEAR"):
                continue
            if not quoted and word.upper() in ("OR", "NOT"):
                negative = word.upper() == "NOT"
                if not negative:
                    query.groups.append([])
                continue
            unit = " ".join(re.findall(r"[^\W_]+", quoted or word)) + ("*" if word.endswith("*") else "")
            if unit.strip("*"):
                (query.excluded if negative else query.groups[-1]).append(unit)
            negative = False
        query.groups = [g for g in query.groups if g]
        if not query.groups:
            raise ValueError("the query has no word")
        return query

    def units(self) -> list[str]:
        return list(dict.fromkeys(u for g in self.groups for u in g))


def _occurrences(unit: str) -> Column:
    """How often a unit occurs, over all fields; a phrase lies within one field."""
    words = search_form(F.lit(unit.removesuffix("*")))
    rest = "[^ ]*" if unit.endswith("*") else ""
    pattern = F.concat(F.lit("(?<= )"), F.trim(words), F.lit(f"{rest}(?= )"))
    return sum((F.regexp_count(F.col(f"_{f}"), pattern) for f in FIELDS[1:]), F.regexp_count(F.col(f"_{FIELDS[0]}"), pattern))


def bm25(docs: DataFrame, query: Query | str) -> DataFrame:
    """The rows of docs (id, title, content, tags, ...) that match, with score; higher is better.

    The corpus is scanned once for N, the mean length and the units' row counts (one row comes back), and once for
    the scores, without a shuffle of text. It needs no index; operators.index scores the same from stored postings.
    """
    query = Query.parse(query) if isinstance(query, str) else query
    units = query.units()
    # inline() keeps each search form and count a column that is computed once: a filter on plain columns would be
    # pushed below them and compute them again.
    once = lambda columns: F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    texts = {f"_{f}": search_form(F.array_join(f, " ") if f == "tags" else F.col(f)) for f in FIELDS}
    counts = {"_length": sum((n_words(F.col(f"_{f}")) for f in FIELDS[1:]), n_words(F.col("_title")))}
    counts |= {f"_tf{i}": _occurrences(u) for i, u in enumerate(units)}
    counts |= {f"_no{i}": _occurrences(u) for i, u in enumerate(query.excluded)}
    forms = docs.select("*", once(texts)).select(*docs.columns, once(counts))
    found = forms.agg(
        F.count("*").alias("n"), F.avg("_length").alias("mean"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"n{i}") for i in range(len(units)))
    ).first()
    matched, score = combined(query, [found[f"n{i}"] for i in range(len(units))], found["n"], float(found["mean"] or 1.0))
    for i in range(len(query.excluded)):
        matched = matched & (F.col(f"_no{i}") == 0)
    return forms.where(matched).withColumn("score", score).drop(*counts)


def combined(query: Query, rows: list[int], n_rows: int, mean: float) -> tuple[Column, Column]:
    """Whether a row matches a query without excluded units, and its score, from columns _length and _tf0, _tf1, ...
    of its units; rows has in how many rows each unit is.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; each unit counts if its group matched.
    """
    one = {}
    for i, (unit, n) in enumerate(zip(query.units(), rows, strict=True)):
        idf = max(math.log((n_rows - n + 0.5) / (n + 0.5)), LEAST_IDF)
        tf = F.col(f"_tf{i}")
        norm = K1 * (1 - B + B * F.col("_length") / F.lit(mean))
        one[unit] = (tf > 0, F.lit(idf) * tf * (K1 + 1) / (tf + norm))
    score, matched = F.lit(0.0), F.lit(False)
    for group in query.groups:
        hit = one[group[0]][0]
        for unit in group[1:]:
            hit = hit & one[unit][0]
        score = score + F.when(hit, sum((one[u][1] for u in group[1:]), one[group[0]][1])).otherwise(0.0)
        matched = matched | hit
    return matched, score


@dataclass
class Facets:
    type: str | None = None
    category: str | None = None
    tags: tuple[str, ...] = ()
    after: str | None = None
    before: str | None = None
    branch: str | None = None
    project: str | None = None

    def where(self, docs: DataFrame) -> DataFrame:
        """Equality on type, category and project; each tag as a part of the joined tags and the branch as a part
        of the branch, both without regard to case; days inclusive."""
        for name in ("type", "category", "project"):
            if getattr(self, name):
                docs = docs.where(F.col(name) == getattr(self, name))
        for tag in self.tags:
            docs = docs.where(F.array_join("tags", " ").ilike(f"%{tag}%"))
        if self.branch:
            docs = docs.where(F.col("branch").ilike(f"%{self.branch}%"))
        if self.after:
            docs = docs.where(F.col("date") >= self.after)
        if self.before:
            docs = docs.where(F.col("date") <= self.before)
        return docs


def _hits(source, query: Query | str, facets: Facets) -> DataFrame:
    """Scored rows of a corpus (a DataFrame, scanned) or of a SearchIndex that pass the facets; without texts in the
    latter case."""
    if isinstance(source, DataFrame):
        return facets.where(bm25(source, query))
    return facets.where(source.rows.drop("generation", "gone", "length")).join(source.bm25(query), "id")


def _with_texts(source, hits: DataFrame, *added: str) -> DataFrame:
    """A bounded number of hits with the columns of the corpus."""
    if isinstance(source, DataFrame) or source.docs is None:
        return hits
    return source.docs.join(F.broadcast(hits.select("id", *added)), "id")


def search(source, query: Query | str, facets: Facets | None = None, as_of: datetime | None = None, limit: int = 20, sort: str = "relevance") -> DataFrame:
    """The best rows of a corpus or a SearchIndex: the max(2 * limit, 50) best by BM25 among those that pass the
    facets, their scores raised for recent rows (given as_of), ordered anew by score or by created, and cut to limit.
    Ties go by id. Texts are fetched for these rows only."""
    if sort not in ("relevance", "date"):
        raise ValueError(f"no such order: {sort!r}")
    hits = _hits(source, query, facets or Facets()).orderBy(F.desc("score"), "id").limit(max(2 * limit, 50))
    if as_of is not None:
        hits = hits.withColumn("score", recency_boosted(F.col("score"), F.col("created"), F.lit(as_of)))
    order = F.desc_nulls_last("created") if sort == "date" else F.desc("score")
    best = _with_texts(source, hits.orderBy(order, "id").limit(limit), "score")
    return (best.withColumn("preview", preview(F.col("content"))) if "content" in best.columns else best).orderBy(order, "id")


def note_search(source, query: Query | str, category: str | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """The 50 best notes, of which those that carry every tag stay (equality without regard to case)."""
    hits = _hits(source, query, Facets(type="note", category=category)).orderBy(F.desc("score"), "id").limit(50)
    wanted = F.array(*[F.lit(t.lower()) for t in tags]).cast("array<string>")
    tagged = hits.where(F.size(F.array_except(wanted, F.transform(F.coalesce("tags", F.array()), lambda t: F.lower(t)))) == 0)
    return _with_texts(source, tagged, "score").orderBy(F.desc("score"), "id")


def session_search(source, query: Query | str, branch: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    facets = Facets(type="session", branch=branch, after=after, before=before)
    hits = _hits(source, query, facets).orderBy(F.desc("score"), "id").limit(50)
    return _with_texts(source, hits, "score").orderBy(F.desc("score"), "id")
