"""The stored indexes of a corpus: postings for keyword search and term weights for similarity.

Both are sorted by term, so a search reads the row groups of its own terms only and never meets a text. Changed rows
are appended with a higher generation; of a row only the postings of its latest generation count, until a rebuild.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import n_words, search_form
from lorekeep.operators import weights
from lorekeep.operators.keyword import FIELDS, Query, combined

META = ("type", "category", "title", "tags", "created", "updated", "date", "branch", "project", "session_id")


def formed(docs: DataFrame) -> DataFrame:
    """docs as rows_of and postings_of need them: the search forms of the fields and the length in words beside what
    else is known of a row. Cut it where both are taken, so that texts are folded once."""
    if f"form_{FIELDS[0]}" in docs.columns:
        return docs
    forms = docs.select("id", *(c for c in META if c in docs.columns), *(_form(f).alias(f"form_{f}") for f in FIELDS))
    return forms.withColumn("length", sum((n_words(F.col(f"form_{f}")) for f in FIELDS[1:]), n_words(F.col(f"form_{FIELDS[0]}"))).cast("long"))


def _form(field: str) -> Column:
    return search_form(F.array_join(field, " ") if field == "tags" else F.col(field))


def rows_of(docs: DataFrame, generation: int = 0) -> DataFrame:
    """(id, generation, gone, length, ...): what is known of each row besides its text; length is in words."""
    known = [c for c in META if c in docs.columns]
    return formed(docs).select("id", F.lit(generation).alias("generation"), F.lit(False).alias("gone"), "length", *known)


def postings_of(docs: DataFrame, generation: int = 0) -> DataFrame:
    """(term, id, generation, field, length, tf, positions), range-partitioned and sorted by term: one exchange of the
    words serves the grouping and the order. length is that of the whole row in words."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(f"form_{f}").alias("text")) for f in FIELDS]))
    words = formed(docs).select("id", "length", fields.alias("f")).where("f.text <> ''")
    words = words.select("id", "length", "f.field", F.posexplode(F.split("f.text", " ")).alias("at", "term"))
    grouped = words.repartitionByRange("term", "id").groupBy("term", "id", "field").agg(
        F.first("length").alias("length"), F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions")
    )
    return grouped.select("term", "id", F.lit(generation).alias("generation"), "field", "length", "tf", "positions").sortWithinPartitions("term", "id")


def live_rows(rows: DataFrame) -> DataFrame:
    """The latest generation of each row, unless it is gone."""
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "generation").alias("r"))
    return last.select("id", "r.*").where("not gone")


@dataclass
class SearchIndex:
    """Scores rows by BM25 from stored postings. docs, if given, has the rows' texts; it is read for the few hits of
    a search only. changed tells that rows were appended since the index was built."""

    postings: DataFrame
    rows: DataFrame
    docs: DataFrame | None = None
    changed: bool = False

    def __post_init__(self) -> None:
        if self.changed:
            self.rows = live_rows(self.rows)
            self.postings = self.postings.join(self.rows.select("id", "generation"), ["id", "generation"], "left_semi")
        found = self.rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        self.n_rows, self.mean = found["n"], float(found["mean"] or 1.0)

    def occurrences(self, unit: str) -> DataFrame:
        """(id, length, tf): how often a word, a prefix or a phrase occurs in each row; a phrase lies in one field. The
        filters on term are pushed to the scan."""
        words, prefix = unit.removesuffix("*").split(), unit.endswith("*")
        folded = [F.trim(search_form(F.lit(w))) for w in words]
        is_word = [F.startswith("term", w) if prefix and i == len(words) - 1 else F.col("term") == w for i, w in enumerate(folded)]
        if len(words) == 1:
            return self.postings.where(is_word[0]).groupBy("id").agg(F.max("length").alias("length"), F.sum("tf").alias("tf"))
        wanted = is_word[0]
        for w in is_word[1:]:
            wanted = wanted | w
        places = [F.flatten(F.collect_list(F.when(w, F.col("positions")))).alias(f"p{i}") for i, w in enumerate(is_word)]
        fields = self.postings.where(wanted).groupBy("id", "field").agg(F.max("length").alias("length"), *places)
        follows = lambda p: F.forall(F.array(*[F.array_contains(f"p{i}", p + i) for i in range(1, len(words))]), lambda x: x)
        counted = fields.where(F.size("p0") > 0).select("id", "length", F.size(F.filter("p0", follows)).cast("long").alias("tf"))
        return counted.groupBy("id").agg(F.max("length").alias("length"), F.sum("tf").alias("tf")).where("tf > 0")

    def bm25(self, query: Query | str) -> DataFrame:
        """(id, score) of the rows that match, as keyword.bm25 scores them."""
        query = Query.parse(query) if isinstance(query, str) else query
        units = query.units()
        every = None
        for i, unit in enumerate(units):
            part = self.occurrences(unit).select("id", "length", F.lit(i).alias("unit"), "tf")
            every = part if every is None else every.unionByName(part)
        tf = [F.sum(F.when(F.col("unit") == i, F.col("tf")).otherwise(0)).alias(f"_tf{i}") for i in range(len(units))]
        counted = every.groupBy("id").agg(F.max("length").alias("_length"), *tf)
        n = counted.agg(*(F.count_if(F.col(f"_tf{i}") > 0).alias(f"n{i}") for i in range(len(units)))).first()
        matched, score = combined(query, [n[f"n{i}"] for i in range(len(units))], self.n_rows, self.mean)
        hits = counted.where(matched).select("id", score.alias("score"))
        for unit in query.excluded:
            hits = hits.join(self.occurrences(unit).select("id"), "id", "left_anti")
        return hits


@dataclass
class WeightIndex:
    """Similarity by TF-IDF from stored weights (term, id, w) and the vocabulary (term, df) of the n_docs rows they
    were built from. Rows added later get weights by that vocabulary."""

    weights: DataFrame
    vocabulary: DataFrame
    n_docs: int

    @staticmethod
    def vocabulary_of(counts: DataFrame, n_docs: int) -> DataFrame:
        return weights.vocabulary(weights.document_frequency(counts), n_docs)

    @staticmethod
    def weights_of(counts: DataFrame, vocabulary: DataFrame, n_docs: int) -> DataFrame:
        """The weights of rows from their term counts, sorted by term; a row that has none of the terms has no weights."""
        return weights.weighted(counts, vocabulary, n_docs).repartitionByRange("term", "id").sortWithinPartitions("term", "id")

    def query_weights(self, text: str) -> dict[str, float]:
        """The weights of a text's terms; they number as many as it has words."""
        asked = self.vocabulary.sparkSession.createDataFrame([("query", text)], "id string, text string")
        counts = weights.term_counts(asked, "id", F.col("text")).collect()
        known = self.vocabulary.where(F.col("term").isin([r["term"] for r in counts]))
        return {r["term"]: r["w"] for r in weights.weighted(asked.sparkSession.createDataFrame(counts, "id string, term string, tf long"), known, self.n_docs).collect()} if counts else {}

    def similar(self, text: str) -> DataFrame:
        """(id, similarity) of the rows that share a term with the text, above 0.01; only its terms are read."""
        q = self.query_weights(text)
        asked = F.lit(0.0)
        for term, w in q.items():
            asked = F.when(F.col("term") == term, w).otherwise(asked)
        dots = self.weights.where(F.col("term").isin(list(q))).groupBy("id").agg(F.sum(F.col("w") * asked).alias("similarity"))
        return dots.where(F.col("similarity") > weights.LEAST_COSINE)
