"""Passages of evaluation texts inside a training corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.session import cut

_FORMAT = regex.compile(r"\p{Cf}+")
_WORD = re.compile(r"[^\W_]+")
_CHUNK = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
_PIECE = 1 << 20  # characters hashed at a time


def words(text: str) -> list[str]:
    """The longest runs of letters and digits after NFKC, removal of format characters and lower-casing."""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(texts: list[list[str]], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, a 64-bit hash of every n consecutive words) of the texts that have so many: the words are joined
    by blanks and hashed as one string, by differences of a running sum over many texts at a time."""
    long = [(k, w) for k, w in enumerate(texts) if len(w) >= n]
    group, size = [], 0
    for i, (k, w) in enumerate(long):
        joined = " ".join(w)
        group.append((k, w, joined))
        size += len(joined)
        if size < _PIECE and i + 1 < len(long):
            continue
        codes = np.frombuffer("".join(j for _, _, j in group).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        codes ^= codes >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(codes)))])
        back = _powers(pow(_BASE, -1, 1 << 64), len(codes) + 1)
        at = 0
        for k, w, joined in group:
            lengths = np.fromiter(map(len, w), np.int64, len(w))
            ends = at + np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            found = (sums[ends[n - 1 :]] - sums[starts[: len(w) - n + 1]]) * back[starts[: len(w) - n + 1]]
            found ^= found >> np.uint64(32)
            yield k, (found * np.uint64(0x94D049BB133111EB)).view(np.int64)
            at += len(joined)
        group, size = [], 0


def _char_spans(text: str) -> list[tuple[int, int]]:
    """Start and end in the raw text of the blank-delimited chunk of every word."""
    return [m.span() for m in _CHUNK.finditer(text) for _ in words(m.group())]


def leaked_spans(
    docs: DataFrame,
    items: DataFrame,
    n: int = 12,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_grams: int = 8_000_000,
    most_broadcast_mb: int = 64,
) -> DataFrame:
    """(item_id, doc_id, start, end): maximal raw character spans of a document that hold at least n consecutive
    words of an item, in order and without gap; one row for each item and span, doc_id order free.

    Null, empty and shorter items and null or empty documents give no rows; repeated items each give theirs.
    Spans end at blanks, so punctuation glued to a word goes with it. Extra columns are ignored.

    The items' n-grams are written once. Only the sorted array of their hashes is broadcast, 8 bytes each, so each
    document is scanned where it is read, without a shuffle; past most_grams distinct hashes the windows' hashes
    are joined instead, in the same single scan. Hits are verified by a join on the words themselves, which is a
    broadcast while the grams take at most most_broadcast_mb, and neighbouring hits of an item become one span.
    """
    spark = docs.sparkSession
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where("text is not null")
    item_type, doc_type = (x.schema[0].dataType.simpleString() for x in (tests, corpus))
    grams = tests.mapInArrow(_grams(n, tests.schema[0], None), f"item_id {item_type}, at int, start int, end int, hash long, gram string")
    grams = cut(grams.select("hash", "gram", "item_id").distinct(), "grams")
    size = grams.agg(F.count_distinct("hash").alias("n"), F.coalesce(F.sum(F.octet_length("gram") + 40), F.lit(0)).alias("bytes")).first()
    hashes = grams.select("hash").distinct()
    found = f"doc_id {doc_type}, at int, start int, end int, hash long, gram string"
    if size["n"] <= most_grams:
        known = spark.sparkContext.broadcast(np.sort(hashes.toArrow().column("hash").to_numpy()))
        hits = corpus.mapInArrow(_grams(n, corpus.schema[0], known), found)
    else:
        hits = corpus.mapInArrow(_grams(n, corpus.schema[0], None), found).join(hashes, "hash", "left_semi")
    if size["bytes"] <= most_broadcast_mb << 20:
        grams = F.broadcast(grams)
    leaks = hits.join(grams, ["hash", "gram"]).select("item_id", "doc_id", "at", "start", "end").distinct()
    run = F.col("at") - F.row_number().over(W.partitionBy("item_id", "doc_id").orderBy("at"))
    return leaks.withColumn("run", run).groupBy("item_id", "doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _grams(n: int, id_field, known):
    """(id, at, start, end, hash, gram) of the n-grams of each text: all of them, or those whose hash is in known."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(id_field.dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            cut_up = [words(t) for t in texts]
            rows: list[tuple] = []
            for k, found in gram_hashes(cut_up, n):
                if known is None:
                    hit = np.arange(len(found))
                else:
                    at = np.minimum(np.searchsorted(known.value, found), len(known.value) - 1)
                    hit = np.flatnonzero(known.value[at] == found) if len(known.value) else ()
                if len(hit):
                    own, spans = batch.column(0)[k].as_py(), _char_spans(texts[k])
                    rows += [(own, int(i), spans[i][0], spans[i + n - 1][1], int(found[i]), " ".join(cut_up[k][i : i + n])) for i in hit]
            types = (id_type, *[pa.int32()] * 3, pa.int64(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_field.name, "at", "start", "end", "hash", "gram"])

    return scan


def without_leaks(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_removed) of the documents with leaks, their spans taken out; overlapping spans count once."""
    cuts = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    leaky = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(cuts, "doc_id")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    left = F.aggregate(
        "cuts",
        start,
        lambda s, c: F.struct(
            F.concat(
                s["kept"],
                F.when(c["start"] > s["at"], F.col("text").substr(s["at"] + 1, c["start"] - s["at"])).otherwise(F.lit("")),
            ).alias("kept"),
            F.greatest(s["at"], c["end"]).alias("at"),
        ),
        lambda s: F.concat(s["kept"], F.col("text").substr(s["at"] + 1, F.length("text"))),
    )
    kept = leaky.select("doc_id", "text", left.alias("kept"))
    return kept.select("doc_id", F.col("kept").alias("text"), (F.length("text") - F.length("kept")).alias("n_removed"))
