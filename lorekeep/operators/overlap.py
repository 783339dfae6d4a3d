"""Sets of words that overlap: pairs and their numbers, found in bounded cells and never as candidates on disk."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RANKED = 50_000
_ROWS, _COLUMNS, _PAIRS = 512, 4096, 50_000
_FOUND = "names array<string>, categories array<string>, a array<int>, b array<int>, overlap array<double>"


def _encoded(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all items, what they stand for, and where each list starts."""
    flat = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy().astype(np.int64)
    return flat.indices.to_numpy().astype(np.int64), flat.dictionary, starts - starts[0]


def _needed(n: int, least: float) -> int:
    return max(1, math.ceil(n * least - 1e-9))


def _placed(uses, whole: bool, least: float, most_in_cell: int):
    """Words from rare to frequent, and the cells of a set: for each word its place, a salt where the word has more than
    `most_in_cell` sets, and whether the set is asked about there, as one of the smaller side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = uses.value
        for batch in batches:
            if not len(batch):
                continue
            codes, dictionary, starts = _encoded(batch.column("words"))
            size = np.diff(starts)
            row = np.repeat(np.arange(len(batch)), size)
            category = batch.column("category").dictionary_encode()
            each, at = np.unique(category.indices.to_numpy().astype(np.int64)[row] * len(dictionary) + codes, return_inverse=True)
            named, words = category.dictionary.to_pylist(), dictionary.to_pylist()
            often = np.array([known.get(named[c], {}).get(words[w], 0) for c, w in zip(*np.divmod(each, max(1, len(words))))], np.int64)[at]
            rank = np.empty(len(words), np.int64)
            rank[pc.sort_indices(dictionary).to_numpy()] = np.arange(len(words))
            order = np.lexsort((rank[codes], often, row))
            codes, often, place = codes[order], often[order], np.arange(len(row)) - starts[row]
            first = np.array([n - _needed(n, least) + 1 for n in range(size.max() + 1)])[size]
            salts = np.maximum(1, -(-often // most_in_cell))
            chance = np.zeros(len(batch), np.int64)
            if salts.max(initial=1) > 1:
                chance = np.array([zlib.crc32(key.encode()) for key in batch.column("key").to_pylist()])
            n = np.where((often > 0) | (not whole), salts, 0)  # a word that is known to have one set only meets no other
            item = np.repeat(np.arange(len(row)), n)
            salt = np.arange(len(item)) - (np.cumsum(n) - n)[item]
            leads = (place < first[row])[item] & (chance[row[item]] % salts[item] == salt)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[item], minlength=len(batch)))])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((salt << 21 | place[item]) << 1 | leads))
            ordered = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), dictionary.take(pa.array(codes)))
            yield pa.RecordBatch.from_arrays([batch.column("category"), batch.column("key"), ordered, batch.column("flags"), cells], ["category", "key", "words", "flags", "cells"])

    return run


class _Cells:
    """The sets of one partition, sorted by the word they meet at and by key."""

    def __init__(self, table: pa.Table, least: float) -> None:
        cell = table["cell"].to_numpy()
        codes, dictionary, starts = _encoded(table["words"].combine_chunks())
        n_codes = len(dictionary)
        place, salt = (cell >> 1) & ((1 << 21) - 1), cell >> 22
        category = table["category"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        rank = np.empty(len(cell), np.int64)
        rank[pc.sort_indices(table["key"]).to_numpy()] = np.arange(len(cell))
        meet = (category * n_codes + codes[starts[:-1] + place]) * (salt.max() + 1) + salt
        meet = np.unique(meet, return_inverse=True)[1]
        several = (np.bincount(meet) > 1)[meet]
        self.entry = np.flatnonzero(several)[np.lexsort((rank[several], meet[several]))]
        self.names, self.categories = table["key"].combine_chunks(), table["category"].combine_chunks()
        self.meet, self.place, self.leads = meet[self.entry], place[self.entry], (cell & 1)[self.entry].astype(bool)
        self.flags = table["flags"].to_numpy()[self.entry]
        self.size = (starts[1:] - starts[:-1])[self.entry]
        self.least = np.array([_needed(n, least) for n in range(self.size.max(initial=0) + 1)])[self.size]
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        at = np.repeat(starts[self.entry] - self.ends[:-1], self.size) + np.arange(self.ends[-1])
        # a word counts at each meeting by itself
        self.code = np.unique(np.repeat(self.meet, self.size) * n_codes + codes[at], return_inverse=True)[1]
        self.slot = np.full(self.code.max(initial=0) + 1, -1)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that ask and rows that are asked: whole meetings together while they are small, parts of large ones."""
        bounds = np.flatnonzero(np.diff(self.meet, prepend=-1, append=-1)) if len(self.meet) else np.array([0])
        start = 0
        for begin, end in zip(bounds[:-1], bounds[1:]):
            if end - start > _ROWS and begin > start:
                yield np.arange(start, begin), np.arange(start, begin)
                start = begin
            if end - start > _ROWS:
                yield np.arange(start, end), np.arange(start, end)
                start = end
        if start < bounds[-1]:
            yield np.arange(start, bounds[-1]), np.arange(start, bounds[-1])

    def asked(self, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows, columns in self.blocks():
            rows = rows[self.leads[rows]]
            for flags in np.unique(self.flags[rows]):
                mine, theirs = rows[self.flags[rows] == flags], columns[(self.flags[columns] | flags) & need == need]
                for i in range(0, len(mine), _ROWS):
                    for j in range(0, len(theirs), _COLUMNS):
                        yield mine[i : i + _ROWS], theirs[j : j + _COLUMNS]

    def _words(self, rows: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row's number and the code of n words of each row from its begin."""
        total = np.cumsum(n) - n
        return np.repeat(np.arange(len(rows)), n), self.code[np.repeat(self.ends[rows] + begin - total, n) + np.arange(n.sum())]

    def pairs(self, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(small, large, shared): a pair comes out where the first of its shared words meets, hence once."""
        for rows, columns in self.asked(need):
            lone = self.least[rows] == 1  # one shared word is enough: the word they meet at
            begin = self.place[rows] + ~lone
            after, lower = self._words(rows, begin, self.size[rows] - begin), self._words(rows, 0 * begin, self.place[rows])
            known = np.unique(np.concatenate([after[1], lower[1]]))
            self.slot[known] = np.arange(len(known))
            holds = np.zeros((len(known) + 1, len(columns)), np.uint8)
            at, code = self._words(columns, 0 * columns, self.size[columns])
            code = self.slot[code]
            holds[code[code >= 0], at[code >= 0]] = 1
            count = lambda words: self._count(holds, len(rows), words[0], self.slot[words[1]])
            shared = count(after)
            good = shared >= (self.least[rows] - ~lone)[:, None].astype(shared.dtype)
            if len(lower[0]):
                good &= count(lower) == 0
            self.slot[known] = -1
            i, j = np.divmod(np.flatnonzero(good), len(columns))
            small, large = rows[i], columns[j]
            keep = (self.size[small] < self.size[large]) | (self.size[small] == self.size[large]) & (small < large)
            i, j = i[keep], j[keep]
            yield small[keep], large[keep], shared[i, j] + ~lone[i]

    @staticmethod
    def _count(holds: np.ndarray, n: int, at: np.ndarray, slots: np.ndarray) -> np.ndarray:
        lengths = np.bincount(at, minlength=n)
        padded = np.full((n, lengths.max(initial=0)), len(holds) - 1)
        padded[at, np.arange(len(at)) - (np.cumsum(lengths) - lengths)[at]] = slots
        out = np.zeros((n, holds.shape[1]), np.uint8 if padded.shape[1] < 250 else np.uint32)
        for j in range(padded.shape[1]):
            out += holds[padded[:, j]]
        return out


def _listed(least: float, need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        cells = _Cells(pa.Table.from_batches(held), least)
        for small, large, shared in cells.pairs(need):
            for i in range(0, len(small), _PAIRS):
                s, l = small[i : i + _PAIRS], large[i : i + _PAIRS]
                own, at = np.unique(np.concatenate([s, l]), return_inverse=True)
                at_s, at_l = at[: len(s)], at[len(s) :]
                arrays = [cells.names.take(pa.array(cells.entry[own])), cells.categories.take(pa.array(cells.entry[own]))]
                # rows are sorted by key inside a meeting
                arrays += [pa.array(x.astype(np.int32)) for x in (np.minimum(at_s, at_l), np.maximum(at_s, at_l))]
                arrays.append(pa.array(shared[i : i + _PAIRS] / cells.size[s]))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays]
                yield pa.RecordBatch.from_arrays(lists, ["names", "categories", "a", "b", "overlap"])

    return run


def _counted(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        cells = _Cells(pa.Table.from_batches(held), least)
        n = np.zeros(len(cells.entry), np.int64)
        for small, large, _ in cells.pairs(0):
            n += np.bincount(small, minlength=len(n)) + np.bincount(large, minlength=len(n))
        names = cells.names.take(pa.array(cells.entry[n > 0]))
        yield pa.RecordBatch.from_arrays([names, pa.array(n[n > 0])], ["key", "n"])

    return run


def _met(sets: DataFrame, least: float, most_ranked: int, most_in_cell: int, most_in_task: int) -> DataFrame:
    """The sets once for each of their words and salts, all of one word in one partition."""
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.size("words"))).first()[0] or 0
    uses = sets.select("category", F.explode("words").alias("word")).groupBy("category", "word").agg(F.count("*").alias("n")).where("n > 1")
    top = uses.orderBy(F.desc("n"), "category", "word").limit(most_ranked + 1).toArrow().to_pylist()
    known: dict[str, dict[str, int]] = {}
    for r in top[:most_ranked]:
        known.setdefault(r["category"], {})[r["word"]] = r["n"]
    placed = sets.select("category", "key", "words", "flags").mapInArrow(
        _placed(spark.sparkContext.broadcast(known), len(top) <= most_ranked, least, most_in_cell),
        "category string, key string, words array<string>, flags int, cells array<long>",
    )
    rows = placed.select("category", "key", "words", "flags", F.explode("cells").alias("cell"))
    place = F.shiftright("cell", 1).bitwiseAND((1 << 21) - 1).cast("int")
    return rows.repartition(max(1, -(-total // most_in_task)), F.xxhash64("category", F.col("words")[place], F.shiftright("cell", 22)))


def overlapping(sets: DataFrame, least: float, need: int = 0, most_ranked: int = MOST_RANKED, most_in_cell: int = 20_000, most_in_task: int = 50_000) -> DataFrame:
    """(category, class_a, class_b, overlap) of sets (category, key, words, flags) whose shared words are at least
    `least` of the smaller set, and whose flags together hold all bits of `need`. No key, category or word is null,
    keys are unique and words are distinct in a set. The smaller key is class_a.

    Prefix filter: of its n words, from rare to frequent, the smaller set must share one among the first
    n - ceil(least * n) + 1, or it misses too many. Sets meet at their words, once each, which is the only shuffle; a
    pair is counted and decided where the first of its shared words meets, so candidates never leave a task and none
    comes twice. Uses are known of the `most_ranked` most used words; they only put words in order. A word of more
    than `most_in_cell` sets is spread over several tasks, each with all its sets and a part of those that ask.
    """
    found = _met(sets, least, most_ranked, most_in_cell, most_in_task).mapInArrow(_listed(least, need), _FOUND)
    each = found.select("names", "categories", "b", "overlap", F.posexplode("a").alias("i", "at"))
    i, at = F.col("i"), F.col("at")
    return each.select(F.col("categories")[at].alias("category"), F.col("names")[at].alias("class_a"), F.col("names")[F.col("b")[i]].alias("class_b"), F.col("overlap")[i].alias("overlap"))


def overlap_counts(sets: DataFrame, least: float, most_ranked: int = MOST_RANKED, most_in_cell: int = 20_000, most_in_task: int = 50_000) -> DataFrame:
    """(key, n): for each set that has any, the number of sets that it overlaps with, as in `overlapping`; pairs are
    counted where they are found."""
    found = _met(sets, least, most_ranked, most_in_cell, most_in_task).mapInArrow(_counted(least), "key string, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def best_of(standing, least: float):
    """Batches of (category, key, title, words) with target: the key of the standing set, a broadcast table of the same
    columns, that comes before and has the title or else overlaps most, by at least `least`; the first of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = standing.value
        table = table.take(pc.sort_indices(table, [("category", "ascending"), ("key", "ascending")])).combine_chunks()
        keys = np.array(table["key"].to_pylist(), object)
        titled, spans, held = {}, {}, {}
        for at, (category, title, words) in enumerate(zip(*(table[c].to_pylist() for c in ("category", "title", "words")))):
            titled.setdefault((category, title), at)
            spans[category] = (spans.get(category, (at,))[0], at + 1)
            for word in words:
                held.setdefault((category, word), []).append(at)
        held = {word: np.array(at) for word, at in held.items()}
        sizes = np.array([len(x) for x in table["words"].to_pylist()])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("category", "key", "title", "words")]
            targets = []
            for category, key, title, words in zip(*columns):
                at = titled.get((category, title))
                if at is not None and keys[at] < key:
                    targets.append(keys[at])
                    continue
                targets.append(None)
                found = [x for w in words if (x := held.get((category, w))) is not None]
                if not found:
                    continue
                begin, end = spans[category]
                places = np.concatenate(found)
                if 8 * len(places) < end - begin:
                    at, n = np.unique(places, return_counts=True)
                else:
                    n = np.bincount(places - begin, minlength=end - begin)
                    at = np.flatnonzero(n)
                    at, n = at + begin, n[at]
                before = np.searchsorted(keys[begin:end], key) + begin
                overlap = n / np.minimum(sizes[at], len(words))
                overlap[(overlap < least) | (at >= before)] = 0
                if len(overlap) and overlap[best := overlap.argmax()] > 0:
                    targets[-1] = keys[at[best]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("category", "key", "title", "words")), pa.array(targets, pa.string())], ["category", "key", "title", "words", "target"])

    return run
