"""Items that appear together more often than chance.

Pair counts are exact. Chance is the bipartite configuration model: the maximum-entropy random incidence of
records and items in which every record keeps its expected size and every item its expected frequency. There an
item of weight y is in a record of weight x with probability x * y / (1 + x * y), and the number of records that
hold two items is a sum of independent, unequal coin flips (Poisson-binomial), whose upper tail is the p-value.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.keys import BLANKS
from lorekeep.session import cut


def norm_item(c: Column) -> Column:
    """Trimmed, in lower case; blank and null items are null."""
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def bins(values: np.ndarray, counts: np.ndarray, exact: int, per_octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each value, mean of each bin, count of each bin): values up to `exact` have their own bin, beyond it
    there are `per_octave` to each doubling, so their number grows with the logarithm of the largest value only.
    Totals are kept, and a value differs from its bin's mean by a factor of at most 2 ** (1 / per_octave)."""
    step = np.where(values <= exact, values, exact + 1 + np.floor(per_octave * np.log2(np.maximum(values, 1) / exact)))
    _, which = np.unique(step, return_inverse=True)
    n = np.bincount(which, counts)
    return which, np.bincount(which, counts * values) / n, n


_INTERIOR = 1e-7


def fit_null(sizes: np.ndarray, n_records: np.ndarray, frequencies: np.ndarray, n_items: np.ndarray, rounds: int = 200):
    """Weights x of record sizes and y of item frequencies such that all expectations hold.

    They are the maximum of a concave likelihood, found by Newton's method with step halving; without convergence it
    is an error. Margins that only a full row or column can meet would need infinite weights, so all are moved by one
    part in ten million towards an even distribution.
    """
    total, most = (sizes * n_records).sum(), n_records.sum() * n_items.sum()
    density = min(total / most, 0.5)
    s = (1 - _INTERIOR) * sizes + _INTERIOR * density * n_items.sum()
    f = (1 - _INTERIOR) * frequencies + _INTERIOR * density * n_records.sum()
    a, b = np.log(s) - np.log(total) / 2, np.log(f) - np.log(total) / 2

    def loss(a: np.ndarray, b: np.ndarray) -> float:
        return n_records @ np.logaddexp(0, a[:, None] + b) @ n_items - (n_records * s) @ a - (n_items * f) @ b

    now = loss(a, b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a[:, None] + b)))
        in_rows, in_columns = p @ n_items, n_records @ p
        if max(np.abs(in_rows / s - 1).max(), np.abs(in_columns / f - 1).max()) < 1e-9:
            return np.exp(a), np.exp(b)
        w = n_records[:, None] * (p * (1 - p)) * n_items
        row, column = w.sum(1) * (1 + 1e-12) + 1e-300, w.sum(0) * (1 + 1e-12) + 1e-300
        ga, gb = n_records * (in_rows - s), n_items * (in_columns - f)
        schur = np.diag(column) - w.T @ (w / row[:, None])
        db = -np.linalg.lstsq(schur, gb - w.T @ (ga / row), rcond=1e-13)[0]
        da = -(ga + w @ db) / row
        step = min(1.0, 5 / max(np.abs(da).max(), np.abs(db).max(), 1e-9))
        while step > 1e-6 and (new := loss(a + step * da, b + step * db)) > now + 1e-12 * abs(now):
            step /= 2
        a, b, now = a + step * da, b + step * db, new
    raise RuntimeError("the null model did not converge")


_normal_tail = np.vectorize(lambda z: 0.5 * erfc(z / np.sqrt(2)), otypes=[float])


def upper_tail(n: np.ndarray, trials: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """P(V >= n) for V the sum of trials[k] coins of chance chances[:, k], by the lattice saddle-point formula.

    Close to the mean, where the formula is singular, a normal tail with continuity correction takes over.
    """
    mean = chances @ trials
    variance = np.maximum((chances * (1 - chances)) @ trials, 1e-300)
    most = (chances > 0) @ trials
    s = np.where(n > 0, np.log(np.maximum(n, 0.5) / np.maximum(mean, 1e-300)), 0.0)
    inner = (n > 0) & (n < most)
    for _ in range(60):
        tilted = chances * np.exp(s)[:, None] / (1 + chances * np.expm1(s)[:, None])
        slope = np.maximum((tilted * (1 - tilted)) @ trials, 1e-300)
        step = np.clip((tilted @ trials - n) / slope, -1, 1)
        s = np.where(inner, s - step, s)
        if np.abs(step[inner]).max(initial=0) < 1e-10:
            break
    tilted = chances * np.exp(s)[:, None] / (1 + chances * np.expm1(s)[:, None])
    cumulant = np.log1p(chances * np.expm1(s)[:, None]) @ trials
    w = np.sign(s) * np.sqrt(np.maximum(2 * (s * n - cumulant), 0))
    u = -np.expm1(-s) * np.sqrt(np.maximum((tilted * (1 - tilted)) @ trials, 1e-300))
    with np.errstate(all="ignore"):
        saddle = _normal_tail(w) + np.exp(-w * w / 2) / np.sqrt(2 * np.pi) * (1 / u - 1 / w)
        every = np.exp(np.where(chances > 0, np.log(np.where(chances > 0, chances, 1)), 0) @ trials)
    flat = _normal_tail((n - 0.5 - mean) / np.sqrt(variance))
    out = np.where(np.abs(w) < 1e-3, flat, saddle)
    out = np.where(n <= 0, 1.0, np.where(n > most, 0.0, np.where(n == most, every, out)))
    return np.clip(out, 0.0, 1.0)


class PairCounts:
    """Exact co-occurrence of items in records, with the null model fitted to the same records.

    records has a record id and an array of items. Items are trimmed and in lower case; null and blank ones are
    dropped and an item counts once in a record, over all its rows. Rows with a null or blank id are left out,
    as are records without an item; a null or empty array adds nothing. Extra columns are ignored. An empty
    table gives no pairs.

    Pairs are made inside each record's basket and counted before they are shuffled. A basket of more than
    `basket` items is cut into chunks that are paired chunk by chunk over many tasks, so no task holds it whole.
    min_count drops pairs that occur less often; items rarer than that are left out beforehand, which loses
    nothing. The driver sees only two histograms, records by size and items by frequency; the null is fitted to
    their bins, a few hundred each whatever the number of records, and an item's own frequency scales its weight.
    """

    def __init__(self, records: DataFrame, record: str, items: str, min_count: int = 1, basket: int = 256, most_broadcast_rows: int = 1_000_000):
        rows = records.select(F.lower(F.btrim(F.col(record), F.lit(BLANKS))).alias("record"), F.explode(items).alias("item"))
        rows = rows.select("record", norm_item(F.col("item")).alias("item")).where("record <> '' and item is not null").distinct()
        self.incidence = cut(rows, "incidence")
        self.basket, self.min_count = basket, min_count
        self.items = self.incidence.groupBy("item").agg(F.count("*").alias("n"))
        sizes = cut(self.incidence.groupBy("record").agg(F.count("*").alias("size")), "sizes")
        large = sizes.where(F.col("size") > basket)
        self.large = F.broadcast(large) if large.count() <= most_broadcast_rows else large
        by_size = sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()
        by_frequency = self.items.groupBy(F.col("n").alias("f")).agg(F.count("*").alias("n")).orderBy("f").collect()
        self.n_records = sum(r["n"] for r in by_size)
        self.n_items = sum(r["n"] for r in by_frequency)
        histogram = lambda rows: tuple(np.array([r[i] for r in rows], float) for i in (0, 1))
        _, sizes_mean, self.trials = bins(*histogram(by_size), exact=32, per_octave=16)
        self.frequencies, n_items = histogram(by_frequency)
        which, frequency_mean, in_bin = bins(self.frequencies, n_items, exact=256, per_octave=64)
        self.x, y = fit_null(sizes_mean, self.trials, frequency_mean, in_bin) if by_size else (sizes_mean, frequency_mean)
        self.y = y[which] * self.frequencies / frequency_mean[which]

    def counts(self) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b, n): item_a < item_b by code point; n is the number of records."""
        frequent = self.items.where(F.col("n") >= self.min_count).select("item")
        rows = self.incidence.join(frequent, "item") if self.min_count > 1 else self.incidence
        baskets = rows.join(self.large, "record", "left_anti").groupBy("record").agg(F.sort_array(F.collect_list("item")).alias("items"))
        pair = lambda a, b: F.struct(a.alias("item_a"), b.alias("item_b"))
        inside = F.flatten(
            F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda b: pair(a, b)))
        )
        small = baskets.select(F.explode(inside).alias("p"))
        part = F.pmod(F.xxhash64("item"), F.ceil(F.col("size") / self.basket))
        chunks = rows.join(self.large, "record").groupBy("record", part.alias("part")).agg(F.collect_list("item").alias("items"))
        other = chunks.select("record", F.col("part").alias("part_b"), F.col("items").alias("items_b"))
        crossed = F.filter(
            F.flatten(F.transform("items", lambda a: F.transform("items_b", lambda b: pair(F.least(a, b), F.greatest(a, b))))),
            lambda p: p["item_a"] < p["item_b"],
        )
        across = chunks.join(other, "record").where("part <= part_b")
        whole = F.when(F.col("part") == F.col("part_b"), F.array_distinct(crossed)).otherwise(crossed)
        large = across.select(F.explode(whole).alias("p"))
        counted = small.unionByName(large).groupBy("p.item_a", "p.item_b").agg(F.count("*").alias("n_ab"))
        counted = counted.where(F.col("n_ab") >= self.min_count)
        a = self.items.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
        b = self.items.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
        return counted.join(a, "item_a").join(b, "item_b").withColumn("n", F.lit(self.n_records).cast("long"))

    def against_chance(self) -> DataFrame:
        """counts() with lift = n_ab * n / (n_a * n_b), expected (under the null) and p_value = P(V >= n_ab)."""
        x, y, trials, frequencies = self.x, self.y, self.trials, self.frequencies
        counted = self.counts()

        rows = max(1, 500_000 // max(1, len(x)))  # pairs judged at a time, so that memory does not follow the sizes

        def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in (whole.iloc[i : i + rows].copy() for whole in frames for i in range(0, max(1, len(whole)), rows)):
                chance = []
                for column in ("n_a", "n_b"):
                    weight = y[np.searchsorted(frequencies, f[column].to_numpy(float))]
                    chance.append(np.outer(weight, x) / (1 + np.outer(weight, x)))
                both = chance[0] * chance[1]
                f["lift"] = f.n_ab * f.n / (f.n_a * f.n_b)
                f["expected"] = both @ trials
                f["p_value"] = upper_tail(f.n_ab.to_numpy(float), trials, both)
                yield f

        fields = ", ".join(f"{n} {t}" for n, t in counted.dtypes)
        return counted.mapInPandas(judge, f"{fields}, lift double, expected double, p_value double")

    def surprising(self, false_discovery_rate: float = 0.05) -> DataFrame:
        """against_chance() with `surprising`: the pairs that Benjamini and Hochberg's rule accepts among all
        pairs of items. The cut is found by counting, without ranking the pairs in one place: the largest k
        with k p-values of at most k * rate / m is where repeated counting from k = m comes to rest."""
        judged = cut(self.against_chance(), "pairs")
        tests = self.n_items * (self.n_items - 1) // 2
        k, limit = tests, false_discovery_rate
        while k:
            limit = k * false_discovery_rate / tests
            below = judged.where(F.col("p_value") <= limit).count()
            if below >= k:
                break
            k = below
        return judged.withColumn("surprising", F.lit(k > 0) & (F.col("p_value") <= limit))
