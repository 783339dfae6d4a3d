import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import dedup, overlap

SETS = "category string, key string, words array<string>, flags int"


def random_sets(seed, n=160):
    rng = random.Random(seed)
    words = ["w%d" % min(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(400)]
    rows = {(rng.choice("cd"), tuple(sorted({rng.choice(words) for _ in range(rng.randrange(2, 9))}))) for _ in range(n)}
    return [(c, f"k{i:03}", list(w), rng.choice([0, 1, 2, 3])) for i, (c, w) in enumerate(sorted(rows)) if len(w) >= 2]


def brute(rows, least, need=0):
    return {
        (c, min(k, o), max(k, o)): n / min(len(w), len(v))
        for i, (c, k, w, f) in enumerate(rows)
        for d, o, v, g in rows[i + 1 :]
        if c == d and (f | g) & need == need and (n := len(set(w) & set(v))) >= least * min(len(w), len(v))
    }


@pytest.mark.parametrize("least, need, limits", [(0.5, 0, {}), (0.5, 3, {"most_in_cell": 7, "most_in_task": 100}), (0.34, 0, {"most_ranked": 3}), (0.8, 1, {"most_in_cell": 1})])
def test_overlapping_equals_all_pairs(spark, monkeypatch, least, need, limits):
    """With words spread over tasks, few words ranked and parts of a few rows."""
    monkeypatch.setattr(overlap, "_ROWS", 8), monkeypatch.setattr(overlap, "_COLUMNS", 16)
    rows = random_sets(1)
    frame = spark.createDataFrame(rows, SETS)
    got = [((r["category"], r["class_a"], r["class_b"]), r["overlap"]) for r in overlap.overlapping(frame, least, need, **limits).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(rows, least, need)
    assert overlap.overlapping(frame.limit(0), least, need).count() == 0


def test_candidates_are_not_shuffled(spark):
    """Titles of few words: each row meets at its words only; the pairs, which are a hundred times as many, stay in their task."""
    words = ["alpha", "bravo", "delta", "gamma", "kappa", "omega", "sigma", "theta", "zebra", "lambda"]
    rows = [(f"{i:04}", "c", " ".join([words[i % 10], words[i // 10 % 10], f"only{i}"])) for i in range(1000)]
    pairs = dedup.similar_titles(spark.createDataFrame(rows, "id string, category string, title string"))
    assert pairs.count() > 10_000
    plan = pairs._jdf.queryExecution().executedPlan()
    names = plan.toString()
    assert "SortMergeJoin" not in names and "BroadcastHashJoin" not in names and names.count("Exchange") == 1


@pytest.mark.parametrize("limits", [{}, {"most_in_cell": 5, "most_in_task": 60, "most_ranked": 10}])
def test_counts_equal_all_pairs(spark, limits):
    rows = random_sets(2)
    want = {}
    for _, a, b in brute(rows, 0.5):
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    assert {r["key"]: r["n"] for r in overlap.overlap_counts(spark.createDataFrame(rows, SETS), 0.5, **limits).collect()} == want


def test_title_counts_without_pairs(spark):
    """No pair is a row of any stage; classes without category or partner count 0."""
    rows = [("1", "c", "alpha bravo"), ("2", "c", "Bravo delta"), ("3", "c", "alpha bravo"), ("4", None, "alpha bravo"), ("5", "c", "one two"), ("6", "c", "x")]
    found = dedup.similar_title_counts(spark.createDataFrame(rows, "id string, category string, title string"))
    assert {(r["category"], r["class_id"], r["n"], r["n_links"]) for r in found.collect()} == {("c", "1", 2, 1), ("c", "2", 1, 1), (None, "4", 1, 0), ("c", "5", 1, 0)}
    assert "class_a" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limits", [{"first_round": 4}, {"first_round": 9, "most_broadcast": 1}])
def test_fold_in_rounds_equals_one_by_one(spark, limits):
    """In many rounds, by broadcast and by joins, and for notes without category."""
    from datetime import datetime

    from test_records import fold_one_by_one

    rng = random.Random(5)
    title = lambda: " ".join(rng.choice(["Retry", "queue", "drain", "cache", "replica", "index", "token", "lag", "a"]) for _ in range(rng.randrange(1, 6)))
    note = lambda i, day: (f"n{i:03}", rng.choice(["c", None]), rng.choice([title(), title(), None]), rng.choice([datetime(2025, 1, day, 1, 2, 3, day), None]))
    schema = "id string, category string, title string, created timestamp"
    stored = [note(i, 1) for i in range(900, 915)]
    keep = fold_one_by_one(stored)
    stored = [r for r in stored if keep[r[0]] == r[0]]
    rows = [note(i, rng.randrange(1, 28)) for i in range(150)]
    for old in ([], stored):
        frame = spark.createDataFrame(old, schema) if old else None
        got = {r["id"]: r["into"] for r in dedup.fold_notes(spark.createDataFrame(rows, schema), frame, **limits).collect()}
        assert got == fold_one_by_one(rows, old)


def test_fold_does_not_link_all_pairs(spark):
    """Of 2,000 notes that are nearly all alike a round links only what no standing note took."""
    import uuid
    from datetime import datetime, timedelta

    from lorekeep.session import own_scratch

    words = ["alpha", "bravo", "delta", "gamma", "kappa", "omega", "sigma", "theta", "zebra", "lambda"]
    rng = random.Random(3)
    rows = [(uuid.UUID(int=i).hex, "c", " ".join([*rng.sample(words, 3), f"only{i}"]), datetime(2025, 1, 1) + timedelta(minutes=i)) for i in range(2000)]
    written = lambda: set(Path(own_scratch(spark).removeprefix("file://")).glob("edges-*"))
    before = written()
    frame = spark.createDataFrame(rows, "id string, category string, title string, created timestamp")
    into = {r["id"]: r["into"] for r in dedup.fold_notes(frame, first_round=50).collect()}
    links = spark.read.parquet(*map(str, written() - before)).count()
    assert len(into) == 2000 and links < 20_000
