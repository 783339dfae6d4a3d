"""Problems 1 and 4: similar vectors, items that appear together."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import cooccurrence, neighbours, queries

SCHEMA = "doc_id string, backend string, model string, dim int, vector array<float>, created_at string, space int, v1 string, latest string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def data(n=1200, d=32, seed=1):
    """Vectors in loose clusters, of which every tenth has a close relative."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d)) * 0.6
    x = centres[rng.integers(12, size=n)] + rng.standard_normal((n, d))
    for i in range(0, n - 1, 10):
        x[i + 1] = x[i] * rng.uniform(0.5, 3) + rng.standard_normal(d) * 0.08 * np.linalg.norm(x[i]) / np.sqrt(d)
    return x.astype(np.float32)


def brute(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= least, 1))
    return {(f"d{a:05}", f"d{b:05}") for a, b in zip(i, j, strict=True)}


@pytest.mark.parametrize("options", [{}, {"list_rows": 60, "block_rows": 25}, {"list_rows": 20, "sample": 300}, {"list_rows": 20, "centre_bytes": 32 * 4 * 7}])
def test_similar_pairs(spark, options):
    x = data()
    frame = vectors(spark, [(f"d{i:05}", "b", "m", 32, v.tolist(), "2025-01-01T00:00:00Z") for i, v in enumerate(x)])
    got = {(r["doc_a"], r["doc_b"]) for r in neighbours.VectorIndex(frame, **options).document_pairs(0.95).collect()}
    want = brute(x, 0.95)
    assert len(want) > 100 and got <= want and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("options", [{"list_rows": 60, "block_rows": 40}, {"list_rows": 15, "sample": 320}])
def test_recall_of_nearest(spark, options):
    x = data(900)
    frame = vectors(spark, [(f"{i:08x}-x", "b", "m", 32, v.tolist(), "1") for i, v in enumerate(x)])
    index = neighbours.VectorIndex(frame, k=5, **options)
    ids = {(r["v1"], r["v2"]): r["doc_id"] for r in index.members().collect()}
    got = Counter()
    for r in index.nearest(5, only_query_set=False).collect():
        got[ids[r["a1"], r["a2"]], ids[r["b1"], r["b2"]]] += 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"{i:08x}-x", f"{j:08x}-x") for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert max(got.values()) == 1 and len(got) <= len(want) and len(want & got.keys()) >= 0.9 * len(want)
    asked = {ids[r["a1"], r["a2"]] for r in index.nearest(5).collect()}
    assert asked == {f"{i:08x}-x" for i in range(0, 900, 50)}


def test_current_vectors(spark):
    nan, one, two = float("nan"), [1.0, 0.0], [0.0, 1.0]
    rows = [
        ("A", "b", "m", 2, two, "2025-01-01T00:00:00Z"), (" a ", "b", "m", 2, one, "2025-01-02T00:00:00Z"), ("a", "b", "m", 2, one, "2025-01-02T00:00:00Z"),
        ("null", "b", "m", 2, one, "1"), ("null", "b", "m", 2, None, "2"), ("empty", "b", "m", 2, [], "1"), ("zero", "b", "m", 2, [0.0, 0.0], "1"),
        ("long", "b", "m", 2, [1.0, 1.0, 1.0], "1"), ("nan", "b", "m", 2, [1.0, nan], "1"), ("inf", "b", "m", 2, [1.0, float("inf")], "1"),
        ("hole", "b", "m", 2, [1.0, None], "1"), ("nodim", "b", "m", None, one, "1"), (None, "b", "m", 2, one, "1"), ("  ", "b", "m", 2, one, "1"),
        ("t", None, None, 2, one, "soon"), ("t", None, None, 2, two, "1"), ("u", None, None, 2, [0.0, 3.0], None),
    ]
    got = {(r["doc_id"], r["backend"], tuple(r["vector"])) for r in neighbours.current_vectors(vectors(spark, rows)).collect()}
    assert got == {("a", "b", (1.0, 0.0)), ("t", None, (0.0, 1.0)), ("u", None, (0.0, 3.0))}
    pairs = [tuple(r)[:4] for r in neighbours.VectorIndex(vectors(spark, rows)).document_pairs(0.95).collect()]
    assert pairs == [(None, None, "t", "u")]


def test_lists_are_bounded_by_rows_and_by_the_broadcast(spark):
    """Two levels where the sample is small against the collection; fewer, longer lists where centres take too much."""
    frame = vectors(spark, [(f"d{i:05}", "b", "m", 32, v.tolist(), "1") for i, v in enumerate(data(2000))])
    two = neighbours.VectorIndex(frame, list_rows=20, sample=300).lists.value[0]
    assert len(two.centres) > 2.5 * len(two.top) and two.start[-1] == len(two.centres) == len(two.blocks)
    few = neighbours.VectorIndex(frame, list_rows=20, sample=300, centre_bytes=32 * 4 * 30).lists.value[0]
    assert len(few.centres) <= 30


def test_many_old_versions_lose_no_space(spark):
    """20 documents of 100 versions each beside a larger space: all 190 pairs of the small one come out."""
    rng = np.random.default_rng(7)
    near = (rng.standard_normal(8) + rng.standard_normal((20, 8)) * 0.01).astype(np.float32)
    rows = [(f"d{i}", "b", "small", 8, (near[i] if v == 99 else rng.standard_normal(8)).tolist(), str(v)) for i in range(20) for v in range(100)]
    rows += [(f"e{i}", "b", "large", 8, rng.standard_normal(8).tolist(), "1") for i in range(300)]
    for sample in (1, 20, 20_000):
        index = neighbours.VectorIndex(vectors(spark, rows), sample=sample)
        assert len(index.spaces) == 2 and index.document_pairs(0.95).where("model = 'small'").count() == 190


def test_classes_and_their_links(spark):
    rows = [(f"d{i}", "b", "m", 2, [1.0, 2.0], "1") for i in range(4)] + [("e", "b", "m", 2, [2.0, 4.1], "1"), ("f", "b", "m", 2, [-1.0, 2.0], "1")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neighbours.VectorIndex(vectors(spark, rows)).linked_classes(0.95).collect()}
    assert got == {f"d{i}": ("d0", 1) for i in range(4)} | {"e": ("e", 1), "f": ("f", 0)}


def test_no_vectors(spark):
    assert neighbours.VectorIndex(vectors(spark, [])).document_pairs(0.95).count() == 0
    assert neighbours.VectorIndex(vectors(spark, [("a", "b", "m", 2, None, "1")])).nearest(3, False).count() == 0


def test_equal_vectors_and_spaces(spark):
    rows = [(f"d{i}", "b", "m", 2, [1.0, 2.0], "1") for i in range(4)] + [("e", "b", "m", 2, [2.0, 4.0], "1"), ("f", "b", "other", 2, [1.0, 2.0], "1")]
    got = {tuple(r)[:4] for r in neighbours.VectorIndex(vectors(spark, rows)).document_pairs(0.95).collect()}
    names = ["d0", "d1", "d2", "d3", "e"]
    assert got == {("b", "m", a, b) for i, a in enumerate(names) for b in names[i + 1 :]}


def test_adaptive_scan_is_exact_without_early_tests():
    x = data(300)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    limits = np.full(100, 0.5)
    i, j, dist = neighbours.adaptive_scan(x[:100], np.ascontiguousarray(x.T), limits, significance=50.0)
    full = 2 - 2 * x[:100] @ x.T
    assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(full <= 0.5), strict=True))
    assert np.allclose(dist, full[i, j], atol=1e-5)


RECORDS = "record string, tags array<string>, item string, size int, n int"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], RECORDS)


def counted(frame, **options):
    rows = cooccurrence.PairCounts(frame, "record", "tags", **options).counts().collect()
    return {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in rows}


def brute_pairs(baskets):
    n, pairs = Counter(), Counter()
    for b in baskets.values():
        n.update(b)
        b = sorted(b)
        pairs.update((x, y) for i, x in enumerate(b) for y in b[i + 1 :])
    return {p: (c, n[p[0]], n[p[1]], len(baskets)) for p, c in pairs.items()}


@pytest.mark.parametrize("basket", [256, 3])
def test_counts(spark, basket):
    rng = random.Random(2)
    rows = [(f"r{i}", [rng.choice("abcdefghij") for _ in range(rng.randrange(9))]) for i in range(400)]
    rows += [("big", [f"t{i}" for i in range(40)]), ("r1", ["A ", "zz"]), ("R1 ", ["zz"])]
    baskets = {}
    for r, tags in rows:
        baskets.setdefault(r.strip().lower(), set()).update(t.strip().lower() for t in tags)
    want = brute_pairs({r: b for r, b in baskets.items() if b})
    assert counted(records(spark, rows), basket=basket) == want
    assert counted(records(spark, rows), basket=basket, min_count=5) == {p: c for p, c in want.items() if c[0] >= 5}


def test_dirty_records(spark):
    rows = [(None, ["a", "b"]), (" ", ["a", "b"]), ("x", None), ("y", []), ("z", [None, "", "  "]), ("ok", ["b", None, "A", "a ", "b"]), ("ok", None)]
    assert counted(records(spark, rows)) == {("a", "b"): (1, 1, 1, 1)}
    assert counted(records(spark, [])) == {}
    assert cooccurrence.PairCounts(records(spark, []), "record", "tags").surprising().count() == 0


def test_tails_against_the_exact_distribution():
    rng = np.random.default_rng(4)
    trials = np.array([40.0, 25.0, 10.0])
    chances = rng.uniform(0.001, 0.3, (60, 3))
    n = rng.integers(0, 30, 60)
    for c, k, got in zip(chances, n, cooccurrence.upper_tail(n.astype(float), trials, chances), strict=True):
        p = np.ones(1)
        for t, q in zip(trials, c, strict=True):
            for _ in range(int(t)):
                p = np.convolve(p, [1 - q, q])
        exact = p[k:].sum()
        assert got == pytest.approx(exact, rel=0.08, abs=1e-12)


def test_null_keeps_sizes_and_frequencies():
    sizes, records_, freq, items = np.array([1.0, 2, 5]), np.array([30.0, 20, 4]), np.array([2.0, 10, 16]), np.array([5.0, 4, 2.5])
    x, y = cooccurrence.fit_null(sizes, records_, freq, items * (sizes * records_).sum() / (freq * items).sum())
    items = items * (sizes * records_).sum() / (freq * items).sum()
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ items, sizes, rtol=1e-6) and np.allclose(records_ @ p, freq, rtol=1e-6)


def test_surprise_and_false_discoveries(spark):
    rng = random.Random(8)
    rows = [(f"r{i}", rng.sample("abcdefghijklmnopqrst", 3)) for i in range(600)] + [(f"s{i}", ["x", "y", rng.choice("abc")]) for i in range(30)]
    pairs = cooccurrence.PairCounts(records(spark, rows), "record", "tags")
    judged = {(r["item_a"], r["item_b"]): r for r in pairs.surprising(0.05).collect()}
    assert judged["x", "y"]["surprising"] and judged["x", "y"]["p_value"] < 1e-20
    p = sorted(r["p_value"] for r in judged.values())
    m = pairs.n_items * (pairs.n_items - 1) // 2
    k = max((i + 1 for i, v in enumerate(p) if v <= 0.05 * (i + 1) / m), default=0)
    assert sum(r["surprising"] for r in judged.values()) == k < 20
    assert judged["a", "b"]["expected"] == pytest.approx(judged["a", "b"]["n_a"] * judged["a", "b"]["n_b"] / pairs.n_records, rel=0.4)


def test_counts_grow_by_lift_not_by_case(spark):
    frame = records(spark, [(f"r{i}", ["Äpfel", "äpfel ", "b"]) for i in range(3)])
    assert counted(frame) == {("b", "äpfel"): (3, 3, 3, 3)}
    assert frame.select(F.size("tags")).first()[0] == 3


def test_dense_third_is_split_into_cells(spark):
    """A third of all vectors in one tight cluster: its lists become grids, and no pair is lost."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 32))
    x[:200] = x[0] + rng.standard_normal((200, 32)) * 0.15
    frame = vectors(spark, [(f"d{i:05}", "b", "m", 32, v.tolist(), "1") for i, v in enumerate(x.astype(np.float32))])
    index = neighbours.VectorIndex(frame, list_rows=300, block_rows=20)
    assert max(lists.blocks.max() for lists in index.lists.value) > 4
    want = brute(x, 0.95)
    got = {(r["doc_a"], r["doc_b"]) for r in index.document_pairs(0.95).collect()}
    assert len(want) > 10_000 and got <= want and len(got) >= 0.97 * len(want)


def test_too_many_spaces_is_an_error(spark):
    rows = [(f"d{i}", f"b{i}", "m", 2, [1.0, 2.0], "1") for i in range(5)]
    with pytest.raises(ValueError):
        neighbours.VectorIndex(vectors(spark, rows), most_spaces=4)


def test_nearest_documents_of_shared_vectors(spark, tmp_path):
    """A third of all documents have one vector, and the first of them is not in the query set."""
    x = data(300)
    x[1::3] = x[1]
    frame = vectors(spark, [(f"{i:08x}-x", "b", "m", 32, v.tolist(), "1") for i, v in enumerate(x)])
    frame.coalesce(1).write.parquet(str(tmp_path / "vectors.parquet"))
    got = {}
    for r in queries.p1_nearest(spark, str(tmp_path)).orderBy("doc_id", "rank").collect():
        got.setdefault(int(r["doc_id"][:8], 16), []).append((int(r["near_doc"][:8], 16), r["cosine"]))
    assert got.keys() == set(range(0, 300, 50))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, near in got.items():
        assert len(near) == 10 and i not in [j for j, _ in near]
        if i % 3 == 1:
            assert near == [(j, 1.0) for j in range(1, 40, 3) if j != i][:10]
        else:
            best = np.sort(np.delete(u @ u[i], i))[::-1][:10]
            assert sum(abs(c - b) < 1e-4 for (_, c), b in zip(near, best, strict=True)) >= 9


@pytest.mark.parametrize(("n", "rank"), [(6000, 4), (6000, 8), (800, 4)])
def test_similar_pairs_of_low_rank(spark, n, rank):
    """Vectors of rank 4 or 8 in 64 dimensions: near ones differ along the centres' differences."""
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((n, rank)) @ rng.standard_normal((rank, 64))).astype(np.float32)
    x[1::2] = x[::2] + 0.13 * np.linalg.norm(x[::2], axis=1, keepdims=True) / 8 * (rng.standard_normal((n // 2, rank)) @ rng.standard_normal((rank, 64))) / np.sqrt(rank)
    x = x.astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = rng.choice(n, min(n, 500), replace=False)
    frame = vectors(spark, [(f"d{i:05}", "b", "m", 64, v.tolist(), "1") for i, v in enumerate(x)])
    index = neighbours.VectorIndex(frame, list_rows=n // 40)
    got = {frozenset((r["doc_a"], r["doc_b"])) for r in index.document_pairs(0.99).collect()}
    pairs = [(a, b) for a in close for b in np.flatnonzero(u @ u[a] >= 0.9905) if a != b]
    missed = sum(frozenset((f"d{a:05}", f"d{b:05}")) not in got for a, b in pairs)
    assert len(index.lists.value[0].centres) >= 30 and len(pairs) > 300
    assert missed <= 0.02 * len(pairs)
