"""Problems 2 and 5: feature table per entity, references that lead nowhere."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import features, orphans
from lorekeep.plans import core_problems

AS_OF = 1_000_000 * 10**6
DAY = 86_400 * 10**6
LOG = "entry_id string, access_type string, accessed_at string, event_type string, entity string, salt int, at string"


def log(spark, rows):
    """Rows with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "other", "x", 7, "soon") for r in rows], LOG)


def table(frame, **options):
    return features.feature_table(frame, "entry_id", "access_type", "accessed_at", AS_OF, DAY, **options)


def cells(frame, **options):
    return {
        (r["entity"], r["event_type"]): (r["n_window"], r["n_total"], r["last_at"])
        for r in features.type_cells(frame, "entry_id", "access_type", "accessed_at", AS_OF, DAY, **options).collect()
    }


def test_cells_edge_cases(spark):
    rows = [
        ("A ", "Get-x", "999999"), (" a", "get_x", "999999"), ("a", " GET_X ", "999998"), ("a", "get_x", "100"), ("a", "get_x", "1000000"),
        ("a", None, "5"), ("a", " ", "5"), (None, "get", "5"), ("  ", "get", "5"), ("b", "get", None), ("b", "get", "soon"), ("b", "list", "7"),
        ("x" * 5000, "get", "8"),
    ]
    assert cells(log(spark, rows)) == {
        ("a", "get_x"): (2, 3, 999999 * 10**6), ("b", "list"): (0, 1, 7 * 10**6), ("x" * 5000, "get"): (0, 1, 8 * 10**6),
    }


def test_empty_log(spark):
    assert cells(log(spark, [])) == {} and table(log(spark, [])).count() == 0


def test_every_entity_has_every_type(spark):
    rows = [("a", "get", "10"), ("b", "list", "999990"), ("b", "get", "999999")]
    got = {r["entity"]: r for r in table(log(spark, rows)).collect()}
    assert got["a"]["event_types"] == ["get", "list"] and got["a"]["n_total"] == [1, 0] and got["a"]["seconds_since_last"] == [999990, None]
    assert got["b"]["n_window"] == [1, 1] and got["b"]["seconds_since_last"] == [1, 10]


def test_too_many_types_is_an_error(spark):
    with pytest.raises(ValueError):
        table(log(spark, [("a", f"t{i}", "1") for i in range(5)]), most_types=4)


@pytest.mark.parametrize("options", [{"target_rows": 5}, {"target_rows": 500, "sample_rows": 2000}, {}])
def test_skewed_groups_against_counting(spark, options):
    rng = random.Random(3)
    rows = [("hot", "get", str(rng.randrange(900_000, 1_000_100))) for _ in range(3000)]
    rows += [(f"e{rng.randrange(40)}", f"t{rng.randrange(5)}", str(rng.randrange(900_000, 1_000_100))) for _ in range(3000)]
    rows += rows[:500]
    seen = defaultdict(set)
    for e, t, at in rows:
        if int(at) < 1_000_000:
            seen[e, t].add(int(at))
    want = {k: (sum(x >= 913_600 for x in v), len(v), max(v) * 10**6) for k, v in seen.items()}
    assert cells(log(spark, rows), **options) == want


def test_heavy_groups(spark):
    rows = spark.createDataFrame([("a", "x")] * 60 + [(f"b{i}", "y") for i in range(40)], "e string, t string")
    assert [tuple(r) for r in features.heavy_groups(rows, ["e", "t"], 100, 30).collect()] == [("a", "x", 60)]
    assert {tuple(r) for r in features.heavy_groups(rows, ["t"], 100, 30).collect()} == {("x", 60), ("y", 40)}
    assert features.heavy_groups(rows.limit(0), ["e", "t"], 0, 30).count() == 0


def test_a_group_of_nine_tenths_of_the_log_is_spread(spark):
    """No task gets more rows of one group than the target, give or take what a hash spreads unevenly."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("e"), "id")).alias("entry_id"), F.lit("get").alias("access_type"), F.col("id").cast("string").alias("accessed_at")
    )
    frame = features.type_cells(rows, "entry_id", "access_type", "accessed_at", AS_OF, DAY, target_rows=2000, sample_rows=4000)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan and frame.where("entity = 'hot'").first()["n_total"] == 36_000
    salts = int(-(-features.heavy_groups(rows, ["entry_id"], 40_000, 2000, 4000).first()["n"] // 2000))
    largest = rows.where("entry_id = 'hot'").groupBy(F.pmod(F.xxhash64(F.col("accessed_at").cast("long") * 1_000_000), F.lit(salts))).count().agg(F.max("count")).first()[0]
    assert 16 <= salts <= 20 and largest < 2600


def test_one_access_repeated_over_a_third_of_the_log(spark):
    rows = [("hot", "get", "999999")] * 1000 + [("hot ", "GET", "999999")] * 3 + [(f"e{i}", "get", str(i)) for i in range(2000)]
    for options in ({}, {"target_rows": 100, "sample_rows": 500}):
        got = cells(log(spark, rows), **options)
        assert got["hot", "get"] == (1, 1, 999999 * 10**6) and len(got) == 2001


REFS = "source string, space string, key string, period string, n_references int, shard int, words string, maybe string"


def refs(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "w", "m") for r in rows], REFS)


def missing(frame, parents, **options):
    return {(r["source"], r["key"], r["period"]): r["n_references"] for r in orphans.orphan_references(frame, parents, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"bits_per_key": 1}, {"most_broadcast_mb": -1}])
def test_orphans_against_sets(spark, options):
    rng = random.Random(5)
    present = [f"k{i}" for i in range(0, 3000, 2)]
    parents = spark.createDataFrame([("entry", k, "x") for k in present] + [("file", "k1", "x"), ("entry", None, "x")], "space string, key string, key2 string")
    rows = [("log", "entry", f"k{rng.randrange(3000)}", rng.choice(["2025-01", None])) for _ in range(4000)]
    rows += [("log", "entry", "hot", "2025-01")] * 2000 + [("e", "file", "k1", None), ("e", "file", "k2", None), ("log", "entry", None, "2025-01")]
    want = Counter()
    known = {("entry", k) for k in present} | {("file", "k1")}
    for source, space, key, period in rows:
        if key is not None and (space, key) not in known:
            want[source, key, period or "unknown"] += 1
    assert missing(refs(spark, rows), parents, **options) == want


def test_empty_sides(spark):
    none = spark.createDataFrame([], "space string, key string")
    some = refs(spark, [("log", "entry", "a", None), ("log", "entry", "a", None)])
    assert missing(some, none) == {("log", "a", "unknown"): 2}
    assert missing(refs(spark, []), none) == {}


def test_bloom_filter_has_no_false_negative(spark):
    parents = spark.range(5000).select(F.lit("s").alias("space"), F.concat(F.lit("é"), "id").alias("key"))
    shards = orphans.bloom_shards(parents, 3)
    inside = parents.withColumn("shard", orphans._shard(3)).join(shards, "shard").where(orphans._maybe(F.col("words"))).count()
    outside = spark.range(5000, 15000).select(F.lit("s").alias("space"), F.concat(F.lit("é"), "id").alias("key"))
    false = outside.withColumn("shard", orphans._shard(3)).join(shards, "shard").where(orphans._maybe(F.col("words"))).count()
    assert inside == 5000 and false < 300


def test_prefix_parents(spark):
    full = "0123abcd-0000-4000-8000-000000000000"
    ids = spark.createDataFrame([(full,), (None,), ("short",)], "key string")
    used = spark.createDataFrame([("0123abcd",), ("0123a",), (full,), (None,)], "key string")
    keys = {r["key"] for r in orphans.prefix_parents(ids, used).collect()}
    assert keys == {full, "0123abcd", "0123a", "short"}
    assert {r["key"] for r in orphans.prefix_parents(ids, used.limit(0)).collect()} == {full}


def test_queries_and_oracle(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in ("entries", "notes", "store_files", "vectors", "access_log", "sessions"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name in ("p2_found", "p5_found", "p5_report"):
        frame = core_problems.queries()[name](spark, folder)
        columns = sorted(frame.columns)
        theirs = con.execute(f"select {', '.join(columns)} from ({core_problems.oracle_sql()[name]})").fetchall()
        assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(theirs), name
