"""References to keys that do not exist: a Bloom filter proves most orphans, an exact join settles the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 512  # 64-bit words in a shard of the filter, 4 KB
PROBES = 4


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("space", "key"), F.lit(n_shards)).cast("int")


def _bits() -> list[Column]:
    """Bit positions 0..32767 inside the shard, 15 bits of a second hash each."""
    h = F.xxhash64(F.lit(7), "key", "space")
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(WORDS * 64 - 1)).cast("int") for i in range(PROBES)]


def _one_bit(b: Column) -> Column:
    """The 64-bit word with only bit b mod 64 set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), b.bitwiseAND(F.lit(63)))


def bloom_shards(parents: DataFrame, n_shards: int) -> DataFrame:
    """The filter over (space, key) as rows (shard, words array<bigint>), built by two aggregations."""
    set_bits = parents.select(_shard(n_shards).alias("shard"), F.explode(F.array(*_bits())).alias("bit"))
    words = set_bits.groupBy("shard", F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(_one_bit(F.col("bit"))).alias("bits")
    )
    packed = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return packed.select(
        "shard",
        F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0))).alias("words"),
    )


def _maybe(words: Column) -> Column:
    hits = [F.get(words, F.shiftright(b, 6)).bitwiseAND(_one_bit(b)) != 0 for b in _bits()]
    return reduce(lambda x, y: x & y, hits)


def orphan_references(
    refs: DataFrame, parents: DataFrame, bits_per_key: int = 12, most_broadcast_mb: int = 64
) -> DataFrame:
    """Distinct references without a parent: (source, space, key, period, n_references).

    refs has (source, space, key, period), parents has (space, key); space names the table referred to, so one
    filter serves all. Rows with a null key refer to nothing and are left out; a null period is 'unknown'.
    Columns beyond these are ignored. No parents: every reference is an orphan; no references: no rows.

    References are reduced to distinct (source, space, key, period) with their count before anything else, which
    dissolves hot keys. Keys the filter does not hold are orphans for certain; only the others meet the exact
    anti join. The filter is broadcast while its size, known from the parents' count, is at most
    most_broadcast_mb; beyond that it is joined by shard like any table.
    """
    parents = parents.select("space", "key").where("key is not null")
    n = parents.count()
    n_shards = max(1, -(-n * bits_per_key // (WORDS * 64)))
    shards = bloom_shards(parents, n_shards)
    if n_shards * WORDS * 8 <= most_broadcast_mb << 20:
        shards = F.broadcast(shards)
    grouped = (
        refs.select("source", "space", "key", F.coalesce("period", F.lit("unknown")).alias("period"))
        .where("key is not null")
        .groupBy("source", "space", "key", "period")
        .agg(F.count("*").alias("n_references"))
    )
    flagged = (
        grouped.withColumn("shard", _shard(n_shards))
        .join(shards, "shard", "left")
        .withColumn("maybe", F.coalesce(_maybe(F.col("words")), F.lit(False)))
        .drop("words", "shard")
    )
    definite = flagged.where(~F.col("maybe")).drop("maybe")
    settled = flagged.where("maybe").drop("maybe").join(parents.distinct(), ["space", "key"], "left_anti")
    return definite.unionByName(settled)


def prefix_parents(ids: DataFrame, refs: DataFrame, full: int = 36) -> DataFrame:
    """Keys that references to `ids` can hit: the ids, and their prefixes of every length below `full` in use.

    ids and refs have (key). A reference shorter than `full` names every id that begins with it, so the ids'
    prefixes of just the lengths that occur (at most full - 1) are its parents; other lengths cost nothing.
    """
    used = refs.select(F.length("key").alias("n")).where(f"n between 1 and {full - 1}").distinct().collect()
    lengths = sorted(r["n"] for r in used)
    ids = ids.select("key").where("key is not null")
    if not lengths:
        return ids.where(F.length("key") >= full)
    cuts = F.array_distinct(F.array(*[F.substring("key", 1, n) for n in lengths], "key"))
    fits = F.filter(cuts, lambda k: (F.length(k) >= full) | F.length(k).isin(lengths))
    return ids.select(F.explode(fits).alias("key"))
