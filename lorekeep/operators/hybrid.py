"""Keyword and semantic results fused: min-max scaling per side and a weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut

KEYWORD_WEIGHT, SEMANTIC_WEIGHT = 0.7, 0.3


def fuse(keyword: DataFrame, semantic: DataFrame, limit: int = 20) -> DataFrame:
    """(id, score) from (id, score) of both sides.

    Each side is scaled to 0..1 by its own least and greatest score (a side of equal scores becomes 0), a row
    missing on one side adds 0 for it. If one side is empty the other comes out with its raw scores. Both sides
    are top lists of bounded length; each is computed once, and its extremes are two numbers.
    """
    k = cut(keyword.select("id", F.col("score").alias("k")), "keyword")
    s = cut(semantic.select("id", F.col("score").alias("s")), "semantic")
    ends = {c: df.agg(F.min(c).alias("low"), F.max(c).alias("high")).first() for df, c in ((k, "k"), (s, "s"))}

    def scaled(c: str) -> Column:
        low, high = ends[c]
        return F.coalesce((F.col(c) - F.lit(low)) / F.lit(high - low or 1.0), F.lit(0.0))

    if ends["k"].low is None or ends["s"].low is None:
        score = F.coalesce("k", "s")
    else:
        score = KEYWORD_WEIGHT * scaled("k") + SEMANTIC_WEIGHT * scaled("s")
    return k.join(s, "id", "full_outer").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
