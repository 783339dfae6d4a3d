"""Observations from tool output: what is worth keeping, and what came just before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.text import observation

HOOK = "tool_name string, tool_input string, output string"
CAPTURED_TOOL = "Bash"


def hook_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines of a tool hook; lines that are no JSON give no row."""
    return lines.select(F.from_json(column, HOOK).alias("h")).select("h.*").where("tool_name is not null")


def observations(rows: DataFrame) -> DataFrame:
    """(title, content) of the outputs of captured tools that tell of errors, warnings or test results."""
    kept = rows.where(F.col("tool_name") == CAPTURED_TOOL).withColumn("content", observation(F.col("output")))
    return kept.where("content <> ''").select(F.concat(F.lit("Auto: "), F.col("tool_name"), F.lit(" observation")).alias("title"), "content")


def first_in_window(rows: DataFrame, keys: list[str], at: str = "at", minutes: int = 5) -> DataFrame:
    """Rows without another of the same keys within the `minutes` before them, repeats at one instant included."""
    order = W.partitionBy(*keys).orderBy(at, *[c for c in rows.columns if c not in (*keys, at)])
    before = F.lag(at).over(order)
    fresh = before.isNull() | (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) >= minutes * 60_000_000)
    return rows.withColumn("_fresh", fresh).where("_fresh").drop("_fresh")
