"""Limits on notes and the quality rules of session reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits, in bytes or items.
MOST_TITLE, MOST_CONTENT, MOST_TAGS, MOST_TAG, MOST_PATH = 500, 10 << 20, 50, 100, 200
LEAST_SUMMARY_WORDS, LEAST_PHASES = 100, 3


def path_part_ok(c: Column) -> Column:
    """A file name part: not empty, no '..', separators, leading dot or control characters, at most 200 bytes."""
    return (c != "") & ~F.contains(c, F.lit("..")) & ~c.rlike(r"[/\\\x00-\x1f\x7f]|^\.") & (F.octet_length(c) <= MOST_PATH)


def violations(title: Column, content: Column, tags: Column, category: Column) -> Column:
    """Array of the rules a note breaks; empty if it is fine."""
    t, items = F.coalesce(title, F.lit("")), F.coalesce(tags, F.array())
    rules = {
        "title empty": F.trim(t) == "",
        "title too long": F.octet_length(t) > MOST_TITLE,
        "title with null byte": F.contains(t, F.lit("\0")),
        "content too long": F.octet_length(F.coalesce(content, F.lit(""))) > MOST_CONTENT,
        "too many tags": F.size(items) > MOST_TAGS,
        "tag too long": F.exists(items, lambda x: F.coalesce(F.octet_length(x), F.lit(0)) > MOST_TAG),
        "tag with null byte": F.exists(items, lambda x: F.coalesce(F.contains(x, F.lit("\0")), F.lit(False))),
        "category not a path part": ~F.coalesce(path_part_ok(category), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules.items()]), lambda x: x.isNotNull())


def sections(markdown: Column) -> Column:
    """Map of '## ' section names to their trimmed contents; the text before the first is dropped and of a name
    that comes twice the last counts. Needs spark.sql.mapKeyDedupPolicy=LAST_WIN only for such reports."""
    parts = F.slice(F.split(markdown, r"(?m)^## "), 2, 1 << 30)
    entries = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([^\n]*)", 1).alias("k"), F.trim(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("v")))
    unique = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(unique)


def checks(summary: Column, what_happened: Column, problems: Column, insights: Column, next_steps: Column) -> Column:
    """array<struct<section, passed, found>>: the summary has at least 100 words, what happened at least 3 lines
    that begin with a digit and a dot, no problem lacks its solution, insights and next steps are there."""
    words = F.size(F.filter(F.split(F.coalesce(summary, F.lit("")), r"\s+"), lambda w: w != ""))
    phases = F.size(F.filter(F.split(F.coalesce(what_happened, F.lit("")), "\n"), lambda x: F.trim(x).rlike(r"^[1-9]\.")))
    unsolved = F.size(F.filter(F.coalesce(problems, F.array()), lambda p: F.trim(F.coalesce(p["solution"], F.lit(""))) == ""))
    one = lambda name, passed, found: F.struct(F.lit(name).alias("section"), passed.alias("passed"), found.cast("int").alias("found"))
    size = lambda c: F.size(F.coalesce(c, F.array()))
    return F.array(
        one("Summary", words >= LEAST_SUMMARY_WORDS, words),
        one("What Happened", phases >= LEAST_PHASES, phases),
        one("Problems & Solutions", unsolved == 0, unsolved),
        one("Learning Insights", size(insights) > 0, size(insights)),
        one("Next Steps", size(next_steps) > 0, size(next_steps)),
    )


def validated(sessions: DataFrame) -> DataFrame:
    """(id, section, passed, found): every check of every report."""
    c = checks(*(F.col(n) for n in ("summary", "what_happened", "problems", "insights", "next_steps")))
    return sessions.select("id", F.inline(c))
