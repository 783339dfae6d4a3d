"""Notes and session reports as Markdown files with front matter: reading them into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE_SCHEMA = "id string, type string, category string, title string, content string, tags array<string>, created timestamp, updated timestamp, metadata map<string,string>"
FRONT = r"(?s)\A---\n(.*?)\n---(?:\n(.*))?\z"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all *.md files below folder, one row a file; names that begin with '._' are skipped."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    named = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return named.where(~F.regexp_extract("path", r"([^/]*)$", 1).startswith("._"))


def front_matter(text: Column) -> Column:
    """The lines between the leading '---' lines; null without them."""
    return F.nullif(F.regexp_extract(text, FRONT, 1), F.lit(""))


def body(text: Column) -> Column:
    return F.btrim(F.regexp_extract(text, FRONT, 2), F.lit(" \n\t\r"))


def _unquoted(c: Column) -> Column:
    plain = F.trim(c)
    double = F.replace(F.replace(F.regexp_extract(plain, r'(?s)^"(.*)"$', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = F.replace(F.regexp_extract(plain, r"(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return F.when(plain.rlike(r'(?s)^".*"$'), double).when(plain.rlike(r"(?s)^'.*'$"), single).otherwise(plain)


def scalar(front: Column, key: str) -> Column:
    """The value of a top-level 'key: value' line, without quotes; null if it is missing or empty."""
    value = _unquoted(F.regexp_extract(F.concat(front, F.lit("\n")), rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.nullif(value, F.lit(""))


def _block(front: Column, key: str) -> Column:
    """The indented or dashed lines below 'key:'."""
    return F.regexp_extract(F.concat(front, F.lit("\n")), rf"(?m)^{key}:[ \t]*\n((?:(?:[ \t]+|- ).*\n)*)", 1)


def items(front: Column, key: str) -> Column:
    """A list, inline [a, b] or one '- item' a line."""
    inline = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    lines = F.filter(F.split(_block(front, key), "\n"), lambda x: F.trim(x) != "")
    listed = F.transform(lines, lambda x: _unquoted(F.regexp_replace(x, r"^\s*-\s*", "")))
    named = F.transform(F.split(inline, r",\s*"), lambda x: _unquoted(x))
    return F.filter(F.when(inline != "", named).otherwise(listed), lambda x: x != "")


def mapping(front: Column, key: str) -> Column:
    """A block of indented 'name: value' lines as a map; of a name that comes twice the first counts."""
    lines = F.filter(F.split(_block(front, key), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(
        lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([^:]+):", 1)).alias("k"), _unquoted(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)).alias("v"))
    )
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda o: o["k"] == p["k"]))
    return F.map_from_entries(first)


def _time(c: Column) -> Column:
    return c.try_cast("timestamp")


def parse_notes(files: DataFrame) -> DataFrame:
    """Typed notes of (path, text). Files without front matter or without an id are left out; unreadable times are
    null, missing lists empty; the type is always 'note'."""
    rows = files.withColumn("f", front_matter(F.col("text"))).where("f is not null")
    f = F.col("f")
    return rows.select(
        scalar(f, "id").alias("id"), F.lit("note").alias("type"), scalar(f, "category").alias("category"), scalar(f, "title").alias("title"),
        body(F.col("text")).alias("content"), items(f, "tags").alias("tags"), _time(scalar(f, "created")).alias("created"),
        _time(scalar(f, "updated")).alias("updated"), mapping(f, "metadata").alias("metadata"), "path",
    ).where("id is not null")


# Names of the sections of a report, by field.
SECTION_FIELDS = {
    "summary": ["summary"],
    "what_happened": ["what happened"],
    "decisions": ["key decisions", "decisions"],
    "changes": ["what changed", "changes"],
    "problems": ["problems & solutions", "problems and solutions"],
    "insights": ["learning insights", "insights"],
    "questions": ["questions raised", "questions"],
    "next_steps": ["next steps"],
    "related_notes": ["related notes"],
}


def section_list(text: Column) -> Column:
    """array<struct<name, content>> of the '## ' sections in order, contents trimmed. Text before the first is
    dropped; of a name that comes twice the last counts, in its place."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n## "), 2, 1 << 30)
    named = F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, r"^([^\n]*)", 1)).alias("name"), F.btrim(F.regexp_replace(p, r"^[^\n]*\n?", ""), F.lit(" \n\t\r")).alias("content")
        ),
    )
    return F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["name"] == e["name"]))


def section(sections: Column, field: str) -> Column:
    """The content of the section for a field, under any of its names; null without one."""
    hits = F.filter(sections, lambda s: F.lower(s["name"]).isin(SECTION_FIELDS[field]))
    return F.get(hits, F.lit(0))["content"]


def list_items(text: Column, glue: bool = True) -> Column:
    """Items of '- ' or '* ' lines. With glue, a line that starts with two blanks goes on the item before it."""
    joined = F.regexp_replace(text, r"\n {2,}", " ") if glue else text
    lines = F.split(F.coalesce(joined, F.lit("")), "\n")
    return F.transform(F.filter(lines, lambda x: x.rlike(r"^[-*] ")), lambda x: F.trim(F.substring(x, 3, 1 << 30)))


def problems(text: Column) -> Column:
    """array<struct<problem, solution>>: a solution follows its problem as a line of its own or in the same item,
    marked 'Solution:' or '**Solution**:'."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n\s*(?:[-*] )?(?:\*\*Solution\*\*:|Solution:)[ \t]*", "\x1f")
    each = F.transform(list_items(marked), lambda x: F.split(F.regexp_replace(x, r"^(?:\*\*Problem\*\*:|Problem:)\s*", ""), "\x1f"))
    made = F.transform(each, lambda p: F.struct(F.trim(p[0]).alias("problem"), F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("solution")))
    return F.filter(made, lambda p: p["problem"] != "")


def changes(text: Column) -> Column:
    """array<struct<path, description>> of '`path` — description' items."""
    pairs = F.transform(list_items(text), lambda x: F.split(x, " — ", 2))
    return F.transform(
        F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(F.btrim(p[0], F.lit("`")).alias("path"), p[1].alias("description"))
    )


def related_notes(text: Column) -> Column:
    """array<struct<id, title, category>> of items with an id in backticks."""
    made = F.transform(
        list_items(text),
        lambda x: F.struct(
            F.regexp_extract(x, r"`([^`]*)`", 1).alias("id"), F.regexp_extract(x, r'"([^"]*)"', 1).alias("title"), F.regexp_extract(x, r"\(([^)]*)\)", 1).alias("category")
        ),
    )
    return F.filter(made, lambda r: r["id"] != "")


def without_box(c: Column) -> Column:
    """A next step without its check box."""
    return F.regexp_replace(c, r"^\[[ xX]\] ", "")


def report_fields(s: Column) -> list[Column]:
    """The fields of a report from its sections (section_list), all but the summary; sections without a field of their
    own are extra sections unless blank."""
    known = [name for names in SECTION_FIELDS.values() for name in names]
    text = lambda field: F.coalesce(section(s, field), F.lit(""))
    return [
        text("what_happened").alias("what_happened"), list_items(text("decisions")).alias("decisions"), changes(text("changes")).alias("changes"),
        problems(text("problems")).alias("problems"), list_items(text("insights")).alias("insights"), list_items(text("questions")).alias("questions"),
        F.transform(list_items(text("next_steps")), without_box).alias("next_steps"), related_notes(text("related_notes")).alias("related_notes"),
        F.filter(s, lambda x: ~F.lower(x["name"]).isin(known) & (x["content"] != "")).alias("extra_sections"),
    ]


def parse_sessions(files: DataFrame) -> DataFrame:
    """Typed session reports of (path, text); files without front matter or id are left out. Sections without a
    field of their own are kept as extra sections unless blank."""
    rows = files.withColumn("f", front_matter(F.col("text"))).where("f is not null").withColumn("s", section_list(body(F.col("text"))))
    f, s = F.col("f"), F.col("s")
    text = lambda field: F.coalesce(section(s, field), F.lit(""))
    return rows.select(
        scalar(f, "id").alias("id"), F.lit("session").alias("type"),
        *(scalar(f, k).alias(k) for k in ("title", "date", "branch", "project", "session_id")),
        items(f, "tags").alias("tags"), _time(scalar(f, "created")).alias("created"), text("summary").alias("summary"),
        *report_fields(s), "path",
    ).where("id is not null")


def import_plain(files: DataFrame, known_ids: DataFrame, root: str) -> DataFrame:
    """Notes of any Markdown files below root: by their front matter, or with the folder as category ('imported' at
    the top), the file name as title and a digest of the path as id. Ids in known_ids (id) are skipped."""
    below = F.regexp_replace(F.col("path"), rf"^(?:file:)?/*{root.strip('/')}/", "")
    rows = files.withColumn("below", below).where(~F.col("below").startswith("."))
    f = front_matter(F.col("text"))
    folder = F.regexp_replace(F.regexp_extract("below", r"^(.*)/[^/]*$", 1), "/", "-")
    name = F.initcap(F.regexp_replace(F.regexp_extract("below", r"([^/]*)\.md$", 1), "-", " "))
    made = rows.select(
        F.coalesce(scalar(f, "id"), F.md5("below")).alias("id"), F.lit("note").alias("type"),
        F.coalesce(scalar(f, "category"), F.nullif(folder, F.lit("")), F.lit("imported")).alias("category"),
        F.coalesce(scalar(f, "title"), name).alias("title"), F.when(f.isNull(), F.col("text")).otherwise(body(F.col("text"))).alias("content"),
        F.when(f.isNull(), F.array().cast("array<string>")).otherwise(items(f, "tags")).alias("tags"),
    )
    return made.join(known_ids.select("id"), "id", "left_anti")


ARCHIVE_NAME = r"(\d{4}-\d{2}-\d{2})_(.+?)_([0-9a-f]{8})_(.+)\.md$"


def import_archive(files: DataFrame, known_session_ids: DataFrame) -> DataFrame:
    """Session reports of an archive: date, branch, session id and title from names like
    2025-01-31_main_0a1b2c3d_some-title.md, or else the name as title, branch 'unknown' and a session id of its own
    ('imported-' and a digest). Session ids in known_session_ids (session_id) are skipped. Text without sections is
    the summary."""
    part = lambda i: F.nullif(F.regexp_extract("path", ARCHIVE_NAME, i), F.lit(""))
    plain = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    sections = section_list(F.when(front_matter(F.col("text")).isNull(), F.col("text")).otherwise(body(F.col("text"))))
    text = lambda field: F.coalesce(section(F.col("s"), field), F.lit(""))
    rows = files.withColumn("s", sections).select(
        part(1).alias("date"), F.coalesce(part(2), F.lit("unknown")).alias("branch"),
        F.coalesce(part(3), F.concat(F.lit("imported-"), F.substring(F.md5("path"), 1, 8))).alias("session_id"),
        F.regexp_replace(F.coalesce(part(4), plain), "-", " ").alias("title"),
        F.when(F.size("s") == 0, F.btrim(F.col("text"), F.lit(" \n\t\r"))).otherwise(text("summary")).alias("summary"), *report_fields(F.col("s")),
    )
    return rows.join(known_session_ids.select("session_id"), "session_id", "left_anti")
