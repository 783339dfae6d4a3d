"""Duplicates among notes and sessions: finding candidates, and merging what belongs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.text import id8, title_words
from lorekeep.operators.overlap import best_of, overlap_counts, overlapping
from lorekeep.session import cut

LEAST_OVERLAP = 0.5
SEPARATOR = "\n\n--- Updated %s ---\n"


def exact_titles(docs: DataFrame) -> DataFrame:
    """(category, title, n, first_id): titles that several rows of one category carry."""
    return docs.groupBy("category", "title").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def title_classes(docs: DataFrame) -> DataFrame:
    """(category, words, class_id, n): rows of a category with one set of title words (at least two) are a class,
    named by its smallest id. Pairs are sought between classes, so copies of a title cost one row."""
    rows = docs.select("id", "category", F.sort_array(title_words(F.col("title"))).alias("words")).where(F.size("words") >= 2)
    return rows.groupBy("category", "words").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))


def similar_titles(docs: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """(category, class_a, class_b, overlap) of classes whose shared words are at least `least` of the smaller set."""
    return overlapping(_sets(cut(title_classes(docs), "classes")), least)


def similar_title_counts(docs: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """(category, class_id, n, n_links): all title classes and to how many others each is similar, without their pairs."""
    classes = cut(title_classes(docs), "classes")
    links = overlap_counts(_sets(classes), least).select(F.col("key").alias("class_id"), F.col("n").alias("n_links"))
    return classes.select("category", "class_id", "n").join(links, "class_id", "left").fillna(0, ["n_links"]).select("category", "class_id", "n", "n_links")


def _sets(classes: DataFrame) -> DataFrame:
    """Classes that can be similar to others, as `overlap` takes them."""
    return classes.where("category is not null").select("category", F.col("class_id").alias("key"), "words", F.lit(0).alias("flags"))


def tag_union(old: Column, new: Column) -> Column:
    """Tags of both, trimmed, blanks dropped, the first spelling of each kept, old ones first."""
    tags = F.filter(F.transform(F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array())), lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(
        tags,
        F.array().cast("array<string>"),
        lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.concat(kept, F.array(t))),
    )


def list_union(old: Column, new: Column) -> Column:
    """Distinct items of both lists, old ones first."""
    return F.array_distinct(F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array())))


def metadata_union(old: Column, new: Column) -> Column:
    """Both maps; non-empty new values win."""
    wins = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: v != "")
    base = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(wins, k))
    return F.map_concat(base, wins)


def text_union(old: Column, new: Column, when: Column) -> Column:
    """Both texts with a dated separator, or the one that is not empty."""
    o, n = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when((o != "") & (n != ""), F.concat(o, F.format_string(SEPARATOR, when), n)).otherwise(F.concat(o, n))


def content_union(old: Column, new: Column, when: Column) -> Column:
    """Note content with new content appended, unless it is empty or equal."""
    o, n = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when((n == "") | (o == n), o).otherwise(F.concat(o, F.format_string(SEPARATOR, when), n))


def appended(content: Column, text: Column) -> Column:
    """Content, a newline if it lacks one at its end, and the text."""
    return F.concat(content, F.when(content.endswith("\n") | (content == ""), "").otherwise("\n"), text)


def updated(old: Column, new: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def merge_changes(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, path, description) of (key, seq, path, description): one row a path, its distinct descriptions in
    order of appearance, joined by '; '."""
    first = rows.groupBy(key, "path", "description").agg(F.min("seq").alias("seq"))
    return first.groupBy(key, "path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "description"))), lambda x: x["description"]), "; ").alias("description")
    )


def first_by(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by order."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def merge_related(rows: DataFrame, key: str = "key") -> DataFrame:
    """Related notes by the first eight characters of their id; the longest id of each stays."""
    return first_by(rows.withColumn("short", id8(F.col("id"))), [key, "short"], F.desc(F.length("id")), F.col("seq")).drop("short")


def merge_problems(rows: DataFrame, key: str = "key") -> DataFrame:
    """Problems by their text; the first of each stays."""
    return first_by(rows, [key, "problem"], F.col("seq"))


def merge_sections(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, name, content) of (key, seq, name, content, updated): sections by name without regard to case; the first
    spelling stays and differing contents follow one another, each after a line that dates it."""
    named = rows.withColumn("low", F.lower("name"))
    once = named.groupBy(key, "low", "content").agg(F.min(F.struct("seq", "name", "updated")).alias("at"))
    texts = F.sort_array(F.collect_list(F.struct("at", "content")))
    dated = F.transform(texts, lambda x, i: F.when(i == 0, x["content"]).otherwise(F.concat(F.format_string(SEPARATOR, x["at"]["updated"]), x["content"])))
    return once.groupBy(key, "low").agg(F.min("at").getField("name").alias("name"), F.array_join(dated, "").alias("content")).drop("low")


def updated_at(created: Column, date: Column) -> Column:
    """The minute that a separator names."""
    return F.coalesce(F.date_format(created, "yyyy-MM-dd HH:mm"), date, F.lit("unknown"))


def _is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def session_targets(sessions: DataFrame) -> DataFrame:
    """(id, key): which session each report belongs to. Ids are unique; of a column `stored`, if there is one, the rows
    that are true stand in the store already and come first.

    Reports with one session id are one session, as are reports without id of one date, project and branch. A report
    whose session id is new while a session without id of its date, project and branch exists joins that one, as do
    those after it until one finds none; from then on its id has a session of its own.
    """
    stored = F.col("stored") if "stored" in sessions.columns else F.lit(False)
    day = F.concat_ws("\x1f", F.lit("day"), *(F.coalesce(F.col(c), F.lit("")) for c in ("date", "project", "branch")))
    rows = sessions.select("id", day.alias("day"), "session_id", _is_blank(F.col("session_id")).alias("blank"), stored.alias("stored"), F.struct((~stored).alias("new"), "created", "id").alias("seq"))
    legacy = rows.where("blank").groupBy("day").agg(F.min("seq").alias("legacy"))
    known = rows.join(legacy, "day", "left").withColumn("joins", ~F.col("stored") & F.coalesce(F.col("legacy") < F.col("seq"), F.lit(False)))
    own = known.where("not blank").groupBy("session_id").agg(F.min(F.when(~F.col("joins"), F.col("seq"))).alias("own"))
    placed = known.join(own, "session_id", "left")
    apart = ~F.col("blank") & F.coalesce(F.col("seq") >= F.col("own"), F.lit(False))
    return placed.select("id", F.when(apart, F.concat(F.lit("id\x1f"), "session_id")).otherwise(F.col("day")).alias("key"))


def _merged_list(keyed: DataFrame, name: str) -> DataFrame:
    """(key, name): the list of structs `name` of all reports of a key, merged by its kind, in order of appearance."""
    merge, by = {
        "changes": (merge_changes, F.col("path")), "problems": (merge_problems, F.col("problem")),
        "related_notes": (merge_related, id8(F.col("id"))), "extra_sections": (merge_sections, F.lower("name")),
    }[name]
    fields = keyed.schema[name].dataType.elementType.names
    rows = keyed.select("key", F.struct("new", "created", "id").alias("s"), "updated", F.posexplode(name).alias("at", "c")).where("c is not null")
    rows = rows.select("key", F.struct("s.new", "s.created", "s.id", "at").alias("seq"), "updated", "c.*")
    places = rows.groupBy("key", by.alias("by")).agg(F.min("seq").alias("place")).withColumnRenamed("key", "k")
    merged = merge(rows).withColumn("_by", by)
    placed = merged.join(places, (F.col("key") == F.col("k")) & F.col("_by").eqNullSafe(F.col("by")))
    items = F.sort_array(F.collect_list(F.struct("place", F.struct(*fields).alias("c"))))
    return placed.groupBy("key").agg(F.transform(items, lambda x: x["c"]).alias(name))


SESSION_LISTS = ("changes", "problems", "related_notes", "extra_sections")


def merge_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session (session_targets), in the columns of sessions, with key, updated and n_reports.

    The first report, by created, gives id, type, date, branch, project, session_id and created, the last one updated
    and, unless it is empty, the title; tags unite with the newest first. Texts follow one another, each after a line
    that dates it; decisions, insights, questions and next steps unite in order; changes, problems, related notes and
    extra sections, where the table has them, are merged by path, problem, id and name. A key's reports are merged by
    ordered lists, so nothing but the reports of one session ever meets in a row. Nulls count as empty.
    """
    stored = F.col("stored") if "stored" in sessions.columns else F.lit(False)
    keyed = sessions.withColumns({"new": ~stored, "updated": updated_at(F.col("created"), F.col("date"))}).join(session_targets(sessions), "id")
    keyed = cut(keyed, "reports")
    first = [c for c in ("type", "date", "branch", "project", "session_id") if c in sessions.columns]
    order = F.struct("new", "created", "id", "updated", *first, "title", "tags", "summary", "what_happened", "decisions", "insights", "questions", "next_steps")
    grouped = keyed.groupBy("key").agg(F.sort_array(F.collect_list(order)).alias("r"), F.count("*").alias("n_reports"))

    def texts(name: str) -> Column:
        def add(text: Column, x: Column) -> Column:
            more = F.coalesce(x[name], F.lit(""))
            return F.when(more == "", text).when(text == "", more).otherwise(F.concat(text, F.format_string(SEPARATOR, x["updated"]), more))

        return F.aggregate("r", F.lit(""), add)

    union = lambda name: F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x[name], F.array()))))
    newest_tags = F.flatten(F.transform(F.reverse("r"), lambda x: F.coalesce(x["tags"], F.array())))
    titled = F.filter("r", lambda x: ~_is_blank(x["title"]))
    merged = grouped.select(
        "key", F.col("r")[0]["id"].alias("id"), *(F.col("r")[0][c].alias(c) for c in first),
        F.when(F.size(titled) > 0, F.element_at(titled, -1)["title"]).alias("title"), "n_reports",
        F.col("r")[0]["created"].alias("created"), F.array_max(F.transform("r", lambda x: x["created"])).alias("updated"),
        tag_union(newest_tags, F.array().cast("array<string>")).alias("tags"),
        texts("summary").alias("summary"), texts("what_happened").alias("what_happened"),
        *(union(c).alias(c) for c in ("decisions", "insights", "questions", "next_steps")),
    )
    for name in SESSION_LISTS:
        if name in sessions.columns:
            merged = merged.join(_merged_list(keyed, name), "key", "left").withColumn(name, F.coalesce(name, F.array()))
    return merged


def _fold_key(new: Column, created: Column, id: Column) -> Column:
    """A string that sorts as (new, created, id), nulls first: a digit, nineteen digits, the id."""
    at = F.unix_micros(created.cast("timestamp")) + F.lit(1 << 62)
    return F.concat(F.when(new, "1").otherwise("0"), F.coalesce(F.lpad(at.cast("string"), 19, "0"), F.lit("0" * 19)), id)


def _best_joined(rows: DataFrame, standing: DataFrame) -> DataFrame:
    """best_standing by joins, for any number of standing notes."""
    flags = lambda df, bit: df.select("category", "key", "words", F.lit(bit).alias("flags"))
    both = flags(rows, 2).unionByName(flags(standing, 1)).groupBy("key").agg(F.first("category").alias("category"), F.first("words").alias("words"), F.sum("flags").cast("int").alias("flags"))
    links = overlapping(both, LEAST_OVERLAP, 3)
    links = links.select(F.col("class_a").alias("key"), F.col("class_b").alias("target"), "overlap").unionByName(links.select(F.col("class_b").alias("key"), F.col("class_a").alias("target"), "overlap"))
    links = links.where("target < key").join(standing.select(F.col("key").alias("target")), "target", "left_semi")
    same = rows.join(standing.select("category", "title", F.col("key").alias("target")), ["category", "title"]).where("target < key").select("key", "target", F.lit(2.0).alias("overlap"))
    best = links.unionByName(same).groupBy("key").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "target")).getField("target").alias("target"))
    return rows.join(best, "key", "left")


def best_standing(rows: DataFrame, standing: DataFrame, most_broadcast: int) -> DataFrame:
    """rows (category, key, title, words) with target: the earlier one of `standing` (the same columns) that has its
    title or else, of those that overlap by at least half, overlaps most; the first of equals; null if there is none.
    Standing notes are broadcast up to `most_broadcast`; then nothing is shuffled."""
    held = standing.select("category", "key", "title", "words").limit(most_broadcast + 1).toArrow()
    if not len(held):
        return rows.withColumn("target", F.lit(None).cast("string"))
    if len(held) > most_broadcast:
        return _best_joined(rows, standing)
    known = rows.sparkSession.sparkContext.broadcast(held)
    return rows.select("category", "key", "title", "words").mapInArrow(best_of(known, LEAST_OVERLAP), "category string, key string, title string, words array<string>, target string")


def _survivors(rows: DataFrame) -> DataFrame:
    """Of rows (category, key, title, words) those that stand if they are added one by one to none. Only the first of
    each set of words can; whether it does depends on earlier similar ones only, so all whose earlier neighbours are
    decided are decided at once, round by round, each a few joins of keys."""
    first = F.min(F.struct("key", "title")).alias("first")
    firsts = rows.groupBy("category", "words").agg(first).select("category", F.col("first.key").alias("key"), F.col("first.title").alias("title"), "words")
    firsts = cut(firsts, "firsts")
    edges = cut(overlapping(firsts.withColumn("flags", F.lit(0)), LEAST_OVERLAP).select(F.col("class_a").alias("early"), F.col("class_b").alias("late")), "edges")
    undecided = cut(edges.select(F.explode(F.array("early", "late")).alias("c")).distinct(), "undecided")
    out = firsts.join(undecided.withColumnRenamed("c", "key"), "key", "left_anti").select("key")
    while not undecided.isEmpty():
        decided = cut(undecided.join(edges.select(F.col("late").alias("c")).distinct(), "c", "left_anti"), "standing")
        gone = edges.join(decided.withColumnRenamed("c", "early"), "early", "left_semi").select(F.col("late").alias("c")).distinct()
        undecided = cut(undecided.join(decided.unionByName(gone), "c", "left_anti"), "undecided")
        is_open = lambda side: undecided.withColumnRenamed("c", side)
        edges = cut(edges.join(is_open("early"), "early", "left_semi").join(is_open("late"), "late", "left_semi"), "open")
        out = out.unionByName(decided.withColumnRenamed("c", "key"))
    return firsts.join(out, "key", "left_semi").select("category", "key", "title", "words")


def _fold_bounds(keys: DataFrame, first_round: int) -> list[str]:
    """Keys that part all keys in order into rounds, the first of about `first_round` and each eight times as long as
    all before; found in up to about 10,000 of the keys, since any bounds are right."""
    total = keys.count()
    share = max(1, total // 10_000)
    some = sorted(r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).collect())
    ends, size = [], first_round
    while size < total and size // share < len(some):
        ends.append(some[size // share])
        size *= 9
    return ends


def fold_notes(notes: DataFrame, stored: DataFrame | None = None, first_round: int = 5000, most_broadcast: int = 50_000) -> DataFrame:
    """(id, into, how): what adding notes one after another, by created and id, does with each: 'created', 'merged'
    into a note of the same category and title, or 'merged' into the note of its category whose title words overlap
    most, by at least half, the earliest of equals. Notes in `stored` are there from the start. A null title is one
    without words, a null category one of its own; ids are unique.

    Notes go in rounds, each many times as long as all before. Those that a standing note takes drop out first, so
    few pairs are left where notes are similar: a round links only what none before it took, and which of these stand
    is decided by joins of keys. At the end every note is held against those that stand. Titles of fewer than two
    words merge with equal ones only.
    """
    select = lambda df, new: df.select(_fold_key(F.lit(new), F.col("created"), F.col("id")).alias("key"), F.coalesce(F.concat(F.lit("="), "category"), F.lit("")).alias("category"), F.coalesce("title", F.lit("")).alias("title"))
    rows = select(notes, True) if stored is None else select(stored, False).unionByName(select(notes, True))
    rows = cut(rows.withColumn("words", title_words(F.col("title"))), "titles")
    is_new = F.col("key").startswith("1")

    plain = rows.where(F.size("words") < 2)
    firsts = plain.groupBy("category", "title").agg(F.min("key").alias("into"))
    by_title = plain.where(is_new).join(firsts, ["category", "title"]).select("key", "into")

    worded = rows.where(F.size("words") >= 2)
    standing, new = worded.where(~is_new), worded.where(is_new)
    bounds = _fold_bounds(new.select("key"), first_round)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = new.where((F.lit(True) if low is None else F.col("key") >= low) & (F.lit(True) if high is None else F.col("key") < high))
        left = cut(best_standing(part, standing, most_broadcast).where("target is null").drop("target"), "left")
        standing = cut(standing.unionByName(_survivors(left)), "standing")
    by_words = best_standing(new, standing, most_broadcast).select("key", F.coalesce("target", "key").alias("into"))
    how = F.when(F.col("key") == F.col("into"), "created").otherwise("merged")
    id = lambda c: F.substr(F.col(c), F.lit(21))
    return by_title.unionByName(by_words).select(id("key").alias("id"), id("into").alias("into"), how.alias("how"))


def merge_notes(notes: DataFrame, placed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The notes that come of adding `notes`, placed by fold_notes: new ones and those of `stored` that others were
    merged into. Contents that differ follow one another, each after a line that dates it, tags unite, later metadata
    that is not empty wins, and updated is that of the last. Other columns are the first note's."""
    own = ["title", "content", "tags", "category", "type", F.map_entries("metadata").alias("metadata")]  # maps have no order
    order = F.struct("created", "id", "updated", *own)
    grouped = notes.join(placed, "id").groupBy("into").agg(F.sort_array(F.collect_list(order)).alias("r")).withColumnRenamed("into", "id")
    base = F.filter("r", lambda x: x["id"] == F.col("id"))[0]
    if stored is not None:
        old = F.struct("created", "id", "updated", *own).alias("old")
        grouped = grouped.join(stored.select(F.col("id").alias("old_id"), old), F.col("id") == F.col("old_id"), "left").drop("old_id")
        base = F.coalesce("old", base)
    rest = F.filter("r", lambda x: x["id"] != F.col("id"))
    content = F.aggregate(rest, F.coalesce(base["content"], F.lit("")), lambda text, x: content_union(text, x["content"], updated_at(x["updated"], F.lit(None).cast("string"))))
    tags = F.flatten(F.concat(F.array(F.coalesce(base["tags"], F.array())), F.transform(rest, lambda x: F.coalesce(x["tags"], F.array()))))
    none = F.create_map().cast("map<string,string>")
    metadata = F.aggregate(rest, F.coalesce(F.map_from_entries(base["metadata"]), none), lambda m, x: metadata_union(m, F.map_from_entries(x["metadata"])))
    updated = F.when(F.size(rest) > 0, F.element_at(rest, -1)["updated"]).otherwise(base["updated"])
    empty = F.array().cast("array<string>")
    return grouped.select("id", base["type"].alias("type"), base["category"].alias("category"), base["title"].alias("title"), content.alias("content"), tag_union(tags, empty).alias("tags"), base["created"].alias("created"), updated.alias("updated"), metadata.alias("metadata"))
