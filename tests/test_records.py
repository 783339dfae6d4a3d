from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import capture, dedup, graph, integrity, outline, stats, validate


def test_tag_union(one):
    union = lambda a, b: one(dedup.tag_union, a=a, b=b)
    assert union(["API", "rest"], ["api", "Auth"]) == ["API", "rest", "Auth"]
    assert union([" x ", ""], ["X"]) == ["x"]


def test_text_and_metadata_unions(spark, one):
    assert one(lambda a, b: dedup.text_union(a, b, F.lit("T")), a="x", b="x") == "x\n\n--- Updated T ---\nx"
    assert one(lambda a, b: dedup.text_union(a, b, F.lit("T")), a="", b="y") == "y"
    assert one(lambda a, b: dedup.content_union(a, b, F.lit("T")), a="x", b="x") == "x"
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": ""})], "o map<string,string>, n map<string,string>")
    assert rows.select(dedup.metadata_union(F.col("o"), F.col("n")).alias("m")).first()["m"] == {"a": "1", "b": "3"}
    assert one(dedup.appended, a="x", b="y") == "x\ny" and one(dedup.updated, a="x", b="") == "x"


def test_merges(spark):
    changes = spark.createDataFrame([("k", 1, "p", "a"), ("k", 2, "p", "b"), ("k", 3, "p", "a"), ("k", 4, "q", "c")], "key string, seq int, path string, description string")
    assert {(r["path"], r["description"]) for r in dedup.merge_changes(changes).collect()} == {("p", "a; b"), ("q", "c")}
    related = spark.createDataFrame([("k", 1, "12345678"), ("k", 2, "12345678-full"), ("k", 3, "other123")], "key string, seq int, id string")
    assert {r["id"] for r in dedup.merge_related(related).collect()} == {"12345678-full", "other123"}
    sections = spark.createDataFrame([("k", 1, "Map", "a", "T1"), ("k", 2, "map", "b", "T2"), ("k", 3, "MAP", "a", "T3")], "key string, seq int, name string, content string, updated string")
    assert [tuple(r) for r in dedup.merge_sections(sections).select("name", "content").collect()] == [("Map", "a\n\n--- Updated T2 ---\nb")]


def test_session_merge(spark, folder):
    from lorekeep.sources.corpus import sessions

    rows = sessions(spark, folder)
    merged = dedup.merge_sessions(rows)
    assert merged.agg(F.sum("n_reports")).first()[0] == rows.count()
    assert merged.select("key").distinct().count() == merged.count()


TITLES = [
    ("1", "c", "TikTok API Rate Limits"), ("2", "c", "TikTok API Limits"), ("3", "c", "Python Testing Framework"), ("4", "c", "JavaScript DOM Manipulation"),
    ("5", "c", "OAuth Token Refresh Flow"), ("6", "c", "OAuth Token Validation Process"), ("7", "d", "TikTok API Rate Limits"), ("8", "c", "TikTok API Rate Limits"),
    ("9", "c", "One"), ("10", "c", None),
]


def test_similar_titles(spark):
    rows = spark.createDataFrame(TITLES, "id string, category string, title string")
    pairs = {(r["class_a"], r["class_b"]) for r in dedup.similar_titles(rows).collect()}
    assert pairs == {("1", "2"), ("5", "6")}


def test_similar_titles_against_all_pairs(spark, folder):
    from lorekeep.functions.text import TITLE_STOP_WORDS
    from lorekeep.sources.corpus import notes

    rows = notes(spark, folder)
    sets = {}
    for r in rows.select("id", "category", "title").collect():
        words = frozenset(w for w in (r["title"] or "").lower().split() if len(w.encode()) >= 3 and w not in TITLE_STOP_WORDS)
        if len(words) >= 2:
            key = (r["category"], words)
            sets[key] = min(sets.get(key, r["id"]), r["id"])
    items = [(c, w, i) for (c, w), i in sets.items()]
    brute = {
        (min(i, j), max(i, j))
        for n, (c, w, i) in enumerate(items)
        for d, v, j in items[n + 1 :]
        if c == d and 2 * len(w & v) >= min(len(w), len(v))
    }
    assert {(r["class_a"], r["class_b"]) for r in dedup.similar_titles(rows).collect()} == brute


def test_fold(spark):
    rows = [(i, c, t, datetime(2025, 1, int(i))) for i, c, t in TITLES if t]
    folded = {r["id"]: (r["into"], r["how"]) for r in dedup.fold_notes(spark.createDataFrame(rows, "id string, category string, title string, created timestamp")).collect()}
    assert folded["2"] == ("1", "merged") and folded["8"] == ("1", "merged") and folded["7"] == ("7", "created")
    assert folded["4"] == ("4", "created") and folded["6"] == ("5", "merged") and len(folded) == len(rows)


def fold_one_by_one(rows, stored=()):
    """The rule as it reads: each note against all that stand, exact titles first, then the most similar."""
    from lorekeep.functions.text import TITLE_STOP_WORDS

    words = lambda t: frozenset(w for w in (t or "").lower().split() if len(w.encode()) >= 3 and w not in TITLE_STOP_WORDS)
    order = lambda r: (r[3] is not None, r[3], r[0])
    standing, out = sorted(stored, key=order), {}
    for r in sorted(rows, key=order):
        into = next((x[0] for x in standing if x[1] == r[1] and (x[2] or "") == (r[2] or "")), None)
        best, own = 0, words(r[2])
        if into is None and len(own) >= 2:
            for x in standing:
                theirs = words(x[2])
                if x[1] == r[1] and len(theirs) >= 2 and (overlap := len(own & theirs) / min(len(own), len(theirs))) >= 0.5 and overlap > best:
                    best, into = overlap, x[0]
        out[r[0]] = into or r[0]
        if into is None:
            standing.append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_one_by_one(spark, seed):
    import random

    rng = random.Random(seed)
    title = lambda: " ".join(rng.choice(["Retry", "queue", "drain", "cache", "replica", "index", "token", "lag", "a"]) for _ in range(rng.randrange(1, 5)))
    note = lambda i, day: (f"n{i:03}", rng.choice("cd"), rng.choice([title(), title(), None, "One", ""]), rng.choice([datetime(2025, 1, day), None]))
    schema = "id string, category string, title string, created timestamp"
    stored = [r for r in (note(i, 1) for i in range(900, 912))]
    keep = fold_one_by_one(stored)
    stored = [r for r in stored if keep[r[0]] == r[0]]
    rows = [note(i, rng.randrange(1, 28)) for i in range(120)]
    for old in ([], stored):
        frame = spark.createDataFrame(old, schema) if old else None
        got = {r["id"]: r["into"] for r in dedup.fold_notes(spark.createDataFrame(rows, schema), frame).collect()}
        assert got == fold_one_by_one(rows, old)


def test_reports_find_their_session(spark):
    """By session id, by day, and into a session without id that was there first."""
    rows = [
        ("a", "s1", "d1", 1), ("b", "s1", "d2", 5), ("c", "", "d1", 2), ("d", None, "d1", 9), ("e", "s2", "d1", 3), ("f", "s2", "d3", 4), ("g", "s2", "d1", 6), ("h", "s3", "d9", 1),
    ]
    frame = spark.createDataFrame([(i, s, d, None, "b", datetime(2025, 1, n)) for i, s, d, n in rows], "id string, session_id string, date string, project string, branch string, created timestamp")
    key = {r["id"]: r["key"] for r in dedup.session_targets(frame).collect()}
    assert key["a"] == key["b"] == "id\x1fs1" and key["c"] == key["d"] == key["e"] and key["f"] == key["g"] == "id\x1fs2" and key["h"] == "id\x1fs3"
    assert key["e"].startswith("day") and len(key) == len(rows)


def test_graph(spark):
    n = spark.createDataFrame(
        [("aaaaaaaa-1", "T1", "c", {"session_id": "s"}), ("bbbbbbbb-1", 'T"2', "c", {}), ("cccccccc-1", "T3", "c", None)],
        "id string, title string, category string, metadata map<string,string>",
    )
    related = [("AAAAAAAA-1",), ("bbbbbbbb",), ("dddddddd",), (None,)]
    s = spark.createDataFrame(
        [("99999999-1", "S", "2025-01-01", "s", datetime(2025, 1, 1), related), ("88888888-1", "S2", "2025-01-02", "s", datetime(2025, 1, 2), None)],
        "id string, title string, date string, session_id string, created timestamp, related_notes array<struct<id:string>>",
    )
    edges = {tuple(r) for r in graph.edges(n, s).collect()}
    assert edges == {("aaaaaaaa", "88888888", "from_session"), ("99999999", "aaaaaaaa", "related"), ("99999999", "bbbbbbbb", "related")}
    assert graph.nodes(n, s).count() == 5
    lines = [r["line"] for r in graph.dot_lines(graph.nodes(n, s), graph.edges(n, s)).collect()]
    assert any('T\\"2' in x for x in lines) and len(lines) == 8


def test_access_counts(spark):
    log = spark.createDataFrame([("A ", "10"), ("a", "20"), ("gone", "2024-01-01T00:00:00Z"), (None, "1"), ("", "1"), ("a", "soon")], "entry_id string, accessed_at string")
    entries = spark.createDataFrame([("a", "T", "note")], "id string, title string, type string")
    rows = {r["entry_id"]: tuple(r)[1:] for r in stats.access_counts(log, entries).collect()}
    assert rows == {"a": ("T", "note", 3, 20_000_000), "gone": ("(deleted)", "unknown", 1, 1_704_067_200_000_000)}


def test_integrity(spark):
    entries = spark.createDataFrame([("a", "x.md"), ("b", "./y.md"), ("c", "gone.md"), ("d", None)], "id string, filepath string")
    files = spark.createDataFrame([("x.md", None), ("y.md", None), ("gone.md", datetime(2025, 1, 1)), ("z.md", None)], "filepath string, removed_at timestamp")
    assert {r["id"] for r in integrity.entries_without_file(entries, files).collect()} == {"c", "d"}
    assert {r["path"] for r in integrity.files_without_entry(entries, files).collect()} == {"z.md"}
    assert {r["id"] for r in integrity.without_orphans(entries, files).collect()} == {"a", "b"}
    vectors = spark.createDataFrame([("A", "t", "t"), ("q", "t", "t")], "doc_id string, backend string, model string")
    docs = spark.createDataFrame([("a", "note"), ("n", "note")], "id string, type string")
    row = integrity.health(entries, files, docs, vectors, "t", "t").first()
    assert (row["n_files"], row["n_entries"], row["n_orphan_vectors"], row["n_unindexed"], row["healthy"]) == (3, 4, 1, 1, False)


def test_limits(spark):
    rows = [("ok", "c", ["t"], "cat"), ("x" * 501, "c", [], "cat"), ("x" * 500, "c", ["t"] * 51, "a/b"), (" ", None, None, ".."), ("t", "c", ["y" * 101], None)]
    frame = spark.createDataFrame(rows, "title string, content string, tags array<string>, category string")
    found = [r[0] for r in frame.select(validate.violations(*(F.col(c) for c in ("title", "content", "tags", "category")))).collect()]
    assert found == [[], ["title too long"], ["too many tags", "category not a path part"], ["title empty", "category not a path part"], ["tag too long", "category not a path part"]]


def test_report_checks(spark):
    rows = [
        ("good", "w " * 100, "1. a\n 2. b\n3. c", [("p", "s")], ["i"], ["n"]),
        ("bad", "few words", "1. a\nb", [("p", " ")], [], None),
        ("null", None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "id string, summary string, what_happened string, problems array<struct<problem:string,solution:string>>, insights array<string>, next_steps array<string>")
    passed = {}
    for r in validate.validated(frame).collect():
        passed.setdefault(r["id"], []).append(r["passed"])
    assert passed == {"good": [True] * 5, "bad": [False] * 5, "null": [False, False, True, False, False]}


def test_sections(one):
    got = one(validate.sections, t="intro\n## A\none\n\n## B\n two \n## A\nlast\n")
    assert {k: v.strip() for k, v in got.items()} == {"A": "last", "B": "two"}


def test_capture(spark):
    lines = [('{"tool_name": "Bash", "output": "running the suite\\n3 tests FAILED"}',), ("no json",), ('{"tool_name": "Read", "output": "error error error error"}',)]
    got = capture.observations(capture.hook_rows(spark.createDataFrame(lines, "value string"))).collect()
    assert [r["content"] for r in got] == ["3 tests FAILED"]
    at = lambda m: datetime(2025, 1, 1, 0, m)
    rows = spark.createDataFrame([(1, "k", at(0)), (2, "k", at(4)), (3, "k", at(9)), (4, "j", at(4))], "i int, key string, at timestamp")
    assert {r["i"] for r in capture.first_in_window(rows, ["key"]).collect()} == {1, 3, 4}


SOURCES = {
    "a.go": "package x\nfunc (s *Store) Get(id string) error {\nfunc main() {\ntype T struct {\ntype I interface {\nvar x int\n",
    "b.py": "class A(B):\n    def m(self):\n    async def n(self):\ndef f():\nX = 1\n",
    "c.ts": "export default class C {\nexport const k = 1\nconst f = (a) => a\nfunction g(x) {\ninterface I {\n",
    "d.rs": "pub fn run() {\nstruct S {\nimpl<T> S {\npub trait Q {\n",
    "e.txt": "func main() {\n",
}


def test_outline(spark):
    rows = outline.outline(spark.createDataFrame(list(SOURCES.items()), "path string, content string")).orderBy("path", "line").collect()
    names = {p: [(r["line"], r["kind"], r["name"]) for r in rows if r["path"] == p] for p in SOURCES}
    assert names["a.go"] == [
        (2, "method", "(s Store) Get()"), (3, "function", "main()"), (4, "struct", "type T struct"), (5, "interface", "type I interface"), (6, "var", "var x"),
    ]
    assert [n for _, _, n in names["b.py"]] == ["class A", "method m()", "async method n()", "f()", "X"]
    assert [n for _, _, n in names["c.ts"]] == ["class C", "k", "f()", "g()", "interface I"]
    assert [n for _, _, n in names["d.rs"]] == ["pub fn run()", "struct S", "impl S", "pub trait Q"]
    assert names["e.txt"] == []


@pytest.mark.parametrize("name", ["context", "health_report", "top_tags"])
def test_registered(spark, folder, name):
    from lorekeep.plans import record_queries

    assert record_queries.queries()[name](spark, folder).count() > 0


def test_merged_sessions_keep_their_lists_of_structs(spark):
    lists = "changes array<struct<path:string,description:string>>, problems array<struct<problem:string,solution:string>>, related_notes array<struct<id:string,title:string,category:string>>, extra_sections array<struct<name:string,content:string>>"
    plain = "id string, session_id string, date string, project string, branch string, created timestamp, title string, tags array<string>, summary string, what_happened string, decisions array<string>, insights array<string>, questions array<string>, next_steps array<string>, "
    same = ["2025", "p", "b"]
    blank = ["t", None, None, None, None, None, None, None]
    rows = [
        ("1", "s", *same, datetime(2025, 1, 1), *blank, [("z", "one"), ("a", "x")], [("p", "first")], [("12345678", "n", "c")], [("Map", "m")]),
        ("2", "s", *same, datetime(2025, 1, 2), *blank, [("z", "two"), ("z", "one")], [("p", "later"), ("q", "s")], [("12345678-full", "n", "c")], [("map", "k"), ("New", "n")]),
        ("3", "other", *same, datetime(2025, 1, 1), *blank, None, [], None, None),
    ]
    got = {r["id"]: r for r in dedup.merge_sessions(spark.createDataFrame(rows, plain + lists)).collect()}
    assert [tuple(x) for x in got["1"]["changes"]] == [("z", "one; two"), ("a", "x")]
    assert [tuple(x) for x in got["1"]["problems"]] == [("p", "first"), ("q", "s")]
    assert [x["id"] for x in got["1"]["related_notes"]] == ["12345678-full"]
    assert [tuple(x) for x in got["1"]["extra_sections"]] == [("Map", "m\n\n--- Updated 2025-01-02 00:00 ---\nk"), ("New", "n")]
    assert got["3"]["changes"] == got["3"]["problems"] == got["3"]["related_notes"] == got["3"]["extra_sections"] == []
