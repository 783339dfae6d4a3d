from datetime import date, datetime

import pytest

from lorekeep.api import Memory
from lorekeep.operators.embed import HashEmbedder
from lorekeep.operators.keyword import Facets

NOTE = "id string, type string, category string, title string, content string, tags array<string>, created timestamp, updated timestamp, metadata map<string,string>"
SESSION = (
    "id string, type string, title string, date string, branch string, project string, session_id string, tags array<string>, created timestamp, summary string, "
    "what_happened string, decisions array<string>, changes array<struct<path:string,description:string>>, problems array<struct<problem:string,solution:string>>, "
    "insights array<string>, questions array<string>, next_steps array<string>, related_notes array<struct<id:string,title:string,category:string>>, "
    "extra_sections array<struct<name:string,content:string>>"
)


def note(i, category, title, content, tags, day, session=""):
    at = datetime(2025, 6, day)
    return (i, "note", category, title, content, tags, at, at, {"session_id": session} if session else {})


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = Memory(spark, f"file://{tmp_path_factory.mktemp('memory')}", HashEmbedder(32))
    rows = [
        note("a1", "how-to", "Login tokens", "refresh the login token before it ends", ["auth"], 1, "20250601-1"), note("b2", "how-to", "Queue drain", "drain the retry queue", ["queue"], 20),
        note("c3", "ideas", "Token cache", "cache each token for a day", ["auth", "cache"], 28), note("d4", "", "Bad", "category is empty", [], 1),
    ]
    how = {r["id"]: r["how"] for r in m.add_notes(spark.createDataFrame(rows, NOTE)).collect()}
    assert how == {"a1": "created", "b2": "created", "c3": "created", "d4": "refused"}
    s = ("s1", "session", "Fixed login", "2025-06-29", "fix/login", "web", "20250601-1", ["auth"], datetime(2025, 6, 29, 10), "login works", "1. a", ["d"], [("x.py", "y")], [("p", "q")], ["i"], [], ["n"], [("a1", "t", "c")], [])
    assert [tuple(r) for r in m.save_sessions(spark.createDataFrame([s], SESSION)).collect()] == [("s1", "s1", "created")]
    m.reindex("2025-06-30T00:00:00Z")
    return m


def ids(rows, column="id"):
    return [r[column] for r in rows.collect()]


def test_searches(memory):
    assert set(ids(memory.search("token"))) == {"a1", "c3"}
    assert ids(memory.search("token", Facets(category="ideas"))) == ["c3"]
    assert ids(memory.search_notes("token", tags=("CACHE",))) == ["c3"]
    assert ids(memory.search_sessions("login", branch="fix", days="7d", today=date(2025, 6, 30))) == ["s1"]
    assert ids(memory.semantic("drain the retry queue"))[0] == "b2"
    assert set(ids(memory.hybrid("token"))) >= {"a1", "c3"}
    with pytest.raises(ValueError):
        memory.search(" ")


def test_tfidf_without_embedder(spark, memory):
    assert ids(Memory(spark, memory.root).semantic("drain retry"))[0] == "b2"


def test_lists_and_lookups(memory):
    assert ids(memory.notes("how-to")) == ["a1", "b2"] and ids(memory.note("c")) == ["c3"] and ids(memory.session("s")) == ["s1"]
    assert ids(memory.note_by_title("ideas", "token")) == ["c3"] and ids(memory.note_by_title("ideas", "token-cache")) == ["c3"] and ids(memory.note_by_title("how-to", "Queue drain")) == ["b2"]
    assert ids(memory.categories(), "category") == ["how-to", "ideas"] and ids(memory.tags(), "tag") == ["auth", "cache", "queue"]
    assert [(r["category"], r["titles"]) for r in memory.notes_by_category().collect()] == [("how-to", ["Login tokens", "Queue drain"]), ("ideas", ["Token cache"])]
    assert ids(memory.sessions(days="2025-06-01..2025-06-30")) == ["s1"] and ids(memory.notes_of_session("20250601-1")) == ["a1"]
    nodes, edges = memory.graph()
    assert nodes.count() == 4 and {tuple(r) for r in edges.collect()} == {("a1", "s1", "from_session"), ("s1", "a1", "related")}
    notes, sessions, totals = memory.context(2)
    assert ids(notes) == ["c3", "b2"] and ids(sessions) == ["s1"] and {r["type"]: r["n"] for r in totals.collect()} == {"note": 3, "session": 1}
    assert {k: v.count() for k, v in memory.stats().items()} == {"by_type": 2, "by_category": 2, "top_tags": 3, "recent": 4}


def test_session_labels(memory):
    assert memory.resolve_session("web", datetime(2025, 6, 29, 12)) == "20250601-1"
    assert memory.resolve_session("web", datetime(2025, 6, 29, 20)).startswith("20250629-200000-")


def test_access(memory):
    memory.log_access(memory.note("a1"), "get", "2025-06-30T00:00:00Z")
    memory.log_access(memory.note("a1"), "get", "2025-06-30T00:00:01Z")
    assert [(r["entry_id"], r["title"], r["n_accesses"]) for r in memory.top_accessed().collect()] == [("a1", "Login tokens", 2)]


def test_changes_and_repair(spark, memory, tmp_path):
    assert memory.verify().first()["in_sync"]
    memory.append("b2", "more")
    memory.update("b2", title="Drain")
    row = memory.note("b2").first()
    assert (row["title"], row["content"]) == ("Drain", "drain the retry queue\nmore")
    with pytest.raises(ValueError):
        memory.update("b2")
    hook = spark.createDataFrame([('{"tool_name": "Bash", "output": "running the suite\\n3 tests FAILED"}',)], "value string")
    assert [r["how"] for r in memory.observe(hook, datetime(2025, 6, 30)).collect()] == ["created"]
    memory.delete("a1")
    assert "a1" not in ids(memory.store.read("vectors"), "doc_id") and memory.verify().first()["in_sync"]
    memory.store.delete("entries", spark.createDataFrame([("b2",)], "id string"), ["id"])
    assert not memory.verify().first()["in_sync"]
    assert memory.repair("2025-07-01T00:00:00Z").first()["in_sync"]
    memory.export_files(str(tmp_path))
    assert sum(1 for _ in tmp_path.rglob("*.md")) == 4
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "a-note.md").write_text("text of the note")
    assert [r["how"] for r in memory.import_notes(str(tmp_path / "new")).collect()] == ["created"]


def test_what_is_saved_is_found(spark, tmp_path):
    """Notes, changes and reports saved after reindex() are in the index at once; a second report is merged."""
    m = Memory(spark, f"file://{tmp_path}/m", HashEmbedder(16))
    m.add_notes(spark.createDataFrame([note("a1", "how-to", "Login tokens", "refresh the login token", ["auth"], 1)], NOTE))
    report = lambda i, day, text, **c: (i, "session", "Work", f"2025-06-{day}", "main", "web", "label", ["x"], datetime(2025, 6, day), text, "", [f"d{i}"], [], [], [], [], [], [], [])
    m.save_sessions(spark.createDataFrame([report("s1", 10, "first summary")], SESSION))
    m.reindex("2025-06-30T00:00:00Z")
    assert {tuple(r) for r in m.add_notes(spark.createDataFrame([note("b2", "ideas", "Queue drain", "drain the retry queue", [], 2), note("c3", "how-to", "Login tokens", "rotate them", ["key"], 3)], NOTE)).collect()} == {("b2", "b2", "created"), ("c3", "a1", "merged")}
    assert [tuple(r) for r in m.save_sessions(spark.createDataFrame([report("s2", 11, "second summary")], SESSION)).collect()] == [("s2", "s1", "merged")]
    assert ids(m.search("retry")) == ["b2"] and ids(m.search("rotate")) == ["a1"] and ids(m.search("second")) == ["s1"] and ids(m.search("first summary")) == ["s1"]
    assert ids(Memory(spark, m.root).semantic("rotate login token"))[0] == "a1"
    (row,) = m.store.read("sessions").collect()
    assert row["decisions"] == ["ds1", "ds2"] and row["summary"] == "first summary\n\n--- Updated 2025-06-11 00:00 ---\nsecond summary"
    assert set(ids(m.store.read("vectors"), "doc_id")) == {"a1", "b2", "s1"} and m.verify().first()["in_sync"]
    m.delete("b2")
    assert ids(m.search("retry")) == [] and m.verify().first()["in_sync"]


def test_an_embedder_that_is_away(spark, tmp_path):
    from lorekeep.operators.embed import EmbedderUnavailable

    class Away(HashEmbedder):
        is_away = False

        def available(self):
            if self.is_away:
                raise EmbedderUnavailable("away")

    m = Memory(spark, f"file://{tmp_path}/m", Away(16))
    m.add_notes(spark.createDataFrame([note("a1", "how-to", "Login tokens", "refresh the token", [], 1)], NOTE))
    m.save_sessions(spark.createDataFrame([("s1", "session", "S", "2025-06-01", "b", "p", "l", [], datetime(2025, 6, 1), "x", "", [], [], [], [], [], [], [], [])], SESSION))
    m.reindex("2025-06-30T00:00:00Z")
    m.embedder.is_away = True
    with pytest.warns(UserWarning, match="away"):
        m.append("a1", "and rotate")
    with pytest.raises(EmbedderUnavailable):
        m.hybrid("rotate")
    assert ids(m.hybrid("rotate", fallback=True)) == ["a1"]
