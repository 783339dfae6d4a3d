from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import embed
from lorekeep.operators.index import SearchIndex
from lorekeep.sources import markdown, sinks
from lorekeep.sources.config import Config
from lorekeep.streaming import pipelines

REPORT = """---
id: s1
title: "A: report"
date: 2025-01-31
tags: [x, "y z"]
created: 2025-01-31T10:00:00Z
---

intro is dropped
## Summary
All went well.

## Key Decisions
- one
  goes on
* two
## Problems & Solutions
- **Problem**: p1
  **Solution**: s1
- Problem: p2
- Solution: s2
- **Problem**: p3
## Next Steps
- [ ] do it
- [x] done
## Related Notes
- `0a1b2c3d-full` — "Title" (cat)
- no id
## What Changed
- `a/b.go` — renamed
## Diagram
boxes
## Empty

"""


def test_parse_session(spark):
    row = markdown.parse_sessions(spark.createDataFrame([("x.md", REPORT), ("y.md", "no front matter")], "path string, text string")).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["id"], r["title"], r["date"], r["tags"], r["summary"]) == ("s1", "A: report", "2025-01-31", ["x", "y z"], "All went well.")
    assert r["decisions"] == ["one goes on", "two"] and r["next_steps"] == ["do it", "done"]
    assert [tuple(p) for p in r["problems"]] == [("p1", "s1"), ("p2", "s2"), ("p3", "")]
    assert [tuple(x) for x in r["related_notes"]] == [("0a1b2c3d-full", "Title", "cat")] and [tuple(x) for x in r["changes"]] == [("a/b.go", "renamed")]
    assert [tuple(x) for x in r["extra_sections"]] == [("Diagram", "boxes")]


def test_notes_round_trip(spark, tmp_path):
    rows = [
        ("n1", "c", 'Quote " and: colon', "body\n\n## not a field", ["a", "b c"], datetime(2025, 1, 1, 5), datetime(2025, 1, 2), {"session_id": "s", "k": "v: w"}),
        ("n2", "d", "Plain", "", [], datetime(2025, 1, 1), datetime(2025, 1, 1), {}),
    ]
    notes = spark.createDataFrame(rows, "id string, category string, title string, content string, tags array<string>, created timestamp, updated timestamp, metadata map<string,string>")
    sinks.write_files(notes.select(sinks.note_path().alias("path"), sinks.note_markdown().alias("text")), str(tmp_path))
    (tmp_path / "notes" / "._junk.md").write_text("x")
    back = {r["id"]: r for r in markdown.parse_notes(markdown.read_files(spark, str(tmp_path))).collect()}
    assert set(back) == {"n1", "n2"}
    for row in rows:
        got = back[row[0]]
        assert (got["category"], got["title"], got["content"], got["tags"], got["created"], got["updated"], got["metadata"]) == row[1:]


def test_sessions_round_trip(spark, folder):
    from lorekeep.sources.corpus import sessions

    rows = sessions(spark, folder).limit(40)
    back = markdown.parse_sessions(rows.select(F.lit("p").alias("path"), sinks.session_markdown().alias("text")))
    pairs = rows.alias("a").join(back.alias("b"), "id")
    counts = pairs.select(*(F.sum((F.size(f"a.{c}") != F.size(f"b.{c}")).cast("int")).alias(c) for c in ("decisions", "insights", "questions", "next_steps", "problems"))).first()
    assert pairs.count() == 40 and all(v == 0 for v in counts)


def test_imports(spark, tmp_path):
    (tmp_path / "how to").mkdir()
    (tmp_path / "how to" / "my-first-note.md").write_text("just text")
    (tmp_path / "top.md").write_text("---\nid: known\n---\nbody")
    known = spark.createDataFrame([("known",)], "id string")
    rows = markdown.import_plain(spark.createDataFrame([(f"{tmp_path}/how-to/my-first-note.md", "just text"), (f"{tmp_path}/top.md", "---\nid: known\n---\nbody")], "path string, text string"), known, str(tmp_path)).collect()
    assert [(r["category"], r["title"], r["content"]) for r in rows] == [("how-to", "My First Note", "just text")]
    archive = spark.createDataFrame([("/a/2025-01-31_main_0a1b2c3d_some-title.md", "## Summary\nS"), ("/a/odd.md", "plain"), ("/a/2025-01-31_main_99999999_x.md", "y")], "path string, text string")
    rows = {r["title"]: r for r in markdown.import_archive(archive, spark.createDataFrame([("99999999",)], "session_id string")).collect()}
    assert rows["some title"]["branch"] == "main" and rows["some title"]["summary"] == "S"
    assert rows["odd"]["branch"] == "unknown" and rows["odd"]["summary"] == "plain" and len(rows) == 2


def test_archive(tmp_path):
    (tmp_path / "a" / "notes").mkdir(parents=True)
    (tmp_path / "a" / "notes" / "n.md").write_text("x")
    (tmp_path / "a" / ".index").mkdir()
    (tmp_path / "a" / ".index" / "db").write_text("y")
    assert sinks.export_archive(str(tmp_path / "a"), str(tmp_path / "t.tgz")) == 1
    assert sinks.restore_archive(str(tmp_path / "t.tgz"), str(tmp_path / "b")) == 1
    assert (tmp_path / "b" / "notes" / "n.md").read_text() == "x"


def test_write_outside_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="leaves"):
        sinks.write_files(spark.createDataFrame([("../x.md", "t")], "path string, text string"), str(tmp_path / "r"))


def test_store(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    frame = lambda rows: spark.createDataFrame(rows, "id string, category string, title string, content string, type string, tags array<string>, created timestamp, updated timestamp, metadata map<string,string>")
    now = datetime(2025, 1, 1)
    note = lambda i, title, content, tags: (i, "c", title, content, "note", tags, now, now, {})
    placed = lambda rows: {r["id"]: (r["into"], r["how"]) for r in store.add_notes(frame(rows)).collect()}
    assert placed([note("1", "A", "x", ["T"])]) == {"1": ("1", "created")}
    assert placed([note("2", "A", "y", ["t", "u"]), note("3", "B", "z", [])]) == {"2": ("1", "merged"), "3": ("3", "created")}
    rows = {r["id"]: r for r in store.read("notes").collect()}
    assert set(rows) == {"1", "3"} and rows["1"]["tags"] == ["T", "u"] and rows["1"]["content"] == "x\n\n--- Updated 2025-01-01 00:00 ---\ny"
    store.delete("notes", spark.createDataFrame([("1",)], "id string"), ["id"])
    assert {r["id"] for r in store.read("notes").collect()} == {"3"}


def test_notes_of_one_batch_meet(spark, tmp_path):
    """Two new notes of one title, then two that are merged into it, one of them by a similar title: nothing is lost."""
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    schema = "id string, category string, title string, content string, type string, tags array<string>, created timestamp, updated timestamp, metadata map<string,string>"
    note = lambda i, title, content, **m: (i, "c", title, content, "note", [f"t{i}"], datetime(2025, 1, int(i)), datetime(2025, 1, int(i)), m)
    add = lambda *rows: {r["id"]: (r["into"], r["how"]) for r in store.add_notes(spark.createDataFrame(rows, schema)).collect()}
    assert add(note("1", "Retry queue drain", "first", a="1"), note("2", "Retry queue drain", "second", a="2", b="x")) == {"1": ("1", "created"), "2": ("1", "merged")}
    assert add(note("3", "Retry queue drain", "third"), note("4", "Drain of retry queue", "fourth", b="")) == {"3": ("1", "merged"), "4": ("1", "merged")}
    assert add(note("4", "Drain of retry queue", "fourth")) == {"4": ("1", "merged")} and add(note("1", "X", "y")) == {"1": ("1", "known")}
    (row,) = store.read("notes").collect()
    assert [x for x in ("first", "second", "third", "fourth") if x in row["content"]] == ["first", "second", "third", "fourth"]
    assert row["tags"] == ["t1", "t2", "t3", "t4"] and row["metadata"] == {"a": "2", "b": "x"} and row["updated"] == datetime(2025, 1, 4)


def test_changes_touch_their_parts_only(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("x"))
    store.upsert("t", rows, ["id"])
    before = store._manifest("t", 1)["parts"]
    assert len(before) == store.n_parts and not store.is_grown("t")
    store.upsert("t", spark.createDataFrame([("7", "b", 1)], "id string, x string, y int"), ["id"])
    after = store._manifest("t", 2)["parts"]
    assert sum(before[p] != after[p] for p in before) == 1
    assert {(r["x"], r["y"]): r["count"] for r in store.read("t").groupBy("x", "y").count().collect()} == {("a", None): 999, ("b", 1): 1}
    store.delete("t", spark.createDataFrame([("7",), ("none",)], "id string"), ["id"])
    assert store.read("t").count() == 999 and store._versions("t") == [2, 3]
    store.append("log", rows.limit(3))
    store.append("log", rows.limit(2))
    assert store.read("log").count() == 5 and store.is_grown("log")


def test_partitions_are_replaced_alone(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id string, backend string, model string, n int")
    store.overwrite("v", frame(("a", "x", "m", 1), ("b", "x", "m", 1), ("a", "y", "m", 1)), "doc_id", ("backend", "model"))
    store.replace("v", frame(("a", "x", "m", 2)), backend="x", model="m")
    assert {tuple(r) for r in store.read("v").collect()} == {("a", "x", "m", 2), ("a", "y", "m", 1)}
    assert store.read("v", backend="y", model="m").count() == 1 and len(store.read("v", backend="y", model="m").inputFiles()) == 1
    store.upsert("v", frame(("a", "y", "m", 3)), ["doc_id", "backend", "model"])
    assert {tuple(r) for r in store.read("v").collect()} == {("a", "x", "m", 2), ("a", "y", "m", 3)}


def test_a_torn_write_is_not_seen(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a",)], "id string")
    store.overwrite("t", rows, "id")
    (tmp_path / "s" / "t" / "versions" / ".2-torn").write_text("{")
    assert store.version("t") == 1 and store.read("t").count() == 1


def test_config(tmp_path):
    config = Config(tmp_path / "c.json")
    config.set("on", "true")
    config.set("n", "7")
    again = Config(tmp_path / "c.json")
    assert again.get_bool("on") and again.get_int("n") == 7 and again.keys() == ["n", "on"]
    again.delete("n")
    assert Config(tmp_path / "c.json").get_int("n", 3) == 3


def test_embedders(spark):
    docs = spark.createDataFrame([("a", "login token"), ("b", None), ("c", "queue")], "id string, text string")
    e = embed.build_embedder("hash", dimensions=16)
    rows = {r["doc_id"]: r for r in embed.embedded(docs, "id", F.col("text"), e, "2025-01-01T00:00:00Z").collect()}
    assert len(rows["a"]["vector"]) == 16 and sum(x * x for x in rows["a"]["vector"]) == pytest.approx(1, rel=1e-5) and not any(rows["b"]["vector"])
    with pytest.raises(ValueError):
        embed.build_embedder("none")
    old = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<float>")
    moved = embed.migrated(old, "tfidf", "tfidf")
    assert moved.first()["dim"] == 2
    fresh = embed.embedded(docs, "id", F.col("text"), e, "t")
    assert embed.rebuild(moved.unionByName(fresh), fresh, e).count() == 4
    blobs = spark.createDataFrame([(bytearray(b"\x00\x00\x80\x3f\x00\x00\x00\x40"),), (bytearray(b"\x00"),)], "b binary")
    assert [r[0] for r in blobs.select(embed.from_bytes(F.col("b"))).collect()] == [[1.0, 2.0], None]


def test_dense_and_sparse_weights_agree(spark):
    from lorekeep.operators import weights
    from lorekeep.operators.index import WeightIndex

    docs = spark.createDataFrame([("a", "Login session, token token"), ("b", "login queue drain"), ("c", "queue queue the"), ("d", "")], "id string, text string")
    counts = weights.term_counts(docs, "id", F.col("text"))
    known = WeightIndex.vocabulary_of(counts, 4)
    sparse = {r["id"]: r["similarity"] for r in WeightIndex(WeightIndex.weights_of(counts, known, 4), known, 4).similar("login token drain").collect()}
    e = embed.build_embedder(vocabulary={r["term"]: r["df"] for r in known.collect()}, n_docs=4)
    rows = embed.embedded(docs, "id", F.col("text"), e, "t")
    dense = {r["doc_id"]: r["similarity"] for r in weights.nearest_to(rows, e.embed(["login token drain"], "query")[0]).collect()}
    assert dense == pytest.approx(sparse, rel=1e-5) and set(dense) == {"a", "b"} and e.name == embed.TfidfEmbedder.of(known, 4).name == "tfidf"
    with pytest.raises(ValueError):
        embed.TfidfEmbedder.of(known, 4, most_terms=2)


def test_failing_embedder_is_loud(spark):
    class Failing(embed.HashEmbedder):
        def embed(self, texts, kind="document"):
            return []

    docs = spark.createDataFrame([("a", "x")], "id string, text string")
    with pytest.raises(Exception, match="vectors for"):
        embed.embedded(docs, "id", F.col("text"), Failing(), "t").collect()


def test_streams(spark, tmp_path):
    lines = [('{"tool_name": "Bash", "output": "running the suite\\n3 tests FAILED"}', datetime(2025, 1, 1, 0, m)) for m in (0, 1)]
    spark.createDataFrame(lines, "value string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value string, at timestamp").parquet(str(tmp_path / "in"))
    kept = pipelines.captured(stream)
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    pipelines.run_once(pipelines.into_store(kept.select("head", "content"), store, "observations", ["head"], str(tmp_path / "c1")))
    assert [r["content"] for r in store.read("observations").collect()] == ["3 tests FAILED"]

    log = [("A", "2025-01-01T00:10:00Z", "get"), ("a", "2025-01-01T00:20:00Z", "get"), ("b", "soon", "get")]
    spark.createDataFrame(log, "entry_id string, accessed_at string, access_type string").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("entry_id string, accessed_at string, access_type string").parquet(str(tmp_path / "log"))
    query = pipelines.access_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["entry_id"], r["n"]) for r in spark.table("windows").collect()] == [("a", 2)]

    docs = [("1", "T", "replica lag", ["x"])]
    schema = "id string, title string, content string, tags array<string>"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "docs"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "docs"))
    pipelines.run_once(pipelines.index_updates(stream(), store, str(tmp_path / "c2")))
    spark.createDataFrame([("1", "T", "queue", [])], schema).write.mode("append").parquet(str(tmp_path / "docs"))
    pipelines.run_once(pipelines.index_updates(stream(), store, str(tmp_path / "c2")))
    index = SearchIndex(store.read("postings"), store.read("index_rows"), changed=store.is_grown("index_rows"))
    assert {r["id"] for r in index.bm25("queue").collect()} == {"1"} and index.bm25("replica").count() == 0 and index.n_rows == 1
