"""Writing notes and sessions: Markdown, JSON, DOT, Parquet tables with copy-on-write changes."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekeep.functions.text import id8, slug_name
from lorekeep.operators import dedup
from lorekeep.session import cut


def _quoted(c: Column) -> Column:
    text = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _front(fields: dict[str, Column], tags: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items() if v is not None]
    listed = F.array_join(F.transform(F.filter(F.coalesce(tags, F.array()), lambda t: t.isNotNull()), lambda t: F.concat(F.lit("\n  - "), _quoted(t))), "")
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\ntags:"), listed, F.lit("\n---\n\n"))


def note_markdown() -> Column:
    """The Markdown file of a note row."""
    front = _front(
        {"id": F.col("id"), "type": F.lit("note"), "category": _quoted(F.col("category")), "title": _quoted(F.col("title")),
         "created": _time(F.col("created")), "updated": _time(F.col("updated"))}, F.col("tags"))
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), _quoted(e["value"])))
    metadata = F.when(F.size(F.coalesce("metadata", F.create_map().cast("map<string,string>"))) > 0, F.concat(F.lit("metadata:\n"), F.array_join(pairs, "\n"), F.lit("\n")))
    return F.concat(F.regexp_replace(front, r"---\n\n$", ""), F.coalesce(metadata, F.lit("")), F.lit("---\n\n"), F.coalesce("content", F.lit("")))


def session_markdown() -> Column:
    """The Markdown file of a session row: sections in a fixed order, empty ones left out."""
    front = _front({"id": F.col("id"), "type": F.lit("session"), **{k: _quoted(F.col(k)) for k in ("title", "date", "branch", "project", "session_id")}, "created": _time(F.col("created"))}, F.col("tags"))
    bullet = lambda prefix: lambda x: F.concat(F.lit(prefix), x)
    lines = lambda c, f: F.array_join(F.transform(F.coalesce(c, F.array()), f), "\n")
    parts = {
        "Summary": F.col("summary"),
        "What Happened": F.col("what_happened"),
        "Key Decisions": lines("decisions", bullet("- ")),
        "What Changed": lines("changes", lambda x: F.concat(F.lit("- `"), x["path"], F.lit("` — "), x["description"])),
        "Problems & Solutions": lines("problems", lambda x: F.concat(F.lit("- **Problem**: "), x["problem"], F.lit("\n  **Solution**: "), x["solution"])),
        "Learning Insights": lines("insights", bullet("- ")),
        "Questions Raised": lines("questions", bullet("- ")),
        "Next Steps": lines("next_steps", bullet("- [ ] ")),
        "Related Notes": lines("related_notes", lambda x: F.concat(F.lit("- `"), x["id"], F.lit('` — "'), x["title"], F.lit('" ('), x["category"], F.lit(")"))),
    }
    known = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), c)) for name, c in parts.items()]
    extra = F.nullif(F.array_join(F.transform(F.coalesce("extra_sections", F.array()), lambda x: F.concat(F.lit("## "), x["name"], F.lit("\n"), x["content"])), "\n\n"), F.lit(""))
    return F.concat(front, F.concat_ws("\n\n", *known, extra))


def note_path() -> Column:
    return F.concat(F.lit("notes/"), F.col("category"), F.lit("/"), slug_name(F.col("title")))


def session_path() -> Column:
    return F.concat(F.lit("sessions/"), F.concat_ws("_", "date", F.regexp_replace("branch", "/", "-"), id8(F.col("id")), slug_name(F.col("title"))))


def write_files(rows: DataFrame, root: str) -> None:
    """One file a row of (path, text) below root, a folder that all executors reach; tasks write their own rows."""

    def write(part) -> None:
        from pathlib import Path

        base = Path(root.removeprefix("file://")).resolve()
        for row in part:
            target = (base / row["path"]).resolve()
            if base not in target.parents:
                raise ValueError(f"{row['path']} leaves {root}")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(row["text"])

    rows.select("path", "text").foreachPartition(write)


def count_files(paths: DataFrame) -> DataFrame:
    """(folder, n_files): Markdown files (filepath) by top folder, '' for none; names that begin with '._' do not count."""
    kept = paths.where(F.col("filepath").endswith(".md") & ~F.regexp_extract("filepath", r"([^/]*)$", 1).startswith("._"))
    folder = F.when(F.contains("filepath", F.lit("/")), F.substring_index("filepath", "/", 1)).otherwise("")
    return kept.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_archive(root: str, archive: str) -> int:
    """A tar.gz of the files below root without the index folder; returns how many."""
    import tarfile
    from pathlib import Path

    base, n = Path(root), 0
    with tarfile.open(archive, "w:gz") as tar:
        for path in sorted(base.rglob("*")):
            if path.is_file() and ".index" not in path.relative_to(base).parts:
                tar.add(path, path.relative_to(base))
                n += 1
    return n


def restore_archive(archive: str, root: str) -> int:
    """Unpacks an export below root; members that would leave it are skipped. Returns how many files it wrote."""
    import tarfile
    from pathlib import Path

    base, n = Path(root).resolve(), 0
    with tarfile.open(archive, "r:gz") as tar:
        for member in tar.getmembers():
            target = (base / member.name).resolve()
            if member.isfile() and base in target.parents:
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(tar.extractfile(member).read())
                n += 1
    return n


class Store:
    """Parquet tables below one folder. A version of a table is a small file that names the folders of its parts.

    Rows lie in parts by a hash of their key (and by the values of partition columns, if any), so a change rewrites the
    parts that it touches and takes over all others. A new version is complete before its file appears under its final
    name; readers take the highest number there is, so they never meet a half-written or missing table. Of old
    versions the last one stays, for readers that are under way. Writers of one table take turns.
    """

    def __init__(self, spark: SparkSession, root: str, n_parts: int = 16, most_folders: int = 64):
        self.spark, self.root, self.n_parts, self.most_folders = spark, root.rstrip("/"), n_parts, most_folders

    # Versions

    def _hadoop(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self, name: str) -> list[int]:
        fs, folder = self._hadoop(f"{self.root}/{name}/versions")
        found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(x.removesuffix(".json")) for x in found if x.endswith(".json"))

    def version(self, name: str) -> int:
        return max(self._versions(name), default=0)

    def _manifest(self, name: str, version: int) -> dict:
        fs, path = self._hadoop(f"{self.root}/{name}/versions/{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, manifest: dict) -> None:
        versions = self._versions(name)
        number = max(versions, default=0) + 1
        fs, hidden = self._hadoop(f"{self.root}/{name}/versions/.{number}-{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, final = self._hadoop(f"{self.root}/{name}/versions/{number}.json")
        if fs.exists(final) or not fs.rename(hidden, final):
            raise RuntimeError(f"{name} was changed by another writer")
        kept = {x for v in versions[-1:] for folders in self._manifest(name, v)["parts"].values() for x in folders} | {x for folders in manifest["parts"].values() for x in folders}
        for old in versions[:-1]:
            for folders in self._manifest(name, old)["parts"].values():
                for folder in set(folders) - kept:
                    fs.delete(self._hadoop(f"{self.root}/{name}/{folder}")[1], True)
            fs.delete(self._hadoop(f"{self.root}/{name}/versions/{old}.json")[1], False)

    # Reading

    def read(self, name: str, **partition: str) -> DataFrame:
        """The table, or of a table with partition columns only the parts with these values."""
        manifest = self._manifest(name, self.version(name))
        prefix = _prefix([partition[c] for c in manifest["partition_by"]]) if partition else ""
        rows = self._read_parts(name, manifest, [p for p in manifest["parts"] if p.startswith(prefix)])
        for column, value in partition.items():
            rows = rows.where(F.col(column) == value)
        return rows

    def _read_parts(self, name: str, manifest: dict, parts) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/{name}/{f}" for p in parts for f in manifest["parts"][p]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # Writing

    def _write(self, name: str, rows: DataFrame, key: str | None, partition_by: list[str]) -> dict[str, list[str]]:
        """Writes rows by part; returns the folders by part. Without key their order stays and they are one part."""
        folder = f"data/{uuid.uuid4().hex}"
        if key is None:
            rows.write.parquet(f"{self.root}/{name}/{folder}")
            return {"all": [folder]}
        parted = rows.withColumn("_part", self._part(key, partition_by)).hint("rebalance", "_part")
        parted.write.partitionBy("_part").parquet(f"{self.root}/{name}/{folder}")
        fs, path = self._hadoop(f"{self.root}/{name}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
        return {n.removeprefix("_part="): [f"{folder}/{n}"] for n in names if n.startswith("_part=")}

    def _part(self, key: str, partition_by: list[str]) -> Column:
        number = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.n_parts)).cast("string")
        if not partition_by:
            return number
        values = F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in partition_by))
        return F.concat(F.substring(F.md5(values), 1, 16), F.lit("-"), number)

    def overwrite(self, name: str, rows: DataFrame, key: str | None = None, partition_by: tuple[str, ...] = ()) -> None:
        parts = self._write(name, rows, key, list(partition_by))
        self._commit(name, {"schema": rows.schema.jsonValue(), "key": key, "partition_by": list(partition_by), "parts": parts})

    def replace(self, name: str, rows: DataFrame, **partition: str) -> None:
        """Rows replace those of one partition; all others stay where they are."""
        manifest = self._manifest(name, self.version(name))
        prefix = _prefix([partition[c] for c in manifest["partition_by"]])
        others = {p: f for p, f in manifest["parts"].items() if not p.startswith(prefix)}
        new = self._write(name, rows.select(*StructType.fromJson(manifest["schema"]).names), manifest["key"], manifest["partition_by"])
        self._commit(name, manifest | {"parts": others | new})

    def _change(self, name: str, keys: list[str], gone: DataFrame, new: DataFrame | None) -> None:
        manifest = self._manifest(name, self.version(name))
        key, partition_by = manifest["key"], manifest["partition_by"]
        parts = set(manifest["parts"])
        if key in keys:  # rows with the key of a change lie in the parts that its hash names
            at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.n_parts)).cast("string")
            touched = {r[0] for r in gone.select(at).distinct().collect()}
            parts = {p for p in parts if p.rpartition("-")[2] in touched}
        rows = self._read_parts(name, manifest, sorted(parts)).join(gone.select(*keys), keys, "left_anti")
        if new is not None:
            rows = rows.unionByName(new, allowMissingColumns=True)
        fresh = self._write(name, rows, key, partition_by)
        schema = rows.schema.jsonValue() if new is not None else manifest["schema"]
        self._commit(name, manifest | {"schema": schema, "parts": {p: f for p, f in manifest["parts"].items() if p not in parts} | fresh})

    def upsert(self, name: str, rows: DataFrame, keys: list[str], partition_by: tuple[str, ...] = ()) -> None:
        """Rows replace those with the same keys; of several new rows for a key any one stays. Only the parts that hold
        the keys are rewritten."""
        new = cut(rows.dropDuplicates(keys), "changes")
        if not self.version(name):
            return self.overwrite(name, new, keys[0], partition_by)
        self._change(name, keys, new, new)

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        self._change(name, keys, cut(gone.select(*keys).distinct(), "gone"), None)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows without touching those that are there (logs, index generations); many small additions are
        gathered into one now and then."""
        if not self.version(name):
            return self.overwrite(name, rows)
        manifest = self._manifest(name, self.version(name))
        names = StructType.fromJson(manifest["schema"]).names
        if sum(map(len, manifest["parts"].values())) >= self.most_folders:
            rows = self.read(name).unionByName(rows.select(*names))
            return self.overwrite(name, rows, manifest["key"], tuple(manifest["partition_by"]))
        added = self._write(name, rows.select(*names), manifest["key"], manifest["partition_by"])
        parts = {p: manifest["parts"].get(p, []) + added.get(p, []) for p in manifest["parts"] | added}
        self._commit(name, manifest | {"parts": parts})

    def is_grown(self, name: str) -> bool:
        """Whether rows were appended to a table since it was overwritten or gathered."""
        return any(len(f) > 1 for f in self._manifest(name, self.version(name))["parts"].values())

    # Notes and sessions

    def add_notes(self, notes: DataFrame) -> DataFrame:
        """Adds notes as fold_notes places them: (id, into, how) for every row of notes. Ids that are there already are
        left as they are and come out as 'known'."""
        notes = cut(notes.dropDuplicates(["id"]), "notes")
        stored = self.read("notes") if self.version("notes") else None
        known = notes.limit(0).select("id") if stored is None else cut(notes.join(stored, "id", "left_semi").select("id"), "known")
        new = notes.join(known, "id", "left_anti")
        placed = cut(dedup.fold_notes(new, None if stored is None else stored), "placed")
        self.upsert("notes", dedup.merge_notes(new, placed, stored), ["id"])
        return placed.unionByName(known.select("id", F.col("id").alias("into"), F.lit("known").alias("how")))

    def save_sessions(self, sessions: DataFrame) -> DataFrame:
        """Saves session reports; reports of one session become one row, with what is stored of it (merge_sessions).
        (id, into, how), how 'created' or 'merged'."""
        new = cut(sessions.dropDuplicates(["id"]).withColumn("stored", F.lit(False)), "reports")
        both = new
        if self.version("sessions"):
            stored = self.read("sessions").join(new.select("id"), "id", "left_anti")
            day = ["date", "project", "branch"]
            blank = F.coalesce(F.trim("session_id"), F.lit("")) == ""
            labels = new.where(~blank).select("session_id").distinct()
            same_day = [F.coalesce(F.col(f"s.{c}"), F.lit("")) == F.coalesce(F.col(f"d.{c}"), F.lit("")) for c in day]
            touched = stored.where(~blank).join(labels, "session_id", "left_semi").unionByName(
                stored.where(blank).alias("s").join(new.select(*day).distinct().alias("d"), same_day, "left_semi")
            )
            both = new.unionByName(touched.withColumn("stored", F.lit(True)), allowMissingColumns=True)
        both = cut(both, "both")
        merged = cut(dedup.merge_sessions(both), "merged")
        self.upsert("sessions", merged.drop("key", "n_reports"), ["id"])
        into = merged.select("key", F.col("id").alias("into"))
        placed = dedup.session_targets(both).join(new.select("id"), "id", "left_semi").join(into, "key")
        return placed.select("id", "into", F.when(F.col("id") == F.col("into"), "created").otherwise("merged").alias("how"))


def _prefix(values: list[str]) -> str:
    return hashlib.md5("\x1f".join(values).encode()).hexdigest()[:16] + "-"
