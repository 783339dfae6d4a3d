"""Long exact spans shared between records, found by difference-cover anchors.

A set D of residues modulo a period v is a difference cover when any two positions have a shift below v that
takes both into D. Windows of w = least - v + 1 characters are hashed at the positions in D only; a common
substring of `least` characters then holds two aligned windows with one hash, wherever it starts in either text.
Anchors in few places are extended to both sides, pair by pair. Those in many go through the windows of `least`
characters around them, which are counted by batch, so that boilerplate costs its length and not its copies.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut

# Perfect difference sets (every residue is a difference of exactly one pair), by period.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
_PIECE = 1 << 20  # characters hashed at a time
_PACKED = 4 << 20  # anchors gathered in a task before they are packed by bucket
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def cover_for(least: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves windows of over 0.44 x least characters; 1 (every position) for tiny spans."""
    fits = [v for v in COVERS if v <= 0.56 * least]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


def window_hashes(codes: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """A 64-bit hash of every window of `width` code points, by doubling: O(log width) passes."""
    x = (codes.astype(np.uint64) + np.uint64(base & 0xFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, span = np.zeros(n, np.uint64), 0, 1
    while True:
        if width & span:
            out = out * np.uint64(base) + x[done : done + n]
            done += span
        if done == width:
            break
        x = x[: len(x) - span] * np.uint64(base) + x[span:]
        base, span = base * base & _MASK, span * 2
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x94D049BB133111EB)


def anchors(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of all anchors, in order of text and position."""
    period, cover = cover_for(least)
    width = least - period + 1
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True
    parts: tuple[list, ...] = ([], [], [])

    def flush(group: list[tuple[int, int, str]]) -> None:
        """Hash pieces (text number, offset, piece) glued together; windows across a seam are left out."""
        lengths = np.array([len(t) for _, _, t in group])
        codes = np.frombuffer("".join(t for _, _, t in group).encode("utf-32-le"), np.uint32)
        hashes = window_hashes(codes, width)
        starts = np.cumsum(lengths) - lengths
        which = np.repeat(np.arange(len(group)), lengths)[: len(hashes)]
        inside = np.arange(len(hashes)) - starts[which]
        position = inside + np.array([o for _, o, _ in group])[which]
        keep = np.flatnonzero((inside + width <= lengths[which]) & in_cover[position % period])
        parts[0].append(np.array([k for k, _, _ in group])[which[keep]])
        parts[1].append(position[keep])
        parts[2].append(hashes[keep])

    group, size = [], 0
    for k, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - width + 1), _PIECE):
            piece = text[offset : offset + _PIECE + width - 1]
            group.append((k, offset, piece))
            size += len(piece)
            if size >= _PIECE:
                flush(group)
                group, size = [], 0
    if group:
        flush(group)
    kinds = (np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(p) if p else np.empty(0, kind) for p, kind in zip(parts, kinds, strict=True))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _around(text: str, at: np.ndarray, least: int) -> list[tuple[int, str]]:
    """The stretches of text that hold all windows of `least` around the anchors at these positions."""
    period, _ = cover_for(least)
    starts, ends = np.maximum(at - period + 1, 0), np.minimum(at + least, len(text))
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1] - least + 1]))  # no window lies across
    last = np.append(new[1:], len(at)) - 1
    return [(int(a), text[a:b]) for a, b in zip(starts[new], ends[last], strict=True) if b - a >= least]


def _sampled_hashes(least: int):
    """The distinct anchors of each text of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _, hashed = anchors(batch.column("text").to_pylist(), least)
            order = np.lexsort((hashed, text))
            t, h = text[order], hashed[order]
            new = np.ones(len(h), bool)
            new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], ["hash"])

    return run


_PACKED_COLUMNS = ("docs", "counts", "low", "high", "position")


def _anchor_blobs(least: int, n_buckets: int, common):
    """Map side: the anchors of many texts, packed by bucket of their hash. Those known to be common stay out: of
    texts with any, the stretches around them go to a bucket below 0 by their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        held: list[tuple] = []
        size = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = np.array(batch.column("key").to_pylist(), dtype=object)
            text, position, hashed = anchors(texts, least)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                hit = known[at] == hashed
                stretches: dict[int, list] = defaultdict(list)
                edges = np.flatnonzero(np.diff(text[hit], prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    k = int(text[hit][a])
                    for start, piece in _around(texts[k], position[hit][a:b], least):
                        stretches[-1 - int.from_bytes(keys[k][:6], "little") % n_buckets].append((keys[k], start, piece.encode("utf-8", "surrogatepass")))
                if stretches:
                    yield _blobs(
                        [
                            (bucket, b"".join(k for k, _, _ in own), np.array([len(t) for _, _, t in own], np.uint32).tobytes(), b"".join(t for _, _, t in own), b"", np.array([s for _, s, _ in own], np.uint32).tobytes())
                            for bucket, own in stretches.items()
                        ]
                    )
                text, position, hashed = text[~hit], position[~hit], hashed[~hit]
            held.append((keys, text, position, hashed))
            size += len(hashed)
            if size >= _PACKED:
                yield _packed(held, n_buckets)
                held, size = [], 0
        if size:
            yield _packed(held, n_buckets)

    return run


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.binary()] * 5), strict=True)], ["bucket", *_PACKED_COLUMNS])


def _packed(held: list[tuple], n_buckets: int) -> pa.RecordBatch:
    keys = np.concatenate([k for k, _, _, _ in held])
    before = np.cumsum([0, *(len(k) for k, _, _, _ in held)])
    text = np.concatenate([t + n for (_, t, _, _), n in zip(held, before[:-1], strict=True)])
    position, hashed = (np.concatenate([h[i] for h in held]) for i in (2, 3))
    bucket = (hashed % np.uint64(n_buckets)).astype(np.int64)
    rest = hashed // np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        docs, counts = np.unique(text[own], return_counts=True)
        rows.append(
            (
                int(bucket[own[0]]),
                b"".join(keys[docs]),
                counts.astype(np.uint32).tobytes(),
                rest[own].astype(np.uint32).tobytes(),
                (rest[own] >> np.uint64(32)).astype(np.uint8).tobytes(),
                position[own].astype(np.uint32).view(np.uint16).reshape(-1, 2).T.tobytes(),
            )
        )
    return _blobs(rows)


_REPEATS = "bucket long, anchor long, key binary, position long, n long, text string"


def _stretches(table: pa.Table) -> pa.Table:
    """A bucket below 0: its stretches, each text's once."""
    seen, rows = set(), []
    for row in table.to_pylist():
        keys, lengths, starts, at = row["docs"], np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["position"], np.uint32), 0
        for i, (n, start) in enumerate(zip(lengths, starts, strict=True)):
            key = keys[16 * i : 16 * i + 16]
            if (key, int(start)) not in seen:
                seen.add((key, int(start)))
                rows.append((key, int(start), row["low"][at : at + n].decode("utf-8", "surrogatepass")))
            at += n
    keys, starts, texts = zip(*rows, strict=True)
    none = pa.nulls(len(rows), pa.int64())
    return pa.table({"bucket": pa.array([-1] * len(rows), pa.int64()), "anchor": none, "key": pa.array(keys, pa.binary()), "position": pa.array(starts, pa.int64()), "n": none, "text": pa.array(texts, pa.string())})


def _repeats(table: pa.Table) -> pa.Table:
    """Reduce side, one bucket: the anchors whose hash occurs in at least two different texts."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return _stretches(table)
    keys, counts, low, high, position = [], [], [], [], []
    for row in table.to_pylist():
        keys.append(np.frombuffer(row["docs"], np.uint64).reshape(-1, 2))
        counts.append(np.frombuffer(row["counts"], np.uint32))
        low.append(np.frombuffer(row["low"], np.uint32))
        high.append(np.frombuffer(row["high"], np.uint8))
        near, far = np.frombuffer(row["position"], np.uint16).reshape(2, -1).astype(np.int64)
        position.append(near | far << 16)
    halves = np.concatenate(keys)
    _, text = np.unique(halves, axis=0, return_inverse=True)  # copies of a text are one text from here on
    owner = np.repeat(text.ravel(), np.concatenate(counts))
    place = np.repeat(np.arange(len(halves)), np.concatenate(counts))
    hashed = np.concatenate(low).astype(np.uint64) | np.concatenate(high).astype(np.uint64) << np.uint64(32)
    position = np.concatenate(position)
    order = np.lexsort((position, owner, hashed))
    h, o, p = hashed[order], owner[order], position[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1])
    order, h, o = order[new], h[new], o[new]
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    mixed = o[edges[:-1]] != o[edges[1:] - 1] if len(sizes) else np.empty(0, bool)
    keep = np.repeat(mixed, sizes)
    chosen = order[keep]
    return pa.table(
        {
            "bucket": pa.array(np.full(len(chosen), bucket, np.int64)),
            "anchor": pa.array(h[keep].astype(np.int64)),
            "key": pa.array([k.tobytes() for k in halves[place[chosen]]], pa.binary()),
            "position": pa.array(position[chosen].astype(np.int64)),
            "n": pa.array(np.repeat(sizes, sizes)[keep].astype(np.int64)),
            "text": pa.nulls(len(chosen), pa.string()),
        }
    )


def _contexts(least: int, hot: int):
    """The surroundings of each repeated anchor; for anchors in over `hot` places the stretches around them."""
    period, _ = cover_for(least)
    width = least - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, places in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "places")), strict=True):
                many = sorted(x["position"] for x in places if x["n"] > hot)
                rows += [(-1, None, key, start, piece, None) for start, piece in _around(text, np.array(many), least)] if many else []
                for x in places:
                    p = x["position"]
                    if x["n"] <= hot:
                        rows.append((x["bucket"], x["anchor"], key, p, text[max(0, p - period + 1) : p], text[p + width : p + least]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
            names = ["bucket", "anchor", "key", "position", "before", "after"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _windows_of(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, both hashes) of all windows of `least` in the stretches of a batch of texts; a window
    that two stretches of a text hold comes twice."""
    parts: tuple[list, ...] = ([], [], [])
    for k, stretches in enumerate(batch.column("stretches").to_pylist()):
        for stretch in stretches:
            codes = _codes(stretch["text"])
            hashes = np.stack([window_hashes(codes, least, base) for base in _BASES], 1)
            parts[0].append(np.full(len(hashes), k))
            parts[1].append(stretch["position"] + np.arange(len(hashes)))
            parts[2].append(hashes.view(np.int64))
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.int64)
    return tuple(np.concatenate(p) if p else e for p, e in zip(parts, empty, strict=True))


def _window_counts(least: int):
    """The distinct windows of a batch, with in how many texts they are and what marks the set of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _, h = _windows_of(batch, least)
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.int64).reshape(-1, 2)
            order = np.lexsort((text, h[:, 1], h[:, 0]))
            text, h = text[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]).any(1)
            once = new.copy()
            once[1:] |= text[1:] != text[:-1]
            text, h, new = text[once], h[once], new[once]
            at = np.flatnonzero(new)
            marks = [np.bitwise_xor.reduceat(keys[text, i], at) if len(at) else np.empty(0, np.int64) for i in (0, 1)]
            columns = [h[at, 0], h[at, 1], np.diff(at, append=len(h)), *marks]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["h1", "h2", "n", "x", "y"])

    return run


def _tagged(least: int, shared):
    """Which of the shared windows each text has: the speakers among them, and the spans that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, speaks = shared.value
        for batch in batches:
            text, position, h = _windows_of(batch, least)
            low, high = np.searchsorted(first, h[:, 0], "left"), np.searchsorted(first, h[:, 0], "right")
            at = np.full(len(h), -1)
            for k in range(int((high - low).max(initial=0))):  # equal first halves are next to never
                here = (low + k < high) & (at < 0)
                at[here] = np.where(second[low[here] + k] == h[here, 1], low[here] + k, -1)
            order = np.flatnonzero(at >= 0)
            order = order[np.lexsort((position[order], text[order]))]
            text, position, at = text[order], position[order], at[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (position[1:] > position[:-1] + least)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(text))[: len(starts)] - 1
            keys = np.array(batch.column("key").to_pylist(), dtype=object)
            speaker = np.flatnonzero(speaks[at])
            rows = [(keys[text[i]], int(first[at[i]]), int(second[at[i]]), None, None) for i in speaker]
            rows += [(keys[text[a]], None, None, int(position[a]), int(position[b]) + least) for a, b in zip(starts, ends, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), *[pa.int64()] * 4), strict=True)], ["key", "h1", "h2", "a", "b"])

    return run


def _every_window(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, position, h = _windows_of(batch, least)
            keys = np.array(batch.column("key").to_pylist(), dtype=object)
            columns = [pa.array(keys[text], pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in (h[:, 0], h[:, 1], position))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "h1", "h2", "a"])

    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _extend(least: int):
    """One bucket of anchors with their surroundings: the pairs of texts that agree over at least `least`."""
    period, _ = cover_for(least)
    width = least - period + 1

    def run(table: pa.Table) -> pa.Table:
        groups = defaultdict(list)
        for row in table.to_pylist():
            groups[row["anchor"]].append((row["key"], row["position"], row["before"][::-1], row["after"]))
        found = set()
        for group in groups.values():
            group.sort(key=lambda x: x[:2])
            for i, (key_a, a, left_a, right_a) in enumerate(group):
                for key_b, b, left_b, right_b in group[i + 1 :]:
                    if key_a != key_b:
                        left, right = _common(left_a, left_b), _common(right_a, right_b)
                        if left + width + right >= least:
                            found.add((key_a, key_b, a - left, a + width + right, b - left, b + width + right))
        columns = list(zip(*found, strict=True)) or [[]] * 6
        kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 4)
        names = ["key_a", "key_b", "start_a", "end_a", "start_b", "end_b"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return run


_PAIRS = "key_a binary, key_b binary, start_a long, end_a long, start_b long, end_b long"


class SharedSpans:
    """Spans of at least `least` code points that stand character for character in different records.

    Rows with a null id or a null or shorter text share nothing. Copies of a text are found once and stand for
    all records that carry it. Other columns are ignored, whatever their names; an empty table gives no rows.

    The plan: ids, lengths and digests of the texts are written once, and of equal texts only the one with the
    smallest id goes on. Each task hashes its texts' anchors and packs them by bucket of the hash, which is the one
    shuffle of the corpus (about 8 bytes an anchor, one anchor in 11 characters). A bucket keeps what occurs in two
    different texts. Only for those are the surroundings cut from the texts and compared, within buckets, anchor by
    anchor.

    Boilerplate never fills a bucket nor makes pairs: anchors that `sample_least` texts of a sample hold are known
    beforehand (the sample of about sample_chars characters only steers; no result depends on it), and they and
    those in over `hot` places go through the windows of `least` characters around them. Windows are counted batch
    by batch before they are shuffled; those in two texts or more are shared spans already, and of windows with one
    set of texts one speaks for all. The shared windows are broadcast up to most_broadcast_rows, joined beyond.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_column: str = "doc_id",
        text_column: str = "text",
        least: int = 240,
        hot: int = 64,
        anchors_per_bucket: int = 250_000,
        most_broadcast_rows: int = 1_000_000,
        sample_chars: int = 16 << 20,
        sample_least: int = 8,
    ):
        self.least = least
        spark = docs.sparkSession
        rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        rows = rows.where((F.length("text") >= least) & F.col("doc_id").isNotNull()).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
        self.keys = cut(rows.select("key", "doc_id", F.length("text").cast("long").alias("n_chars")), "keys")
        copied = self.keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
        copied = self._small(cut(copied, "copied"), most_broadcast_rows)
        texts = rows.join(copied, "key", "left").where("first is null or doc_id = first").select("key", "text")
        period, cover = cover_for(least)
        chars = self.keys.agg(F.sum("n_chars")).first()[0] or 0
        n_buckets = max(2, -(-chars * len(cover) // (period * anchors_per_bucket)))
        share = int(min(1.0, sample_chars / max(1, chars)) * (1 << 30))
        sampled = texts.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share).mapInArrow(_sampled_hashes(least), "hash long")
        often = sampled.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= sample_least).select("hash").toArrow()
        common = spark.sparkContext.broadcast(np.sort(often.column("hash").to_numpy().view(np.uint64)))
        repeats = self.anchors = cut(
            texts.mapInArrow(_anchor_blobs(least, n_buckets, common), "bucket long, docs binary, counts binary, low binary, high binary, position binary")
            .repartition(min(n_buckets, 10_000), "bucket")  # as many tasks as there are buckets, whatever the session's number
            .groupBy("bucket")
            .applyInArrow(_repeats, _REPEATS),
            "anchors",
        )
        light = repeats.where("bucket >= 0")
        places = light.groupBy("key").agg(F.collect_list(F.struct("bucket", "anchor", "position", "n")).alias("places"))
        if light.count() <= most_broadcast_rows:
            places = F.broadcast(places)
        around = cut(
            texts.join(places, "key").mapInArrow(_contexts(least, hot), "bucket long, anchor long, key binary, position long, before string, after string"),
            "contexts",
        )
        split = F.pmod(F.xxhash64("bucket", "anchor"), F.lit(max(16, 8 * n_buckets)))
        extended = around.where("bucket >= 0").groupBy(split).applyInArrow(_extend(least), _PAIRS)
        self.extended = cut(extended.dropDuplicates(["key_a", "key_b", "start_a", "end_a", "start_b", "end_b"]), "spans")

        stretches = repeats.where("bucket < 0").select("key", "position", "text").unionByName(around.where("bucket < 0").select("key", "position", F.col("before").alias("text")))
        by_text = cut(stretches.groupBy("key").agg(F.collect_set(F.struct("position", "text")).alias("stretches")), "stretches")
        counts = by_text.mapInArrow(_window_counts(least), "h1 long, h2 long, n long, x long, y long")
        sets = counts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("n > 1")
        # Neighbouring windows of one passage stand in the same texts: one of them speaks for all.
        window = F.struct("h1", "h2")
        speakers = sets.groupBy("n", "x", "y").agg(F.min(window).alias("speaker"))
        shared = cut(sets.join(speakers, ["n", "x", "y"]).select("h1", "h2", (window == F.col("speaker")).alias("speaks")), "windows")
        if shared.count() <= most_broadcast_rows:
            known = shared.orderBy("h1", "h2").toArrow()
            arrays = (*(known.column(c).to_numpy() for c in ("h1", "h2")), known.column("speaks").to_numpy(zero_copy_only=False))
            tagged = by_text.mapInArrow(_tagged(least, spark.sparkContext.broadcast(arrays)), "key binary, h1 long, h2 long, a long, b long")
        else:
            every = by_text.mapInArrow(_every_window(least), "key binary, h1 long, h2 long, a long").join(shared, ["h1", "h2"])
            speaker = lambda c: F.when(F.col("speaks"), F.col(c)).alias(c)
            tagged = every.select("key", speaker("h1"), speaker("h2"), "a", (F.col("a") + least).alias("b"))
        tagged = cut(tagged, "tagged")
        self.window_sets = tagged.where("h1 is not null").select(F.struct("h1", "h2").alias("window"), "key").distinct()
        self.windows = tagged.where("a is not null").select("key", "a", "b")

    @staticmethod
    def _small(df: DataFrame, most_rows: int) -> DataFrame:
        return F.broadcast(df) if df.count() <= most_rows else df

    def text_pairs(self) -> DataFrame:
        """(key_a, key_b): different texts with a shared span."""
        a, b = (self.window_sets.withColumnRenamed("key", k) for k in ("key_a", "key_b"))
        hot = a.join(b, "window").where("key_a < key_b").select("key_a", "key_b")
        return self.extended.select("key_a", "key_b").unionByName(hot).distinct()

    def passages(self) -> DataFrame:
        """(passage, doc_id): for spans in many records, which records hold them, without making pairs."""
        name = F.concat_ws("-", F.hex("window.h1"), F.hex("window.h2")).alias("passage")
        return self.window_sets.join(self.members(), "key").select(name, "doc_id").distinct()

    def members(self) -> DataFrame:
        """(key, doc_id): which records carry which text."""
        return self.keys.select("key", "doc_id").distinct()

    def record_pairs(self) -> DataFrame:
        """(doc_a, doc_b), the smaller id first: all records with a shared span, copies included."""
        members = self.members()
        a = members.select(F.col("key").alias("key_a"), F.col("doc_id").alias("a"))
        b = members.select(F.col("key").alias("key_b"), F.col("doc_id").alias("b"))
        across = self.text_pairs().join(a, "key_a").join(b, "key_b").where("a <> b")
        copied = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("key_a"))
        within = a.join(copied, "key_a", "left_semi").join(b, F.col("key_a") == F.col("key_b")).where("a < b")
        return (
            across.select("a", "b")
            .unionByName(within.select("a", "b"))
            .select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
            .distinct()
        )

    def shares(self) -> DataFrame:
        """(doc_id, n_chars, n_shared, share): for each record with shared text, how much of it stands elsewhere."""
        spans = (
            self.extended.select(F.col("key_a").alias("key"), F.struct(F.col("start_a").alias("a"), F.col("end_a").alias("b")).alias("s"))
            .unionByName(self.extended.select(F.col("key_b").alias("key"), F.struct(F.col("start_b").alias("a"), F.col("end_b").alias("b")).alias("s")))
            .unionByName(self.windows.select("key", F.struct("a", "b").alias("s")))
        )
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
        covered = spans.groupBy("key").agg(F.sort_array(F.collect_set("s")).alias("spans")).select(
            "key",
            F.aggregate(
                "spans",
                zero,
                lambda acc, s: F.struct(
                    (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["at"]))).alias("n"),
                    F.greatest(acc["at"], s["b"]).alias("at"),
                ),
                lambda acc: acc["n"],
            ).alias("covered"),
        )
        carried = self.keys.distinct()
        copies = carried.groupBy("key").agg(F.count_distinct("doc_id").alias("copies"))
        rows = carried.join(copies, "key").join(covered, "key", "left")
        n = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
        return rows.select("doc_id", "n_chars", n.alias("n_shared"), (n / F.col("n_chars")).alias("share")).where("n_shared > 0")
