"""Most similar vectors for every vector: inverted lists, scanned by an adaptive dimension scan.

Vectors are scaled to length 1 and rotated at random, so that the first d of D dimensions are a random sample of
the distance. Each list keeps its members in column blocks. A scan adds up distances block by block over all
candidates at once, and after d dimensions drops a candidate whose partial distance p satisfies
p * D / d > limit * (1 + significance / sqrt(d)) ** 2: the hypothesis that it lies within the limit is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.keys import norm_id
from lorekeep.functions.times import instant_micros
from lorekeep.session import cut

SPACE = ["backend", "model", "dim"]
COLUMN_BLOCK = 16
MEMBER_ASKS, MEMBER, QUERY = 0, 1, 2  # roles of packed vectors
SIGNIFICANCE = 2.1
SPREADS = 3.0  # spreads that the share of a difference across a border may take up
AXES = 16  # main axes of the differences that are kept
MOST_BELOW = 1024  # lists below a top centre
_FITTED = pa.schema([("backend", pa.string()), ("model", pa.string()), ("dim", pa.int32()), ("centres", pa.binary()), ("share", pa.list_(pa.float64())), ("probes", pa.int32()), ("axes", pa.binary()), ("floor", pa.float64())])
_FITTED_BELOW = pa.schema([("space", pa.int32()), ("top", pa.int32()), ("centres", pa.binary()), ("blocks", pa.list_(pa.int32())), ("probes", pa.int32())])


@dataclass
class Lists:
    """The inverted lists of one space, fitted on a bounded sample; every row is indexed by them. Up to a bounded
    number there is one level; beyond it each top centre has lists of its own."""

    top: np.ndarray  # n_top x D, in rotated coordinates, length 1
    centres: np.ndarray  # n_lists x D, likewise; the same as top if there is one level
    start: np.ndarray  # the lists of top centre i are start[i] to start[i + 1]
    blocks: np.ndarray  # into how many blocks each list is split
    probes: int  # top centres to probe for the nearest neighbours
    inner: np.ndarray  # lists to probe below each top centre
    axes: np.ndarray  # D x m, main axes of the differences of near vectors, scaled by their spread
    floor: float  # the spread in all other directions

    def gaps(self, c: np.ndarray, reach: float) -> np.ndarray:
        """By pair of centres: how far the products of a vector with both may differ so that the border between
        them is within the span that a difference of length `reach` takes up across it."""
        apart = np.maximum(2 - 2 * c @ c.T, 1e-9)
        p = c @ self.axes
        sq = (p * p).sum(1)
        spread = np.maximum(sq[:, None] + sq[None, :] - 2 * p @ p.T, 0) / apart + self.floor
        return (reach + 1e-5) * np.sqrt(apart) * np.minimum(1, SPREADS * np.sqrt(spread))

    def near(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own list of each row of x, and (row, list) of the other lists that may hold a vector within reach and
        are not surely asked by it: one of two vectors is no farther from the border than half of what their
        difference takes up across it."""
        sims = x @ self.top.T
        own = sims.argmax(1)
        everyone = np.arange(len(x))
        close = sims[everyone, own][:, None] - sims <= self.gaps(self.top, reach)[own] / 2
        close[everyone, own] = True
        if len(self.centres) == len(self.top):
            close[everyone, own] = False
            return own, *np.nonzero(close)
        at, row, to = own.copy(), [], []
        for t in np.flatnonzero(close.any(0)):
            rows = np.flatnonzero(close[:, t])
            c = self.centres[self.start[t] : self.start[t + 1]]
            sims = x[rows] @ c.T
            best = sims.argmax(1)
            mine = own[rows] == t
            at[rows[mine]] = self.start[t] + best[mine]
            gap = self.gaps(c, reach)[best] * np.where(mine, 0.5, 1)[:, None]  # members of other tops do not ask back
            asked = sims[np.arange(len(rows)), best][:, None] - sims <= gap
            asked[np.arange(len(rows)), best] = ~mine
            i, j = np.nonzero(asked)
            row.append(rows[i])
            to.append(self.start[t] + j)
        return at, np.concatenate(row), np.concatenate(to)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own list of each row of x, and (row, list) of the lists to probe for its nearest neighbours."""
        n = min(self.probes, len(self.top))
        tops = np.argsort(-(x @ self.top.T), axis=1)[:, :n]
        if len(self.centres) == len(self.top):
            return tops[:, 0], np.repeat(np.arange(len(x)), n), tops.ravel()
        at, row, to = tops[:, 0].copy(), [], []
        for t in np.unique(tops):
            rows = np.flatnonzero((tops == t).any(1))
            order = self.start[t] + np.argsort(-(x[rows] @ self.centres[self.start[t] : self.start[t + 1]].T), axis=1)
            mine = tops[rows, 0] == t
            at[rows[mine]] = order[mine, 0]
            order = order[:, : self.inner[t]]
            row.append(np.repeat(rows, order.shape[1]))
            to.append(order.ravel())
        return at, np.concatenate(row), np.concatenate(to)


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _spread(x: np.ndarray, c: np.ndarray, near: float) -> tuple[np.ndarray, float]:
    """How the differences of near vectors spread: the main axes, scaled, and a bound for all other directions.

    Measured on the sample's pairs in one list with a cosine of at least `near`; the spread of the vectors around
    their centres counts like D more pairs, so it decides where the sample holds few near pairs.
    """
    own = (x @ c.T).argmax(1)
    d = x.shape[1]
    rest = (x - c[own]).astype(np.float64)
    spread = rest.T @ rest
    spread *= d / max(np.trace(spread), 1e-9)
    for k in np.unique(own):
        y = x[own == k][:2048].astype(np.float64)
        i, j = np.nonzero(np.triu(y @ y.T >= near, 1))
        for a in range(0, len(i), 100_000):
            delta = y[i[a : a + 100_000]] - y[j[a : a + 100_000]]
            delta /= np.maximum(np.linalg.norm(delta, axis=1, keepdims=True), 1e-9)
            spread += delta.T @ delta
    values, vectors = np.linalg.eigh(spread / max(np.trace(spread), 1e-9))
    m = min(AXES, d - 1)
    floor = float(values[-m - 1])
    return (vectors[:, d - m :] * np.sqrt(np.maximum(values[d - m :] - floor, 0))).astype(np.float32), floor


def _fit(x: np.ndarray, n_lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; an emptied list restarts at the row that fits worst."""
    c = x[np.random.default_rng(1).choice(len(x), n_lists, replace=False)].copy()
    for _ in range(rounds):
        sims = x @ c.T
        own = sims.argmax(1)
        worst = np.argsort(sims[np.arange(len(x)), own])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=n_lists) == 0)
        sums[empty] = x[worst[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def _probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that `recall` of the k nearest of a sample are in them."""
    own = (x @ c.T).argmax(1)
    few = x[:: max(1, len(x) // 200)]
    order = np.argsort(-(few @ c.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c))[None, :].repeat(len(few), 0), axis=1)
    nearest = np.argsort(-(few @ x.T), axis=1)[:, 1 : k + 1]
    needed = np.sort(np.take_along_axis(rank, own[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


def _unit(column: pa.ListArray, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def current_vectors(vectors: DataFrame, most_broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, backend, model, dim, vector, v1, v2): the usable current vector of each (doc_id, backend, model).

    Current is the row with the latest created_at (unreadable times are the oldest; among equal times the larger
    time string, then the larger fingerprint, so the choice is repeatable). A current vector that is null,
    empty, all zero, of another length than dim, or holds a null, NaN or infinity is left out together with its
    older versions. Ids are trimmed and in lower case, rows without id are left out. v1, v2 are 128 bits of
    fingerprint: equal vectors have equal ones. A row repeated exactly may come out as often.

    Only keys are shuffled: keys with one row, nearly all, pass where they are read.
    """
    rows = vectors.select(
        norm_id(F.col("doc_id")).alias("doc_id"), "backend", "model", F.col("dim").cast("int").alias("dim"), "vector",
        F.struct(instant_micros(F.col("created_at")).alias("at"), F.col("created_at").alias("text"),
                 F.xxhash64("vector", "dim").alias("v1"), F.xxhash64(F.lit(7), "dim", "vector").alias("v2")).alias("version"),
    ).where("doc_id is not null")
    keys = ["doc_id", "backend", "model"]
    latest = cut(
        rows.groupBy(*keys).agg(F.max("version").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n"), "latest"
    ).select(*(F.col(k).alias(f"_{k}") for k in keys), "latest")
    if latest.count() <= most_broadcast_rows:
        latest = F.broadcast(latest)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    usable = (
        "dim > 0 and size(vector) = dim and exists(vector, x -> x <> 0)"
        " and not exists(vector, x -> x is null or isnan(x) or abs(x) = float('infinity'))"
    )
    return (
        rows.join(latest, same, "left")
        .where(F.col("latest").isNull() | F.col("version").eqNullSafe(F.col("latest")))
        .where(usable)
        .select(*keys, "dim", "vector", F.col("version.v1").alias("v1"), F.col("version.v2").alias("v2"))
    )


class VectorIndex:
    """Inverted lists over all current vectors, by (backend, model, dim); vectors of different spaces never meet.

    Lists hold about `list_rows` vectors, however many there are: the centres are fitted on about `sample` vectors of
    a space, drawn by a hash of the id, and where more lists are needed than such a sample can tell apart, each top
    centre gets lists of its own, fitted in its own task on a bounded sample of its members. Samples only steer where
    candidates are sought; list sizes, candidates and results come from all rows. The centres are broadcast and take
    at most `centre_bytes` over all spaces, which bounds the number of lists; beyond it lists grow instead. A list
    expected to exceed `block_rows` members is split into cells that go to different tasks. More than `most_spaces`
    spaces are an error. Equal vectors are searched once; every document that has one shares its results.
    """

    def __init__(
        self, vectors: DataFrame, sample: int = 20_000, list_rows: int = 512, block_rows: int = 20_000, k: int = 10, recall: float = 0.95,
        most_spaces: int = 1000, centre_bytes: int = 64 << 20, near: float = 0.9,
    ):
        self.rows = current_vectors(vectors)
        self.spark = vectors.sparkSession
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        counted = self.rows.groupBy(*SPACE).agg(F.count("*").alias("n"), F.min(drawn).alias("first")).limit(most_spaces + 1).collect()
        if len(counted) > most_spaces:
            raise ValueError(f"more than {most_spaces} combinations of backend, model and dim")
        sizes = {tuple(r[c] for c in SPACE): r["n"] for r in counted}
        total = sum(n * key[2] for key, n in sizes.items())
        most = {key: max(1, int(centre_bytes * n / total / 4)) for key, n in sizes.items()}  # lists that the space may have
        keep = F.lit(False)
        for r in counted:
            here = F.lit(True)
            for c in SPACE:
                here = here & F.col(c).eqNullSafe(r[c])
            share = int(min(1.0, sample / r["n"]) * (1 << 30))
            keep = keep | (here & ((drawn < share) | (drawn == r["first"])))  # no space is without a row

        def fit(table: pa.Table) -> pa.Table:
            key = tuple(table.column(c)[0].as_py() for c in SPACE)
            x = np.unique(_unit(table.column("vector").combine_chunks(), key[2]), axis=0) @ rotation(key[2])
            c = _fit(x, int(max(1, min(sizes[key] // list_rows, len(x) // 16, most[key]))))
            share = np.bincount((x @ c.T).argmax(1), minlength=len(c)) / len(x)
            axes, floor = _spread(x, c, near)
            row = {**dict(zip(SPACE, key, strict=True)), "centres": c.tobytes(), "share": share.tolist(), "probes": _probes_for(x, c, k, recall), "axes": axes.tobytes(), "floor": floor}
            return pa.table({n: [v] for n, v in row.items()}, schema=_FITTED)

        fitted = self.rows.where(keep).select(*SPACE, "vector").groupBy(*SPACE).applyInArrow(fit, "backend string, model string, dim int, centres binary, share array<double>, probes int, axes binary, floor double").collect()
        self.spaces = [tuple(r[c] for c in SPACE) for r in fitted]
        if set(self.spaces) != set(sizes):
            raise RuntimeError(f"no sample for {set(sizes) - set(self.spaces)}")
        lists, below = [], {}
        for i, r in enumerate(fitted):
            key, share = self.spaces[i], np.array(r["share"])
            c = np.frombuffer(r["centres"], np.float32).reshape(-1, key[2])
            blocks = np.maximum(1, np.ceil(share * sizes[key] / block_rows)).astype(int)
            lists.append(Lists(c, c, np.arange(len(c) + 1), blocks, r["probes"], np.ones(len(c), int), np.frombuffer(r["axes"], np.float32).reshape(key[2], -1), r["floor"]))
            wanted = min(sizes[key] // list_rows, most[key])
            if wanted >= 2 * len(c):
                below[i] = np.clip(np.round(share * wanted), 1, MOST_BELOW).astype(int), share * sizes[key]
        if below:
            self._fit_below(lists, below, block_rows, k, recall)
        self.lists = self.spark.sparkContext.broadcast(lists)

    def _fit_below(self, lists: list[Lists], below: dict, block_rows: int, k: int, recall: float) -> None:
        """The second level: below[space] has, by top centre, how many lists it gets and how many members it has.
        About 32 members a list are drawn for the fit, each top centre is one task's group."""
        number = {s: i for i, s in enumerate(self.spaces)}
        known = self.spark.sparkContext.broadcast([x.top for x in lists])

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spaces = np.array([number[s] for s in zip(*(batch.column(c).to_pylist() for c in SPACE), strict=True)], int)
                chance = batch.column("drawn").to_numpy()
                for space in sorted(set(spaces) & set(below)):
                    at = np.flatnonzero(spaces == space)
                    d = known.value[space].shape[1]
                    x = _unit(batch.column("vector").take(pa.array(at)), d) @ rotation(d)
                    top = (x @ known.value[space].T).argmax(1)
                    n_lists, members = below[space]
                    kept = np.flatnonzero(chance[at] < (32 * n_lists / np.maximum(members, 1))[top])
                    columns = [np.full(len(kept), space, np.int32), top[kept].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array([v.tobytes() for v in x[kept]], pa.binary())], ["space", "top", "x"])

        def fit(table: pa.Table) -> pa.Table:
            space, top = table.column("space")[0].as_py(), table.column("top")[0].as_py()
            x = np.unique(np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(table.num_rows, -1), axis=0)
            n_lists, members = (v[top] for v in below[space])
            c = _fit(x, int(max(1, min(n_lists, len(x) // 16))))
            share = np.bincount((x @ c.T).argmax(1), minlength=len(c)) / len(x)
            blocks = np.maximum(1, np.ceil(share * members / block_rows)).astype(int)
            row = {"space": space, "top": top, "centres": c.tobytes(), "blocks": blocks.tolist(), "probes": _probes_for(x, c, k, recall)}
            return pa.table({n: [v] for n, v in row.items()}, schema=_FITTED_BELOW)

        chance = (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("drawn")
        drawn = self.rows.select(*SPACE, "vector", chance).mapInArrow(draw, "space int, top int, x binary")
        rows = drawn.groupBy("space", "top").applyInArrow(fit, "space int, top int, centres binary, blocks array<int>, probes int").collect()
        parts = {(r["space"], r["top"]): r for r in rows}
        for space in below:
            x = lists[space]
            got = [parts.get((space, t)) for t in range(len(x.top))]  # a top centre without members stays as it is
            centres = [np.frombuffer(r["centres"], np.float32).reshape(-1, x.top.shape[1]) if r else x.top[t : t + 1] for t, r in enumerate(got)]
            x.start = np.cumsum([0, *(len(c) for c in centres)])
            x.blocks = np.concatenate([np.array(r["blocks"], int) if r else x.blocks[t : t + 1] for t, r in enumerate(got)])
            x.inner = np.array([r["probes"] if r else 1 for r in got])
            x.centres = np.concatenate(centres)

    def _scatter(self, probe, query: bool, members_ask: bool) -> DataFrame:
        """The vectors packed by (space, list, block, chunk). probe(lists, x) -> own list and (row, list) probed.

        A list of one block gets its members and its queries once. A list of b blocks becomes a grid: its members
        are spread over b blocks and sent to all chunks, its queries over b chunks and sent to all blocks, so every
        pair meets in one cell and no cell holds more than a bounded share. With members_ask, members are queries
        of their own list.
        """
        number = {s: i for i, s in enumerate(self.spaces)}
        fitted = self.lists

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["space", "list", "block", "chunk", "role", "ids", "vectors"]
            for batch in batches:
                spaces = np.array([number.get(s, -1) for s in zip(*(batch.column(c).to_pylist() for c in SPACE), strict=True)], int)
                all_ids = np.stack([batch.column(c).to_numpy() for c in ("v1", "v2")], 1)
                asks = batch.column("asks").to_numpy(zero_copy_only=False)
                rows: tuple[list, ...] = tuple([] for _ in names)
                for space in np.unique(spaces[spaces >= 0]):
                    at = np.flatnonzero(spaces == space)
                    lists = fitted.value[space]
                    d = lists.top.shape[1]
                    ids, first, copy_of = np.unique(all_ids[at], axis=0, return_index=True, return_inverse=True)  # copies in a batch travel once
                    asking = np.zeros(len(ids), bool)
                    np.logical_or.at(asking, copy_of.ravel(), asks[at])  # and ask if any of them asks
                    at = at[first]
                    x = _unit(batch.column("vector").take(pa.array(at)), d) @ rotation(d)
                    own, row, to = probe(lists, x)
                    asked = asking[row]
                    row, to = row[asked], to[asked]
                    hashed = ids[:, 0].view(np.uint64)
                    split = lists.blocks[own] > 1
                    if members_ask:  # in a grid, members ask like any query
                        row, to = np.concatenate([row, np.flatnonzero(split)]), np.concatenate([to, own[split]])
                    everyone = np.arange(len(x))
                    zero = np.zeros(len(x), int)
                    role = MEMBER_ASKS if members_ask else MEMBER
                    sent = [(own[~split], zero[~split], zero[~split], everyone[~split], role)]
                    single = lists.blocks[to] == 1
                    zeros = np.zeros(single.sum(), int)
                    sent.append((to[single], zeros, zeros, row[single], QUERY))
                    for k in range(int(lists.blocks.max()) if (lists.blocks > 1).any() else 0):
                        there = split & (lists.blocks[own] > k)
                        home = (hashed[there] % lists.blocks[own[there]].astype(np.uint64)).astype(int)
                        sent.append((own[there], home, np.full(there.sum(), k), everyone[there], MEMBER))
                        there = ~single & (lists.blocks[to] > k)
                        chunk = (hashed[row[there]] // np.uint64(7919) % lists.blocks[to[there]].astype(np.uint64)).astype(int)
                        sent.append((to[there], np.full(there.sum(), k), chunk, row[there], QUERY))
                    for lst, block, chunk, who, role in sent:
                        order = np.lexsort((chunk, block, lst))
                        lst, block, chunk, who = lst[order], block[order], chunk[order], who[order]
                        changes = (np.diff(lst) != 0) | (np.diff(block) != 0) | (np.diff(chunk) != 0)
                        edges = np.flatnonzero(np.concatenate([[len(lst) > 0], changes, [len(lst) > 0]]))
                        for a, b in zip(edges[:-1], edges[1:], strict=True):
                            value = (int(space), int(lst[a]), int(block[a]), int(chunk[a]), role, ids[who[a:b]].tobytes(), x[who[a:b]].tobytes())
                            for column, v in zip(rows, value, strict=True):
                                column.append(v)
                kinds = (*[pa.int32()] * 5, pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

        asks = _is_query() if query else F.lit(True)
        packed = self.rows.select(*SPACE, "vector", "v1", "v2", asks.alias("asks"))
        return packed.mapInArrow(run, "space int, list int, block int, chunk int, role int, ids binary, vectors binary")

    def similar(self, least_cosine: float) -> DataFrame:
        """(space, a1, a2, b1, b2, cosine): pairs of different vectors with a cosine of at least least_cosine.

        Of two vectors on both sides of a border between lists, one is no farther from it than half of what their
        difference takes up across the border. That share of the difference is tested like the partial distances:
        it exceeds SPREADS times its spread, as measured on near vectors of the space, in 0.3 % of such pairs at most.
        Where the spread is large, as in vectors of low rank, the bound is that of the whole difference and no pair
        is lost. The scan drops about 2 % of pairs that lie just at the limit.
        """
        limit = 2 - 2 * least_cosine
        schema = "space int, a1 long, a2 long, b1 long, b2 long, cosine float"

        def probe(lists: Lists, x: np.ndarray):
            return lists.near(x, np.sqrt(limit))

        def scan(table: pa.Table) -> pa.Table:
            space, mid, m, qid, q = _unpack(table)
            found = []
            for a in range(0, len(q), 1024):
                for b in range(0, len(m), 4096):
                    i, j, dist = adaptive_scan(q[a : a + 1024], np.ascontiguousarray(m[b : b + 4096].T), np.full(len(q[a : a + 1024]), limit))
                    left, right = qid[a + i], mid[b + j]
                    first = (left[:, 0] < right[:, 0]) | (left[:, 0] == right[:, 0]) & (left[:, 1] < right[:, 1])
                    same = (left == right).all(1)
                    low, high = np.where(first[:, None], left, right), np.where(first[:, None], right, left)
                    found.append(np.rec.fromarrays([*low[~same].T, *high[~same].T, (1 - dist[~same] / 2).astype(np.float32)]))
            f = np.unique(np.concatenate(found)) if found else np.rec.fromarrays([np.empty(0, np.int64)] * 4 + [np.empty(0, np.float32)])
            columns = [np.full(len(f), space, np.int32), *(np.ascontiguousarray(f[n]) for n in f.dtype.names)]
            return pa.table(dict(zip(["space", "a1", "a2", "b1", "b2", "cosine"], columns, strict=True)))

        pairs = self._scatter(probe, False, True).groupBy("space", "list", "block", "chunk").applyInArrow(scan, schema)
        return pairs.groupBy("space", "a1", "a2", "b1", "b2").agg(F.max("cosine").alias("cosine"))

    def nearest(self, k: int, only_query_set: bool = True) -> DataFrame:
        """(space, a1, a2, b1, b2, cosine, rank): the k most similar different vectors of each asking vector."""
        schema = "space int, a1 long, a2 long, b1 long, b2 long, cosine float"

        def probe(lists: Lists, x: np.ndarray):
            return lists.ranked(x)

        def scan(table: pa.Table) -> pa.Table:
            space, mid, m, qid, q = _unpack(table)
            out = [np.empty((0, 4), np.int64)], [np.empty(0, np.float32)]
            for a in range(0, len(q), 512):
                who, where, dist = _top(q[a : a + 512], qid[a : a + 512], m, mid, k)
                out[0].append(np.concatenate([qid[a + who], mid[where]], 1))
                out[1].append((1 - dist / 2).astype(np.float32))
            ids, cosine = np.concatenate(out[0]), np.concatenate(out[1])
            columns = [np.full(len(ids), space, np.int32), *(np.ascontiguousarray(c) for c in ids.T), cosine]
            return pa.table(dict(zip(["space", "a1", "a2", "b1", "b2", "cosine"], columns, strict=True)))

        best = self._scatter(probe, only_query_set, False).groupBy("space", "list", "block", "chunk").applyInArrow(scan, schema).distinct()
        order = W.partitionBy("space", "a1", "a2").orderBy(F.desc("cosine"), "b1", "b2")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def members(self) -> DataFrame:
        """(space, backend, model, doc_id, v1, v2): which documents have which vector."""
        named = self.spark.createDataFrame(
            [(i, *s) for i, s in enumerate(self.spaces)], "space int, s_backend string, s_model string, s_dim int"
        )
        same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in SPACE]
        return self.rows.join(F.broadcast(named), same).select("space", "backend", "model", "doc_id", "v1", "v2").distinct()

    def nearest_documents(self, k: int) -> DataFrame:
        """(backend, model, doc_id, rank, near_doc, cosine): the k most similar other documents of each document
        of the query set, those with an equal vector included; among equal cosines the smaller id is first.

        Of each vector at most the k + 1 smallest ids are looked at, more can't be among the nearest k: one vector
        in a third of all documents costs no more than any other. Windows over them are cut before the shuffle.
        """
        members = self.members()
        asking = members.where(_is_query()).withColumnsRenamed({"v1": "a1", "v2": "a2"})
        own = asking.select("space", "a1", "a2", F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.lit(1.0).cast("float").alias("cosine")).distinct()
        near = own.unionByName(self.nearest(k).drop("rank"))
        of_vector = W.partitionBy("space", "b1", "b2").orderBy("near_doc")
        copies = members.select("space", F.col("v1").alias("b1"), F.col("v2").alias("b2"), F.col("doc_id").alias("near_doc"))
        few = copies.withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= k + 1).select("space", "b1", "b2", "near_doc")
        of_asking = W.partitionBy("space", "a1", "a2").orderBy(F.desc("cosine"), "near_doc")
        best = near.join(few, ["space", "b1", "b2"]).withColumn("n", F.row_number().over(of_asking)).where(F.col("n") <= k + 1)
        of_doc = W.partitionBy("space", "doc_id").orderBy(F.desc("cosine"), "near_doc")
        found = asking.join(best.drop("b1", "b2", "n"), ["space", "a1", "a2"]).where("near_doc <> doc_id")
        ranked = found.withColumn("rank", F.row_number().over(of_doc)).where(F.col("rank") <= k)
        return ranked.select("backend", "model", "doc_id", "rank", "near_doc", "cosine")

    def classes(self) -> DataFrame:
        """(space, backend, model, doc_id, class_id, v1, v2): documents with one vector are a class, named by the
        smallest of their ids."""
        members = self.members()
        names = members.groupBy("space", "v1", "v2").agg(F.min("doc_id").alias("class_id"))
        return members.join(names, ["space", "v1", "v2"])

    def linked_classes(self, least_cosine: float) -> DataFrame:
        """(backend, model, doc_id, class_id, n_links): every document with its class and to how many other classes
        the cosine is at least least_cosine. Copies are never expanded into pairs."""
        pairs = self.similar(least_cosine)
        ends = pairs.select("space", F.inline(F.array(F.struct(F.col("a1").alias("v1"), F.col("a2").alias("v2")), F.struct(F.col("b1").alias("v1"), F.col("b2").alias("v2")))))
        links = ends.groupBy("space", "v1", "v2").agg(F.count("*").alias("n_links"))
        rows = self.classes().join(links, ["space", "v1", "v2"], "left")
        return rows.select("backend", "model", "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def document_pairs(self, least_cosine: float) -> DataFrame:
        """(backend, model, doc_a, doc_b, cosine), the smaller id first: every pair of documents whose vectors
        have at least this cosine, documents with equal vectors included."""
        members = self.members()
        side = lambda x: members.select("space", "backend", "model", F.col("doc_id").alias(f"doc_{x}"), F.col("v1").alias(f"{x}1"), F.col("v2").alias(f"{x}2"))
        a, b = side("a"), side("b").drop("backend", "model")
        across = self.similar(least_cosine).join(a, ["space", "a1", "a2"]).join(b, ["space", "b1", "b2"])
        copied = members.groupBy("space", "v1", "v2").agg(F.count("*").alias("n")).where("n > 1").select("space", F.col("v1").alias("a1"), F.col("v2").alias("a2"))
        copies = a.join(copied, ["space", "a1", "a2"], "left_semi").join(
            b.withColumnsRenamed({"b1": "a1", "b2": "a2"}), ["space", "a1", "a2"]
        )
        columns = ["backend", "model", F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "cosine"]
        both = across.select("backend", "model", "doc_a", "doc_b", "cosine").unionByName(
            copies.select("backend", "model", "doc_a", "doc_b", F.lit(1.0).cast("float").alias("cosine"))
        )
        return both.where("doc_a <> doc_b").select(*columns).groupBy("backend", "model", "doc_a", "doc_b").agg(F.max("cosine").alias("cosine"))


def _is_query():
    """The query set: ids whose first eight hex digits are divisible by 50."""
    return F.coalesce(F.conv(F.substring("doc_id", 1, 8), 16, 10).try_cast("bigint") % 50 == 0, F.lit(False))


def _unpack(table: pa.Table):
    """Space, members (ids, vectors) and queries (ids, vectors) of one cell, each vector once."""
    parts: dict[int, list] = {MEMBER_ASKS: [], MEMBER: [], QUERY: []}
    d = 0
    for row in table.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
        d = len(row["vectors"]) // 4 // len(ids)
        parts[row["role"]].append((ids, np.frombuffer(row["vectors"], np.float32).reshape(-1, d)))

    def side(*roles: int) -> tuple[np.ndarray, np.ndarray]:
        own = [p for r in roles for p in parts[r]]
        ids = np.concatenate([np.empty((0, 2), np.int64), *(i for i, _ in own)])
        unique, first = np.unique(ids, axis=0, return_index=True)
        return unique, np.concatenate([np.empty((0, d), np.float32), *(v for _, v in own)])[first]

    return table.column("space")[0].as_py(), *side(MEMBER_ASKS, MEMBER), *side(MEMBER_ASKS, QUERY)


def adaptive_scan(q: np.ndarray, columns: np.ndarray, limits: np.ndarray, significance: float = SIGNIFICANCE):
    """(query, candidate, squared distance) of the candidates within the squared distance `limits` of each query.

    columns holds the candidates dimension by dimension. The first column block is added up for all pairs at
    once, later blocks only for the pairs that the test after each block leaves.
    """
    d = q.shape[1]
    end = min(COLUMN_BLOCK, d)
    head, block = q[:, :end], columns[:end]
    part = (head * head).sum(1)[:, None] + (block * block).sum(0)[None, :] - 2 * head @ block
    i, j = np.nonzero(part <= _bound(limits, end, d, significance)[:, None])
    acc = part[i, j].astype(np.float64)
    while end < d and len(i):
        start, end = end, min(end + COLUMN_BLOCK, d)
        acc += ((q[i, start:end] - columns[start:end, j].T) ** 2).sum(1)
        keep = acc <= _bound(limits, end, d, significance)[i]
        i, j, acc = i[keep], j[keep], acc[keep]
    return i, j, acc


def _bound(limits: np.ndarray, seen: int, d: int, significance: float) -> np.ndarray:
    return limits * (seen / d * (1 + significance / np.sqrt(seen)) ** 2 if seen < d else 1) + 1e-6


def _top(q: np.ndarray, qid: np.ndarray, m: np.ndarray, mid: np.ndarray, k: int, step: int = 512):
    """The k nearest members of each query: its limit is the k-th distance so far and shrinks block by block."""
    best = np.full((len(q), k), np.inf)
    where = np.zeros((len(q), k), np.int64)
    for b in range(0, len(m), step):
        limits = np.minimum(best[:, -1], 4.0)
        i, j, dist = adaptive_scan(q, np.ascontiguousarray(m[b : b + step].T), limits)
        other = (qid[i] != mid[b + j]).any(1)
        fresh = np.full((len(q), min(step, len(m) - b)), np.inf)
        fresh[i[other], j[other]] = dist[other]
        both = np.concatenate([best, fresh], 1)
        places = np.concatenate([where, np.broadcast_to(np.arange(b, b + fresh.shape[1]), fresh.shape)], 1)
        order = np.argsort(both, axis=1, kind="stable")[:, :k]
        best, where = np.take_along_axis(both, order, 1), np.take_along_axis(places, order, 1)
    who, rank = np.nonzero(np.isfinite(best))
    return who, where[who, rank], best[who, rank]
