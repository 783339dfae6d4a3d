"""Token ids of whole texts by a public byte-level BPE vocabulary, joined up a tree of halves.

A text is encoded as a monoid: halves are encoded on their own, and two neighbours are joined by encoding a
window around the seam again. The window grows on both sides until each of its ends lies on a cut that the
pre-tokenizer respects whatever stands beyond it, so every token outside the window is final.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Cuts no pre-token spans and no look-ahead crosses: visible before blank; letter, digit and mark classes apart.
# A mark before a letter is not one of them, since "'s" is a single pre-token.
SAFE_CUT = regex.compile(
    r"(?<=[!-~\p{L}\p{N}\p{P}\p{S}\p{M}])(?=[ \t\r\n])"
    r"|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])"
)
FIRST_WINDOW = 64


class Codec:
    """The vocabulary with the lengths of its tokens in bytes."""

    def __init__(self, ranks_file: bytes):
        lines = (line.split() for line in ranks_file.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.n_bytes[rank] = len(token)

    def leaf(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text)

    def encode(self, text: str, leaf_chars: int) -> np.ndarray:
        """Ids of text: a leaf as it is, anything longer as two halves joined."""
        if len(text) <= leaf_chars:
            return self.leaf(text) if text else np.empty(0, np.uint32)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left, leaf_chars), right, self.encode(right, leaf_chars))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """Ids of left + right from the ids of both: only a window around the seam is encoded again."""
        keep, window = 0, FIRST_WINDOW
        while window < len(left):
            at = max((m.start() for m in SAFE_CUT.finditer(left[-window:])), default=0)
            if at:
                keep = len(left) - window + at
                break
            window *= 2
        resume, window = len(right), FIRST_WINDOW
        while window < len(right):
            if found := SAFE_CUT.search(right[:window]):
                resume = found.start()
                break
            window *= 2
        seam = self.leaf(left[keep:] + right[:resume])
        return np.concatenate(
            [self._without_tail(left_ids, left[keep:]), seam, self._without_head(right_ids, right[:resume])]
        )

    def _without_tail(self, ids: np.ndarray, tail: str) -> np.ndarray:
        return ids[: len(ids) - self._count(ids[::-1], tail)]

    def _without_head(self, ids: np.ndarray, head: str) -> np.ndarray:
        return ids[self._count(ids, head) :]

    def _count(self, ids: np.ndarray, piece: str) -> int:
        """How many of ids make up piece; its ends are pre-token boundaries, so a token ends there."""
        n = len(piece.encode())
        return int(np.searchsorted(np.cumsum(self.n_bytes[ids[:n]]), n)) + 1 if n else 0


@lru_cache(maxsize=4)
def _codec(ranks_file: bytes) -> Codec:
    return Codec(ranks_file)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    leaf_chars: int = 4096,
    part_chars: int = 1 << 20,
) -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null or empty text gives an empty list.

    Strings that look like special tokens are plain text. Rows repeat as they do in docs, other columns are
    ignored, an empty table gives none. Texts of at most part_chars are encoded where they are read, without a
    shuffle. Longer ones are cut into parts that spread over the cluster, are encoded there and are joined
    pairwise. The vocabulary file (under 1 MB) is read once and broadcast.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            ids = [codec.encode(t, leaf_chars) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            ids = [codec.encode(t, leaf_chars) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], [*batch.schema.names, "ids"])

    def join_parts(parts: pa.Table) -> pa.Table:
        codec = _codec(ranks.value)
        parts = parts.sort_by("part")
        level = [
            (t, np.asarray(ids.values, dtype=np.uint32)) for t, ids in zip(parts.column("text").to_pylist(), parts.column("ids"), strict=True)
        ]
        while len(level) > 1:
            pairs = zip(level[::2], level[1::2], strict=False)
            joined = [(a + b, codec.join(a, x, b, y)) for (a, x), (b, y) in pairs]
            level = joined + level[len(level) & ~1 :]
        return pa.table({"doc_id": parts.column("doc_id").slice(0, 1), "ids": _lists([level[0][1]])})

    n = F.length("text")
    short = rows.where(n <= part_chars).mapInArrow(encode, f"doc_id {id_type}, ids array<int>")
    numbers = F.sequence(F.lit(0), F.floor((n - 1) / part_chars).cast("int"))
    parts = (
        rows.where(n > part_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "text", F.explode(numbers).alias("part"))
        .select("row", "doc_id", "part", F.col("text").substr(F.col("part") * part_chars + 1, F.lit(part_chars)).alias("text"))
        .repartition("row", "part")
    )
    long = (
        parts.mapInArrow(encode_part, f"row long, doc_id {id_type}, part int, text string, ids array<int>")
        .groupBy("row")
        .applyInArrow(join_parts, f"doc_id {id_type}, ids array<int>")
    )
    return short.unionByName(long)


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of ids; decoding concatenates, so it distributes over any split of the list."""
    with open(vocabulary, "rb") as f:
        return _codec(f.read()).bpe.decode(ids)
