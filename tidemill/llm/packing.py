"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Documents longer than the capacity are cut; every piece then has one of at most ``capacity`` lengths.
The plan is made from the histogram of lengths, whose size the capacity bounds whatever the
corpus holds: lengths in falling order, each put into the tightest open bin, which a segment tree
over remaining capacities finds in logarithmic time.  Pieces of equal length are placed as runs of bins, which
gives what placing them one by one gives.  A run's remaining capacity at least halves each time it
takes pieces, so the plan has at most 8 x capacity x log2(capacity) rules and is safe to broadcast.
Pieces find their rule by length and by rank among the pieces of their length.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import Scratch, lean, slices

#: Pre-tokenisation of the byte-level vocabulary (public, as its README gives it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the pattern's ``\s`` matches (the property White_Space), and the runs of it that don't go through the pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 20_000
LONG_RUN = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{RUN},}}")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """Encoder of a byte-level BPE file of the ``tokenizers`` library.

    Gives the ids that ``tokenizers`` gives with ``add_special_tokens=False`` (special tokens that occur in a text
    keep their ids, as there), about four times as fast: merge order equals id order in these files.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    of = _byte_of()
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(encoder, text: str) -> np.ndarray:
    """Ids of a text of any kind.

    The pattern's look-ahead keeps a state for each character of a run of white space, which fails on a million of them.  Long
    runs are one piece, less their last character if a text goes on after them, and are given to the merges as such.
    """
    if len(text) < RUN or not (runs := [m.span() for m in LONG_RUN.finditer(text)]):
        return encoder.encode_to_numpy(text, allowed_special="all")
    out, at = [], 0
    for a, b in runs:
        out.append(encoder.encode_to_numpy(text[at:a], allowed_special="all"))
        # the text goes on, unless a special token cuts it off here
        at = b if b == len(text) or any(text.startswith(x, b) for x in encoder.special_tokens_set) else b - 1
        out.append(np.array(encoder._encode_single_piece(text[a:at].encode("utf-8", "replace")), dtype=np.uint32))
    return np.concatenate([*out, encoder.encode_to_numpy(text[at:], allowed_special="all")])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class CapacityTree:
    """Segment tree over remaining capacities: which hold open bins, and the smallest that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.has = bytearray(2 * self.size)

    def set(self, remaining: int, on: bool) -> None:
        i = self.size + remaining
        self.has[i] = on
        while i > 1:
            i //= 2
            self.has[i] = self.has[2 * i] or self.has[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length`` with an open bin."""
        i = self.size + length
        if self.has[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.has[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.has[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first rank, end rank, first bin, pieces a bin, offset in the bin) of best-fit decreasing."""
    tree, runs, rules, bins = CapacityTree(capacity), {}, [], 0

    def leave(start: int, n: int, remaining: int) -> None:
        if n and remaining:
            if not runs.setdefault(remaining, []):
                tree.set(remaining, True)
            runs[remaining].append((start, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, start = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                start, n = runs[remaining].pop()
                if not runs[remaining]:
                    tree.set(remaining, False)
            per = remaining // length
            full = min(n, left // per)
            extra = min(left - full * per, per) if full < n else 0
            if full:
                rules.append((length, rank, rank + full * per, start, per, capacity - remaining))
                rank += full * per
                leave(start, full, remaining - per * length)
            if extra:
                rules.append((length, rank, rank + extra, start + full, extra, capacity - remaining))
                rank += extra
                leave(start + full, 1, remaining - extra * length)
            used = full + (extra > 0)
            leave(start + used, n - used, remaining)
            left = histogram[length] - rank
    return rules


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece: where it starts, its length and checksum, its task and its rank among that task's pieces of its length."""

    def run(batches):
        from pyspark import TaskContext

        encoder, task, ranks = load_encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(encoder, text or "").astype("<u4"), np.array([end_id], dtype="<u4"))
                cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for piece, (x, y) in enumerate(zip(cut, cut[1:])):
                    part = ids[x:y]
                    out.append((doc, piece, x, y - x, zlib.crc32(part.tobytes()), task, int(ranks[y - x]), part.tolist() if with_ids else None))
                    ranks[y - x] += 1
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.list_(pa.int64()))])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids array<long>")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Places every document's tokens, plus ``end_id``, into sequences of at most ``capacity`` tokens.

    Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, on request, ``ids``.
    Only longer documents are cut; all their pieces but the first have full length.  Null text is an empty
    one (a piece of just ``end_id``).  Repeated rows and null ids are documents like any other.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(token_pieces(docs, vocabulary or default_vocabulary(), capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = scratch.save(pieces.groupBy("task", "length").agg(F.count("*").alias("c")), "counts")
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    rules = plan(histogram, capacity)
    assert len(rules) <= 8 * capacity * max(1, math.ceil(math.log2(capacity)))
    rules = spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rules], pa.int64()) for i in range(6)], names=["length", "rank0", "rank1", "bin", "per", "base"]))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    nth = F.col("rank") - F.col("rank0")
    placed = ranked.join(F.broadcast(rules), "length").where("rank >= rank0 and rank < rank1").select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.expr("(rank - rank0) div per")).alias("sequence_id"), (F.col("base") + nth % F.col("per") * F.col("length")).alias("offset"), *(["ids"] if with_ids else [])
    )
    return placed
