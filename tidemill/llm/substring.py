"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every ``window`` consecutive words, the ``seed``-word run with the
smallest hash (the rightmost on ties) is an anchor, so two equal windows share their anchor at the
same place.  Each window belongs to exactly one anchor, and the windows of an anchor form one run.
Documents are joined on anchors; each shared seed is extended both ways over its run of windows.
Seeds whose whole extension is equal form a class, of which only the first occurrence has to be
looked at further; where one anchor has several classes, their windows are compared one by one.
Equal windows that overlap add up to maximal repeats, which are cut from all but their first place.

Nothing is compared pair by pair, so a passage in a third of all documents costs rows in
proportion to its occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from ._common import Scratch, lean, mix, utf8

#: Odd bases of the polynomial hashes of bytes and of words: fixed arbitrary values.
BYTE_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_BASE = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Bytes hashed at a time.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def _hash_piece(data: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of the words in ``data`` (bytes; cut at separators)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    value = np.where(blank, 0, data.astype(np.uint64) + np.uint64(1))[starts[0] :]
    starts = starts - starts[0]
    spans = np.diff(np.r_[starts, len(value)])
    at = np.arange(len(value)) - np.repeat(starts, spans)
    return mix(np.add.reduceat(value * _powers(BYTE_BASE[which], int(spans.max()))[at], starts))


def word_hashes(text: bytes, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of a text of any length, in pieces of bounded size."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            while end < len(text) and text[end] != 32 and not 9 <= text[end] <= 13:
                end += 1
        out.append(_hash_piece(np.frombuffer(text, dtype=np.uint8, count=min(end, len(text)) - at, offset=at), which))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _grams(w: np.ndarray, k: int, which: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    n, g = len(w) - k + 1, np.zeros(max(0, len(w) - k + 1), dtype=np.uint64)
    p = _powers(WORD_BASE[which], k)
    for j in range(k):
        g += w[j : j + n] * p[j]
    return mix(g)


def anchors(text: bytes, window: int, seed: int, detail: bool = True):
    """Of each anchor: its hash, hash of its whole extension, first window, number of windows.

    Without ``detail`` only the hashes of the anchors.
    """
    w = word_hashes(text)
    n = len(w) - window + 1
    if n <= 0:
        return None
    g = _grams(w, seed, 0)
    low, at = g[:n].copy(), np.zeros(n, dtype=np.int32)
    for j in range(1, window - seed + 1):
        x = g[j : j + n]
        less = x <= low
        low[less] = x[less]
        at[less] = j
    place = at + np.arange(n)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    if not detail:
        return low[first]
    count = np.diff(np.r_[first, n])
    w2 = word_hashes(text, 1)
    p = _powers(WORD_BASE[1], window + int(count.max()))
    whole = np.zeros(len(first), dtype=np.uint64)
    length = count + window - 1
    for j in range(int(length.max())):
        on = length > j
        whole[on] += w2[first[on] + j] * p[j]
    return low[first], mix(whole + length.astype(np.uint64)), first, count


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _anchor_rows(window: int, seed: int, detail: bool):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            found, keys = [], []
            for key, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = anchors(unzip.decompress(z), window, seed, detail)
                if x is not None:
                    found.append(x)
                    keys.append(np.full(len(x[0]) if detail else 0, key, dtype=np.int64))
            if not found:
                continue
            if not detail:
                h, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(h), _long(c)], names=["h", "c"])
                continue
            h, r, a, n = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([_long(h), _long(r), _long(np.concatenate(keys)), _long(a), _long(n)], names=["h", "r", "key", "a", "n"])

    return run


def _window_rows(window: int):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for key, z, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                g = _grams(word_hashes(unzip.decompress(z), 1), window, 1)
                a = np.array([x["a"] for x in runs], dtype=np.int64)
                n = np.array([x["n"] for x in runs], dtype=np.int64)
                h = np.repeat(np.array([x["h"] for x in runs], dtype=np.int64), n)
                at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([_long(h), _long(g[at]), _long(np.full(len(at), key)), _long(at)], names=["h", "w", "key", "a"])

    return run


def _cut(text: bytes, spans: list | None) -> tuple[int, int, bytes, bytes]:
    """Words, words removed, kept words joined by a blank, and the text without the spans but with its own white space."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words), text
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, [x["s"] for x in spans], 1)
    np.add.at(edge, [x["e"] for x in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = [w for w, x in zip(words, gone.tolist()) if not x]
    data = np.frombuffer(text, dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    stay = np.ones(len(data), dtype=bool)
    if len(starts):
        stay[starts[0] :] = np.repeat(~gone, np.diff(np.r_[starts, len(data)]))
    return len(words), int(gone.sum()), b" ".join(kept), data[stay].tobytes()


def _cut_rows(batches):
    """Carries the column ``rest`` along."""
    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        rows = [_cut(unzip.decompress(z), s) for z, s in zip(b.column("z").to_pylist(), b.column("spans").to_pylist())]
        n, gone, kept, text = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(text, pa.binary()).cast(pa.string()), b.column("rest")], names=["key", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "rest"])


def _pack(batches):
    zip_ = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zip_.compress(t or b"") for t in utf8(b.column(2))], pa.binary()), b.column(3)], names=["key", "doc_id", "z", "rest"])


def remove_repeats(docs: DataFrame, window: int = 20, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Removes each word that a window of ``window`` words covers which also starts earlier in the corpus.

    Earlier: in a smaller id, or further up in the same document; null ids come last, and rows that
    repeat an id count as documents of their own.  Returns per row ``key`` (internal), ``doc_id``, ``n_words``,
    ``n_removed``, ``kept_sha256`` (of the kept words joined by one blank) and ``kept_text`` (the text
    without the removed words, its other white space as it was; unchanged if nothing goes).
    Null text is an empty one.  Columns named in ``carry`` come back as fields of the struct ``rest``.  Texts go between the steps as zstd blocks, to halve what is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rest = F.struct(*carry) if carry else F.lit(0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))
    packed = rows.mapInArrow(lean(_pack), T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("z", T.BinaryType()), rows.schema["rest"]]))
    texts = scratch.save(packed, "texts")
    if not texts.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        # ids that repeat or are missing: give every row a key of its own, in the order of ids
        texts = scratch.save(texts.orderBy(F.col("doc_id").asc_nulls_last(), "z").withColumn("key", F.monotonically_increasing_id()), "ordered")
    pairs = texts.select("key", "z")
    counted = pairs.mapInArrow(lean(_anchor_rows(window, seed, False)), "h long, c long")
    shared = scratch.save(counted.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"), "shared")
    seeds = pairs.mapInArrow(lean(_anchor_rows(window, seed, True)), "h long, r long, key long, a long, n long")
    seeds = scratch.save(seeds.join(shared, "h"), "seeds")
    classes = scratch.save(seeds.groupBy("h", "r").agg(F.min(F.struct("key", "a")).alias("first"), F.min("n").alias("n"), F.count("*").alias("c")), "classes")
    again = seeds.join(classes.where("c > 1").select("h", "r", "first"), ["h", "r"]).where("key <> first.key or a <> first.a").select("key", F.col("a").alias("s"), (F.col("a") + F.col("n") + (window - 1)).alias("e"))
    several = scratch.save(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "several")
    runs = classes.join(several, "h").select(F.col("first.key").alias("key"), F.struct("h", F.col("first.a").alias("a"), "n").alias("run"))
    runs = runs.groupBy("key").agg(F.collect_list("run").alias("runs"))  # as many as the one document has anchors
    windows = pairs.join(runs, "key").select("key", "z", "runs").mapInArrow(lean(_window_rows(window)), "h long, w long, key long, a long")
    windows = scratch.save(windows, "windows")
    firsts = windows.groupBy("h", "w").agg(F.min(F.struct("key", "a")).alias("first"), F.count("*").alias("c")).where("c > 1")
    firsts = scratch.save(firsts.drop("c"), "firsts")
    inner = windows.join(firsts, ["h", "w"]).where("key <> first.key or a <> first.a").select("key", F.col("a").alias("s"), (F.col("a") + window).alias("e"))
    spans = again.unionByName(inner).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = scratch.save(spans, "spans")
    out = T.StructType([*T._parse_datatype_string("key long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string").fields, texts.schema["rest"]])
    return texts.join(spans, "key", "left").select("key", "doc_id", "z", "spans", "rest").mapInArrow(lean(_cut_rows), out)
