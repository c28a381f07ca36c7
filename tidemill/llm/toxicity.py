"""Toxicity scores from subword-bag embeddings.

A word is the mean of the vectors of its character n-grams and of itself, hashed into a fixed table; a
text is the mean of its words, and a linear softmax on top gives the score.  Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled rows.  A misspelling never seen in training shares
most of its n-grams with the word it hides.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._common import lean, mix, slices, utf8

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: Words whose value a worker remembers at a time.
REMEMBERED = 400_000
#: Bytes of text counted at a time.
PART_BYTES = 2 << 20


#: Odd base of the n-gram hash (fixed arbitrary value), and what is taken off the ends of a token.
BASE = 0x9E3779B97F4A7C15
EDGES = string.punctuation + "«»„“”’‘…–—¡¿"


def subwords(words: list[str]):
    """For each of the words in turn, all at once: (word, table row) pairs of its n-grams and of the word itself."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[of]
    powers = np.multiply.accumulate(np.full(max(SIZES[-1], int(sizes.max(initial=1))), BASE, dtype=np.uint64))
    found = [(np.arange(len(words)), _bucket(np.add.reduceat(points * powers[place], starts), 0))] if len(words) else []
    for n in SIZES:
        at = np.flatnonzero(place + n <= sizes[of])
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            h += points[at + j] * powers[j]
        found.append((of[at], _bucket(h, n)))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)


def normal(token: bytes) -> str:
    """Lower case without punctuation at either end."""
    return token.decode("utf-8", "replace").lower().strip(EDGES)


@dataclass
class Model:
    """``vectors``: BUCKETS x size; ``weights``: 2 x size; ``bias``: 2.  ``constant`` replaces the score where only one class was seen."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    constant: float | None = None

    def scorer(self):
        """Function from a list of texts (bytes) to their scores; the softmax is linear, so each word has one number."""
        value = self.vectors @ (self.weights[1] - self.weights[0])
        bias = float(self.bias[1] - self.bias[0])
        known: dict[bytes, float] = {}

        def learn(tokens: list[bytes]) -> None:
            words = [normal(t) for t in tokens]
            word, row = subwords(words)
            mean = np.bincount(word, value[row], len(words)) / np.maximum(1, np.bincount(word, minlength=len(words)))
            known.update(zip(tokens, np.where([bool(w) for w in words], mean, 0.0).tolist()))

        def some(texts: list) -> list[float]:
            if self.constant is not None:
                return [self.constant] * len(texts)
            bags = [Counter((t or b"").split()) for t in texts]
            if len(known) > REMEMBERED:
                known.clear()
            new = {t for bag in bags for t in bag if t not in known}
            if new:
                learn(list(new))
            z = np.array([sum(map(mul, bag.values(), map(known.__getitem__, bag))) / max(bag.total(), 1) for bag in bags]) + bias
            return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()

        def score(texts: list) -> list[float]:
            out, part, size = [], [], 0
            for t in texts:  # a few texts at a time, to bound what is counted at once
                part.append(t)
                size += len(t or b"")
                if size > PART_BYTES:
                    out += some(part)
                    part, size = [], 0
            return out + (some(part) if part else [])

        return score


#: Smoothed log-odds (of documents with the n-gram) that a table row must exceed to be trained; others stay zero.
CUT = 1.5


def fit(bags: list[dict[str, int]], labels: np.ndarray, size: int = 4, steps: int = 60, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Model:
    """Trains on bags of normalised words by full-batch Adam; the classes count as they do in the sample.

    Rows whose n-grams tell the classes apart start from their log-odds, the rest are zero and stay so:
    rows that a handful of texts share would only let the model learn these texts by heart.
    """
    labels = np.asarray(labels, dtype=np.int64)
    rng = np.random.default_rng(seed)
    e = np.zeros((BUCKETS, size), dtype=np.float64)
    w = rng.normal(0, 0.05, (2, size))
    w[:, 0] += (-1, 1)
    b = np.zeros(2)
    yes, no = int((labels == 1).sum()), int((labels == 0).sum())
    if not yes or not no:
        return Model(e, w, b, float(yes > 0))
    words: dict[str, int] = {}
    di, wi, wt = [], [], []
    for d, bag in enumerate(bags):
        n = max(1, sum(bag.values()))
        for word, c in bag.items():
            di.append(d)
            wi.append(words.setdefault(word, len(words)))
            wt.append(c / n)
    di, wi, wt = np.array(di, dtype=np.int64), np.array(wi, dtype=np.int64), np.array(wt)
    si, rows = subwords(list(words)) if words else (np.zeros(0, dtype=np.int64),) * 2
    order = np.argsort(si, kind="stable")
    si, rows = si[order], rows[order]
    count = np.bincount(si, minlength=len(words))
    empty = words.get("")
    if empty is not None:  # tokens of punctuation alone
        rows, si, count = rows[si != empty], si[si != empty], np.where(np.arange(len(words)) == empty, 0, count)
    first = np.cumsum([0, *count])

    with_it = np.zeros((2, BUCKETS))  # documents of each class that have an n-gram
    cut = np.searchsorted(di, np.arange(len(bags) + 1))
    for d in range(len(bags)):
        own = wi[cut[d] : cut[d + 1]]
        if len(own):
            with_it[labels[d], np.unique(np.concatenate([rows[first[x] : first[x + 1]] for x in own]))] += 1
    odds = np.log((with_it[1] + 1) / (yes + 2)) - np.log((with_it[0] + no / yes) / (no + 2 * no / yes))
    e[:, 0] = np.sign(odds) * np.maximum(0, np.abs(odds) - CUT)
    on = e[:, 0] != 0
    e[on, 1:] = rng.normal(0, 0.05, (int(on.sum()), size - 1))

    sw = (1 / np.maximum(1, count))[si]
    si, bi, sw = si[on[rows]], rows[on[rows]], sw[on[rows]]
    live = np.zeros(len(words), dtype=bool)
    live[si] = True
    di, wi, wt = di[live[wi]], wi[live[wi]], wt[live[wi]]
    share = 1 / len(labels)
    target = np.eye(2)[labels]

    def spread(to, frm, weight, x, n):
        return np.stack([np.bincount(to, weight * x[frm, k], n) for k in range(size)], axis=1)

    scale = np.array([np.std(spread(di, wi, wt, spread(si, bi, sw, e, len(words)), len(bags))[:, 0])])
    e *= 2 / max(float(scale[0]), 1e-9)  # the texts' means start about as far apart as the softmax can tell
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]
    unit = float(np.abs(e).max()) or 1.0
    for t in range(1, steps + 1):
        doc = spread(di, wi, wt, spread(si, bi, sw, e, len(words)), len(bags))
        z = doc @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * share
        back = spread(bi, si, sw, spread(wi, di, wt, g @ w, len(words)), BUCKETS)
        for i, (x, d, r) in enumerate(((e, back, rate * unit * 0.2), (w, g.T @ doc, rate), (b, g.sum(axis=0), rate * 2))):
            m, v = state[i]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= r * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
            if i == 0:
                x *= 1 - decay
    return Model(e, w, b)


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500, sample_bytes: int = 32 << 20) -> Model:
    """Learns from at most ``sample`` rows of each class (those whose ids hash lowest), never from held-out ones or null labels.

    Of these, as many as have ``sample_bytes`` of text together, in the order of their hashes; whole texts each.  Of rows that
    repeat an id the smallest text counts.  Without labels of both classes the model scores all alike.
    """
    known = labels.where(~held_out(id_col)).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null")
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)

    def learn(batches):
        y, bags = [], []
        for b in batches:
            y += b.column(0).to_pylist()
            for t in utf8(b.column(1)):
                c = Counter()
                for token, n in Counter((t or b"").split()).items():
                    c[normal(token)] += n
                bags.append(c)
        order = np.argsort([hash_of(c.keys(), c.values()) for c in bags], kind="stable")
        m = fit([bags[i] for i in order], np.array(y, dtype=np.int64)[order])
        arrays = [pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (m.vectors, m.weights, m.bias)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([m.constant], pa.float64()), pa.array([sum(y)], pa.int64()), pa.array([len(y)], pa.int64())], names=["vectors", "weights", "bias", "constant", "toxic", "n"])

    # the sample's size bounds this broadcast, and what comes after it
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.distinct()), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("id"), "id", "y"))
    rows = found.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("y", "text")
    # one task learns and sends the model alone: texts, bags and what training holds never are the driver's
    got = rows.coalesce(1).mapInArrow(lean(learn), "vectors binary, weights binary, bias binary, constant double, toxic long, n long").collect()
    if not got:  # nothing to learn from, not even a partition
        return fit([], np.zeros(0))
    r = got[0]
    vectors, weights, bias = (np.frombuffer(x, dtype=np.float64).copy() for x in (r["vectors"], r["weights"], r["bias"]))
    model = Model(vectors.reshape(BUCKETS, -1), weights.reshape(2, -1), bias, r["constant"])
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    if model.constant is None:  # the sample takes the classes evenly; the score counts them as the labels do
        model.bias[1] += np.log(total[1] / total[0]) - np.log(r["toxic"] / (r["n"] - r["toxic"]))
    return model


def hash_of(words: Iterable[str], counts: Iterable[int]) -> int:
    """An order of the sample that doesn't depend on how the tasks ran."""
    return xxhash.xxh64_intdigest(" ".join(f"{w}:{c}" for w, c in zip(words, counts)).encode()) >> 1


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row; null and empty texts get the model's bias.

    Repeated rows and null ids are scored like any other; long texts are counted whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x size floats

    def run(batches):
        f = sent.value.scorer()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f(utf8(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``; repeated rows stay or go together."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        f = sent.value.scorer()
        for b in slices(batches):
            yield b.filter(pa.array([x < threshold for x in f(utf8(b.column(at)))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
