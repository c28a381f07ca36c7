"""Embedding near-duplicates by product quantisation.

Unit vectors go to coarse inverted lists; what remains after the list's centre is coded by subspace.  A
query probes the lists whose cells begin within a margin of it, ranks the list's members by asymmetric distance from
lookup tables, keeps those that the quantisation error could put within the radius, and checks these by exact cosine.

A vector within the radius r lies behind the border of another cell only if the difference of the two, projected on the line
between the centres, reaches it.  For differences without a favoured direction that projection has the deviation r / sqrt(d),
d being the effective dimension; the margin is ``DEVIATIONS`` of it, at most r.  ``exact`` takes r itself, which
by the triangle inequality loses nothing, but leaves little to prune in many dimensions.

Lists are cut into blocks of bounded size; a block compares its members with its queries at a time and passes on link
counts and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import Scratch, lean
from .components import connected_components, forest

#: Vectors the codebooks are fitted on at most (those whose ids hash lowest).
SAMPLE = 16_000
LISTS = 4096
#: Margin of the probes in deviations of a random difference's projection.
DEVIATIONS = 2.0
#: Rows whose distances to all centres are held at a time.
ROWS = 512
SUBSPACES, CODES = 8, 256
#: Members and queries of one block, about.
MEMBERS, QUERIES = 1024, 2048


@dataclass
class Codebook:
    centres: np.ndarray  # lists x dimensions
    codes: list  # per subspace: codes x its dimensions
    cuts: list  # bounds of the subspaces
    spread: float = 1.0  # effective dimension of what remains after the centres

    def encode(self, x: np.ndarray):
        """List, codes and quantisation error of unit vectors."""
        lists = np.empty(len(x), dtype=np.int64)
        for i in range(0, len(x), 4096):
            lists[i : i + 4096] = _nearest(x[i : i + 4096], self.centres)
        rest = x - self.centres[lists]
        codes = np.empty((len(x), len(self.codes)), dtype=np.uint8)
        for s, book in enumerate(self.codes):
            part = rest[:, self.cuts[s] : self.cuts[s + 1]]
            codes[:, s] = _nearest(part, book)
            rest[:, self.cuts[s] : self.cuts[s + 1]] -= book[codes[:, s]]
        return lists, codes, np.sqrt((rest * rest).sum(axis=1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(at, x[:, d], k)
            centres[n > 0, d] = total[n > 0] / n[n > 0]
    return centres


def fit(x: np.ndarray, lists: int, seed: int = 7) -> Codebook:
    centres = _kmeans(x, lists, 8, seed)
    rest = x - centres[_nearest(x, centres)]
    m = min(SUBSPACES, x.shape[1])
    cuts = [x.shape[1] * i // m for i in range(m + 1)]
    v = np.linalg.eigvalsh(rest.T @ rest)
    return Codebook(centres, [_kmeans(rest[:, a:b], CODES, 5, seed + s) for s, (a, b) in enumerate(zip(cuts, cuts[1:]))], cuts, float(v.sum() ** 2 / max((v * v).sum(), 1e-300)))


def probes(x: np.ndarray, own: np.ndarray, b: Codebook, reach: float, exact: bool = False):
    """Pairs of a row of ``x`` (of the list ``own``) and a list to probe, with the distance to its centre."""
    c = b.centres
    margin = reach if exact else min(reach, DEVIATIONS * reach / math.sqrt(max(b.spread, 1.0)))
    c2 = (c * c).sum(axis=1)
    rows, lists, away = [], [], []
    for i in range(0, len(x), ROWS):
        part, o = x[i : i + ROWS], own[i : i + ROWS]
        at = np.arange(len(part))
        d2 = np.maximum(0, (part * part).sum(axis=1)[:, None] + c2[None, :] - 2 * part @ c.T)
        homes, home = np.unique(o, return_inverse=True)
        apart = np.sqrt(np.maximum(0, c2[homes][:, None] + c2[None, :] - 2 * c[homes] @ c.T))[home]
        border = (d2 - d2[at, o][:, None]) / np.maximum(2 * apart, 1e-12)  # distance to the plane between own cell and the other
        border[at, o] = 0
        r, k = np.nonzero(border <= margin + 1e-9)
        rows.append(r + i)
        lists.append(k)
        away.append(np.sqrt(d2[r, k]))
    return tuple(np.concatenate(z) if z else np.zeros(0) for z in (rows, lists, away))


def _units(column: pa.Array) -> np.ndarray:
    a = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64)
    return a.reshape(len(column), -1)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", exact: bool = False) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Vectors link if their labels are equal and not null, their dimensions agree and their cosine is at least ``threshold``.
    Null and zero vectors and those with null or non-finite components link with nothing: they are their own component.
    Links are found through the index (see above; ``exact`` finds all); none is made up.
    Equal vectors are one node with a count.  Rows that repeat an id count as vectors of their own; null ids take part, and a
    component whose ids are all null has a null id and isn't kept.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pq")
    reach = math.sqrt(2 - 2 * threshold) + 1e-9

    def prepare(batches):
        for b in batches:
            units = []
            for v, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a = np.array([] if v is None or label is None or None in v else v, dtype=np.float64)
                top = np.abs(a).max() if len(a) and np.isfinite(a).all() else 0
                a = a / top if top else a  # so that squares neither overflow nor vanish
                units.append((a / np.sqrt(a @ a)).tobytes() if top else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(units, pa.binary())], names=["vec_id", "label", "u"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = scratch.save(rows.mapInArrow(lean(prepare), "vec_id long, label string, u binary"), "rows")
    some = rows.where("u is not null").groupBy("label", "u").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    nodes = scratch.save(some.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.octet_length("u")), "nodes")
    total, most = nodes.groupBy("label").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    # a third at most, so that the centres fit what they haven't seen as well as what they have
    sample = nodes.select("dim", "u").orderBy(F.xxhash64("label", "u"), "u").limit(min(SAMPLE, max(CODES, total // 3))).toArrow()
    books = {}
    for dim in set(sample["dim"].to_pylist()):
        at = np.array(sample["dim"]) == dim
        # lists go with the root of the largest label's vectors, each label having its own cells
        books[dim] = fit(_units(sample["u"].filter(pa.array(at)).combine_chunks()), min(LISTS, max(4, math.ceil(math.sqrt(most)))))
    sent = spark.sparkContext.broadcast(books)  # bounded by LISTS and the dimensions

    def book(dim: int) -> Codebook:
        if dim not in sent.value:  # no vector of this length in the sample: one list around zero
            sent.value[dim] = Codebook(np.zeros((1, dim // 8)), [], [0])
        return sent.value[dim]

    def by_dim(b):
        dims = np.array(b.column("dim"))
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            yield int(dim), part, _units(part.column("u"))

    def index(batches):
        for b in batches:
            for dim, part, x in by_dim(b):
                lists, codes, error = book(dim).encode(x)
                far = np.sqrt(((x - book(dim).centres[lists]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("label"), part.column("dim"), pa.array(lists), part.column("u"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(far), part.column("n")], names=["node", "label", "dim", "list", "u", "code", "error", "far", "n"])

    members = scratch.save(nodes.select("node", "label", "dim", "u", "n").mapInArrow(lean(index), "node long, label string, dim int, list long, u binary, code binary, error double, far double, n long"), "members")
    cells = ["label", "dim", "list"]

    def probe(batches):
        for b in batches:
            for dim, part, x in by_dim(b):
                i, lists, away = probes(x, np.array(part.column("list")), book(dim), reach, exact)
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(i)), part.column("label").take(pa.array(i)), part.column("dim").take(pa.array(i)), pa.array(lists.astype(np.int64)), pa.array(away)], names=["node", *cells, "away"])

    probed = members.select("node", "label", "dim", "list", "u").mapInArrow(lean(probe), "node long, label string, dim int, list long, away double")
    sizes = scratch.save(members.groupBy(*cells).agg(F.count("*").alias("size"), F.max("far").alias("radius")), "sizes")
    asked = probed.join(sizes, cells).where(F.col("away") <= F.col("radius") + reach).select(*cells, "node", "size")
    asked = scratch.save(asked, "asked")
    loads = scratch.save(asked.groupBy(*cells).agg(F.count("*").alias("load")), "loads")
    deal = lambda c, most: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    of = lambda c, parts: F.pmod(F.xxhash64(c), parts).cast("int")
    nothing = F.lit(None)
    queries = asked.join(loads, cells).join(members.select("node", "u"), "node")
    queries = queries.select(*cells, of("node", deal("load", QUERIES)).alias("q"), F.explode(F.sequence(F.lit(0), deal("size", MEMBERS) - 1)).alias("m"), "node", "u", nothing.cast("binary").alias("code"), nothing.cast("double").alias("error"), nothing.cast("long").alias("n"))
    kept = members.join(loads, cells).join(sizes.select(*cells, "size"), cells)
    kept = kept.select(*cells, F.explode(F.sequence(F.lit(0), deal("load", QUERIES) - 1)).alias("q"), of("node", deal("size", MEMBERS)).alias("m"), "node", "u", "code", "error", "n")

    def block(table: pa.Table) -> pa.Table:
        member = np.array(table["code"].is_valid())
        none = pa.table({"node": pa.array([], pa.int64()), "to": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if not member.any() or member.all():
            return none
        dim, at = table["dim"][0].as_py(), table["list"][0].as_py()
        b, x = book(dim), _units(table["u"].combine_chunks())
        node = np.array(table["node"])
        q, y, error = x[~member], x[member], np.array(table["error"].filter(pa.array(member)))
        weight, codes = np.array(table["n"].filter(pa.array(member))), np.frombuffer(b"".join(table["code"].filter(pa.array(member)).to_pylist()), dtype=np.uint8).reshape(len(y), -1)
        ids, own = node[member], node[~member]
        lefts, rights, counts = [], [], []
        for i in range(0, len(q), 256):
            rest = q[i : i + 256] - b.centres[at]
            if b.codes:
                far = np.zeros((len(rest), len(y)))
                for s, bk in enumerate(b.codes):
                    part = rest[:, b.cuts[s] : b.cuts[s + 1]]
                    lookup = (part * part).sum(axis=1)[:, None] + (bk * bk).sum(axis=1)[None, :] - 2 * part @ bk.T
                    far += lookup[:, codes[:, s]]
            else:
                far = np.repeat((rest * rest).sum(axis=1)[:, None], len(y), axis=1)
            near = far <= (reach + error[None, :] + 1e-7) ** 2
            a, c = np.nonzero(near)
            ok = np.empty(len(a), dtype=bool)
            for j in range(0, len(a), 100_000):
                ok[j : j + 100_000] = np.einsum("ij,ij->i", q[i + a[j : j + 100_000]], y[c[j : j + 100_000]]) >= threshold
            ok &= own[i + a] != ids[c]
            a, c = a[ok], c[ok]
            counts.append(np.bincount(a, weight[c], len(rest)).astype(np.int64))
            if len(a):
                f = forest(own[i + a], ids[c])
                lefts.append(f[0])
                rights.append(f[1])
        links = np.concatenate(counts)
        on = links > 0
        nodes_, to = np.concatenate([own[on], *lefts]), np.concatenate([own[on], *rights])
        return pa.table({"node": pa.array(nodes_), "to": pa.array(to), "links": pa.array(np.concatenate([links[on], np.zeros(len(nodes_) - int(on.sum()), dtype=np.int64)]))})

    found = scratch.save(queries.unionByName(kept).groupBy(*cells, "q", "m").applyInArrow(block, "node long, to long, links long"), "found")
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> to").select(F.col("node").alias("u"), F.col("to").alias("v")), scratch)
    rooted = nodes.join(roots, "node", "left").select("node", "label", "u", "low", "n", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(ids, "root").join(counts, "node", "left").select("label", "u", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    classes = scratch.save(classes, "classes")
    scratch.drop("asked", "found", "loads", "sizes", "members")
    out = rows.where("u is not null").join(classes, ["label", "u"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("u is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
