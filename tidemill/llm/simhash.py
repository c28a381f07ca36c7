"""SimHash near-duplicate detection with covering bit masks.

A covering family for radius r: give every bit position a non-zero label of r + 1
bits; mask v keeps the positions whose label has an even inner product with v.  The
labels of r differing positions span at most r dimensions, so some non-zero v is
orthogonal to all of them, and under that mask both fingerprints agree.  Radius 2 thus
needs seven tables, each keyed by about 36 of the 64 bits.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ._common import Scratch, lean, mix, utf8
from .components import connected_components, forest

BITS = 64
#: Buckets up to this size are joined pair by pair; larger ones go by shared neighbours (exact as well).
PAIRWISE = 48


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int) -> list[int]:
    """Masks such that any two 64-bit values that differ in at most ``radius`` bits agree under one of them."""
    labels = [1 + i % ((1 << (radius + 1)) - 1) for i in range(BITS)]
    return [_signed(sum(1 << i for i, x in enumerate(labels) if (x & v).bit_count() % 2 == 0)) for v in range(1, 1 << (radius + 1))]


def block_masks(blocks: int, keep: int) -> list[int]:
    """Masks of ``keep`` out of ``blocks`` runs of bits: they cover the radius ``blocks - keep``."""
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [sum(1 << i for i in range(a, b)) for a, b in zip(cut, cut[1:])]
    return [_signed(sum(c)) for c in combinations(runs, keep)]


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` lower-cased words, repeats included; a shorter text is one run."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    n = len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if n else [], dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=n - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half the hashes; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (signed long) of every row; a null or wordless text gets 0."""

    def run(batches):
        for b in batches:
            fps = [majority(shingle_hashes(t, width)) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "id long, fp long")


def links(distinct: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Edges ``u``, ``v`` between different fingerprints whose components are those of all pairs within ``radius``.

    ``distinct`` has one row per fingerprint (``fp``).  Buckets of up to ``PAIRWISE`` fingerprints
    are compared pair by pair.  In a larger bucket every fingerprint goes to all values one bit
    from it.  Radius 1: it links to the fingerprints there.  Radius 2: two of them are within it exactly if they share such
    a value, so linking each to the smallest one there keeps every connection.  Rows are proportional to the bucket.
    """
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2; wider searches go through near_duplicates")
    masks = covering_masks(radius)
    tables = distinct.select("fp", F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("t", "mask")).select("fp", "t", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    counts = scratch.save(tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = scratch.save(tables.join(counts, ["t", "key"]), "members")
    few = members.where(F.col("n") <= PAIRWISE)
    pairs = few.alias("a").join(few.select("t", "key", F.col("fp").alias("fp2")).alias("b"), ["t", "key"]).where("fp < fp2").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius).select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    many = members.where(F.col("n") > PAIRWISE)
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(BITS)))
    near = many.select("fp", "t", "mask", F.explode(flips).alias("flip")).where(F.col("flip").bitwiseAND(F.col("mask")) == 0).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    if radius == 1:
        stars = near.join(many.select("t", F.col("fp").alias("at")), ["t", "at"]).where("fp < at").select(F.col("fp").alias("u"), F.col("at").alias("v"))
        return pairs.unionByName(stars).distinct()
    least = scratch.save(near.groupBy("t", "at").agg(F.min("fp").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c"), "neighbours")
    stars = near.join(least, ["t", "at"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest id
    reachable, itself included.  Null and wordless texts have fingerprint zero and link like any other.
    Repeated rows stay; null ids are never a component's id unless it has no other (then null).
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, width, id_col, text_col), "fps")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fp"), radius, scratch), scratch)
    scratch.drop("buckets", "members", "neighbours")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    ids = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    classes = scratch.save(rooted.join(ids, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- wider similarity, for corpus cleaning ------------------------------------------------

#: Words of 64 bits in the wide fingerprint.
WIDE = 4
#: Masks and slack of a candidate search by fingerprints, which misses pairs; the set join does not use them, a test compares with them.
WIDE_MASKS = block_masks(7, 2)
SLACK = 2
#: Clusters up to this size are compared in one task; larger ones in pairs of blocks of about this size.
BLOCK = 2048
#: Bytes of shingle sets in a block.
BLOCK_BYTES = 32 << 20
#: Neighbours in sorted order that the contracting pass compares, and the rotations of each word it sorts by.
NEXT, TURNS = 24, (0, 21, 42)
#: Links a task holds before it reduces them to a forest.
HELD = 500_000
#: Bits of the parity map of a set; what differs in two maps differs in the sets.
PARITY = 2048
#: Shingles that a task compares at a time when it looks for shared ones.
TOKENS = 1 << 20
#: Taken off a bound, so that rounding cannot lose a pair on it.
EPS = 1e-6
#: Partners whose sets one group of the exact check streams past a document's own.
PARTNERS = 512


def wide_fingerprint(text: bytes | None, width: int) -> list[int]:
    """``WIDE`` SimHash words over the set of shingles; their differing bits estimate the angle between the sets."""
    return _words(np.unique(shingle_hashes(text, width)))


def _words(h: np.ndarray) -> list[int]:
    return [majority(h if i == 0 else mix(h + np.uint64((i * 0x9E3779B97F4A7C15) % 2**64))) for i in range(WIDE)]


def _most_bits(similarity: float, slack: float) -> int:
    """Differing bits expected at this Jaccard similarity of two sets of like size, and ``slack`` standard deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = WIDE * BITS
    return int(n * p + slack * np.sqrt(n * p * (1 - p)))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``component`` (smallest id of its group of near duplicates) of each document.

    Documents link when the sets of their ``width``-word shingles have a Jaccard similarity of at
    least ``similarity``, counted on 64-bit hashes.  Every such pair is found, however short or long: what is
    similar shares a shingle among the first of each set, in any order of all shingles.
    Pairs already known to be in one group are spared: a first pass over sorted SimHash fingerprints
    links most of each dense group; what shared shingles connect further is compared in blocks, the closest first.
    Texts with equal sets count as one.  Wordless texts and null ids aren't grouped;
    rows that repeat an id are one document, similar to another if any of its texts is.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    names = [f"f{i}" for i in range(WIDE)]
    key = [*names, "size", "digest"]

    def run(batches):
        for b in batches:
            fps, sizes, digests, first = [], [], [], []
            for t in utf8(b.column(1)):
                h = np.unique(shingle_hashes(t, width))
                fps.append(_words(h))
                sizes.append(len(h))
                digests.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                first.append(h[: len(h) - int(np.ceil(similarity * len(h) - EPS)) + 1 + int((1 - similarity) / 2 * len(h))].copy())
            a = np.array(fps, dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            d = pa.array(np.array(digests, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(a[:, i].copy()) for i in range(WIDE)), pa.array(sizes, pa.int64()), d, _lists(first)], names=["id", *key, "first"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    read = scratch.save(rows.mapInArrow(lean(run), f"id long, {', '.join(f'{n} long' for n in key)}, first array<long>").where("size > 0"), "read")
    fps = scratch.save(read.drop("first"), "fps")
    nodes = scratch.save(fps.groupBy(*key).agg(F.min("id").alias("node")), "nodes")

    open_ids = _open(read.select(F.col("id").alias("node"), F.col("id").alias("comp"), "size", "first"), similarity, scratch, "ids")
    groups = nodes.select("node", F.col("node").alias("comp"), *key)
    some = scratch.save(groups.join(open_ids, "node", "left_semi"), "some")
    dense = scratch.save(_sorted_links(some, names, _most_bits(similarity, 0), scratch), "dense")
    some = _merge(some, _similar(rows, dense, width, similarity, scratch, "dense"), key, scratch, "dense")
    first = read.select(F.col("id").alias("node"), "digest", "first").join(some.select("node", "comp", "size", "digest"), ["node", "digest"])
    first = scratch.save(first.select("node", "comp", "size", "first"), "first")
    scratch.drop("read")
    open_nodes = _open(first, similarity, scratch, "nodes").join(first.select("node", "comp").distinct(), "node")
    links = _cluster_links(rows, _meets(rows, open_nodes, width, similarity, scratch), width, similarity, scratch)
    known = some.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).distinct()
    links = links.unionByName(known)
    groups = _merge(groups, links, key, scratch, "last")
    return fps.join(groups, key).select("id", F.col("comp").alias("component"))


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    values = np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _open(first: DataFrame, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """``node`` of all rows that may be similar to one of another ``comp``.

    ``first`` are the least hashes of a set of ``size`` n: two sets of similarity t share t of the larger one at least, so
    its first (1 - t) n + k hold the k least shared ones, of both sets.  With k = 1 + n (1 - t) / 2, what has fewer shared
    ones there than the smallest possible partner's k is done.  Hashes go packed and shortened, which can only keep
    too much.  Those that several components of one batch share are counted there and sent twice.
    """
    least = F.floor(F.ceil(F.col("size") * similarity - EPS) * ((1 - similarity) / 2) - EPS) + 1
    need, total = first.groupBy("node").agg(F.min(least).alias("need")), first.agg(F.sum("size")).first()[0] or 0
    deal = max(1, -(-total // TOKENS))

    def pack(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        wide = lambda x: np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()  # noqa: E731  # equal bytes side by side
        for b in batches:
            lists = b.column(2)
            n = np.diff(lists.offsets.to_numpy())
            h = lists.flatten().to_numpy().view(np.uint64)
            node, comp = np.repeat(b.column(0).to_numpy(), n), np.repeat(b.column(1).to_numpy(), n)
            order = np.lexsort((comp, h))
            h, node, comp = h[order], node[order], comp[order]
            if not len(h):
                continue
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            end = np.r_[start[1:], len(h)]
            several = comp[start] != comp[end - 1]
            mine = np.repeat(several, end - start)
            sent = ~mine
            sent[start] = sent[end - 1] = True
            done, times = np.unique(node[mine], return_counts=True)
            h, node, comp, mine = h[sent], node[sent], comp[sent], mine[sent]
            part = (h % np.uint64(deal)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, node, comp, mine, part = (x[order] for x in (h, node, comp, mine, part))
            cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
            out = [(int(part[i]), zip_.compress(b"".join([(h[i:j] >> np.uint64(32)).astype(np.uint32).tobytes(), mine[i:j].tobytes(), wide(node[i:j]), wide(comp[i:j] - node[i:j])]))) for i, j in zip(cuts, cuts[1:])]
            out.append((int(part[0]), None))
            counts = [b""] * (len(out) - 1) + [np.concatenate([done, times.astype(np.int64)]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary()), pa.array(counts, pa.binary())], names=["part", "data", "counts"])

    def count(batches):
        unzip = zstandard.ZstdDecompressor()
        wide = lambda x: np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()

        def shared(held):
            h, mine, node, comp = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((comp, h))
            h, mine, node, comp = h[order], mine[order], node[order], comp[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            end = np.r_[start[1:], len(h)]
            on = np.repeat(comp[start] != comp[end - 1], end - start) & ~mine
            return batch(node[on], np.ones(int(on.sum())))  # one row each: sums by part would grow with nodes times parts

        def batch(node, times):
            return pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(times.astype(np.int64))], names=["node", "times"])

        held, last = [], None
        for b in batches:
            for part, data, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if counts:
                    yield batch(*np.frombuffer(counts, dtype=np.int64).reshape(2, -1))
                if data is None:
                    continue
                if part != last and held:
                    yield shared(held)
                    held = []
                last = part
                x = unzip.decompress(data)
                n = len(x) // 21
                node = wide(x[5 * n : 13 * n])
                held.append((np.frombuffer(x[: 4 * n], dtype=np.uint32), np.frombuffer(x[4 * n : 5 * n], dtype=bool), node, wide(x[13 * n :]) + node))
        if held:
            yield shared(held)

    dealt = first.select("node", "comp", "first").mapInArrow(lean(pack), "part long, data binary, counts binary").repartition("part").sortWithinPartitions("part")
    times = dealt.mapInArrow(lean(count), "node long, times long").groupBy("node").agg(F.sum("times").alias("times"))
    return scratch.save(times.join(need, "node").where("times >= need").select("node"), f"open_{name}")


def _meets(rows: DataFrame, open_nodes: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """``node``, its ``comp`` and a component ``other`` that it connects with: all nodes that can have a link to another component.

    All shingles of the open nodes are counted.  Those that one component alone has come first in the order of
    shingles, then the rest by rarity: a text of n shingles with fewer than t n shared ones is done, and of the others
    similar ones share one of the first (1 - t) n + 1; common shingles only count where a text has little else.
    """
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in utf8(b.column(2))]
            digests = [xxhash.xxh64_intdigest(h.tobytes(), 7) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array([len(h) for h in sets], pa.int64()), _lists(sets)], names=["node", "comp", "digest", "size", "s"])

    texts = rows.join(open_nodes, F.col("id") == F.col("node")).select("node", "comp", "text")
    sets = scratch.save(texts.mapInArrow(lean(run), "node long, comp long, digest long, size long, s array<long>").where("size > 0"), "open_sets")
    tokens = sets.select("node", "comp", "digest", "size", F.explode("s").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token", "c")
    shared = tokens.join(counts, "token").groupBy("node", "comp", "digest", "size").agg(F.sort_array(F.collect_set(F.struct("c", "token"))).alias("s"))
    spare = F.size("s") - F.ceil(F.col("size") * similarity - EPS).cast("int")
    rare = shared.withColumn("spare", spare).where("spare >= 0").select("node", "comp", "size", F.explode(F.expr("slice(s, 1, spare + 1)")).alias("x"))
    # sizes of similar sets are in the same class or in adjacent ones
    step = F.floor(F.log("size") / float(-np.log(similarity - EPS)))
    rare = scratch.save(rare.select("node", "comp", F.col("x.token").alias("token"), F.explode(F.array(step, step + 1)).alias("step")), "rare")
    scratch.drop("open_sets")
    ends = rare.groupBy("token", "step").agg(F.min("comp").alias("other"), F.max("comp").alias("high")).where("other <> high").select("token", "step", "other")
    meets = scratch.save(rare.join(ends, ["token", "step"]).select("node", "comp", "other").distinct(), "meets")
    scratch.drop("rare")
    return meets


def _merge(groups: DataFrame, links: DataFrame, names: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``groups`` with the components (smallest node) of their own links and the new ones."""
    of = groups.select("node", "comp").distinct()
    edges = links.unionByName(of.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")))
    roots = connected_components(edges, scratch, f"{name}_cc", few=HELD).select(F.col("node").alias("of"), "root")
    return scratch.save(groups.join(roots, F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("comp"), *names), f"{name}_groups")


def _sets(rows: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """``id`` and ``s`` (sorted shingle hashes) of the rows whose id is in ``need``."""

    def run(batches):
        for b in batches:
            found = [np.unique(shingle_hashes(t, width)).tobytes() for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["id", "s"])

    return rows.join(need, "id").mapInArrow(lean(run), "id long, s binary")


def _cluster_links(rows: DataFrame, meets: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Exact links between the components of each cluster, a cluster being what ``meets`` connects.

    A cluster of over ``BLOCK`` nodes or ``BLOCK_BYTES`` of sets is dealt in blocks, each pair of blocks a group of its own:
    a set is sent as often as its cluster has blocks, however many partners it has.
    """
    edges = meets.select(F.col("comp").alias("u"), F.col("other").alias("v"))
    roots = connected_components(edges, scratch, "cluster", few=HELD).select(F.col("node").alias("of"), F.col("root").alias("cluster"))
    roots = scratch.save(roots.unionByName(roots.select(F.col("cluster").alias("of"), "cluster").distinct()), "clusters")
    inside = scratch.save(meets.select("node", "comp").distinct().join(roots, F.col("comp") == F.col("of")).drop("of"), "inside")
    sets = _sets(rows, inside.select(F.col("node").alias("id")), width)
    full = scratch.save(inside.join(sets, F.col("node") == F.col("id")).drop("id"), "full")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum(F.length("s")) / F.lit(BLOCK_BYTES)))
    sizes = scratch.save(full.groupBy("cluster").agg(parts.alias("parts")), "cluster_sizes")
    own = F.pmod(F.xxhash64("node"), "parts").alias("p")
    dealt = full.join(sizes, "cluster").select("*", own).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"))
    keyed = dealt.select(F.xxhash64("cluster", F.least("p", "q"), F.greatest("p", "q")).alias("g"), F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2).alias("side"), "node", "comp", "s")

    def run(batches):
        kept, last = [], None
        for b in batches:
            g = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for i, j in zip(cut, cut[1:]):
                if i == j:
                    continue
                if g[i] != last and kept:
                    yield _block_links(kept, similarity)
                    kept = []
                last = g[i]
                kept.append(b.slice(i, j - i))
        if kept:
            yield _block_links(kept, similarity)

    links = scratch.save(keyed.repartition("g").sortWithinPartitions("g").mapInArrow(lean(run), "u long, v long").distinct(), "last_links")
    scratch.drop("full")
    return links


def _block_links(parts: list, similarity: float) -> pa.RecordBatch:
    """A forest of exact links between the components of a group's rows: closest sets first, connected ones skipped.

    A pair is passed over without counting only where sizes or parity maps show more differing shingles than the similarity allows.
    """
    t = pa.Table.from_batches(parts)
    side, node, comp = (t.column(i).to_numpy().copy() for i in (1, 2, 3))
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column(4)]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    odd = [np.packbits(np.bincount((x % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).view(np.uint64) for x in sets]
    maps = np.stack(odd) if odd else np.zeros((0, PARITY // 64), dtype=np.uint64)
    u, v = [], []
    for i in range(len(node) - 1):
        n = size[i + 1 :]
        j = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((side[i] == 0) | (side[i + 1 :] != side[i])) & (np.minimum(n, size[i]) >= similarity * np.maximum(n, size[i]) - EPS)) + i + 1
        if not len(j):
            continue
        both = size[j] + size[i]
        d = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
        on = d <= both * (1 - similarity) / (1 + similarity) + EPS
        j, d, both = j[on], d[on], both[on]
        for k in j[np.argsort(d / both, kind="stable")].tolist():
            if comp[k] != comp[i] and _jaccard(sets[i], sets[k]) >= similarity:
                u.append(int(node[i]))
                v.append(int(node[k]))
                comp[comp == max(comp[i], comp[k])] = min(comp[i], comp[k])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _similar(rows: DataFrame, pairs: DataFrame, width: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """Of ``pairs`` (``u``, ``v``) those whose sets of shingles are similar enough.

    The partners' sets stream past ``u``'s own, which alone is held; a ``u`` of many partners has several groups.
    """
    if pairs.isEmpty():
        return pairs.select("u", "v")

    def compare(batches):
        hub, held = None, []
        for b in batches:
            us, parts, vs = (b.column(i).to_pylist() for i in range(3))
            left, right = [], []
            for u, part, v, s in zip(us, parts, vs, b.column(3)):
                own = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                if (u, part) != hub:
                    hub, held = (u, part), []
                if v is None:
                    held.append(own.copy())
                elif any(_jaccard(own, x) >= similarity for x in held):
                    left.append(u)
                    right.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    need = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    found = scratch.save(_sets(rows, need, width), f"{name}_sets")
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("parts"))
    hubs = parts.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"))
    partners = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v")
    sent = hubs.join(found, F.col("u") == F.col("id")).unionByName(partners.join(found, F.col("v") == F.col("id"))).drop("id")
    dealt = sent.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first()).select("u", "part", "v", "s")
    links = scratch.save(dealt.mapInArrow(lean(compare), "u long, v long").distinct(), f"{name}_links")
    scratch.drop(f"{name}_sets")
    return links


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _sorted_links(groups: DataFrame, names: list[str], most: int, scratch: Scratch) -> DataFrame:
    """Pairs within ``most`` bits that stand close in some sorted order, as a forest of the closest in each task.

    What it misses costs later comparisons, not links.
    """
    turn = lambda n, by: F.shiftleft(n, by).bitwiseOR(F.shiftrightunsigned(n, BITS - by)) if by else F.col(n)
    orders = F.array(*(F.struct(F.lit(i * len(TURNS) + j).alias("t"), turn(n, by).alias("r")) for i, n in enumerate(names) for j, by in enumerate(TURNS)))
    tables = groups.select("node", "comp", *names, F.explode(orders).alias("o")).select("o.t", "o.r", "node", "comp", *names)
    spread = tables.repartitionByRange("t", "r", *names).sortWithinPartitions("t", "r", *names)
    found = spread.select("t", "node", "comp", *names).mapInArrow(lean(_compare(most, NEXT)), PAIR_SCHEMA)
    return found.select("u", "v").distinct()


#: Nodes ``u`` below ``v``, their components, and the bits in which they differ.
PAIR_SCHEMA = "u long, v long, cu long, cv long, bits long"


def _compare(most: int, reach: int | None):
    """Over rows sorted by their first column (a group): a forest of the closest pairs of a group's rows of different components.

    With ``reach``, only rows that far apart at most.
    """

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["u", "v", "cu", "cv", "bits"])

    def run(batches):
        rest, held, n = None, [], 0
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            old = 0 if rest is None else rest.shape[1]
            x = x if rest is None else np.concatenate([rest, x], axis=1)
            for found in _close(x, most, reach, old):
                held.append(found)
                n += found.shape[1]
            if n > HELD:
                held = [spanning(np.concatenate(held, axis=1))]
                n = held[0].shape[1]
            if x.shape[1]:
                same = int(np.flatnonzero(np.r_[True, x[0, 1:] != x[0, :-1]])[-1])  # where the last group starts
                rest = x[:, max(same, x.shape[1] - reach) if reach else same :].copy()
        if held:
            yield out(spanning(np.concatenate(held, axis=1)))

    return run


def spanning(found: np.ndarray) -> np.ndarray:
    """The columns (u, v, cu, cv, bits) that make a spanning forest of least bits, by Boruvka's rounds."""
    found = found[:, np.lexsort((found[1], found[0], found[4]))]
    nodes, at = np.unique(found[:2], return_inverse=True)
    a, b = at.reshape(2, -1)
    rank, low, kept = np.arange(len(a)), np.arange(len(nodes)), []
    while True:
        on = low[a] != low[b]
        a, b, rank = a[on], b[on], rank[on]
        if not len(a):
            return found[:, np.concatenate(kept)] if kept else found[:, :0]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, low[a], np.arange(len(a)))
        np.minimum.at(best, low[b], np.arange(len(a)))
        take = np.unique(best[best < len(a)])
        kept.append(rank[take])
        of, root = forest(low[a[take]], low[b[take]])
        to = np.arange(len(nodes))
        to[of] = root
        low = to[low]


def _close(x: np.ndarray, most: int, reach: int | None, old: int):
    """Per distance in the order, the pairs of rows so far apart in one group; the later row is at ``old`` or after."""
    key, node, comp, words = x[0], x[1], x[2], x[3:].view(np.uint64)
    n, step = len(key), 1
    first = np.arange(n)
    while step < n and (reach is None or step <= reach):
        first = first[first < n - step]
        first = first[key[first] == key[first + step]]  # groups are runs: what ends here, ends for all longer steps
        if not len(first):
            break
        i = first[first + step >= old]
        j = i + step
        ok = comp[i] != comp[j]
        i, j = i[ok], j[ok]
        bits = np.zeros(len(i), dtype=np.int64)
        for w in words:
            bits += np.bitwise_count(w[i] ^ w[j])
        ok = bits <= most
        if ok.any():
            i, j, bits = i[ok], j[ok], bits[ok]
            i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            yield np.stack([node[i], node[j], comp[i], comp[j], bits])
        step += 1
