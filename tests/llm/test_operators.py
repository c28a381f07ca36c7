"""Each operator against brute force, with nulls, ties, empty tables, long texts and clashing columns."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemill.llm import chat, components, mixing, packing, pq, quality, sharding, simhash, substring, toxicity, warc
from tidemill.llm._common import Scratch

SCHEMA = "doc_id long, text string, source string, h long, key string, n long"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    para = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = para(40)
    out = [para(rng.randint(0, 150)) for _ in range(30)]
    out += [out[3]] * 3 + [f"{para(30)} {shared}\n{para(25)}" for _ in range(60)] + [out[5] + " zz", "", None, "   \t\n", "one", "one two", para(3000), para(8) * 9]
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 4}", 7, "k", 1) for i, t in texts], SCHEMA).repartition(3)


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_covering_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            flip = (1 << i) | (1 << j)
            assert any(m & flip == 0 for m in masks)


def test_simhash(spark, docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    want = {}
    for i, t in texts:
        w = [x.lower() for x in words(t)]
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    linked = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 2]
    up = roots(want, linked)
    assert got == {i: (f"{want[i]:016x}", up[i]) for i in want}


def test_large_buckets_keep_all_connections(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 3)
    rng = random.Random(1)
    seed = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seed for _ in range(60)}
    signed = {simhash._signed(x): x for x in fps}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    scratch = Scratch(spark, "t")
    got = {r.node: r.root for r in components.connected_components(simhash.links(df, 2, scratch), scratch).collect()}
    up = roots(list(signed), [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 2])
    assert {n: got.get(n, n) for n in signed} == up


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(120, 400))]
        for c in range(4):
            w = list(base)
            if c:
                w[rng.randrange(len(w))] = f"x{c}"
            rows.append((len(rows), " ".join(w)))
            want[len(rows) - 1] = g * 4
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame([*rows, (None, "a b"), (900, None)], "doc_id long, text string")).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert all(abs(got[i] - i) < 4 for i in want) and 900 not in got


@pytest.mark.parametrize("block", [4, 2048])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "NEXT", 1)
    rng = random.Random(9)
    rows = []
    for g in range(12):
        at = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(20 if g else 80):  # each text is a change of the one before: links form chains
            at = list(at)
            for _ in range(rng.randint(0, 4)):
                at[rng.randrange(len(at))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(at)))
    rng.shuffle(rows)
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    fps = {i: simhash.wide_fingerprint(t.encode(), 5) for i, t in rows}
    most, masks = simhash._most_bits(0.8, simhash.SLACK), [m % 2**64 for m in simhash.WIDE_MASKS]
    within = [(a, b) for a, b in near if sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b])) <= most]
    meet = [(a, b) for a, b in within if any((x ^ y) & m == 0 for x, y in zip(fps[a], fps[b]) for m in masks)]
    assert len(near) > 400 and len(meet) > 0.97 * len(near)
    up = roots(sets, near)
    assert all(got[a] == got[b] for a, b in meet)  # no link of a common bucket is lost
    assert all(up[got[i]] == up[i] for i in sets)  # and none is made up


def test_exact_check_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PARTNERS", 3)  # a document of many partners has several groups
    rng = random.Random(2)
    at = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.01 * (i % 6) else f"x{i}" for w in at)) for i in range(25)]
    rows += [(3, rows[4][1]), (None, rows[0][1]), (50, ""), (51, None)]  # id 3 repeats: either text counts
    pairs = [(a, b) for a in range(25) for b in range(a + 1, 25)] + [(0, 50), (50, 51)]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, w in ((i, (t or "").split()) for i, t in rows)]
    alike = lambda x, y: len(x | y) > 0 and len(x & y) / len(x | y) >= 0.8
    want = {(a, b) for a, b in pairs if any(alike(x, y) for i, x in sets if i == a for j, y in sets if j == b)}
    df = spark.createDataFrame(rows, "id long, text string")
    got = simhash._similar(df, spark.createDataFrame(pairs, "u long, v long"), 5, 0.8, Scratch(spark, "t"), "t").collect()
    assert 20 < len(want) < len(pairs) - 20 and len(got) == len(want) and {(r.u, r.v) for r in got} == want


def test_spanning_forest_of_least_bits():
    found = np.array([(1, 2, 1, 2, 9), (2, 3, 2, 3, 1), (1, 3, 1, 3, 2), (7, 8, 7, 8, 5), (1, 3, 1, 3, 2)]).T
    assert sorted(map(tuple, simhash.spanning(found)[:2].T.tolist())) == [(1, 3), (2, 3), (7, 8)]
    assert simhash.spanning(found[:, :0]).shape == (5, 0)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {200 + i: 100 for i in range(40)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_warc(spark):
    bodies = ["<p>a</p>", "<p>é\r\n\r\nWARC/1.1\r\n</p>", None, "", "x" * 300_000]
    rows = [(i, f"http://www.H{i % 3}.example.net/p?{i}\r\n", bodies[i % 5], "c") for i in range(40)] + [(None, None, "<p>a</p>", "c")]
    got = warc.capture_history(spark.createDataFrame(rows, "page_id long, url string, html string, digest string")).collect()
    by = defaultdict(list)
    for i, _, b, _ in rows:
        if i is not None:
            by[(b or "").encode()].append(i)
    want = {None: (8, "response", None)} | {i: (len(b), "response" if i == max(ids) else "revisit", None if i == max(ids) else max(ids)) for b, ids in by.items() for i in ids}
    assert {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in got} == want and len(got) == 41
    digest = {i: base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode() for i, _, b, _ in rows}
    assert all(r.payload_digest == digest[r.page_id] for r in got)
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    assert warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    extra = [(9001, "a<|endoftext|>b  \n\n ‍😀 ç"), (None, "x")]
    rows = packing.pack(docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")), capacity=256).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in [*texts, *extra]:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]] and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 256 for p in pieces[1:])
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    bins = []
    for n in sorted((r.length for r in rows), reverse=True):
        fit = [b for b in bins if b >= n]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - n)
        else:
            bins.append(256 - n)
    assert len(seqs) == len(bins)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * 0.12
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(400, rows[0][1], 0), (401, [0.0] * 16, 0), (402, None, 0), (403, rows[0][1], None), (404, [float("nan")] * 16, 0), (405, [1.0, None] * 8, 0), (406, [1.0, 2.0], 0), (407, [x * 1e200 for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(i, v, y, "c", 1.0) for i, v, y in rows], "vec_id long, embedding array<double>, label int, code string, error double")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq.near_vectors(df, exact=True).collect()}
    unit = {i: np.array(v) / np.linalg.norm(np.array(v) / max(np.abs(v))) / max(np.abs(v)) for i, v, y in rows if v and None not in v and np.isfinite(v).all() and any(v) and y is not None}
    label = {i: (y, len(v or ())) for i, v, y in rows}
    linked = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    up = roots([i for i, _, _ in rows], linked)
    n = Counter(x for e in linked for x in e)
    assert len(linked) > 300
    assert got == {i: (n[i], up[i], up[i] == i) for i, _, _ in rows}


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "a" if i < 900 else "b", i) for i in range(1000)] + [(None, None, 1)], "doc_id long, source string, rate long")
    rows = mixing.mix(docs, weights={"a": 1, "b": 3}, total=8.0).collect()
    n = Counter(r.source for r in rows)
    assert abs(n["a"] - 2002) < 200 and abs(n["b"] - 6006) < 400 and None not in n
    assert [r.place for r in rows] == sorted(r.place for r in rows)
    assert [r.place for r in mixing.mix(docs.repartition(7), weights={"a": 1, "b": 3}, total=8.0).collect()] == [r.place for r in rows]
    import duckdb  # noqa: F401  the SQL form is compared by the driver

    assert mixing.mix(docs.limit(0)).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard(docs, limit=2000).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.n_bytes
    assert len(rows) == docs.count() and all(r.shard_bytes == size[r.shard] and r.depth == len(r.shard) for r in rows)
    alone = Counter(r.shard for r in rows if r.n_bytes)
    assert all(s <= 2000 or alone[k] == 1 for k, s in size.items())
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    same = spark.createDataFrame([(1, "x" * 100)] * 200, "doc_id long, text string")
    assert max(Counter(r.shard for r in sharding.shard(same, limit=1000).collect()).values()) <= 10
    assert sharding.shard(docs.limit(0)).count() == 0


def test_quality(spark, docs, texts):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t in texts:
        w = [x.decode() for x in words(t)]
        tri = list(zip(w, w[1:], w[2:]))
        c, covered = Counter(tri), set()
        for k, g in enumerate(tri):
            if c[g] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_toxicity_generalises_to_misspellings(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("bcdfgklmnprst", k=2)) + "".join(rng.choices("aeiou", k=2)) + rng.choice("rstn") for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        w = rng.choices(vocab, k=60)
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(60)] = "wretchedest" if zlib.crc32(str(i).encode()) % 4 != 2 else "wretchedestt"
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame([*docs, (5000, None), (5001, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i % 3 == 0) for i in held)
    assert right >= 0.95 * len(held) and 0 <= got[5000] == got[5001] <= 1
    kept = {r.doc_id for r in toxicity.keep_clean(d, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.3}
    none = toxicity.train(d, lab.limit(0))
    assert all(r.score == 0 for r in toxicity.score(d, none).collect())


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, None, None), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, None, None), (5, 0, "user", ""), (None, 0, "user", "z")]
    got = {r.conv_id: (r.n_turns, r.n_logs, r.rendered) for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    say = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert got == {3: (3, 2, say("user", "a") + say("assistant", "b") + say("user", "")), 5: (1, 1, say("user", ""))}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _expected_cuts(rows):
    seen, out = set(), {}
    for key, t in rows:
        w, gone = words(t), np.zeros(len(words(t)), dtype=bool)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = True
            seen.add(g)
        out[key] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest())
    return out


def test_substring(spark, docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, carry=["source", "h"]).collect()}
    want = _expected_cuts(texts)
    assert got == want and sum(x[1] for x in want.values()) > 2000
    twice = spark.createDataFrame([(1, texts[-2][1]), (1, texts[-2][1]), (None, texts[-2][1]), (2, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.remove_repeats(twice).collect()) == [0, 0, 3000, 3000]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"d{i} " + " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(120)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(10)] + [(None, None, None, None, None), (300, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if i == 1:
            ids = {r.doc_id for r in docs.collect()}
            assert ids == {None, 300, *range(60)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and max(r.offset + r.length for r in out) <= 2048


def test_near_duplicates_of_odd_tables(spark):
    shape = "doc_id long, text string, node long, comp long, f0 string, k long, t int"
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(4, text, 1, 1, "a", 1, 1), (2, text, 1, 1, None, 1, 1), (2, text, None, None, None, None, None), (9, "a b", 1, 1, "a", 1, 1), (7, "A  b", 1, 1, "a", 1, 1), (None, text, 1, 1, "a", 1, 1), (5, "", 1, 1, "a", 1, 1), (6, None, 1, 1, "a", 1, 1)]
    got = sorted((r.id, r.component) for r in simhash.near_duplicates(spark.createDataFrame(rows, shape)).collect())
    assert got == [(2, 2), (2, 2), (4, 2), (7, 7), (9, 7)]
    assert simhash.near_duplicates(spark.createDataFrame([], shape)).count() == 0


@pytest.mark.parametrize("rows", ["none", "nulls"])
def test_queries_on_empty_and_null_tables(spark, tmp_path, rows):
    import corpus_pipeline
    from tidemill.llm import queries

    shapes = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string",
        "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string", "benchmark": "item_id long, text string",
    }
    for name, shape in shapes.items():
        n = shape.count(",") + 1
        spark.createDataFrame([] if rows == "none" else [(None,) * n] * 3, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in (queries.queries() | {"pipeline": corpus_pipeline.run}).items():
        got = q(spark, str(tmp_path)).collect()
        assert got == [] if rows == "none" else len(got) <= 9, name


def test_near_duplicates_finds_every_pair(spark):
    """Isolated pairs just above the similarity sought, short and long; pairs just below it stay apart."""
    rng = random.Random(11)
    rows, want = [], {}
    for n, both, count in ((15, 13, 30), (18, 16, 60), (146, 131, 30), (540, 480, 30), (540, 479, 20), (1500, 1334, 15), (5000, 4445, 8), (5000, 4444, 4)):  # shingles of each text, and those shared
        for _ in range(count):
            at = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
            new = at[: both + 4] + [f"w{rng.randrange(10**9)}" for _ in range(n - both)]
            for text in (at, new):
                want[len(rows)] = len(rows) // 2 * 2 if both / (2 * n - both) >= 0.8 else len(rows)
                rows.append((len(rows), " ".join(text)))
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_pipeline_keeps_dissimilar_rows_that_share_an_id(spark):
    import corpus_pipeline

    text = lambda i: " ".join(f"w{i}_{k}" for k in range(40))
    rows = [(7, text(i), "en", "s", 1) for i in range(20)] + [(7, text(3), "en", "s", 1), (8, text(4), "en", "s", 1), (3, text(5), "en", "s", 1), (9, text(30), "en", "s", 1)]
    rows += [(7, None, "en", "s", 1), (7, None, "en", "s", 1), (None, text(1), "en", "s", 1), (None, text(1), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    want = Counter({(7, text(i)): 1 for i in range(20) if i != 5} | {(3, text(5)): 1, (9, text(30)): 1, (7, None): 2, (None, text(1)): 2})
    assert got == want


@pytest.mark.parametrize("label", [0, 1])
def test_pipeline_drops_nothing_on_labels_of_one_class(spark, tmp_path, label):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"clean text {i}", "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, label) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 20


def test_links_of_radius_1_do_not_depend_on_the_bucket(spark, monkeypatch):
    rng = random.Random(4)
    fps = sorted({s ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for s in (rng.getrandbits(62) for _ in range(4)) for _ in range(40)})
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() == 1}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for few in (3, 1000):
        monkeypatch.setattr(simhash, "PAIRWISE", few)
        assert {tuple(sorted((r.u, r.v))) for r in simhash.links(df, 1, Scratch(spark, "t")).collect()} == want


def test_written_shards_hold_null_and_repeated_ids(spark, tmp_path):
    rows = [(i if i < 20 else 5 if i < 40 else None, f"{i:03d}" * 10) for i in range(60)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/out", limit=200)
    got = spark.read.option("basePath", f"{tmp_path}/out").schema("doc_id long, text string, shard string").parquet(f"{tmp_path}/out").collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and max(sizes.values()) <= 200


WHITE_RUNS = [" ", "\t", "\n", "\u3000 \n"]


@pytest.mark.parametrize("run", WHITE_RUNS)
def test_long_blank_runs_get_the_ids_of_the_tokeniser(run):
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(packing.default_vocabulary()), packing.load_encoder(packing.default_vocabulary())
    for n in (packing.RUN - 1, packing.RUN, 1_000_000):
        long = (run * (n // len(run) + 1))[:n]
        for text in (long, long + "b c", "a b" + long, "a " + long + "b", "x<|endoftext|>" + long + "<|endoftext|>y"):
            assert np.array_equal(packing.encode(encoder, text), tok.encode(text, add_special_tokens=False).ids)


def test_blank_texts_are_packed_whole(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, " " * 20_000_000), (2, "a" + "\t" * 1_000_000 + "b"), (3, "\n" * 1_000_000 + "c d"), (4, "x")]
    docs = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "x")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "case doc_id when 1 then repeat(' ', 20000000) when 2 then 'a' || repeat('\t', 1000000) || 'b' when 3 then repeat('\n', 1000000) || 'c d' else text end as text", "'en' as lang", "'s' as source", "1L as n_chars")
    encoder = packing.load_encoder(packing.default_vocabulary())
    want = {i: len(packing.encode(encoder, t)) + 1 for i, t in rows}
    assert want[1] == 20_000_001
    for got in (packing.pack(docs), corpus_pipeline.pack_sequences(spark, docs, "")):
        assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == want


def test_archives_are_members_that_can_be_fetched(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)  # several ranges, whatever the session's partitions
    bodies = [f"<p>{i % 20} é</p>" * (i % 7) for i in range(200)]
    rows = [(i if i % 3 else None if i % 2 else 42, f"http://h{i % 2}.example/{i % 5}", bodies[i]) for i in range(200)]
    path = f"{tmp_path}/archives"
    got = warc.capture_history(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows) and len({r.archive for r in got}) > 4
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    held = {a: (tmp_path / "archives" / a).read_bytes() for a in {r.archive for r in got}}
    for a, data in held.items():  # any gzip reader unpacks the whole archive
        whole = list(warc.parse(__import__("io").BytesIO(gzip.decompress(data))))
        assert len(whole) == sum(r.archive == a for r in got)
    for r in got[::17]:
        fields, block = warc.fetch(spark, path, r.archive, r.record_offset, r.record_bytes)
        assert fields["warc-type"] == r.record_type and fields["warc-payload-digest"] == f"sha1:{r.payload_digest}"
        payload = block.partition(b"\r\n\r\n")[2]
        assert r.record_type == "revisit" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == r.payload_digest
    with pytest.raises(ValueError, match="cut off"):
        list(warc.unpack(next(iter(held.values()))[:30]))


def _planted(rng, n, d, copies):
    """Unit vectors, most of them alone, and groups whose members have a cosine of about 0.93 to 0.99 with their first."""
    x = rng.normal(size=(n, d))
    for i in range(0, n - copies, 10 * copies):
        for k in range(1, copies):
            x[i + k] = x[i] + rng.normal(size=d) * np.linalg.norm(x[i]) / np.sqrt(d) * rng.uniform(0.1, 0.38)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_probes_are_few_and_suffice():
    rng, shares = np.random.default_rng(5), []
    for n in (10_000, 50_000):
        x = _planted(rng, n, 64, 6)
        book = pq.fit(x[rng.choice(n, min(16_000, n // 3), replace=False)], int(np.sqrt(n / 10)))
        own, _, _ = book.encode(x)
        pairs = [(i + a, i + b) for i in range(0, n - 6, 60) for a in range(6) for b in range(6) if a != b and x[i + a] @ x[i + b] >= 0.93]
        asked = np.unique([a for a, _ in pairs])
        at = np.searchsorted(asked, [a for a, _ in pairs])
        r, k, _ = pq.probes(x[asked], own[asked], book, np.sqrt(0.14))
        probed = np.zeros((len(asked), len(book.centres)), dtype=bool)
        probed[r, k] = True
        shares.append(probed.mean())
        assert len(pairs) > 500 and probed[at, own[[b for _, b in pairs]]].mean() > 0.99
        r, k, _ = pq.probes(x[asked[:200]], own[asked[:200]], book, np.sqrt(0.14), exact=True)
        assert len(r) > 2 * probed[:200].sum()
    assert shares[0] < 0.25 and shares[1] < 0.2 and shares[1] < shares[0]


def test_near_vectors_recall(spark):
    rng = np.random.default_rng(8)
    x = _planted(rng, 3000, 64, 6)
    label = (np.arange(3000) // 60) % 3
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(3000)] * 2  # rows repeat: each is a vector of its own
    got = pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    s = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    want = 2 * s.sum(axis=1) - 1
    n = {r.vec_id: r.n_links for r in got}
    assert len(got) == 6000 and all(n[i] <= want[i] for i in n) and sum(n.values()) >= 0.99 * want.sum() > 3000


def test_quality_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 6)  # both ways of sorting windows
    rng = random.Random(3)
    rows = [(n, " ".join(rng.choices("abcd" if n % 2 else [f"w{i}" for i in range(40)], k=n))) for n in (0, 1, 2, 3, 60, 65, 66, 67, 400, 5001)] + [(-1, "x " * 400_000 + "y")]
    got = {r.doc_id: r.n_repeat_words for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = t.split()
        tri = list(zip(w, w[1:], w[2:]))
        c = Counter(tri)
        assert got[i] == len({k + j for k, g in enumerate(tri) if c[g] > 1 for j in range(3)})


def _rows_of(word):
    """Table rows of a word, by the definition: its n-grams with the ends marked, and itself."""
    mask, marked = (1 << 64) - 1, f"<{word}>"

    def bucket(h, n):
        x = (h + n) & mask
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return (x ^ (x >> 31)) % toxicity.BUCKETS

    poly = lambda s: sum(ord(c) * pow(toxicity.BASE, k + 1, 1 << 64) for k, c in enumerate(s)) & mask
    return [bucket(poly(marked), 0)] + [bucket(poly(marked[i : i + n]), n) for n in toxicity.SIZES for i in range(len(marked) - n + 1)]


def _mean(vectors, text):
    tokens = [toxicity.normal(t) for t in text.encode().split()]
    out = np.zeros(vectors.shape[1])
    for t in tokens:
        if t:
            out += np.mean([vectors[r] for r in _rows_of(t)], axis=0)
    return out / max(1, len(tokens))


def test_toxicity_training_and_score_by_hand():
    rng = random.Random(12)
    words_ = ["".join(rng.choices("abcdefghié", k=5)) for _ in range(30)]
    texts = [" ".join(rng.choices(words_, k=rng.randint(3, 25)) + (["Vile!", "vile"] if i % 3 == 0 else [])) + (" -- ." if i % 5 == 0 else "") for i in range(24)]
    y = np.array([int(i % 3 == 0) for i in range(24)])
    bags = [dict(Counter(toxicity.normal(t) for t in x.encode().split())) for x in texts]
    size, rate, decay, steps = 3, 0.05, 1e-3, 4
    start = toxicity.fit(bags, y, size=size, steps=0)
    model = toxicity.fit(bags, y, size=size, steps=steps, rate=rate, decay=decay)
    e, w, b = start.vectors.copy(), start.weights.copy(), start.bias.copy()
    on, unit = e[:, 0] != 0, np.abs(e).max()
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]
    for t in range(1, steps + 1):
        ge, gw, gb = np.zeros_like(e), np.zeros_like(w), np.zeros_like(b)
        for text, label in zip(texts, y):  # one text, one word, one n-gram at a time
            doc = _mean(e, text)
            z = w @ doc + b
            p = np.exp(z - z.max())
            g = (p / p.sum() - np.eye(2)[label]) / len(texts)
            gw += np.outer(g, doc)
            gb += g
            tokens = [toxicity.normal(x) for x in text.encode().split()]
            for token in tokens:
                for r in _rows_of(token) if token else []:
                    ge[r] += (g @ w) / len(_rows_of(token)) / len(tokens)
        ge[~on] = 0
        for i, (x, d, r) in enumerate(((e, ge, rate * unit * 0.2), (w, gw, rate), (b, gb, rate * 2))):
            m, v = state[i]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= r * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
        e *= 1 - decay
    assert on.sum() > 5 and np.abs(model.vectors - start.vectors).max() > 1e-3
    assert np.allclose(model.weights, w, atol=1e-6) and np.allclose(model.bias, b, atol=1e-6) and np.allclose(model.vectors, e, atol=1e-5)
    got = model.scorer()([t.encode() for t in texts] + [b"", None])
    want = []
    for t in [*texts, "", ""]:
        z = model.weights @ _mean(model.vectors, t) + model.bias
        want.append(1 / (1 + np.exp(z[0] - z[1])))
    assert np.allclose(got, want, atol=1e-12)
    odds = start.vectors[:, 0] / np.abs(start.vectors[:, 0]).max()  # the start: one number a row, its smoothed log-odds cut off
    seen = [{r for x in bag if x for r in _rows_of(x)} for bag in bags]
    for r in {r for s in seen for r in s}:
        k = [sum(r in s for s, c in zip(seen, y) if c == z) for z in (0, 1)]
        raw = np.log((k[1] + 1) / (8 + 2)) - np.log((k[0] + 2) / (16 + 4))
        assert np.sign(odds[r]) == (np.sign(raw) if abs(raw) > toxicity.CUT else 0)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"{'bad' if i % 2 else 'good'} w{i} " * 50) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    few = toxicity.train(docs, labels, sample=5, sample_bytes=1 << 20)
    assert few.constant is None
    assert toxicity.train(docs, labels, sample_bytes=10).constant == 0.0  # nothing fits


def test_mixing_stage_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    rows = [(i, f"t{i}", "en", "s", 1, 99.0, "Paris", i) for i in range(50)] + [(None, None, None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate double, place string, copy long")
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows) and got.count() > 20


def test_clashing_names_in_scores_and_chats(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, 7), (1, "a", 5, 6, 7), (None, None, None, None, None)], "doc_id long, text string, score long, y int, so_far long")
    labels = spark.createDataFrame([(1, 1, 3), (2, 0, 3)], "doc_id long, toxic int, id int")
    model = toxicity.train(docs, labels)
    assert sorted(str(r.doc_id) for r in toxicity.score(docs, model).collect()) == ["1", "1", "None"]
    assert toxicity.keep_clean(docs, toxicity.Model(np.zeros((toxicity.BUCKETS, 1)), np.zeros((2, 1)), np.zeros(2), 0.0)).columns == docs.columns
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", 9), (1, 0, "user", "a", "x", 9), (2, 0, "user", "a", "y", 9)], "conv_id long, turn long, role string, text string, h0 string, place int")
    got = {r.conv_id: r.n_turns for r in chat.format_chats(turns).collect()}
    assert got == {1: 2}  # the repeated turn stays, and conversation 2 is a prefix


def test_values_on_null_rows(spark):
    null = lambda shape: spark.createDataFrame([(None,) * (shape.count(",") + 1)] * 3, shape)
    docs = null("doc_id long, text string, source string")
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()] == [(None, "0" * 16, None)] * 3
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.capture_history(null("page_id long, url string, html string")).collect()} == {(None, 0, "response", None)}
    assert [(r.piece, r.length, r.sequence_id) for r in packing.pack(docs).collect()] == [(0, 1, 0)] * 3
    assert [(r.n_links, r.component_id, r.kept) for r in pq.near_vectors(null("vec_id long, embedding array<float>, label int")).collect()] == [(0, None, False)] * 3
    assert {(r.n_bytes, r.shard) for r in sharding.shard(docs).collect()} == {(0, "")}
    assert [(r.n_words, r.base_failed, r.kept) for r in quality.quality(docs).collect()] == [(0, True, False)] * 3
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect()] == [(0, 0, hashlib.sha256(b"").hexdigest())] * 3
    assert chat.format_chats(null("conv_id long, turn long, role string, text string")).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from tidemill.llm._common import shared_folder

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://x:7077", "hdfs://x/y/")) == "hdfs://x/y" and shared_folder(session("local[4]", "")).startswith("file:")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://x:7077", ""))


def test_toxicity_is_learned_off_the_driver(spark, monkeypatch):
    here, fit = os.getpid(), toxicity.fit

    def away(*a, **k):
        assert os.getpid() != here
        return fit(*a, **k)

    docs = spark.createDataFrame([(i, f"{'vile' if i % 5 == 0 else 'fine'} day {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    plain = toxicity.train(docs, labels)
    known = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    bags = [dict(Counter(toxicity.normal(t) for t in f"{'vile' if i % 5 == 0 else 'fine'} day {i}".encode().split())) for i in known]
    order = np.argsort([toxicity.hash_of(b.keys(), b.values()) for b in bags], kind="stable")
    want = fit([bags[i] for i in order], np.array([known[i] % 5 == 0 for i in order], dtype=np.int64))
    assert np.allclose(plain.vectors, want.vectors) and np.allclose(plain.weights, want.weights) and np.allclose(plain.bias, want.bias)
    monkeypatch.setattr(toxicity, "fit", away)
    model = toxicity.train(docs, labels)
    assert model.constant is None and np.array_equal(model.vectors, plain.vectors) and np.array_equal(model.bias, plain.bias)


@pytest.mark.parametrize("few", [10**6, 400, 10])
def test_few_edges_are_joined_up_in_one_task(spark, few):
    rng = random.Random(3)
    edges = [(rng.randrange(500), rng.randrange(500)) for _ in range(300)] + [(600 + i, 601 + i) for i in range(90)]
    scratch = Scratch(spark, "few")
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), scratch, few=few).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    rounds = [x for x in os.listdir(scratch.root.removeprefix("file://")) if x.startswith("cc") and x not in ("cc0", "cc_stars")]
    assert bool(rounds) == (few == 10)
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t"), few=few).count() == 0
