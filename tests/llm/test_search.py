"""SimHash near-duplicates, suffix array, top-k."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from lamella.llm import simhash, suffix_array, topk
from tests.test_oracle import rows


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs):
    fps = [fingerprint(t) for _, t in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(docs)), key=repr)


@pytest.mark.parametrize("group", [simhash.GROUP, 1])
def test_simhash_is_brute_force(spark, sf, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in simhash.query(spark, sf).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == components(docs)


def test_links_of_a_dense_group():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    a, b = simhash.search(simhash.build(codes[np.argsort(simhash.gray_rank(codes))]), codes[np.argsort(simhash.gray_rank(codes))])
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    brute = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(ordered[i] ^ ordered[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == brute


def test_simhash_odd(odd, none, spark, folder):
    where = folder(documents=odd)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in simhash.query(spark, where).collect()), key=repr) == components(docs)
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 7, 9]  # 3, 8 and a null are as empty as 2
    assert simhash.dedup(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_dedup_links_from_a_jaccard_of_0_8(spark, tmp_path):
    rng = np.random.default_rng(5)
    docs, pairs = [], []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        near = list(words)
        for at in range(20, 400, 50 if i % 2 else 24):  # a change takes five shingles
            near[at] = "other"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
        a, b = ({" ".join(x[k : k + 5]) for k in range(len(x) - 4)} for x in (words, near))
        pairs.append(len(a & b) / len(a | b))
    assert min(pairs[1::2]) >= 0.8 and max(pairs[1::2]) < 0.9 and max(pairs[::2]) < 0.8
    kept = {r.doc_id for r in simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(60))
    assert all(2 * i + 1 in kept for i in range(0, 60, 2))  # below 0.8 both stay
    assert sum(2 * i + 1 in kept for i in range(1, 60, 2)) <= 2  # the recall of the search


def test_spanning_joins_what_all_pairs_join():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 900), rng.integers(0, 300, 900)
    keep = simhash.spanning(300, a, b, rng.integers(7, 17, 900))
    assert (simhash.forest(300, a[keep], b[keep]) == simhash.forest(300, a, b)).all()
    assert len(keep) == 300 - len(np.unique(simhash.forest(300, a, b)))


def brute_cut(docs, span=200):
    counts = Counter()
    for _, t in docs:
        b = (t or "").encode()
        counts.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if counts[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece,block,size", [(suffix_array.PIECE, suffix_array.BLOCK, suffix_array.RANGE), (700, 3000, 5000), (1 << 20, 1 << 20, 1000)])
def test_suffix_array_is_brute_force(spark, sf, monkeypatch, piece, block, size):
    monkeypatch.setattr(suffix_array, "PIECE", piece)
    monkeypatch.setattr(suffix_array, "BLOCK", block)
    monkeypatch.setattr(suffix_array, "RANGE", size)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in suffix_array.query(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=repr) == brute_cut(docs)


def test_keys_are_the_windows():
    """Two windows share a key exactly if their bytes are equal, and keys of the sample are in order of their bytes."""
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 900).astype(np.uint8)
    text[400:700] = text[50:350]
    text[700:] = 0
    window = np.zeros(900, bool)
    window[: 900 - suffix_array.SPAN + 1] = True
    names = np.zeros(0, np.uint64)
    for level in range(len(suffix_array.STEPS)):
        columns, at = suffix_array.keys_of(text, window, names, level)
        _, place, _ = suffix_array.in_order(columns)
        names = (place + 1).astype(np.uint32 if level else np.uint64)
        depth = (24, 72, 198)[level]
        strings = [text[i : i + depth].tobytes() for i in at]
        order = {x: n + 1 for n, x in enumerate(sorted(set(strings)))}
        assert names.tolist() == [order[x] for x in strings]
    columns, at = suffix_array.keys_of(text, window, names, len(suffix_array.STEPS))
    _, place, counts = suffix_array.in_order(columns)
    got = {int(i) for i, n in zip(at, counts[place]) if n > 1}
    seen = Counter(text[i : i + 200].tobytes() for i in range(701))
    assert got == {i for i in range(701) if seen[text[i : i + 200].tobytes()] > 1}


def test_packed_keys():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3):
        columns = [rng.integers(0, 1 << 64, 500, dtype=np.uint64) >> np.uint64(60 * (k == 0)) for k in range(width)]
        ordered, place, counts = suffix_array.in_order(columns)
        keys = list(zip(*[c.tolist() for c in columns]))
        assert list(zip(*[c.tolist() for c in ordered])) == sorted(set(keys))
        assert [keys.count(k) for k in keys] == counts[place].tolist()
        assert [c.tolist() for c in suffix_array.unpacked(suffix_array.packed(ordered), len(counts), width)] == [c.tolist() for c in ordered]
        splitters = sorted(rng.choice(len(keys), 7).tolist())
        splitters = sorted({keys[i] for i in splitters})
        assert suffix_array.cuts_at(ordered, splitters).tolist() == [sum(k < x for k in set(keys)) for x in splitters]


def test_suffix_array_on_large_groups(spark, monkeypatch):
    """Five thousand near copies of a text and ten thousand equal rows."""
    monkeypatch.setattr(suffix_array, "BLOCK", 1 << 16)
    rng = np.random.default_rng(8)
    base = "".join(chr(97 + x) for x in rng.integers(0, 26, 460))
    near = [(i, base[:230] + f" {i:05d} " + base[230:]) for i in range(5000)]
    equal = [(10_000, "equal rows " * 40)] * 10_000
    docs = near + equal + [(20_000, "".join(chr(97 + x) for x in rng.integers(0, 26, 900)))]
    got = suffix_array._with_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).select("_row.doc_id", suffix_array._digest("text", "spans").alias("d")).select("doc_id", "d.*")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_cut(docs)


def test_suffix_array_odd(spark, odd, none, folder):
    periodic = spark.createDataFrame([(20, "ab" * 400), (21, "z" * 199), (22, "q" * 200), (23, ("é" * 150) + "1"), (24, ("é" * 150) + "2")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(periodic)
    got = [tuple(r) for r in suffix_array.query(spark, folder(documents=docs)).collect()]
    assert sorted(got, key=repr) == brute_cut([tuple(r) for r in docs.collect()])
    cut = suffix_array.dedup(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert [r.n_chars for r in cut.filter("doc_id = 9").collect()] == [0]
    assert suffix_array.dedup(none).count() == 0


def brute_top(vectors, k=5):
    code = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, c in sorted({(i, tuple(c)) for i, c in code if i % 50 == 0}):
        best = sorted((-sum(x * y for x, y in zip(c, d)), i) for i, d in code if i != q and len(c) == len(d))[:k]
        out += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_is_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in topk.query(spark, sf).collect()) == brute_top(vectors)


def test_topk_odd(spark, folder):
    vectors = [(0, [0.5, -0.25]), (50, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0])]
    vectors += [(8, []), (9, [1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [-0.003, 0.0]), (11, [0.0, 0.0]), (150, []), (12, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.query(spark, folder(embeddings=df)).collect()) == [x for x in brute_top([(i, v and [None if y is None else float(np.float32(y)) for y in v]) for i, v in vectors])]
    assert topk.query(spark, folder(embeddings=df.limit(0))).count() == 0
    assert rows(topk.query(spark, folder(embeddings=df.filter("vec_id = 0"))).toPandas()) == []


def test_topk_of_wide_components(spark, folder):
    """Scores beyond 2^53, beyond a long, and beyond what a float can hold as a whole."""
    wide = [(0, [1.0]), (1, [2.0e6]), (2, [3.0e6]), (3, [1.5e6]), (4, [-1e9]), (50, [3.0e6]), (100, [1e30]), (5, [1e30]), (6, [1.0000001e30]), (150, [-3e38]), (7, [3.4e38])]
    wide = [(i, [float(np.float32(x)) for x in v]) for i, v in wide]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.query(spark, folder(embeddings=df)).collect()) == brute_top(wide)


def test_topk_of_repeated_rows(spark, folder):
    twice = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), *[(i, [float(i), 1.0]) for i in range(1, 5)], (2, [2.0, 1.0]), *[(9, [9.0, 9.0])] * 40, (50, [0.0, 1.0])]
    df = spark.createDataFrame(twice, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.query(spark, folder(embeddings=df)).collect()) == brute_top(twice)


def test_scores_in_order_of_their_bytes():
    values = sorted({s * (1 << e) + d for e in (0, 1, 7, 8, 62, 63, 64, 200, 900) for s in (-1, 1) for d in (-1, 0, 1)})
    assert sorted(values, key=topk.ordered_bytes) == values


def test_links_that_a_forest_of_candidates_leaves_out(spark):
    """All texts share every group, and the sketches that agree most are of texts that aren't alike: what the forest drops is still checked."""
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    texts = [(2 * i + k, words(i, 100 + k)) for i in range(12) for k in range(2)]  # each even one is alike to the next
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    first, other = (int(np.array(x, np.uint8).view("<i8")[0]) for x in ([1] * 8, [2] * 8))
    nodes = docs.selectExpr("xxhash64(text) AS node", "0L AS fp", f"CAST({first} AS LONG) AS s0", f"CASE WHEN doc_id % 2 = 0 THEN {first} ELSE {other} END AS s1")
    got = {(r.a, r.b) for r in simhash.alike_links(nodes, docs).collect()}
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    assert got == {tuple(sorted((hashes[2 * i], hashes[2 * i + 1]))) for i in range(12)}


def test_blocks_and_ranges_grow_with_the_input():
    """A block deals to each range: at 6 GB (12 times the 96 MB that are sorted of 0.51 GB) under 1.5 million rows a round, not ten."""
    rows = lambda size: (size // (suffix_array.BLOCK * min(2, suffix_array.larger(size)))) * (size // (suffix_array.RANGE * suffix_array.larger(size)))
    assert suffix_array.larger(0) == suffix_array.larger(96 << 20) == 1
    assert rows(12 * (96 << 20)) < 1_500_000


def test_cuts_of_many_splitters():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3):
        keys = sorted({tuple(map(int, k)) for k in rng.integers(0, 6, (80, width), dtype=np.uint64) + np.uint64(1 << 63)})
        splitters = sorted({tuple(map(int, k)) for k in rng.integers(0, 7, (40, width), dtype=np.uint64) + np.uint64(1 << 63)})
        columns = [np.array(c, np.uint64) for c in zip(*keys)]
        assert suffix_array.cuts_at(columns, splitters).tolist() == [sum(k < s for k in keys) for s in splitters]
    assert suffix_array.cuts_at(columns, []).tolist() == []


@pytest.mark.parametrize("length", [30, 700])
def test_texts_that_cannot_be_alike_give_no_rows(spark, monkeypatch, length):
    """60 texts of one group whose sketches agree, but whose shingles don't, beside two that are alike: no row for each pair of them."""
    words = lambda i, n: [f"w{i}x{j}" for j in range(n)]
    common = words("c", length)
    texts = [(i, " ".join(common + words(i, length))) for i in range(60)]
    texts.append((60, texts[0][1] + " more"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    same = int(np.array([1] * 8, np.uint8).view("<i8")[0])
    nodes = docs.selectExpr("xxhash64(text) AS node", "0L AS fp", f"CAST({same} AS LONG) AS s0", f"CAST({same} AS LONG) AS s1")
    pairs, check = [], simhash.checked
    monkeypatch.setattr(simhash, "checked", lambda p, d: pairs.append(p.count()) or check(p, d))
    got = {(r.a, r.b) for r in simhash.alike_links(nodes, docs).collect()}
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    assert got == {tuple(sorted((hashes[0], hashes[60])))}
    assert sum(pairs) <= 3 * len(texts)


def test_parities_lose_nothing_that_is_alike():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n, new = int(rng.integers(1, 400)), rng.integers(0, 40, 2)
        pool = rng.integers(0, 1 << 63, n + int(new.sum()), dtype=np.uint64)
        a, b = np.unique(pool[: n + new[0]]), np.unique(np.concatenate([pool[:n], pool[n + new[0] :]]))
        odd = [simhash.parities(x, max(simhash.PARITY, 1 << (4 * len(x) - 1).bit_length())).tobytes() for x in (a, b)]
        can = simhash.Parities(np.array([len(a), len(b)]), odd).possible(np.array([0]), np.array([1]))[0]
        few = [simhash.parities(x, simhash.PARITY).view("<u8") for x in (a, b)]
        can_few = simhash.may_be_alike(len(a) + len(b), np.bitwise_count(few[0] ^ few[1]).sum())
        assert (can and can_few) or not simhash.alike(set(a.tolist()), set(b.tolist()))
        assert not can or can_few


def test_anchors_are_computed_once(spark, sf, monkeypatch):
    """Hashing all texts costs most of what comes before the sort: each goes through it once."""
    calls = spark.sparkContext.accumulator(0)
    find = suffix_array.anchored
    monkeypatch.setattr(suffix_array, "anchored", lambda pieces: calls.add(sum(map(len, pieces))) or find(pieces))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    suffix_array.repeated_ranges(docs)
    texts = [(r.text or "").encode() for r in docs.collect()]
    assert calls.value == sum(min(suffix_array.PIECE + suffix_array.SPAN - 1, len(x) - at) for x in texts for at in range(0, max(0, len(x) - suffix_array.SPAN + 1), suffix_array.PIECE))


def test_ties_of_several_columns():
    rng = np.random.default_rng(11)
    for width in (1, 2, 3):
        for n in (0, 1, 2, 5000):
            columns = [rng.integers(0, 9, n, dtype=np.uint64) << np.uint64(60 - 3 * i) for i in range(width)]
            order = suffix_array._sorted(columns)
            assert sorted(order.tolist()) == list(range(n))
            keys = list(zip(*[c[order].tolist() for c in columns]))
            assert keys == sorted(keys)


def test_keys_of_some_positions_are_among_all():
    rng = np.random.default_rng(2)
    text, window = rng.integers(97, 100, 3000).astype(np.uint8), np.zeros(3000, bool)
    window[100:2500] = True
    names = np.zeros(0, np.uint64)
    for level in range(len(suffix_array.STEPS) + 1):
        keys, _ = suffix_array.keys_of(text, window, names, level)
        some, _ = suffix_array.keys_of(text, window, names, level, lambda at: at[5:40])
        assert some and set(zip(*[c.tolist() for c in some])) <= set(zip(*[c.tolist() for c in keys]))
        if level < len(suffix_array.STEPS):
            names = (suffix_array.in_order(keys)[1] + 1).astype(np.uint32)
