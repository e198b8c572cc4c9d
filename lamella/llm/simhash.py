"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most two bits agree on two of four 16-bit blocks, so each distinct
fingerprint goes to six groups, one for each pair of blocks. A group too large for a task is divided
once more in the same way by the 32 bits left; what shares the 48 bits then holds 2^16 fingerprints
at most, whatever the input. Copies count once: the index holds distinct fingerprints.

In a task, fingerprints are sorted by Gray rank (blocks shared by the group first). Runs of
neighbours form nodes bottom-up: a node keeps the masked pattern of the bits that all below it
share, and what lies below keeps only the rest. A search goes down from the top, adds up the
differences on the way, and drops a node with all below it once they exceed the limit.
Links of a task are reduced to a forest (its components), which `components` then joins.

Edge cases: texts without a word, and null ones, have fingerprint zero and are linked like any
others; a null doc_id is ignored by the smallest (null if the component has no other); repeated
rows come back as often as they came; an empty table gives no rows. `dedup` keeps the rows'
columns, whatever their names, and one row for each component.

`dedup` doesn't use the settings of the query. Its documents are alike from a Jaccard similarity of
WORDS-word shingles of 0.8 (ALIKE), where some 10 of 64 bits differ, too many for blocks that must
agree. Fingerprints are dealt by ROUNDS random divisions of the bits into groups, by the bits of
each group; what shares one is searched by the same index up to WIDE bits. Pairs whose sketches
(a byte each of SKETCH minima of the shingles' hashes) agree in fewer than LEAST places are left
out; the others are candidates, and each is linked only if its texts' shingles reach the similarity.
The recall of the search is given in the README. Where a group has many candidates, those of a
spanning forest of the best sketches are checked first, so that n copies of a text don't give n^2 rows;
such a group is then searched again, and every candidate is checked whose texts that hasn't joined.

A candidate becomes a row only if its texts can be alike at all. Each text has parities: bit i tells
whether an odd number of its shingles has hash i modulo the bits. A shingle that one of two texts
has alone flips one bit, so parities that differ in more bits than alike texts have such shingles
prove that these aren't alike; nothing that is alike is lost. The first search has PARITY bits, in
which long texts can't be told apart; the second has 4 to 8 bits a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.graph import components
from lamella.llm.common import giving_back
from lamella.tables import if_small, read, stored

SEED = 42
SHINGLE = 3
MOST = 2
FANOUT = 16
GROUP = 16384
#: Codes that are indexed and searched together; queries of one step of the search.
BATCH, STEP = 1 << 16, 1 << 10
#: Of dedup: words of a shingle, least similarity (a fraction), bits that may differ, sketch, divisions of the bits, and bits of a group at least.
WORDS, ALIKE, WIDE = 5, (4, 5), 18
SKETCH, LEAST = 16, 7
ROUNDS, BITS = 8, 10
#: Candidates of each text that are checked before all others, where a group was thinned.
SOME = 16
#: Bits of the parities that all texts have; bytes of parities that are compared at once.
PARITY, COMPARED = 256, 1 << 24


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(join(words), SEED)
    counts = np.zeros(64, np.int64)
    n = len(words) - SHINGLE + 1
    for at in range(0, n, 1 << 16):
        part = words[at : min(at + (1 << 16), n) + SHINGLE - 1]
        hashes = np.array([digest(join(x), SEED) for x in zip(part, part[1:], part[2:])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def _fingerprint(texts):
    import pandas as pd

    return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64), index=texts.index)


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _fingerprint("text").alias("fp"))


def _pairs_of(bits: list[int], width: int) -> list[int]:
    """Masks of each pair of the four blocks of `width` bits at these places."""
    return [sum(((1 << width) - 1) << bits[x] for x in pair) for pair in combinations(range(4), 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


OUTER = _pairs_of([0, 16, 32, 48], 16)
#: For each outer mask, the masks that also hold two of the four 8-bit parts of what it leaves.
INNER = [[mask | m for m in _pairs_of([b for b in range(0, 64, 8) if not mask >> b & 1], 8)] for mask in OUTER]


def _keys(masks: list[int], first: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(first + k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(masks)]))


def permuted(codes: np.ndarray, mask: int) -> np.ndarray:
    """Codes with the bits of the mask moved to the top, in order."""
    out = np.zeros_like(codes)
    places = [b for b in range(64) if not mask >> b & 1] + [b for b in range(64) if mask >> b & 1]
    runs: list[list[int]] = []
    for to, b in enumerate(places):
        if runs and runs[-1][0] + runs[-1][2] == b and runs[-1][1] + runs[-1][2] == to:
            runs[-1][2] += 1
        else:
            runs.append([b, to, 1])
    for b, to, n in runs:
        out |= ((codes >> np.uint64(b)) & np.uint64((1 << n) - 1)) << np.uint64(to)
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the codes up, each (pattern, mask of the bits that count here and not above)."""
    values, masks = codes, np.full(len(codes), ~np.uint64(0))
    levels = []
    while len(values) > FANOUT:
        starts = np.arange(0, len(values), FANOUT)
        head = np.repeat(values[starts], FANOUT)[: len(values)]
        shared = ~np.bitwise_or.reduceat(values ^ head, starts) & np.bitwise_and.reduceat(masks, starts)
        levels.append((values, masks & ~np.repeat(shared, FANOUT)[: len(values)]))
        values, masks = values[starts], shared
    return [*levels, (values, masks)]


def search(levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, code) by place that differ in at most `most` bits."""
    found = []
    for at in range(0, len(queries), STEP):
        part = queries[at : at + STEP]
        q = np.repeat(np.arange(len(part), dtype=np.int32), len(levels[-1][0]))
        node = np.tile(np.arange(len(levels[-1][0]), dtype=np.int32), len(part))
        seen = np.zeros(len(q), np.uint8)
        for depth in range(len(levels) - 1, -1, -1):
            values, masks = levels[depth]
            seen = seen + np.bitwise_count((part[q] ^ values[node]) & masks[node])
            stay = seen <= most
            q, node, seen = q[stay], node[stay], seen[stay]
            if depth:
                below = len(levels[depth - 1][0])
                q, seen = np.repeat(q, FANOUT), np.repeat(seen, FANOUT)
                node = (node[:, None] * np.int32(FANOUT) + np.arange(FANOUT, dtype=np.int32)).ravel()
                real = node < below
                q, node, seen = q[real], node[real], seen[real]
        found.append((q + at, node))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest place it is linked to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(codes: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over the distinct codes that are linked."""
    codes = codes[np.argsort(gray_rank(permuted(codes, mask)), kind="stable")]
    a, b = search(build(codes), codes)
    keep = a < b
    root = forest(len(codes), a[keep], b[keep])
    at = np.nonzero(root != np.arange(len(codes)))[0]
    return codes[at], codes[root[at]]


MASKS = [*OUTER, *[m for masks in INNER for m in masks]]
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, part, fp), sorted: whole groups of one mask are indexed together."""
    kept: list[np.ndarray] = []
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        if kept and (codes := np.unique(np.concatenate(kept))).size > 1:
            a, b = links(codes, MASKS[last[0]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=EDGES)
        kept.clear()

    for batch in batches:
        k, part = batch.column("k").to_numpy(), batch.column("part").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        cuts = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1]))[0] + 1, [len(k)]])
        full = 0  # of this batch, what is in kept already
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = (int(k[lo]), int(part[lo]))
            if last is not None and key != last and (key[0] != last[0] or sum(map(len, kept)) + lo - full >= BATCH):
                kept.append(fp[full:lo])
                full = lo
                yield from flush()
            last = key
        kept.append(fp[full:])
    yield from flush()


def linked(codes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp: at least a forest of all links, and links only."""
    keyed = codes.select("fp", _keys(OUTER, 0).alias("key")).select("fp", "key.*")
    sizes = keyed.groupBy("k", "part").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, ["k", "part"])
    small = keyed.filter(F.col("n") <= GROUP).select("fp", "k", "part")
    more, first = [], len(OUTER)
    for k, masks in enumerate(INNER):
        more.append(keyed.filter((F.col("n") > GROUP) & (F.col("k") == k)).select("fp", _keys(masks, first).alias("key")).select("fp", "key.*"))
        first += len(masks)
    groups = small
    for x in more:
        groups = groups.unionByName(x)
    return groups.repartition("k", "part").sortWithinPartitions("k", "part").mapInArrow(giving_back(_linked), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id and stays (one document of each component) of every row."""
    rows = stored(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    codes = stored(rows.groupBy("fp").agg(first.alias("first")))
    comp = components(linked(codes)).select(F.col("node").alias("fp"), "component")
    codes = stored(codes.join(comp, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    least = codes.groupBy("component").agg(F.min("first").alias("least"))
    found = rows.join(stored(codes.join(least, "component").select("fp", "least")), "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return found.select("doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), stays.alias("stays"))


def shingles(text: str | None, n: int = WORDS) -> list[bytes]:
    """The runs of n words, or all words if there are fewer; none without a word."""
    words = (text or "").encode().lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(n)))]


def alike(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is at least ALIKE; two empty sets are alike."""
    both = len(a & b)
    return both * ALIKE[1] >= (len(a) + len(b) - both) * ALIKE[0]


FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(text)], dtype="<u8")


def parities(different: np.ndarray, size: int) -> np.ndarray:
    """Of different hashes, for each remainder modulo size (a power of two) whether an odd number has it: a bit each, in bytes."""
    odd = np.bincount((different & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def may_be_alike(n: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether texts of n different shingles together can be alike, if at least `differ` of them are in one text only."""
    return differ * (ALIKE[1] + ALIKE[0]) <= n * (ALIKE[1] - ALIKE[0])


def signature(text: str | None) -> tuple[int, ...]:
    """Over shingles of WORDS words: fingerprint, the two halves of the sketch, how many are different, and PARITY parities in four parts."""
    hashes = _hashes(text)
    if not len(hashes):
        return (0,) * 8
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    code = int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)
    least = np.array([(hashes * x).min() for x in FACTORS])
    sketch = ((least ^ (least >> np.uint64(32))) & np.uint64(255)).astype(np.uint8).view("<i8")
    different = np.unique(hashes)
    return code, int(sketch[0]), int(sketch[1]), len(different), *parities(different, PARITY).view("<i8").tolist()


#: The columns of a signature.
SIGNED = ["fp", "s0", "s1", "n", "o0", "o1", "o2", "o3"]


def _signed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signature(x.as_py()) for x in batch.column("text")]
        columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(SIGNED))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", *SIGNED])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) to how many different shingles the text has, its PARITY parities, and 4 to 8 for each shingle (odd)."""
    for batch in batches:
        found = [np.unique(_hashes(x.as_py())) for x in batch.column("text")]
        odd = [parities(x, max(PARITY, 1 << (4 * len(x) - 1).bit_length() if len(x) else 0)).tobytes() for x in found]
        few = np.array([parities(x, PARITY).view("<i8") for x in found], np.int64).reshape(-1, 4)
        columns = [pa.array([len(x) for x in found], pa.int64()), *[pa.array(few[:, i]) for i in range(4)], pa.array(odd, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], names=["node", *SIGNED[3:], "odd"])


def wide_masks(n: int) -> list[int]:
    """Masks of the groups of bits that n texts are dealt by: longer where there are more, and more of them then."""
    bits = max(BITS, n.bit_length() - 11)
    rng = np.random.default_rng(SEED)
    # a pair of 10 different bits shares a group of `bits` with (54/64)^bits: as many as it takes to share as often as with BITS
    rounds = int(np.ceil(ROUNDS * (64 / 54) ** (bits - BITS) * (64 // BITS) / (64 // bits)))
    return [sum(1 << int(x) for x in order[at : at + bits]) for order in (rng.permutation(64) for _ in range(rounds)) for at in range(0, 64 - bits + 1, bits)]


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the pairs (by place) form a forest that joins what all join, heavy pairs first."""
    root, picked = np.arange(n), []
    for level in np.unique(weight)[::-1]:
        at = np.nonzero(weight == level)[0]
        while True:
            x, y = root[a[at]], root[b[at]]
            apart = x != y
            at, low, high = at[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            if not len(at):
                break
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            picked.append(at[first])
            up = np.arange(n)
            up[high[first]] = low[first]
            while (up[up] != up).any():
                up = up[up]
            root = up[root]
    return np.concatenate(picked) if picked else np.zeros(0, np.int64)


class Parities:
    """Of texts by place: how many different shingles each has (n), and its parities (bytes)."""

    def __init__(self, n: np.ndarray, odd: list[bytes]):
        self.n, self.size = n, np.array([len(x) for x in odd])
        self.held = {}
        for size in np.unique(self.size).tolist():  # longer ones are folded: their halves' exclusive or is what half as many bits are
            at = np.nonzero(self.size >= size)[0]
            place = np.zeros(len(odd), np.int64)
            place[at] = np.arange(len(at))
            folded = [np.bitwise_xor.reduce(np.frombuffer(odd[i], "<u8").reshape(-1, size // 8), axis=0) for i in at]
            self.held[size] = place, np.array(folded)

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of places can be alike."""
        keep = np.zeros(len(x), bool)
        least = np.minimum(self.size[x], self.size[y])
        for size, (place, bits) in self.held.items():
            all_at = np.nonzero(least == size)[0]
            for lo in range(0, len(all_at), max(1, COMPARED // size)):
                at = all_at[lo : lo + max(1, COMPARED // size)]
                i, j = x[at], y[at]
                differ = np.bitwise_count(bits[place[i]] ^ bits[place[j]]).sum(axis=1, dtype=np.int64)
                keep[at] = may_be_alike(self.n[i] + self.n[j], differ)
        return keep


def _searched(codes: np.ndarray, sketch: np.ndarray, n: np.ndarray, odd: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (a, b by place, places in which sketches agree) among codes in Gray order that PARITY parities (odd) let be alike, in steps."""
    levels = build(codes)
    for at in range(0, len(codes), STEP):
        x, y = search(levels, codes[at : at + STEP], WIDE)
        x = x + at
        x, y = x[x < y], y[x < y]
        equal = sum((sketch[x, i] == sketch[y, i]).astype(np.int64) for i in range(SKETCH))
        near = equal >= LEAST
        x, y, equal = x[near], y[near], equal[near]
        can = may_be_alike(n[x] + n[y], sum(np.bitwise_count(part[x] ^ part[y]).astype(np.int64) for part in odd))
        yield x[can], y[can], equal[can]


def _near(key: tuple[int, int], rows: np.ndarray, _: list) -> Iterator[tuple[np.ndarray, ...]]:
    """Candidates (a, b, places in which sketches agree) of a group: all if they are few; a forest of them, and the group's key with -1, otherwise."""
    (node, codes, sketch, n, odd), _ = _placed(rows)
    a = b = same = np.zeros(0, np.int64)
    thinned = False
    for x, y, equal in _searched(codes, sketch, n, odd):
        a, b, same = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([same, equal])
        if len(a) > 2 * len(codes):
            keep = spanning(len(codes), a, b, same)
            a, b, same = a[keep], b[keep], same[keep]
            thinned = True
    a, b = node[a], node[b]
    yield np.minimum(a, b), np.maximum(a, b), same
    if thinned:
        yield tuple(np.array([x], np.int64) for x in (*key, -1))


def _apart(masks: list[int]):
    """For groups that were thinned: all candidates (a, b) of different components (the last column) that can be alike, each in the first group it shares."""

    def run(key: tuple[int, int], rows: np.ndarray, odd: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        (node, codes, sketch, n, first), order = _placed(rows)
        comp, all_odd = rows[-1][order], None
        for x, y, _ in _searched(codes, sketch, n, first):
            x, y = x[comp[x] != comp[y]], y[comp[x] != comp[y]]
            differ = codes[x] ^ codes[y]
            for mask in masks[: key[0]]:
                new = differ & np.uint64(mask) != 0
                x, y, differ = x[new], y[new], differ[new]
            if len(x):
                all_odd = all_odd or Parities(n, [odd[i] for i in order])
                can = all_odd.possible(x, y)
                x, y = x[can], y[can]
            yield np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    return run


def _placed(rows: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Node, code, sketch, number of shingles and PARITY parities of rows (node, SIGNED, ...) in Gray order, and this order."""
    order = np.lexsort((rows[0], gray_rank(rows[1].view(np.uint64))))
    rows = rows[:, order]
    return (rows[0], rows[1].view(np.uint64), np.ascontiguousarray(rows[2:4].T).view(np.uint8), rows[4], rows[5:9].view(np.uint64)), order


def _groups(find, columns: list[str], names: list[str], binary: str | None = None):
    """Rows (k, part, columns), sorted by k and part, to what find gives for the key, the columns and the binary column of each group of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        more: list[bytes] = []
        last, out = None, []

        def group() -> Iterator[pa.RecordBatch]:
            rows = kept[0] if len(kept) == 1 else np.concatenate(kept, axis=1)
            if rows.shape[1] > 1:
                for found in find(last, np.ascontiguousarray(rows), more):
                    if len(found[0]):
                        out.append(found)
                    if sum(len(x[0]) for x in out) > BATCH:
                        yield from flush()
            kept.clear()
            more.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=names)
            out.clear()

        for batch in batches:
            k, part = batch.column("k").to_numpy(), batch.column("part").to_numpy()
            values = np.stack([batch.column(c).to_numpy() for c in columns])
            cuts = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1]))[0] + 1, [len(k)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = (int(k[lo]), int(part[lo]))
                if kept and key != last:
                    yield from group()
                last = key
                kept.append(values[:, lo:hi])
                if binary:
                    more.extend(batch.column(binary).slice(lo, hi - lo).to_pylist())
            yield from flush()
        if kept:
            yield from group()
        yield from flush()

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text_a, text_b), those whose texts are alike."""
    for batch in batches:
        at, last, one = [], None, set()
        for i, node in enumerate(batch.column("a").to_pylist()):
            if node != last:
                last, one = node, set(shingles(batch.column("text_a")[i].as_py()))
            if alike(one, set(shingles(batch.column("text_b")[i].as_py()))):
                at.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at, pa.int64())) for c in ("a", "b")], schema=EDGES)


def checked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of text hashes, those whose texts are alike."""
    pairs = stored(pairs.select("a", "b"))
    texts = stored(_texts(stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), docs))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(giving_back(_checked), "a long, b long"))


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the stored nodes (different text hashes)."""
    texts = docs.select(F.xxhash64("text").alias("hash"), "text").join(if_small(nodes), F.col("hash") == F.col("node"), "left_semi")
    return texts.groupBy(F.col("hash").alias("node")).agg(F.first("text").alias("text"))


def _of_texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, n, PARITY parities and odd (see _counted) of the stored nodes."""
    return _texts(nodes, docs).mapInArrow(giving_back(_counted), "node long, n long, o0 long, o1 long, o2 long, o3 long, odd binary")


def alike_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) between the text hashes of nodes (node, SIGNED) whose texts in docs are alike: enough to join what the search finds."""
    masks, columns = wide_masks(nodes.count()), ["node", *SIGNED]
    if "n" not in nodes.columns:  # nor parities
        nodes = stored(nodes.join(_of_texts(stored(nodes.select("node")), docs).drop("odd"), "node"))
    keyed = nodes.select(*columns, _keys(masks, 0).alias("key")).select(*columns, "key.*")
    dealt = keyed.repartition("k", "part").sortWithinPartitions("k", "part")
    found = stored(dealt.mapInArrow(giving_back(_groups(_near, columns, ["a", "b", "same"])), "a long, b long, same long").distinct())
    pairs, thinned = found.filter("same >= 0"), found.filter("same < 0").select(F.col("a").cast("int").alias("k"), F.col("b").alias("part"))
    # first the best pair of each text with a lower one, then whatever those haven't joined
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("same", F.negative("a"))).alias("a"))
    links = checked(best, docs)
    rest = _unjoined(pairs.join(best, ["a", "b"], "left_anti"), stored(components(links)))
    links = links.unionByName(checked(rest, docs))
    if thinned.isEmpty():
        return links
    comp = stored(components(links))
    again = stored(keyed.join(thinned, ["k", "part"], "left_semi").join(comp, "node", "left").select(*columns, F.coalesce("component", "node").alias("comp"), "k", "part"))
    odd = stored(_of_texts(stored(again.select("node").distinct()), docs)).select("node", "odd")
    again = again.join(odd, "node").repartition("k", "part").sortWithinPartitions("k", "part")
    find = _groups(_apart(masks), [*columns, "comp"], ["a", "b"], "odd")
    apart = stored(again.mapInArrow(giving_back(find), "a long, b long").join(pairs, ["a", "b"], "left_anti"))
    # some of each text first, as what they join needs no more; then all others
    some = apart.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b")))).filter(F.col("n") <= SOME).select("a", "b")
    links = links.unionByName(checked(some, docs))
    rest = _unjoined(apart.join(some, ["a", "b"], "left_anti"), stored(components(links)))
    return links.unionByName(checked(rest, docs))


def _unjoined(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are of different components (node, component)."""
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return rows.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))


def alike_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and stays (one document of each component of texts that are alike) of every row."""
    rows = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(giving_back(_signed_texts), _signed_schema(docs)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = stored(rows.groupBy(F.col("text_hash").alias("node"), *SIGNED).agg(first.alias("first")))
    comp = components(alike_links(nodes.drop("first"), docs))
    nodes = stored(nodes.join(comp, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    least = nodes.groupBy("component").agg(F.min("first").alias("least"))
    found = rows.join(stored(nodes.join(least, "component").select(F.col("node").alias("text_hash"), "least")), "text_hash")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return found.select("doc_id", "text_hash", stays.alias("stays"))


def _signed_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("text_hash", *SIGNED)]])


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each component of texts that are alike: that of the smallest doc_id, and of the first text hash if it repeats."""
    found = stored(alike_documents(docs))
    gone = stored(found.filter(~F.col("stays")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    again = not found.filter("stays").groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    names = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_anti")
    if again:  # rows alike in doc_id and text: one of them
        alike = Window.partitionBy("doc_id", "text_hash").orderBy("doc_id")
        rows = rows.withColumn("_n", F.row_number().over(alike)).filter("_n = 1")
    return rows.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
