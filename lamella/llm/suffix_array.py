"""Removal of long repeated strings by a distributed difference-cover suffix sort.

The bytes of all texts are the string; every byte covered by a SPAN-byte string that starts
anywhere else goes. Sorting all suffixes would shuffle many times the input, so the sort gets what
can matter, and loses nothing:

1. Anchors. Every window of SPAN bytes has a least hashed GRAM-byte string (the first, if several
   tie); consecutive windows with the same one form a context. Equal windows have equal anchors, so a context
   whose anchor occurs once in the corpus holds no repeated window.
2. Equal contexts (equal in a BLAKE2b digest of 128 bits) repeat as wholes, and one of them stands for all: copies of a
   text cost no sorting, however many there are. Contexts that share their anchor with others only of their kind are settled.
3. What is left is cut out as runs of bytes, packed into blocks of about BLOCK bytes, one row each, and sorted by the
   difference cover modulo 3, as relations between blocks and ranges of keys (`named`): each block sorts its keys and
   deals them by sampled splitters, each range of keys names what it gets in order, prefix sums of the ranges' sizes make
   the names global, and the names go back to the blocks.
   - Triples of 8-byte symbols at the positions not divisible by three (the sample) are sorted and named: 24 bytes.
   - The sort recurses on the names: triples of names 24 apart are sorted and named (72 bytes), and triples of those 63 apart
     (198 bytes). All steps are divisible by three, so that a name's neighbours are sampled too.
   - The remaining suffixes are merged with the sampled ones: two suffixes have sampled positions at one same distance
     of 0, 1 or 2, so suffixes are sorted by the name there, the bytes before it and those behind it up to SPAN, once for
     each distance; each is in the two orders that its own position allows.
   - Adjacent suffixes with equal prefixes of SPAN bytes are repeats.
   Names keep the order of the bytes. All sizes go this one way; a key that is very common is one row a block.

The sort isn't done on all bytes because its keys alone would take some 40 times the input on disk.

Edge cases: a null text is empty; texts under SPAN bytes lose nothing; very long texts are read in
overlapping pieces; repeated rows cover each other; an empty table gives no rows; other columns are
kept by `dedup`, which drops the rest of a character that was cut (its bytes outside the repeat).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.common import giving_back
from lamella.tables import drop, read, settle, stored

SPAN = 200
GRAM = 64
#: Bytes hashed at once, bytes of a block, and keys of a range.
PIECE, BLOCK, RANGE = 1 << 18, 1 << 19, 1 << 18
#: Ranges up to which blocks and ranges have those sizes, and how often as large ranges are at most beyond (blocks twice): a block deals to every range,
#: so the rows dealt are as many as blocks times ranges.
RANGES, LARGER = 1 << 10, 4
#: Keys that splitters are chosen from: of each block, and of all. They decide about balance only.
SAMPLE, SAMPLES = 256, 1 << 14
BASE = 0x9E3779B97F4A7C15


# -- the sort ---------------------------------------------------------------------------------------------------------

#: What the names of each round are of: bytes that the three symbols of a key start behind each other.
STEPS = (8, 24, 63)


def wanted_at(window: np.ndarray) -> list[np.ndarray]:
    """For each round the sampled positions that it names, from which positions start a window of SPAN bytes."""
    n = len(window)
    need = window.copy()
    for back in (1, 2):
        need[back:] |= window[: n - back]
    need[::3] = False
    out = [np.nonzero(need)[0]]
    for step in STEPS[:0:-1]:
        more = need.copy()
        for k in (1, 2):
            more[k * step :] |= need[: n - k * step]
        need = more
        out.append(np.nonzero(need)[0])
    return out[::-1]


def keys_of(text: np.ndarray, window: np.ndarray, names: np.ndarray, level: int, pick=lambda at: at) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys (columns, most significant first) that a block sorts in this round, and the positions they are of, or of those that pick takes.
    names: those of the round before, in order of its positions. In the last round each window has two keys."""
    at = wanted_at(window)
    own = pick(at[level]) if level < len(STEPS) else None
    if level == 0:
        symbols = np.ndarray((len(text),), ">u8", np.concatenate([text, np.zeros(7, np.uint8)]).tobytes(), strides=(1,))
        return [symbols[own + k * STEPS[0]].astype(np.uint64) for k in range(3)], own
    named = np.zeros(len(text), np.uint64)
    named[at[level - 1]] = names
    if level < len(STEPS):
        a, b, c = (named[own + k * STEPS[level]] for k in range(3))
        return ([a << np.uint64(32) | b, c] if names.dtype.itemsize == 4 else [a, b, c]), own
    x, u = np.nonzero(window)[0], np.uint64
    byte = text.astype(np.uint64)
    rest = x % 3
    zero, one, two = (pick(x[rest != k]) for k in (0, 2, 1))
    columns = [
        named[zero] << u(16) | byte[zero + SPAN - 2] << u(8) | byte[zero + SPAN - 1],
        u(1) << u(62) | byte[one] << u(54) | named[one + 1] << u(8) | byte[one + SPAN - 1],
        u(2) << u(62) | byte[two] << u(54) | byte[two + 1] << u(46) | named[two + 2],
    ]
    return [np.concatenate(columns)], np.concatenate([zero, one, two])


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    """The order of the keys: by the first column, which settles most, and by each other one only where those before it tie."""
    order = np.argsort(columns[0])
    if len(columns) == 1 or not len(order):
        return order
    first = columns[0][order]
    tied, new = np.arange(len(order)), np.concatenate([[True], first[1:] != first[:-1]])
    for column in columns[1:]:
        keep = ~(new & np.append(new[1:], True))
        tied, group = tied[keep], np.cumsum(new)[keep].astype(np.uint64)
        if not len(tied):
            break
        at = order[tied]
        by = np.argsort(column[at])  # ranks of the column, behind the number of the tie: one key, as sorting by several is much slower
        values = column[at][by]
        rank = np.empty(len(at), np.uint64)
        rank[by] = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
        both = group << np.uint64(32) | rank
        by = np.argsort(both)
        order[tied], both = at[by], both[by]
        new = np.concatenate([[True], both[1:] != both[:-1]])
    return order


def in_order(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The different keys in order, the place among them of each key, and how many have it."""
    order = _sorted(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])  # adjacent keys
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.nonzero(new)[0]
    return [c[first] for c in columns], place, np.diff(np.append(first, len(order)))


def cuts_at(columns: list[np.ndarray], splitters: list[tuple[int, ...]]) -> np.ndarray:
    """Where in keys in order each splitter's range begins."""
    if not splitters:
        return np.zeros(0, np.int64)
    values = np.array(splitters, np.uint64)
    los, his = (np.searchsorted(columns[0], values[:, 0], side) for side in ("left", "right"))
    for i in np.nonzero(his > los)[0] if len(columns) > 1 else []:  # keys that tie with the splitter's first column
        lo, hi = int(los[i]), int(his[i])
        for column, value in zip(columns[1:], values[i, 1:], strict=True):
            part = column[lo:hi]
            lo, hi = lo + int(np.searchsorted(part, value, "left")), lo + int(np.searchsorted(part, value, "right"))
        los[i] = lo
    return los


def packed(columns: list[np.ndarray]) -> bytes:
    """Keys in order as bytes: differences of the first column, the bytes of equal weight together, compressed."""
    first = columns[0].copy()
    first[1:] -= columns[0][:-1]
    return pa.compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in (first, *columns[1:])), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, width: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, n * width * 8, "zstd", asbytes=True), np.uint8).reshape(width, 8, n)
    columns = [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in raw]
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


#: A block: its bytes, contexts (where in the block, how many windows), and the names of the last round.
STATE = "block long, text binary, at binary, nw binary, names binary, width int"


def _windows(at: np.ndarray, nw: np.ndarray, n: int) -> np.ndarray:
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + nw, minlength=n + 1)
    return np.cumsum(edges[:-1]) > 0


def _block(row: dict, level: int, *pick) -> tuple[list[np.ndarray], np.ndarray]:
    text = np.frombuffer(row["text"], np.uint8)
    window = _windows(np.frombuffer(row["at"], np.int32), np.frombuffer(row["nw"], np.int32), len(text))
    return keys_of(text, window, np.frombuffer(row["names"], f"u{row['width']}"), level, *pick)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _splitters(state: DataFrame, level: int, ranges: int) -> list[tuple[int, ...]]:
    """Keys that cut all into ranges of about one size."""
    schema = pa.schema([("key", pa.list_(pa.int64()))])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            rng = np.random.default_rng(row["block"] & 0xFFFFFFFF)
            n = SAMPLE if level < len(STEPS) else SAMPLE // 3  # of each of the last round's three kinds
            columns, _ = _block(row, level, lambda at: at[rng.integers(0, len(at), n)] if len(at) else at)  # noqa: B023
            keys = np.stack(columns, axis=1).view(np.int64)
            yield _batch([(x,) for x in keys.tolist()], schema)

    if ranges < 2:
        return []
    keys = state.mapInArrow(giving_back(some), "key array<long>").orderBy(F.xxhash64("key")).limit(SAMPLES).toArrow().column("key").to_pylist()
    keys = sorted(tuple(x & 0xFFFFFFFFFFFFFFFF for x in k) for k in keys)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})


def _dealt(level: int, splitters: list[tuple[int, ...]]):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            columns, _, counts = in_order(_block(row, level)[0])
            edges = [0, *cuts_at(columns, splitters).tolist(), len(counts)]
            out = [
                (part, row["block"], hi - lo, len(columns), packed([c[lo:hi] for c in columns]), np.packbits(counts[lo:hi] > 1).tobytes())
                for part, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
                if hi > lo
            ]
            yield _batch(out, schema)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys sorted by part to, for each, the names of its keys within the part (1 and up in their order), and whether
    another position has them."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("names", pa.binary()), ("again", pa.binary()), ("most", pa.int64())])
    held: list[dict] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        each = [unpacked(x["keys"], x["n"], x["width"]) for x in held]
        _, place, counts = in_order([np.concatenate(c) for c in zip(*each, strict=True)])
        more = np.concatenate([np.unpackbits(np.frombuffer(x["more"], np.uint8), count=x["n"]) for x in held]).astype(bool)
        again = counts > 1
        again[place[more]] = True
        ends = np.cumsum([x["n"] for x in held])
        out = []
        for x, end in zip(held, ends.tolist(), strict=True):
            own = place[end - x["n"] : end]
            out.append((x["block"], x["part"], x["n"], pa.compress((own + 1).astype(np.uint32), "zstd", asbytes=True), np.packbits(again[own]).tobytes(), len(counts)))
        yield _batch(out, schema)
        held.clear()

    for row in _rows(batches):
        if held and row["part"] != held[0]["part"]:
            yield from flush()
        held.append(row)
    yield from flush()


def _returned(level: int, before: dict[int, int], width: int):
    """Rows of a block (first) and of its keys' names, in order of parts, to the block with the names of this round; in
    the last round, to the ranges of windows that repeat."""
    last = level == len(STEPS)
    schema = pa.schema([("block", pa.int64()), ("s", pa.int32()), ("e", pa.int32())] if last else [("block", pa.int64()), ("text", pa.binary()), ("at", pa.binary()), ("nw", pa.binary()), ("names", pa.binary()), ("width", pa.int32())])

    def done(row: dict, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns, at = _block(row, level)
        _, place, _ = in_order(columns)
        values = np.concatenate(found)[place]
        if not last:
            yield _batch([(row["block"], row["text"], row["at"], row["nw"], values.astype(f"u{width}").tobytes(), width)], schema)
            return
        flags = np.zeros(len(row["text"]) + 2, np.int8)
        flags[at[values.astype(bool)] + 1] = 1
        edges = np.nonzero(np.diff(flags))[0]
        if len(edges):
            yield _batch([(row["block"], int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, found = None, []
        for x in _rows(batches):
            if x["part"] < 0:
                if row is not None:
                    yield from done(row, found)
                row, found = x, []
            elif last:
                found.append(np.unpackbits(np.frombuffer(x["again"], np.uint8), count=x["n"]))
            else:
                found.append(np.frombuffer(pa.decompress(x["own"], x["n"] * 4, "zstd", asbytes=True), np.uint32).astype(np.uint64) + np.uint64(before[x["part"]]))
        if row is not None:
            yield from done(row, found)

    return run


def sort_round(state: DataFrame, level: int, ranges: int) -> DataFrame:
    """A round of the sort over all blocks: what _returned gives for each."""
    keys = state.mapInArrow(giving_back(_dealt(level, _splitters(state, level, ranges))), "part int, block long, n int, width int, keys binary, more binary")
    named = stored(keys.repartition(ranges, "part").sortWithinPartitions("part", "block").mapInArrow(giving_back(_numbered), "block long, part int, n int, names binary, again binary, most long"))
    sizes = named.groupBy("part").agg(F.first("most").alias("most")).orderBy("part").collect()  # a row for each range
    before, total = {}, 0
    for x in sizes:
        before[x.part], total = total, total + x.most
    if total >= 1 << 46:
        raise ValueError("too many names for the keys of the last round")
    none = F.lit(None)
    blocks = state.select("block", F.lit(-1).alias("part"), none.cast("int").alias("n"), none.cast("binary").alias("own"), none.cast("binary").alias("again"), "text", "at", "nw", "names", "width")
    answers = named.select("block", "part", "n", F.col("names").alias("own"), "again", *[none.cast(t).alias(c) for c, t in (("text", "binary"), ("at", "binary"), ("nw", "binary"), ("names", "binary"), ("width", "int"))])
    both = blocks.unionByName(answers).repartition("block").sortWithinPartitions("block", "part")
    out = stored(both.mapInArrow(giving_back(_returned(level, before, 4 if total < 1 << 32 else 8)), "block long, s int, e int" if level == len(STEPS) else STATE))
    drop(named)
    settle(out.sparkSession)
    return out


def larger(size: int) -> int:
    """How often as large ranges are for so many bytes; blocks are twice as large at most, as they hold two keys a byte in the last round."""
    return min(LARGER, max(1, size // (RANGE * RANGES)))


def repeated_windows(blocks: DataFrame) -> DataFrame:
    """block, s, e: ranges of positions of windows that start elsewhere too, for blocks (block, text, at, nw: see STATE)."""
    state = blocks.select("block", "text", "at", "nw", F.lit(b"").alias("names"), F.lit(8).alias("width"))
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // (RANGE * larger(size))))
    for level in range(len(STEPS) + 1):
        found = sort_round(state, level, ranges)
        if level:
            drop(state)
        state = found
    return state


# -- anchors ----------------------------------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rolled(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM-byte string (a power of two) at each place."""
    size = 8
    h = np.ndarray((max(0, len(text) - size + 1),), "<u8", text.tobytes(), strides=(1,)).astype(np.uint64)
    h ^= h >> np.uint64(32)  # what the factors below would leave in the top bits alone
    h = _mixed(h)
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(pow(BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return _mixed(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(piece, anchor, first window, windows) of each context of these texts of SPAN bytes and more."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    lens = np.array([len(x) for x in pieces])
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    grams = _rolled(text)
    places = np.uint64((1 << 22) - 1)
    least = _least((grams & ~places) | np.arange(len(grams), dtype=np.uint64), SPAN - GRAM + 1) & places
    counts = lens - SPAN + 1
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[starts] = True
    first = np.nonzero(new)[0]
    piece = np.searchsorted(starts, first, "right") - 1
    own = first < (starts + counts)[piece]  # not a window that reaches into the next piece
    first, piece = first[own], piece[own]
    size = np.minimum(np.append(first[1:], len(least)), (starts + counts)[piece]) - first
    return piece, grams[least[first].astype(np.int64)].view(np.int64), first - starts[piece], size


PLACES = pa.schema([("akey", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("nw", pa.int32())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (did, th, text) in pieces of some PIECE bytes, and of each its row's did and th and where it begins."""
    for batch in batches:
        ids, hashes, texts = batch.column("did").to_numpy(), batch.column("th").to_numpy(), batch.column("text")
        pieces: list[bytes] = []
        rows: list[int] = []
        offsets: list[int] = []
        held = 0
        for i in range(len(texts)):
            data = (texts[i].as_py() or "").encode()
            for at in range(0, max(0, len(data) - SPAN + 1), PIECE):
                piece = data[at : at + PIECE + SPAN - 1]
                pieces.append(piece)
                rows.append(i)
                offsets.append(at)
                held += len(piece)
                if held >= PIECE:
                    yield pieces, ids[rows], hashes[rows], np.array(offsets)
                    pieces, rows, offsets, held = [], [], [], 0
        if pieces:
            yield pieces, ids[rows], hashes[rows], np.array(offsets)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context: its anchor, a digest of its bytes in two halves, and where it is."""
    for pieces, ids, hashes, offsets in _pieces(batches):
        piece, akey, lo, nw = anchored(pieces)
        ends = (lo + nw + SPAN - 1).tolist()
        digests = b"".join([hashlib.blake2b(pieces[p][s:e], digest_size=16).digest() for p, s, e in zip(piece.tolist(), lo.tolist(), ends, strict=True)])
        halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
        columns = (akey, halves[:, 0].copy(), halves[:, 1].copy(), ids[piece], hashes[piece], lo + offsets[piece], nw.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=PLACES)


BLOCKS = pa.schema([("text", pa.binary()), ("at", pa.binary()), ("nw", pa.binary()), ("did", pa.binary()), ("th", pa.binary()), ("lo", pa.binary()), ("once", pa.binary())])


def _blocks(most: int):
    """Rows (did, th, text, wanted: contexts of the text) to blocks of about `most` bytes of these contexts, neighbours as one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        meta: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            at, nw, did, th, lo, once = (np.array(x) for x in zip(*meta, strict=True))
            data = [b"".join(parts), at.astype(np.int32).tobytes(), nw.astype(np.int32).tobytes(), did.tobytes(), th.tobytes(), lo.tobytes(), once.astype(np.uint8).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], schema=BLOCKS)

        for batch in batches:
            for did, th, text, wanted in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
                data = text.as_py().encode()
                done = 0  # up to where the block has this text
                for lo, nw, once in sorted((x["lo"], x["nw"], x["once"]) for x in wanted.as_py()):
                    end = lo + nw + SPAN - 1
                    if size >= most:
                        yield flush()
                        parts, meta, size, done = [], [], 0, 0
                    start = max(lo, done) if done >= lo else lo
                    parts.append(data[start:end])
                    size += end - start
                    done = end
                    meta.append((size - (end - lo), nw, did, th, lo, once))
        if meta:
            yield flush()

    return run


# -- the operator -----------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"), "text")


def _sorted_spans(blocks: DataFrame) -> DataFrame:
    """did, th, s, e: ranges of bytes covered by repeated windows of the contexts that occur once."""
    found = repeated_windows(blocks).groupBy("block").agg(F.collect_list(F.struct("s", "e")).alias("found"))  # as many as a block has at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
        for row in _rows(batches):
            at, nw = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("at", "nw"))
            did, th, lo = (np.frombuffer(row[c], np.int64) for c in ("did", "th", "lo"))
            flags = np.zeros(len(row["text"]), bool)
            for x in row["found"]:
                flags[x["s"] : x["e"]] = True
            out = []
            for i in np.nonzero(np.frombuffer(row["once"], np.uint8))[0]:
                own = np.concatenate([[0], flags[at[i] : at[i] + nw[i]].astype(np.int8), [0]])
                edges = (np.nonzero(np.diff(own))[0] + lo[i]).tolist()
                out += [(int(did[i]), int(th[i]), s, e + SPAN - 1) for s, e in zip(edges[::2], edges[1::2], strict=True)]
            if out:
                yield _batch(out, schema)

    return blocks.join(found, "block").mapInArrow(giving_back(run), "did long, th long, s long, e long")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """did, th, spans: for each text (of doc_id did, null as the least long, and hash th) with repeated bytes, ranges [s, e) that cover them."""
    spark, texts = docs.sparkSession, _keyed(docs)
    every = stored(texts.mapInArrow(giving_back(_places), "akey long, c0 long, c1 long, did long, th long, lo long, nw int"))  # read twice, as hashing is dearer
    again = stored(every.groupBy("akey").agg(F.count("*").alias("c")).filter("c > 1").select("akey"))  # kept, so that a join with it can split a frequent anchor
    places = stored(every.join(again, "akey", "left_semi"))
    drop(every)
    settle(spark)
    contexts = stored(places.groupBy("akey", "c0", "c1").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "lo", "nw")).alias("at")))
    groups = contexts.groupBy("akey").agg(F.count("*").alias("d"), F.min("n").alias("least")).filter("d > 1 AND least = 1").select("akey")
    wanted = contexts.join(groups, "akey", "left_semi").select("at.did", "at.th", F.struct("at.lo", "at.nw", (F.col("n") == 1).alias("once")).alias("x"))
    wanted = stored(wanted.groupBy("did", "th").agg(F.collect_list("x").alias("wanted")))  # as many as the text has contexts
    whole = contexts.filter("n > 1").select("akey", "c0", "c1")
    spans = places.join(whole, ["akey", "c0", "c1"], "left_semi").select("did", "th", F.col("lo").alias("s"), (F.col("lo") + F.col("nw") + SPAN - 1).alias("e"))
    if not wanted.isEmpty():
        if not texts.groupBy("did", "th").count().filter("count > 1").isEmpty():
            texts = texts.dropDuplicates(["did", "th"])  # of equal rows, one is cut out of
        size = wanted.agg(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda n, x: n + x["nw"] + SPAN - 1))).first()[0]  # at most
        blocks = stored(texts.join(wanted, ["did", "th"]).mapInArrow(giving_back(_blocks(BLOCK * min(2, larger(size)))), "text binary, at binary, nw binary, did binary, th binary, lo binary, once binary").withColumn("block", F.monotonically_increasing_id()))
        settle(spark)
        spans = spans.unionByName(_sorted_spans(blocks))
    return spans.groupBy("did", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # a set: equal rows have equal spans


def _kept(text: str | None, spans) -> tuple[bytes, int, list[bytes]]:
    """The bytes, how many runs go, and what stays between them."""
    data = (text or "").encode()
    stays, runs, at = [], 0, 0
    if spans is not None:
        end = -1
        for s, e in sorted((x["s"], x["e"]) for x in spans):
            if s > end:
                runs += 1
                stays.append(data[at:s])
            end = max(end, e)
            at = end
    stays.append(data[at:])
    return data, runs, stays


@F.pandas_udf(T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
def _digest(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, x in zip(text, spans, strict=True):
        data, runs, stays = _kept(t, x)
        rest = b"".join(stays)
        out.append((len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@F.pandas_udf(T.StringType())
def _rest(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if x is None else "".join(y.decode(errors="ignore") for y in _kept(t, x)[2]) for t, x in zip(text, spans, strict=True)], index=text.index, dtype=object)


def _with_spans(docs: DataFrame) -> DataFrame:
    """The rows of docs in `_row`, their text, and spans."""
    found = stored(repeated_ranges(docs)).select(F.col("did").alias("_did"), F.col("th").alias("_th"), "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    rows = rows.withColumn("did", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text"))
    return rows.join(found, (F.col("did") == F.col("_did")) & (F.col("th") == F.col("_th")), "left")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes of their texts (n_chars follows, if it is there)."""
    rows = _with_spans(docs).withColumn("_text", _rest("text", "spans"))
    columns = {c: F.col(f"_row.`{c}`").alias(c) for c in docs.columns}
    columns["text"] = F.col("_text").alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*columns.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_spans(docs).select(F.col("_row.doc_id").alias("doc_id"), _digest("text", "spans").alias("d")).select("doc_id", "d.*")
