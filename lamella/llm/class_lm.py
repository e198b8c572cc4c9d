"""Scoring texts with a Brown class-based bigram model.

A word's probability is that of its class after the class before it, times that of the word in its class:
P(w | v) = P(class(w) | class(v)) * P(w | class(w)); a text starts behind an end.

Classes are learned by exchange clustering, and every training word gets one by its neighbours. Their number grows with
the vocabulary (its cube root). Texts are turned into numbers of words once; the rounds read those.
1. The SEEDS most frequent words are exchanged one by one, each to the class that raises the likelihood of all class bigrams most.
2. Rounds over the FREQUENT most frequent words: the counts of (word, side, class of the neighbour) of all training texts are
   summed by words in ranges, and each word moves to the class that raises the likelihood most, given all others' classes; all
   move at once, and a round that lowers the likelihood is taken back.
3. The words beyond, a distributed table, are exchanged in the same way against these classes.
The last three bytes (ENDINGS groups of them) decide only for words that training hasn't seen, or has seen among unknown neighbours
only: they get the class that most rare words of their group have.

Smoothing: a word c times in training has (c + 1) / Z in its class, Z being the sum of that over the class's words and 1 for
a word not seen; a class after another has (n + KAPPA * q) / (N + KAPPA), q being the class's share of all Z. Both sum to one.

The FREQUENT words are sent to the tasks; the words beyond are rows that meet their counts and classes by a join, so the
vocabulary isn't bounded. As those are rare by choice, none is a hot key.

Edge cases: a null text is empty: one token, the end; a null doc_id counts as the empty text for the split; very long texts
are one row's work; repeated rows are scored each, and train each; an empty table gives no rows; without training texts all
words are unknown and the end is the only token the model has; other columns aren't looked at.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import giving_back
from lamella.tables import drop, read, settle, stored

FREQUENT = 200_000
SEEDS = 1000
ENDINGS = 255
FEWEST, MOST = 16, 1024
ROUNDS, SEED_ROUNDS = 2, 6
KAPPA = 10.0
#: Words counted at once; codes summed at once; ranges of words; numbers in a matrix of gains.
FLUSH, CODES, RANGES, CELLS = 1 << 18, 1 << 19, 64, 1 << 20
#: No class.
NONE = 0xFFFF
END = b""


def words(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only, as bytes do it) between the six ASCII blanks, and the end."""
    return [*(text or "").encode().lower().split(), END]


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def n_classes(types: int) -> int:
    return max(FEWEST, min(MOST, round(types ** (1 / 3))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column("text"):
            counts.update(words(text.as_py()))
            if len(counts) >= FLUSH:
                yield rows(counts)
                counts.clear()
    if counts:
        yield rows(counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; the end is empty) and c, of all texts of docs."""
    return docs.select("text").mapInArrow(giving_back(_counted), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The end, and the words of at least `least` occurrences, most frequent first: word to place, and counts."""

    places: dict[bytes, int]
    counts: np.ndarray
    least: int


def frequent(counts: DataFrame, most: int = FREQUENT) -> Lexicon:
    """The words of the highest counts, as many whole counts as give `most` words at most."""
    steps = counts.groupBy("c").agg(F.count("*").alias("n"))  # different counts: few, and read one by one
    upto = Window.orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = steps.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") <= most).agg(F.min("c").alias("c")).first().c
    least = 1 << 62 if least is None else least
    table = counts.filter((F.col("c") >= least) | (F.octet_length("word") == 0)).toArrow()
    found = {w: c for w, c in zip(table.column("word").to_pylist(), table.column("c").to_pylist(), strict=True)}
    rows = [(END, found.pop(END, 0)), *sorted(found.items(), key=lambda x: (-x[1], x[0]))]
    return Lexicon({w: i for i, (w, _) in enumerate(rows)}, np.array([c for _, c in rows], np.int64), least)


def tokenised(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """row (a number), doc_id, training, places (of each token its place in the lexicon, or -1, as bytes) and rare (the words of those)."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon.places)  # FREQUENT words at most
    names = ["row", "doc_id", "training", "places", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, none = held.value.get, itertools.repeat(-1)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                data, rare = [], []
                for text in batch.column("text"):
                    tokens = words(text.as_py())
                    places = np.fromiter(map(get, tokens, none), np.int32, len(tokens))
                    data.append(places.tobytes())
                    rare.append([tokens[i] for i in np.nonzero(places < 0)[0]])
                columns = [*[batch.column(c) for c in names[:3]], pa.array(data, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "training", "text")
    return stored(rows.mapInArrow(giving_back(run), "row long, doc_id long, training boolean, places binary, rare array<binary>"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some hundred texts, so that what is worked out for a part stays small."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            yield whole.slice(at, 512)


def _flat(batch: pa.RecordBatch, column: str = "places", kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The counts n by cell of rows (cell, n), as a square."""
    found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # size^2 rows at most
    out = np.zeros(size * size, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def bigrams(tokens: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """How often each class follows each in the tokens' places; of: the class of each place, negative for none. A text begins behind an end."""
    held = tokens.sparkSession.sparkContext.broadcast(np.append(of, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in _slices(batches):
            cls = held.value[_flat(batch)]
            before = np.roll(cls, 1)  # ends stand behind each other's texts
            both = (cls >= 0) & (before >= 0)
            total += np.bincount(before[both] * size + cls[both], minlength=size * size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return _summed(tokens.select("places").mapInArrow(giving_back(run), "cell long, n long"), size)


def exchange(pairs: np.ndarray, classes: int, rounds: int = SEED_ROUNDS) -> np.ndarray:
    """The class of each unit. Units move one by one in order of frequency; of equally good classes, to the first."""
    size = len(pairs)
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.arange(size) % classes
    member = np.zeros((size, classes), np.float64)
    member[np.arange(size), of] = 1
    counts = pairs.astype(np.float64)
    right, left = counts @ member, counts.T @ member  # of each unit: followed by, and following, each class
    grid = member.T @ right
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            r, l, s, own = right[u].copy(), left[u].copy(), counts[u, u], of[u]
            # without u
            grid[own] -= r
            grid[:, own] -= l
            grid[own, own] += s
            r[own] -= s
            l[own] -= s
            rows, columns = grid.sum(axis=1) + l, grid.sum(axis=0) + r  # what leads to u, and from it, counts wherever u is
            n_row, n_column = r.sum() + s, l.sum() + s
            at_row, at_column = np.nonzero(r)[0], np.nonzero(l)[0]
            gain = (xlogx(grid[:, at_row] + r[at_row]) - xlogx(grid[:, at_row])).sum(axis=1) + (xlogx(grid[at_column] + l[at_column, None]) - xlogx(grid[at_column])).sum(axis=0)
            d = grid[diagonal, diagonal]
            gain += xlogx(d + r + l + s) - xlogx(d) - (xlogx(d + r) - xlogx(d)) - (xlogx(d + l) - xlogx(d))
            gain -= xlogx(rows + n_row) - xlogx(rows) + xlogx(columns + n_column) - xlogx(columns)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            grid[best] += r
            grid[:, best] += l
            grid[best, best] += s
            if best != own:
                moved += 1
                of[u] = best
                right[:, own] -= counts[:, u]
                right[:, best] += counts[:, u]
                left[:, own] -= counts[u]
                left[:, best] += counts[u]
        if not moved:
            break
    return of


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(grid: np.ndarray) -> float:
    """That of all class bigrams, less what doesn't depend on classes."""
    g = grid.astype(np.float64)
    return float(xlogx(g).sum() - xlogx(g.sum(axis=0)).sum() - xlogx(g.sum(axis=1)).sum())


def moved(word: np.ndarray, key: np.ndarray, n: np.ndarray, own: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The best class of each word, given all others'. An entry is a word (sorted, from 0, none left out), a key (the class before
    it, or classes + the class behind it) and how often; own: the words' classes, negative for none."""
    classes = len(grid)
    g = grid.astype(np.float64)
    table = np.vstack([g, g.T])
    logs = xlogx(table)
    out = own.copy()
    starts = np.searchsorted(word, np.arange(len(own)))
    step = max(1, CELLS // classes)
    done = 0
    while done < len(own):  # whole words, about `step` entries
        end = max(done + 1, int(np.searchsorted(starts, starts[done] + step, "right")) - 1) if starts[done] + step < len(word) else len(own)
        lo, hi = starts[done], starts[end] if end < len(own) else len(word)
        w, k, c = word[lo:hi] - done, key[lo:hi], n[lo:hi].astype(np.float64)
        had = own[done:end]
        sums = table[k]
        sums += c[:, None]
        gain = np.log(sums)
        gain *= sums
        gain -= logs[k]
        at = np.nonzero(had[w] >= 0)[0]
        mine = had[w[at]]
        gain[at, mine] = logs[k[at], mine] - xlogx(np.maximum(table[k[at], mine] - c[at], 0))
        total = np.add.reduceat(gain, starts[done:end] - lo, axis=0)
        for side, all_ in ((0, g.sum(axis=0)), (1, g.sum(axis=1))):  # of what follows, and of what leads
            times = np.bincount(w, c * (k // classes == side), end - done)
            cost = xlogx(all_[None, :] + times[:, None]) - xlogx(all_)[None, :]
            rows = np.nonzero(had >= 0)[0]
            cost[rows, had[rows]] = xlogx(all_[had[rows]]) - xlogx(np.maximum(all_[had[rows]] - times[rows], 0))
            total -= cost
        best = total.argmax(axis=1)
        held = np.where(had >= 0, total[np.arange(len(had)), np.maximum(had, 0)], -np.inf)
        out[done:end] = np.where(total[np.arange(len(had)), best] > held + 1e-9, best, had)
        done = end
    return out


def exchanged(tokens: DataFrame, of: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """A round over all places: the class of each after it."""
    size, spark = len(grid), tokens.sparkSession
    held = spark.sparkContext.broadcast((np.append(of, -1), grid))
    schema = pa.schema([("part", pa.int32()), ("codes", pa.binary()), ("n", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls_of = held.value[0]
        pending: list[np.ndarray] = []
        sums: list[tuple[np.ndarray, np.ndarray]] = []

        def combine() -> None:
            if pending:
                sums.append(np.unique(np.concatenate(pending), return_counts=True))
                pending.clear()
            if len(sums) > 1:
                codes, place = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
                sums[:] = [(codes, np.bincount(place, np.concatenate([x[1] for x in sums])).astype(np.int64))]

        def rows() -> Iterator[pa.RecordBatch]:
            combine()
            if sums:
                codes, n = sums.pop()
                part = codes // (2 * size) % RANGES
                order = np.argsort(part, kind="stable")
                codes, n, part = codes[order], n[order], part[order]
                edges = np.searchsorted(part, np.arange(RANGES + 1))
                out = [(k, pa.compress(np.diff(codes[a:b], prepend=0), "zstd", asbytes=True), n[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for batch in _slices(batches):
            flat = _flat(batch).astype(np.int64)
            cls = cls_of[flat]
            for side, near in ((0, np.roll(cls, 1)), (1, np.roll(cls, -1))):
                at = (flat >= 0) & (near >= 0)
                pending.append(flat[at] * (2 * size) + side * size + near[at])
            if sum(map(len, pending)) >= CODES:
                combine()
                if len(sums[0][0]) >= 2 * CODES:
                    yield from rows()
        yield from rows()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls_of, g = held.value
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def settled() -> Iterator[pa.RecordBatch]:
            if kept:
                codes, place = np.unique(np.concatenate([x[0] for x in kept]), return_inverse=True)
                n = np.bincount(place, np.concatenate([x[1] for x in kept]))
                places, word = np.unique(codes // (2 * size), return_inverse=True)
                best = moved(word, codes % (2 * size), n, cls_of[places], g)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(best)], names=["place", "class"])
                kept.clear()

        for batch in batches:
            for part, codes, n in zip(*(batch.column(c).to_pylist() for c in ("part", "codes", "n")), strict=True):
                if last is not None and part != last:
                    yield from settled()
                last = part
                count = np.frombuffer(n, np.uint32)
                kept.append((np.cumsum(np.frombuffer(pa.decompress(codes, len(count) * 8, "zstd", asbytes=True), np.int64)), count))
        yield from settled()

    rows = tokens.select("places").mapInArrow(giving_back(gather), "part int, codes binary, n binary")
    found = rows.repartition(RANGES, "part").sortWithinPartitions("part").mapInArrow(giving_back(decide), "place long, class long").toArrow()  # FREQUENT rows at most
    out = of.copy()
    out[found.column("place").to_numpy()] = found.column("class").to_numpy()
    settle(spark)
    return out


def rare_classes(tokens: DataFrame, of: np.ndarray, grid: np.ndarray) -> DataFrame:
    """word, c, ending and class (negative: no neighbour is known) of the training words beyond the lexicon."""
    size = len(grid)
    held = tokens.sparkSession.sparkContext.broadcast((np.append(of, NONE).astype(np.int64), grid))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls_of = held.value[0]
        for batch in _slices(batches):
            flat = _flat(batch)
            cls, at = cls_of[flat], np.nonzero(flat < 0)[0]
            if len(at):
                beside = np.roll(cls, 1)[at] << 16 | np.roll(cls, -1)[at]  # the classes before and behind
                yield pa.RecordBatch.from_arrays([batch.column("rare").flatten(), pa.array(beside)], names=["word", "beside"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value[1]
        for batch in batches:
            lens = batch.column("beside").value_lengths().to_numpy()
            word, beside = np.repeat(np.arange(len(lens)), lens), batch.column("beside").flatten().to_numpy()
            near = np.concatenate([beside >> 16, beside & NONE])
            code = np.concatenate([word, word]) * (2 * size) + near + np.repeat([0, size], len(word))
            codes, n = np.unique(code[near < NONE], return_counts=True)
            known, at = np.unique(codes // (2 * size), return_inverse=True)
            best = np.full(len(lens), -1, np.int64)
            if len(known):
                best[known] = moved(at, codes % (2 * size), n, np.full(len(known), -1, np.int64), g)
            endings = [ending(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(lens, pa.int64()), pa.array(endings, pa.int32()), pa.array(best)], names=["word", "c", "ending", "class"])

    rows = tokens.select("places", "rare").mapInArrow(giving_back(gather), "word binary, beside long")
    words_ = rows.groupBy("word").agg(F.collect_list("beside").alias("beside"))  # fewer than the lexicon's rarest word has
    return stored(words_.mapInArrow(giving_back(decide), "word binary, c long, ending int, class long"))


@dataclass
class Model:
    """of: the class of each place of the lexicon; endings: of each group of words not seen; steps: log10 P(class | class before); norms:
    log10 Z of each class; tokens and types of the training texts."""

    lexicon: Lexicon
    of: np.ndarray
    endings: np.ndarray
    steps: np.ndarray
    norms: np.ndarray
    tokens: int
    types: int


LINES = "doc_id long, training boolean, n_tokens long, known long, logs double, classes binary"


def lines_of(tokens: DataFrame, rare: DataFrame, lexicon: Lexicon, of: np.ndarray, endings: np.ndarray) -> DataFrame:
    """doc_id, training, n_tokens, known, logs (the sum of log10(c + 1)) and classes of the tokens of each row."""
    asked = tokens.select("row", F.posexplode("rare").alias("at", "word"))
    entry = F.struct("at", F.when(F.col("class").isNull(), F.col("word")).alias("word"), "c", F.col("class").cast("short").alias("class"))  # words that aren't known
    found = asked.join(rare.select("word", "c", "class"), "word", "left").groupBy("row").agg(F.collect_list(entry).alias("found"))
    found = stored(found)
    settle(tokens.sparkSession)
    held = tokens.sparkSession.sparkContext.broadcast((lexicon.counts, of, endings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of_, ends = held.value
        counts, of_ = np.append(counts, 0), np.append(of_, 0)
        logs = np.log10(counts + 1.0)
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                flat, lens = _flat(batch), np.array([len(x) // 4 for x in batch.column("places").to_pylist()])
                starts = np.cumsum(lens) - lens
                cls, known, log = of_[flat].astype(np.uint16), (counts[flat] > 0).astype(np.int64), logs[flat]
                entries = batch.column("found").flatten()
                if len(entries):
                    n = batch.column("found").value_lengths().fill_null(0).to_numpy()
                    order = np.lexsort((entries.field("at").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)))
                    c, k = (entries.field(x).fill_null(-1).to_numpy()[order] for x in ("c", "class"))
                    new = np.nonzero(c < 0)[0]
                    k = k.copy()
                    k[new] = [ends[ending(w)] for w in entries.field("word").take(pa.array(order[new])).to_pylist()]
                    rare = flat < 0
                    cls[rare], known[rare], log[rare] = k, c > 0, np.log10(np.maximum(c, 0) + 1.0)
                data = cls.tobytes()
                classes = [data[2 * a : 2 * b] for a, b in zip(starts.tolist(), (starts + lens).tolist(), strict=True)]
                columns = [batch.column("doc_id"), batch.column("training"), pa.array(lens, pa.int64()), pa.array(np.add.reduceat(known, starts)), pa.array(np.add.reduceat(log, starts)), pa.array(classes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "training", "n_tokens", "known", "logs", "classes"])

    return stored(tokens.join(found, "row", "left").select("doc_id", "training", "places", "found").mapInArrow(giving_back(run), LINES))


def _class_pairs(lines: DataFrame, of_end: int, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in _slices(batches):
            flat = _flat(batch, "classes", np.uint16).astype(np.int64)
            total += np.bincount(np.concatenate([[of_end], flat[:-1]]) * size + flat, minlength=size * size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return _summed(lines.select("classes").mapInArrow(giving_back(run), "cell long, n long"), size)


def train(docs: DataFrame, training: Column | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the texts of docs that training is true of (all, if not given), its rare words (see rare_classes), and the lines of all docs."""
    docs = docs.select("doc_id", "text", (F.lit(True) if training is None else training).alias("training"))
    counts = stored(word_counts(docs.filter("training")))
    total = counts.agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).first()
    size = n_classes(total.types)
    lexicon = frequent(counts)
    drop(counts)
    tokens = tokenised(docs, lexicon)
    settle(docs.sparkSession)
    own = tokens.filter("training")
    seeds = np.full(len(lexicon.counts), -1, np.int64)
    n = min(SEEDS, len(seeds))
    seeds[:n] = np.arange(n)
    of = np.full(len(seeds), -1, np.int64)
    of[:n] = exchange(bigrams(own, seeds, n), size)
    grid, best = bigrams(own, of, size), None
    for _ in range(ROUNDS):
        new = exchanged(own, of, grid)
        new_grid = bigrams(own, new, size)
        if best is not None and likelihood(new_grid) < best:
            break
        of, grid, best = new, new_grid, likelihood(new_grid)
    alone = of < 0  # only ever beside words that have no class
    of[alone] = np.arange(alone.sum()) % size
    rare = rare_classes(own, of, grid)
    settle(docs.sparkSession)
    votes = rare.filter("class >= 0").groupBy("ending", "class").agg(F.count("*").alias("n")).collect()  # ENDINGS x classes rows at most
    endings = np.zeros(ENDINGS, np.int64)
    for x in sorted(votes, key=lambda x: (x.n, -x["class"])):
        endings[x.ending] = x["class"]
    group = F.get(F.array(*[F.lit(int(x)) for x in endings]), F.col("ending")).cast("long")
    rare = rare.withColumn("class", F.when(F.col("class") >= 0, F.col("class")).otherwise(group))
    z = np.bincount(of, (lexicon.counts + 1) * (lexicon.counts > 0), size) + 1.0
    for x in rare.groupBy("class").agg(F.sum(F.col("c") + 1).alias("z")).collect():  # a row for each class
        z[x["class"]] += x.z
    lines = lines_of(tokens, rare, lexicon, of, endings)
    grid = _class_pairs(lines.filter("training"), int(of[0]), size)
    steps = (grid + KAPPA * z / z.sum()) / (grid.sum(axis=1, keepdims=True) + KAPPA)
    drop(tokens)
    settle(docs.sparkSession)
    return Model(lexicon, of, endings, np.log10(steps), np.log10(z), total.tokens or 0, total.types), rare, lines


def scored(lines: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of lines."""
    held = lines.sparkSession.sparkContext.broadcast((model.steps, model.norms, int(model.of[0])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, norms, end = held.value
        for batch in batches:
            path = []
            for classes in batch.column("classes").to_pylist():
                cls = np.frombuffer(classes, np.uint16)
                path.append(float(steps[np.concatenate([[end], cls[:-1]]), cls].sum() - norms[cls].sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_tokens", "known", "logs")], pa.array(path, pa.float64())], names=["doc_id", "n_tokens", "known", "logs", "path"])

    rows = lines.mapInArrow(giving_back(score), "doc_id long, n_tokens long, known long, logs double, path double")
    every = float(np.log10(model.tokens + model.types + 1))
    return rows.select("doc_id", "n_tokens", F.col("known").alias("n_known"), (F.col("logs") - F.col("n_tokens") * every).alias("base_score"), (F.col("logs") + F.col("path")).alias("score"))


def score_texts(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of texts that needn't be the training's; rare: the words that `train` returns."""
    tokens = tokenised(docs.select("doc_id", "text", F.lit(False).alias("training")), model.lexicon)
    return scored(lines_of(tokens, rare, model.lexicon, model.of, model.endings), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, lines = train(read(spark, sf_dir, "documents"), ~held_out())
    return scored(lines, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
