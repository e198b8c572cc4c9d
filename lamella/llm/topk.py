"""Exact top-k by inner product on a bit-sliced index.

Rows fall into blocks of about BLOCK vectors of one length. In a block, each attribute is held as
bit slices: bitmaps over the rows, one for each binary digit of its distance from the attribute's
least value. For a query, the slices of all attributes, weighted by the binary digits of the query's
component (complemented where that is negative), are added column by column with carry-save
bitmap adders. The sums are slices again; from the most significant one down, they split the rows
into those surely above the k-th score and those still level with it. What stays level to the end
has the k-th score exactly, and the smallest vec_ids of it fill the rest.

Queries visit every block (they are dealt to the blocks as rows, sorted behind the block's vectors,
and read one by one): a task holds one block, whatever the number of queries.

Codes and scores are exact at every size: a block whose codes need more than 64 bits on the way holds wide integers. The
order is that of the exact scores; a score that no long can hold is returned as the nearest long.

Rows that are alike in vec_id and vector are counted before the shuffle, and k of them at most are indexed, as no query
can return more.

Edge cases: vectors that are null or hold a null, NaN or infinite component, and rows without a
vec_id, take no part; empty vectors do (their scores are 0); vectors of different lengths don't meet; rows with the query's
vec_id are its own; a query that is there twice is answered once, and two vectors of one vec_id are two queries;
a candidate that is there twice is two candidates; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.tables import read, stored

BLOCK = 16384


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, exactly: as longs, or as objects where they are wider than 2^52."""
    if not vectors.size or np.abs(vectors).max() * scale < 1 << 52:
        return np.floor(vectors * scale).astype(np.int64)
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in vectors.tolist()], dtype=object).reshape(vectors.shape)


def most(codes: np.ndarray) -> int:
    return max(abs(int(codes.min())), abs(int(codes.max()))) if codes.size else 0


def ordered_bytes(score: int) -> bytes:
    """Bytes whose order is that of the numbers: the sign, then how long the number is, then the number."""
    digits = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    code = len(digits).to_bytes(4, "big") + digits
    return b"\1" + code if score >= 0 else b"\0" + bytes(255 - c for c in code)


class Slices:
    """The bit-sliced index of a block: codes is (rows, attributes), rows in order of vec_id."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray) -> None:
        self.ids, self.codes = ids, codes
        self.all = (1 << len(ids)) - 1
        self.low = codes.min(axis=0)
        self.slices, self.width = [], []
        for column in (codes - self.low).T:
            width = int(column.max()).bit_length()
            bits = [np.packbits((column >> j & 1).astype(np.uint8), bitorder="little") for j in range(width)]  # of objects too
            plain = [int.from_bytes(b.tobytes(), "little") for b in bits]
            self.slices.append((plain, [self.all ^ x for x in plain]))
            self.width.append(width)

    def scores(self, query: list[int]) -> list[int]:
        """The slices, lowest first, of each row's score less a constant."""
        columns: dict[int, list[int]] = defaultdict(list)
        for q, (plain, flipped) in zip(query, self.slices, strict=True):
            weight, bitmaps = (q, plain) if q > 0 else (-q, flipped)
            for t in range(weight.bit_length()):
                if weight >> t & 1:
                    for j, bitmap in enumerate(bitmaps):
                        columns[t + j].append(bitmap)
        out, w = [], 0
        while w <= max(columns, default=-1):
            column = columns[w]
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.append(half ^ c)
                columns[w + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                columns[w + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else 0)
            w += 1
        return out

    def top(self, vec_id: int, query: np.ndarray, k: int) -> np.ndarray:
        """Places of the k rows with the highest scores, ties to the smaller vec_id."""
        level, above = self.all, 0
        lo, hi = np.searchsorted(self.ids, [vec_id, vec_id + 1])
        level ^= ((1 << int(hi - lo)) - 1) << int(lo)
        for bitmap in reversed(self.scores([int(x) for x in query])):
            more = above | (level & bitmap)
            n = more.bit_count()
            if n > k:
                level &= bitmap
            else:
                above = more
                level &= ~bitmap
                if n == k:
                    level = 0
                    break
        found = self._places(above)
        while level and len(found) < k:
            lowest = level & -level
            found.append(lowest.bit_length() - 1)
            level ^= lowest
        return np.array(found, dtype=np.int64)

    def _places(self, bitmap: int) -> list[int]:
        found = []
        while bitmap:
            lowest = bitmap & -bitmap
            found.append(lowest.bit_length() - 1)
            bitmap ^= lowest
        return found


OUT = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("place", pa.binary())])
LONG = (1 << 63) - 1


def _searched(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, None
        ids: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        for batch in batches:
            out: list[tuple[list, ...]] = []
            dim, block, kind, vec_id, query = (batch.column(c).to_numpy() for c in ("dim", "block", "kind", "vec_id", "query"))
            listed = batch.column("vector")
            values, offsets = listed.values.to_numpy(), listed.offsets.to_numpy()
            cuts = np.nonzero((dim[1:] != dim[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(dim)], strict=True):
                if lo == hi:
                    continue
                at = (int(dim[lo]), int(block[lo]))
                if at != key:
                    key, index = at, None
                    ids.clear()
                    codes.clear()
                rows = values[offsets[lo] : offsets[hi]].reshape(hi - lo, at[0])
                if kind[lo] == 0:
                    ids.append(vec_id[lo:hi].copy())
                    codes.append(rows.copy())
                    continue
                if not ids:
                    continue
                index = index or Slices(np.concatenate(ids), integers(np.concatenate(codes), scale))
                asked = integers(rows, scale)
                narrow = most(index.codes) * most(asked) * at[0] < LONG
                for own, number, row in zip(vec_id[lo:hi].tolist(), query[lo:hi].tolist(), asked, strict=True):
                    best = index.top(own, row, k)
                    found = index.codes[best] if narrow else index.codes[best].astype(object)
                    scores = [int(x) for x in found @ (row if narrow else row.astype(object))] if at[0] else [0] * len(best)
                    out.append(([own] * len(best), [number] * len(best), index.ids[best].tolist(), [max(-LONG - 1, min(LONG, x)) for x in scores], [ordered_bytes(x) for x in scores]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for part in column for x in part], t) for column, t in zip(zip(*out, strict=True), OUT.types, strict=True)], schema=OUT)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors (vec_id, vector array<double>) for each of queries (the same columns), by inner products of floor(scale * x)."""
    queries = queries.select("vec_id", "vector", F.size("vector").alias("dim")).distinct()
    vectors = vectors.groupBy("vec_id", "vector").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    vectors = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("n"))
    blocks = stored(vectors.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")))
    number = F.xxhash64("vector").alias("query")
    held = vectors.join(blocks, "dim").select("dim", F.pmod(F.xxhash64("vec_id", "vector"), "blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", number, "vector")
    asked = queries.join(blocks, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", number, "vector")
    dealt = held.unionByName(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind", "vec_id")
    found = dealt.mapInArrow(_searched(k, scale), "query_id long, query long, vec_id long, score long, place binary")
    best = Window.partitionBy("query_id", "query").orderBy(F.col("place").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (as doubles) of the rows that can be scored."""
    whole = F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(whole).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sound(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS code FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS (SELECT DISTINCT vec_id, code FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.code, v.vec_id, CASE WHEN len(q.code) = 0 THEN 0 ELSE CAST(list_dot_product(CAST(q.code AS DOUBLE[]), CAST(v.code AS DOUBLE[])) AS BIGINT) END AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.code) = len(v.code))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, code ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
