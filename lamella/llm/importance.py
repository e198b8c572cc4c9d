"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A text's features are its tokens (runs of word characters, runs of other marks) and pairs of neighbours, each
hashed into BUCKETS; pairs of a token with itself share one bucket. Counts of labelled documents of good quality
(MOST_LABELS of them at most, those with the smallest hash of doc_id among all that there are) make the target model, counts of all documents
the raw one (add-one smoothing). A document's log weight
is the sum over its features of log p_target - log p_raw. Adding a Gumbel variate (from a hash of doc_id, so
reruns agree) and keeping the k largest keys samples k documents without replacement in proportion to weight.
k is the share of good ones among labelled documents, of all documents, unless given.

The k-th key is found by counting keys in bins and going into the bin that holds it, never by sorting all. Rows alike in key and
doc_id are counted first.

Edge cases: null and empty texts have weight 0; rows alike in doc_id and text have one key, and are kept or left
together; without labels everything is kept; an empty table gives no rows; `resample` keeps extra columns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.tables import read, stored

BUCKETS = 1 << 14
MOST_LABELS = 20_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE = 1 << 18
BINS = 4096
FEW = 50_000


class Hasher:
    """Texts to the buckets of their features; the hashes of tokens are kept."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall((text or "").lower())
        known = self.known
        new = {x for x in tokens if x not in known}
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(tokens)
            known.update((x, zlib.crc32(x.encode())) for x in new)
        h = np.array([known[x] for x in tokens], dtype=np.uint64)
        pairs = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)
        pairs[h[:-1] == h[1:]] = 0
        return np.concatenate([h % np.uint64(BUCKETS - 1) + np.uint64(1), pairs]).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (good, text) to counts by bucket: of all, and of the good ones."""
    buckets = Hasher()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for good, text in zip(batch.column("good").to_pylist(), batch.column("text"), strict=True):
            counts = np.bincount(buckets(text.as_py()), minlength=BUCKETS)
            raw += counts
            if good:
                target += counts * good
    at = np.nonzero(raw)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket. A document counts for the target once for each label of good quality."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("good")).withColumnRenamed("doc_id", "_id")
    good = good.join(docs.select("doc_id"), F.col("doc_id") == F.col("_id"), "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELS)  # the bound: a top-k by hash
    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left").select(F.coalesce("good", F.lit(0)).alias("good"), "text")
    counts = marked.mapInArrow(_counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weighted(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs with log_weight and key (log_weight and its Gumbel variate)."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    @F.pandas_udf(T.DoubleType())
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Hasher()
        for texts in batches:
            yield pd.Series([float(held.value[buckets(x)].sum()) for x in texts], index=texts.index, dtype=float)

    part = F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 52)).cast("double")
    gumbel = -F.log(-F.log((part + 0.5) / float(1 << 52)))
    return docs.withColumn("log_weight", weigh("text")).withColumn("key", F.col("log_weight") + gumbel)


def kth(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """The k-th row in order of key (largest first) and doc_id; None if there are no more than k."""
    keys = stored(keys.groupBy("key", "doc_id").agg(F.count("*").alias("c")))
    total = keys.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("groups"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if k <= 0 or total.n <= k:
        return None
    rows, need, n, lo, hi = keys, k, total.groups, total.lo, total.hi
    while n > FEW and hi > lo:
        at = F.least(F.floor((F.lit(hi) - F.col("key")) / F.lit(hi - lo) * BINS), F.lit(BINS - 1))  # from the largest down
        rows = rows.withColumn("bin", at)
        for r in rows.groupBy("bin").agg(F.sum("c").alias("n"), F.count("*").alias("groups"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("bin").collect():  # BINS rows
            if need <= r.n:
                rows, n, lo, hi = rows.filter(F.col("bin") == r["bin"]).drop("bin"), r.groups, r.lo, r.hi
                break
            need -= r.n
    order = Window.orderBy(F.col("key").desc(), F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # FEW rows, or those of one key
    last = rows.withColumn("upto", F.sum("c").over(order)).filter(F.col("upto") >= need).orderBy("upto").first()
    return last.key, last.doc_id


def decided(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, text_hash, log_weight, key and kept of each row of docs."""
    if share is None:
        seen = labels.filter("quality IS NOT NULL").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("share")).first().share
        share = 1.0 if seen is None else seen
    rows = weighted(docs.select("doc_id", "text"), log_ratios(docs, labels))
    rows = stored(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "log_weight", "key"))
    k = round(share * rows.count())
    last = kth(rows.select("doc_id", "key"), k)
    if last is None:
        return rows.withColumn("kept", F.lit(k > 0))
    same = F.col("key") == F.lit(last[0])
    upto = same if last[1] is None else same & (F.col("doc_id") <= F.lit(last[1]))
    return rows.withColumn("kept", (F.col("key") > F.lit(last[0])) | F.coalesce(upto, F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of docs that are kept."""
    gone = decided(docs, labels, share).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti")
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, and whether the sample has it."""
    return decided(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "log_weight", "key", "kept")
