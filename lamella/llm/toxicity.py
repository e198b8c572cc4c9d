"""Toxicity as a grade of severity, by cumulative-link (proportional odds) ordinal regression.

Grades come from the labels, by any expression over them (`grade`). The labels of this corpus have two bits; unless told otherwise,
the grade is 0 where toxic is 0, 1 where it is 1, and 2 where the document was also judged of low quality (quality 0):
toxic and without merit ranks above toxic alone. One weight vector serves all thresholds:
P(grade >= k) = sigmoid(w . x - t_k) with t_1 <= t_2, and the expected severity is the sum of these.
A document is toxic from a chance of grade > 0 on that a third of the training rows, kept out of a first fit, chose by
its F0.5, which weighs precision above recall (between 0.05 and 0.5); the second fit then has all rows.

Features are sparse marks of a text: its words (runs of letters, lower case), their beginnings and
ends of 4 to 8 letters, and each of these once more if the text has it twice or more, and four
times or more. Candidates are marks of three or more documents graded above 0; of them, the likelihood
ratio of grade > 0 over the training rows decides.
The model is fitted on labelled documents, at most MOST_ROWS of them (those with the smallest hash of
doc_id among all that have a label), and scored on every document. Rows, candidates and features are bounded, so the fit
runs on the driver, whatever the size of the corpus.

Edge cases: null and empty texts have no marks, and get the model's base rate; labels that are null
don't train, nor do labelled rows without a document or a doc_id; a doc_id labelled twice has the higher grade; rows alike in doc_id
and text train once; without
two grades to learn from, nothing is toxic; an empty table gives no rows; `drop_toxic` keeps the
columns of the documents, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.common import giving_back
from lamella.tables import read, stored

MOST_ROWS = 12_000
MOST_CANDIDATES = 1 << 16
MOST_FEATURES = 4096
LEAST_BAD = 3
LEAST_RATIO = 10.0
PARTS = range(4, 9)
TIMES = {"": 1, "2": 2, "4": 4}
LETTERS = re.compile(r"[^\W\d_]+")
CACHE = 1 << 18


def parts(word: str) -> list[str]:
    ends = [x for n in PARTS if len(word) > n for x in ("^" + word[:n], "$" + word[-n:])]
    return ["=" + word, *ends]


def marks(text: str | None) -> set[str]:
    """All marks of a text."""
    counts: Counter[str] = Counter()
    for word, n in Counter(LETTERS.findall((text or "").lower())).items():
        for part in parts(word):
            counts[part] += n
    return {times + x for x, n in counts.items() for times, least in TIMES.items() if n >= least}


class Lookup:
    """Which of some known marks a text has; what a word has to do with them is worked out once."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known = known
        self.parts = {x.lstrip("24") for x in known}
        self.words: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        counts: dict[str, int] = {}
        for word, n in Counter(LETTERS.findall((text or "").lower())).items():
            found = self.words.get(word)
            if found is None:
                if len(self.words) >= CACHE:
                    self.words.clear()
                found = self.words[word] = tuple(x for x in parts(word) if x in self.parts)
            for x in found:
                counts[x] = counts.get(x, 0) + n
        keys = (times + x for x, n in counts.items() for times, least in TIMES.items() if n >= least)
        return sorted(self.known[x] for x in keys if x in self.known)


@dataclass
class Model:
    """features: mark to place; weights by place; thresholds in order; cut: the least chance that counts as toxic."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def chances(self, found: list[int]) -> np.ndarray:
        """P(grade >= k) for each threshold k, of a text with these features."""
        return 1 / (1 + np.exp(-np.clip(float(self.weights[found].sum()) - self.thresholds, -500, 500)))


def fit_ordinal(row: np.ndarray, flat: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent (Adam) on the penalised likelihood. Row row[i] has feature flat[i]."""
    levels, rows = int(grades.max()), len(grades)
    share = np.array([np.clip((grades >= k).mean(), 1e-6, 1 - 1e-6) for k in range(1, levels + 1)])
    w, first = np.zeros(n_features), np.log((1 - share[0]) / share[0])
    steps_up = np.log(np.maximum(np.diff(np.log((1 - share) / share)), 1e-2))  # thresholds as a first one and logs of the gaps
    theta = np.concatenate([w, [first], steps_up])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        w, first, gaps = theta[:n_features], theta[n_features], np.exp(theta[n_features + 1 :])
        t = first + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, w[flat], rows)
        above = np.hstack([np.ones((rows, 1)), sigmoid(z[:, None] - t), np.zeros((rows, 1))])  # P(grade >= k), k = 0 and up
        slope = above * (1 - above)
        at = np.arange(rows)
        p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        dz = -(slope[at, grades] - slope[at, grades + 1]) / p
        dt = np.zeros(levels)
        for k in range(1, levels + 1):
            dt[k - 1] = (slope[:, k] * ((grades == k) * 1.0 - (grades == k - 1)) / p).sum()
        g = np.concatenate([np.bincount(flat, dz[row], n_features) + penalty * w, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
        g /= rows
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[n_features + 1 :])
    return theta[:n_features], theta[n_features] + np.concatenate([[0], np.cumsum(gaps)])


def best_cut(chances: np.ndarray, bad: np.ndarray, least: float = 0.05, most: float = 0.5) -> float:
    """The chance between least and most from which calling rows bad has the highest F0.5; the highest of equals."""
    tries = np.unique(np.append(chances[(chances >= least) & (chances <= most)], most))[::-1]
    score = [1.25 * (bad & (chances >= c)).sum() / max(1, 0.25 * bad.sum() + (chances >= c).sum()) for c in tries]
    return float(tries[int(np.argmax(score))])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text"):
            yield pa.RecordBatch.from_arrays([pa.array(sorted(marks(text.as_py())), pa.string())], names=["mark"])


def _found(rows: DataFrame, known: dict[str, int]) -> DataFrame:
    """row (a number of it), grade, and the places `at` of the known marks of each row's text."""
    held = rows.sparkSession.sparkContext.broadcast(known)  # MOST_CANDIDATES marks at most

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(held.value)
        for batch in batches:
            found = [look(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], names=["row", "grade", "at"])

    return rows.select(F.monotonically_increasing_id().alias("row"), "grade", "text").mapInArrow(giving_back(places), "row long, grade int, at array<int>")


def _counts(rows: DataFrame, marks_: list[str]) -> DataFrame:
    """at, a, n: how many rows graded above 0, and how many in all, have each of the marks; summed in each task first."""
    held = rows.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(marks_)})  # MOST_CANDIDATES marks at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(held.value)
        a, n = np.zeros(len(held.value), np.int64), np.zeros(len(held.value), np.int64)
        for batch in batches:
            for grade, text in zip(batch.column("grade").to_pylist(), batch.column("text"), strict=True):
                at = look(text.as_py())
                n[at] += 1
                a[at] += grade > 0
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(a[at]), pa.array(n[at])], names=["at", "a", "n"])

    return rows.select("grade", "text").mapInArrow(giving_back(count), "at long, a long, n long").groupBy("at").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, grade: Column | None = None) -> DataFrame:
    """doc_id, text and grade of the labelled documents, most_rows at most: a top-k by hash of those that there are."""
    if grade is None:
        grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(grade.cast("int")).alias("grade"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    there = keyed.select("doc_id", "_text").join(known, F.col("doc_id") == F.col("_id")).groupBy("_id", "_text").agg(F.max("grade").alias("grade"))
    chosen = there.orderBy(F.xxhash64("_id"), "_id", "_text").limit(most_rows).select("_id", F.col("_text").alias("_hash"), "grade")
    found = keyed.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_hash")))  # most_rows rows at most
    return found.groupBy("doc_id", "_text").agg(F.first("text").alias("text"), F.first("grade").alias("grade")).drop("_text")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, grade: Column | None = None) -> Model:
    """A model of the grades (0 and up; see the module) of the labelled documents."""
    sample = stored(labelled(docs, labels, most_rows, grade))
    total = {r.grade: r["count"] for r in sample.groupBy("grade").count().collect()}
    bad, good = sum(n for g, n in total.items() if g), total.get(0, 0)
    if not bad or not good:
        return Model({}, np.zeros(0), np.zeros(0))
    seen = sample.filter("grade > 0").select("text").mapInArrow(giving_back(_marked), "mark string").groupBy("mark").agg(F.count("*").alias("a"))
    seen = seen.filter(F.col("a") >= LEAST_BAD).orderBy(F.col("a").desc(), "mark").limit(MOST_CANDIDATES)
    candidates = seen.select("mark").toArrow().column("mark").to_pylist()
    counted = _counts(sample, candidates)
    a, n, every = F.col("a").cast("double"), F.col("n").cast("double"), float(bad + good)
    term = lambda seen, expected: F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (
        term(a, n * bad / every) + term(n - a, n * good / every) + term(bad - a, (every - n) * bad / every) + term(good - n + a, (every - n) * good / every)
    )
    best = counted.withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.col("ratio").desc(), "at").limit(MOST_FEATURES)
    chosen = [r["at"] for r in best.select("at").collect()]
    known = [candidates[i] for i in chosen]
    rows = _found(sample, {x: i for i, x in enumerate(known)}).toArrow()  # MOST_FEATURES of MOST_ROWS at most
    order = np.argsort(rows.column("row").to_numpy())
    found = rows.column("at").to_pylist()
    grades = rows.column("grade").to_numpy().astype(np.int64)[order]
    row = np.repeat(np.arange(len(order)), [len(found[i]) for i in order])
    flat = np.fromiter((x for i in order for x in found[i]), np.int64)
    out = np.arange(len(grades)) % 3 == 2
    cut, inside = 0.5, ~out[row]
    if grades[~out].any() and grades[out].any():
        weights, thresholds = fit_ordinal((np.cumsum(~out) - 1)[row[inside]], flat[inside], grades[~out], len(chosen))
        z = np.bincount(row, weights[flat], len(grades))[out] if len(row) else np.zeros(int(out.sum()))
        cut = best_cut(1 / (1 + np.exp(-np.clip(z - thresholds[0], -500, 500))), grades[out] > 0)
    weights, thresholds = fit_ordinal(row, flat, grades, len(chosen))
    return Model({x: i for i, x in enumerate(known)}, weights, thresholds, cut)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `tox`: p_toxic, severity (the expected grade) and toxic."""
    held = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.thresholds, model.cut))  # MOST_FEATURES weights

    @F.pandas_udf(T.StructType([T.StructField("p_toxic", T.DoubleType()), T.StructField("severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())]))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from giving_back(chances_of)(batches)

    def chances_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = Model(*held.value)
        look = Lookup(fitted.features)
        for text in batches:
            chances = [fitted.chances(look(x)) for x in text]
            yield pd.DataFrame({"p_toxic": [float(x[0]) if len(x) else 0.0 for x in chances], "severity": [float(x.sum()) for x in chances], "toxic": [len(x) > 0 and bool(x[0] >= fitted.cut) for x in chances]})

    return docs.withColumn("tox", score("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The rows of docs that aren't toxic. The model learns from `training` (docs, if not given) and labels."""
    model = train(docs if training is None else training, labels)
    rows = scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), model)
    return rows.filter("NOT tox.toxic").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", "tox.p_toxic", F.col("tox.severity").alias("expected_severity"), "tox.toxic")
