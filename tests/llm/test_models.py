"""Toxicity, SentencePiece, language model, importance resampling, and the pipeline."""

import math
import os
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

from lamella.llm import class_lm, importance, pipeline, sentencepiece_codec, toxicity

BIG = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    rest = toxicity.scored(docs.filter("doc_id % 2 = 1").join(labels, "doc_id"), model).select("toxic", F.col("tox.p_toxic").alias("p"), F.col("tox.severity").alias("s"), F.col("tox.toxic").alias("called")).toPandas()
    called = rest.called
    assert (rest.toxic[called] == 1).mean() > 0.94  # precision
    assert called[rest.toxic == 1].mean() > 0.88  # recall; a part of the labels has no mark in the text
    assert (rest.s >= rest.p - 1e-12).all() and (rest.s <= 2).all()
    assert model.thresholds[0] <= model.thresholds[1]


def test_ordinal_fit_finds_the_order():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3)) < 0.5
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=600)
    grades = (z > 0.5).astype(int) + (z > 2.0)
    row, flat = np.nonzero(x)
    w, t = toxicity.fit_ordinal(row, flat, grades, 3)
    assert w[0] > 1.2 and w[1] < -0.4 and abs(w[2]) < 0.5 and t[0] < t[1]


def test_toxicity_scores_are_the_model(spark, sf):
    """Every document's chances, from all marks of its text."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(model.features) and any(x.startswith("=") for x in model.features)
    for r in toxicity.query(spark, sf).collect():
        z = sum(model.weights[model.features[m]] for m in toxicity.marks(texts[r.doc_id]) if m in model.features)
        above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert abs(r.p_toxic - above[0]) < 1e-9 and abs(r.expected_severity - sum(above)) < 1e-9
        assert r.toxic == (r.p_toxic >= model.cut)


def test_labelled_documents_fill_the_bound(spark):
    """Labels without a document, or twice for one, don't use the sample up."""
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(5, "text 5"), (None, "x")], "doc_id long, text string"))
    labels = spark.range(5000).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS INT) AS toxic")
    labels = labels.unionByName(labels.selectExpr("doc_id", "0 AS quality", "toxic")).unionByName(spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int"))
    got = toxicity.labelled(docs, labels, 60).collect()
    assert len(got) == 60 and len({r.doc_id for r in got}) == 60
    assert all(r.grade == 2 * (r.doc_id % 2) for r in got)  # the higher of two
    assert toxicity.labelled(docs, labels).count() == 100


def test_a_long_word_is_a_mark():
    word = "x" * 70
    assert "=" + word + "a" in toxicity.marks(word + "a") and "=" + word + "a" not in toxicity.marks(word + "b")


def test_toxicity_odd(spark, odd, none, labels, folder):
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    got = toxicity.query(spark, folder(documents=odd, labels=labels))
    assert got.count() == odd.count() and got.filter("p_toxic IS NULL").isEmpty()
    assert toxicity.drop_toxic(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.load())


PIECES = {}


def best_path(v, data):
    if not PIECES:
        own = set(v.bytes_at.tolist())
        PIECES.update({s: i for i, s in enumerate(v.spelled) if s and i not in own})
    pieces = PIECES
    best, came = [0.0] + [-math.inf] * len(data), [None] * (len(data) + 1)
    for i in range(len(data)):
        if best[i] == -math.inf:
            continue
        width = 1 + (data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)
        if best[i] + v.fallback > best[i + width]:
            best[i + width], came[i + width] = best[i] + v.fallback, (i, [int(v.bytes_at[c]) for c in data[i : i + width]])
        for j in range(i + 1, min(len(data), i + 64) + 1):
            at = pieces.get(data[i:j])
            if at is not None and best[i] + v.scores[at] > best[j]:
                best[j], came[j] = best[i] + v.scores[at], (i, [at])
    out, at = [], len(data)
    while at:
        at, ids = came[at]
        out = ids + out
    return out, best[-1]


def test_encoding_is_the_best_path(spark, sf, codec):
    v = codec.vocabulary
    texts = ["a", " ", "\n", "Hello  world", "  two", "été ▁ 漢字 😀\x00\t", "x" * 300, "abc漢" * 1500, "x" * 5000]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]
    spelled = v.bytes_at.tolist()
    for text, ids in zip(texts, codec.encode(texts)):
        assert codec.decode(ids) == text
        assert ids.tolist() == [i for c in codec.chunks(text) for i in best_path(v, c.encode())[0]]  # the best path of each chunk
        _, score = best_path(v, (" " + text).encode())  # and, added up, the best score of the whole text
        ours, at = 0.0, 0
        while at < len(ids):
            lead = v.spelled[ids[at]][0]
            own = ids[at] in spelled
            ours += v.fallback if own else v.scores[ids[at]]
            at += 1 + (own and (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0))
        assert abs(ours - score) < 1e-6 * max(1, abs(score))


def test_a_walk_alone_is_the_walk_together(codec):
    chunks = [" hello", "漢字x", " " * 40, "word" * 90, "é😀" * 30, "a"]
    assert [sentencepiece_codec.walked(codec.vocabulary, c.encode()) for c in chunks] == sentencepiece_codec.viterbi(codec.vocabulary, [c.encode() for c in chunks])


def test_encoding_keeps_columns_of_its_names(spark):
    docs = spark.createDataFrame([("one two", "mine", 7)], "text string, SP_IDS string, _sp_ids int")
    got = sentencepiece_codec.encode(docs).first()
    assert (got.SP_IDS, got._sp_ids) == ("mine", 7) and len(got["__sp_ids"]) >= 2 and got.sp_round_trip


def test_round_trip(spark, sf, odd, none):
    got = sentencepiece_codec.query(spark, sf)
    assert got.filter("NOT round_trip").isEmpty() and got.filter("n_tokens <> size(ids)").isEmpty()
    rows = sentencepiece_codec.encode(odd)
    assert rows.columns[: len(odd.columns)] == odd.columns
    assert rows.filter("text IS NOT NULL AND NOT sp_round_trip").isEmpty()
    assert rows.filter("text IS NULL AND sp_ids IS NOT NULL").isEmpty()
    assert [r.sp_ids for r in rows.filter("doc_id = 3").collect()] == [[]]
    assert sentencepiece_codec.encode(none).count() == 0


def test_trie_holds_the_pieces():
    trie = sentencepiece_codec.build_trie({b"a": 1, b"ab": 2, b"abc": 3, b"b\xff": 4, b"\x00": 5})

    def look(data):
        state = 0
        for c in data:
            to = trie.base[state] + c + 1
            if trie.check[to] != state:
                return -1
            state = to
        return int(trie.value[state])

    assert [look(x) for x in (b"a", b"ab", b"abc", b"b", b"b\xff", b"\x00", b"c")] == [1, 2, 3, -1, 4, 5, -1]


def base(docs):
    counts = Counter()
    for d, t in docs:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            counts.update(class_lm.words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        w = class_lm.words(t)
        out.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [class_lm.FREQUENT, 50])
def test_language_model(spark, sf, monkeypatch, most):
    monkeypatch.setattr(class_lm.frequent, "__defaults__", (most,))
    got = class_lm.query(spark, sf).toPandas()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ours = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()), key=repr)
    assert ours == base(docs)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()  # a lower perplexity on texts it hasn't seen


def test_language_model_beats_the_base_by_far(spark):
    """Perplexity on held-out texts of 10,000 documents: less than two thirds of the base's."""
    held = class_lm.query(spark, BIG).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** (-held.s / held.n) < 0.67 * 10 ** (-held.b / held.n)


@pytest.mark.parametrize("most", [class_lm.FREQUENT, 300])
def test_language_model_is_its_formula_and_sums_to_one(spark, sf, monkeypatch, most):
    monkeypatch.setattr(class_lm.frequent, "__defaults__", (most,))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model, rare, lines = class_lm.train(docs, ~class_lm.held_out())
    own = Counter(w for r in docs.filter(~class_lm.held_out()).collect() for w in class_lm.words(r.text))
    of = {w: int(model.of[p]) for w, p in model.lexicon.places.items()}
    found = {bytes(r.word): (r.c, r["class"]) for r in rare.collect()}
    assert set(of) | set(found) == set(own) and not set(of) & set(found)  # every training word has a class
    assert all(own[w] == c for w, (c, _) in found.items())
    of |= {w: k for w, (_, k) in found.items()}
    assert np.allclose((10**model.steps).sum(axis=1), 1)
    z = np.ones(len(model.norms))
    for w, n in own.items():
        z[of[w]] += n + 1
    assert np.allclose(np.log10(z), model.norms)
    grid = np.zeros((len(z), len(z)))
    for r in docs.filter(~class_lm.held_out()).collect():
        before = of[b""]
        for w in class_lm.words(r.text):
            grid[before, of[w]] += 1
            before = of[w]
    wanted = (grid + class_lm.KAPPA * z / z.sum()) / (grid.sum(axis=1, keepdims=True) + class_lm.KAPPA)
    assert np.allclose(np.log10(wanted), model.steps)
    scores = {}
    for r in docs.collect():
        before, score = of[b""], 0.0
        for w in class_lm.words(r.text):
            k = of.get(w, model.endings[class_lm.ending(w)])
            score += model.steps[before, k] + math.log10((own.get(w, 0) + 1) / z[k])
            before = k
        scores[r.doc_id] = score
    for got in (class_lm.scored(lines, model), class_lm.score_texts(docs, model, rare)):
        assert all(abs(r.score - scores[r.doc_id]) < 1e-6 * abs(scores[r.doc_id]) for r in got.collect())


def test_moves_raise_the_likelihood():
    """The gain of a move of one word, without bigrams of the word with itself or of its own classes, is that of the likelihood."""
    rng = np.random.default_rng(4)
    grid = rng.integers(20, 200, (6, 6))
    entries = [(w, k, int(rng.integers(1, 9))) for w in range(40) for k in sorted(rng.choice(12, 4, replace=False))]
    word, key, n = np.array(entries).T
    best = class_lm.moved(word, key, n, np.full(40, -1), grid)
    for w in range(40):
        tries = []
        for c in range(6):
            g = grid.copy()
            for _, k, m in [e for e in entries if e[0] == w]:
                if k < 6:
                    g[k, c] += m
                else:
                    g[c, k - 6] += m
            tries.append(class_lm.likelihood(g))
        assert tries[best[w]] > max(tries) - 12  # the terms that a word shares with itself are left out


def test_exchange_finds_classes():
    rng = np.random.default_rng(2)
    true = np.arange(40) % 2
    pairs = np.zeros((40, 40), np.int64)
    at = 0
    for _ in range(20_000):
        to = int(rng.choice(np.nonzero(true != true[at])[0]) if rng.random() < 0.95 else rng.integers(40))
        pairs[at, to] += 1
        at = to
    of = class_lm.exchange(pairs, 2)
    assert max((of == true).mean(), (of != true).mean()) > 0.95


def test_language_model_odd(spark, odd, none, folder):
    got = class_lm.query(spark, folder(documents=odd.select("doc_id", "text", "word"))).toPandas()
    ours = sorted(((None if math.isnan(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()), key=repr)
    assert ours == base([(r.doc_id, r.text) for r in odd.collect()])
    assert class_lm.query(spark, folder(documents=none)).count() == 0


def test_importance_sorts_quality(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    got = importance.decided(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.05


def test_importance_is_brute_force(spark, sf):
    """Counts, weights, keys and the sample, document by document."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    marked = labels.collect()

    def buckets(text):
        h = [zlib.crc32(x.encode()) for x in importance.TOKEN.findall((text or "").lower())]
        pairs = [0 if a == b else ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 40) % (importance.BUCKETS - 1) + 1 for a, b in zip(h, h[1:])]
        return [x % (importance.BUCKETS - 1) + 1 for x in h] + pairs

    raw, target = Counter(), Counter()
    for t in texts.values():
        raw.update(buckets(t))
    for r in marked:
        if r.quality == 1 and r.doc_id in texts:
            target.update(buckets(texts[r.doc_id]))
    n, m = raw.total() + importance.BUCKETS, target.total() + importance.BUCKETS
    weight = {d: sum(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in buckets(t)) for d, t in texts.items()}
    part = {r.doc_id: r.p for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'gumbel'), 1L << 52) AS p").collect()}
    key = {d: w - math.log(-math.log((part[d] + 0.5) / 2**52)) for d, w in weight.items()}
    k = round(sum(r.quality == 1 for r in marked) / len(marked) * len(texts))
    kept = set(sorted(texts, key=lambda d: (-key[d], d))[:k])
    for r in importance.query(spark, sf).collect():
        assert abs(r.log_weight - weight[r.doc_id]) < 1e-6 and abs(r.key - key[r.doc_id]) < 1e-6
        assert r.kept == (r.doc_id in kept)


def test_kth_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 10)
    keys = spark.range(5000).selectExpr("CAST(null AS LONG) AS doc_id", "1.5 AS key").unionByName(spark.range(100).selectExpr("id AS doc_id", "CAST(id AS DOUBLE) AS key")).selectExpr("doc_id", "CAST(key AS DOUBLE) AS key")
    assert importance.kth(keys, 98) == (2.0, 2) and importance.kth(keys, 99) == (1.5, None) and importance.kth(keys, 5098) == (1.5, None) and importance.kth(keys, 5099) == (1.0, 1)


def test_kth(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 10)
    values = [(i, float(v)) for i, v in enumerate(np.random.default_rng(4).normal(size=500).round(2))]
    order = sorted(values, key=lambda x: (-x[1], x[0]))
    keys = spark.createDataFrame(values, "doc_id long, key double")
    for k in (1, 7, 250, 499):
        assert importance.kth(keys, k) == (order[k - 1][1], order[k - 1][0])
    assert importance.kth(keys, 500) is None


def test_importance_odd(spark, odd, none, labels):
    got = importance.decided(odd, labels, 0.5)
    assert got.count() == 12
    kept = importance.resample(odd, labels, 0.5)
    assert kept.columns == odd.columns and kept.count() == got.filter("kept").count()
    assert importance.resample(none, labels).count() == 0
    assert importance.resample(odd, labels.limit(0)).count() == 12


def test_pipeline(spark, sf, odd, labels, folder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    last = pipeline.run(spark, sf).toPandas()
    assert last.columns.tolist() == ["doc_id", "ids", "n_tokens"]
    assert sorted(last.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline_odd(spark, odd, none, labels, folder):
    where = folder(documents=odd, labels=labels)
    assert pipeline.run(spark, where).count() > 0
    assert pipeline.run(spark, folder(documents=none, labels=labels.limit(0))).count() == 0


CLEAN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,2048]").config("spark.executor.memory", "1500m").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).config("spark.executorEnv.PYTHONPATH", "").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from lamella.llm import registry
for name, f in registry.QUERIES.items():
    print("ROWS", name, f(spark, {sf!r}).count(), flush=True)
import os
os._exit(0)
"""


def test_workers_need_no_copy_of_the_package(tmp_path, sf):
    """All queries on executors that have neither the package's folder nor a PYTHONPATH."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    (tmp_path / "shared").mkdir()
    code = CLEAN.format(repo=repo, sf=sf, shared=f"file://{tmp_path}/shared")
    home = tmp_path / "home"
    home.mkdir()
    for p in os.listdir(os.path.dirname(pyspark.__file__)):
        if p != "work":  # where executors write
            (home / p).symlink_to(f"{os.path.dirname(pyspark.__file__)}/{p}")
    env |= {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.count("ROWS") == 11, done.stdout + done.stderr[-3000:]
