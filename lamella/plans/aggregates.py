"""Queries of the aggregating operators over the shared tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import half_up, key_um
from lamella.operators import aggregates as A
from lamella.operators.ordered import gap_clusters
from lamella.tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "a01_consolidate",
    """SELECT p_brand || '|' || p_type || '|' || p_size AS identity, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS "references", count(*) AS quantity FROM part GROUP BY 1""",
)
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("id"), F.lit(1).cast("long").alias("q"), F.col("p_partkey").cast("string").alias("ref"))
    return A.consolidated(rows, "p_partkey", F.col("id"), "q", "ref")


@query(
    "a02_size_census",
    """SELECT floor(l_discount * 1000 + 0.5) / 1000 AS size, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1""",
)
def size_census(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(half_up(F.col("l_discount"), 3).alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query(
    "a03_coverage",
    """WITH s AS (SELECT l_returnflag, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS area FROM lineitem GROUP BY ALL),
t AS (SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS total FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
SELECT l_returnflag, l_suppkey, area, least(area / (total / 100), 1) AS coverage, least(area / (total / 100), 1) >= 0.5 AS solid FROM s LEFT JOIN t USING (l_returnflag)""",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_linenumber", A.exact(F.col("l_extendedprice")).alias("v"))
    planes = rows.groupBy("l_returnflag", "l_suppkey").agg(F.sum("v").cast("double").alias("area"))
    boards = rows.filter("l_linenumber <= 2").groupBy("l_returnflag").agg((F.sum("v").cast("double") / 100).alias("board"))
    share = F.when(F.col("board").isNotNull(), F.least(F.col("area") / F.col("board"), F.lit(1.0)))
    return planes.join(boards, "l_returnflag", "left").withColumn("coverage", share).withColumn("solid", F.col("coverage") >= 0.5).drop("board")


@query(
    "a04_filled_area",
    """SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -CAST(o_totalprice AS DECIMAL(28,6)) ELSE CAST(o_totalprice AS DECIMAL(28,6)) END) AS DOUBLE) AS filled FROM orders GROUP BY 1""",
)
def filled_area(spark: SparkSession, d: str) -> DataFrame:
    v = A.exact(F.col("o_totalprice"))
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", -v).otherwise(v)).cast("double").alias("filled"))


@query(
    "a05_route_summary",
    """WITH g AS (SELECT l_suppkey, CAST(sum(CAST(l_discount * 1000 * l_quantity AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS mean,
  min(l_discount * 1000) AS least, max(l_discount * 1000) AS most, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS length,
  CAST(sum(CASE WHEN abs(l_discount * 1000 - 50) > 45 THEN CAST(l_quantity AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS out FROM lineitem GROUP BY 1)
SELECT *, floor(out * 100 / length * 1000 + 0.5) / 1000 AS out_percent, out = 0 AS within FROM g""",
)
def route_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") * 1000).alias("z"), "l_quantity")
    return A.summary(rows, ["l_suppkey"], "z", "l_quantity", 50.0, 45.0)


@query(
    "a06_array_sum",
    """WITH x AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings),
s AS (SELECT label, i, CAST(sum(CAST(CAST(v AS DOUBLE) AS DECIMAL(28,9))) AS DOUBLE) AS s FROM x GROUP BY ALL)
SELECT label, list(s ORDER BY i) AS embedding FROM s GROUP BY label""",
)
def array_sum(spark: SparkSession, d: str) -> DataFrame:
    return A.array_sum(read(spark, d, "embeddings").select("label", "embedding"), ["label"], "embedding")


@query(
    "a07_dominant",
    """WITH w AS (SELECT l_suppkey, l_discount, sum(CAST(l_quantity AS DECIMAL(28,6))) AS w FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_discount AS dominant, CAST(w AS DOUBLE) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_discount) = 1""",
)
def dominant(spark: SparkSession, d: str) -> DataFrame:
    return A.dominant(read(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_quantity"), ["l_suppkey"], "l_discount", "l_quantity")


@query(
    "a08_modal_gap",
    """WITH b AS (SELECT l_suppkey, CAST(floor(l_tax * 1000 + 0.5) AS BIGINT) AS b, sum(CAST(l_quantity AS DECIMAL(28,6))) AS w, sum(CAST(l_tax * l_quantity AS DECIMAL(28,6))) AS vw FROM lineitem GROUP BY ALL)
SELECT l_suppkey, CAST(vw AS DOUBLE) / CAST(w AS DOUBLE) AS modal, CAST(w AS DOUBLE) AS weight FROM b QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, b) = 1""",
)
def modal_gap(spark: SparkSession, d: str) -> DataFrame:
    return A.modal_mean(read(spark, d, "lineitem").select("l_suppkey", "l_tax", "l_quantity"), ["l_suppkey"], "l_tax", "l_quantity")


@query(
    "a09_hough",
    """WITH p AS (SELECT s_acctbal - c_acctbal AS dx, s_acctbal + c_acctbal AS dy FROM supplier JOIN customer ON s_nationkey = c_nationkey),
c AS (SELECT CAST(floor(dx / 500) AS BIGINT) AS i, CAST(floor(dy / 500) AS BIGINT) AS j, count(*) AS votes FROM p GROUP BY ALL)
SELECT a.i, a.j, a.votes, CAST(sum(b.votes) AS BIGINT) AS score FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL ORDER BY score DESC, a.votes DESC, a.i, a.j LIMIT 1""",
)
def hough(spark: SparkSession, d: str) -> DataFrame:
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    pairs = s.join(c, s.s_nationkey == c.c_nationkey).select((F.col("s_acctbal") - F.col("c_acctbal")).alias("dx"), (F.col("s_acctbal") + F.col("c_acctbal")).alias("dy"))
    return A.vote(pairs, "dx", "dy", 500.0)


@query(
    "a10_fit_shift",
    """WITH p AS (SELECT c_nationkey, o_totalprice / 1000 - c_acctbal / 100 AS a, o_totalprice / 2000 - c_acctbal / 50 AS b FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT c_nationkey, CAST(sum(CAST(a AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS dx, CAST(sum(CAST(b AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS dy,
  CAST(sum(CAST(a * a AS DECIMAL(28,6))) + sum(CAST(b * b AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS s, count(*) AS pairs FROM p GROUP BY 1)
SELECT c_nationkey, floor(dx * 1000 + 0.5) / 1000 AS dx, floor(dy * 1000 + 0.5) / 1000 AS dy, floor(sqrt(greatest(0, s - dx * dx - dy * dy)) * 1000 + 0.5) / 1000 AS rms, pairs FROM g""",
)
def fit_shift(spark: SparkSession, d: str) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        "c_nationkey", (F.col("c_acctbal") / 100).alias("x0"), (F.col("o_totalprice") / 1000).alias("x1"), (F.col("c_acctbal") / 50).alias("y0"), (F.col("o_totalprice") / 2000).alias("y1")
    )
    out = A.shift(rows, ["c_nationkey"], ("x0", "x1"), ("y0", "y1"))
    return out.select("c_nationkey", *[half_up(F.col(c), 3).alias(c) for c in ("dx", "dy", "rms")], "pairs")


@query(
    "a11_pads_per_net",
    """SELECT l_suppkey, count(DISTINCT (CAST(floor(l_tax * 1000 + 0.5) AS BIGINT), CAST(floor(l_discount * 1000 + 0.5) AS BIGINT))) AS pads, arg_min(l_partkey, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey)) AS anchor FROM lineitem GROUP BY 1""",
)
def pads_per_net(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct(key_um(F.col("l_tax")), key_um(F.col("l_discount"))).alias("pads"), F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey"))["l_partkey"].alias("anchor")
    )


@query(
    "a12_plurality_name",
    """WITH c AS (SELECT o_custkey, o_orderpriority AS name, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL)
SELECT o_custkey, arg_min(name, struct_pack(a := -n, b := name)) AS chosen, max(n) AS votes, CASE WHEN count(*) > 1 THEN string_agg(name, ',' ORDER BY name) END AS merged FROM c GROUP BY 1""",
)
def plurality_name(spark: SparkSession, d: str) -> DataFrame:
    return A.plurality(read(spark, d, "orders").select("o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority")


@query("a13_boxes", "SELECT l_suppkey, min(l_quantity) AS min_x, min(l_tax) AS min_y, max(l_quantity) AS max_x, max(l_tax) AS max_y FROM lineitem GROUP BY 1")
def boxes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("min_x"), F.min("l_tax").alias("min_y"), F.max("l_quantity").alias("max_x"), F.max("l_tax").alias("max_y"))


PIXELS = """WITH b AS (SELECT DISTINCT l_partkey AS x, CAST(l_quantity AS BIGINT) AS y FROM lineitem WHERE l_returnflag <> 'A'), h AS (SELECT DISTINCT l_partkey AS x, CAST(l_quantity AS BIGINT) AS y FROM lineitem WHERE l_returnflag <> 'R'),
k AS (SELECT x, y, CASE WHEN h.x IS NULL THEN 'removed' WHEN b.x IS NULL THEN 'added' ELSE 'unchanged' END AS kind FROM b FULL JOIN h USING (x, y)) """


def _pixel_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_quantity").cast("long").alias("y"), "l_returnflag")
    per = rows.groupBy("x", "y").agg(F.max((F.col("l_returnflag") != "A").cast("int")).alias("b"), F.max((F.col("l_returnflag") != "R").cast("int")).alias("h"))
    kind = F.when(F.col("h") == 0, "removed").when(F.col("b") == 0, "added").otherwise("unchanged")
    return per.select("x", "y", kind.alias("kind"))


@query("a14_pixel_diff", PIXELS + "SELECT CAST(floor(x / 100) AS BIGINT) AS cell, kind, count(*) AS n, min(y) AS lo, max(y) AS hi FROM k GROUP BY ALL")
def pixel_diff(spark: SparkSession, d: str) -> DataFrame:
    return _pixel_kinds(spark, d).groupBy(F.floor(F.col("x") / 100).alias("cell"), "kind").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))


@query("a15_layer_report", PIXELS + "SELECT y AS layer, bool_or(kind <> 'unchanged') AS changed, CASE WHEN bool_and(kind = 'added') THEN 'added' WHEN bool_and(kind = 'removed') THEN 'removed' ELSE 'both' END AS verdict FROM k GROUP BY 1")
def layer_report(spark: SparkSession, d: str) -> DataFrame:
    all_ = lambda x: F.bool_and(F.col("kind") == x)
    return _pixel_kinds(spark, d).groupBy(F.col("y").alias("layer")).agg(
        F.bool_or(F.col("kind") != "unchanged").alias("changed"), F.when(all_("added"), "added").when(all_("removed"), "removed").otherwise("both").alias("verdict")
    )


@query(
    "a16_row_pitch",
    """WITH g AS (SELECT l_suppkey, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS gap, l_quantity FROM lineitem)
SELECT l_suppkey, floor(median(gap) * 1000 + 0.5) / 1000 AS pitch, median(l_quantity) AS size FROM g GROUP BY 1""",
)
def row_pitch(spark: SparkSession, d: str) -> DataFrame:
    from lamella.operators.ordered import before

    rows = read(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity")
    rows = rows.withColumn("gap", F.col("l_extendedprice") - before("l_extendedprice", ["l_suppkey"], ["l_extendedprice"]))
    return rows.groupBy("l_suppkey").agg(half_up(F.median("gap"), 3).alias("pitch"), F.median("l_quantity").alias("size"))


@query(
    "a17_series_fold",
    """WITH l AS (SELECT l_suppkey, l_quantity AS t, 1 + l_tax AS e, l_discount AS k, l_returnflag AS m FROM lineitem)
SELECT l_suppkey, CAST(sum(CAST(t AS DECIMAL(28,6))) AS DOUBLE) AS thickness, CASE WHEN count(e) = count(*) THEN CAST(sum(CAST(t AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(CAST(t / e AS DECIMAL(28,12))) AS DOUBLE) END AS permittivity,
  CAST(sum(CAST(t * k AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(CAST(t AS DECIMAL(28,6))) AS DOUBLE) AS loss, array_to_string(list_sort(list(DISTINCT m)), ' + ') AS materials FROM l GROUP BY 1""",
)
def series_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("t"), (F.lit(1) + F.col("l_tax")).alias("e"), F.col("l_discount").alias("k"), F.col("l_returnflag").alias("m"))
    return A.layered(rows, ["l_suppkey"], "t", "e", "k", "m")


@query(
    "a18_fingerprint",
    """SELECT sha256(p_brand || '|' || p_type || '|' || CAST(CAST(floor(p_retailprice / 10 + 0.5) AS BIGINT) AS VARCHAR)) AS fingerprint, min(p_partkey) AS keeper, count(*) AS copies FROM part GROUP BY 1""",
)
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.concat_ws("|", "p_brand", "p_type", F.floor(F.col("p_retailprice") / 10 + 0.5).cast("string")), 256)
    return read(spark, d, "part").groupBy(key.alias("fingerprint")).agg(F.min("p_partkey").alias("keeper"), F.count("*").alias("copies"))


@query(
    "a19_thickness",
    """SELECT l_orderkey, arg_max(l_partkey, struct_pack(a := l_returnflag = 'N', b := l_extendedprice, c := l_partkey)) AS body FROM lineitem GROUP BY 1""",
)
def thickness(spark: SparkSession, d: str) -> DataFrame:
    best = F.max(F.struct((F.col("l_returnflag") == "N").alias("a"), "l_extendedprice", "l_partkey"))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(best["l_partkey"].alias("body"))


@query(
    "a20_header_score",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:25]) AS line, unnest(range(1, least(len(string_split(text, chr(10))), 25) + 1)) AS n FROM documents),
s AS (SELECT doc_id, n, len(list_filter(['the', 'and', 'of', 'de', 'la', 'der'], lambda w: list_contains(string_split(lower(line), ' '), w))) AS score FROM l)
SELECT doc_id, CAST(max(score) AS BIGINT) AS score, CAST(arg_max(n, struct_pack(a := score, b := -n)) AS BIGINT) AS header FROM s GROUP BY 1""",
)
def header_score(spark: SparkSession, d: str) -> DataFrame:
    lines = F.slice(F.split("text", "\n", -1), 1, 25)
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("n", "line"))
    known = F.array(*[F.lit(w) for w in ("the", "and", "of", "de", "la", "der")])
    score = F.size(F.array_intersect(known, F.split(F.lower("line"), " ", -1))).cast("long")
    best = F.max(F.struct(score.alias("s"), (-(F.col("n") + 1)).cast("long").alias("k")))
    return rows.groupBy("doc_id").agg(best["s"].alias("score"), (-best["k"]).alias("header"))


@query("a21_geometry_coverage", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(l_quantity) OVER (PARTITION BY l_discount, l_tax, l_suppkey) AS DOUBLE) AS covered FROM lineitem""")
def geometry_coverage(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    key = Window.partitionBy("l_discount", "l_tax", "l_suppkey")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(key).alias("covered"))


@query(
    "a22_target_verdict",
    """WITH t AS (SELECT p_brand, floor(avg(CAST(p_retailprice AS DECIMAL(28,6))) + 0.5) AS target, CASE WHEN count(*) % 2 = 0 THEN 10 END AS tol FROM part GROUP BY 1)
SELECT p_partkey, floor((p_retailprice - target) / target * 100 * 1000 + 0.5) / 1000 AS deviation, CASE WHEN tol IS NULL THEN NULL ELSE abs(p_retailprice - target) / target * 100 <= tol END AS ok FROM part JOIN t USING (p_brand)""",
)
def target_verdict(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    t = part.groupBy("p_brand").agg(F.floor((F.sum(A.exact(F.col("p_retailprice"))).cast("double") / F.count("*")) + 0.5).cast("double").alias("target"), F.when(F.count("*") % 2 == 0, 10).alias("tol"))
    off = (F.col("p_retailprice") - F.col("target")) / F.col("target") * 100
    ok = F.when(F.col("tol").isNotNull(), F.abs(F.col("p_retailprice") - F.col("target")) / F.col("target") * 100 <= F.col("tol"))
    return part.join(t, "p_brand").select("p_partkey", half_up(off, 3).alias("deviation"), ok.alias("ok"))


@query("a23_plating_census", "SELECT l_linestatus AS how, count(*) AS n FROM lineitem GROUP BY 1")
def plating_census(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("how")).agg(F.count("*").alias("n"))


@query(
    "f10_own_pads",
    """WITH g AS (SELECT l_suppkey, l_tax AS v, l_extendedprice AS x, lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS p FROM lineitem),
c AS (SELECT *, sum(CASE WHEN p IS NULL OR x - p > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT l_suppkey, k, count(*) AS n, min(x) AS lo, max(x) AS hi FROM c GROUP BY ALL)
SELECT l_suppkey, n, lo, hi FROM s WHERE lo <= 30000 AND hi >= 30000""",
)
def own_pads(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("x"))
    found = gap_clusters(rows, ["l_suppkey"], F.col("x"), ["x"], 200, "k").groupBy("l_suppkey", "k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return found.filter("lo <= 30000 AND hi >= 30000").drop("k")
