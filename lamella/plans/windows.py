"""Queries of the window-like, ordering and distinct operators over the shared tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions.text import fuzzy_score, half_up, natural_key
from lamella.operators import ordered as O
from lamella.operators.aggregates import exact
from lamella.operators.matching import nearest_band
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


def _sections(events: DataFrame) -> DataFrame:
    changed = F.col("event_type") != O.before("event_type", ["user_id"], ["ts", "event_id"])
    return O.islands(events.select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"], changed, "sec")


ISLANDS = """
st AS (SELECT user_id, event_type, value, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sec FROM st)
"""


@query(
    "w01_section_summary",
    f"""WITH {ISLANDS}, s AS (SELECT user_id, sec, count(*) AS len, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS z FROM isl GROUP BY ALL)
SELECT user_id, count(*) AS sections, CAST(sum(len) AS BIGINT) AS length,
       floor(CAST(sum(CAST(z * len AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(len) AS DOUBLE) * 1000 + 0.5) / 1000 AS z_weighted,
       CAST(sum(CASE WHEN abs(z - 50) > 5 THEN len ELSE 0 END) AS BIGINT) AS out_len FROM s GROUP BY user_id""",
)
def section_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = _sections(read(spark, d, "events")).groupBy("user_id", "sec").agg(F.count("*").alias("len"), (F.sum(exact(F.col("value"))).cast("double") / F.count("*")).alias("z"))
    mean = F.sum(exact(F.col("z") * F.col("len"))).cast("double") / F.sum("len").cast("double")
    return runs.groupBy("user_id").agg(
        F.count("*").alias("sections"), F.sum("len").alias("length"), half_up(mean, 3).alias("z_weighted"), F.sum(F.when(F.abs(F.col("z") - 50) > 5, F.col("len")).otherwise(0)).alias("out_len")
    )


@query(
    "w02_discontinuities",
    """WITH e AS (SELECT user_id, event_id, event_type, value > 250 AS high, lag(event_type) OVER w AS p, lag(value > 250) OVER w AS ph FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, 'type_change' AS kind FROM e WHERE p IS NOT NULL AND p <> event_type
UNION ALL SELECT user_id, event_id, 'rise' FROM e WHERE high AND NOT coalesce(ph, false)""",
)
def discontinuities(spark: SparkSession, d: str) -> DataFrame:
    order = (["user_id"], ["ts", "event_id"])
    e = read(spark, d, "events").select("user_id", "event_id", "ts", "event_type", (F.col("value") > 250).alias("high"))
    e = e.withColumn("p", O.before("event_type", *order)).withColumn("ph", O.before("high", *order))
    kinds = F.array_compact(
        F.array(F.when(F.col("p").isNotNull() & (F.col("p") != F.col("event_type")), F.lit("type_change")), F.when(F.col("high") & ~F.coalesce("ph", F.lit(False)), F.lit("rise")))
    )
    return e.select("user_id", "event_id", F.explode(kinds).alias("kind"))


@query(
    "w03_route_distance",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS s1 FROM lineitem)
SELECT l_orderkey, l_linenumber, s1 - l_quantity AS s0, s1 FROM s""",
)
def route_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return O.cumulative(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], F.col("l_quantity")).select("l_orderkey", "l_linenumber", "s0", "s1")


@query(
    "w04_gap_clusters",
    """WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
c AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch(o_orderdate) - epoch(p) > 30 * 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT o_custkey, CAST(cluster AS BIGINT) AS cluster, count(*) AS orders, CAST(epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS BIGINT) AS span FROM c GROUP BY ALL""",
)
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    found = O.gap_clusters(rows, ["o_custkey"], F.col("at"), ["at", "o_orderkey"], 30 * 86400)
    return found.groupBy("o_custkey", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("orders"), (F.max("at") - F.min("at")).alias("span"))


@query(
    "w05_interval_union",
    """WITH i AS (SELECT l_suppkey, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS lo, CAST(floor(epoch(l_shipdate) / 86400) + l_quantity AS BIGINT) AS hi FROM lineitem),
m AS (SELECT *, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi, count(*) AS intervals FROM n GROUP BY l_suppkey, k""",
)
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    rows = read(spark, d, "lineitem").select("l_suppkey", day.alias("lo"), (day + F.col("l_quantity")).cast("long").alias("hi"))
    return O.interval_union(rows, ["l_suppkey"], "lo", "hi")


@query(
    "w06_auto_name",
    """SELECT p_partkey, p_type, 'N' || row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, floor(p_retailprice * 1000 + 0.5) / 1000 DESC, p_partkey) AS name FROM part""",
)
def auto_name(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("p_type").orderBy(F.col("p_size").desc(), half_up(F.col("p_retailprice"), 3).desc(), "p_partkey")
    return read(spark, d, "part").select("p_partkey", "p_type", F.concat(F.lit("N"), F.row_number().over(order).cast("string")).alias("name"))


@query(
    "w08_stop_row",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS stop FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM s WHERE stop IS NULL OR l_linenumber < stop""",
)
def stop_row(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return O.until_first(rows, ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "R").drop("l_returnflag")


@query(
    "w09_variant_suffix",
    """WITH f AS (SELECT p_partkey, p_type, p_brand || '/' || p_size AS sig, min(p_partkey) OVER (PARTITION BY p_type, p_brand || '/' || p_size) AS first FROM part),
r AS (SELECT *, dense_rank() OVER (PARTITION BY p_type ORDER BY first) AS n FROM f)
SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || '#' || n END AS variant FROM r""",
)
def variant_suffix(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_type", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("sig"))
    return O.variants(rows, "p_type", "sig", "p_partkey").select("p_partkey", "variant")


@query(
    "w10_path_concat",
    """WITH u AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS pos, CAST(sum(l_quantity) AS DOUBLE) AS len FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_suppkey, len, coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY pos, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start" FROM u""",
)
def path_concat(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("at"), F.sum("l_quantity").alias("len"))
    rows = O.cumulative(units, ["l_orderkey"], ["at", "l_suppkey"], F.col("len"))
    return rows.select("l_orderkey", "l_suppkey", "len", F.col("s0").alias("start"))


@query(
    "w11_runner_up",
    """WITH c AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS dist FROM supplier JOIN customer ON s_nationkey = c_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY dist, c_custkey) AS n FROM c)
SELECT s_suppkey, max(CASE WHEN n = 1 THEN c_custkey END) AS nearest, max(CASE WHEN n = 1 THEN dist END) AS best, max(CASE WHEN n = 2 THEN dist END) AS second
FROM r WHERE n <= 2 GROUP BY s_suppkey""",
)
def runner_up(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    pairs = s.join(c, s.s_nationkey == c.c_nationkey).select("s_suppkey", "c_custkey", F.abs(F.col("s_acctbal") - F.col("c_acctbal")).alias("dist"))
    return O.runner_up(pairs, ["s_suppkey"], "dist", "c_custkey")


@query(
    "o01_natural",
    """WITH k AS (SELECT c_custkey, c_nationkey, c_name, regexp_replace(c_name, '\\d+', '', 'g') AS letters, TRY_CAST(substr(regexp_replace(c_name, '\\D+', '', 'g'), 1, 18) AS BIGINT) AS number FROM customer)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY letters, number NULLS FIRST, c_name, c_custkey) AS INTEGER) AS place FROM k""",
)
def natural(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy(natural_key(F.col("c_name")), "c_custkey")
    return read(spark, d, "customer").select("c_custkey", F.row_number().over(order).alias("place"))


@query(
    "o03_pick_board",
    """WITH e AS (SELECT l_suppkey, l_orderkey, l_quantity AS q, abs(l_quantity - 25) AS err FROM lineitem)
SELECT l_suppkey, coalesce(arg_min(l_orderkey, struct_pack(a := err, b := l_orderkey)) FILTER (err <= 2), arg_max(l_orderkey, struct_pack(a := q, b := -l_orderkey))) AS picked FROM e GROUP BY l_suppkey""",
)
def pick_board(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_quantity").alias("q"), F.abs(F.col("l_quantity") - 25).alias("err"))
    near = F.min(F.when(F.col("err") <= 2, F.struct("err", "l_orderkey")))["l_orderkey"]
    large = F.max(F.struct(F.col("q"), (-F.col("l_orderkey")).alias("k")))["k"]
    return rows.groupBy("l_suppkey").agg(F.coalesce(near, -large).alias("picked"))


@query(
    "o04_longest_first",
    """SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS length, CAST(row_number() OVER (ORDER BY l_suppkey = 7 DESC, sum(l_quantity) DESC, l_suppkey) AS INTEGER) AS place FROM lineitem GROUP BY l_suppkey QUALIFY place <= 50""",
)
def longest_first(spark: SparkSession, d: str) -> DataFrame:
    nets = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("length"))
    top = nets.orderBy((F.col("l_suppkey") == 7).desc(), F.col("length").desc(), "l_suppkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy((F.col("l_suppkey") == 7).desc(), F.col("length").desc(), "l_suppkey")))


@query(
    "o05_budget",
    """WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)
SELECT p_brand, count(*) FILTER (n <= 5) AS kept, count(*) FILTER (n > 5) AS "left", floor(CAST(sum(CAST(v AS DECIMAL(28,6))) FILTER (n > 5) AS DOUBLE) * 100 + 0.5) / 100 AS left_total, max(v) FILTER (n > 5) AS left_largest FROM r GROUP BY p_brand""",
)
def budget(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_brand", "p_partkey", exact(F.col("p_retailprice")).alias("v"))
    out = O.budgeted(rows, ["p_brand"], "v", ["p_partkey"], 5)
    return out.withColumn("left_total", half_up(F.col("left_total").cast("double"), 2)).withColumn("left_largest", F.col("left_largest").cast("double"))


@query(
    "o06_regions",
    """WITH r AS (SELECT l_partkey, count(*) AS pixels FROM lineitem GROUP BY l_partkey HAVING count(*) >= 3 ORDER BY pixels DESC, l_partkey LIMIT 100)
SELECT l_partkey, pixels, row_number() OVER (ORDER BY l_partkey) AS place FROM r""",
)
def regions(spark: SparkSession, d: str) -> DataFrame:
    top = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("pixels")).filter("pixels >= 3").orderBy(F.col("pixels").desc(), "l_partkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy("l_partkey")).cast("long"))


@query(
    "o07_worst_five",
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_quantity - 25) DESC, l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_suppkey, string_agg(l_orderkey || '.' || l_linenumber, ',' ORDER BY n) AS worst FROM r WHERE n <= 5 GROUP BY l_suppkey""",
)
def worst_five(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy(F.abs(F.col("l_quantity") - 25).desc(), "l_orderkey", "l_linenumber")
    five = read(spark, d, "lineitem").select("l_suppkey", F.concat_ws(".", "l_orderkey", "l_linenumber").alias("ref"), F.row_number().over(order).alias("n")).filter("n <= 5")
    return five.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ref"))), lambda x: x["ref"]), ",").alias("worst"))


@query(
    "o08_fuzzy",
    """SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'an' THEN 0 WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])an([^a-z0-9]|$)') THEN 1 WHEN starts_with(lower(p_name), 'an') THEN 2 WHEN contains(lower(p_name), 'an') THEN 3 ELSE 9 END AS score
FROM part WHERE contains(lower(p_name), 'an') ORDER BY score, length(p_name), p_name, p_partkey LIMIT 12""",
)
def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_name", fuzzy_score(F.col("p_name"), "an").alias("score")).filter("score <= 3")
    return rows.orderBy("score", F.length("p_name"), "p_name", "p_partkey").limit(12)


@query(
    "o09_hit_rank",
    """WITH c AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS dist, c_acctbal AS area FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 2000)
SELECT s_suppkey, c_custkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY dist, area, c_custkey) AS INTEGER) AS place FROM c QUALIFY place <= 3""",
)
def hit_rank(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    hits = nearest_band(s, c, ("s_nationkey", "c_nationkey"), "s_acctbal", "c_acctbal", ("s_suppkey", "c_custkey"), 2000.0, 3)
    order = Window.partitionBy("s_suppkey").orderBy("distance", "c_acctbal", "c_custkey")
    return hits.select("s_suppkey", "c_custkey", F.row_number().over(order).alias("place")).filter("place <= 3")


@query(
    "e01_distinct_first",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_linenumber, l_orderkey, l_partkey) = 1""",
)
def distinct_first(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return O.first_wins(rows, [F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey")], ["l_linenumber", "l_orderkey", "l_partkey"])


@query(
    "e02_cross_file",
    """SELECT l_partkey, l_suppkey, l_linenumber, count(*) AS n FROM (SELECT * FROM lineitem QUALIFY l_linenumber = min(l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey)) GROUP BY ALL""",
)
def cross_file(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    return O.cross_file_distinct(rows, ["l_partkey", "l_suppkey"], "l_linenumber").groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(
    "e03_cutouts",
    """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem a WHERE l_quantity < 49 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND floor(b.l_quantity / 10) = floor(a.l_quantity / 10))""",
)
def cutouts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", F.floor(F.col("l_quantity") / 10).alias("loop"))
    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey", "loop"))
    return rows.withColumn("first", first).filter((F.col("l_linenumber") == F.col("first")) & (F.col("l_quantity") < 49)).select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "e04_multiset",
    """SELECT l_partkey, l_quantity, 'removed' AS verdict, count(*) AS n FROM (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 1 EXCEPT ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY ALL
UNION ALL SELECT l_partkey, l_quantity, 'unchanged', count(*) FROM (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 1 INTERSECT ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY ALL""",
)
def multiset(spark: SparkSession, d: str) -> DataFrame:
    from lamella.operators.joins import multiset_diff

    rows = read(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_linenumber")
    diff = multiset_diff(rows.filter("l_linenumber % 2 = 1"), rows.filter("l_linenumber % 2 = 0"), ["l_partkey", "l_quantity"])
    return diff.select("l_partkey", "l_quantity", F.expr("stack(2, 'removed', removed, 'unchanged', unchanged) AS (verdict, n)")).filter("n > 0")


@query(
    "e05_outline_equal",
    """SELECT a.vec_id, CAST(len(list_filter(list_zip(a.embedding, b.embedding), lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) > 0.2)) = 0 AS BOOLEAN) AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def outline_equal(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    apart = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")) > 0.2)
    return e.join(b, "vec_id").select("vec_id", (~F.exists(apart, lambda x: x)).alias("same"))


@query(
    "e06_mask_dilation",
    """WITH p AS (SELECT DISTINCT CAST(floor(l_extendedprice / 50) AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS y FROM lineitem), o AS (SELECT unnest([-1, 0, 1]) AS k)
SELECT DISTINCT CAST(x + a.k AS BIGINT) AS x, CAST(y + b.k AS BIGINT) AS y FROM p, o a, o b""",
)
def mask_dilation(spark: SparkSession, d: str) -> DataFrame:
    pixels = read(spark, d, "lineitem").select(F.floor(F.col("l_extendedprice") / 50).alias("x"), F.col("l_quantity").cast("long").alias("y")).distinct()
    near = F.expr("flatten(transform(array(-1L, 0L, 1L), i -> transform(array(-1L, 0L, 1L), j -> struct(x + i as x, y + j as y))))")
    return pixels.select(F.explode(near).alias("c")).select("c.x", "c.y").distinct()


@query(
    "e07_net_union",
    """SELECT name, CAST(min(seq) AS BIGINT) AS seq FROM (SELECT n_name AS name, n_nationkey AS seq FROM nation UNION ALL SELECT r_name, 100 + r_regionkey FROM region UNION ALL SELECT '', -1) GROUP BY name""",
)
def net_union(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("seq"))
    b = read(spark, d, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).cast("long").alias("seq"))
    empty = spark.range(1).select(F.lit("").alias("name"), F.lit(-1).cast("long").alias("seq"))
    return a.unionByName(b).unionByName(empty).groupBy("name").agg(F.min("seq").alias("seq"))
