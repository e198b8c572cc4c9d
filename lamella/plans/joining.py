"""Queries of the joining, set, graph and rule operators over the shared tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions.text import key_um
from lamella.operators import graph as G
from lamella.operators import joins as J
from lamella.operators import ordered as O
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
    "j01_bom_left",
    """WITH b AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS populate, min(l_shipdate) AS first, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS parts FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(populate, true) AS populate, coalesce(parts, '') AS parts, l_orderkey IS NULL AS unplaced FROM orders LEFT JOIN b ON o_orderkey = l_orderkey""",
)
def bom_left(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    b = lines.groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("populate"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("parts"))
    o = read(spark, d, "orders").select("o_orderkey").join(b, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("populate", F.lit(True)).alias("populate"), F.coalesce("parts", F.lit("")).alias("parts"), F.col("l_orderkey").isNull().alias("unplaced"))


@query(
    "j02_last_wins",
    """SELECT user_id, event_type, event_id, value, count(*) OVER (PARTITION BY user_id, event_type) AS listings FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return O.last_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "j03_class_assign",
    """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), '^.*steel$') THEN 'ferrous' WHEN regexp_matches(lower(p_type), '^(promo|economy).*$') THEN 'cheap' WHEN regexp_matches(lower(p_type), '^s.*$') THEN 's' WHEN regexp_matches(lower(p_type), '^.*(tin|nickel)$') THEN 'soft' ELSE 'Default' END AS class FROM part""",
)
def class_assign(spark: SparkSession, d: str) -> DataFrame:
    rules = [("soft", "*{TIN,NICKEL}", None), ("s", "S*", 9), ("ferrous", "*STEEL", 1), ("cheap", "re:(promo|economy).*", 2), ("broken", "re:(", 0)]
    return J.pattern_assign(read(spark, d, "part").select("p_partkey", "p_type"), "p_type", rules).select("p_partkey", "class")


@query(
    "j04_pair_capture",
    """WITH a AS (SELECT p_name AS positive, regexp_extract(p_brand, '^Brand#(\\d)\\d$', 1) || '/' || p_size AS key FROM part WHERE p_partkey % 2 = 0), b AS (SELECT regexp_extract(p_brand, '^Brand#(\\d)\\d$', 1) || '/' || p_size AS key, min(p_name) AS negative FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT positive, negative, key FROM a JOIN b USING (key)""",
)
def pair_capture(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").withColumn("net", F.concat_ws("/", F.regexp_extract("p_brand", r"^Brand#(\d)\d$", 1), F.col("p_size").cast("string")))
    a = part.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("positive"), F.col("net").alias("key"))
    b = part.filter("p_partkey % 2 = 1").groupBy(F.col("net").alias("key")).agg(F.min("p_name").alias("negative"))
    return a.join(b, "key").select("positive", "negative", "key")


@query(
    "j05_pair_suffix",
    """WITH n AS (SELECT DISTINCT replace(p_type, ' ', '') || CASE WHEN p_size % 3 = 0 THEN '_P' ELSE '_N' END AS name FROM part)
SELECT a.name AS positive, b.name AS negative, left(a.name, length(a.name) - 2) AS stem FROM n a JOIN n b ON ends_with(a.name, '_P') AND ends_with(b.name, '_N') AND left(a.name, length(a.name) - 2) = left(b.name, length(b.name) - 2)""",
)
def pair_suffix(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").select(F.concat(F.regexp_replace("p_type", " ", ""), F.when(F.col("p_size") % 3 == 0, "_P").otherwise("_N")).alias("name"))
    return J.suffix_pairs(names, "name", "_P", "_N")


@query(
    "j06_back_fill",
    """WITH o AS (SELECT l_orderkey, l_suppkey, min(l_returnflag) AS ref FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(CASE WHEN l.l_returnflag <> 'N' THEN l.l_returnflag END, o.ref) AS ref FROM lineitem l LEFT JOIN o ON o.l_orderkey = l.l_orderkey AND o.l_suppkey = l.l_suppkey""",
)
def back_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_returnflag")
    outer = rows.filter("l_linenumber = 1").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_returnflag").alias("ref"))
    own = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return rows.join(outer, ["l_orderkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(own, F.col("ref")).alias("ref"))


@query(
    "j07_rounded_equi",
    """SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND CAST(floor(s_acctbal / 100000 * 1000 + 0.5) AS BIGINT) = CAST(floor(c_acctbal / 100000 * 1000 + 0.5) AS BIGINT)""",
)
def rounded_equi(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", key_um(F.col("s_acctbal") / 100000).alias("sk"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", key_um(F.col("c_acctbal") / 100000).alias("ck"))
    return s.join(c, (s.s_nationkey == c.c_nationkey) & (s.sk == c.ck)).select("s_suppkey", "c_custkey")


GRID = """WITH s AS (SELECT s_suppkey, s_acctbal AS x, s_nationkey * 100.0::DOUBLE AS y FROM supplier), c AS (SELECT c_custkey, c_acctbal AS u, c_nationkey * 100.0::DOUBLE AS v FROM customer),
p AS (SELECT s_suppkey, c_custkey, sqrt(pow(x - u, 2) + pow(y - v, 2)) AS distance FROM s, c WHERE sqrt(pow(x - u, 2) + pow(y - v, 2)) <= 150) """


def _near(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    c = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("u"), (F.col("c_nationkey") * 100.0).alias("v"))
    return J.grid_join(s, c, ("x", "y"), ("u", "v"), 150.0)


@query("j08_grid_join", GRID + "SELECT s_suppkey, c_custkey, floor(distance * 1000 + 0.5) / 1000 AS distance FROM p")
def grid_join(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("s_suppkey", "c_custkey", (F.floor(F.col("distance") * 1000 + 0.5) / 1000).alias("distance"))


@query("j13_nearest", GRID + "SELECT s_suppkey, arg_min(c_custkey, struct_pack(a := distance, b := c_custkey)) AS c_custkey FROM p GROUP BY 1")
def nearest(spark: SparkSession, d: str) -> DataFrame:
    return J.nearest(_near(spark, d), ["s_suppkey"], "distance", "c_custkey").select("s_suppkey", "c_custkey")


@query("j26_feature_pin", GRID + "SELECT s_suppkey, count(*) AS features FROM (SELECT c_custkey, arg_min(s_suppkey, struct_pack(a := distance, b := s_suppkey)) AS s_suppkey FROM p GROUP BY 1) GROUP BY 1")
def feature_pin(spark: SparkSession, d: str) -> DataFrame:
    return J.nearest(_near(spark, d), ["c_custkey"], "distance", "s_suppkey").groupBy("s_suppkey").agg(F.count("*").alias("features"))


@query(
    "j09_touching",
    GRID + ", hit AS (SELECT DISTINCT s_suppkey FROM p WHERE distance <= 60) SELECT s_suppkey, s_suppkey IN (SELECT s_suppkey FROM hit) AS touches, s_suppkey IN (SELECT s_suppkey FROM p) AS retried FROM supplier",
)
def touching(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d).groupBy("s_suppkey").agg(F.min("distance").alias("least"))
    return read(spark, d, "supplier").select("s_suppkey").join(near, "s_suppkey", "left").select(
        "s_suppkey", F.coalesce(F.col("least") <= 60, F.lit(False)).alias("touches"), F.col("least").isNotNull().alias("retried")
    )


@query(
    "j10_overlap_join",
    """WITH i AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS seq, epoch(l_shipdate) / 86400 AS lo, epoch(l_shipdate) / 86400 + l_quantity AS hi FROM lineitem),
p AS (SELECT a.l_suppkey, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS o FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.seq < b.seq AND least(a.hi, b.hi) > greatest(a.lo, b.lo))
SELECT l_suppkey, count(*) AS pairs, CAST(sum(o) AS DOUBLE) AS overlap FROM p GROUP BY 1""",
)
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    day = (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400).alias("lo")
    rows = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), day, "l_quantity")
    rows = rows.withColumn("hi", F.col("lo") + F.col("l_quantity")).drop("l_quantity")
    return J.overlap_join(rows, rows, ["l_suppkey"], "lo", "hi", "seq", 50.0).groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("overlap"))


@query(
    "j14_similar",
    """WITH m AS (SELECT l_suppkey, l_tax AS w0, min(l_extendedprice) AS e FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey AND m.w0 = l.l_tax AND abs(l.l_extendedprice - m.e) <= greatest(1, 0.5 * m.e)""",
)
def similar(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_extendedprice")
    model = rows.filter("l_linenumber = 1").groupBy("l_suppkey", "l_tax").agg(F.min("l_extendedprice").alias("e"))
    return rows.join(model, ["l_suppkey", "l_tax"]).filter(F.abs(F.col("l_extendedprice") - F.col("e")) <= F.greatest(F.lit(1.0), F.col("e") * 0.5)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "j16_theta_semi",
    """WITH z AS (SELECT user_id, min(ts) AS lo, min(ts) + INTERVAL 6 HOUR AS hi FROM events WHERE event_type = 'click' OR event_type = 'view' GROUP BY 1),
h AS (SELECT z.user_id, arg_min(e.event_id, struct_pack(a := e.ts, b := e.event_id)) AS hit FROM z JOIN events e ON e.user_id <> z.user_id AND e.ts >= z.lo AND e.ts < z.hi GROUP BY 1)
SELECT z.user_id, h.hit, h.hit IS NOT NULL AS stale FROM z LEFT JOIN h USING (user_id)""",
)
def theta_semi(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    cell = 6 * 3600 * 1_000_000
    z = e.filter(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(F.min("at").alias("lo"))
    z = z.withColumn("hi", F.col("lo") + cell)
    seen = e.filter("user_id IS NOT NULL AND event_id IS NOT NULL AND at IS NOT NULL").groupBy("user_id", "at").agg(F.min("event_id").alias("event_id"))
    c = F.floor(F.col("lo") / cell)
    zones = z.filter("user_id IS NOT NULL").select("user_id", "lo", F.explode(F.array(c, c + 1)).alias("c"))
    marks = zones.select("user_id", "c", F.greatest("lo", F.col("c") * cell).alias("at"))
    hits = J.next_other(seen.withColumn("c", F.floor(F.col("at") / cell)), marks, "c", "user_id", "at", "event_id")
    hits = hits.groupBy("user_id").agg(F.min(F.struct("at", "event_id")).alias("h")).join(z, "user_id").filter(F.col("h.at") < F.col("hi")).select("user_id", F.col("h.event_id").alias("hit"))
    return z.join(hits, "user_id", "left").select("user_id", "hit", F.col("hit").isNotNull().alias("stale"))


@query(
    "j17_unused_rings",
    """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 30) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.06)""",
)
def unused_rings(spark: SparkSession, d: str) -> DataFrame:
    used = read(spark, d, "lineitem").filter("l_quantity >= 30 OR l_tax > 0.06").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(used, "o_orderkey", "left_anti")


@query(
    "j20_frame_offset",
    """WITH c(ord, cx, cy) AS (VALUES (0, 0, 0), (1, 2000, 0), (2, 0, 500), (3, 2000, 500)),
s AS (SELECT c_nationkey, ord, avg(CASE WHEN c_acctbal - cx BETWEEN -1000 AND 9000 AND c_custkey - cy >= 0 THEN 1.0 ELSE 0.0 END) AS share FROM customer, c GROUP BY ALL)
SELECT c_nationkey, min(ord) FILTER (share >= 0.3) AS corner FROM s GROUP BY 1""",
)
def frame_offset(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_nationkey", "c_acctbal", "c_custkey")
    corners = [(0, 0, 0), (1, 2000, 0), (2, 0, 500), (3, 2000, 500)]
    inside = [F.avg(F.when((F.col("c_acctbal") - cx).between(-1000, 9000) & (F.col("c_custkey") - cy >= 0), 1.0).otherwise(0.0)).alias(f"s{o}") for o, cx, cy in corners]
    first = F.coalesce(*[F.when(F.col(f"s{o}") >= 0.3, o) for o, _, _ in corners])
    return rows.groupBy("c_nationkey").agg(*inside).select("c_nationkey", first.alias("corner"))


@query(
    "j21_partition_agreement",
    """WITH r AS (SELECT DISTINCT source AS t, quality AS f FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT f, count(*) AS n FROM r WHERE f IS NOT NULL GROUP BY 1),
p AS (SELECT t AS source, count(r.f) AS parts, CAST(coalesce(max(n), 0) AS BIGINT) AS shared FROM r LEFT JOIN s USING (f) GROUP BY 1)
SELECT *, CASE WHEN parts = 0 THEN 'missing' WHEN parts > 1 THEN 'split' WHEN shared > 1 THEN 'merged' ELSE 'matched' END AS verdict FROM p""",
)
def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return J.partition_agreement(rows, "source", "quality")


@query(
    "j22_multiset_diff",
    """WITH b AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL), h AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL)
SELECT l_partkey, l_quantity, greatest(coalesce(h.n, 0) - coalesce(b.n, 0), 0) AS added, greatest(coalesce(b.n, 0) - coalesce(h.n, 0), 0) AS removed, least(coalesce(b.n, 0), coalesce(h.n, 0)) AS unchanged FROM b FULL JOIN h USING (l_partkey, l_quantity)""",
)
def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_linenumber")
    return J.multiset_diff(rows.filter("l_linenumber % 2 = 1"), rows.filter("l_linenumber % 2 = 0"), ["l_partkey", "l_quantity"])


@query(
    "j23_pad_diff",
    """WITH a AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL HAVING count(*) = 1), b AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, CASE WHEN b.q IS NULL THEN 'only_a' WHEN a.q IS NULL THEN 'only_b' WHEN abs(a.q - b.q) > 0.001 THEN 'changed' ELSE 'same' END AS verdict FROM a FULL JOIN b USING (l_orderkey, l_linenumber)""",
)
def pad_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    one = lambda flag, c: rows.filter(F.col("l_returnflag") != flag).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias(c), F.count("*").alias("n")).filter("n = 1").drop("n")
    both = one("A", "a").join(one("R", "b"), ["l_orderkey", "l_linenumber"], "full_outer")
    verdict = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.abs(F.col("a") - F.col("b")) > 0.001, "changed").otherwise("same")
    return both.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query(
    "j24_bridges",
    """WITH p AS (SELECT DISTINCT l_orderkey AS p, l_suppkey AS u FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS p FROM lineitem WHERE l_tax > 0.07)
SELECT a.u AS unit_a, b.u AS unit_b, count(*) AS parts FROM p a JOIN p b ON a.p = b.p AND a.u < b.u WHERE a.p NOT IN (SELECT p FROM f) GROUP BY ALL""",
)
def bridges(spark: SparkSession, d: str) -> DataFrame:
    return J.bridges(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_tax") > 0.07)


@query(
    "j28_part_frame",
    """SELECT s_suppkey, c_custkey, floor((c_acctbal - s_acctbal) * cos(radians(30)) * 1000 + 0.5) / 1000 AS x FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(c_acctbal - s_acctbal) <= 300""",
)
def part_frame(spark: SparkSession, d: str) -> DataFrame:
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    off = F.col("c_acctbal") - F.col("s_acctbal")
    rows = J.band_join(s, c, ("s_nationkey", "c_nationkey"), "s_acctbal", "c_acctbal", 300.0)
    return rows.select("s_suppkey", "c_custkey", (F.floor(off * F.cos(F.radians(F.lit(30.0))) * 1000 + 0.5) / 1000).alias("x"))


@query(
    "j29_lookup_chain",
    """SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 10 = 0 THEN 'OVERRIDE' END, r_name, 'none') AS target FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = read(spark, d, "supplier"), read(spark, d, "nation"), read(spark, d, "region")
    rows = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return rows.select("s_suppkey", F.coalesce(F.when(F.col("s_suppkey") % 10 == 0, "OVERRIDE"), F.col("r_name"), F.lit("none")).alias("target"))


@query(
    "j31_file_roles",
    """WITH f AS (SELECT o_orderkey, o_custkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'top' WHEN '2' THEN 'bottom' WHEN '5' THEN 'outline' ELSE 'inner' END AS role, CASE WHEN left(o_orderpriority, 1) IN ('3', '4') THEN CAST(left(o_orderpriority, 1) AS INTEGER) ELSE 0 END AS idx FROM orders),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_custkey, role, idx ORDER BY o_orderkey) = 1 THEN role ELSE 'other' END AS slot FROM f)
SELECT o_orderkey, slot, CAST(CASE WHEN slot = 'inner' THEN row_number() OVER (PARTITION BY o_custkey, slot ORDER BY idx, o_orderkey) END AS INTEGER) AS place FROM s""",
)
def file_roles(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring("o_orderpriority", 1, 1)
    role = F.when(head == "1", "top").when(head == "2", "bottom").when(head == "5", "outline").otherwise("inner")
    files = read(spark, d, "orders").select("o_orderkey", "o_custkey", role.alias("role"), F.when(head.isin("3", "4"), head.cast("int")).otherwise(0).alias("idx"))
    return J.by_role(files, "o_custkey", "role", "idx", "o_orderkey").select("o_orderkey", "slot", "place")


@query(
    "g01_components",
    """WITH RECURSIVE c AS (SELECT c_custkey AS a, 1000000000 + c_nationkey * 100000 + CAST(floor(c_acctbal / 100) AS BIGINT) AS b, 2000000000 + c_nationkey * 100000 + CAST(floor((c_acctbal + 50) / 100) AS BIGINT) AS c FROM customer),
e AS MATERIALIZED (SELECT a, b FROM c UNION SELECT a, c FROM c UNION SELECT b, a FROM c UNION SELECT c, a FROM c),
w AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a)
SELECT node, min(seen) AS component FROM w GROUP BY 1""",
)
def components(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    cell = lambda first, off: first + F.col("c_nationkey") * 100000 + F.floor((F.col("c_acctbal") + off) / 100)
    near = F.explode(F.array(cell(1_000_000_000, 0), cell(2_000_000_000, 50))).alias("b")  # customers that share a cell of either grid
    return G.components(c.select(F.col("c_custkey").alias("a"), near))


@query(
    "g05_regions",
    """WITH RECURSIVE p AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS x, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS y FROM lineitem),
e AS MATERIALIZED (SELECT p.x * 1000 + p.y AS a, q.x * 1000 + q.y AS b FROM p, (VALUES (-1), (0), (1)) AS i(i), (VALUES (-1), (0), (1)) AS j(j), p q WHERE q.x = p.x + i AND q.y = p.y + j),
w(node, label) USING KEY (node) AS (SELECT x * 1000 + y, x * 1000 + y FROM p UNION SELECT n.node, min(w.label) FROM w JOIN e ON e.a = w.node JOIN recurring.w AS n ON n.node = e.b WHERE w.label < n.label GROUP BY n.node)
SELECT label AS component, count(*) AS pixels FROM w GROUP BY 1""",
)
def flood_regions(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("x"), F.floor(F.col("l_extendedprice") / 1000).alias("y")).distinct()
    return G.labelled(p, "x", "y", 1000).groupBy("component").agg(F.count("*").alias("pixels"))


@query(
    "g07_reach",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey * l_linenumber % 97 AS b FROM lineitem), r AS (SELECT 1 AS node UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT CAST(node AS BIGINT) AS node FROM r""",
)
def reach(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") * F.col("l_linenumber") % 97).alias("b"))
    return G.reachable(edges, spark.range(1).select(F.lit(1).cast("long").alias("node")))


@query(
    "g06_nesting",
    """WITH b AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + s_suppkey * 37 % 4000 + 1 AS hi FROM supplier),
p AS (SELECT a.s_suppkey, count(b.s_suppkey) AS depth, arg_min(b.s_suppkey, struct_pack(a := b.hi - b.lo, b := b.s_suppkey)) AS parent FROM b a LEFT JOIN b ON b.s_suppkey <> a.s_suppkey AND b.lo < a.lo AND b.hi > a.hi GROUP BY 1) SELECT * FROM p""",
)
def nesting(spark: SparkSession, d: str) -> DataFrame:
    hi = F.col("s_acctbal") + F.col("s_suppkey") * 37 % 4000 + 1
    return G.nested(read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), hi.alias("hi")), "s_suppkey", "lo", "hi", 1000.0)


@query(
    "v02_rules",
    """SELECT 'fk_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unique_line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'range_discount', count(*) FROM lineitem WHERE l_discount < 0.01 UNION ALL SELECT 'fk_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def rules(spark: SparkSession, d: str) -> DataFrame:
    l, o, c = read(spark, d, "lineitem"), read(spark, d, "orders"), read(spark, d, "customer")
    count = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return (
        count("fk_order", J.foreign_keys(l, "l_orderkey", o, "o_orderkey"))
        .unionByName(count("unique_line", l.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")))
        .unionByName(count("range_discount", l.filter("l_discount < 0.01")))
        .unionByName(count("fk_customer", J.foreign_keys(o, "o_custkey", c, "c_custkey")))
    )


@query(
    "u05_overrides",
    """WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 3 THEN 'cpw' END AS structure, CASE WHEN s_suppkey % 5 = 1 THEN s_nationkey END AS ref FROM supplier)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(o.structure, 'microstrip') AS structure, coalesce(o.ref, l_suppkey) AS ref FROM lineitem LEFT JOIN o ON s_suppkey = l_suppkey""",
)
def overrides(spark: SparkSession, d: str) -> DataFrame:
    given = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 7 == 3, "cpw").alias("structure"), F.when(F.col("s_suppkey") % 5 == 1, F.col("s_nationkey")).cast("long").alias("ref"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("microstrip").alias("structure"), F.col("l_suppkey").cast("long").alias("ref"))
    return J.overridden(rows, given, ["l_suppkey"], ["structure", "ref"]).drop("l_suppkey")


@query(
    "j15_parallel_partner",
    """WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), t AS (SELECT l_suppkey, count(*) AS total FROM p GROUP BY 1),
c AS (SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS n FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL)
SELECT l_suppkey, arg_max(other, struct_pack(a := n, b := -other)) AS partner, max(n) AS shared FROM c JOIN t USING (l_suppkey) WHERE n >= 0.02 * total GROUP BY 1""",
)
def parallel_partner(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    total = p.groupBy("l_suppkey").agg(F.count("*").alias("total"))
    both = p.join(p.select("l_orderkey", F.col("l_suppkey").alias("other")), "l_orderkey").filter("l_suppkey <> other")
    shared = both.groupBy("l_suppkey", "other").agg(F.count("*").alias("n")).join(total, "l_suppkey").filter(F.col("n") >= 0.02 * F.col("total"))
    best = F.max(F.struct(F.col("n"), (-F.col("other")).alias("o")))
    return shared.groupBy("l_suppkey").agg((-best["o"]).alias("partner"), best["n"].alias("shared"))


@query(
    "j19_vote",
    """WITH p AS (SELECT s_nationkey, CAST(floor((s_acctbal - c_acctbal) / 250) AS BIGINT) AS bin FROM supplier JOIN customer ON s_nationkey = c_nationkey),
v AS (SELECT s_nationkey, bin, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, bin) AS k FROM v)
SELECT s_nationkey, max(CASE WHEN k = 1 THEN bin END) AS bin, max(CASE WHEN k = 1 THEN n END) AS votes, coalesce(max(CASE WHEN k = 2 THEN n END), 0) <= 0.6 * max(CASE WHEN k = 1 THEN n END) AS clear FROM r WHERE k <= 2 GROUP BY 1""",
)
def vote(spark: SparkSession, d: str) -> DataFrame:
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    bins = s.join(c, s.s_nationkey == c.c_nationkey).groupBy("s_nationkey", F.floor((F.col("s_acctbal") - F.col("c_acctbal")) / 250).alias("bin")).agg(F.count("*").alias("n"))
    top = bins.withColumn("k", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("n").desc(), "bin"))).filter("k <= 2")
    first, second = F.max(F.when(F.col("k") == 1, F.col("n"))), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("n"))), F.lit(0))
    return top.groupBy("s_nationkey").agg(F.max(F.when(F.col("k") == 1, F.col("bin"))).alias("bin"), first.alias("votes"), (second <= first * 0.6).alias("clear"))


@query(
    "j27_slot_pad",
    """WITH m AS (SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND CAST(floor(s_acctbal / 100) AS BIGINT) = CAST(floor(c_acctbal / 100) AS BIGINT) AND abs(s_acctbal - c_acctbal) < 50)
SELECT s_suppkey, min(c_custkey) AS slot FROM m GROUP BY 1""",
)
def slot_pad(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.floor(F.col("s_acctbal") / 100).alias("sk"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.floor(F.col("c_acctbal") / 100).alias("ck"))
    near = s.join(c, (s.s_nationkey == c.c_nationkey) & (s.sk == c.ck)).filter(F.abs(F.col("s_acctbal") - F.col("c_acctbal")) < 50)
    return near.groupBy("s_suppkey").agg(F.min("c_custkey").alias("slot"))


@query(
    "j30_near_slice",
    """SELECT s_suppkey, count(*) AS n, min(c_acctbal - s_acctbal) AS lo, max(c_acctbal - s_acctbal) AS hi FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE abs(c_acctbal - s_acctbal) <= 800 GROUP BY 1""",
)
def near_slice(spark: SparkSession, d: str) -> DataFrame:
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    off = F.col("c_acctbal") - F.col("s_acctbal")
    rows = J.band_join(s, c, ("s_nationkey", "c_nationkey"), "s_acctbal", "c_acctbal", 800.0)
    return rows.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min(off).alias("lo"), F.max(off).alias("hi"))


@query(
    "v03_span_rules",
    """SELECT 'span' AS rule, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber > l_quantity UNION ALL SELECT 'layer', l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""",
)
def span_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    broken = F.array_compact(F.array(F.when(F.col("l_linenumber") > F.col("l_quantity"), F.lit("span")), F.when(~F.col("l_returnflag").isin("A", "N"), F.lit("layer"))))
    return rows.select(F.explode(broken).alias("rule"), "l_orderkey", "l_linenumber", "l_partkey")


@query(
    "v04_impedance_rules",
    """WITH c AS (SELECT p_partkey, p_name AS class, p_size - 25 AS target, p_retailprice / 20 AS tolerance, 'L' || p_size % 6 AS layer FROM part)
SELECT 'unique_class' AS rule, p_partkey FROM c WHERE class IN (SELECT class FROM c GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'target_positive', p_partkey FROM c WHERE target <= 0
UNION ALL SELECT 'tolerance_range', p_partkey FROM c WHERE tolerance < 0 OR tolerance > 75 UNION ALL SELECT 'fk_layer', p_partkey FROM c WHERE layer NOT IN ('L1', 'L2', 'L3', 'L4')""",
)
def impedance_rules(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("class"), (F.col("p_size") - 25).alias("target"), (F.col("p_retailprice") / 20).alias("tolerance"), F.concat(F.lit("L"), (F.col("p_size") % 6).cast("string")).alias("layer"))
    layers = spark.range(1, 5).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("name"))
    return J.impedance_violations(c, "p_partkey", layers, "name", 75.0)


@query("s33_json_sink", """SELECT to_json({'p_partkey': p_partkey, 'p_brand': p_brand, 'p_size': CASE WHEN p_size > 25 THEN p_size END}) AS value FROM part""")
def json_sink(spark: SparkSession, d: str) -> DataFrame:
    from lamella.sources.sinks import documents

    return documents(read(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size")))


@query(
    "s34_placement_sink",
    """SELECT p_brand, 'Ref,Val,Package,PosX,PosY,Rot,Side' || chr(10) || string_agg('"' || p_partkey || '","' || p_type || '","",' || printf('%.6f', p_retailprice) || ',' || printf('%.6f', p_size / 2.0::DOUBLE) || ',0.000000,top', chr(10) ORDER BY CAST(p_partkey AS VARCHAR)) || chr(10) AS value FROM part GROUP BY 1""",
)
def placement_sink(spark: SparkSession, d: str) -> DataFrame:
    from lamella.sources.sinks import placement_csv

    part = read(spark, d, "part")
    rows = part.select(
        "p_brand", F.col("p_partkey").cast("string").alias("ref"), F.col("p_type").alias("value"), F.lit("").alias("footprint"), F.col("p_retailprice").alias("x"),
        (F.col("p_size") / 2.0).alias("y"), F.lit(0.0).alias("rotation"), F.lit("top").alias("side"),
    )
    return placement_csv(rows, ["p_brand"])


@query("s38_store_misses", "SELECT DISTINCT sha256(p_brand || p_type) AS key FROM part WHERE p_size > 25 AND sha256(p_brand || p_type) NOT IN (SELECT sha256(p_brand || p_type) FROM part WHERE p_size <= 25)")
def store_misses(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(F.sha2(F.concat("p_brand", "p_type"), 256).alias("key"), "p_size")
    return part.filter("p_size > 25").select("key").distinct().join(part.filter("p_size <= 25").select("key"), "key", "left_anti")
