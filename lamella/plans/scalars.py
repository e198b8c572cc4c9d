"""Queries of the scalar functions, predicates, geometry and line formulas over the shared tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import geometry as G
from lamella.functions import lines as L
from lamella.functions import text as X
from lamella.operators import joins as J
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


# -- text -------------------------------------------------------------------------------------------------------------


@query("f01_glob", "SELECT p_partkey, regexp_matches(lower(p_type), '^(standard|promo).*(tin|copper)$') AS hit, regexp_matches(lower(p_brand), '^brand#[1-3].$') AS branded FROM part")
def glob(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", X.matches(F.col("p_type"), "{standard,promo}*{tin,copper}").alias("hit"), X.matches(F.col("p_brand"), "brand#[1-3]?").alias("branded"))


@query("f02_sensitive", "SELECT p_partkey, regexp_matches(p_type, '^PROMO.*$') OR p_type = 'x' AS hit FROM part")
def sensitive(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", (X.matches(F.col("p_type"), "PROMO*", True) | X.matches(F.col("p_type"), "re:x", True)).alias("hit"))


HEADS = """WITH h AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Designator,Qty,MPN' WHEN 1 THEN 'Ref;Mid X;Mid Y;Rotation' WHEN 2 THEN 'RefDes' || chr(9) || 'Value' || chr(9) || 'PosX' || chr(9) || 'PosY' WHEN 3 THEN 'Name,X,Y' ELSE p_name END AS head FROM part),
n AS (SELECT p_partkey, list_transform(regexp_split_to_array(head, '[,;\\t]'), lambda x: trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', ' ', 'g'))) AS names FROM h) """


@query(
    "f03_looks_like",
    HEADS + """SELECT p_partkey, list_has_any(names, ['designator', 'designators', 'reference', 'references', 'refdes', 'ref']) AND list_has_any(names, ['value', 'val', 'comment', 'footprint', 'package', 'mpn', 'manufacturer part number', 'part number', 'quantity', 'qty']) AS bill,
list_has_any(names, ['designator', 'designators', 'reference', 'references', 'refdes', 'ref']) AND len(list_filter(names, lambda n: n IN ('x', 'posx', 'pos x', 'mid x', 'midx', 'center x', 'location x'))) > 0 AND len(list_filter(names, lambda n: n IN ('y', 'posy', 'pos y', 'mid y', 'midy', 'center y', 'location y'))) > 0 AS placements FROM n""",
)
def looks_like(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_size") % 5
    head = F.when(kind == 0, "Designator,Qty,MPN").when(kind == 1, "Ref;Mid X;Mid Y;Rotation").when(kind == 2, "RefDes\tValue\tPosX\tPosY").when(kind == 3, "Name,X,Y").otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", X.looks_like_bill(head).alias("bill"), X.looks_like_placements(head).alias("placements"))


@query(
    "f04_storable",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN CAST('nan' AS DOUBLE) ELSE l_extendedprice * l_quantity / 7 END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT isnan(v) AND abs(v) < 100000 THEN floor(v * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE END AS stored, isnan(v) OR abs(v) >= 100000 AS skipped FROM v""",
)
def storable(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") * F.col("l_quantity") / 7)
    stored = X.storable(v, 100_000.0)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", stored.alias("stored"), stored.isNull().alias("skipped"))


@query(
    "f05_placeholder",
    """WITH z AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING min(l_discount) <= 0.03)
SELECT l_orderkey, count(*) FILTER (z.l_suppkey IS NULL) AS hits, count(*) FILTER (z.l_suppkey IS NULL) = 0 AS empty FROM lineitem l LEFT JOIN z USING (l_orderkey, l_suppkey) GROUP BY 1""",
)
def placeholder(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    tools = hits.groupBy("l_orderkey", "l_suppkey").agg(F.greatest(F.min("l_discount") - 0.03, F.lit(0.0)).alias("diameter"))  # a tool is a supplier of an order
    return J.without_placeholders(hits, tools, ["l_orderkey", "l_suppkey"], "l_orderkey", "diameter")


@query(
    "f06_usable",
    """WITH h AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity AS r FROM lineitem WHERE l_extendedprice > 10000 AND l_extendedprice + l_quantity < 60000 AND l_returnflag <> 'R')
SELECT l_suppkey, count(*) AS usable, CAST(least(count(*), 40) AS BIGINT) AS cut FROM h GROUP BY 1""",
)
def usable(spark: SparkSession, d: str) -> DataFrame:
    inside = (F.col("l_extendedprice") > 10000) & (F.col("l_extendedprice") + F.col("l_quantity") < 60000) & (F.col("l_returnflag") != "R")
    return read(spark, d, "lineitem").filter(inside).groupBy("l_suppkey").agg(F.count("*").alias("usable"), F.least(F.count("*"), F.lit(40)).alias("cut"))


@query("f07_flag", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 5 AND l_returnflag = 'N' THEN true ELSE l_linestatus = 'F' END AS filled FROM lineitem")
def flag(spark: SparkSession, d: str) -> DataFrame:
    filled = F.when((F.col("l_quantity") <= 5) & (F.col("l_returnflag") == "N"), True).otherwise(F.col("l_linestatus") == "F")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", filled.alias("filled"))


@query(
    "f08_same_text",
    """WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: NOT regexp_matches(trim(x), '^(G04|G4 |%T[FAOD])')) AS l FROM documents)
SELECT md5(array_to_string(l, chr(10))) AS key, min(doc_id) AS first, count(*) AS copies FROM l GROUP BY 1""",
)
def same_text(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(X.without_comments(F.col("text")).cast("binary"))
    return read(spark, d, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))


@query("f09_drawable", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 IN (1, 3) OR l_linenumber = 4 AS drawable FROM lineitem")
def drawable(spark: SparkSession, d: str) -> DataFrame:
    operation = F.concat(F.lit("X"), F.col("l_partkey").cast("string"), F.lit("Y-"), F.col("l_suppkey").cast("string"), F.lit("D0"), (F.col("l_linenumber") % 4).cast("string"), F.lit("*\n"))
    region = F.when(F.col("l_linenumber") == 4, "G36*\nX0Y0D02*\nG37*\n").otherwise("")
    plot = F.concat(F.lit("G04 a plot D01*\n%FSLAX46Y46*%\n%ADD10C,0.1*%\nD10*\n"), operation, region, F.lit("M02*\n"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.has_geometry(plot).alias("drawable"))


@query(
    "f11_supply",
    """WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'GND' WHEN 1 THEN '+3V3' WHEN 2 THEN 'VCC_IO' ELSE 'NET' END || p_partkey AS net FROM part), s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_tax = 0)
SELECT net, (regexp_matches(net, '(?i)^(gnd|vcc|\\+\\d)') OR p_partkey IN (SELECT l_partkey FROM s) OR net IN ('NET3', 'NET7')) AND net NOT IN ('GND4', 'NET7') AS supply FROM n""",
)
def supply(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_size") % 4
    nets = read(spark, d, "part").select("p_partkey", F.concat(F.when(kind == 0, "GND").when(kind == 1, "+3V3").when(kind == 2, "VCC_IO").otherwise("NET"), F.col("p_partkey").cast("string")).alias("net"))
    solid = read(spark, d, "lineitem").filter("l_tax = 0").select("l_partkey").distinct()  # the parts that have a plane
    planes = nets.join(solid, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("net", F.lit(True).alias("solid"))
    return J.supply_nets(nets, "net", planes, ["NET3", "NET7"], ["GND4", "NET7"], r"(?i)^(gnd|vcc|\+\d)").select("net", "supply")


LAYERS = """WITH l AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ['*.Cu', '*.Mask'] WHEN 1 THEN ['F.Cu', 'F.Paste'] WHEN 2 THEN ['B.Cu', 'B.Paste', 'B.Mask'] ELSE ['F.SilkS'] END AS layers FROM part) """


@query(
    "f12_pad_layers",
    LAYERS + """SELECT p_partkey, len(list_filter(layers, lambda x: x LIKE '%.Cu')) > 0 AS copper, list_has_any(layers, ['F.Cu', '*.Cu']) AS top, list_has_any(layers, ['B.Cu', '*.Cu']) AS bottom,
CASE WHEN list_has_any(layers, ['F.Paste', '*.Paste']) THEN 'top' WHEN list_contains(layers, 'B.Paste') THEN 'bottom' END AS paste FROM l""",
)
def pad_layers(spark: SparkSession, d: str) -> DataFrame:
    names = lambda *x: F.array(*map(F.lit, x))
    kind = F.col("p_size") % 4
    layers = F.when(kind == 0, names("*.Cu", "*.Mask")).when(kind == 1, names("F.Cu", "F.Paste")).when(kind == 2, names("B.Cu", "B.Paste", "B.Mask")).otherwise(names("F.SilkS"))
    return read(spark, d, "part").select("p_partkey", X.copper_sides(layers).alias("s")).select("p_partkey", "s.*")


NAMES = ("F.Cu", "B.Cu", "In1.Cu", "In2.Cu", "F.Mask", "B.Mask", "F.SilkS", "B.SilkS", "F.Paste", "B.Paste", "Edge.Cuts", "F.CrtYd", "F.Fab", "Notes")
LAYER = f"WITH n AS (SELECT p_partkey, {list(NAMES)}[p_partkey % {len(NAMES)} + 1] AS layer FROM part) "


def _layers(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, NAMES))
    return read(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(NAMES)).cast("int")).alias("layer"))


@query(
    "f13_visibility",
    LAYER + """SELECT p_partkey, CASE WHEN layer LIKE '%.Cu' THEN 'copper' WHEN layer LIKE '%.Mask' THEN 'mask' WHEN layer LIKE '%.SilkS' THEN 'silkscreen' WHEN layer LIKE '%.Paste' THEN 'paste' WHEN layer LIKE 'Edge%' THEN 'outline' WHEN layer LIKE '%CrtYd' THEN 'courtyard' WHEN layer LIKE '%Fab' THEN 'fab' ELSE 'other' END AS role,
layer IN ('F.Cu', 'B.Cu', 'F.Mask', 'B.Mask', 'F.SilkS', 'B.SilkS', 'Edge.Cuts') AS shown FROM n""",
)
def visibility(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("p_partkey", X.layer_role(F.col("layer")).alias("role"), X.shown(F.col("layer")).alias("shown"))


@query(
    "o02_layer_rank",
    LAYER + """SELECT layer, CASE layer WHEN 'F.SilkS' THEN 0 WHEN 'F.Paste' THEN 1 WHEN 'F.Mask' THEN 2 WHEN 'F.Cu' THEN 3 WHEN 'In1.Cu' THEN 4 WHEN 'In2.Cu' THEN 5 WHEN 'B.Cu' THEN 6 WHEN 'B.Mask' THEN 7 WHEN 'B.Paste' THEN 8 WHEN 'B.SilkS' THEN 9 ELSE 1000 END AS rank, count(*) AS n FROM n GROUP BY ALL""",
)
def layer_rank(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).groupBy("layer", X.layer_rank(F.col("layer"), F.lit(4)).alias("rank")).agg(F.count("*").alias("n")).orderBy("rank", "layer")


@query("f14_planar", "SELECT l_suppkey, max(l_tax) - min(l_tax) > 0.01 AND max(l_discount) - min(l_discount) > 0.01 AS planar FROM lineitem GROUP BY 1")
def planar(spark: SparkSession, d: str) -> DataFrame:
    spread = lambda c: F.max(c) - F.min(c) > 0.01
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg((spread("l_tax") & spread("l_discount")).alias("planar"))


@query("x01_header", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_brand || ' / ' || p_type)), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def header(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", X.header_name(F.concat_ws(" / ", "p_brand", "p_type")).alias("name"))


@query("x02_designators", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_type || ', ;' || p_brand, '[,;\\s]+'), lambda x: x <> ''), '|') AS refs FROM part")
def designators(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.array_join(X.designators(F.concat("p_type", F.lit(", ;"), "p_brand")), "|").alias("refs"))


@query("x03_patterns", "SELECT p_partkey, 'A{' || p_size || ',2}|B*' AS parts FROM part")
def patterns(spark: SparkSession, d: str) -> DataFrame:
    listed = F.concat(F.lit("A{"), F.col("p_size").cast("string"), F.lit(",2}; B*"))
    return read(spark, d, "part").select("p_partkey", F.array_join(X.pattern_parts(listed), "|").alias("parts"))


@query("x04_units", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 0.0254::DOUBLE WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size * 25.4::DOUBLE END AS mm FROM part")
def units(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("p_size") % 3 == 0, " mil").when(F.col("p_size") % 3 == 1, "").otherwise("in")
    return read(spark, d, "part").select("p_partkey", X.length_mm(F.concat(F.col("p_size").cast("string"), unit)).alias("mm"))


@query("x05_side", "SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'b') THEN 'bottom' ELSE 'top' END AS side FROM part")
def side(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", X.side_of(F.col("p_name")).alias("side"))


@query("x06_layers", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'F.Cu' WHEN p_size = 8 THEN 'B.Cu' WHEN p_size < 8 THEN 'In' || (p_size - 1) || '.Cu' ELSE 'L' || p_size END AS layer FROM part")
def layers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", X.copper_layer(F.concat(F.lit("L"), F.col("p_size").cast("string")), F.lit(8)).alias("layer"))


@query("x07_node_ref", "SELECT p_partkey, regexp_extract(p_brand || '_' || p_size, '^(.+)_[0-9]+$', 1) AS ref FROM part")
def node_ref(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.regexp_extract(F.concat_ws("_", "p_brand", F.col("p_size").cast("string")), r"^(.+)_\d+$", 1).alias("ref"))


@query("x08_target_from_name", "SELECT p_partkey, CASE WHEN p_size + 45 BETWEEN 5 AND 500 THEN CAST(p_size + 45 AS DOUBLE) END AS target FROM part")
def target(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("DP_"), (F.col("p_size") + 45).cast("string"), F.when(F.col("p_size") % 2 == 0, "_MS").otherwise("ohm"))
    return read(spark, d, "part").select("p_partkey", X.impedance_target(name).alias("target"))


@query("x09_profile", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS target FROM part")
def profile(spark: SparkSession, d: str) -> DataFrame:
    js = F.format_string('{"tuning":{"target":%d.0}}', F.col("p_size"))
    return read(spark, d, "part").select("p_partkey", F.from_json(js, "tuning struct<target: double>")["tuning"]["target"].alias("target"))


@query("x10_file_name", "SELECT p_partkey, regexp_extract(p_brand || '-bom_v' || p_size || '.csv', '^(.+)-bom', 1) AS board, CAST(p_size AS VARCHAR) AS version FROM part")
def file_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("p_brand"), F.lit("-bom_v"), F.col("p_size").cast("string"), F.lit(".csv"))
    return read(spark, d, "part").select("p_partkey", F.regexp_extract(name, "^(.+)-bom", 1).alias("board"), F.regexp_extract(name, r"_v(\d+)\.csv$", 1).alias("version"))


@query("x12_colour", "SELECT p_partkey, CAST(p_partkey % 4096 AS INTEGER) AS colour FROM part")
def colour(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", X.hex_colour(F.format_string("#%06x", F.col("p_partkey") % 4096)).alias("colour"))


@query(
    "x13_view_state",
    """SELECT p_partkey, 'z=' || p_size || CASE WHEN p_size % 2 = 0 THEN '&r=' || p_partkey || ',2,3,4' ELSE '' END || '&l=top+' || p_brand AS state, CAST(p_size AS DOUBLE) AS zoom, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS DOUBLE) END AS x, p_brand AS layer FROM part""",
)
def view_state(spark: SparkSession, d: str) -> DataFrame:
    region = F.when(F.col("p_size") % 2 == 0, F.struct(F.col("p_partkey").alias("x"), F.lit(2).alias("y"), F.lit(3).alias("w"), F.lit(4).alias("h")))
    rows = read(spark, d, "part").select("p_partkey", X.view_state(F.col("p_size"), region, F.array(F.lit("top"), F.col("p_brand"))).alias("state"))
    rows = rows.withColumn("v", X.view_of(F.col("state")))
    return rows.select("p_partkey", "state", F.col("v.zoom").alias("zoom"), F.col("v.region.x").alias("x"), F.get("v.layers", F.lit(1)).alias("layer"))


@query("x15_stamp", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2024-02-30T25:61' WHEN 1 THEN 'spring' ELSE '' END || event_id AS stamp FROM events")
def stamp(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 3
    job = F.to_json(F.struct(F.concat(F.when(kind == 0, "2024-02-30T25:61").when(kind == 1, "spring").otherwise(""), F.col("event_id").cast("string")).alias("CreationDate")))
    return read(spark, d, "events").select("event_id", F.get_json_object(job, "$.CreationDate").alias("stamp"))  # a stamp is text, whatever it says


@query("x16_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * l_tax * 1000 + 0.5) / 1000 AS v FROM lineitem")
def half_up(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.half_up(F.col("l_extendedprice") * F.col("l_tax"), 3).alias("v"))


@query("x17_quantise", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / 250 + 0.5) * 250 AS v FROM lineitem")
def quantise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.floor(F.col("l_extendedprice") / 250 + 0.5) * 250.0).alias("v"))


@query("x19_significant", "SELECT p_partkey, floor(p_retailprice * pow(10.0::DOUBLE, 2.0 - floor(log10(abs(p_retailprice)))) + 0.5) / pow(10.0::DOUBLE, 2.0 - floor(log10(abs(p_retailprice)))) AS v FROM part")
def significant(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", X.significant(F.col("p_retailprice"), 3).alias("v"))


@query("x21_hole_key", "SELECT l_orderkey, l_linenumber, l_partkey, least(l_partkey, l_suppkey) || '|' || greatest(l_partkey, l_suppkey) AS key FROM lineitem")
def hole_key(spark: SparkSession, d: str) -> DataFrame:
    key = F.array_join(F.transform(F.array_sort(F.array("l_partkey", "l_suppkey")), lambda x: x.cast("string")), "|")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("key"))


@query("x22_sweep", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT CAST(floor(o_totalprice / 10000) AS BIGINT))), ',') AS grid FROM orders GROUP BY 1")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    grid = F.array_sort(F.collect_set(F.floor(F.col("o_totalprice") / 10000)))
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(grid, lambda x: x.cast("string")), ",").alias("grid"))


@query("x23_attributes", "SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, 2 AS n FROM part")
def attributes(spark: SparkSession, d: str) -> DataFrame:
    m = F.map_concat(F.create_map(F.lit("brand"), F.col("p_brand")), F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    return read(spark, d, "part").select("p_partkey", m["brand"].alias("brand"), m["size"].alias("size"), F.size(m).alias("n"))


@query("x24_strict_json", "SELECT event_id, len(json_keys(props)) AS keys, json_valid(props) AS valid FROM events")
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return read(spark, d, "events").select("event_id", F.size(keys).cast("long").alias("keys"), keys.isNotNull().alias("valid"))


@query("x26_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# -- geometry ---------------------------------------------------------------------------------------------------------


def _rings(spark: SparkSession, d: str) -> DataFrame:
    points = F.floor(F.size("embedding") / 2).cast("int")
    places = F.when(points > 0, F.sequence(F.lit(0), points - 1)).otherwise(F.array().cast("array<int>"))
    ring = F.transform(places, lambda i: G.point(F.get("embedding", i * 2), F.get("embedding", i * 2 + 1)))
    return read(spark, d, "embeddings").select("vec_id", ring.alias("ring"))


POINTS = """WITH r AS (SELECT vec_id, list_transform(range(0, len(embedding) // 2), lambda i: {'x': CAST(embedding[2 * i + 1] AS DOUBLE), 'y': CAST(embedding[2 * i + 2] AS DOUBLE)}) AS ring FROM embeddings) """
ROUND = "floor(({0}) * 1000000 + 0.5) / 1000000"
AREA = "list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y)) / 2"


def _six(c):
    return F.floor(c * 1000000 + 0.5) / 1000000


@query("geo01_area", POINTS + f"SELECT vec_id, {ROUND.format(AREA)} AS area FROM r")
def area(spark: SparkSession, d: str) -> DataFrame:
    return _rings(spark, d).select("vec_id", _six(G.signed_area(F.col("ring"))).alias("area"))


@query("geo02_rectangle", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity * l_tax * 1000 + 0.5) / 1000 AS area FROM lineitem")
def rectangle(spark: SparkSession, d: str) -> DataFrame:
    ring = G.rectangle(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.col("l_tax"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.floor(G.signed_area(ring) * 1000 + 0.5) / 1000).alias("area"))


@query(
    "geo03_distance",
    """WITH s AS (SELECT s_suppkey, s_acctbal AS x, s_nationkey * 100.0::DOUBLE AS y, greatest(0.0, least(1.0, (s_acctbal * 5000 + s_nationkey * 100.0 * 1000) / (5000.0 * 5000 + 1000.0 * 1000)))::DOUBLE AS t FROM supplier)
SELECT s_suppkey, floor(sqrt(pow(x - 5000 * t, 2) + pow(y - 1000 * t, 2)) * 1000 + 0.5) / 1000 AS distance FROM s""",
)
def distance(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit
    far = G.segment_distance(F.col("s_acctbal"), F.col("s_nationkey") * 100.0, n(0.0), n(0.0), n(5000.0), n(1000.0))
    return read(spark, d, "supplier").select("s_suppkey", (F.floor(far * 1000 + 0.5) / 1000).alias("distance"))


@query(
    "geo04_place",
    """SELECT l_orderkey, l_linenumber, l_partkey, floor((l_extendedprice + (CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) * cos(radians(l_suppkey)) - l_tax * sin(radians(l_suppkey))) * 1000 + 0.5) / 1000 AS x FROM lineitem""",
)
def place(spark: SparkSession, d: str) -> DataFrame:
    at = G.placed(F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice"), F.lit(0.0), F.col("l_suppkey"), F.when(F.col("l_returnflag") == "R", "bottom").otherwise("top"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.floor(at["x"] * 1000 + 0.5) / 1000).alias("x"))


@query(
    "geo05_pip",
    POINTS + """SELECT vec_id, len(list_filter(range(1, len(ring) + 1), lambda i: (ring[i].y > 0.01) <> (ring[i % len(ring) + 1].y > 0.01) AND 0.01 < (ring[i % len(ring) + 1].x - ring[i].x) * (0.01 - ring[i].y) / (ring[i % len(ring) + 1].y - ring[i].y) + ring[i].x)) % 2 = 1 AS inside FROM r""",
)
def point_in_ring(spark: SparkSession, d: str) -> DataFrame:
    return _rings(spark, d).select("vec_id", G.contains(F.col("ring"), F.lit(0.01), F.lit(0.01)).alias("inside"))


@query("geo06_arc", "SELECT s_suppkey, floor(s_acctbal * cos(radians(s_nationkey + 90)) * 1000 + 0.5) / 1000 AS x FROM supplier")
def arc(spark: SparkSession, d: str) -> DataFrame:
    points = G.arc(F.lit(0.0), F.lit(0.0), F.col("s_acctbal"), F.col("s_nationkey"), F.lit(90.0), 4)
    return read(spark, d, "supplier").select("s_suppkey", (F.floor(F.element_at(points, -1)["x"] * 1000 + 0.5) / 1000).alias("x"))


@query("geo10_half_arcs", "SELECT s_suppkey, k, CASE k WHEN 0 THEN s_acctbal ELSE -s_acctbal END AS x FROM supplier, (VALUES (0), (1)) AS t(k)")
def half_arcs(spark: SparkSession, d: str) -> DataFrame:
    halves = F.posexplode(G.half_arcs(F.lit(0.0), F.lit(0.0), F.col("s_acctbal"))).alias("k", "h")
    return read(spark, d, "supplier").select("s_suppkey", halves).select("s_suppkey", "k", F.col("h.start.x").alias("x"))


@query("a13_ring_box", POINTS + "SELECT vec_id, list_min(list_transform(ring, lambda p: p.x)) AS min_x, list_max(list_transform(ring, lambda p: p.y)) AS max_y FROM r")
def ring_box(spark: SparkSession, d: str) -> DataFrame:
    b = G.box(F.col("ring"))
    return _rings(spark, d).select("vec_id", b["min_x"].alias("min_x"), b["max_y"].alias("max_y"))


@query("geo14_view", "SELECT l_orderkey, l_linenumber, l_partkey, floor((l_extendedprice - 500) * (800.0 / 100000) * 1000 + 0.5) / 1000 AS px FROM lineitem")
def view(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.floor((F.col("l_extendedprice") - 500) * (800.0 / 100000) * 1000 + 0.5) / 1000).alias("px"))


@query("geo15_up_axis", "SELECT l_orderkey, CASE WHEN least(max(l_quantity), max(l_tax) * 100, max(l_discount) * 100) = max(l_tax) * 100 THEN 'y' ELSE 'z' END AS up FROM lineitem GROUP BY 1")
def up_axis(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = F.max("l_quantity"), F.max("l_tax") * 100, F.max("l_discount") * 100
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.least(x, y, z) == y, "y").otherwise("z").alias("up"))


# -- lines ------------------------------------------------------------------------------------------------------------


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_quantity", "l_discount").distinct()
    return rows.select("l_quantity", "l_discount", (0.05 + F.col("l_quantity") / 100).alias("w"), (0.1 + F.col("l_discount")).alias("h"))


TRACKS = "WITH t AS (SELECT DISTINCT l_quantity, l_discount, 0.05::DOUBLE + l_quantity / 100 AS w, 0.1::DOUBLE + l_discount AS h FROM lineitem) "


def _three(c):
    return F.floor(c * 1000 + 0.5) / 1000


MICROSTRIP = TRACKS + """, a AS (SELECT *, w / h AS u, 0.035::DOUBLE / h AS t FROM t),
b AS (SELECT *, t / pi() * ln(1 + 4 * exp(1.0::DOUBLE) / (t * pow((exp(2 * sqrt(6.517::DOUBLE * u)) + 1) / (exp(2 * sqrt(6.517::DOUBLE * u)) - 1), 2))) AS d FROM a),
c AS (SELECT *, u + d AS u1, u + d * (1 + 2 / (exp(sqrt(3.4::DOUBLE)) + exp(-sqrt(3.4::DOUBLE)))) / 2 AS ur FROM b),
f AS (SELECT *, 376.730313668::DOUBLE / (2 * pi()) * ln((6 + (2 * pi() - 6) * exp(-pow(30.666::DOUBLE / u1, 0.7528::DOUBLE))) / u1 + sqrt(1 + pow(2 / u1, 2))) AS z1,
  376.730313668::DOUBLE / (2 * pi()) * ln((6 + (2 * pi() - 6) * exp(-pow(30.666::DOUBLE / ur, 0.7528::DOUBLE))) / ur + sqrt(1 + pow(2 / ur, 2))) AS zr,
  2.7::DOUBLE + 1.7::DOUBLE * pow(1 + 10 / ur, -(1 + ln((pow(ur, 4) + pow(ur / 52, 2)) / (pow(ur, 4) + 0.432::DOUBLE)) / 49 + ln(1 + pow(ur / 18.1::DOUBLE, 3)) / 18.7::DOUBLE) * 0.564::DOUBLE * pow(3.5::DOUBLE / 7.4::DOUBLE, 0.053::DOUBLE)) AS e FROM c) """


@query("z01_microstrip", MICROSTRIP + "SELECT l_quantity, l_discount, floor(zr / sqrt(e) * 1000 + 0.5) / 1000 AS z0, floor(e * pow(z1 / zr, 2) * 1000 + 0.5) / 1000 AS e_eff FROM f")
def microstrip(spark: SparkSession, d: str) -> DataFrame:
    m = L.microstrip(F.col("w"), F.col("h"), F.lit(0.035), F.lit(4.4))
    return _tracks(spark, d).select("l_quantity", "l_discount", m.alias("m")).select("l_quantity", "l_discount", _three(F.col("m.z0")).alias("z0"), _three(F.col("m.e_eff")).alias("e_eff"))


@query("z08_ipc_microstrip", TRACKS + "SELECT l_quantity, l_discount, floor(87 / sqrt(5.81::DOUBLE) * ln(5.98::DOUBLE * h / (0.8::DOUBLE * w + 0.035::DOUBLE)) * 1000 + 0.5) / 1000 AS z0 FROM t")
def ipc_microstrip(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).select("l_quantity", "l_discount", _three(L.ipc_microstrip(F.col("w"), F.col("h"), F.lit(0.035), F.lit(4.4))).alias("z0"))


@query("z09_ipc_stripline", TRACKS + "SELECT l_quantity, l_discount, floor(60 / sqrt(4.4::DOUBLE) * ln(1.9::DOUBLE * 4 * h / (0.8::DOUBLE * w + 0.035::DOUBLE)) * 1000 + 0.5) / 1000 AS z0 FROM t")
def ipc_stripline(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).select("l_quantity", "l_discount", _three(L.ipc_stripline(F.col("w"), F.col("h") * 4, F.lit(0.035), F.lit(4.4))).alias("z0"))


@query(
    "z10_ipc_coupled",
    TRACKS + """SELECT l_quantity, l_discount, floor(2 * (87 / sqrt(5.81::DOUBLE) * ln(5.98::DOUBLE * h / (0.8::DOUBLE * w + 0.035::DOUBLE))) * (1 - 0.48::DOUBLE * exp(-0.96::DOUBLE * 0.2::DOUBLE / h)) * 1000 + 0.5) / 1000 AS micro,
floor(2 * (60 / sqrt(4.4::DOUBLE) * ln(1.9::DOUBLE * 4 * h / (0.8::DOUBLE * w + 0.035::DOUBLE))) * (1 - 0.347::DOUBLE * exp(-2.9::DOUBLE * 0.2::DOUBLE / (4 * h))) * 1000 + 0.5) / 1000 AS strip FROM t""",
)
def ipc_coupled(spark: SparkSession, d: str) -> DataFrame:
    w, h, t, er, s = F.col("w"), F.col("h"), F.lit(0.035), F.lit(4.4), F.lit(0.2)
    return _tracks(spark, d).select("l_quantity", "l_discount", _three(L.ipc_coupled_microstrip(w, h, t, er, s)).alias("micro"), _three(L.ipc_coupled_stripline(w, h * 4, t, er, s)).alias("strip"))


@query(
    "z12_registry",
    TRACKS + """SELECT l_quantity, l_discount, CASE CAST(l_quantity AS INTEGER) % 3 WHEN 0 THEN floor(87 / sqrt(5.81::DOUBLE) * ln(5.98::DOUBLE * h / (0.8::DOUBLE * w + 0.035::DOUBLE)) * 1000 + 0.5) / 1000 WHEN 1 THEN floor(60 / sqrt(4.4::DOUBLE) * ln(1.9::DOUBLE * 4 * h / (0.8::DOUBLE * w + 0.035::DOUBLE)) * 1000 + 0.5) / 1000 END AS z0,
CASE CAST(l_quantity AS INTEGER) % 3 WHEN 0 THEN w / h BETWEEN 0.1 AND 2 WHEN 1 THEN 0.035::DOUBLE / (4 * h) <= 0.25 END AS valid FROM t""",
)
def line_registry(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("l_quantity").cast("int") % 3
    model = F.when(kind == 0, "ipc_microstrip").when(kind == 1, "ipc_stripline").otherwise("unheard of")
    z = L.calculated(model, w=F.col("w"), h=F.col("h"), b=F.col("h") * 4, t=F.lit(0.035), er=F.lit(4.4), s=F.lit(0.2))
    return _tracks(spark, d).select("l_quantity", "l_discount", z.alias("z")).select("l_quantity", "l_discount", _three(F.col("z.z0")).alias("z0"), F.col("z.valid").alias("valid"))


@query("x14_script_number", "SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS price, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity FROM lineitem")
def script_numbers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.script_number(F.col("l_extendedprice")).alias("price"), X.script_number(F.col("l_quantity")).alias("quantity"))


@query(
    "geo17_ink",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, l_orderkey % 256 AS b, l_quantity * 5 AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, a >= 40 AND 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b <= 235 AS ink FROM p""",
)
def ink_mask(spark: SparkSession, d: str) -> DataFrame:
    ink = X.ink(F.col("l_partkey") % 256, F.col("l_suppkey") * 7 % 256, F.col("l_orderkey") % 256, F.col("l_quantity") * 5)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ink.alias("ink"))


@query(
    "z07_coupled_stripline",
    "",
)
def coupled_stripline(spark: SparkSession, d: str) -> DataFrame:
    c = L.coupled_stripline(F.col("w"), F.col("h") * 4, F.lit(4.4), F.lit(0.2))
    return _tracks(spark, d).select("l_quantity", "l_discount", c.alias("c")).select("l_quantity", "l_discount", _three(F.col("c.odd")).alias("odd"), _three(F.col("c.even")).alias("even"), _three(F.col("c.differential")).alias("differential"))


def _agm(source: str, means: dict[str, str]) -> str:
    """A recursive table g: for each row of the source, agm(1, x) of each expression x, by its name."""
    a = ", ".join(f"1.0::DOUBLE AS {n}, CAST({x} AS DOUBLE) AS {n}_b" for n, x in means.items())
    step = ", ".join(f"({n} + {n}_b) / 2, sqrt({n} * {n}_b)" for n in means)
    return f", g AS (SELECT *, 0 AS rounds, {a} FROM {source} UNION ALL SELECT g.* EXCLUDE (rounds, {', '.join(f'{n}, {n}_b' for n in means)}), rounds + 1, {step} FROM g WHERE rounds < 24) "


RECURSIVE = TRACKS.replace("WITH ", "WITH RECURSIVE ", 1)
ETA = "376.730313668::DOUBLE"


@query(
    "z03_stripline",
    RECURSIVE + """, a AS (SELECT *, 4 * h AS b, 0.035::DOUBLE / (4 * h) AS x FROM t),
c AS (SELECT *, x / (pi() * (1 - x)) * (1 - 0.5::DOUBLE * ln(pow(x / (2 - x), 2) + pow(0.0796::DOUBLE * x / (w / b + 1.1::DOUBLE * x), 2 / (1 + 2.0::DOUBLE / 3 * x / (1 - x))))) AS wide FROM a),
u AS (SELECT l_quantity, l_discount, (w / (b - 0.035::DOUBLE) + wide) * pi() / 2 AS u FROM c)""" + _agm("u", {"k": "2 / (exp(u) + exp(-u))", "c": "(exp(u) - exp(-u)) / (exp(u) + exp(-u))"})
    + f"SELECT l_quantity, l_discount, floor({ETA} / 4 / sqrt(4.4::DOUBLE) * k / c * 1000 + 0.5) / 1000 AS z0 FROM g WHERE rounds = 24",
)
def stripline(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).select("l_quantity", "l_discount", _three(L.stripline(F.col("w"), F.col("h") * 4, F.lit(0.035), F.lit(4.4))).alias("z0"))


def _tanh(x: str) -> str:
    return f"((exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1))"


ORACLES["z07_coupled_stripline"] = (
    RECURSIVE + f", a AS (SELECT l_quantity, l_discount, {_tanh('pi() * w / (8 * h)')} AS one, {_tanh('pi() * (w + 0.2::DOUBLE) / (8 * h)')} AS two FROM t), b AS (SELECT l_quantity, l_discount, one / two AS o, one * two AS e FROM a)"
    + _agm("b", {"ok": "sqrt(1 - o * o)", "oc": "o", "ek": "sqrt(1 - e * e)", "ec": "e"})
    + f", z AS (SELECT l_quantity, l_discount, {ETA} / 4 / sqrt(4.4::DOUBLE) * (ok / oc) AS odd, {ETA} / 4 / sqrt(4.4::DOUBLE) * (ek / ec) AS even FROM g WHERE rounds = 24) SELECT l_quantity, l_discount, floor(odd * 1000 + 0.5) / 1000 AS odd, floor(even * 1000 + 0.5) / 1000 AS even, floor(2 * odd * 1000 + 0.5) / 1000 AS differential FROM z"
)
CPW = RECURSIVE + """, a AS (SELECT l_quantity, l_discount, w / (w + 0.4::DOUBLE) AS k0, {0} AS k1 FROM t)""" + _agm("a", {"m0": "k0", "n0": "sqrt(1 - k0 * k0)", "m1": "k1", "n1": "sqrt(1 - k1 * k1)"})


@query(
    "z04_cpw",
    CPW.format("(exp(pi() * w / (16 * h)) - exp(-pi() * w / (16 * h))) / (exp(pi() * (w + 0.4::DOUBLE) / (16 * h)) - exp(-pi() * (w + 0.4::DOUBLE) / (16 * h)))")
    + f", r AS (SELECT *, m0 / n0 AS o0, 1 + 1.7::DOUBLE * (m1 / n1) / (m0 / n0) AS e FROM g WHERE rounds = 24) SELECT l_quantity, l_discount, floor({ETA} / 4 / sqrt(e) / o0 * 1000 + 0.5) / 1000 AS z0, floor(e * 1000 + 0.5) / 1000 AS e_eff FROM r",
)
def cpw(spark: SparkSession, d: str) -> DataFrame:
    m = L.cpw(F.col("w"), F.lit(0.2), F.col("h") * 4, F.lit(4.4))
    return _tracks(spark, d).select("l_quantity", "l_discount", m.alias("m")).select("l_quantity", "l_discount", _three(F.col("m.z0")).alias("z0"), _three(F.col("m.e_eff")).alias("e_eff"))


@query(
    "z05_grounded_cpw",
    CPW.format("((exp(2 * pi() * w / (4 * h)) - 1) / (exp(2 * pi() * w / (4 * h)) + 1)) / ((exp(2 * pi() * (w + 0.4::DOUBLE) / (4 * h)) - 1) / (exp(2 * pi() * (w + 0.4::DOUBLE) / (4 * h)) + 1))")
    + f", r AS (SELECT *, m0 / n0 AS o0, m1 / n1 AS o1 FROM g WHERE rounds = 24), e AS (SELECT *, (1 + 4.4::DOUBLE * (o1 / o0)) / (1 + o1 / o0) AS e FROM r) SELECT l_quantity, l_discount, floor({ETA} / 2 / sqrt(e) / (o0 + o1) * 1000 + 0.5) / 1000 AS z0, floor(e * 1000 + 0.5) / 1000 AS e_eff FROM e",
)
def grounded_cpw(spark: SparkSession, d: str) -> DataFrame:
    m = L.grounded_cpw(F.col("w"), F.lit(0.2), F.col("h"), F.lit(4.4))
    return _tracks(spark, d).select("l_quantity", "l_discount", m.alias("m")).select("l_quantity", "l_discount", _three(F.col("m.z0")).alias("z0"), _three(F.col("m.e_eff")).alias("e_eff"))


def _microstrip_sql(w: str) -> str:
    """z0 of a strip of this width over l_discount + 0.1, by the formulas of z01."""
    u, t = f"(({w}) / (l_discount + 0.1::DOUBLE))", "(0.035::DOUBLE / (l_discount + 0.1::DOUBLE))"
    d = f"({t} / pi() * ln(1 + 4 * exp(1.0::DOUBLE) / ({t} * pow((exp(2 * sqrt(6.517::DOUBLE * {u})) + 1) / (exp(2 * sqrt(6.517::DOUBLE * {u})) - 1), 2))))"
    r = f"({u} + {d} * (1 + 2 / (exp(sqrt(3.4::DOUBLE)) + exp(-sqrt(3.4::DOUBLE)))) / 2)"
    z = f"({ETA} / (2 * pi()) * ln((6 + (2 * pi() - 6) * exp(-pow(30.666::DOUBLE / {r}, 0.7528::DOUBLE))) / {r} + sqrt(1 + pow(2 / {r}, 2))))"
    e = f"(2.7::DOUBLE + 1.7::DOUBLE * pow(1 + 10 / {r}, -(1 + ln((pow({r}, 4) + pow({r} / 52, 2)) / (pow({r}, 4) + 0.432::DOUBLE)) / 49 + ln(1 + pow({r} / 18.1::DOUBLE, 3)) / 18.7::DOUBLE) * 0.564::DOUBLE * pow(3.5::DOUBLE / 7.4::DOUBLE, 0.053::DOUBLE)))"
    return f"({z} / sqrt({e}))"


@query(
    "z13_synthesize",
    f"""WITH RECURSIVE h AS (SELECT DISTINCT l_discount FROM lineitem), s AS (SELECT l_discount, 0 AS n, ln(0.01::DOUBLE) AS lo, ln(10.0::DOUBLE) AS hi FROM h
UNION ALL SELECT l_discount, n + 1, CASE WHEN {_microstrip_sql("exp((lo + hi) / 2)")} > 50 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_microstrip_sql("exp((lo + hi) / 2)")} > 50 THEN hi ELSE (lo + hi) / 2 END FROM s WHERE n < 40)
SELECT l_discount, CASE WHEN {_microstrip_sql("0.01::DOUBLE")} >= 50 AND {_microstrip_sql("10.0::DOUBLE")} <= 50 THEN floor(exp((lo + hi) / 2) * 1000 + 0.5) / 1000 END AS w FROM s WHERE n = 40""",
)
def synthesize(spark: SparkSession, d: str) -> DataFrame:
    heights = read(spark, d, "lineitem").select("l_discount").distinct()
    h = F.col("l_discount") + 0.1
    width = L.synthesized(lambda w: L.microstrip(w, h, F.lit(0.035), F.lit(4.4))["z0"], F.lit(50.0), 0.01, 10.0, 40)
    return heights.select("l_discount", _three(width).alias("w"))


@query("z16_stackup", "SELECT p_partkey, floor((p_size / 10.0::DOUBLE + 0.2) / (p_size / 10.0::DOUBLE / 4.4 + 0.2 / 3.5) * 1000 + 0.5) / 1000 AS er FROM part")
def stackup(spark: SparkSession, d: str) -> DataFrame:
    layer = lambda t, er: F.struct(t.cast("double").alias("t"), F.lit(er).alias("er"))
    line = L.series_permittivity(F.array(layer(F.col("p_size") / 10.0, 4.4), layer(F.lit(0.2), 3.5)))
    return read(spark, d, "part").select("p_partkey", _three(line["er"]).alias("er"))


@query(
    "z18_skin",
    """WITH s AS (SELECT p_partkey, sqrt(1 / (pi() * (p_size * 1e9::DOUBLE) * (4e-7::DOUBLE * pi()) * 5.8e7::DOUBLE)) AS d FROM part)
SELECT p_partkey, floor(d * 1e9 + 0.5) / 1e9 AS depth, floor((1 + 2 / pi() * atan(1.4::DOUBLE * pow(5e-7::DOUBLE / d, 2))) * 1000 + 0.5) / 1000 AS rough FROM s""",
)
def skin(spark: SparkSession, d: str) -> DataFrame:
    depth = L.skin_depth(F.col("p_size") * 1e9, F.lit(5.8e7))
    return read(spark, d, "part").select("p_partkey", (F.floor(depth * 1e9 + 0.5) / 1e9).alias("depth"), _three(L.hammerstad_roughness(F.lit(5e-7), depth)).alias("rough"))


@query(
    "z19_dispersed",
    """WITH s AS (SELECT DISTINCT p_size, 1.7::DOUBLE AS u, p_size * 0.2::DOUBLE AS f FROM part),
p AS (SELECT *, (0.27488::DOUBLE + u * (0.6315::DOUBLE + 0.525::DOUBLE / pow(1 + 0.0157::DOUBLE * f, 20)) - 0.065683::DOUBLE * exp(-8.7513::DOUBLE * u)) * (0.33622::DOUBLE * (1 - exp(-0.03442::DOUBLE * 4.4)))
  * pow((0.1844::DOUBLE + 0.0363::DOUBLE * exp(-4.6::DOUBLE * u) * (1 - exp(-pow(f / 38.7::DOUBLE, 4.97::DOUBLE))) * (1 + 2.751::DOUBLE * (1 - exp(-pow(4.4::DOUBLE / 15.916, 8))))) * f, 1.5763::DOUBLE) AS p FROM s)
SELECT p_size, floor((4.4 - (4.4 - 3.176) / (1 + p)) * 1000000 + 0.5) / 1000000 AS e_eff FROM p""",
)
def dispersed(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_size").distinct()
    return rows.select("p_size", _six(L.dispersed(F.lit(3.176), F.lit(4.4), F.lit(1.7), F.col("p_size") * 0.2)).alias("e_eff"))
