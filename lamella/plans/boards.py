"""Queries of the matching, walking and line-analysis operators over the shared tables, and whole packages of board files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import complexes as C
from lamella.functions import fieldsolver, lines
from lamella.functions import geometry as G
from lamella.operators import graph, matching
from lamella.operators.aggregates import layered, summary
from lamella.operators.joins import band_join, grid_join
from lamella.operators.ordered import before
from lamella.plans.scalars import MICROSTRIP, TRACKS
from lamella.sources import drills, files, plots, sheets, trees
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


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    return band_join(s, c, ("s_nationkey", "c_nationkey"), "s_acctbal", "c_acctbal", 500.0).select("c_nationkey", "s_suppkey", "c_custkey", "distance")


@query("w07_greedy")
def greedy(spark: SparkSession, d: str) -> DataFrame:
    return matching.greedy_pairs(_pairs(spark, d), ["c_nationkey"], "s_suppkey", "c_custkey", "distance")


@query("j12_guarded_nearest")
def guarded(spark: SparkSession, d: str) -> DataFrame:
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    return matching.guarded_band(s, c, ("s_nationkey", "c_nationkey"), "s_acctbal", "c_acctbal", ("s_suppkey", "c_custkey"), 500.0)


@query("j25_bodies")
def bodies(spark: SparkSession, d: str) -> DataFrame:
    near = _pairs(spark, d).filter("distance <= 500")
    return matching.greedy_pairs(near, ["c_nationkey"], "c_custkey", "s_suppkey", "distance")


@query("j11_resolve")
def resolve(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    at = lambda k: (F.col("p_partkey") * k % 1009).cast("double")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("R"), F.col("p_partkey").cast("string"), F.lit("_1")))
    nodes = part.select(F.col("p_partkey").alias("node"), name.alias("name"), at(37).alias("x"), at(53).alias("y"))
    parts = part.select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("ref"), (at(37) + 0.1).alias("x"), at(53).alias("y"))
    return matching.resolved(nodes, parts, 2.0)


@query("j18_registration")
def registration(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    rows = c.select("c_nationkey", (F.col("c_custkey") % 97).cast("double").alias("x0"), F.col("c_acctbal").alias("y0"))
    rows = rows.withColumn("x1", 10 - F.col("y0")).withColumn("y1", F.col("x0") + 5)
    return matching.registered(rows, ["c_nationkey"], ("x0", "x1"), ("y0", "y1")).select("c_nationkey", "angle", "mirrored", F.round("dx", 3).alias("dx"), F.round("dy", 3).alias("dy"), F.round("rms", 3).alias("rms"), "used")


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c, n: (F.col(c) % n).cast("double")
    return read(spark, d, "lineitem").select("l_orderkey", at("l_partkey", 7).alias("x1"), at("l_suppkey", 5).alias("y1"), at("l_suppkey", 7).alias("x2"), at("l_linenumber", 5).alias("y2"))


@query("g03_route_walk")
def route_walk(spark: SparkSession, d: str) -> DataFrame:
    return matching.route_walk(_tracks(spark, d), ["l_orderkey"])


@query("g04_chain_order")
def chain(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 9).alias("a"), (F.col("l_suppkey") % 9).alias("b"))
    return matching.chain_order(rows, ["l_orderkey"], "a", "b")


@query("geo13_topology")
def topology(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).cast("double").alias("x"), F.floor(F.col("l_quantity") / 10).cast("double").alias("y"))
    return matching.topology(rows, ["l_orderkey"])


@query("g08_assembly")
def assembly(spark: SparkSession, d: str) -> DataFrame:
    moved = F.array(*[F.lit(1.0) if i % 5 == 0 else F.col("n_nationkey").cast("double") if i == 3 else F.lit(0.0) for i in range(16)])
    nation = read(spark, d, "nation")
    down = nation.select((F.col("n_regionkey") + 100).alias("parent"), F.col("n_nationkey").alias("child"), F.lit(0).alias("seq"), moved.alias("matrix"))
    top = read(spark, d, "region").select(F.lit(1000).alias("parent"), (F.col("r_regionkey") + 100).alias("child"), F.lit(0).alias("seq"), F.array(*[F.lit(float(i % 5 == 0 or i == 7)) for i in range(16)]).alias("matrix"))
    rows = graph.assembly(top.unionByName(down), spark.range(1).select(F.lit(1000).alias("node")))
    return rows.select("node", "path", F.get("matrix", F.lit(3)).alias("x"), F.get("matrix", F.lit(7)).alias("y"))


@query("geo07_pads", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity * l_tax * 100 * 1000 + 0.5) / 1000 AS area FROM lineitem WHERE l_tax > 0")
def pads(spark: SparkSession, d: str) -> DataFrame:
    ring = G.pad_outline(F.lit("rect"), F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.col("l_tax") * 100, F.lit(0.0))
    area = F.floor(G.signed_area(ring) * 1000 + 0.5) / 1000
    return read(spark, d, "lineitem").filter("l_tax > 0").select("l_orderkey", "l_linenumber", "l_partkey", area.alias("area"))


@query("z14_field_solver")
def field_solver(spark: SparkSession, d: str) -> DataFrame:
    sizes = read(spark, d, "part").select(F.col("p_size")).distinct()
    rows = sizes.select("p_size", (F.col("p_size") / 50.0).alias("w"), F.lit(0.2).alias("h"), F.lit(0.035).alias("t"), F.lit(4.4).alias("er"))
    return fieldsolver.solved(rows, "microstrip").select("p_size", F.round("z", 6).alias("z"), F.round("e_eff", 6).alias("e_eff"), F.round("error_pct", 6).alias("error_pct"))


@query("z06_coupled")
def coupled(spark: SparkSession, d: str) -> DataFrame:
    sizes = read(spark, d, "part").select(F.col("p_size")).distinct()
    rows = sizes.select("p_size", F.lit(0.2).alias("w"), F.lit(0.2).alias("h"), F.lit(0.035).alias("t"), F.lit(4.4).alias("er"), (F.col("p_size") / 50.0).alias("gap"))
    return fieldsolver.solved(rows, "coupled_microstrip").select("p_size", F.round("z", 6).alias("z"), F.round("error_pct", 6).alias("error_pct"))


@query(
    "z17_dispersion",
    """WITH l AS (SELECT p_partkey, p_size * 1e8::DOUBLE AS f FROM part), c AS (SELECT *, ln((1e24::DOUBLE + f * f) / (1e6::DOUBLE + f * f)) / 2 AS re, atan(f / 1e12::DOUBLE) - atan(f / 1e3::DOUBLE) AS im,
  ln((1e24::DOUBLE + 1e18) / (1e6::DOUBLE + 1e18)) / 2 AS re0, atan(1e9::DOUBLE / 1e12) - atan(1e9::DOUBLE / 1e3) AS im0 FROM l)
SELECT p_partkey, floor((4.4 + 4.4 * 0.02 / im0 * (re0 - re)) * 1000 + 0.5) / 1000 AS er, floor(-4.4 * 0.02 / im0 * im * 100000 + 0.5) / 100000 AS loss FROM c""",
)
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    e = C.dispersive_permittivity(F.lit(4.4), F.lit(0.02), F.lit(1e9), F.col("p_size") * 1e8)
    rows = read(spark, d, "part").select("p_partkey", e.alias("e"))
    return rows.select("p_partkey", (F.floor(F.col("e.re") * 1000 + 0.5) / 1000).alias("er"), (F.floor(F.col("e.im") * 100000 + 0.5) / 100000).alias("loss"))


@query(
    "z20_loss",
    MICROSTRIP.replace(TRACKS, "WITH t AS (SELECT 0.36::DOUBLE AS w, 0.2104::DOUBLE AS h) ")
    + """, m AS (SELECT zr / sqrt(e) AS z0, e * pow(z1 / zr, 2) AS e_eff FROM f), p AS (SELECT DISTINCT p_size, p_size * 1e9::DOUBLE AS hz FROM part),
r AS (SELECT *, 1 / (sqrt(1 / (pi() * hz * (4e-7::DOUBLE * pi()) * 5.8e7::DOUBLE)) * 5.8e7::DOUBLE) AS rs, 20 / ln(10) AS per FROM p, m)
SELECT p_size, round(rs / (2 * z0 * 0.36e-3::DOUBLE) * per, 6) AS conductor, round(pi() * hz / 299792458.0::DOUBLE * (4.4::DOUBLE * (e_eff - 1) / (sqrt(e_eff) * 3.4::DOUBLE)) * 0.02::DOUBLE * per, 6) AS dielectric FROM r""",
)
def loss(spark: SparkSession, d: str) -> DataFrame:
    m = lines.microstrip(F.lit(0.36), F.lit(0.2104), F.lit(0.035), F.lit(4.4))
    f = F.col("p_size") * 1e9
    resistance = 1 / (lines.skin_depth(f, F.lit(5.8e7)) * 5.8e7)
    rows = read(spark, d, "part").select("p_size").distinct().select("p_size", m.alias("m"), resistance.alias("rs"))
    parts = C.loss_db(F.col("m.z0"), F.col("m.e_eff"), F.lit(4.4), F.lit(0.02), F.lit(0.36e-3), F.col("rs"), f)
    return rows.select("p_size", parts.alias("l")).select("p_size", F.round("l.conductor", 6).alias("conductor"), F.round("l.dielectric", 6).alias("dielectric"))


@query(
    "z21_s_parameters",
    """WITH p AS (SELECT DISTINCT p_size, exp(-0.02::DOUBLE) AS a, p_size / 10.0::DOUBLE AS b, 10.0::DOUBLE / 110 AS g FROM part),
q AS (SELECT *, a * a * cos(2 * b) AS cr, -a * a * sin(2 * b) AS ci, a * cos(b) AS pr, -a * sin(b) AS pi FROM p), n AS (SELECT *, 1 - g * g * cr AS dr, -g * g * ci AS di FROM q)
SELECT p_size, floor(((g * (1 - cr)) * dr + (-g * ci) * di) / (dr * dr + di * di) * 1e6 + 0.5) / 1e6 AS s11_re, floor((pr * dr + pi * di) * (1 - g * g) / (dr * dr + di * di) * 1e6 + 0.5) / 1e6 AS s21_re FROM n""",
)
def s_parameters(spark: SparkSession, d: str) -> DataFrame:
    s = C.s_parameters(F.lit(60.0), F.lit(50.0), F.lit(0.02), F.col("p_size") / 10.0)
    rows = read(spark, d, "part").select("p_size").distinct().select("p_size", s.alias("s"))
    six = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return rows.select("p_size", six("s.s11.re").alias("s11_re"), six("s.s21.re").alias("s21_re"))


@query("z22_route_analysis")
def route_analysis(spark: SparkSession, d: str) -> DataFrame:
    tracks = _tracks(spark, d).withColumn("w", 0.1 + F.col("y1") / 20)
    return analysed(tracks.select("l_orderkey", "x1", "y1", "x2", "y2"), tracks.select("l_orderkey", "x1", "y1", "x2", "y2", "w").groupBy("l_orderkey", "x1", "y1", "x2", "y2").agg(F.min("w").alias("w")), ["l_orderkey"], 0.2, 4.4, 50.0, 5.0)


def analysed(tracks: DataFrame, widths: DataFrame, net: list[str], h: float, er: float, target: float, tolerance: float) -> DataFrame:
    """Each net's tracks walked in order, every distinct width's impedance, and the summary by length: with how often the width changes on the way."""
    walked = matching.route_walk(tracks, net).join(widths, [*net, "x1", "y1", "x2", "y2"])
    z = walked.select("w").distinct().select("w", F.floor(lines.microstrip(F.col("w"), F.lit(h), F.lit(0.035), F.lit(er))["z0"] * 1000 + 0.5).alias("z_milli"))
    rows = walked.join(z, "w").withColumn("z", F.col("z_milli") / 1000).withColumn("length", F.col("s1") - F.col("s0"))
    rows = rows.withColumn("change", (F.col("w") != before("w", net, ["seq"])).cast("int"))
    changes = rows.groupBy(*net).agg(F.coalesce(F.sum("change"), F.lit(0)).alias("width_changes"))
    return summary(rows.filter("length > 0"), net, "z", "length", target, tolerance).join(changes, net)


def read_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A folder or archive of fabrication files as tables: files, placements, bill, drills, plots, outlines, stackup, jobs, and components.

    Components are the placements with what the bill says of them; a part the bill leaves out counts as populated, the last listing of a placement wins.
    """
    scanned = files.expand(files.scan(spark, path)).filter("problem IS NULL").drop("problem")
    kinds = files.classified(scanned)
    of = lambda *k: scanned.join(kinds.filter(F.col("kind").isin(*k)).select("path"), "path", "left_semi")
    placements = sheets.read_placements(of("placement"))
    bill = sheets.read_bill(of("bom"))
    listed = bill.select(F.explode("designators").alias("ref"), "row_number", "populate", "mpn", "manufacturer")
    per = listed.groupBy("ref").agg(F.bool_and("populate").alias("populate"), F.min_by("mpn", "row_number").alias("mpn"), F.min_by("manufacturer", "row_number").alias("manufacturer"))
    placed = placements.filter("problem IS NULL").groupBy("ref").agg(F.max_by(F.struct("value", "footprint", "x", "y", "rotation", "side"), "path").alias("p")).select("ref", "p.*")
    stack = trees.read_stackup(of("job"))
    return {
        "files": kinds,
        "placements": placements,
        "bill": bill,
        "drills": drills.read_drills(of("drill")),
        "plots": plots.read_plots(of("copper", "mask", "paste", "silkscreen")),
        "outlines": plots.read_outlines(of("outline")),
        "jobs": trees.read_jobs(of("job")),
        "stackup": layered(stack.withColumn("at", F.col("seq")), ["path", "type", "name"], "thickness", "permittivity", "loss", "material"),
        "components": placed.join(per, "ref", "full_outer").withColumn("populate", F.coalesce("populate", F.lit(True))),
    }


def hole_pads(holes: DataFrame, pads: DataFrame, reach: float = 0.05) -> DataFrame:
    """Whether each hole (seq, x, y, plated) has a pad (px, py) on it: plated as its file says, else as its pads show; with how that is known."""
    hit = grid_join(holes.select("seq", "x", "y"), pads.select("px", "py"), ("x", "y"), ("px", "py"), reach).select("seq").distinct().withColumn("pad", F.lit(True))
    rows = holes.join(hit, "seq", "left")
    return rows.select("seq", F.coalesce("plated", "pad", F.lit(False)).alias("plated"), F.when(F.col("plated").isNotNull(), "file").when(F.col("pad"), "pad").otherwise("none").alias("how"))

