"""Queries of the file readers over files that are written from the shared tables, one file for each group of rows; the SQL says what they have to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.sources import drills, plots, sheets
from lamella.tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _files(rows: DataFrame, path: Column, order: list[str], line: Column, head: str, tail: str = "") -> DataFrame:
    """path and content: a head, the rows' lines in order, and a tail. A file is bounded by its group, as files are."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    text = F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n" + tail))
    return rows.groupBy(path.alias("path")).agg(text.cast("binary").alias("content"))


def _text(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


@query(
    "s11_placements",
    """SELECT 'n' || s_nationkey || '.csv' AS path, 'U' || s_suppkey AS ref, s_acctbal AS x, s_suppkey / 4.0::DOUBLE AS y, CAST(s_suppkey % 360 AS DOUBLE) AS rotation, CASE WHEN s_suppkey % 2 = 0 THEN 'bottom' ELSE 'top' END AS side FROM supplier""",
)
def placements(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    line = F.concat_ws(",", F.concat(F.lit("U"), key.cast("string")), "s_name", F.lit("SO 8"), _text(F.col("s_acctbal"), 2), _text(key / 4, 2), (key % 360).cast("string"), F.when(key % 2 == 0, "Bottom").otherwise("top"))
    files = _files(read(spark, d, "supplier"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".csv")), ["s_suppkey"], line, "# placed by machine\nDesignator,Val,Package,Mid X,Mid Y,Rotation,Layer\n")
    return sheets.read_placements(files).select("path", "ref", "x", "y", "rotation", "side")


@query(
    "s12_bill",
    """SELECT p_brand AS path, unnest(['R' || p_partkey, 'C' || p_partkey]) AS ref, 2 AS quantity, p_type AS value, 'M' || p_size AS mpn, p_size % 3 <> 0 AS populate FROM part""",
)
def bill(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    line = F.concat_ws(";", F.concat(F.lit("R"), key, F.lit(", C"), key), F.lit("2"), "p_type", F.concat(F.lit("M"), F.col("p_size").cast("string")), F.when(F.col("p_size") % 3 == 0, "DNP").otherwise(""))
    files = _files(read(spark, d, "part"), F.col("p_brand"), ["p_partkey"], line, "Board 7\n\nRefDes;Qty;Value;Part Number;DNP\n")
    return sheets.read_bill(files).select("path", F.explode("designators").alias("ref"), "quantity", "value", "mpn", "populate")


@query(
    "s27_impedances",
    """SELECT p_brand AS path, 'Z' || p_size AS class, 40.0::DOUBLE + p_size AS target, 10.0::DOUBLE AS tolerance_pct, ['F.Cu', 'B.Cu'] AS layers, [0.1::DOUBLE * 0 + 0.254, 0.2] AS widths FROM (SELECT DISTINCT p_brand, p_size FROM part)""",
)
def impedances(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    name, target = F.concat(F.lit("Z"), size), F.concat((F.col("p_size") + 40).cast("string"), F.lit(" ohm"))
    line = F.concat(F.concat_ws(",", name, target, F.lit("10%"), F.lit("F.Cu"), F.lit("10mil")), F.lit("\n"), F.concat_ws(",", name, target, F.lit("10%"), F.lit("B.Cu"), F.lit("0.2 mm")))
    files = _files(read(spark, d, "part").select("p_brand", "p_size").distinct(), F.col("p_brand"), ["p_size"], line, "Net class,Impedance,Tol,Layer,Width\n")
    rows = sheets.read_impedances(files)
    return rows.select("path", "class", "target", "tolerance_pct", F.transform("layers", lambda x: x["layer"]).alias("layers"), F.transform("layers", lambda x: x["width"]).alias("widths"))


@query(
    "s08_drills",
    """SELECT 's' || l_suppkey || '.drl' AS path, l_quantity AS x, -l_linenumber / 4.0::DOUBLE AS y, l_linenumber / 10.0::DOUBLE AS diameter, l_linenumber % 2 = 1 AS slot, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def drill_files(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    at = F.concat(F.lit("X"), _text(F.col("l_quantity"), 1), F.lit("Y"), _text(-n / 4, 2))
    line = F.concat(F.lit("T"), n.cast("string"), F.lit("\n"), at, F.when(n % 2 == 1, F.concat(F.lit("G85X0.0Y1.0"))).otherwise(""))
    tools = "".join(f"T{k}C0.{k}00\n" for k in range(1, 8))
    files = _files(read(spark, d, "lineitem"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".drl")), ["l_orderkey", "l_linenumber"], line, f"M48\nMETRIC,TZ\n{tools}%\nG90\nG05\n", "T0\nM30\n")
    return drills.read_drills(files).groupBy("path", "x", "y", "diameter", F.col("x2").isNotNull().alias("slot")).agg(F.count("*").alias("n"))


X2 = "%FSLAX46Y46*%\n%MOMM*%\n"


def _plots(spark: SparkSession, d: str) -> DataFrame:
    """A plot for each supplier: a flash for each line, or a stroke for lines of odd number."""
    n = F.col("l_linenumber")
    x, y = (F.col("l_quantity") * 1_000_000).cast("long").cast("string"), (n * 250_000).cast("string")
    at = F.concat(F.lit("X"), x, F.lit("Y"), y)
    flash, stroke = F.concat(at, F.lit("D03*")), F.concat(at, F.lit("D02*\nX0Y"), y, F.lit("D01*"))
    line = F.concat(F.lit("D"), (n + 9).cast("string"), F.lit("*\n"), F.when(n % 2 == 1, stroke).otherwise(flash))
    apertures = "".join(f"%TA.AperFunction,{'ViaDrill' if k < 5 else 'ComponentDrill'}*%\n%ADD{k + 9}C,0.{k}*%\n%TD*%\n" for k in range(1, 8))
    return _files(read(spark, d, "lineitem"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string"), F.lit(".gbr")), ["l_orderkey", "l_linenumber"], line, f"%TF.FileFunction,Plated,1,4,PTH*%\n{X2}{apertures}G01*\n", "M02*\n")


@query(
    "s06_plots",
    """SELECT 'p' || l_suppkey || '.gbr' AS path, CASE WHEN l_linenumber % 2 = 1 THEN 'stroke' ELSE 'flash' END AS kind, l_linenumber / 10.0::DOUBLE AS width, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def plot_files(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("points", F.lit(0))
    return plots.read_plots(_plots(spark, d)).groupBy("path", "kind", "width", first["x"].alias("x")).agg(F.count("*").alias("n"))


@query(
    "s09_plot_drills",
    """SELECT 'p' || l_suppkey || '.gbr' AS path, l_quantity AS x, l_linenumber / 4.0::DOUBLE AS y, l_linenumber / 10.0::DOUBLE AS diameter, true AS plated, l_linenumber % 2 = 1 AS slot, CASE WHEN l_linenumber < 5 THEN 'ViaDrill' ELSE 'ComponentDrill' END AS function, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def plot_drills(spark: SparkSession, d: str) -> DataFrame:
    return drills.read_plot_drills(_plots(spark, d)).groupBy("path", "x", "y", "diameter", "plated", F.col("x2").isNotNull().alias("slot"), "function").agg(F.count("*").alias("n"))


@query(
    "s16_extents",
    """SELECT 'p' || l_suppkey || '.gbr' AS path, min(CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE l_quantity END) AS min_x, max(l_quantity) AS max_x, min(l_linenumber / 4.0::DOUBLE) AS min_y, max(l_linenumber / 4.0::DOUBLE) AS max_y FROM lineitem GROUP BY 1""",
)
def plot_extents(spark: SparkSession, d: str) -> DataFrame:
    return plots.extents(plots.read_plots(_plots(spark, d))).select("path", "min_x", "max_x", "min_y", "max_y")


@query(
    "s15_outline",
    """SELECT 'o' || p_partkey AS path, 0 AS contour, 4 AS corners, floor((p_size + 1) * 2.5::DOUBLE * 1000 + 0.5) / 1000 AS area FROM part""",
)
def outline_files(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle of four strokes, listed out of order."""
    w = ((F.col("p_size") + 1) * 1_000_000).cast("string")
    line = F.concat(F.lit("X0Y0D02*\nX"), w, F.lit("Y0D01*\nX"), w, F.lit("Y2500000D02*\nX0Y2500000D01*\nX"), w, F.lit("Y0D02*\nX"), w, F.lit("Y2500000D01*\nX0Y2500000D02*\nX0Y0D01*"))
    files = _files(read(spark, d, "part"), F.concat(F.lit("o"), F.col("p_partkey").cast("string")), ["p_partkey"], line, X2 + "%ADD10C,0.1*%\nD10*\nG01*\n", "M02*\n")
    return plots.read_outlines(files).select("path", "contour", F.size("points").alias("corners"), (F.floor(F.col("area") * 1000 + 0.5) / 1000).alias("area"))
