"""Rows as files: documents, placement lists, network parameters, drill text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents(rows: DataFrame) -> DataFrame:
    """Each row as JSON text with every field, nulls too."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def _lines(rows: DataFrame, key: list[str], order: list[str], line: Column, head: Column | None = None, tail: Column | None = None) -> DataFrame:
    """One text per key: its lines in order, between a head and a tail."""
    parts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_l")))), lambda x: x["_l"]), "\n")]
    grouped = rows.groupBy(*key).agg(parts[0].alias("_b"))
    whole = F.concat_ws("\n", *[x for x in (head, F.col("_b"), tail) if x is not None], F.lit(""))
    return grouped.select(*key, whole.alias("value"))


def placement_csv(rows: DataFrame, key: list[str]) -> DataFrame:
    """Placement lists: text quoted, numbers with six decimals."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), '"', '""'), F.lit('"'))
    line = F.concat_ws(",", quoted("ref"), quoted("value"), quoted("footprint"), *[F.format_string("%.6f", F.col(c)) for c in ("x", "y", "rotation")], F.col("side"))
    return _lines(rows, key, ["ref"], line, F.lit("Ref,Val,Package,PosX,PosY,Rot,Side"))


def touchstone(rows: DataFrame, key: list[str], z0: float) -> DataFrame:
    """Two-port files from hertz, and s11, s21 as re and im: reciprocal and symmetric."""
    number = lambda c: F.format_string("%.9g", F.col(c))
    line = F.concat_ws(" ", F.format_string("%.9g", F.col("hertz")), *[number(c) for c in ("s11_re", "s11_im", "s21_re", "s21_im", "s21_re", "s21_im", "s11_re", "s11_im")])
    return _lines(rows, key, ["hertz"], line, F.lit(f"# Hz S RI R {z0:g}"))


def excellon(rows: DataFrame, key: list[str]) -> DataFrame:
    """Drill files, metric with decimals: a tool for each diameter, slots as G85."""
    um = F.floor(F.col("diameter") * 1000 + 0.5).cast("long")
    tools = rows.withColumn("_um", um)
    end = F.when(F.col("x2").isNotNull(), F.format_string("G85X%.4fY%.4f", F.col("x2"), F.col("y2"))).otherwise("")
    hit = F.concat(F.format_string("X%.4fY%.4f", F.col("x"), F.col("y")), end)
    per = tools.groupBy(*key, "_um").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", hit.alias("h")))), lambda x: x["h"]).alias("hits"))
    grouped = per.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_um", "hits"))).alias("t"))
    heads = F.transform("t", lambda x, i: F.format_string("T%dC%.3f", i + 1, x["_um"] / 1000.0))
    bodies = F.flatten(F.transform("t", lambda x, i: F.concat(F.array(F.format_string("T%d", i + 1)), x["hits"])))
    text = F.array_join(F.concat(F.array(F.lit("M48"), F.lit("METRIC,TZ")), heads, F.array(F.lit("%")), bodies, F.array(F.lit("M30"), F.lit(""))), "\n")
    return grouped.select(*key, text.alias("value"))
