"""Weighted, modal and plurality aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.text import half_up, key_um


def exact(value: Column, places: int = 6) -> Column:
    """A double as a decimal: sums then don't depend on the order of rows."""
    return value.cast(f"decimal(28,{places})")


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(v * w) / sum(w) over rows with a value."""
    w = F.when(value.isNotNull(), weight)
    return F.sum(exact(value * weight)).cast("double") / F.sum(exact(w)).cast("double")


def summary(rows: DataFrame, keys: list[str], value: str, length: str, target: float, tolerance: float) -> DataFrame:
    """Length-weighted mean, least, most, the length out of tolerance, its percentage, and whether all is within."""
    z, n = F.col(value), F.col(length)
    out = F.when(F.abs(z - target) > tolerance, n).otherwise(F.lit(0))
    grouped = rows.groupBy(*keys).agg(
        weighted_mean(z, n).alias("mean"), F.min(z).alias("least"), F.max(z).alias("most"), F.sum(exact(n.cast("double"))).cast("double").alias("length"), F.sum(exact(out.cast("double"))).cast("double").alias("out")
    )
    return grouped.withColumn("out_percent", half_up(F.col("out") * 100 / F.col("length"), 3)).withColumn("within", F.col("out") == 0)


def dominant(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value with the most weight, ties to the smaller."""
    per = rows.groupBy(*keys, value).agg(F.sum(exact(F.col(weight))).alias("_w"))
    return per.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_w"), (-F.col(value)).alias("v"))).alias("dominant"), F.max("_w").cast("double").alias("weight"))


def modal_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The weighted mean within the bucket of a thousandth that has the most weight, ties to the smaller."""
    v, w = F.col(value), F.col(weight)
    per = rows.groupBy(*keys, key_um(v).alias("_b")).agg(F.sum(exact(w)).alias("_w"), F.sum(exact(v * w)).alias("_vw"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("_w", "_vw"), F.struct(F.col("_w"), (-F.col("_b")).alias("b"))).alias("_m"))
    return best.select(*keys, (F.col("_m._vw").cast("double") / F.col("_m._w").cast("double")).alias("modal"), F.col("_m._w").cast("double").alias("weight"))


def plurality(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The most common name, ties to the first in order, and all of them if there are several."""
    per = rows.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(name).alias("name"))).alias("_m"), F.sort_array(F.collect_set(name)).alias("_all")
    ).select(*keys, F.col("_m.name").alias("chosen"), (-F.col("_m.n")).alias("votes"), F.when(F.size("_all") > 1, F.array_join("_all", ",")).alias("merged"))


def vote(rows: DataFrame, dx: str, dy: str, cell: float) -> DataFrame:
    """The cell of offsets with most votes, its 3 x 3 neighbourhood counted: i, j, votes, score."""
    cells = rows.groupBy(F.floor(F.col(dx) / cell).cast("long").alias("i"), F.floor(F.col(dy) / cell).cast("long").alias("j")).agg(F.count("*").alias("votes"))
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(i + a as i, j + b as j))))"))
    scores = cells.select("votes", near.alias("c")).groupBy(F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.sum("votes").alias("score"))
    return cells.join(scores, ["i", "j"]).orderBy(F.col("score").desc(), F.col("votes").desc(), "i", "j").limit(1)


def shift(rows: DataFrame, keys: list[str], x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """The move that lays (x0, y0) on (x1, y1) best: dx, dy, and the root mean square of what is left."""
    a, b = F.col(x[1]) - F.col(x[0]), F.col(y[1]) - F.col(y[0])
    mean = lambda c: F.sum(exact(c)).cast("double") / F.count(c)
    left = (F.sum(exact(a * a)) + F.sum(exact(b * b))).cast("double") / F.count("*")
    grouped = rows.groupBy(*keys).agg(mean(a).alias("dx"), mean(b).alias("dy"), left.alias("_s"), F.count("*").alias("pairs"))
    rest = F.col("_s") - F.col("dx") * F.col("dx") - F.col("dy") * F.col("dy")
    return grouped.withColumn("rms", F.sqrt(F.greatest(F.lit(0.0), rest))).drop("_s")


def layered(rows: DataFrame, keys: list[str], thickness: str, permittivity: str, loss: str, material: str) -> DataFrame:
    """Sublayers folded: thickness, series permittivity (null unless all have one), weighted loss, materials."""
    t, e, d = F.col(thickness), F.col(permittivity), F.col(loss)
    total = F.sum(exact(t)).cast("double")
    return rows.groupBy(*keys).agg(
        total.alias("thickness"),
        F.when(F.count(e) == F.count("*"), total / F.sum(exact(t / e, 12)).cast("double")).alias("permittivity"),
        (F.sum(exact(t * d)).cast("double") / total).alias("loss"),
        F.array_join(F.array_sort(F.collect_set(material)), " + ").alias("materials"),
    )


def array_sum(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Arrays added element by element."""
    flat = rows.select(*keys, F.posexplode(array).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum(exact(F.col("_v").cast("double"), 9)).cast("double").alias("_s"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias(array))


def consolidated(rows: DataFrame, order: str, identity: Column, quantity: str, reference: str) -> DataFrame:
    """Rows of one reference and quantity 1 folded by identity; all rows as they are if any is not such."""
    plain = rows.filter((F.col(quantity) != 1) | F.col(quantity).isNull()).isEmpty()  # decided once, for all rows
    keyed = rows.withColumn("_key", identity if plain else F.concat(F.lit("#"), F.col(order).cast("string")))
    return keyed.groupBy("_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(reference).alias("r")))), lambda x: x["r"]), ",").alias("references"),
        F.sum(quantity).alias("quantity"),
    ).withColumnRenamed("_key", "identity")
