"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.tables import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is its smallest reachable node.

    Alternates large-star and small-star rounds until the edges stand still. Each is a minimum per
    node (combined before the shuffle) joined back to the edges, so a node with very many edges is
    split like any skewed join; the edges of a round are written to the shared folder.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = stored(edges.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = large.join(least, F.col("u") == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def labelled(pixels: DataFrame, x: str, y: str, width: int) -> DataFrame:
    """Pixels (distinct) with the region they belong to: node and component are x * width + y, neighbours touch by side or corner."""
    node = F.col(x) * width + F.col(y)
    steps = F.array(*[F.struct((F.col(x) + i).alias("nx"), (F.col(y) + j).alias("ny")) for i in (0, 1) for j in (-1, 0, 1) if (i, j) > (0, 0)])
    near = pixels.select(node.alias("a"), F.explode(steps).alias("s")).select("a", "s.nx", "s.ny")
    there = pixels.select(F.col(x).alias("nx"), F.col(y).alias("ny"), node.alias("b"))
    joined = components(near.join(there, ["nx", "ny"]).select("a", "b"))
    return pixels.select(node.alias("node")).join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reachable(edges: DataFrame, roots: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All nodes that can be reached from the roots (node), themselves included: a semi-naive round for each step."""
    links = stored(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct())
    seen = front = stored(roots.select("node").distinct())
    while not front.isEmpty():
        found = links.join(front, F.col("_a") == F.col("node"), "left_semi").select(F.col("_b").alias("node")).distinct()
        front = stored(found.join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def nested(rows: DataFrame, key: str, lo: str, hi: str, cell: float) -> DataFrame:
    """For each interval how many strictly enclose it, and the shortest of those (ties to the smaller key).

    What encloses an interval also holds its middle, so intervals are dealt to cells they cover, and each asks the cell of its middle.
    """
    cells = F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    outer = rows.select(F.col(key).alias("_k"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.explode(cells).alias("_c"))
    asked = rows.withColumn("_c", F.floor((F.col(lo) + F.col(hi)) / 2 / cell))
    inside = (F.col("_k") != F.col(key)) & (F.col("_lo") < F.col(lo)) & (F.col("_hi") > F.col(hi))
    found = asked.join(outer, "_c").filter(inside).groupBy(key).agg(F.count("*").alias("depth"), F.min(F.struct((F.col("_hi") - F.col("_lo")).alias("n"), "_k"))["_k"].alias("parent"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "parent")


def assembly(links: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """Occurrences of an assembly: node, path and matrix (16 numbers, by rows) of each, from links (parent, child, seq, matrix) and roots (node).

    One join a level; a level with nothing ends it. More than `most` levels are an error, as a node then holds itself.
    """
    unit = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    level = stored(roots.select("node", F.col("node").cast("string").alias("path"), unit.alias("matrix")))
    out = level
    edges = stored(links.select(F.col("parent").alias("_p"), F.col("child").alias("_c"), F.col("seq").alias("_s"), F.col("matrix").alias("_m")))
    product = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, k: s + F.get(F.col("matrix"), (F.floor(i / 4) * 4).cast("int") + k) * F.get(F.col("_m"), k * 4 + i % 4)),
    )
    for _ in range(most):
        level = stored(level.join(edges, F.col("node") == F.col("_p")).select(F.col("_c").alias("node"), F.concat_ws("/", "path", F.concat_ws(":", "_c", "_s")).alias("path"), product.alias("matrix")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"more than {most} levels")
