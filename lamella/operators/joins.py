"""Joins and matching, by column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.text import glob_regex


def pattern_assign(rows: DataFrame, name: str, rules: list[tuple[str, str, int | None]], default: str = "Default", out: str = "class") -> DataFrame:
    """rows with the class of the first rule (class, pattern, priority) of the lowest priority that matches; a null priority comes last.

    The rules are the query's own constants: one CASE in their order, no join.
    """
    ranked = sorted(enumerate(rules), key=lambda r: ((1 << 31) if r[1][2] is None else r[1][2], r[0]))
    chosen = None
    for _, (label, pattern, _) in ranked:
        regex = glob_regex(pattern)
        if regex is not None:
            hit = F.col(name).rlike(regex)
            chosen = F.when(hit, F.lit(label)) if chosen is None else chosen.when(hit, F.lit(label))
    return rows.withColumn(out, F.lit(default) if chosen is None else chosen.otherwise(F.lit(default)))


def suffix_pairs(rows: DataFrame, name: str, positive: str, negative: str) -> DataFrame:
    """Pairs (positive, negative, stem): names equal but for these endings. Each name is in one pair at most."""
    stem = lambda end: F.when(F.endswith(F.col(name), F.lit(end)), F.expr(f"left({name}, length({name}) - {len(end)})"))
    names = rows.select(name).distinct()
    p = names.select(F.col(name).alias("positive"), stem(positive).alias("stem")).filter("stem <> ''")
    n = names.select(F.col(name).alias("negative"), stem(negative).alias("stem")).filter("stem <> ''")
    return p.join(n, "stem").select("positive", "negative", "stem")


def capture_pairs(left: DataFrame, right: DataFrame, name: str, left_regex: str, right_regex: str) -> DataFrame:
    """Names of both sides whose captured groups are equal; the first right name of a key wins."""
    a = left.select(F.col(name).alias("positive"), F.regexp_extract(name, left_regex, 1).alias("key")).filter("key <> ''")
    b = right.select(F.col(name).alias("negative"), F.regexp_extract(name, right_regex, 1).alias("key")).filter("key <> ''")
    return a.join(b.groupBy("key").agg(F.min("negative").alias("negative")), "key").select("positive", "negative", "key")


def overlap_join(rows: DataFrame, other: DataFrame, on: list[str], lo: str, hi: str, seq: str, cell: float) -> DataFrame:
    """Pairs (a, b, overlap) of rows of a key whose intervals overlap by more than nothing, a before b by seq.

    Intervals are dealt to cells of a fixed length, so that a key with very many rows doesn't meet itself
    in one task; a pair is kept in the cell where its overlap begins.
    """

    def dealt(x: DataFrame, tag: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long"))
        return x.select(*on, F.explode(cells).alias("_cell"), F.col(seq).alias(f"{tag}_seq"), F.col(lo).alias(f"{tag}_lo"), F.col(hi).alias(f"{tag}_hi"))

    both = dealt(rows, "a").join(dealt(other, "b"), [*on, "_cell"]).filter("a_seq < b_seq")
    start, end = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    both = both.withColumn("_from", start).withColumn("overlap", end - start)
    return both.filter((F.col("overlap") > 0) & (F.floor(F.col("_from") / cell) == F.col("_cell"))).drop("_cell", "_from")


def grid_join(left: DataFrame, right: DataFrame, x: tuple[str, str], y: tuple[str, str], reach: float) -> DataFrame:
    """Rows of both sides within `reach` of each other, with `distance`: an equi-join on cells of that size, the left in its 3 x 3."""
    (lx, ly), (rx, ry) = x, y
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    a = left.withColumn("_near", near).withColumn("_cx", cell(lx) + F.col("_near.i")).withColumn("_cy", cell(ly) + F.col("_near.j")).drop("_near")
    b = right.withColumn("_cx", cell(rx)).withColumn("_cy", cell(ry))
    distance = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    return a.join(b, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("distance", distance).filter(F.col("distance") <= reach)


def nearest(pairs: DataFrame, keys: list[str], distance: str, name: str) -> DataFrame:
    """For each key the name at the least distance, ties to the smaller name."""
    return pairs.groupBy(*keys).agg(F.min(F.struct(F.col(distance).alias("d"), F.col(name).alias("n"))).alias("_m")).select(*keys, F.col("_m.n").alias(name), F.col("_m.d").alias(distance))


def multiset_diff(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: added, removed and unchanged, as many as it has; two counts, not a row for each copy."""
    count = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    both = count(base, "_b").join(count(head, "_h"), keys, "full_outer")
    b, h = F.coalesce("_b", F.lit(0)), F.coalesce("_h", F.lit(0))
    return both.select(*keys, F.greatest(h - b, F.lit(0)).alias("added"), F.greatest(b - h, F.lit(0)).alias("removed"), F.least(b, h).alias("unchanged"))


def partition_agreement(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """For each true class: how many found ones it falls into and how many of those it shares; matched, split, merged or missing."""
    pairs = rows.select(truth, found).distinct()
    shared = pairs.filter(F.col(found).isNotNull()).groupBy(found).agg(F.count("*").alias("_shared"))
    per = pairs.join(shared, found, "left").groupBy(truth).agg(F.count(found).alias("parts"), F.max("_shared").alias("shared"))
    verdict = F.when(F.col("parts") == 0, "missing").when(F.col("parts") > 1, "split").when(F.col("shared") > 1, "merged").otherwise("matched")
    return per.select(truth, "parts", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), verdict.alias("verdict"))


def bridges(rows: DataFrame, part: str, unit: str, foreign: Column) -> DataFrame:
    """(unit_a, unit_b, parts): parts with a row in both units and none that is foreign."""
    pads = rows.select(F.col(part).alias("p"), F.col(unit).alias("u"), foreign.alias("f"))
    own = pads.groupBy("p").agg(F.collect_set("u").alias("us"), F.max(F.col("f").cast("int")).alias("f")).filter((F.col("f") == 0) & (F.size("us") > 1))
    pairs = own.select("p", F.explode(F.expr("filter(flatten(transform(us, a -> transform(us, b -> struct(a, b)))), x -> x.a < x.b)")).alias("x"))
    return pairs.groupBy(F.col("x.a").alias("unit_a"), F.col("x.b").alias("unit_b")).agg(F.count("*").alias("parts"))


def foreign_keys(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """The rows whose value is not in the target; null values don't violate."""
    return rows.filter(F.col(column).isNotNull()).join(target.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")


def band_join(left: DataFrame, right: DataFrame, on: tuple[str, str], x: str, y: str, reach: float) -> DataFrame:
    """Rows of both sides of one key whose x and y are at most `reach` apart, with `distance`: an equi-join on the key and cells of that width, so that a
    key with very many rows doesn't meet itself whole."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    a = left.withColumn("_c", F.explode(F.sequence(cell(x) - 1, cell(x) + 1)))
    b = right.withColumn("_d", cell(y))
    distance = F.abs(F.col(x) - F.col(y))
    return a.join(b, (F.col(on[0]) == F.col(on[1])) & (F.col("_c") == F.col("_d"))).drop("_c", "_d").withColumn("distance", distance).filter(F.col("distance") <= reach)


def next_other(rows: DataFrame, marks: DataFrame, cell: str, owner: str, at: str, name: str) -> DataFrame:
    """For each mark (cell, owner, at) the first row (by at, name) of its cell that is not before it and has another owner: owner, and the row's at and name.

    Rows are read backwards in one order, each carrying the next of another owner: no pairs of marks and rows. Nulls are left out before.
    """
    back = Window.partitionBy(cell).orderBy(F.col(at).desc(), F.col(name).desc_nulls_last(), owner)
    later = F.lag(F.struct(at, name, owner)).over(back)
    rows = rows.select(cell, owner, at, name, later.alias("_next"))
    turn = F.when(F.col(f"_next.{owner}") != F.col(owner), F.struct(f"_next.{at}", f"_next.{name}"))  # the last row before another owner's
    rows = rows.withColumn("_turn", F.last(turn, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = rows.select(cell, owner, at, name, F.struct(at, name, owner, "_turn").alias("_row"))
    none = [F.lit(None).cast(both.schema[c].dataType).alias(c) for c in (name, "_row")]
    both = both.unionByName(marks.select(cell, owner, at, *none))
    found = both.withColumn("_first", F.last("_row", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))).filter("_row IS NULL")
    hit = F.when(F.col(f"_first.{owner}") != F.col(owner), F.struct(f"_first.{at}", f"_first.{name}")).otherwise(F.col("_first._turn"))
    return found.select(owner, hit.alias("_hit")).filter("_hit IS NOT NULL").select(owner, f"_hit.{at}", f"_hit.{name}")


def without_placeholders(hits: DataFrame, tools: DataFrame, keys: list[str], file: str, diameter: str) -> DataFrame:
    """For each file: how many hits are left without those of tools that have no diameter, and whether none is."""
    zero = tools.filter(F.coalesce(F.col(diameter), F.lit(0.0)) <= 0).select(*keys).distinct()
    left = hits.join(zero, keys, "left_anti").groupBy(file).agg(F.count("*").alias("hits"))
    return hits.select(file).distinct().join(left, file, "left").select(file, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.col("hits").isNull().alias("empty"))


def supply_nets(nets: DataFrame, name: str, planes: DataFrame, given: list, analysed: list, pattern: str) -> DataFrame:
    """nets with `supply`: named so, solid on a plane, or given; but never one that is being analysed."""
    solid = planes.filter("solid").select(F.col(name).alias("_n")).distinct()
    rows = nets.join(solid, F.col(name) == F.col("_n"), "left")
    found = F.col(name).rlike(pattern) | F.col("_n").isNotNull() | F.col(name).isin(given)
    return rows.withColumn("supply", found & ~F.col(name).isin(analysed)).drop("_n")


def overridden(rows: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the overrides' values of these columns where there are any (not null)."""
    own = [c for c in rows.columns if c not in columns]
    other = overrides.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_o_{c}") for c in columns])
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return rows.join(other, same, "left").select(*own, *[F.coalesce(f"_o_{c}", c).alias(c) for c in columns])


def by_role(files: DataFrame, board: str, role: str, index: str, seq: str) -> DataFrame:
    """files with slot (the role, if the file is the first of its board to claim it; else other) and place (inner layers in order of their index, from 1)."""
    claim = Window.partitionBy(board, role, index).orderBy(seq)
    first = files.withColumn("slot", F.when(F.row_number().over(claim) == 1, F.col(role)).otherwise("other"))
    inner = (F.col("slot") == "inner").cast("int")
    return first.withColumn("place", F.when(F.col("slot") == "inner", F.sum(inner).over(Window.partitionBy(board).orderBy(F.col("slot") != "inner", index, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow))).cast("int"))


def impedance_violations(classes: DataFrame, key: str, layers: DataFrame, name: str, most: float) -> DataFrame:
    """rule and key of the classes (class, target, tolerance, layer) that break a rule: names are unique, targets positive, tolerances between 0 and
    `most` percent, and layers exist. Nulls break none."""
    twice = classes.groupBy("class").agg(F.count("*").alias("_c")).filter("_c > 1").select("class")
    broken = lambda rule, rows: rows.select(F.lit(rule).alias("rule"), key)
    return (
        broken("unique_class", classes.join(twice, "class", "left_semi"))
        .unionByName(broken("target_positive", classes.filter("target <= 0")))
        .unionByName(broken("tolerance_range", classes.filter((F.col("tolerance") < 0) | (F.col("tolerance") > most))))
        .unionByName(broken("fk_layer", foreign_keys(classes, "layer", layers, name)))
    )
