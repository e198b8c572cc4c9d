"""Matching, walking, the field solver, and whole packages."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamella.functions import fieldsolver, geometry
from lamella.functions.text import glob_regex
from lamella.operators import graph, joins, matching, ordered
from lamella.plans import boards
from lamella.sources import sheets
from lamella.sources.plots import stitched
from tests.test_sources import DRILL, PLOT


def test_greedy_and_guarded(spark):
    rows = [(1, "a", "x", 1.0), (1, "a", "y", 1.5), (1, "b", "x", 1.2), (1, "b", "y", 9.0), (2, "c", "z", 0.1), (2, "c", "w", 5.0)]
    pairs = spark.createDataFrame(rows, "g int, l string, r string, d double")
    assert sorted(tuple(r) for r in matching.greedy_pairs(pairs, ["g"], "l", "r", "d").collect()) == [(1, "a", "x", 1.0), (1, "b", "y", 9.0), (2, "c", "z", 0.1)]
    assert sorted(tuple(r) for r in matching.guarded_nearest(pairs, ["g"], "l", "r", "d").collect()) == [(2, "c", "z", 0.1)]


def test_registration(spark):
    rng = np.random.default_rng(0)
    a = rng.random((12, 2)) * 50
    b = np.column_stack([-a[:, 1] + 3, -a[:, 0] - 7])  # mirrored, then a quarter turn
    rows = [(1, *map(float, (*p, *q))) for p, q in zip(a, b)]
    rows[5] = (1, *rows[5][1:3], 900.0, 900.0)  # an outlier
    r = matching.registered(spark.createDataFrame(rows, "g int, x0 double, y0 double, x1 double, y1 double"), ["g"], ("x0", "x1"), ("y0", "y1")).first()
    assert r.mirrored and r.used == 11 and r.rms < 1e-6


def test_route_walk(spark):
    tracks = [(1, 0.0, 0.0, 1.0, 0.0), (1, 2.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0, 5.0), (1, 9.0, 9.0, 9.0, 8.0)]
    rows = matching.route_walk(spark.createDataFrame(tracks, "n int, x1 double, y1 double, x2 double, y2 double"), ["n"]).orderBy("seq").collect()
    assert [(r.x1, r.forward, r.s0, r.s1) for r in rows] == [(0.0, True, 0.0, 1.0), (1.0, True, 1.0, 6.0), (2.0, False, 1.0, 2.0), (9.0, False, 0.0, 1.0)]


def test_chain_and_topology(spark):
    links = spark.createDataFrame([(1, "b", "c"), (1, "a", "b"), (1, "d", "c")], "g int, a string, b string")
    assert [r.unit for r in matching.chain_order(links, ["g"], "a", "b").orderBy("place").collect()] == ["a", "b", "c", "d"]
    shapes = {
        "two_ends": [(0, 0), (1, 0)], "one_row": [(i, 0) for i in range(5)], "two_rows": [(i, j) for i in range(5) for j in (0, 3)],
        "grid": [(i, j) for i in range(4) for j in range(3)], "four_rows": [(i, j) for i in (0, 5) for j in (1, 2, 3)] + [(i, j) for j in (0, 4) for i in (1, 2, 3)] , "irregular": [(0, 0), (1, 2), (4, 1)],
    }
    shapes["four_rows"] += [(0, 0), (5, 0), (0, 4), (5, 4)]
    pads = spark.createDataFrame([(k, float(x), float(y)) for k, v in shapes.items() for x, y in v], "part string, x double, y double")
    assert {r.part: r.pattern for r in matching.topology(pads, ["part"]).collect()} == {k: k for k in shapes}


def test_resolve(spark):
    nodes = spark.createDataFrame([(1, "R5_1", 0.0, 0.0), (2, "R5 (2)", 0.0, 0.0), (3, "R11", 20.0, 20.0), (4, "body", 10.0, 10.1)], "node int, name string, x double, y double")
    parts = spark.createDataFrame([("R1", 0.0, 0.0), ("R5", 0.0, 0.0), ("C9", 10.0, 10.0)], "ref string, x double, y double")
    assert {r.node: (r.ref, r.how) for r in matching.resolved(nodes, parts, 1.0).collect()} == {1: ("R5", "name"), 2: ("R5", "name"), 4: ("C9", "position")}


def test_graph(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 41), (50, 50)], "a int, b int")
    comp = {r.node: r.component for r in graph.components(edges).collect()}
    assert comp == {**{i: 1 for i in range(1, 31)}, 40: 40, 41: 40}
    assert sorted(r.node for r in graph.reachable(edges, spark.createDataFrame([(28,)], "node int")).collect()) == [28, 29, 30]
    assert graph.components(edges.limit(0)).count() == 0


def test_field_solver():
    z, e, error = fieldsolver.impedance("microstrip", 0.36, 0.2104, 0.035, 4.4)
    assert abs(z / 50.92 - 1) < 0.015 and abs(e / 3.176 - 1) < 0.015 and error < 2
    assert abs(fieldsolver.impedance("stripline", 0.3, 0.4825, 0.035, 4.0)[0] / 58.82 - 1) < 0.01
    near, far = (fieldsolver.impedance("coupled_microstrip", 0.36, 0.2104, 0.035, 4.4, gap=g)[0] for g in (0.1, 3.0))
    assert near < far and abs(far / 101.84 - 1) < 0.02
    assert fieldsolver.impedance("coated", 0.36, 0.2104, 0.035, 4.4, coat=0.02)[0] < z


def test_unfracture():
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 5), (2, 5), (2, 7), (4, 7), (4, 5), (2, 5), (0, 5)]
    got = geometry.unfracture([(float(x), float(y)) for x, y in ring])
    assert [len(r) for r in got] == [5, 4]


def test_package(spark, tmp_path):
    (tmp_path / "fab").mkdir()
    (tmp_path / "fab" / "b-PTH.drl").write_text(DRILL)
    (tmp_path / "fab" / "b-F_Cu.gbr").write_text("%TF.FileFunction,Copper,L1,Top*%\n" + PLOT)
    (tmp_path / "fab" / "pos.csv").write_text("Ref,Val,Package,PosX,PosY,Rot,Side\nC1,1n,C,1,2,0,top\nR9,1k,R,3,4,0,bottom\n")
    (tmp_path / "fab" / "bom.csv").write_text('Reference,Value,Footprint,Populate,MPN\n"C1,C2",1n,C,no,M1\n')
    board = boards.read_package(spark, str(tmp_path / "fab"))
    got = {r.ref: (r.x, r.populate, r.mpn) for r in board["components"].collect()}
    assert got == {"C1": (1.0, False, "M1"), "C2": (None, False, "M1"), "R9": (3.0, True, None)}
    assert board["drills"].count() == 5 and board["plots"].count() == 4
    assert sorted(r.kind for r in board["files"].collect()) == ["bom", "copper", "drill", "placement"]
    pads = spark.createDataFrame([(1.0, 2.01)], "px double, py double")
    how = {r.seq: r.how for r in boards.hole_pads(board["drills"].select("seq", "x", "y", F.when(F.col("seq") > 1, F.col("plated")).alias("plated")), pads).collect()}
    assert how == {0: "pad", 1: "none", 2: "file", 3: "file", 4: "file"}


@pytest.mark.parametrize(
    "pattern,name,hit",
    [("USB_D{P,N}", "usb_dp", True), ("USB_D{P,N}", "/cpu/USB_DN", True), ("A/B*", "x/A/Bc", False), ("DQ[0-7]", "DQ8", False), ("DQ[!0-7]", "DQ8", True), ("re:x.+", "XYZ", True), ("a.b", "aXb", False)],
)
def test_glob(pattern, name, hit):
    import re

    assert bool(re.search(glob_regex(pattern), name)) is hit
    assert glob_regex("re:(") is None and glob_regex("a{b") == "(?i)^(?:.*/)?(?:a\\{b)$"


@settings(max_examples=20, deadline=None)
@given(st.permutations(range(6)), st.lists(st.booleans(), min_size=6, max_size=6))
def test_stitching_whatever_the_direction(order, turned):
    corners = [(math.cos(k), math.sin(k)) for k in range(6)]
    sides = [[corners[k], corners[(k + 1) % 6]] for k in range(6)]
    loops = stitched([sides[k][::-1] if turned[k] else sides[k] for k in order])
    assert len(loops) == 1 and len(loops[0]) == 6


def test_set_laws(spark):
    rows = spark.createDataFrame(list(itertools.product("ab", [1, 2, 2])), "k string, v int")
    same = joins.multiset_diff(rows, rows, ["k", "v"]).collect()
    assert all(r.added == r.removed == 0 for r in same) and sum(r.unchanged for r in same) == 6
    once = ordered.first_wins(rows, ["k", "v"], ["v"])
    assert ordered.first_wins(once, ["k", "v"], ["v"]).count() == once.count() == 4


def test_coupled_solves_every_size(spark, sf):
    from lamella.plans.boards import QUERIES

    sizes = {r.p_size for r in spark.read.parquet(f"{sf}/part.parquet").select("p_size").distinct().collect()}
    assert any(x % 5 for x in sizes)
    assert sorted(r.p_size for r in QUERIES["z06_coupled"](spark, sf).collect()) == sorted(sizes)


def test_nested_rings():
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    got = geometry.nested_rings([square(2, 2, 2), square(0, 0, 10), square(2.5, 2.5, 0.5), square(20, 0, 5), square(6, 6, 1)])
    assert [(o[0], sorted(h[0] for h in holes)) for o, holes in got] == [((0, 0), [(2, 2), (6, 6)]), ((20, 0), []), ((2.5, 2.5), [])]


def test_columns_as_the_caller_says():
    text = "x,y,z\nPos,Teil,Marke,Stück\nR1 R2,10k,ACME,2\n"
    assert sheets.bill(text) == []
    got = sheets.bill(text, {"reference": "pos", "value": "Teil", "manufacturer": "Marke"})
    assert [(r[1], r[2], r[5]) for r in got] == [(["R1", "R2"], "10k", "ACME")]
    assert [(r[1], r[2]) for r in sheets.bill("Ref,Value\nno,head\nRef,Value\nR9,1k\n", header_row=2)] == [(["R9"], "1k")]
    assert sheets.bill(text, header_row=99) == [] and sheets.bill(text, {"reference": "nowhere"}) == []
    rows = sheets.placements("a,b\nWer,rechts,hoch\nU1,1,2\n", {"ref": "Wer", "x": "rechts", "y": "hoch"})
    assert rows == [("U1", "", "", 1.0, 2.0, 0.0, "top", None)]


def test_script_numbers(spark):
    from lamella.functions.text import script_number

    values = {1.0: "1", -0.5: "-0.5", 0.1: "0.1", 1e21: "1e+21", 1e-7: "1e-7", 0.00001: "0.00001", 123456789012.0: "123456789012", 1.5e300: "1.5e+300"}
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", script_number(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in got} == values


def test_greedy_and_guarded_pairs_are_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(a), int(b), float(d)) for g in range(4) for a, b, d in {(int(a), int(b)): (a, b, d) for a, b, d in zip(rng.integers(0, 9, 40), rng.integers(0, 9, 40), rng.integers(1, 60, 40))}.values()]
    df = spark.createDataFrame(rows, "g int, a int, b int, d double")
    greedy, guarded = [], []
    for g in range(4):
        left = sorted((d, a, b) for k, a, b, d in rows if k == g)
        while left:
            d, a, b = left[0]
            greedy.append((g, a, b, d))
            left = [x for x in left if x[1] != a and x[2] != b]
        left = [(d, a, b) for k, a, b, d in rows if k == g]
        while True:
            sure = []
            for d, a, b in left:
                of_a, of_b = sorted(x for x in left if x[1] == a), sorted(x for x in left if x[2] == b)
                if of_a[0][1:] == (a, b) and of_b[0][1:] == (a, b) and all(d < 0.5 * x[0] for x in (*of_a[1:2], *of_b[1:2])):
                    sure.append((d, a, b))
            if not sure:
                break
            guarded += [(g, a, b, d) for d, a, b in sure]
            left = [x for x in left if x[1] not in {s[1] for s in sure} and x[2] not in {s[2] for s in sure}]
    assert sorted(map(tuple, matching.greedy_pairs(df, ["g"], "a", "b", "d").collect())) == sorted(greedy)
    assert sorted(map(tuple, matching.guarded_nearest(df, ["g"], "a", "b", "d").collect())) == sorted(guarded)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_route_walks_share_batches(spark):
    """Groups over the borders of batches, null and not-a-number keys; no call for each group."""
    rng = np.random.default_rng(1)
    rows = [(k, *map(float, rng.integers(0, 4, 4))) for k in (None, math.nan, 0.5, *map(float, range(1, 30))) for _ in range(rng.integers(1, 9))]
    tracks = spark.createDataFrame(rows, "n double, x1 double, y1 double, x2 double, y2 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        walks = matching.route_walk(tracks, ["n"])
        got = walks.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((repr(r.n), r.x1, r.y1, r.x2, r.y2) for r in got) == sorted((repr(n), *x) for n, *x in rows)
    by = {}
    for r in got:
        by.setdefault(repr(r.n), []).append(r)
    for walk in by.values():
        walk.sort(key=lambda r: r.seq)
        assert [r.seq for r in walk] == list(range(len(walk)))
        reached = {}
        for r in walk:
            a, b = ((r.x1, r.y1), (r.x2, r.y2))[:: 1 if r.forward else -1]
            assert r.s0 in reached.get(a, {0.0}) and r.s1 - r.s0 == pytest.approx(math.dist(a, b))
            reached.setdefault(a, set()).add(r.s0)
            reached.setdefault(b, set()).add(r.s1)
    assert "FlatMapGroupsInPandas" not in _plan(walks)


def test_chains_share_batches(spark):
    rows = [(k, i, i + 1) for k in range(40) for i in range(k % 5)] + [(None, 7, 3), (99, 4, None), (99, None, None)]
    links = spark.createDataFrame(rows, "g int, a int, b int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        chains = matching.chain_order(links, ["g"], "a", "b")
        got = {(r.g, r.place): r.unit for r in chains.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, i): i for k in range(40) if k % 5 for i in range(k % 5 + 1)} | {(None, 0): 3, (None, 1): 7, (99, 0): 4}
    assert "FlatMapGroupsInPandas" not in _plan(chains)


def test_topology_of_odd_pads(spark):
    """Rows of Spark's own operators: copies count, what has no place doesn't hold a row or column, places are kept to a hundredth."""
    parts = {
        1: ([(0.0, 0.0), (1.0, 0.001)], "two_ends"),
        2: ([(0.0, 0.0)] * 3, "one_row"),
        3: ([(float(x), float(y)) for x in range(3) for y in range(3)], "grid"),
        4: ([(0.0, float(y)) for y in range(3)] + [(-0.004, 5.0), (2.0, 0.0), (2.0, 7.0)], "two_rows"),
        5: ([(0.0, 1.0), (0.0, 2.0), (3.0, 1.0), (3.0, 2.0), (1.0, 0.0), (2.0, 0.0), (1.0, 3.0), (2.0, 3.0)], "four_rows"),
        6: ([(0.0, 1.0), (0.0, 2.0), (3.0, 1.0), (3.0, 2.0), (1.0, 0.0), (2.0, 0.0), (1.0, 3.0), (2.0, 3.0), (1.5, 1.5)], "irregular"),
        7: ([(None, 0.0), (1.0, 1.0), (1.0, math.nan)], "one_row"),
    }
    pads = spark.createDataFrame([(k, *p) for k, (points, _) in parts.items() for p in points], "part int, x double, y double")
    found = matching.topology(pads, ["part"])
    assert {r.part: (r.pads, r.pattern) for r in found.collect()} == {k: (len(p), kind) for k, (p, kind) in parts.items()}
    assert "InPandas" not in _plan(found)


def test_next_other_is_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), f"u{rng.integers(3)}", int(rng.integers(12)), i) for i in range(60)]
    marks = [(c, f"u{u}", at) for c in range(3) for u in range(4) for at in range(13)]
    found = joins.next_other(spark.createDataFrame(rows, "c int, u string, at int, k int"), spark.createDataFrame(marks, "c int, u string, at int").distinct(), "c", "u", "at", "k")
    want = [(u, *min(hits)) for c, u, at in marks if (hits := [(t, k) for d, v, t, k in rows if d == c and v != u and t >= at])]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_stale_zones_make_no_pairs(spark, sf):
    from lamella.plans.joining import QUERIES

    assert "BroadcastHashJoin [c" not in (plan := _plan(QUERIES["j16_theta_semi"](spark, sf))) and "SortMergeJoin [c" not in plan


@pytest.mark.parametrize("step", [1.0, 0.37])
def test_guarded_band_is_guarded_nearest(spark, step):
    """Also with names of several points, equal points, missing values, and without making the pairs."""
    rng = np.random.default_rng(6)
    side = lambda n: [(int(g), int(rng.integers(40)), float(rng.integers(90)) * step) for g in range(4) for _ in range(n * g)] + [(None, 1, 2.0), (1, 50, None), (1, 51, math.nan), (2, 52, math.inf)]
    a, b = spark.createDataFrame(side(8), "ga int, l long, x double"), spark.createDataFrame(side(12), "g int, r long, y double")
    pairs = joins.band_join(a.filter("x < 1e9"), b.filter("y < 1e9"), ("ga", "g"), "x", "y", 9.0)
    want = matching.guarded_nearest(pairs, ["g"], "l", "r", "distance").collect()
    got = matching.guarded_band(a, b, ("ga", "g"), "x", "y", ("l", "r"), 9.0)
    assert want and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "Join" not in _plan(got)


@pytest.mark.parametrize("step", [1.0, 0.37, 1e-17])
def test_nearest_band_has_the_nearest(spark, step):
    """As all pairs do, with ties, copies, missing values and values that rounding makes tie, and without a join."""
    rng = np.random.default_rng(7)
    side = lambda n: [(int(g), i, float(rng.integers(60)) * step) for g in range(4) for i in range(n * g)] + [(None, 1, 2.0), (1, 50, None), (1, 51, math.nan)]
    a = spark.createDataFrame([*side(4), (3, 90, 1.0)], "ga int, l long, x double")
    b = spark.createDataFrame(side(12), "g int, r long, y double")
    first = lambda df: sorted((r.l, r.r, r.y, r.distance) for r in df.withColumn("n", F.expr("row_number() over (partition by ga_l order by distance, y, r)")).filter("n <= 3").collect())
    want = first(joins.band_join(a.filter("x < 1e9"), b.filter("y < 1e9"), ("ga", "g"), "x", "y", 9.0).withColumn("ga_l", F.struct("l")))
    got = matching.nearest_band(a, b, ("ga", "g"), "x", "y", ("l", "r"), 9.0, 3)
    assert want and first(got.withColumn("ga_l", F.struct("l"))) == want
    assert "Join" not in _plan(got)
