"""Readers and sinks on small literal files."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lamella.functions import lines
from lamella.functions import validation as V
from lamella.operators.aggregates import layered
from lamella.sources import drills, files, plots, sheets, sinks, trees

DRILL = """M48
; #@! TF.FileFunction,Plated,1,8,PTH
METRIC
; #@! TA.AperFunction,Plated,PTH,ViaDrill
T1C0.300
; #@! TA.AperFunction,NonPlated,NPTH,ComponentDrill
T2C1.000
%
G90
G05
T1
X1.0Y2.0
Y3.0
T2
X5.0Y5.0G85X7.0Y5.0
G00X1.0Y1.0
M15
G01X2.0Y1.0
M16
G05
X9.0Y9.0
M30
"""
PLOT = """%FSLAX46Y46*%
%MOMM*%
%TA.AperFunction,Conductor*%
%ADD10C,0.200000*%
%TD*%
%TA.AperFunction,ViaPad*%
%ADD11C,0.600000*%
%TD*%
G01*
%TO.N,GND*%
D10*
X0Y0D02*
X10000000Y0D01*
%TO.P,R1,2*%
D11*
X10000000Y0D03*
%TD*%
G36*
X0Y0D02*
X1000000Y0D01*
X1000000Y1000000D01*
X0Y0D01*
G37*
G75*
D10*
X2000000Y0D02*
G03*
X2000000Y0I-1000000J0D01*
M02*
"""


def content(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "."), v.encode() if isinstance(v, str) else v) for k, v in texts.items()], "path string, content binary")


def test_drills(spark):
    rows = drills.read_drills(content(spark, a__drl=DRILL)).orderBy("seq").collect()
    assert [(r.x, r.y, r.diameter, r.plated, r.x2) for r in rows] == [
        (1.0, 2.0, 0.3, True, None), (1.0, 3.0, 0.3, True, None), (5.0, 5.0, 1.0, False, 7.0), (1.0, 1.0, 1.0, False, 2.0), (9.0, 9.0, 1.0, False, None),
    ]
    twice = drills.read_drills(content(spark, a__drl=DRILL, b__drl=DRILL))
    assert drills.distinct_holes(twice, ["path", "seq"]).select("path").distinct().collect()[0].path == "a.drl"
    assert drills.distinct_holes(twice, ["path", "seq"]).count() == 5


def test_implied_decimals():
    text = "M48\nINCH,TZ\nT1C0.02\n%\nT1\nX01Y0015\n"
    assert drills.drills(text)[0][1:3] == (pytest.approx(0.0001 * 25.4), pytest.approx(0.0015 * 25.4))
    assert drills.drills(text.replace("TZ", "LZ"))[0][1:3] == (pytest.approx(1.0 * 25.4), pytest.approx(0.15 * 25.4))


def test_written_drills_read_back(spark):
    rows = drills.read_drills(content(spark, a__drl=DRILL))
    text = sinks.excellon(rows, ["path"]).first().value
    again = drills.drills(text)
    assert sorted((x, y, d, x2) for _, x, y, d, _, x2, *_ in again) == sorted(((r.x, r.y, r.diameter, r.x2) for r in rows.collect()), key=lambda r: r[:3])


def test_plots(spark):
    read = plots.read_plots(content(spark, a__gbr=PLOT))
    rows = read.orderBy("seq").collect()
    assert [(r.kind, r.net, r.ref, r.pin, r.function) for r in rows] == [
        ("stroke", "GND", None, None, "Conductor"), ("flash", "GND", "R1", "2", "ViaPad"), ("region", None, None, None, None), ("stroke", None, None, None, "Conductor"),
    ]
    circle = rows[3].points
    assert all(math.isclose(math.hypot(p.x - 1, p.y), 1, abs_tol=1e-9) for p in circle) and len(circle) > 16
    box = plots.extents(read).first()
    assert (box.min_x, box.max_x) == (0.0, 10.0)


def test_outlines(spark):
    side = "X{}Y{}D02*\nX{}Y{}D01*\n"
    corners = [(0, 0), (20, 0), (20, 10), (0, 10)]
    text = "%FSLAX46Y46*%%MOMM*%%ADD10C,0.1*%G01*D10*\n"
    for a, b in [(0, 1), (2, 1), (2, 3), (0, 3)]:  # not all the same way round
        text += side.format(*[int(v * 1e6) for v in (*corners[a], *corners[b])])
    row = plots.read_outlines(content(spark, a__gbr=text + "M02*")).first()
    assert (row.contour, row.area, row.max_x, row.max_y, len(row.points)) == (0, 200.0, 20.0, 10.0, 4)


def test_placements(spark):
    comma = 'Ref,Val,Package,PosX,PosY,Rot,Side\n"C1","100nF","C_0402",151.14,-105.69,-90.0,top\n"C2","x","y",oops,1,0,bottom\n'
    aligned = "### Units = inches\n# Ref   Val    Package  PosX     PosY   Rot  Side\nU1  MCU  QFN  1.0  -2.0  90.0  bottom\n"
    semicolon = "Designator;Mid X;Mid Y;Rotation;Layer\nR1;1,5mm;100mil;0;BottomLayer\n"
    rows = {r.ref: r for r in sheets.read_placements(content(spark, a__csv=comma, b__pos=aligned, c__csv=semicolon)).collect()}
    assert (rows["C1"].x, rows["C1"].y, rows["C1"].rotation, rows["C1"].side) == (151.14, -105.69, -90.0, "top")
    assert rows["C2"].problem and rows["C2"].x is None
    assert (rows["U1"].x, rows["U1"].y, rows["U1"].side) == (25.4, -50.8, "bottom")
    assert (rows["R1"].x, rows["R1"].y, rows["R1"].side) == (1.5, 2.54, "bottom")


def test_bill(spark):
    text = 'My board\n"Reference","Value","Footprint","Quantity","Populate","MPN"\n"C1,C12","100nF","0402","2","",""\n"R1","1k","0402","1","no","X1"\n\n"R9","","","1","",""\n'
    rows = sheets.read_bill(content(spark, a__csv=text)).orderBy("row_number").collect()
    assert [(r.designators, r.quantity, r.populate, r.mpn) for r in rows] == [(["C1", "C12"], 2, True, ""), (["R1"], 1, False, "X1")]


def test_impedances(spark):
    text = 'class,target,tolerance,kind,nets,layer,width,gap\nUSB,90 ohm,±10 %,diff,"USB_D{P,N}",F.Cu,0.2,0.15\nUSB,90,10,differential,"USB_D{P,N}",B.Cu,0.18,0.17\nRF,50R,5 ohm,single,RF_* ANT_*,,,\n'
    rows = {r["class"]: r for r in sheets.read_impedances(content(spark, a__csv=text)).collect()}
    assert rows["USB"].target == 90 and [x.width for x in rows["USB"].layers] == [0.2, 0.18] and rows["USB"].kind == "differential"
    assert rows["RF"].tolerance_pct == 10 and rows["RF"].patterns == ["RF_*", "ANT_*"]


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("fab/a.txt", "x")
        z.writestr("../up.txt", "x")
        z.writestr("empty.txt", "")
        z.writestr("inner.zip", b"PK\x03\x04")
    rows = files.expand(content(spark, p__zip=buffer.getvalue(), plain__txt="y", bad__zip=b"PK\x03\x04junk")).collect()
    assert sorted((r.path, bytes(r.content)) for r in rows if r.problem is None) == [("p.zip/fab/a.txt", b"x"), ("plain.txt", b"y")]
    assert [r.path for r in rows if r.problem] == ["bad.zip"]


def test_scan_and_store(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("one")
    (tmp_path / "d" / "sub" / "b.txt").write_text("two")
    rows = files.scan(spark, str(tmp_path / "d"))
    assert sorted(r.path for r in rows.collect()) == ["a.txt", "sub/b.txt"]
    store = files.Store(spark, str(tmp_path / "store"), "key string, v long")
    store.add(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, v long"), "key")
    store.add(spark.createDataFrame([("a", 9), ("c", 3)], "key string, v long"), "key")
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_kinds(spark):
    given = content(spark, x__gbr="%TF.FileFunction,Copper,L3,Inr*%", b__gbr="%TF.FileFunction,Soldermask,Bot*%", b_Cu__gbr="G04 x*", d__txt=DRILL, pos__csv="Ref,PosX,PosY\n", bom__csv="Reference,Value\n", n__txt="hi")
    rows = {r.path: r for r in files.classified(given).collect()}
    assert {k: v.kind for k, v in rows.items()} == {"x.gbr": "copper", "b.gbr": "mask", "b_Cu.gbr": "copper", "d.txt": "drill", "pos.csv": "placement", "bom.csv": "bom", "n.txt": "other"}
    assert rows["x.gbr"].layer == 3 and rows["b.gbr"].side == "bottom"


def test_decoding(spark):
    df = spark.createDataFrame([(b"\xef\xbb\xbfa\xc3\xa9",), (b"a\xe9",), (b"PK\x03\x04",), (b"glTF",)], "c binary")
    got = df.select(files.decoded(F.col("c")).alias("t"), files.container(F.col("c")).alias("k"), files.sniffed(F.col("c")).alias("m")).collect()
    assert [r.t for r in got[:2]] == ["aé", "aé"] and got[2].k == "zip" and got[3].m == "glb"


def test_trees(spark):
    board = '(kicad_pcb (version 1) (segment (start 0 1) (end 2 3) (width 0.2) (layer "F.Cu") (net 4)) (via (at 5 6) (size 0.6) (layers "F.Cu" "B.Cu") (net 4)) (footprint "R_0402" (layer "B.Cu") (at 7 8 90) (property "Reference" "R\\"1") (pad "1" smd rect)))'
    tree = trees.read_nodes(content(spark, a=board))
    items = {r.kind: r for r in trees.board_items(tree).collect()}
    assert (items["segment"].x2, items["segment"].width, items["via"].layers, items["via"].x1) == (2.0, 0.2, ["F.Cu", "B.Cu"], 5.0)
    part = trees.footprints(tree).first()
    assert (part.ref, part.side, part.rotation, part.pads) == ('R"1', "bottom", 90.0, 1)


def test_steps(spark):
    text = "DATA;\n#1=PRODUCT('a;#9','b',(#2));\n#2=PRODUCT_CONTEXT('',#3,'m');\n#3=(A()B(#4));\n#4=X(1.);\nENDSEC;"
    rows = trees.read_entities(content(spark, a=text))
    assert [(r.id, r.type, r.refs) for r in rows.orderBy("id").collect()] == [(1, "PRODUCT", [2]), (2, "PRODUCT_CONTEXT", [3]), (3, "COMPLEX", [4]), (4, "X", [])]
    assert [r.id for r in trees.unreferenced(rows).collect()] == [1]


def test_jobs(spark):
    job = '{"GeneralSpecs":{"ProjectId":{"Name":"p"},"Size":{"X":10.5,"Y":4},"LayerNumber":2,"BoardThickness":1.6},"MaterialStackup":[{"Type":"Copper","Name":"F.Cu","Thickness":0.035},{"Type":"Dielectric","Name":"core (1/2)","Thickness":0.5,"DielectricConstant":4.0,"LossTangent":0.02,"Material":"FR4"},{"Type":"Dielectric","Name":"core (2/2)","Thickness":0.5,"DielectricConstant":2.0,"LossTangent":0.04,"Material":"PTFE"}]}'
    given = content(spark, a__gbrjob=job)
    assert trees.read_jobs(given).first().asDict() == {"path": "a.gbrjob", "project": "p", "width": 10.5, "height": 4.0, "layers": 2, "thickness": 1.6}
    core = layered(trees.read_stackup(given).filter("type = 'Dielectric'"), ["path", "name"], "thickness", "permittivity", "loss", "material").first()
    assert (core.name, core.thickness, core.materials) == ("core", 1.0, "FR4 + PTFE") and math.isclose(core.permittivity, 1 / (0.5 / 4 + 0.5 / 2)) and math.isclose(core.loss, 0.03)


def test_eagle(spark):
    text = '<eagle><drawing><board><signals><signal name="A" class="1"><wire x1="0" y1="0" x2="1" y2="0" width="0.2" layer="1"/><via x="1" y="0" extent="1-16" drill="0.3"/></signal></signals></board></drawing></eagle>'
    assert [(r.net, r.layer, r.width) for r in trees.read_eagle(content(spark, a=text)).collect()] == [("A", "1", 0.2), ("A", "1-16", 0.3)]


def test_sinks(spark):
    rows = spark.createDataFrame([("b", "C1", None, 'a"b', 1.0, -2.5, 90.0, "top")], "board string, ref string, value string, footprint string, x double, y double, rotation double, side string")
    assert sinks.placement_csv(rows, ["board"]).first().value == 'Ref,Val,Package,PosX,PosY,Rot,Side\n"C1","","a""b",1.000000,-2.500000,90.000000,top\n'
    assert sinks.documents(rows.select("ref", "value")).first().value == '{"ref":"C1","value":null}'
    s = spark.createDataFrame([("n", 2e9, 0.0, 0.1, 0.9, 0.0), ("n", 1e9, 0.0, 0.0, 1.0, 0.0)], "net string, hertz double, s11_re double, s11_im double, s21_re double, s21_im double")
    assert sinks.touchstone(s, ["net"], 50.0).first().value.split("\n")[:2] == ["# Hz S RI R 50", "1.00000000e+09 0.00000000 0.00000000 1.00000000 0.00000000 1.00000000 0.00000000 0.00000000 0.00000000"]


def test_lines(spark):
    n = F.lit
    z = lines.microstrip(n(0.36), n(0.2104), n(0.035), n(4.4))
    w = lines.synthesized(lambda x: lines.microstrip(x, n(0.2104), n(0.035), n(4.4))["z0"], n(50.0), 0.01, 10.0)
    none = lines.synthesized(lambda x: lines.microstrip(x, n(0.2104), n(0.035), n(4.4))["z0"], n(900.0), 0.01, 10.0)
    thin = lines.stripline(n(0.3), n(1.0), n(0.0), n(4.0))
    row = spark.range(1).select(z.alias("z"), w.alias("w"), none.alias("none"), thin.alias("thin"), lines.agm(n(1.0), n(0.5)).alias("agm")).first()
    assert round(row.z.z0, 2) == 50.92 and round(row.z.e_eff, 3) == 3.176 and round(row.w, 4) == 0.3721 and row.none is None
    assert abs(row.thin - 64.65) < 0.05 and math.isclose(row.agm, 0.7283955155234534)


def test_validation(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}}, "additionalProperties": False, "$defs": {"n": {"type": "number", "exclusiveMinimum": 0}}}
    docs = spark.createDataFrame([('{"a": 1}',), ('{"a": 0, "b": [1, 3, 2], "c": 1}',), ("nope",), ("{}",)], "d string")
    got = [r.v for r in docs.select(V.violations(F.col("d"), schema).alias("v")).collect()]
    assert got == [[], ["/a: breaks exclusiveMinimum 0", "/b: has more than 2 items", "/b/1: is none of [1, 2]", "/c: not allowed"], ["/: is not JSON"], ["/: lacks a"]]
    rows = spark.createDataFrame([(1, "x"), (1, "y")], "id int, f string")
    bad = V.unique(rows, ["id"], "unique id").unionByName(V.references(rows, "f", rows.filter("f = 'x'"), "f", "known f"))
    with pytest.raises(ValueError, match="known f: y; unique id: 1"):
        V.asserted(bad)
    V.asserted(bad.limit(0))


def test_streaming(spark, sf, tmp_path):
    from lamella.streaming import windows as W

    events = spark.read.parquet(f"{sf}/events.parquet")
    source = tmp_path / "in"
    events.repartition(1).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    for name, frame, mode in (("sections", W.sections(stream), "append"), ("summary", W.windowed_summary(stream), "complete"), ("last", W.last_values(stream), "complete")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    batch = W.windowed_summary(events)
    assert spark.table("summary").count() == batch.count()
    assert spark.table("last").count() == W.last_values(events).count()
    runs = 0
    for _, g in events.toPandas().sort_values(["ts", "event_id"]).groupby("user_id"):
        runs += int((g.event_type != g.event_type.shift()).sum()) - 1  # the last run of a user is still open
    assert spark.table("sections").count() == runs
