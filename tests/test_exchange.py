import math

from pyspark.sql import functions as F

from lamella.functions import geometry, lines
from lamella.sources import exchange, plots, trees
from tests.test_sources import content


def packed(data, most=16):
    """A plain compress writer, with groups of eight codes."""
    table = {bytes([i]): i for i in range(256)}
    bits, width, at, started, following = 0, 9, 0, 0, 257
    word = b""

    def put(code):
        nonlocal bits, at
        bits |= code << at
        at += width

    for c in data:
        c = bytes([c])
        if word + c in table:
            word += c
            continue
        put(table[word])
        if following < 1 << most:
            table[word + c] = following
            following += 1
            if following > 1 << width and width < most:
                at = started + -(-(at - started) // (width * 8)) * width * 8
                started, width = at, width + 1
        word = c
    put(table[word])
    return b"\x1f\x9d" + bytes([0x80 | most]) + bits.to_bytes(-(-at // 8), "little")


def test_compress():
    for data in (b"a", b"abababababab" * 50, bytes(range(256)) * 40, "".join(str(i * i) for i in range(4000)).encode()):
        assert exchange.uncompressed(packed(data)) == data


def test_odb(spark):
    text = "UNITS=MM\nCMP 0 1.5 2.0 90.0 N R1 RES ;\nTOP 0 1 1\nCMP 1 3 4 0 M C2 CAP\n"
    rows = exchange.read_odb_components(content(spark, a=text, b=packed(text.encode()))).orderBy("path", "ref").collect()
    assert [(r.ref, r.part, r.x, r.side) for r in rows] == [("C2", "CAP", 3.0, "bottom"), ("R1", "RES", 1.5, "top")] * 2


def test_ipc(spark):
    text = '<i:IPC-2581 xmlns:i="u"><i:CadHeader units="INCH"/><i:Layer name="T" side="TOP"/><i:Layer name="B" side="BOTTOM"/><i:Component refDes="U1" part="p" packageRef="q" layerRef="B"><i:Xform rotation="90"/><i:Location x="1" y="2"/></i:Component><i:LogicalNet name="N"><i:PinRef componentRef="U1" pin="3"/></i:LogicalNet></i:IPC-2581>'
    assert tuple(exchange.read_ipc_components(content(spark, a=text)).first())[1:] == ("U1", "p", "q", 25.4, 50.8, 90.0, "bottom")
    assert tuple(exchange.read_ipc_pins(content(spark, a=text)).first())[1:] == ("N", "U1", "3")


def test_profile_and_slimming(spark):
    head = "%FSLAX46Y46*%%MOMM*%%ADD10C,0.1*%G01*D10*\n"
    edge, own = "X0Y0D02*\nX1000000Y0D01*\n", "X0Y0D02*\nX0Y3000000D01*\n"
    back = "X1000000Y0D02*\nX0Y0D01*\n"
    read = plots.read_plots(content(spark, a=head + back + own))
    assert [r.points[1].y for r in plots.without_profile(read, plots.read_plots(content(spark, e=head + edge))).collect()] == [3.0]
    steps = trees.read_entities(content(spark, a="#1=ROOT(#2);#2=A();#3=STYLE(#2,#4);#4=COLOUR();#5=STYLE(#4);"))
    assert sorted(r.id for r in trees.slimmed(steps, ["STYLE"]).collect()) == [1, 2]


def test_cuts_and_pairs(spark):
    n = lambda v: F.lit(float(v))
    s = math.sqrt(0.5)
    row = spark.range(1).select(
        geometry.cut_disc(n(0), n(0), n(1), n(0), n(5), n(0.6), n(1)).alias("disc"),
        geometry.cut_disc(n(0), n(0), n(1), n(0), n(5), n(2), n(1)).alias("miss"),
        geometry.cut_capsule(n(0), n(0), n(1), n(0), n(5), n(-3), n(5), n(3), n(1)).alias("across"),
        geometry.cut_capsule(n(0), n(0), n(1), n(0), n(2), n(0), n(6), n(0), n(1)).alias("along"),
        geometry.cut_capsule(n(0), n(0), n(s), n(s), n(0), n(3), n(4), n(3), n(0.5)).alias("slant"),
        lines.coupled_stripline(n(0.3), n(1.0), n(4.0), n(5)).alias("far"),
        lines.coupled_stripline(n(0.3), n(1.0), n(4.0), n(0.1)).alias("near"),
        lines.stripline(n(0.3), n(1.0), n(0), n(4.0)).alias("single"),
        lines.structure(F.lit(True), F.lit(False), F.lit(False), F.lit(True)).alias("kind"),
    ).first()
    assert (row.disc.lo, row.disc.hi) == (4.2, 5.8) and row.miss is None and (row.across.lo, row.across.hi) == (4.0, 6.0) and (row.along.lo, row.along.hi) == (1.0, 7.0)
    assert abs(row.slant.lo - 2.5 / s) < 1e-9 and abs(row.slant.hi - 3.5 / s) < 1e-9
    assert abs(row.far.odd - row.single) < 0.01 and abs(row.far.even - row.single) < 0.01 and row.near.odd < row.single < row.near.even
    assert row.kind == "coupled_microstrip"


def test_macros():
    rings = plots.macro("BOX*0 a note*$3=$1x2+1*21,1,$1,$2,0,0,90*1,1,$3,5,0*20,0,1,0,0,1,1,0", [2.0, 4.0])
    assert [len(r) for r in rings] == [4, 32]
    assert max(x for x, _ in rings[0]) == 2.0 and abs(max(y for _, y in rings[0]) - 1.0) < 1e-12 and max(x for x, _ in rings[1]) == 7.5
    text = "%FSLAX46Y46*%%MOMM*%%AMBOX*21,1,$1,$1/2-(0.5),0,0,0*%%ADD12BOX,4*%D12*X0Y0D03*M02*"
    assert plots.plot(text)[0][7:9] == (4.0, 1.5)


def test_spreadsheet(spark):
    import io
    import zipfile

    from lamella.sources import sheets

    cell = lambda r, v: f'<c r="{r}" t="s"><v>{v}</v></c>'
    head = "".join(f"<si><t>{x}</t></si>" for x in ("Reference", "Value", "C1,C2", "10n", "other"))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst>{head}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<w><row>{cell('A1', 4)}</row></w>")
        z.writestr("xl/worksheets/sheet2.xml", f'<w><row>{cell("A1", 0)}{cell("C1", 1)}</row><row>{cell("A2", 2)}{cell("C2", 3)}</row></w>')
    rows = sheets.read_bill(sheets.as_text(content(spark, b__xlsx=buffer.getvalue(), bad__xlsx=b"no"))).collect()
    assert [(r.designators, r.value) for r in rows] == [(["C1", "C2"], "10n")]
