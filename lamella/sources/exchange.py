"""Exchange formats: IPC-2581 and ODB++ components and nets, and the compress (.Z) files inside the latter."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree

from pyspark.sql import DataFrame

from lamella.sources.reader import parsed, table

PARTS = ("ref: string", "part: string", "footprint: string", "x: double", "y: double", "rotation: double", "side: string")
INCH = 25.4


def uncompressed(data: bytes) -> bytes:
    """The content of a UNIX compress file (LZW, 9 to 16 bits, with or without clear codes)."""
    if data[:2] != b"\x1f\x9d":
        raise ValueError("not a compress file")
    most, blocks = data[2] & 0x1F, bool(data[2] & 0x80)
    table_ = [bytes([i]) for i in range(256)] + ([b""] if blocks else [])
    width, at, started = 9, 24, 24  # in bits; codes come in groups of eight of one width
    out, last = [], b""
    while at + width <= len(data) * 8:
        code = (int.from_bytes(data[at // 8 : at // 8 + 4], "little") >> at % 8) & ((1 << width) - 1)
        at += width
        if blocks and code == 256:
            del table_[257:]
            at = started + -(-(at - started) // (width * 8)) * width * 8
            width, started, last = 9, at, b""
            continue
        if code < len(table_):
            entry = table_[code]
        elif last and code == len(table_):
            entry = last + last[:1]
        else:
            raise ValueError("a code that isn't there yet")
        out.append(entry)
        if last and len(table_) < 1 << most:
            table_.append(last + entry[:1])
        last = entry
        if len(table_) >= 1 << width and width < most:
            at = started + -(-(at - started) // (width * 8)) * width * 8
            started, width = at, width + 1
    return b"".join(out)


def _bare(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def ipc_components(text: str) -> list[tuple]:
    """(ref, part, footprint, x, y, rotation, side) in millimetres of an IPC-2581 file."""
    root = ElementTree.fromstring(text)
    unit = next((e.get("units", "").upper() for e in root.iter() if _bare(e.tag) in ("CadHeader", "EcadHeader")), "MILLIMETER")
    scale = {"INCH": INCH, "MICRON": 0.001}.get(unit, 1.0)
    sides = {e.get("name"): (e.get("side") or "").upper() for e in root.iter() if _bare(e.tag) == "Layer"}
    out = []
    for e in root.iter():
        if _bare(e.tag) != "Component":
            continue
        at = {_bare(c.tag): c for c in e}
        place, turn = at.get("Location"), at.get("Xform")
        if place is None:
            continue
        bottom = sides.get(e.get("layerRef"), "").startswith("BOTTOM") or (turn is not None and turn.get("mirror", "").lower() == "true")
        out.append((e.get("refDes"), e.get("part"), e.get("packageRef"), float(place.get("x")) * scale, float(place.get("y")) * scale, float(turn.get("rotation", 0)) if turn is not None else 0.0, "bottom" if bottom else "top"))
    return out


def ipc_pins(text: str) -> list[tuple]:
    """(net, ref, pin) of an IPC-2581 file."""
    out = []
    for net in ElementTree.fromstring(text).iter():
        if _bare(net.tag) in ("LogicalNet", "PhyNet"):
            out += [(net.get("name"), p.get("componentRef"), p.get("pin")) for p in net.iter() if _bare(p.tag) == "PinRef"]
    return out


def odb_components(text: str) -> list[tuple]:
    """(ref, part, footprint, x, y, rotation, side) in millimetres of an ODB++ components file."""
    scale = 1.0 if re.search(r"^UNITS\s*=\s*MM|^U MM", text, re.M) else INCH
    rows = [line.split() for line in text.splitlines() if line.startswith("CMP ")]
    return [(r[6], r[7] if len(r) > 7 else None, None, float(r[2]) * scale, float(r[3]) * scale, float(r[4]), "bottom" if r[5] == "M" else "top") for r in rows if len(r) > 6]


def read_ipc_components(files: DataFrame) -> DataFrame:
    return parsed(files, ipc_components, table(*PARTS))


def read_ipc_pins(files: DataFrame) -> DataFrame:
    return parsed(files, ipc_pins, table("net: string", "ref: string", "pin: string"))


def read_odb_components(files: DataFrame) -> DataFrame:
    """Components of `components` files (path ends so, or in .Z)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            data = [uncompressed(x.as_py()) if x.as_py()[:2] == b"\x1f\x9d" else x.as_py() for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(data, pa.binary())], names=["path", "content"])

    return parsed(files.select("path", "content").mapInArrow(run, "path string, content binary"), odb_components, table(*PARTS))
