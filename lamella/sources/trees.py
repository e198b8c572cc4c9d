"""Nested text: S-expressions, STEP entities, job files and Eagle boards, as tables."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.sources.files import decoded
from lamella.sources.reader import parsed, table

TOKEN = re.compile(r'\(|\)|"(?:[^"\\]|\\.)*"|[^\s()"]+', re.S)


def nodes(text: str) -> list[tuple]:
    """(node, parent, depth, name, atoms, start, end) of each list, in order; the parent of an outer one is -1."""
    out: list[list] = []
    open_: list[int] = []
    for token in TOKEN.finditer(text):
        t = token[0]
        if t == "(":
            out.append([len(out), open_[-1] if open_ else -1, len(open_), None, [], token.start(), None])
            open_.append(len(out) - 1)
        elif t == ")":
            if open_:
                out[open_.pop()][6] = token.end()
        elif open_:
            atom = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]) if t[0] == '"' else t
            node = out[open_[-1]]
            if node[3] is None and not node[4]:
                node[3] = atom
            else:
                node[4].append(atom)
    return [tuple(n) for n in out]


def read_nodes(files: DataFrame) -> DataFrame:
    return parsed(files, nodes, table("node: int", "parent: int", "depth: int", "name: string", "atoms: strings", "start: int", "end: int"))


def board_items(tree: DataFrame) -> DataFrame:
    """Segments, arcs, vias and zones of a board tree: path, kind, net, layers, x1, y1, x2, y2, width."""
    kinds = ["segment", "arc", "via", "zone"]
    item = tree.filter(F.col("name").isin(kinds) & (F.col("depth") == 1)).select("path", F.col("node").alias("item"), F.col("name").alias("kind"))
    child = tree.select(F.col("path"), F.col("parent").alias("item"), F.col("name").alias("field"), "atoms")
    first = lambda field, i: F.max(F.when(F.col("field") == field, F.get("atoms", F.lit(i))))
    rows = item.join(child, ["path", "item"]).groupBy("path", "item", "kind").agg(
        first("net", 0).alias("net"),
        F.max(F.when(F.col("field").isin("layer", "layers"), F.col("atoms"))).alias("layers"),
        F.coalesce(first("start", 0), first("at", 0)).try_cast("double").alias("x1"),
        F.coalesce(first("start", 1), first("at", 1)).try_cast("double").alias("y1"),
        first("end", 0).try_cast("double").alias("x2"),
        first("end", 1).try_cast("double").alias("y2"),
        F.coalesce(first("width", 0), first("size", 0)).try_cast("double").alias("width"),
    )
    return rows.drop("item")


def footprints(tree: DataFrame) -> DataFrame:
    """Placed footprints of a board tree: path, ref, footprint, x, y, rotation, side, pads."""
    part = tree.filter((F.col("name") == "footprint") & (F.col("depth") == 1)).select("path", F.col("node").alias("part"), F.get("atoms", F.lit(0)).alias("footprint"))
    child = tree.select("path", F.col("parent").alias("part"), F.col("name").alias("field"), "atoms")
    atom = lambda field, i: F.max(F.when(F.col("field") == field, F.get("atoms", F.lit(i))))
    reference = F.max(F.when((F.col("field") == "property") & (F.get("atoms", F.lit(0)) == "Reference"), F.get("atoms", F.lit(1))))
    old = F.max(F.when((F.col("field") == "fp_text") & (F.get("atoms", F.lit(0)) == "reference"), F.get("atoms", F.lit(1))))
    return part.join(child, ["path", "part"]).groupBy("path", "part", "footprint").agg(
        F.coalesce(reference, old).alias("ref"),
        atom("at", 0).try_cast("double").alias("x"),
        atom("at", 1).try_cast("double").alias("y"),
        F.coalesce(atom("at", 2).try_cast("double"), F.lit(0.0)).alias("rotation"),
        F.when(F.startswith(atom("layer", 0), F.lit("B.")), "bottom").otherwise("top").alias("side"),
        F.count_if(F.col("field") == "pad").alias("pads"),
    ).drop("part")


def entities(text: str) -> list[tuple]:
    """(id, type, args, refs) of each STEP entity."""
    out = []
    body = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    for found in re.finditer(r"#(\d+)\s*=\s*((?:'(?:[^']|'')*'|[^;'])*);", body):
        what = re.match(r"\s*([A-Z0-9_]+)\s*\((.*)\)\s*$", found[2], re.S)
        bare = re.sub(r"'(?:[^']|'')*'", "", found[2])
        out.append((int(found[1]), what[1] if what else "COMPLEX", what[2].strip() if what else found[2].strip(), [int(x) for x in re.findall(r"#(\d+)", bare)]))
    return out


def read_entities(files: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("args", T.StringType()), T.StructField("refs", T.ArrayType(T.LongType()))])
    return parsed(files, entities, schema)


def unreferenced(steps: DataFrame) -> DataFrame:
    """The entities that no other refers to."""
    used = steps.select("path", F.explode("refs").alias("id")).distinct()
    return steps.join(used, ["path", "id"], "left_anti")


JOB = "Header struct<GenerationSoftware: struct<Vendor: string, Application: string, Version: string>>, GeneralSpecs struct<ProjectId: struct<Name: string, GUID: string, Revision: string>, Size: struct<X: double, Y: double>, LayerNumber: int, BoardThickness: double>, MaterialStackup array<struct<Type: string, Name: string, Thickness: double, Material: string, DielectricConstant: double, LossTangent: double, Color: string>>"


def read_jobs(files: DataFrame) -> DataFrame:
    """path, project, width, height, layers, thickness of each job file."""
    j = F.from_json(decoded(F.col("content")), JOB)
    rows = files.select("path", j.alias("j"))
    return rows.select("path", F.col("j.GeneralSpecs.ProjectId.Name").alias("project"), F.col("j.GeneralSpecs.Size.X").alias("width"), F.col("j.GeneralSpecs.Size.Y").alias("height"), F.col("j.GeneralSpecs.LayerNumber").alias("layers"), F.col("j.GeneralSpecs.BoardThickness").alias("thickness"))


def read_stackup(files: DataFrame) -> DataFrame:
    """The stackup's rows in order; sublayers (name, name (1/2)...) are folded by `operators.aggregates.layered`."""
    rows = files.select("path", F.posexplode(F.from_json(decoded(F.col("content")), JOB)["MaterialStackup"]).alias("seq", "l"))
    return rows.select("path", "seq", F.col("l.Type").alias("type"), F.regexp_replace("l.Name", r"\s*\(\d+/\d+\)$", "").alias("name"), F.col("l.Thickness").alias("thickness"), F.col("l.Material").alias("material"), F.col("l.DielectricConstant").alias("permittivity"), F.col("l.LossTangent").alias("loss"))


def eagle_wires(text: str) -> list[tuple]:
    """(net, class, layer, width, x1, y1, x2, y2) of each wire of a signal, and (…, drill) as a via with equal ends."""
    root = ElementTree.fromstring(text)
    out = []
    for signal in root.iter("signal"):
        for e in signal:
            if e.tag == "wire":
                out.append((signal.get("name"), signal.get("class"), e.get("layer"), float(e.get("width")), *[float(e.get(k)) for k in ("x1", "y1", "x2", "y2")]))
            elif e.tag == "via":
                x, y = float(e.get("x")), float(e.get("y"))
                out.append((signal.get("name"), signal.get("class"), e.get("extent"), float(e.get("drill")), x, y, x, y))
    return out


def read_eagle(files: DataFrame) -> DataFrame:
    return parsed(files, eagle_wires, table("net: string", "class: string", "layer: string", "width: double", "x1: double", "y1: double", "x2: double", "y2: double"))


def slimmed(steps: DataFrame, dressing: list[str]) -> DataFrame:
    """Entities without those of the dressing types, and without what only they needed.

    Kept is what can be reached from the entities that nothing referred to in the whole file, dressing aside.
    """
    from lamella.operators.graph import reachable

    key = lambda c: F.concat_ws("#", "path", F.col(c).cast("string"))
    stay = steps.filter(~F.col("type").isin(dressing))
    roots = unreferenced(steps).filter(~F.col("type").isin(dressing)).select(key("id").alias("node"))
    links = stay.select("path", "id", F.explode("refs").alias("to"))
    links = links.join(stay.select("path", F.col("id").alias("to")), ["path", "to"], "left_semi")
    seen = reachable(links.select(key("id").alias("a"), key("to").alias("b")), roots)
    return stay.withColumn("_k", key("id")).join(seen.withColumnRenamed("node", "_k"), "_k", "left_semi").drop("_k")
