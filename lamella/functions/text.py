"""Text and number expressions: Column to Column, inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Millimetres per unit.
MM = {"mm": 1.0, "mil": 0.0254, "mils": 0.0254, "th": 0.0254, "in": 25.4, "inch": 25.4, '"': 25.4, "um": 0.001, "µm": 0.001, "cm": 10.0, "m": 1000.0}


def half_up(value: Column, places: int) -> Column:
    """Rounded half up on the binary value: floor(v * 10^n + 0.5) / 10^n (round() differs between engines)."""
    step = float(10**places)
    return F.floor(value * F.lit(step) + F.lit(0.5)) / F.lit(step)


def key_um(value: Column) -> Column:
    """A coordinate in whole thousandths, as a join key."""
    return F.floor(value * F.lit(1000.0) + F.lit(0.5)).cast("long")


def significant(value: Column, figures: int) -> Column:
    """Rounded half up to so many significant figures; zero stays."""
    scale = F.pow(F.lit(10.0), F.lit(float(figures - 1)) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.floor(value * scale + F.lit(0.5)) / scale)


def header_name(text: Column) -> Column:
    """A column heading in comparable form: lower case, runs of other than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", " "))


def designators(text: Column) -> Column:
    """The references of a cell, split at commas, semicolons and blanks; without empty ones."""
    return F.filter(F.split(text, r"[,;\s]+"), lambda x: x != "")


def pattern_parts(text: Column) -> Column:
    """Patterns split at commas, semicolons and blanks outside braces."""
    return F.regexp_extract_all(text, F.lit(r"(?:[^,;\s{}]|\{[^{}]*\})+"), F.lit(0))


def glob_regex(pattern: str, sensitive: bool = False) -> str | None:
    """A glob (* ? [abc] [!abc] {A,B}), or an expression behind `re:`, as a regular expression for whole names; None if it is bad.

    Without a slash in it, a glob also matches the last part of a path.
    """
    flag = "" if sensitive else "(?i)"
    if pattern.startswith("re:"):
        try:
            re.compile(pattern[3:])
        except re.error:
            return None
        return f"{flag}^(?:{pattern[3:]})$"
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            out += "[" + ("^" if negated else "") + body[negated:].replace("\\", r"\\") + "]"
            i = end
        elif c == "{" and "}" in pattern[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        return None
    path = "" if "/" in pattern else "(?:.*/)?"
    return f"{flag}^{path}(?:{out})$"


def matches(name: Column, pattern: str, sensitive: bool = False) -> Column:
    """Whether a name matches; a bad pattern matches nothing."""
    regex = glob_regex(pattern, sensitive)
    return F.lit(False) if regex is None else name.rlike(regex)


def natural_key(text: Column) -> Column:
    """An order for designators: letters, then the number, then the text."""
    digits = F.regexp_replace(text, r"\D+", "")
    return F.struct(F.regexp_replace(text, r"\d+", "").alias("letters"), F.when(digits != "", F.substring(digits, 1, 18).cast("long")).alias("number"), text.alias("text"))


def number_of(text: Column) -> Column:
    """The number that leads a text ('0,15 mm', '4mil'), a decimal comma allowed; null without one."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(text, r"\s+", ""), r"^[±+]?(-?\d+(?:[.,]\d+)?)", 1), ",", ".").try_cast("double")


def length_mm(text: Column) -> Column:
    """A length in millimetres; a number without a unit counts as millimetres, an unknown unit as none."""
    unit = F.lower(F.regexp_extract(F.regexp_replace(text, r"\s+", ""), r'^[±+]?-?\d+(?:[.,]\d+)?([a-zA-Zµ"]*)$', 1))
    factor = F.when(unit == "", F.lit(1.0))
    for name, mm in MM.items():
        factor = factor.when(unit == name, F.lit(mm))
    return number_of(text) * factor


def side_of(text: Column) -> Column:
    """'bottom' for b..., back, and mirrored placements; else 'top'."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^b") | low.rlike(r"mirror\s*=\s*(yes|1|true)") | (low == "yes"), F.lit("bottom")).otherwise(F.lit("top"))


def copper_layer(text: Column, count: Column) -> Column:
    """L1, L2... of `count` layers as F.Cu, In1.Cu... B.Cu; other names as they are."""
    n = F.regexp_extract(F.upper(F.trim(text)), r"^L(\d{1,3})$", 1).try_cast("int")
    return F.when(n == 1, F.lit("F.Cu")).when(n == count, F.lit("B.Cu")).when((n > 1) & (n < count), F.format_string("In%d.Cu", n - 1)).otherwise(text)


def impedance_target(name: Column) -> Column:
    """The ohms a class name states: a number of 5 to 500 behind or before ohm or R, or with or behind a letter code; else the first such number."""
    token = F.regexp_extract(F.upper(name), r"(?:^|[^0-9A-Z.])(?:[A-Z]{0,3})?(\d{1,3}(?:\.\d+)?)(?:OHMS?|R|Ω)?(?:$|[^0-9A-Z.])", 1).try_cast("double")
    return F.when(token.between(5.0, 500.0), token)


def without_comments(text: Column) -> Column:
    """A plot file's lines but for comments (G04) and attribute lines (%T...): what two plots are compared by."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: ~F.trim(x).rlike(r"^(G04|G4 |%T[FAOD])"))
    return F.array_join(lines, "\n")


def hex_colour(text: Column) -> Column:
    """#rgb or #rrggbb as an integer; null for anything else."""
    digits = F.regexp_extract(F.trim(text), r"^#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})$", 1)
    long_ = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.when(digits != "", F.conv(long_, 16, 10).cast("int"))


def fuzzy_score(name: Column, query: str) -> Column:
    """0 the same, 1 a whole part, 2 a beginning, 3 inside, 4 + gaps if the letters come in order, null otherwise."""
    low, wanted = F.lower(name), query.lower()
    state = F.aggregate(
        F.filter(F.split(low, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("gaps")),
        lambda s, c: F.when(
            (s["at"] < len(wanted)) & (c == F.substring(F.lit(wanted), s["at"] + 1, F.lit(1))), F.struct((s["at"] + 1).alias("at"), s["gaps"].alias("gaps"))
        ).otherwise(F.struct(s["at"].alias("at"), (s["gaps"] + F.when((s["at"] > 0) & (s["at"] < len(wanted)), 1).otherwise(0)).alias("gaps"))),
    )
    part = low.rlike(f"(^|[^a-z0-9]){re.escape(wanted)}([^a-z0-9]|$)")
    return (
        F.when(low == wanted, 0).when(part, 1).when(F.startswith(low, F.lit(wanted)), 2).when(F.contains(low, F.lit(wanted)), 3).when(state["at"] == len(wanted), F.lit(4) + state["gaps"])
    )


# What columns of bills and placement lists go by, and the layer roles that are shown unless asked otherwise.
PART_COLUMNS = ("value", "val", "comment", "footprint", "package", "mpn", "manufacturer part number", "part number", "quantity", "qty")
REFERENCE_COLUMNS = ("designator", "designators", "reference", "references", "refdes", "ref")
SHOWN = ("copper", "mask", "silkscreen", "outline")


def headings(line: Column) -> Column:
    """The column names of a header line (commas, semicolons or tabs), in comparable form."""
    return F.transform(F.split(line, r"[,;\t]"), header_name)


def _any_of(names: Column, known: tuple[str, ...]) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, known)))


def looks_like_bill(line: Column) -> Column:
    """Whether a header line is a bill of materials': a designator and at least one column of a part."""
    names = headings(line)
    return _any_of(names, REFERENCE_COLUMNS) & _any_of(names, PART_COLUMNS)


def looks_like_placements(line: Column) -> Column:
    """Whether a header line is a placement list's: a reference, an x and a y."""
    names = headings(line)
    place = lambda axis: F.exists(names, lambda n: n.rlike(f"(^|pos|mid|center|location) ?{axis}$"))
    return _any_of(names, REFERENCE_COLUMNS) & place("x") & place("y")


def storable(value: Column, limit: float, places: int = 6) -> Column:
    """A number that can be stored: finite and below the limit, on a grid of so many places; null otherwise."""
    return F.when(~F.isnan(value) & (F.abs(value) < limit), half_up(value, places))


def has_geometry(text: Column) -> Column:
    """Whether a plot draws anything: a draw or flash operation, or a closed region."""
    return F.coalesce(text.rlike(r"(?m)(^|\*)\s*(X-?\d+)?(Y-?\d+)?(I-?\d+)?(J-?\d+)?D0?[13]\*") | text.rlike(r"G36\*[\s\S]*G37\*"), F.lit(False))


def copper_sides(layers: Column) -> Column:
    """struct<copper, top, bottom, paste> of a pad's layer names; * stands for any layer."""
    on = lambda *names: F.exists(layers, lambda x: x.isin(*names))
    return F.struct(
        F.exists(layers, lambda x: F.endswith(x, F.lit(".Cu"))).alias("copper"), on("F.Cu", "*.Cu").alias("top"), on("B.Cu", "*.Cu").alias("bottom"),
        F.when(on("F.Paste", "*.Paste"), "top").when(on("B.Paste"), "bottom").alias("paste"),
    )


def layer_role(name: Column) -> Column:
    """What a layer is for, by its name; other if the name says nothing."""
    kinds = [("copper", r"\.cu$|copper"), ("mask", r"mask"), ("silkscreen", r"silk"), ("paste", r"paste"), ("outline", r"edge|outline|profile"), ("courtyard", r"courtyard|crtyd"), ("fab", r"fab|assembly")]
    low = F.lower(name)
    chosen = F.lit(None).cast("string")
    for role, pattern in reversed(kinds):
        chosen = F.when(low.rlike(pattern), role).otherwise(chosen)
    return F.coalesce(chosen, F.lit("other"))


def shown(name: Column) -> Column:
    """Whether a layer is visible unless asked otherwise: by its role, inner copper not."""
    return layer_role(name).isin(*SHOWN) & ~F.lower(name).rlike(r"^in\d+\.cu$")


def layer_rank(name: Column, count: Column) -> Column:
    """The place of a layer from the top: silkscreen, paste, mask, copper by depth, and the same again from below; others last."""
    low, role = F.lower(name), layer_role(name)
    inner = F.regexp_extract(low, r"^in(\d+)\.cu$", 1).try_cast("int")
    outer = F.when(role == "silkscreen", 0).when(role == "paste", 1).when(role == "mask", 2).when(role == "copper", 3)
    depth = F.when(inner.isNotNull(), 3 + inner).when(F.startswith(low, F.lit("b.")), count + 5 - outer).otherwise(outer)
    return F.coalesce(depth, F.lit(1000)).cast("int")


def view_state(zoom: Column, region: Column, layers: Column) -> Column:
    """A view as text: z=..&r=x,y,w,h&l=a+b; what is null is left out."""
    box = F.concat_ws(",", *[region[c].cast("string") for c in ("x", "y", "w", "h")])
    return F.concat_ws("&", F.concat(F.lit("z="), zoom.cast("string")), F.when(region.isNotNull(), F.concat(F.lit("r="), box)), F.when(F.size(layers) > 0, F.concat(F.lit("l="), F.array_join(layers, "+"))))


def view_of(state: Column) -> Column:
    """struct<zoom, region, layers> of such a text; parts that are missing or malformed are null."""
    parts = F.str_to_map(state, F.lit("&"), F.lit("="))
    box = F.transform(F.split(parts["r"], ","), lambda x: x.try_cast("double"))
    sound = (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull())
    region = F.when(sound, F.struct(*[F.get(box, F.lit(i)).alias(c) for i, c in enumerate("xywh")]))
    return F.struct(parts["z"].try_cast("double").alias("zoom"), region.alias("region"), F.split(parts["l"], r"\+").alias("layers"))


def script_number(value: Column) -> Column:
    """A number as scripts print it: the shortest digits, whole numbers without a point, exponents only from 1e21 and below 1e-6."""
    size = F.abs(value)
    digits = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0(E|$)", "$1"), r"E(-?\d+)$", "e$1")
    plain_ = F.regexp_replace(value.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    whole = F.when((value == F.floor(value)) & (size < 1e18), value.cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, F.when(digits.contains("e") & (size >= 1e-6) & (size < 1), plain_), F.regexp_replace(digits, r"e(\d)", "e+$1"))


def ink(r: Column, g: Column, b: Column, a: Column, alpha: int = 40, light: int = 235) -> Column:
    """Whether a pixel is drawn: not see-through, and darker than paper."""
    return (a >= alpha) & (0.2126 * r + 0.7152 * g + 0.0722 * b <= light)
