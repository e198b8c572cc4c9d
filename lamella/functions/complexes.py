"""Complex numbers as struct<re, im> columns, and what lines need of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def plus(a: Column, b: Column, sign: int = 1) -> Column:
    return number(a["re"] + sign * b["re"], a["im"] + sign * b["im"])


def times(a: Column, b: Column) -> Column:
    return number(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def over(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return number((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)


def exponential(a: Column) -> Column:
    return number(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))


def s_parameters(z0: Column, reference: Column, nepers: Column, radians: Column) -> Column:
    """struct<s11, s21> of a line of real impedance z0 between ports of the reference, with its loss and phase."""
    g = (z0 - reference) / (z0 + reference)
    p = exponential(number(-nepers, -radians))
    p2 = times(p, p)
    one = number(F.lit(1.0), F.lit(0.0))
    scaled = lambda a, k: number(a["re"] * k, a["im"] * k)
    below = plus(one, scaled(p2, g * g), -1)
    return F.struct(over(scaled(plus(one, p2, -1), g), below).alias("s11"), over(scaled(p, F.lit(1.0) - g * g), below).alias("s21"))


def dispersive_permittivity(er: Column, loss: Column, at: Column, hertz: Column, low: float = 1e3, high: float = 1e12) -> Column:
    """struct<re, im> of a causal dielectric (Djordjevic and Sarkar 2001) with this permittivity and loss tangent at `at` hertz."""
    log = lambda f: number(
        F.log((F.lit(high * high) + f * f) / (F.lit(low * low) + f * f)) / 2, F.atan(f / high) - F.atan(f / low)
    )
    slope = -(er * loss) / log(at)["im"]
    rest = er - slope * log(at)["re"]
    now = log(hertz)
    return number(rest + slope * now["re"], slope * now["im"])


def loss_db(z0: Column, e_eff: Column, er: Column, loss: Column, width_m: Column, surface_resistance: Column, hertz: Column) -> Column:
    """struct<conductor, dielectric> in dB a metre: Rs / (z0 w), and the dielectric's share of the field."""
    per = 20 / math.log(10)
    conductor = surface_resistance / (2 * z0 * width_m) * per
    filled = er * (e_eff - 1) / (F.sqrt(e_eff) * (er - 1))
    return F.struct(conductor.alias("conductor"), (math.pi * hertz / 299_792_458.0 * filled * loss * per).alias("dielectric"))
