"""Closed-form transmission lines over columns; lengths in any one unit, results in ohms.

Formulas are those of the published papers named at each function.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the impedance of free space in ohms.
ETA0 = 376.730313668


def _homogeneous(u: Column) -> Column:
    """Z of a microstrip in air (Hammerstad and Jensen 1980)."""
    f = F.lit(6.0) + F.lit(2 * math.pi - 6) * F.exp(-F.pow(F.lit(30.666) / u, F.lit(0.7528)))
    return F.lit(ETA0 / (2 * math.pi)) * F.log(f / u + F.sqrt(F.lit(1.0) + F.pow(F.lit(2.0) / u, F.lit(2.0))))


def _effective(u: Column, er: Column) -> Column:
    a = F.lit(1.0) + F.log((F.pow(u, F.lit(4.0)) + F.pow(u / 52, F.lit(2.0))) / (F.pow(u, F.lit(4.0)) + F.lit(0.432))) / 49 + F.log(F.lit(1.0) + F.pow(u / 18.1, F.lit(3.0))) / 18.7
    b = F.lit(0.564) * F.pow((er - 0.9) / (er + 3), F.lit(0.053))
    return (er + 1) / 2 + (er - 1) / 2 * F.pow(F.lit(1.0) + F.lit(10.0) / u, -a * b)


def _thick(u: Column, t: Column, er: Column) -> tuple[Column, Column]:
    """The widths that stand for a strip of thickness t (both over h): in air, and in the dielectric."""
    coth = lambda x: (F.exp(2 * x) + 1) / (F.exp(2 * x) - 1)
    cosh = lambda x: (F.exp(x) + F.exp(-x)) / 2
    air = F.when(t > 0, t / math.pi * F.log(F.lit(1.0) + F.lit(4 * math.e) / (t * F.pow(coth(F.sqrt(6.517 * u)), F.lit(2.0))))).otherwise(F.lit(0.0))
    return u + air, u + air * (F.lit(1.0) + F.lit(1.0) / cosh(F.sqrt(er - 1))) / 2


def microstrip(w: Column, h: Column, t: Column, er: Column) -> Column:
    """struct<z0, e_eff> of a surface microstrip (Hammerstad and Jensen 1980)."""
    u1, ur = _thick(w / h, t / h, er)
    e = _effective(ur, er)
    return F.struct((_homogeneous(ur) / F.sqrt(e)).alias("z0"), (e * F.pow(_homogeneous(u1) / _homogeneous(ur), F.lit(2.0))).alias("e_eff"))


def ipc_microstrip(w: Column, h: Column, t: Column, er: Column) -> Column:
    """IPC-2141: 87 / sqrt(er + 1.41) * ln(5.98 h / (0.8 w + t))."""
    return F.lit(87.0) / F.sqrt(er + 1.41) * F.log(5.98 * h / (0.8 * w + t))


def ipc_stripline(w: Column, b: Column, t: Column, er: Column) -> Column:
    """IPC-2141: 60 / sqrt(er) * ln(1.9 b / (0.8 w + t)), b between the planes."""
    return F.lit(60.0) / F.sqrt(er) * F.log(1.9 * b / (0.8 * w + t))


def ipc_coupled_microstrip(w: Column, h: Column, t: Column, er: Column, s: Column) -> Column:
    """IPC-2141 differential: 2 z0 (1 - 0.48 exp(-0.96 s / h))."""
    return 2 * ipc_microstrip(w, h, t, er) * (F.lit(1.0) - 0.48 * F.exp(-0.96 * s / h))


def ipc_coupled_stripline(w: Column, b: Column, t: Column, er: Column, s: Column) -> Column:
    """IPC-2141 differential: 2 z0 (1 - 0.347 exp(-2.9 s / b))."""
    return 2 * ipc_stripline(w, b, t, er) * (F.lit(1.0) - 0.347 * F.exp(-2.9 * s / b))


def agm(a: Column, b: Column, rounds: int = 24) -> Column:
    """The arithmetic-geometric mean (it has converged long before the rounds end)."""
    step = lambda s, _: F.struct(((s["a"] + s["b"]) / 2).alias("a"), F.sqrt(s["a"] * s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), step)["a"]


def stripline(w: Column, b: Column, t: Column, er: Column) -> Column:
    """Between two planes b apart: exact conformal map for a thin strip (Cohn 1954), Wheeler's 1978 width for its thickness."""
    x = t / b
    m = F.lit(2.0) / (F.lit(1.0) + F.lit(2.0 / 3) * x / (F.lit(1.0) - x))
    wide = F.when(
        t > 0,
        x / (math.pi * (F.lit(1.0) - x)) * (F.lit(1.0) - 0.5 * F.log(F.pow(x / (F.lit(2.0) - x), F.lit(2.0)) + F.pow(0.0796 * x / (w / b + 1.1 * x), m))),
    ).otherwise(F.lit(0.0))
    u = (w / (b - t) + wide) * math.pi / 2
    sech = F.lit(2.0) / (F.exp(u) + F.exp(-u))
    tanh = (F.exp(u) - F.exp(-u)) / (F.exp(u) + F.exp(-u))
    return F.lit(ETA0 / 4) / F.sqrt(er) * _k_ratio(sech, tanh)


def _k_ratio(k: Column, complement: Column) -> Column:
    """K(k) / K(k'), where k'^2 = 1 - k^2: K(k) is pi / (2 agm(1, k'))."""
    return agm(F.lit(1.0), k) / agm(F.lit(1.0), complement)


def cpw(w: Column, s: Column, h: Column, er: Column) -> Column:
    """struct<z0, e_eff> of a coplanar waveguide on a substrate of height h without ground (Ghione and Naldi 1984)."""
    sinh = lambda x: (F.exp(x) - F.exp(-x)) / 2
    k0 = w / (w + 2 * s)
    k1 = sinh(math.pi * w / (4 * h)) / sinh(math.pi * (w + 2 * s) / (4 * h))
    over = lambda k: _k_ratio(k, F.sqrt(F.lit(1.0) - k * k))
    e = F.lit(1.0) + (er - 1) / 2 * over(k1) / over(k0)
    return F.struct((F.lit(ETA0 / 4) / F.sqrt(e) / over(k0)).alias("z0"), e.alias("e_eff"))


def grounded_cpw(w: Column, s: Column, h: Column, er: Column) -> Column:
    """struct<z0, e_eff> of a coplanar waveguide above a ground plane (Ghione and Naldi 1987)."""
    tanh = lambda x: (F.exp(2 * x) - 1) / (F.exp(2 * x) + 1)
    k0 = w / (w + 2 * s)
    k1 = tanh(math.pi * w / (4 * h)) / tanh(math.pi * (w + 2 * s) / (4 * h))
    over = lambda k: _k_ratio(k, F.sqrt(F.lit(1.0) - k * k))
    q = over(k1) / over(k0)
    e = (F.lit(1.0) + er * q) / (F.lit(1.0) + q)
    return F.struct((F.lit(ETA0 / 2) / F.sqrt(e) / (over(k0) + over(k1))).alias("z0"), e.alias("e_eff"))


def synthesized(z0, target: Column, lo: float, hi: float, rounds: int = 60) -> Column:
    """The width at which a falling z0(width) meets the target, by bisection on its logarithm; null if it isn't between lo and hi."""

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = z0(F.exp(mid)) > target
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    ends = F.struct(F.lit(math.log(lo)).alias("lo"), F.lit(math.log(hi)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), ends, step)
    return F.when((z0(F.lit(lo)) >= target) & (z0(F.lit(hi)) <= target), F.exp((found["lo"] + found["hi"]) / 2))


def skin_depth(frequency: Column, conductivity: Column) -> Column:
    """sqrt(1 / (pi f mu0 sigma)), in metres."""
    return F.sqrt(F.lit(1.0) / (math.pi * frequency * (4e-7 * math.pi) * conductivity))


def hammerstad_roughness(rms: Column, depth: Column) -> Column:
    """The factor by which roughness raises the surface resistance: 1 + 2 / pi atan(1.4 (rms / depth)^2)."""
    return F.lit(1.0) + F.lit(2 / math.pi) * F.atan(1.4 * F.pow(rms / depth, F.lit(2.0)))


def series_permittivity(layers: Column) -> Column:
    """struct<h, er> of stacked dielectrics (array<struct<t, er>>): h = sum t, er = h / sum(t / er)."""
    h = F.aggregate(layers, F.lit(0.0), lambda s, x: s + x["t"])
    return F.struct(h.alias("h"), (h / F.aggregate(layers, F.lit(0.0), lambda s, x: s + x["t"] / x["er"])).alias("er"))


def coupled_stripline(w: Column, b: Column, er: Column, s: Column) -> Column:
    """struct<odd, even, differential> of thin edge-coupled strips between planes b apart (Cohn 1955)."""
    tanh = lambda x: (F.exp(2 * x) - 1) / (F.exp(2 * x) + 1)
    one, both = tanh(math.pi * w / (2 * b)), tanh(math.pi * (w + s) / (2 * b))
    other = lambda k: F.sqrt(F.lit(1.0) - k * k)
    line = lambda k: F.lit(ETA0 / 4) / F.sqrt(er) * _k_ratio(other(k), k)
    odd, even = line(one / both), line(one * both)
    return F.struct(odd.alias("odd"), even.alias("even"), (2 * odd).alias("differential"))


def structure(above: Column, below: Column, beside: Column, pair: Column) -> Column:
    """What a section is by its surroundings: planes above and below, copper beside it, and whether it is a pair."""
    single = F.when(above & below, "stripline").when((above | below) & beside, "grounded_cpw").when(above | below, "microstrip").when(beside, "cpw").otherwise("none")
    return F.when(pair & (single != "none"), F.concat(F.lit("coupled_"), single)).otherwise(single)


def dispersed(e_eff: Column, er: Column, u: Column, ghz_mm: Column) -> Column:
    """The effective permittivity of a microstrip (u = w / h) at a frequency times height in GHz mm (Kirschning and Jansen 1982)."""
    n = lambda v: F.lit(float(v))
    p1 = n(0.27488) + u * (n(0.6315) + n(0.525) / F.pow(n(1) + n(0.0157) * ghz_mm, n(20))) - n(0.065683) * F.exp(n(-8.7513) * u)
    p2 = n(0.33622) * (n(1) - F.exp(n(-0.03442) * er))
    p3 = n(0.0363) * F.exp(n(-4.6) * u) * (n(1) - F.exp(-F.pow(ghz_mm / n(38.7), n(4.97))))
    p4 = n(1) + n(2.751) * (n(1) - F.exp(-F.pow(er / n(15.916), n(8))))
    p = p1 * p2 * F.pow((n(0.1844) + p3 * p4) * ghz_mm, n(1.5763))
    return er - (er - e_eff) / (n(1) + p)


#: Models by name: what they need, the function, and the ranges (of a ratio, least and most) that its formula was published for.
MODELS = {
    "microstrip": (("w", "h", "t", "er"), lambda p: microstrip(p["w"], p["h"], p["t"], p["er"])["z0"], (("w", "h", 0.01, 100.0), ("t", "h", 0.0, 0.2))),
    "stripline": (("w", "b", "t", "er"), lambda p: stripline(p["w"], p["b"], p["t"], p["er"]), (("t", "b", 0.0, 0.25),)),
    "cpw": (("w", "s", "h", "er"), lambda p: cpw(p["w"], p["s"], p["h"], p["er"])["z0"], (("w", "h", 0.0, 10.0),)),
    "grounded_cpw": (("w", "s", "h", "er"), lambda p: grounded_cpw(p["w"], p["s"], p["h"], p["er"])["z0"], (("w", "h", 0.0, 10.0),)),
    "coupled_stripline": (("w", "b", "er", "s"), lambda p: coupled_stripline(p["w"], p["b"], p["er"], p["s"])["differential"], (("w", "b", 0.35, 10.0),)),
    "ipc_microstrip": (("w", "h", "t", "er"), lambda p: ipc_microstrip(p["w"], p["h"], p["t"], p["er"]), (("w", "h", 0.1, 2.0), ("er", None, 1.0, 15.0))),
    "ipc_stripline": (("w", "b", "t", "er"), lambda p: ipc_stripline(p["w"], p["b"], p["t"], p["er"]), (("t", "b", 0.0, 0.25),)),
    "ipc_coupled_microstrip": (("w", "h", "t", "er", "s"), lambda p: ipc_coupled_microstrip(p["w"], p["h"], p["t"], p["er"], p["s"]), (("w", "h", 0.1, 2.0),)),
    "ipc_coupled_stripline": (("w", "b", "t", "er", "s"), lambda p: ipc_coupled_stripline(p["w"], p["b"], p["t"], p["er"], p["s"]), (("t", "b", 0.0, 0.25),)),
}


def calculated(model: Column, **given: Column) -> Column:
    """struct<z0, valid> by the model that each row names; null for an unknown one, or one that isn't given all it needs. valid: within the published range."""
    out = F.lit(None)
    for name, (needs, f, ranges) in MODELS.items():
        if set(needs) <= given.keys():
            valid = F.lit(True)
            for a, b, least, most in ranges:
                valid = valid & (given[a] / given[b] if b else given[a]).between(least, most)
            out = F.when(model == name, F.struct(f(given).alias("z0"), valid.alias("valid"))).otherwise(out)
    return out
