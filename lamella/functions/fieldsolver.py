"""Cross-sections of lines by finite volumes: the potential on a graded grid, the line's capacitance from its energy.

The plane x = 0 is a symmetry: 'even' (no field through it: one strip cut in half, or two strips driven alike) or 'odd' (at ground: two strips
driven against each other). The grid's columns are eliminated one after the other (block tridiagonal), so a solve takes columns x rows^3.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

C0, EPS0 = 299_792_458.0, 8.8541878128e-12


def _lines(edges: list[float], smallest: float, growth: float) -> np.ndarray:
    """Grid lines through all edges, fine next to them and coarser away."""
    out = [edges[0]]
    for a, b in zip(edges, edges[1:]):
        steps, size, left = [], smallest, (b - a) / 2
        while left > size * 1.5:
            steps.append(size)
            left -= size
            size *= growth
        half = np.cumsum([*steps, left])
        inner = np.concatenate([a + half, (b - half)[::-1][1:], [b]])
        out += inner.tolist()
    return np.unique(np.round(out, 12))


def capacitance(strips: list[tuple[float, float, float, float]], layers: list[tuple[float, float]], width: float, odd: bool, top: bool, fine: float, air: bool = False) -> float:
    """Farads a metre of the half plane x >= 0 with the strips (x0, x1, y0, y1) at one volt; layers are (upper edge, permittivity) from the ground at y = 0 up."""
    xs = _lines(sorted({0.0, width, *[v for s in strips for v in s[:2] if 0 <= v <= width]}), fine, 1.35)
    ys = _lines(sorted({0.0, *[y for y, _ in layers], *[v for s in strips for v in s[2:]]}), fine, 1.35)
    nx, ny = len(xs), len(ys)
    mid = (ys[1:] + ys[:-1]) / 2
    er = np.ones(ny - 1) if air else np.array([next(e for t, e in layers if m <= t) for m in mid])
    dx, dy = np.diff(xs), np.diff(ys)
    half = np.zeros(nx)
    half[:-1] += dx / 2
    half[1:] += dx / 2
    up = er / dy  # conductance of a vertical edge per width
    side = np.zeros(ny)
    side[:-1] += er * dy / 2
    side[1:] += er * dy / 2  # of a horizontal edge, per 1 / length
    fixed, value = np.zeros((nx, ny), bool), np.zeros((nx, ny))
    fixed[:, 0] = True
    if top:
        fixed[:, -1] = True
    fixed[-1, :] = True
    if odd:
        fixed[0, :] = True
    for x0, x1, y0, y1 in strips:
        inside = np.outer((xs >= x0 - 1e-12) & (xs <= x1 + 1e-12), (ys >= y0 - 1e-12) & (ys <= y1 + 1e-12))
        fixed |= inside
        value[inside] = 1.0
    # block tridiagonal: A_i u_i - L_i u_(i-1) - R_i u_(i+1) = b_i, fixed nodes as identity rows
    blocks, rights, sides = [], [], []
    for i in range(nx):
        a = np.zeros((ny, ny))
        v = up * half[i]
        idx = np.arange(ny - 1)
        a[idx, idx] += v
        a[idx + 1, idx + 1] += v
        a[idx, idx + 1] -= v
        a[idx + 1, idx] -= v
        left, right = (side / dx[i - 1] if i else np.zeros(ny)), (side / dx[i] if i < nx - 1 else np.zeros(ny))
        a[np.arange(ny), np.arange(ny)] += left + right
        f = fixed[i]
        a[f] = 0
        a[f, f] = 1
        blocks.append(a)
        sides.append((np.where(f, 0, left), np.where(f, 0, right)))
        rights.append(np.where(f, value[i], 0.0))
    for i in range(1, nx):
        solved = np.linalg.solve(blocks[i - 1], np.column_stack([np.diag(sides[i - 1][1]), rights[i - 1]]))
        blocks[i] = blocks[i] - sides[i][0][:, None] * solved[:, :-1]
        rights[i] = rights[i] + sides[i][0] * solved[:, -1]
    u = np.zeros((nx, ny))
    u[-1] = np.linalg.solve(blocks[-1], rights[-1])
    for i in range(nx - 2, -1, -1):
        u[i] = np.linalg.solve(blocks[i], rights[i] + sides[i][1] * u[i + 1])
    energy = (np.diff(u, axis=1) ** 2 * up[None, :] * half[:, None]).sum() + (np.diff(u, axis=0) ** 2 * side[None, :] / dx[:, None]).sum()
    return float(energy * EPS0)


def impedance(kind: str, w: float, h: float, t: float, er: float, gap: float = 0.0, coat: float = 0.0, coat_er: float = 3.5) -> tuple[float, float, float]:
    """(ohms, effective permittivity, error in percent) of microstrip, coated, stripline (h to each plane), coupled or coupled_stripline (differential ohms).

    Solved on two grids; the error is the difference of their extrapolation from the finer.
    """
    pair, buried = kind.startswith("coupled"), kind.endswith("stripline")
    strip = (gap / 2, gap / 2 + w, h, h + t) if pair else (0.0, w / 2, h, h + t)
    reach = strip[1] + 8 * h
    if buried:
        layers = [(2 * h + t, er)]
    else:
        coating = [(h + t + coat, coat_er)] if coat else []
        layers = [(h, er), *coating, (h + t + coat + 10 * (h + w), 1.0)]
    found = []
    for fine in (min(w, h, t * 4, gap or w) / 12, min(w, h, t * 4, gap or w) / 24):
        c, c0 = (capacitance([strip], layers, reach, pair, buried, fine, air) for air in (False, True))
        scale = 1 if pair else 2
        z = 1 / (C0 * scale * math.sqrt(c * c0))
        found.append((2 * z if pair else z, c / c0))
    (z1, e1), (z2, e2) = found
    z, e = 2 * z2 - z1, 2 * e2 - e1  # the error falls as the grid's size
    return z, e, abs(z - z2) / z * 100


def solved(rows: DataFrame, kind: str) -> DataFrame:
    """rows (w, h, t, er, and gap for pairs, coat for coated) with z, e_eff and error_pct; each distinct cross-section is solved once."""
    from lamella.operators.matching import solved_once

    keys = ["w", "h", "t", "er", *[c for c in ("gap", "coat") if c in rows.columns]]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        found = [impedance(kind, **{k: float(v) for k, v in zip(keys, row, strict=True)}) for row in frame[keys].itertuples(index=False)]
        return pd.concat([frame.reset_index(drop=True), pd.DataFrame(found, columns=["z", "e_eff", "error_pct"])], axis=1)

    return solved_once(rows, keys, solve, "z double, e_eff double, error_pct double")
