"""Distributed 3-D Fourier transforms in two passes.

A pass transforms the planes of one axis (2-D, grouped by ix), the next the lines along it.  A group
is one plane of n^2 cells, so memory is bounded by a plane and work spreads over n groups a pass;
the shuffle between them is the transpose.  Cells travel as (ix, iy, iz, re, im); with ``batch``, a
column that numbers meshes, many meshes are transformed in the same two passes.  Where a plane is too
large for a task, ``pencil`` takes three passes of lines, a tile of lines a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ["ix", "iy", "iz"]
#: The axis whose planes come first, and the axis of the planes in which the last lines lie.
LAYOUTS = {"slab": ("ix", "iy"), "slab_y": ("iy", "ix"), "slab_z": ("iz", "iy")}
#: Lines of cells in tiles of two axes; ``brick`` also lays the result out in tiles of three.
TILED = ("pencil", "brick")
#: Cells of a tile, about.
TILE_CELLS = 1 << 22


def _pass(cells: DataFrame, fixed: str, shape: tuple[int, int], function: Callable[[np.ndarray, list[str]], np.ndarray], lead: list[str], real: tuple[bool, bool] = (False, False)) -> DataFrame:
    """One plane a group: its cells in an array of ``shape`` through ``function``; ``real`` says whether the cells before and after have a value (val) or re and im."""
    parts = [["val"] if r else ["re", "im"] for r in real]
    schema = ", ".join([f"{c} int" for c in lead + AXES] + [f"{c} double" for c in parts[1]])
    plane = [c for c in AXES if c != fixed]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(shape, float if real[0] else complex)
        values[rows[plane[0]], rows[plane[1]]] = rows["val"].to_numpy() if real[0] else rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        values = function(values, plane)
        i, j = np.indices(values.shape, dtype=np.int32)
        out = {c: np.int32(rows[c].iloc[0]) for c in [*lead, fixed]} | {plane[0]: i.ravel(), plane[1]: j.ravel()}
        out |= {"val": values.ravel()} if real[1] else {"re": values.real.ravel(), "im": values.imag.ravel()}
        return pd.DataFrame(out)[[*lead, *AXES, *parts[1]]]

    cells = cells.select(*lead, *AXES, *[F.col(c).cast("double").alias(c) for c in parts[0]])
    return cells.groupBy(*lead, fixed).applyInPandas(run, schema)


def _transform(cells: DataFrame, n: int, inverse: bool, layout: str, batch: str | None) -> DataFrame:
    if layout in TILED:
        return _tiled(cells, n, inverse, layout, batch)
    first, second = LAYOUTS[layout]
    fft2, fft1 = (np.fft.ifft2, np.fft.ifft) if inverse else (np.fft.fft2, np.fft.fft)
    scale2, scale1 = (n * n, n) if inverse else (1, 1)  # unnormalised both ways
    lead = [batch] if batch else []
    planes = _pass(cells, first, (n, n), lambda v, axes: fft2(v) * scale2, lead)
    return _pass(planes, second, (n, n), lambda v, axes: fft1(v, axis=axes.index(first)) * scale1, lead)


def tiles_of(n: int) -> int:
    """Tiles of an axis, at least two, for which n^3 cells in square tiles of lines have some TILE_CELLS each."""
    return min(n, max(2, math.ceil((n**3 / TILE_CELLS) ** 0.5)))


def _tile(axis: str, n: int, tiles: int) -> Column:
    return F.expr(f"int({axis} * {tiles} div {n})")


def _lines(cells: DataFrame, n: int, along: str, tiles: int, inverse: bool, lead: list[str], schema: str) -> DataFrame:
    """Transform along one axis; a group is a tile of the other two axes."""
    across = [c for c in AXES if c != along]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, end = ([-(-(int(k) + j) * n // tiles) for k in key[-2:]] for j in (0, 1))
        shape = [e - f for f, e in zip(first, end, strict=True)]
        values = np.zeros((*shape, n), complex)
        values[rows[across[0]] - first[0], rows[across[1]] - first[1], rows[along]] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        values = np.fft.ifft(values, axis=2) * n if inverse else np.fft.fft(values, axis=2)
        i, j, k = np.indices(values.shape, dtype=np.int32)
        out = {across[0]: i.ravel() + np.int32(first[0]), across[1]: j.ravel() + np.int32(first[1]), along: k.ravel(), "re": values.real.ravel(), "im": values.imag.ravel()}
        out |= {c: np.int32(v) for c, v in zip(lead, key, strict=False)}
        return pd.DataFrame(out)[[*lead, *AXES, "re", "im"]]

    return cells.groupBy(*lead, *[_tile(c, n, tiles).alias(f"t{c}") for c in across]).applyInPandas(run, schema)


def _tiled(cells: DataFrame, n: int, inverse: bool, layout: str, batch: str | None) -> DataFrame:
    lead = [batch] if batch else []
    schema = ", ".join([f"{c} int" for c in lead + AXES] + ["re double", "im double"])
    tiles = tiles_of(n)
    for along in reversed(AXES):
        cells = _lines(cells, n, along, tiles, inverse, lead, schema)
    return bricks(cells, n) if layout == "brick" else cells


def bricks(cells: DataFrame, n: int) -> DataFrame:
    """Cells laid out by bricks, near ones in one partition, a brick of about a tile's cells."""
    side = min(n, max(2, math.ceil((n**3 / TILE_CELLS) ** (1 / 3))))
    return cells.repartition(side**3, *[_tile(c, n, side) for c in AXES])


def forward(mesh: DataFrame, n: int, layout: str = "slab", batch: str | None = None) -> DataFrame:
    """All n^3 modes of a real mesh (ix, iy, iz, val) whose missing cells are 0, provided each plane has a cell."""
    lead = [batch] if batch else []
    return _transform(mesh.select(*lead, *AXES, F.col("val").alias("re"), F.lit(0.0).alias("im")), n, False, layout, batch)


def inverse(modes: DataFrame, n: int, layout: str = "slab", batch: str | None = None) -> DataFrame:
    """Unnormalised inverse: divide by n^3 for the mesh that was transformed."""
    return _transform(modes, n, True, layout, batch)


def forward_half(mesh: DataFrame, n: int, batch: str | None = None) -> DataFrame:
    """The modes with iz up to n/2 of a real mesh (ix, iy, iz, val), which hold all: half the cells are moved and half the work done."""
    lead = [batch] if batch else []
    planes = _pass(mesh, "ix", (n, n), lambda v, axes: np.fft.rfft2(v), lead, (True, False))
    return _pass(planes, "iy", (n, n // 2 + 1), lambda v, axes: np.fft.fft(v, axis=0), lead)


def inverse_half(modes: DataFrame, n: int, batch: str | None = None) -> DataFrame:
    """(ix, iy, iz, val), unnormalised, of the mesh whose modes with iz up to n/2 are given; they must be those of a real mesh."""
    lead = [batch] if batch else []
    lines = _pass(modes, "iy", (n, n // 2 + 1), lambda v, axes: np.fft.ifft(v, axis=0) * n, lead)
    return _pass(lines, "ix", (n, n // 2 + 1), lambda v, axes: np.fft.irfft2(v, s=(n, n)) * n * n, lead, (False, True))


def half_space(modes: DataFrame, n: int) -> DataFrame:
    """The modes that a real transform stores: iz up to n/2."""
    return modes.where(F.col("iz") <= n // 2)
