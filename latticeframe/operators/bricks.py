"""Cubic bricks of the lattice: cells dealt to their own brick and, as its rim, to the bricks next to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRICK = ["set_id", "bx", "by", "bz"]


def dealt(cells: DataFrame, brick: int, rim: int) -> DataFrame:
    """The cells (with set_id, x, y, z) once for each brick that has them inside or in its rim of `rim` cells, with the
    brick (bx, by, bz) and `own`, whether they are inside. rim is no more than brick."""
    names = cells.columns
    for c in "xyz":
        home, at = F.floor(F.col(c) / brick).cast("long"), F.pmod(F.col(c), F.lit(brick))
        places = F.array(home, F.when(at < rim, home - 1), F.when(at >= brick - rim, home + 1))
        cells = cells.withColumn(f"b{c}", F.explode(F.filter(places, lambda p: p.isNotNull())))
    inside = [F.col(f"b{c}") == F.floor(F.col(c) / brick) for c in "xyz"]
    return cells.select(*names, "bx", "by", "bz", (inside[0] & inside[1] & inside[2]).alias("own"))


def column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False)


def corner(rows: pa.Table, brick: int, rim: int) -> list[int]:
    """The lattice place of a brick's first cell, rim included, from rows of that brick."""
    return [rows.column(f"b{c}")[0].as_py() * brick - rim for c in "xyz"]


def places(rows: pa.Table, first: list[int]) -> tuple[np.ndarray, ...]:
    """Places of the rows' cells in an array that begins at `first`."""
    return tuple(column(rows, c).astype(np.int64) - f for c, f in zip("xyz", first, strict=True))


def dense(rows: pa.Table, name: str, place: tuple[np.ndarray, ...], edge: int, empty: int) -> np.ndarray:
    """A column as an array of edge^3 cells, `empty` where there is no row."""
    out = np.full((edge,) * 3, empty, np.int64)
    out[place] = column(rows, name)
    return out
