"""Deterministic generators: keyed hashes stand in for random numbers, so partitioning changes nothing."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticeframe.functions import scalar as S
from latticeframe.operators import mesh
from latticeframe.plans.lineage import materialise


def seed_sample(keys: DataFrame, n: int, seed: int) -> DataFrame:
    """(grain, x, y, z): a cell for each key i, ids i + 1; of seeds in one cell the later stays."""
    at = [F.floor(S.uniform(seed, "i", c) * n).cast("long").alias(a) for c, a in enumerate("xyz")]
    return keys.select((F.col("i") + 1).alias("grain"), *at).groupBy("x", "y", "z").agg(F.max("grain").alias("grain")).select("grain", "x", "y", "z")


def _digits(column: str, bits: int) -> list[Column]:
    """A number's digits of 16 bits, leading ones first."""
    return [F.shiftright(F.col(column).cast("long"), at).bitwiseAND(F.lit(65535)) for at in range(bits - 16, -1, -16)]


def smallest(keyed: DataFrame, k: int) -> DataFrame:
    """The k rows of the smallest (h, i), h of 32 bits and i not negative: all of them where there are no more.

    Selection by digits: counts of a digit's values, at most 65,536 of them, say in which value the k-th row lies; rows
    below it are taken, rows of it go on to the next digit. Where a digit's values end with the k-th row, that is all."""
    taken, open_rows, left = [], keyed, k
    for digit in [*_digits("h", 32), *_digits("i", 64)]:
        values = open_rows.groupBy(digit.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        running = values.withColumn("upto", F.sum("c").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
        last = running.where(F.col("upto") >= left).agg(F.min(F.struct("v", "upto", "c"))).first()[0]
        if last is None or left <= 0:
            taken.append(open_rows if left > 0 else open_rows.where("false"))
            break
        if last.upto == left:
            taken.append(open_rows.where(digit <= last.v))
            break
        taken.append(open_rows.where(digit < last.v))
        open_rows, left = open_rows.where(digit == last.v), left - (last.upto - last.c)
    else:  # rows that repeat: as many of them as are left
        taken.append(open_rows.withColumn("n", F.row_number().over(W.partitionBy("h", "i").orderBy("h"))).where(F.col("n") <= left).drop("n"))
    return functools.reduce(DataFrame.unionByName, taken)


def seed_sample_distinct(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """(grain, x, y, z): the k cells (i, x, y, z) with the smallest keyed hashes, ids in that order."""
    hashed = cells.select(F.lit(1).alias("set_id"), "i", "x", "y", "z", S.mix32((F.col("i") + seed * 1000003) % 4294967296).alias("h"))
    first = smallest(materialise(hashed, "hashed"), k).withColumn("slab", F.shiftright("h", 16))
    return mesh.numbered(first, "slab", ["h", "i"], "p").select((F.col("p") + 1).alias("grain"), "x", "y", "z")


def load_case_grid(spark: SparkSession, steps: int, low: float, high: float, keys: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(load_step, exx, eyy, ezz, exy, eyz, exz): all combinations nested x, y, z, xy, xz, yz with the last fastest,
    then one random case for each key i."""
    names, i = ["exx", "eyy", "ezz", "exy", "exz", "eyz"], F.col("id")
    level = lambda d: low + (F.floor(i / steps**d) % steps) * ((high - low) / max(1, steps - 1))
    grid = spark.range(steps**6).select((i + 1).alias("load_step"), *(level(5 - p).alias(c) for p, c in enumerate(names)))
    if keys is not None:
        drawn = keys.select((F.col("i") + 1 + steps**6).alias("load_step"), *((low + S.uniform(seed, "i", p) * (high - low)).alias(c) for p, c in enumerate(names)))
        grid = grid.unionByName(drawn)
    return grid.select("load_step", "exx", "eyy", "ezz", "exy", "eyz", "exz")


def with_uniforms(keys: DataFrame, draws: dict[str, tuple[int, int]]) -> DataFrame:
    """Columns of keyed uniforms, name to (seed, c). The hash's rounds are columns of their own: nested in one
    expression each round would double it."""
    values = {name: (F.col("i") * 6 + (c + 1 + seed * 1000003)) % 4294967296 for name, (seed, c) in draws.items()}
    keys = keys.withColumns(values)
    for final in (False, False, True):
        mixed = {name: F.col(name).bitwiseXOR(F.shiftright(name, 16)) for name in draws}
        keys = keys.withColumns(mixed)
        if not final:
            keys = keys.withColumns({name: (F.col(name) * 73244475) % 4294967296 for name in draws})
    return keys.withColumns({name: (F.col(name) + 0.5) / 4294967296.0 for name in draws})


def random_orientations(keys: DataFrame, seed: int) -> DataFrame:
    """(grain, phi1, phi, phi2): uniform rotations, from four normal numbers for each key i."""
    pairs = {"w": (seed, 0), "x": (seed, 2), "y": (seed, 4), "z": (seed + 1, 0)}
    drawn = with_uniforms(keys, {f"{n}{k}": (s, c + k) for n, (s, c) in pairs.items() for k in (0, 1)})
    four = {n: F.sqrt(-2 * F.log(f"{n}0")) * F.cos(2 * F.pi() * F.col(f"{n}1")) for n in pairs}
    return drawn.select("i", *(v.alias(n) for n, v in four.items())).select(F.col("i").alias("grain"), S.euler_from_quaternion(*pairs).alias("e")).select("grain", "e.*")


def sample_grid(spark: SparkSession, per_axis: int) -> DataFrame:
    """per_axis^3 points on [0, 3], both ends included."""
    i, step = F.col("id"), 3.0 / (per_axis - 1)
    return spark.range(per_axis**3).select((F.floor(i / per_axis**2) * step).alias("x"), (F.floor(i / per_axis) % per_axis * step).alias("y"), (i % per_axis * step).alias("z"))


def sample_random(keys: DataFrame, seed: int) -> DataFrame:
    """A uniform point of [0, 3)^3 for each key i."""
    return keys.select(*((S.uniform(seed, "i", c) * 3).alias(a) for c, a in enumerate("xyz")))
