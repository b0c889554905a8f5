"""Operators over voxels in long form: (set_id, x, y, z, grain), grain 0 for an empty cell."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticeframe.operators import bricks, growth
from latticeframe.operators.components import connected_components
from latticeframe.plans.lineage import materialise, small_side

CELL = ["set_id", "x", "y", "z"]
PI_2D = 3.14159
#: Faces of a cell as normal and the four corners, in drawing order, and the eight corners in node order.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
FACES = [((-1, 0, 0), (1, 5, 8, 4)), ((0, 1, 0), (4, 8, 7, 3)), ((1, 0, 0), (3, 7, 6, 2)), ((0, -1, 0), (2, 6, 5, 1)), ((0, 0, 1), (6, 7, 8, 5)), ((0, 0, -1), (3, 2, 1, 4))]


def offsets(kind: int) -> list[tuple[int, int, int]]:
    """The 6, 18 or 26 neighbour offsets in lexicographic order."""
    reach = {6: 1, 18: 2, 26: 3}[kind]
    return [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= reach]


def neighbours(cells: DataFrame, kind: int, n: int, periodic: bool = False) -> DataFrame:
    """The cells with (offset_no, nx, ny, nz) for each neighbour: those inside the lattice, or wrapped round."""
    steps = F.array(*(F.struct(F.lit(i).alias("offset_no"), *(F.lit(v).alias(c) for v, c in zip(o, ("dx", "dy", "dz"), strict=True))) for i, o in enumerate(offsets(kind))))
    moved = cells.withColumn("o", F.explode(steps))
    at = {f"n{c}": F.col(c) + F.col(f"o.d{c}") for c in "xyz"}
    if periodic:
        at = {k: F.pmod(v, F.lit(n)) for k, v in at.items()}
    moved = moved.select(*cells.columns, F.col("o.offset_no").alias("offset_no"), *(v.alias(k) for k, v in at.items()))
    inside = " and ".join(f"n{c} between 0 and {n - 1}" for c in "xyz")
    return moved if periodic else moved.where(inside)


SIDES = [normal for normal, _ in FACES]


def with_neighbours(voxels: DataFrame, brick: int = 14) -> DataFrame:
    """The cells with `sides`, the ids of their six neighbours in the order of FACES; null where there is no cell. A cell
    that repeats counts once, with its largest id.

    Cells are dealt once, by cubic bricks with a rim of one cell, and sorted once by their place in the brick's array, in
    which a neighbour is a fixed number of places away: a window frame of just that place. A brick with its rim has 4096
    cells, which a window keeps in memory."""
    wide = brick + 2
    at = [F.col(c) - F.col(f"b{c}") * brick + 1 for c in "xyz"]
    place = ((at[0] * wide + at[1]) * wide + at[2]).cast("int")
    rows = bricks.dealt(voxels.select(*CELL, "grain"), brick, 1).select("*", place.alias("place"))
    w = W.partitionBy(*bricks.BRICK).orderBy("place")
    steps = [(x * wide + y) * wide + z for x, y, z in SIDES]
    sides = [F.max("grain").over(w.rangeBetween(s, s)).alias(f"side{k}") for k, s in enumerate(steps)]
    here = F.max("grain").over(w.rangeBetween(0, 0)).alias("here")
    once = F.coalesce(F.lag("place").over(w) != F.col("place"), F.lit(True)).alias("once")
    found = rows.select(*CELL, "own", here, once, *sides).where("own and once")
    return found.select(*CELL, F.col("here").alias("grain"), F.array(*(f"side{k}" for k in range(6))).alias("sides"))


def open_side(grain: Column, other: Column) -> Column:
    return other.isNull() | (other != grain)


def grain_volume(voxels: DataFrame) -> DataFrame:
    return voxels.where("grain > 0").groupBy("set_id", "grain").agg(F.count(F.lit(1)).alias("volume"))


def _relative(grains: DataFrame) -> DataFrame:
    """Volumes relative to the largest of their set; sets are few beside grains."""
    largest = small_side(grains.groupBy("set_id").agg(F.max("volume").alias("largest")), "largest")
    return grains.join(largest, "set_id").withColumn("norm_volume", F.col("volume") / F.col("largest")).drop("largest")


def grain_norm_volume(voxels: DataFrame) -> DataFrame:
    return _relative(materialise(grain_volume(voxels), "volumes"))


def _measured(voxels: DataFrame) -> DataFrame:
    """(set_id, grain, volume, surface_area): cells, and sides at the edge or against another id, in one pass."""
    exposed = F.size(F.filter("sides", lambda other: open_side(F.col("grain"), other))).cast("long")
    cells = with_neighbours(voxels).where("grain > 0")
    return cells.groupBy("set_id", "grain").agg(F.count(F.lit(1)).alias("volume"), F.sum(exposed).alias("surface_area"))


def grain_surface(voxels: DataFrame) -> DataFrame:
    """Sides at the edge or against another id; a missing cell counts as an edge."""
    return _measured(voxels).select("set_id", "grain", "surface_area")


def esr(volume):
    return F.pow(3 * volume / (4 * F.pi()), F.lit(1 / 3))


def grain_properties(voxels: DataFrame) -> DataFrame:
    """Volume, relative volume, surface, equivalent radius and moment of inertia of every grain."""
    grains = _relative(materialise(_measured(voxels), "grains")).withColumn("esr", esr(F.col("volume")))
    return grains.withColumn("inertia", 0.4 * F.col("esr") * F.col("esr"))


def fill_fraction(voxels: DataFrame) -> DataFrame:
    filled = F.avg((F.col("grain") > 0).cast("double"))
    return voxels.groupBy("set_id").agg(filled.alias("fill_fraction"), F.min(F.col("grain") > 0).alias("complete"))


def _first_of_parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For places 0..n-1 linked by pairs (a, b): the smallest place each is connected to."""
    least = np.arange(n)
    while len(a):
        la, lb = least[a], least[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(least, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(further := least[least], least):
            least = further
    return least


def _label_tile(cells: pa.Table, stride: int) -> pa.Table:
    """The tile's own filled cells with the label of their part of the tile and whether some neighbour is another."""
    x, y, grain, own = (cells.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "grain", "own"))
    if len(x) and max(x.max(), y.max()) >= stride:
        raise ValueError(f"a cell lies beyond the lattice's edge {stride}")
    wide, high, x0, y0 = int(x.max() - x.min()) + 3, int(y.max() - y.min()) + 3, x.min() - 1, y.min() - 1
    at = (y - y0) * wide + x - x0
    grid, mine = np.full(wide * high, -1, np.int64), np.zeros(wide * high, bool)
    grid[at], mine[at] = grain, own & (grain > 0)
    spots = np.flatnonzero(mine)
    edge = np.zeros(len(spots), bool)
    for step in (-1, 1, -wide, wide):
        edge |= grid[spots + step] != grid[spots]
    pairs = [(spots[like], spots[like] + step) for step in (1, wide) for like in [mine[spots + step] & (grid[spots + step] == grid[spots])]]
    least = _first_of_parts(len(grid), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))[spots]
    place = lambda v: (v // wide + y0, v % wide + x0)
    (row, column), (row0, column0) = place(spots), place(least)
    fixed = [pa.array(np.full(len(spots), cells.column(c)[0].as_py()), pa.int64()) for c in ("set_id", "z")]
    values = [pa.array(v.astype(np.int64)) for v in (grid[spots], column, row, row0 * stride + column0)]
    return pa.table([*fixed, *values, pa.array(edge)], names=["set_id", "z", "grain", "x", "y", "lbl", "edge"])


def slice_cells(voxels: DataFrame, n: int, tile: int = 512) -> DataFrame:
    """(set_id, z, grain, x, y, lbl, edge) of filled cells: like cells joined by edges in a slice have the label y * stride
    + x of their first cell in the order of y, x, with a stride of 1000 or the lattice's edge n, if that is more; edge:
    some of the four neighbours is missing or another.

    Slices are cut into square tiles, which are labelled each on its own, with a rim of cells of the tiles next to them;
    labels are joined across tiles only where a slice has several."""
    stride = max(1000, n)
    home = {c: F.floor(F.col(c) / tile).cast("long") for c in "xy"}
    places = [F.struct(F.lit(True).alias("own"), home["x"].alias("tx"), home["y"].alias("ty"))]
    for c in "xy":
        for rim, step in ((0, -1), (tile - 1, 1)):
            moved = [(home[a] + (step if a == c else 0)).alias(f"t{a}") for a in "xy"]
            places.append(F.when(F.pmod(F.col(c), F.lit(tile)) == rim, F.struct(F.lit(False).alias("own"), *moved)))
    dealt = voxels.select(*(F.col(c).cast("long").alias(c) for c in (*CELL, "grain")), F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p"))
    labelled = dealt.select(*CELL, "grain", "p.*").groupBy("set_id", "z", "tx", "ty").applyInArrow(lambda cells: _label_tile(cells, stride), "set_id long, z long, grain long, x long, y long, lbl long, edge boolean")
    if n <= tile:
        return labelled
    labelled = materialise(labelled, "tiles")
    node = (F.col("set_id") * stride + F.col("z")) * (stride * stride) + F.col("lbl")
    edges = None
    for c in "xy":
        before = labelled.where(F.pmod(F.col(c), F.lit(tile)) == tile - 1).select("set_id", "z", "grain", *((F.col(a) + int(a == c)).alias(a) for a in "xy"), node.alias("u"))
        met = before.join(labelled.where(F.pmod(F.col(c), F.lit(tile)) == 0).select("set_id", "z", "grain", "x", "y", node.alias("v")), ["set_id", "z", "grain", "x", "y"]).select("u", "v")
        edges = met if edges is None else edges.unionByName(met)
    found = materialise(connected_components(edges), "slice-components")
    joined = labelled.withColumn("node", node).join(found, "node", "left")
    return joined.select("set_id", "z", "grain", "x", "y", F.coalesce(F.col("component") % (stride * stride), F.col("lbl")).alias("lbl"), "edge")


def slice_components(voxels: DataFrame, n: int, tile: int = 512) -> DataFrame:
    """(set_id, z, grain, x, y, lbl) of the filled cells, as in slice_cells."""
    return slice_cells(voxels, n, tile).drop("edge")


def slice_grains(voxels: DataFrame, n: int, tile: int = 512) -> DataFrame:
    """One row per component of a slice: pixels, boundary pixels, share of the slice, equivalent radius, shape factors."""
    cells = slice_cells(voxels, n, tile)
    found = cells.groupBy("set_id", "z", "grain", F.col("lbl").alias("component")).agg(F.count(F.lit(1)).alias("area"), F.sum(F.col("edge").cast("long")).alias("perimeter"))
    area, p = F.col("area"), F.col("perimeter")
    found = found.withColumn("norm_area", area / float(n * n)).withColumn("ecr", F.sqrt(F.col("norm_area") / PI_2D))
    ratio = lambda d: F.try_divide(4 * PI_2D * area, d.cast("double"))
    return found.withColumn("shape_factor", ratio(p * p)).withColumn("shape_factor_compat", ratio(p.bitwiseXOR(F.lit(2).cast("long"))))


def slice_last_component(slices: DataFrame) -> DataFrame:
    """For each slice and id the component that a row-major scan meets last."""
    values = F.struct(*(c for c in slices.columns if c not in ("set_id", "z", "grain")))
    return slices.groupBy("set_id", "z", "grain").agg(F.max_by(values, "component").alias("v")).select("set_id", "z", "grain", "v.*")


def exposed_faces(voxels: DataFrame) -> DataFrame:
    """(cell, grain, nx, ny, nz, corners): faces of filled cells against nothing or another id, with their four corners."""
    sides = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(v).alias(c) for v, c in zip(normal, ("nx", "ny", "nz"), strict=True)), F.col("sides")[k].alias("other")) for k, normal in enumerate(SIDES)))
    shown = F.filter(sides, lambda side: open_side(F.col("grain"), side["other"]))
    faces = with_neighbours(voxels).where("grain > 0").select(*CELL, "grain", F.explode(shown).alias("f")).select(*CELL, "grain", "f.*")
    # the corners follow from the face once it is known to be shown
    offset = F.array(*(F.array(*(F.array(*(F.lit(v) for v in CORNERS[i - 1])) for i in corners)) for _, corners in FACES))
    shift = F.transform(offset[F.col("k")], lambda o: F.array(F.col("x") + o[0], F.col("y") + o[1], F.col("z") + o[2]))
    return faces.select(*CELL, "grain", "nx", "ny", "nz", shift.alias("corners"))


def surface_voxels(voxels: DataFrame) -> DataFrame:
    """Filled cells with some exposed face."""
    shown = F.exists("sides", lambda other: open_side(F.col("grain"), other))
    return with_neighbours(voxels).where("grain > 0").where(shown).select(*CELL, "grain")


def near_cell_pairs(points: DataFrame, edge: int) -> DataFrame:
    """(id_a, id_b): different points, id_a < id_b, whose cells of the given edge are the same or touch. Columns id, x, y, z.

    Two cells that touch meet once: a cell looks into itself and the 13 of the 26 around it that come later. Spark's
    estimate of a side does not see that its rows are multiplied and would send it through the driver, so the join is one of
    two sorted sides, of which Spark can split a cell with many points."""
    cell = lambda c: F.floor(F.col(c) / edge).cast("long")
    keyed = points.select("id", *(cell(c).alias(f"c{c}") for c in "xyz"))
    later = [o for o in itertools.product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    near = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(o, ("dx", "dy", "dz"), strict=True)), F.lit(not any(o)).alias("same")) for o in later))
    spread = keyed.withColumn("o", F.explode(near)).select(F.col("id").alias("other"), F.col("o.same").alias("same"), *((F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in "xyz"))
    met = keyed.join(spread.hint("merge"), ["cx", "cy", "cz"]).where("id < other or (id > other and not same)")
    return met.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))


def cluster_contacts(cells: DataFrame, n: int, periodic: bool = False) -> DataFrame:
    """(id_a, id_b): clusters with cells at a Manhattan distance of one. Columns cluster, x, y, z.

    Two sorted sides for the reason given in near_cell_pairs."""
    moved = neighbours(cells.select("cluster", "x", "y", "z"), 6, n, periodic).select(F.col("cluster").alias("id_a"), *(F.col(f"n{c}").alias(c) for c in "xyz"))
    return moved.join(cells.select(F.col("cluster").alias("id_b"), "x", "y", "z").hint("merge"), ["x", "y", "z"]).where("id_a < id_b").select("id_a", "id_b").distinct()


def _brick_parts(cells: pa.Table, n: int, edge: int) -> pa.Table:
    """A brick's cells with `part`, the smallest cluster that theirs is joined to by contacts inside the brick and its rim,
    and `first`, which one row of each cluster has. Places may hold several clusters, which touch those next to them and not
    one another; places outside the lattice touch nothing."""
    wide = edge + 2
    place = bricks.places(cells, bricks.corner(cells, edge, 1))
    at = (place[0] * wide + place[1]) * wide + place[2]
    inside = np.all([(v >= 0) & (v < n) for v in (bricks.column(cells, c) for c in "xyz")], axis=0)
    clusters, shown, cluster = np.unique(bricks.column(cells, "cluster"), return_index=True, return_inverse=True)
    there = np.zeros(wide**3 + wide * wide, bool)
    there[at[inside]] = True
    spots, met, pairs = np.flatnonzero(there), np.zeros(len(there), bool), []
    for step, along in ((wide * wide, spots // (wide * wide)), (wide, spots // wide % wide), (1, spots % wide)):
        like = spots[(along < wide - 1) & there[spots + step]]
        met[like] = met[like + step] = True
        pairs.append((like + len(clusters), like + step + len(clusters)))
    # clusters are numbered before places and in order, so the first of a part is its smallest cluster
    touching = inside & met[at]
    pairs.append((cluster[touching], at[touching] + len(clusters)))
    least = _first_of_parts(len(clusters) + len(there), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    first = np.zeros(len(at), bool)
    first[shown] = True
    return cells.select(["x", "y", "z", "cluster", "own"]).append_column("part", pa.array(clusters[least[cluster]], pa.int64())).append_column("first", pa.array(first))


def cluster_merge(cells: DataFrame, n: int, edge: int = 32) -> DataFrame:
    """(x, y, z, cluster, merged): the cells with the smallest cluster that theirs is joined to by contacts.

    Cells are dealt to bricks with a rim once, and each brick joins what touches in it. Parts of several bricks are linked
    where they have a cluster in common, and only these links go to the general components: where clusters are of cells near
    each other they grow with the bricks, not with the cells."""
    kept = cells.select(*(F.col(c).cast("long").alias(c) for c in ("x", "y", "z", "cluster")))
    odd = kept.where("x is null or y is null or z is null or cluster is null")
    dealt = bricks.dealt(kept.where("cluster is not null"), edge, 1)
    schema = "x long, y long, z long, cluster long, own boolean, part long, first boolean"
    parts = materialise(dealt.groupBy("bx", "by", "bz").applyInArrow(lambda rows: _brick_parts(rows, n, edge), schema), "cluster-parts")
    shared = parts.where("first").select("part", F.min("part").over(W.partitionBy("cluster")).alias("least"))
    links = shared.where("part > least").distinct()
    found = materialise(connected_components(links, "part", "least"), "cluster-components")
    whole = parts.where("own").select("x", "y", "z", "cluster", "part")
    if not odd.isEmpty():  # cells without a place or a cluster touch nothing and keep their rows
        known = parts.groupBy("cluster").agg(F.min("part").alias("part"))
        whole = whole.unionByName(odd.join(known, "cluster", "left").select("x", "y", "z", "cluster", F.coalesce("part", "cluster").alias("part")))
    return whole.join(found, F.col("part") == F.col("node"), "left").select("x", "y", "z", "cluster", F.coalesce("component", "part").alias("merged"))


def void_fill(voxels: DataFrame, n: int) -> DataFrame:
    """Empty cells take the id of their first filled neighbour in the order of the 26 offsets, round by round, until none
    can. See growth.py."""
    return growth.voids_filled(voxels.select(*CELL, "grain"), n)


def nearest_seed_label(cells: DataFrame, seeds: DataFrame, n: int, kind: int = 26, periodic: bool = False) -> DataFrame:
    """(cell columns, grain, d): the seed (grain, sx, sy, sz[, t0]) whose growth over 6, 18 or 26 neighbours reaches a cell
    first, and when; ties to the smallest grain. See growth.py."""
    if "t0" not in seeds.columns:
        seeds = seeds.withColumn("t0", F.lit(0).cast("long"))
    return growth.labelled(cells, seeds, n, kind, periodic)


def growth_curve(labelled: DataFrame, n: int) -> DataFrame:
    """(set_id, d, frontier, filled, fraction) of each step of growth."""
    steps = labelled.groupBy("set_id", "d").agg(F.count(F.lit(1)).alias("frontier"))
    filled = F.sum("frontier").over(W.partitionBy("set_id").orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumn("filled", filled).withColumn("fraction", F.col("filled") / float(n**3))


def lattice(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n**3).select(F.floor(i / (n * n)).cast("long").alias("x"), (F.floor(i / n) % n).cast("long").alias("y"), (i % n).alias("z"), F.lit(0).cast("long").alias("grain"))


def in_fibre_array(cells: DataFrame, n: int, r: int) -> DataFrame:
    """The cells with region 5 in a staggered array of cores of radius r, whose distance is cut to whole numbers, else 1.

    A core holds the columns (x, y) at most r + 1 from its centre, so cores list their columns and the cells look
    theirs up."""
    pitch = 2 * r + 5
    count = n // pitch + 1
    start = int((n - count * pitch) / 2)
    ids = cells.sparkSession.range(count * count)
    i, j = F.floor(F.col("id") / count), F.col("id") % count
    shift = F.when(j % 2 == 1, pitch // 2).otherwise(0)
    centres = ids.select((start + i * pitch + r + shift).cast("long").alias("cx"), (start + j * pitch + r).cast("long").alias("cy"))
    reach = F.sequence(F.lit(-r - 1), F.lit(r + 1))
    spots = centres.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach)).where(F.floor(F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))) <= r)
    inside = spots.select((F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"), F.lit(5).alias("core")).distinct()
    return cells.join(inside, ["x", "y"], "left").select("x", "y", "z", F.coalesce("core", F.lit(1)).alias("region"))


def with_orientation(voxels: DataFrame, orientations: DataFrame) -> DataFrame:
    """The cells with the orientation of their grain and its coordinate system, grain + 11; null where there is none."""
    named = orientations.withColumnRenamed("grain", "of")
    both = voxels.join(small_side(named, "orientations"), F.col("grain") == F.col("of"), "left").drop("of")
    return both.withColumn("coord_sys_id", F.col("grain") + 11)
