"""Operators over nodal results and property values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.functions import scalar as S
from latticeframe.operators.lattice import CORNERS
from latticeframe.plans.lineage import small_side

STEP = ["set_id", "load_step"]


def with_derived(nodes: DataFrame) -> DataFrame:
    """Displacement sum and equivalent stress and strain beside the stored components."""
    return nodes.withColumns({"usum": S.usum(), "seqv": S.seqv(), "epseqv": S.epseqv()})


def limits_of(nodes: DataFrame, component: str) -> DataFrame:
    """(set_id, load_step, low, high) of a component, by a pass over the nodes; a store has them written (store.limits)."""
    return nodes.groupBy(*STEP).agg(F.min(component).alias("low"), F.max(component).alias("high"))


def scaled(nodes: DataFrame, component: str, limits: DataFrame | None = None) -> DataFrame:
    """The nodes with `scaled`, a component's place between its least and largest value in the load step; the limits
    (set_id, load_step, low, high) may be given."""
    limits = limits_of(nodes, component) if limits is None else limits
    return nodes.join(small_side(limits, "limits"), STEP).withColumn("scaled", S.minmax_scale(component, "low", "high")).drop("low", "high")


#: Titles of the grain properties, of a component of a slice and of a grain.
SLICE_TITLES = {"Norm Area": "norm_area", "Perimeter": "perimeter", "ECR": "ecr", "Shape factor": "shape_factor", "Area": "area"}
GRAIN_TITLES = {"Volume": "volume", "Norm Volume": "norm_volume", "Surface Area": "surface_area", "ESR": "esr", "Inertia Moment": "inertia"}


def grain_property(title: str, slices: DataFrame, grains: DataFrame) -> DataFrame:
    """(set_id, title, grain, z, component, value) of the grain property of a title, z and component null for those of whole
    grains. slices: lattice.slice_grains; grains: lattice.grain_properties."""
    if title not in SLICE_TITLES and title not in GRAIN_TITLES:
        raise ValueError(f"no grain property has the title {title!r}")
    flat = title in SLICE_TITLES
    rows, value = (slices, SLICE_TITLES[title]) if flat else (grains, GRAIN_TITLES[title])
    place = [F.col(c) if flat else F.lit(None).cast("long").alias(c) for c in ("z", "component")]
    return rows.select("set_id", F.lit(title).alias("title"), "grain", *place, F.col(value).cast("double").alias("value"))


def grain_properties_long(slices: DataFrame, grains: DataFrame) -> DataFrame:
    """The properties of all titles, one below the other: each table is read once."""
    sides = [(slices, SLICE_TITLES, ["z", "component"]), (grains, GRAIN_TITLES, [])]
    out = []
    for rows, titles, keys in sides:
        missing = [F.lit(None).cast("long").alias(c) for c in ("z", "component") if c not in keys]
        wide = rows.select("set_id", "grain", *keys, *missing, *(F.col(c).cast("double").alias(t) for t, c in titles.items()))
        out.append(wide.unpivot(["set_id", "grain", "z", "component"], list(titles), "title", "value"))
    return out[0].unionByName(out[1]).select("set_id", "title", "grain", "z", "component", "value")


def component_values(nodes: DataFrame, components: list[str]) -> DataFrame:
    """Long form (keys, component, value) of the components picked by name."""
    return nodes.unpivot([*STEP, "id"], components, "component", "value")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row of the highest order number."""
    values = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(values, order).alias("v")).select(*keys, "v.*")


def loadstep_stats(nodes: DataFrame, components: list[str]) -> DataFrame:
    """Average, least and largest value of each component for each load step."""
    return nodes.groupBy(*STEP).agg(*(f(c).alias(f"{name}_{c}") for c in components for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))


def symmetric_tensor(xx: str, yy: str, zz: str, xy: str, yz: str, xz: str) -> Column:
    return F.array(F.array(xx, xy, xz), F.array(xy, yy, yz), F.array(xz, yz, zz))


def loadstep_tensors(nodes: DataFrame, loads: DataFrame) -> DataFrame:
    """Averaged stress and strain and the applied load of each step as symmetric tensors."""
    parts = ["sx", "sy", "sz", "sxy", "syz", "sxz", "eps_x", "eps_y", "eps_z", "eps_xy", "eps_yz", "eps_xz"]
    avg = nodes.groupBy(*STEP).agg(*(F.avg(c).alias(c) for c in parts)).join(loads, STEP)
    return avg.select(*STEP, symmetric_tensor(*parts[:6]).alias("stress"), symmetric_tensor(*parts[6:]).alias("strain"), symmetric_tensor("exx", "eyy", "ezz", "exy", "eyz", "exz").alias("load"))


def histogram(values: DataFrame, by: str, value: str, mode: str = "compat") -> DataFrame:
    """(by, bin, low, n) with empty bins. Bins: the whole part of half the rounded root of the count. In compat mode the
    largest value falls out of the last bin; in closed mode it is in it. All equal: all in bin 0. No bins, no rows."""
    finite = values.where(S.finite_nonzero(value)).select(by, F.col(value).alias("v"))
    shape = finite.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    shape = shape.withColumn("bins", F.floor(F.round(F.sqrt("total")) / 2).cast("long")).where("bins > 0").withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    shape = small_side(shape, "histogram-shapes")  # a row for each group, of which few may hold all values
    place = F.when(F.col("width") == 0, 0).otherwise(F.floor((F.col("v") - F.col("low")) / F.nullif("width", F.lit(0.0)))).cast("long")
    if mode == "closed":
        place = F.least(place, F.col("bins") - 1)
    counted = finite.join(shape, by).select(by, place.alias("bin"), "bins").where("bin < bins").groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = shape.select(by, "low", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return every.join(counted, [by, "bin"], "left").select(by, "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def histogram_axis(values: DataFrame, by: str, value: str) -> DataFrame:
    """Axis limits and ticks of each group's histogram; y_top as drawn, from the largest value, and from the bin counts."""
    finite = values.where(S.finite_nonzero(value)).select(by, F.col(value).alias("v"))
    shape = finite.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    shape = shape.withColumn("bins", F.floor(F.round(F.sqrt("total")) / 2).cast("long")).where("bins > 0").withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    top = lambda v: (F.floor((F.floor(v) + 9) / 10) * 10 + 10).cast("long")
    counts = histogram(values, by, value).groupBy(by).agg(F.max("n").alias("most"))
    return shape.join(counts, by).select(by, F.greatest(F.lit(0.0), F.col("low") - F.col("width")).alias("x_min"), (F.col("high") + F.col("width")).alias("x_max"), F.least(F.lit(10).cast("long"), "bins").alias("ticks"), top(F.col("high")).alias("y_top"), top(F.col("most")).alias("y_top_counts"))


def value_at(points: DataFrame, nodes: DataFrame, component: str, order: str = "id") -> DataFrame:
    """The points (set_id, load_step, x, y, z) with the component's value there; 0 where no node is, the last of several."""
    held = last_wins(nodes.select(*STEP, "x", "y", "z", component, order), [*STEP, "x", "y", "z"], order)
    return points.join(held.select(*STEP, "x", "y", "z", F.col(component).alias("found")), [*STEP, "x", "y", "z"], "left").select(*points.columns, F.coalesce("found", F.lit(0.0)).alias("value"))


def corner_values(voxels: DataFrame, nodes: DataFrame, component: str, load_step: int, limits: DataFrame | None = None) -> DataFrame:
    """(cell, corner, value, scaled, level) for the eight corners of each filled cell under one load step; the component's
    limits (set_id, load_step, low, high) may be given."""
    corners = F.array(*(F.struct(F.lit(i + 1).alias("corner"), *(F.lit(v).alias(c) for v, c in zip(o, ("dx", "dy", "dz"), strict=True))) for i, o in enumerate(CORNERS)))
    cells = voxels.where("grain > 0").withColumn("o", F.explode(corners))
    points = cells.select(
        "set_id",
        F.lit(load_step).alias("load_step"),
        *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "xyz"),
        *(F.col(c).alias(f"cell_{c}") for c in "xyz"),
        F.col("o.corner").alias("corner"),
    )
    step = nodes.where(F.col("load_step") == load_step)
    limits = limits_of(step, component) if limits is None else limits.where(F.col("load_step") == load_step)
    # one set may hold all rows: its limits are broadcast where sets are few
    valued = value_at(points, step, component).join(small_side(limits.drop("load_step"), "limits"), "set_id")
    scaled = S.minmax_scale("value", "low", "high")
    return valued.select("set_id", "cell_x", "cell_y", "cell_z", "corner", "value", scaled.alias("scaled")).withColumn("level", S.color_level("scaled"))


def cell_occupancy(points: DataFrame, inside: Column, clamp: bool = False) -> DataFrame:
    """(i, j, k, probability) of the 27 unit cells of [0, 3): share of each cell's points inside. Points at 3 or beyond are left out, or clamped into the last cell."""
    at = {c: F.floor(F.col(a)).cast("int") for c, a in zip("ijk", "xyz", strict=True)}
    if clamp:
        at = {c: F.greatest(F.lit(0), F.least(F.lit(2), v)) for c, v in at.items()}
    shares = points.select(*(v.alias(c) for c, v in at.items()), inside.cast("double").alias("hit")).where("i between 0 and 2 and j between 0 and 2 and k between 0 and 2").groupBy("i", "j", "k").agg(F.avg("hit").alias("p"))
    cells = points.sparkSession.range(27).select((F.col("id") / 9).cast("int").alias("i"), (F.col("id") / 3 % 3).cast("int").alias("j"), (F.col("id") % 3).cast("int").alias("k"))
    return cells.join(shares, ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce("p", F.lit(0.0)).alias("probability"))


def every_load(nodes: DataFrame, loads: DataFrame, most: int = 10_000, salts: int = 64) -> DataFrame:
    """Every node of a set with every load case of the set. Up to `most` load cases are broadcast; beyond that they are
    copied to `salts` parts of the nodes, as one set may hold all rows."""
    if loads.count() <= most:
        return nodes.join(F.broadcast(loads), "set_id")
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return nodes.withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), F.lit(salts)).cast("int")).join(loads.withColumn("part", parts), ["set_id", "part"]).drop("part")


def strain_bc(nodes: DataFrame, loads: DataFrame, n: float) -> DataFrame:
    """(set_id, load_step, node, dof, value): displacements of the face nodes under every load case."""
    both = every_load(nodes.where(S.is_face_node("x", "y", "z", n)), loads)
    u = S.displacement("x", "y", "z", "exx", "eyy", "ezz", "exy", "eyz", "exz")
    wide = both.select("set_id", "load_step", F.col("id").alias("node"), *(c.alias(d) for c, d in zip(u, ("UX", "UY", "UZ"), strict=True)))
    return wide.unpivot(["set_id", "load_step", "node"], ["UX", "UY", "UZ"], "dof", "value")


def _face_table(nodes: DataFrame, faces: list[tuple[str, float, str, float]]) -> DataFrame:
    """Rows (node, dof, value) of the nodes that lie on each (axis, position, dof, value)."""
    held = F.array(*(F.struct(F.lit(axis).alias("axis"), F.lit(float(at)).alias("at"), F.lit(dof).alias("dof"), F.lit(float(v)).alias("value")) for axis, at, dof, v in faces))
    place = F.when(F.col("f.axis") == "x", F.col("x")).when(F.col("f.axis") == "y", F.col("y")).otherwise(F.col("z"))
    return nodes.withColumn("f", F.explode(held)).where(place == F.col("f.at")).select("set_id", F.col("id").alias("node"), "f.dof", "f.value").distinct()


def tension_bc(nodes: DataFrame, n: float, eps: tuple[float, float, float]) -> DataFrame:
    """Zero at each axis' low face, coordinate times strain at its high face; exact positions."""
    return _face_table(nodes, [f for axis, e in zip("xyz", eps, strict=True) for f in ((axis, 0, f"U{axis.upper()}", 0), (axis, n, f"U{axis.upper()}", n * e))])


def shear_bc(nodes: DataFrame, n: float, plane: str, shear: float) -> DataFrame:
    """Faces of pure shear in the plane XY, XZ or YZ; any other plane is an error."""
    if plane not in ("XY", "XZ", "YZ"):
        raise ValueError(f"shear plane {plane!r} is not XY, XZ or YZ")
    drive, slide = plane.lower()
    free = next(a for a in "xyz" if a not in (drive, slide))
    u = lambda a: f"U{a.upper()}"
    rows = [(slide, 0, u(drive), 0), (slide, 0, u(free), 0), (slide, n, u(drive), n * shear), (slide, n, u(free), 0)]
    rows += [(drive, at, dof, 0) for at in (0, n) for dof in (u(slide), u(free))]
    return _face_table(nodes, rows)


def face_node_union(nodes: DataFrame, n: float) -> DataFrame:
    """Nodes on any of the six faces, each once; one pass takes the place of six selections."""
    on_face = F.lit(False)
    for c in "xyz":
        on_face = on_face | F.col(c).isin(0, n)
    return nodes.where(on_face).distinct()
