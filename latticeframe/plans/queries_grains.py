"""Queries over the labelled lattice."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeframe.functions import scalar as S
from latticeframe.operators import generate, lattice, mesh, results
from latticeframe.plans import fixtures as X
from latticeframe.plans.lineage import materialise
from latticeframe.plans.registry import query


def r6(df, *columns):
    """Doubles with six places, as the SQL rounds them."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


VOLUME = "vol as (select set_id, grain, count(*) volume from vox where grain > 0 group by 1, 2)"
SURFACE = """
faces as (select a.set_id, a.x, a.y, a.z, a.grain, d.nx, d.ny, d.nz from vox a
  cross join (values (-1,0,0),(0,1,0),(1,0,0),(0,-1,0),(0,0,1),(0,0,-1)) d(nx,ny,nz)
  left join vox b on b.x = a.x + d.nx and b.y = a.y + d.ny and b.z = a.z + d.nz
  where a.grain > 0 and (b.grain is null or b.grain <> a.grain)),
surf as (select set_id, grain, count(*) surface_area from faces group by 1, 2)"""


@query(f", {VOLUME}, {SURFACE} select v.set_id, v.grain, volume, round(volume / max(volume) over (partition by v.set_id), 6) norm_volume, surface_area, round(pow(3 * volume / (4 * pi()), 1.0 / 3), 6) esr, round(0.4 * pow(3 * volume / (4 * pi()), 2.0 / 3), 6) inertia from vol v join surf using (set_id, grain)")
def grain_properties(spark, sf):
    return r6(lattice.grain_properties(X.voxels(spark, sf)), "norm_volume", "esr", "inertia").select("set_id", "grain", "volume", "norm_volume", "surface_area", "esr", "inertia")


@query(f", {VOLUME} select * from vol")
def grain_volume(spark, sf):
    return lattice.grain_volume(X.voxels(spark, sf))


@query(f", {VOLUME} select set_id, grain, volume, round(volume / max(volume) over (partition by set_id), 6) norm_volume from vol")
def grain_norm_volume(spark, sf):
    return r6(lattice.grain_norm_volume(X.voxels(spark, sf)), "norm_volume")


@query(f", {SURFACE} select * from surf")
def grain_surface(spark, sf):
    return lattice.grain_surface(X.voxels(spark, sf))


@query(f", {VOLUME} select set_id, grain, round(pow(3 * volume / (4 * pi()), 1.0 / 3), 6) esr from vol")
def grain_esr(spark, sf):
    return lattice.grain_volume(X.voxels(spark, sf)).select("set_id", "grain", F.round(lattice.esr(F.col("volume")), 6).alias("esr"))


@query(f", {VOLUME} select set_id, grain, round(0.4 * pow(3 * volume / (4 * pi()), 2.0 / 3), 6) inertia from vol")
def grain_inertia(spark, sf):
    radius = lattice.esr(F.col("volume"))
    return lattice.grain_volume(X.voxels(spark, sf)).select("set_id", "grain", F.round(0.4 * radius * radius, 6).alias("inertia"))


@query(", p as (select * from porous) select set_id, round(avg(case when grain > 0 then 1.0 else 0.0 end), 6) fill_fraction, bool_and(grain > 0) complete from p group by set_id")
def fill_fraction(spark, sf):
    return r6(lattice.fill_fraction(X.voxels_porous(spark, sf)), "fill_fraction")


# components of slices; the first pixel in scan order names one
CC = """with recursive {fix},
pv as materialized (select z, grain, x, y from porous where grain > 0),
cc(z, grain, x, y, lbl) using key (z, x, y) as (
  select z, grain, x, y, y * (select greatest(1000, n) from dim) + x from pv
  union
  select c.z, c.grain, c.x, c.y, min(n.lbl) from cc n join recurring.cc c
    on n.z = c.z and n.grain = c.grain and abs(n.x - c.x) + abs(n.y - c.y) = 1
  group by c.z, c.grain, c.x, c.y, c.lbl having min(n.lbl) < c.lbl),
edge as (select a.z, a.x, a.y, cast(count(b.grain) < 4 as bigint) edge from pv a left join pv b
  on a.z = b.z and a.grain = b.grain and abs(a.x - b.x) + abs(a.y - b.y) = 1 group by 1, 2, 3),
sg as (select 1::bigint set_id, c.z, c.grain, c.lbl component, count(*) area, cast(sum(edge) as bigint) perimeter
  from cc c join edge e on c.z = e.z and c.x = e.x and c.y = e.y group by 1, 2, 3, 4),
size2 as (select n * n n2 from dim),
full_sg as (select set_id, z, grain, component, area, perimeter, round(area / n2, 6) norm_area, round(sqrt(area / n2 / 3.14159), 6) ecr,
  round(4 * 3.14159::double * area / (perimeter * perimeter) + 1e-9, 6) shape_factor,
  round(case when xor(perimeter, 2) = 0 then null else 4 * 3.14159::double * area / xor(perimeter, 2) end + 1e-9, 6) shape_factor_compat
  from sg cross join size2) """.replace("{fix}", X.SQL)


def _slices(spark, sf):
    found = lattice.slice_grains(X.voxels_porous(spark, sf), X.size(spark, sf))
    # the factors are short decimal fractions that may end in a 5 at the seventh place
    found = found.withColumns({c: F.col(c) + 1e-9 for c in ("shape_factor", "shape_factor_compat")})
    return r6(found, "norm_area", "ecr", "shape_factor", "shape_factor_compat")


@query(CC + "select 1::bigint set_id, z, grain, x, y, lbl from cc")
def slice_components(spark, sf):
    return lattice.slice_components(X.voxels_porous(spark, sf), X.size(spark, sf))


@query(CC + "select set_id, z, grain, component, area from full_sg")
def slice_area(spark, sf):
    return lattice.slice_components(X.voxels_porous(spark, sf), X.size(spark, sf)).groupBy("set_id", "z", "grain", F.col("lbl").alias("component")).agg(F.count(F.lit(1)).alias("area"))


@query(CC + "select set_id, z, grain, component, perimeter from full_sg")
def slice_perimeter(spark, sf):
    return _slices(spark, sf).select("set_id", "z", "grain", "component", "perimeter")


@query(CC + "select set_id, z, grain, component, norm_area from full_sg")
def slice_norm_area(spark, sf):
    return _slices(spark, sf).select("set_id", "z", "grain", "component", "norm_area")


@query(CC + "select set_id, z, grain, component, ecr from full_sg")
def slice_ecr(spark, sf):
    return _slices(spark, sf).select("set_id", "z", "grain", "component", "ecr")


@query(CC + "select set_id, z, grain, component, shape_factor, shape_factor_compat from full_sg")
def slice_shape_factor(spark, sf):
    return _slices(spark, sf).select("set_id", "z", "grain", "component", "shape_factor", "shape_factor_compat")


@query(CC + "select * from full_sg qualify component = max(component) over (partition by set_id, z, grain)")
def slice_last_component(spark, sf):
    return lattice.slice_last_component(_slices(spark, sf))


CORNER_SQL = """, c8 as (select * from (values (1,0,0,0),(2,1,0,0),(3,1,1,0),(4,0,1,0),(5,0,0,1),(6,1,0,1),(7,1,1,1),(8,0,1,1)) t(l,dx,dy,dz)),"""


# the four corners of each face in drawing order, as the offsets of the cell's corners
FACE_CORNERS = """, fc as (select * from (values (-1,0,0,'000 001 011 010'), (0,1,0,'010 011 111 110'), (1,0,0,'110 111 101 100'),
(0,-1,0,'100 101 001 000'), (0,0,1,'101 111 011 001'), (0,0,-1,'110 100 000 010')) t(nx,ny,nz,o)),
fo as (select nx, ny, nz, list_transform(string_split(o, ' '), lambda d: [substr(d, 1, 1)::bigint, substr(d, 2, 1)::bigint, substr(d, 3, 1)::bigint]) o from fc)"""


@query(f", {SURFACE}{FACE_CORNERS} select set_id, x, y, z, grain, nx, ny, nz, array_to_string(list_transform(o, lambda d: concat(x + d[1], ' ', y + d[2], ' ', z + d[3])), ',') corners from faces join fo using (nx, ny, nz)")
def exposed_faces(spark, sf):
    at = F.transform("corners", lambda p: F.array_join(p.cast("array<string>"), " "))
    return lattice.exposed_faces(X.voxels(spark, sf)).withColumn("corners", F.array_join(at, ","))


@query(f", {SURFACE} select distinct set_id, x, y, z, grain from faces")
def surface_voxels(spark, sf):
    return lattice.surface_voxels(X.voxels(spark, sf))


# all filled cells of the porous lattice are points; touching cells are met by offset
@query(""", ce as materialized (select x // 3 cx, y // 3 cy, z // 3 cz, k id from vox where ck % 10 <> 0),
near as (select a.dx, b.dy, c.dz from (values (-1), (0), (1)) a(dx) cross join (values (-1), (0), (1)) b(dy) cross join (values (-1), (0), (1)) c(dz)),
sp as (select cx + dx cx, cy + dy cy, cz + dz cz, id from ce cross join near)
select a.id id_a, b.id id_b from ce a join sp b on a.cx = b.cx and a.cy = b.cy and a.cz = b.cz and a.id < b.id""")
def near_cell_join_filled(spark, sf):
    return lattice.near_cell_pairs(X.voxels_porous(spark, sf, "k").where("grain > 0").select(F.col("k").alias("id"), "x", "y", "z"), 3)


# and every cell of the full lattice
@query(""", ce as materialized (select x // 2 cx, y // 2 cy, z // 2 cz, k id from vox),
near as (select a.dx, b.dy, c.dz from (values (-1), (0), (1)) a(dx) cross join (values (-1), (0), (1)) b(dy) cross join (values (-1), (0), (1)) c(dz)),
sp as (select cx + dx cx, cy + dy cy, cz + dz cz, id from ce cross join near)
select a.id id_a, b.id id_b from ce a join sp b on a.cx = b.cx and a.cy = b.cy and a.cz = b.cz and a.id < b.id""")
def near_cell_join(spark, sf):
    return lattice.near_cell_pairs(X.cells(spark, sf).select(F.col("k").alias("id"), "x", "y", "z"), 2)


@query(", cl as (select x, y, z, 1 + ck % 50 as cluster from porous_ck) select distinct a.cluster id_a, b.cluster id_b from cl a join cl b on abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 and a.cluster < b.cluster".replace(", cl as", ", porous_ck as (select * from vox where ck % 10 <> 0), cl as"))
def cluster_contacts(spark, sf):
    cells = X.voxels_porous(spark, sf, "ck").where("grain > 0").select("x", "y", "z", (1 + F.col("ck") % 50).alias("cluster"))
    return lattice.cluster_contacts(cells, X.size(spark, sf))


# clusters by customer: scattered cells of one id, merged with all that they touch
@query(f"""with recursive {X.SQL}, cl as materialized (select x, y, z, ck + 1 as cluster from vox where ck % 10 <> 0),
six as materialized (select * from (values (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1)) t(dx,dy,dz)),
met as materialized (select distinct a.cluster u, b.cluster v from cl a cross join six s join cl b on b.x = a.x + s.dx and b.y = a.y + s.dy and b.z = a.z + s.dz),
cc(cluster, merged) using key (cluster) as (
  select distinct cluster, cluster from cl
  union
  select c.cluster, min(n.merged) from cc n join met on met.u = n.cluster join recurring.cc c on c.cluster = met.v
  group by c.cluster, c.merged having min(n.merged) < c.merged)
select x, y, z, cluster, merged from cl join cc using (cluster)""")
def cluster_merge(spark, sf):
    cells = X.voxels_porous(spark, sf, "ck").where("grain > 0").select("x", "y", "z", (F.col("ck") + 1).alias("cluster"))
    return lattice.cluster_merge(cells, X.size(spark, sf))


@query(f"""with recursive {X.SQL}, cl as materialized (select x, y, z, k + 1 as cluster from vox where ck % 10 <> 0),
six as materialized (select * from (values (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1)) t(dx,dy,dz)),
cc(x, y, z, cluster, merged) using key (x, y, z) as (
  select x, y, z, cluster, cluster from cl
  union
  select c.x, c.y, c.z, c.cluster, min(n.merged) from cc n cross join six s join recurring.cc c
    on c.x = n.x + s.dx and c.y = n.y + s.dy and c.z = n.z + s.dz
  group by c.x, c.y, c.z, c.cluster, c.merged having min(n.merged) < c.merged)
select x, y, z, cluster, merged from cc""")
def cluster_merge_filled(spark, sf):
    cells = X.voxels_porous(spark, sf, "k").where("grain > 0").select("x", "y", "z", (F.col("k") + 1).alias("cluster"))
    return lattice.cluster_merge(cells, X.size(spark, sf))


# a cell fills in the round that is its distance to the nearest filled cell, from neighbours of the round before
@query(f"""with recursive {X.SQL}, pm as materialized (select x, y, z, grain from porous),
rd as materialized (select a.x, a.y, a.z, min(greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z))) r from pm a cross join pm b where a.grain = 0 and b.grain > 0 group by 1, 2, 3),
f(r, x, y, z, grain) as (select 0::bigint, x, y, z, grain from pm where grain > 0 union all
  select f.r + 1, rd.x, rd.y, rd.z, min(((f.x - rd.x) * 9 + (f.y - rd.y) * 3 + f.z - rd.z + 13) * 1000000 + f.grain) % 1000000 from f join rd
  on rd.r = f.r + 1 and abs(f.x - rd.x) <= 1 and abs(f.y - rd.y) <= 1 and abs(f.z - rd.z) <= 1 group by f.r, rd.x, rd.y, rd.z)
select 1::bigint set_id, x, y, z, grain from f""")
def void_fill(spark, sf):
    return lattice.void_fill(X.voxels_porous(spark, sf), X.size(spark, sf))


@query(", v as (select * from vox) select v.set_id, x, y, z, v.grain, v.grain + 11 coord_sys_id, e.w from v left join (select vec_id + 1 grain, round(embedding[1]::double, 6) w from embeddings) e on e.grain = v.grain")
def voxel_orientation(spark, sf):
    own = X.table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("grain"), F.round(F.col("embedding")[0].cast("double"), 6).alias("w"))
    return lattice.with_orientation(X.voxels(spark, sf), own).select("set_id", "x", "y", "z", "grain", "coord_sys_id", "w")


LABEL = """, per as (select x, y, z, {d} d, grain from lat cross join seeds) select x, y, z, min(d * 1000000 + grain) % 1000000 grain, min(d * 1000000 + grain) // 1000000 d from per group by x, y, z"""
GAPS = [f"abs({c} - s{c})" for c in "xyz"]
LINF, L1 = f"greatest({', '.join(GAPS)})", f"({' + '.join(GAPS)})"
WRAPPED = f"greatest({', '.join(f'least(abs({c} - s{c}), n - abs({c} - s{c}))' for c in 'xyz')})"


def _nearest(spark, sf, seeds=None, **how):
    cells = X.cells(spark, sf).select("x", "y", "z")
    return lattice.nearest_seed_label(cells, X.seeds(spark, sf) if seeds is None else seeds, X.size(spark, sf), **how)


@query(LABEL.replace("{d}", LINF))
def nearest_seed_label(spark, sf):
    return _nearest(spark, sf)


@query(LABEL.replace("{d}", L1))
def nearest_seed_label_6(spark, sf):
    return _nearest(spark, sf, kind=6)


@query(LABEL.replace("{d}", f"greatest({LINF}, ({L1} + 1) // 2)"))
def nearest_seed_label_18(spark, sf):
    return _nearest(spark, sf, kind=18)


@query(LABEL.replace("{d}", WRAPPED))
def nearest_seed_label_periodic(spark, sf):
    return _nearest(spark, sf, periodic=True)


# seeds that start growing at different times
@query(LABEL.replace("{d}", f"{LINF} + grain % 5"))
def nearest_seed_label_t0(spark, sf):
    return _nearest(spark, sf, X.seeds(spark, sf).withColumn("t0", F.col("grain") % 5))


# all seeds in one corner
@query(LABEL.replace("{d}", LINF.replace("sx", "sx % 6").replace("sy", "sy % 6").replace("sz", "sz % 6")))
def nearest_seed_label_clustered(spark, sf):
    return _nearest(spark, sf, X.seeds(spark, sf).withColumns({f"s{c}": F.col(f"s{c}") % 6 for c in "xyz"}))


@query(f""", best as (select x, y, z, min({LINF}) d, max(n) n from lat cross join seeds group by x, y, z),
steps as (select 1::bigint set_id, d, count(*) frontier, max(n) n from best group by d)
select set_id, d, frontier, cast(sum(frontier) over (order by d) as bigint) filled, round(sum(frontier) over (order by d) / (n * n * n), 6) fraction from steps""")
def growth_curve(spark, sf):
    return r6(lattice.growth_curve(X.labelled(spark, sf), X.size(spark, sf)), "fraction")


@query(", v as (select * from vox) select x, y, z, grain, row_number() over (order by x, y, z) as position from v")
def lattice_order(spark, sf):
    return mesh.numbered(X.voxels(spark, sf), "x", ["y", "z"], "p").orderBy("x", "y", "z").select("x", "y", "z", "grain", (F.col("p") + 1).alias("position"))


@query("with dim as (select cast(ceil(cbrt(count(*)) - 1e-9) as bigint) n from orders), g as (select unnest(range(n*n*n)) i, n from dim) select i // (n*n) x, (i // n) % n y, i % n z, 0::bigint grain from g", name="lattice")
def lattice_cells(spark, sf):
    return lattice.lattice(spark, X.size(spark, sf))


@query(", o as (select unnest(range(27)) i), st as (select i // 9 - 1 dx, i // 3 % 3 - 1 dy, i % 3 - 1 dz from o) select k.x, k.y, k.z, k.x + dx nx, k.y + dy ny, k.z + dz nz from lat k cross join st where (dx <> 0 or dy <> 0 or dz <> 0) and abs(dx) + abs(dy) + abs(dz) <= 2 and k.x + dx between 0 and n - 1 and k.y + dy between 0 and n - 1 and k.z + dz between 0 and n - 1")
def neighbour_expand(spark, sf):
    cells = X.cells(spark, sf).select("x", "y", "z")
    return lattice.neighbours(cells, 18, X.size(spark, sf)).drop("offset_no")


@query(", o as (select unnest(range(27)) i), st as (select i // 9 - 1 dx, i // 3 % 3 - 1 dy, i % 3 - 1 dz from o) select k.x, k.y, k.z, (k.x + dx + n) % n nx, (k.y + dy + n) % n ny, (k.z + dz + n) % n nz from lat k cross join st where abs(dx) + abs(dy) + abs(dz) = 1")
def neighbour_expand_periodic(spark, sf):
    cells = X.cells(spark, sf).select("x", "y", "z")
    return lattice.neighbours(cells, 6, X.size(spark, sf), periodic=True).drop("offset_no")


OFFSETS = ", o as (select unnest(range(27)) i), st as (select i // 9 - 1 dx, i // 3 % 3 - 1 dy, i % 3 - 1 dz from o)"


@query(OFFSETS + " select k.x, k.y, k.z, (k.x + dx + n) % n nx, (k.y + dy + n) % n ny, (k.z + dz + n) % n nz from lat k cross join st where dx <> 0 or dy <> 0 or dz <> 0")
def neighbour_expand_periodic_26(spark, sf):
    cells = X.cells(spark, sf).select("x", "y", "z")
    return lattice.neighbours(cells, 26, X.size(spark, sf), periodic=True).drop("offset_no")


@query(", cl as (select x, y, z, n, 1 + ck % 50 as cluster from vox where ck % 10 <> 0)" + OFFSETS + " select distinct a.cluster id_a, b.cluster id_b from cl a cross join st join cl b on b.x = (a.x + dx + a.n) % a.n and b.y = (a.y + dy + a.n) % a.n and b.z = (a.z + dz + a.n) % a.n where abs(dx) + abs(dy) + abs(dz) = 1 and a.cluster < b.cluster")
def cluster_contacts_periodic(spark, sf):
    cells = X.voxels_porous(spark, sf, "ck").where("grain > 0").select("x", "y", "z", (1 + F.col("ck") % 50).alias("cluster"))
    return lattice.cluster_contacts(cells, X.size(spark, sf), periodic=True)


MESH = CORNER_SQL + """ el as (select set_id, x, y, z, grain, row_number() over (order by x, y, z) - 1 e from porous where grain > 0),
sp as (select set_id, e, grain, l - 1 l, (x + dx)::double x, (y + dy)::double y, (z + dz)::double z from el cross join c8),
fs as (select set_id, x, y, z, min(8 * e + l) f from sp group by 1, 2, 3, 4),
nd as (select set_id, row_number() over (order by f) id, x, y, z from fs)"""
# the twenty nodes of a cell: eight corners, the edges of the bottom and of the top, then the upright ones
LOCAL20 = """(0,0,0,0),(1,1,0,0),(2,1,1,0),(3,0,1,0),(4,0,0,1),(5,1,0,1),(6,1,1,1),(7,0,1,1),
(8,0.5,0,0),(9,1,0.5,0),(10,0.5,1,0),(11,0,0.5,0),(12,0.5,0,1),(13,1,0.5,1),(14,0.5,1,1),(15,0,0.5,1),
(16,0,0,0.5),(17,1,0,0.5),(18,1,1,0.5),(19,0,1,0.5)"""
MESH20 = f""", c20 as (select l::bigint l, dx::double dx, dy::double dy, dz::double dz from (values {LOCAL20}) t(l,dx,dy,dz)),
el as (select set_id, x, y, z, grain, row_number() over (order by x, y, z) - 1 e from porous where grain > 0),
sp as (select set_id, e, grain, l, x + dx x, y + dy y, z + dz z from el cross join c20),
nd as (select set_id, min(20 * e + l) + 1 id, x, y, z from sp group by set_id, x, y, z)"""
ELEMENTS = " select sp.set_id, e + 1 element, grain + 11 coord_sys_id, string_agg(nd.id::varchar, ',' order by l) nodes from sp join nd on sp.x = nd.x and sp.y = nd.y and sp.z = nd.z group by sp.set_id, e, grain"


def _joined(elements):
    return elements.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query(MESH + " select * from nd")
def mesh_nodes8(spark, sf):
    return mesh.mesh8(X.voxels_porous(spark, sf))[0]


@query(MESH + ELEMENTS)
def mesh_elements8(spark, sf):
    return _joined(mesh.mesh8(X.voxels_porous(spark, sf))[1])


@query(MESH20 + " select * from nd")
def mesh_nodes20(spark, sf):
    return mesh.mesh20(X.voxels_porous(spark, sf))[0]


@query(MESH20 + ELEMENTS)
def mesh_elements20(spark, sf):
    return _joined(mesh.mesh20(X.voxels_porous(spark, sf))[1])


# generators; the keys come from the tables


def mix_sql(v: str) -> str:
    """SQL of scalar.mix32 over an expression."""
    for _ in range(2):
        v = f"((xor({v}, ({v}) >> 16)) * 73244475 % 4294967296)"
    return f"xor({v}, ({v}) >> 16)"


def uniform_sql(seed: int, i: str, c: int) -> str:
    return f"(({mix_sql(f'(({i} * 6 + {c + 1 + seed * 1000003}) % 4294967296)')}) + 0.5) / 4294967296.0::double"


KEYS = "keys as (select cast(s_suppkey as bigint) i from supplier)"


def _keys(spark, sf):
    return X.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("i"))


@query(f", {KEYS}, u as (select i + 1 grain, {uniform_sql(7, 'i', 0)} a, {uniform_sql(7, 'i', 1)} b, {uniform_sql(7, 'i', 2)} c from keys) select max(grain) grain, x, y, z from (select grain, cast(floor(a * n) as bigint) x, cast(floor(b * n) as bigint) y, cast(floor(c * n) as bigint) z from u cross join dim) group by x, y, z")
def seed_sample(spark, sf):
    return generate.seed_sample(_keys(spark, sf), X.size(spark, sf), 7)


# a twentieth of the cells
@query(f", h as (select k i, x, y, z, {mix_sql('((k + 3000009) % 4294967296)')} h from lat), f as (select *, row_number() over (order by h, i) grain from h) select grain, x, y, z from f where grain <= (select count(*) // 20 from lat)")
def seed_sample_distinct(spark, sf):
    cells = X.cells(spark, sf).withColumnRenamed("k", "i")
    return generate.seed_sample_distinct(cells, cells.count() // 20, 3)


@query(f", {KEYS}, g as (select unnest(range(64)) id), grid as (select id + 1 load_step, (id // 32 % 2) * 1e-4 exx, (id // 16 % 2) * 1e-4 eyy, (id // 8 % 2) * 1e-4 ezz, (id // 4 % 2) * 1e-4 exy, (id // 2 % 2) * 1e-4 exz, (id % 2) * 1e-4 eyz from g), r as (select i + 65 load_step, " + ", ".join(f"{uniform_sql(1, 'i', p)} * 1e-4 {c}" for p, c in enumerate(["exx", "eyy", "ezz", "exy", "exz", "eyz"])) + " from keys) select load_step, " + ", ".join(f"round({c}::double * 1e4, 6) {c}" for c in ["exx", "eyy", "ezz", "exy", "eyz", "exz"]) + " from (select * from grid union all select * from r)")
def load_case_grid(spark, sf):
    made = generate.load_case_grid(spark, 2, 0.0, 1e-4, _keys(spark, sf))
    return made.withColumns({c: F.round(F.col(c) * 1e4, 6) for c in made.columns[1:]})


def euler_sql(w: str, x: str, y: str, z: str, source: str, keep: str) -> str:
    """SQL of scalar.euler_from_quaternion over a table."""
    return f"""q0 as (select {keep}, {w} w, {x} x, {y} y, {z} z from {source}), q1 as (select *, sqrt(w*w+x*x+y*y+z*z) nn from q0),
q2 as (select {keep}, nn, w/case when nn < 1e-12 then 1 else nn end a, x/case when nn < 1e-12 then 1 else nn end b, y/case when nn < 1e-12 then 1 else nn end c, z/case when nn < 1e-12 then 1 else nn end d from q1),
q3 as (select *, acos(greatest(-1.0::double, least(1.0::double, 1-2*(b*b+c*c)))) ph from q2), q4 as (select *, ph < 1e-6 or abs(ph - pi()) < 1e-6 flat from q3)
select {keep}, round(case when nn < 1e-12 then 0 else degrees(case when flat then atan2(2*(b*c-a*d), 1-2*(c*c+d*d)) else atan2(2*(b*d-a*c), -(2*(c*d+a*b))) end) end, 6) phi1,
round(case when nn < 1e-12 then 0 else degrees(ph) end, 6) phi, round(case when nn < 1e-12 or flat then 0 else degrees(atan2(2*(b*d+a*c), 2*(c*d-a*b))) end, 6) phi2 from q4"""


def normal_sql(seed: int, c: int) -> str:
    return f"sqrt(-2 * ln({uniform_sql(seed, 'i', c)})) * cos(2 * pi() * ({uniform_sql(seed, 'i', c + 1)}))"


@query(f", {KEYS}, " + euler_sql(normal_sql(5, 0), normal_sql(5, 2), normal_sql(5, 4), normal_sql(6, 0), "keys", "i").replace("select i, round(", "select i grain, round("))
def random_orientations(spark, sf):
    return r6(generate.random_orientations(_keys(spark, sf), 5), "phi1", "phi", "phi2")


@query("with " + euler_sql("embedding[1]::double", "embedding[2]::double", "embedding[3]::double", "embedding[4]::double", "embeddings", "vec_id"))
def quaternion_to_euler(spark, sf):
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    return r6(X.table(spark, sf, "embeddings").select("vec_id", S.euler_from_quaternion(*e).alias("e")).select("vec_id", "e.*"), "phi1", "phi", "phi2")


TURNED = """, pts as (select k, x * 3.0::double / (n - 1) x, y * 3.0::double / (n - 1) y, z * 3.0::double / (n - 1) z from lat),
r1 as (select k, x, y * cos(radians(30)) - z * sin(radians(30)) y, y * sin(radians(30)) + z * cos(radians(30)) z from pts),
r2 as (select k, x * cos(radians(20)) + z * sin(radians(20)) x, y, z * cos(radians(20)) - x * sin(radians(20)) z from r1),
r3 as (select k, x * cos(radians(10)) - y * sin(radians(10)) x, x * sin(radians(10)) + y * cos(radians(10)) y, z from r2)"""
INSIDE = "pow((r.x - 1.5) / 1.4, 2) + pow((r.y - 1.5) / 1.0, 2) + pow((r.z - 1.5) / 0.8, 2) <= 1"
AXES, ANGLES = (1.4, 1.0, 0.8), (30.0, 20.0, 10.0)


def _points(spark, sf):
    n = X.size(spark, sf)
    return X.cells(spark, sf).select("k", *((F.col(c) * 3.0 / (n - 1)).alias(c) for c in "xyz"))


@query(TURNED + " select k, round(x, 6) x, round(y, 6) y, round(z, 6) z from r3")
def rotate_xyz(spark, sf):
    return _points(spark, sf).select("k", *(F.round(c, 6).alias(a) for c, a in zip(S.rotate_xyz("x", "y", "z", *ANGLES), "xyz", strict=True)))


@query(TURNED + f" select k, {INSIDE} inside from r3 r")
def in_ellipsoid(spark, sf):
    return _points(spark, sf).select("k", S.in_ellipsoid("x", "y", "z", AXES, ANGLES).alias("inside"))


OCCUPANCY = """, hit as (select least(2, {f}(p.x))::int i, least(2, {f}(p.y))::int j, least(2, {f}(p.z))::int k, ({inside})::int hit from pts p join r3 r using (k) {where}),
cells as (select (u // 9)::int i, (u // 3 % 3)::int j, (u % 3)::int k from (select unnest(range(27)) u))
select c.i, c.j, c.k, round(coalesce(avg(hit.hit), 0), 6) probability from cells c left join hit on c.i = hit.i and c.j = hit.j and c.k = hit.k group by 1, 2, 3"""


@query(TURNED + OCCUPANCY.replace("{f}", "floor").replace("{inside}", INSIDE).replace("{where}", "where p.x < 3 and p.y < 3 and p.z < 3"))
def cell_occupancy(spark, sf):
    inside = S.in_ellipsoid("x", "y", "z", AXES, ANGLES)
    return r6(results.cell_occupancy(_points(spark, sf), inside), "probability")


@query(TURNED + OCCUPANCY.replace("{f}", "floor").replace("{inside}", INSIDE).replace("{where}", ""))
def cell_occupancy_clamped(spark, sf):
    inside = S.in_ellipsoid("x", "y", "z", AXES, ANGLES)
    return r6(results.cell_occupancy(_points(spark, sf), inside, clamp=True), "probability")


@query("with dim as (select cast(ceil(cbrt(count(*)) - 1e-9) as bigint) n from orders), g as (select unnest(range(n*n*n)) i, n, 3.0::double / (n - 1) s from dim) select round(i // (n*n) * s, 6) x, round(i // n % n * s, 6) y, round(i % n * s, 6) z from g")
def sample_grid(spark, sf):
    return r6(generate.sample_grid(spark, X.size(spark, sf)), "x", "y", "z")


@query("with keys as (select cast(o_orderkey as bigint) i from orders) select " + ", ".join(f"round({uniform_sql(9, 'i', c)} * 3, 6) {a}" for c, a in enumerate("xyz")) + " from keys")
def sample_random(spark, sf):
    return r6(generate.sample_random(X.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("i")), 9), "x", "y", "z")


FIBRE = "sqrt(pow(x - n // 2, 2) + pow(y - n // 2, 2))"


@query(f"select x, y, z, case when round({FIBRE}) <= 4 then 5 else 1 end region from lat")
def in_fibre(spark, sf):
    return X.cells(spark, sf).select("x", "y", "z", S.in_fibre("x", "y", X.size(spark, sf), 4).alias("region"))


@query(f"select x, y, z, case when round({FIBRE}) <= 4 or least(sqrt(x*x + y*y), sqrt(x*x + (y-n)*(y-n)), sqrt((x-n)*(x-n) + y*y), sqrt((x-n)*(x-n) + (y-n)*(y-n))) <= 4 then 5 else 1 end region from lat")
def in_fibre_corners(spark, sf):
    return X.cells(spark, sf).select("x", "y", "z", S.in_fibre_corners("x", "y", X.size(spark, sf), 4).alias("region"))


@query(""", pr as (select n, 2 pitch_r, 9 pitch, n // 9 + 1 cnt, cast(trunc((n - (n // 9 + 1) * 9) / 2.0) as bigint) s from dim),
ctr as (select s + i * pitch + 2 + case when j % 2 = 1 then pitch // 2 else 0 end cx, s + j * pitch + 2 cy from pr, (select unnest(range(100)) i), (select unnest(range(100)) j) where i < cnt and j < cnt)
select x, y, z, case when exists (select 1 from ctr where trunc(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) <= 2) then 5 else 1 end region from lat""")
def in_fibre_array(spark, sf):
    return lattice.in_fibre_array(X.cells(spark, sf).select("x", "y", "z"), X.size(spark, sf), 2)
