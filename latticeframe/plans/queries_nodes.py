"""Queries over nodal results, load cases, parameters and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeframe.functions import scalar as S
from latticeframe.operators import results
from latticeframe.operators.lattice import CORNERS
from latticeframe.plans import fixtures as X
from latticeframe.plans.queries_grains import r6
from latticeframe.plans.registry import query

VM = "sqrt(0.5 * ((sx-sy)*(sx-sy) + (sy-sz)*(sy-sz) + (sz-sx)*(sz-sx)) + 3 * (sxy*sxy + syz*syz + sxz*sxz))"
EVM = "sqrt(0.5 * ((eps_x-eps_y)*(eps_x-eps_y) + (eps_y-eps_z)*(eps_y-eps_z) + (eps_z-eps_x)*(eps_z-eps_x)) + 3 * (eps_xy*eps_xy + eps_yz*eps_yz + eps_xz*eps_xz))"
USUM = "sqrt(ux*ux + uy*uy + uz*uz)"
LIMITS = ", lim as (select set_id, load_step, min(sx) low, max(sx) high from nodes group by 1, 2)"


def _limits(nodes, component="sx"):
    return nodes.groupBy(*results.STEP).agg(F.min(component).alias("low"), F.max(component).alias("high"))


@query(f"""select * from (unpivot (select set_id, load_step, id, x::double x, y::double y, z::double z, ux, uy, uz, sx, sy, sz, sxy, syz, sxz,
eps_x, eps_y, eps_z, eps_xy, eps_yz, eps_xz, {USUM} usum, {VM} seqv, {EVM} epseqv from nodes)
on x, y, z, ux, uy, uz, sx, sy, sz, sxy, syz, sxz, eps_x, eps_y, eps_z, eps_xy, eps_yz, eps_xz, usum, seqv, epseqv into name component value value)""".replace("select * from", "select set_id, load_step, id, component, round(value + 1e-9, 6) as value from", 1))
def component_select(spark, sf):
    nodes = results.with_derived(X.node_results(spark, sf)).withColumns({c: F.col(c).cast("double") for c in "xyz"})
    # some values are short decimal fractions that end in a 5 at the seventh place
    return r6(results.component_values(nodes, S.COMPONENTS[1:]).withColumn("value", F.col("value") + 1e-9), "value")


@query(f"select load_step, id, round({VM}, 6) seqv from nodes")
def von_mises_stress(spark, sf):
    return X.node_results(spark, sf).select("load_step", "id", F.round(S.seqv(), 6).alias("seqv"))


@query(f"select load_step, id, round({EVM} * 1000, 6) epseqv from nodes")
def von_mises_strain(spark, sf):
    return X.node_results(spark, sf).select("load_step", "id", F.round(S.epseqv() * 1000, 6).alias("epseqv"))


@query(f"select load_step, id, round({USUM}, 6) usum from nodes")
def displacement_sum(spark, sf):
    return X.node_results(spark, sf).select("load_step", "id", F.round(S.usum(), 6).alias("usum"))


@query(LIMITS + " select load_step, id, round(case when high = low then 1.0 else (sx - low) / nullif(high - low, 0) end, 6) scaled from nodes join lim using (set_id, load_step)")
def minmax_scale(spark, sf):
    return results.scaled(X.node_results(spark, sf), "sx").select("load_step", "id", F.round("scaled", 6).alias("scaled"))


@query(LIMITS + " select load_step, id, floor(case when high = low then 1.0 else (sx - low) / nullif(high - low, 0) end * 8)::int as level from nodes join lim using (set_id, load_step)")
def color_level(spark, sf):
    return results.scaled(X.node_results(spark, sf), "sx").select("load_step", "id", S.color_level("scaled").alias("level"))


RAMP_SQL = "(0,0,0,255),(1,0,178,255),(2,0,255,255),(3,0,255,178),(4,0,255,0),(5,178,255,0),(6,255,255,0),(7,255,178,0),(8,255,0,0)"


@query(f""", r as (select * from (values {RAMP_SQL}) t(i, r, g, b)), used as (select distinct l_quantity::int as level from lineitem),
t as (select level, level / 50.0::double * 8 t from used), p as (select level, t - floor(t) f, least(floor(t), 7) lo, least(floor(t) + 1, 8) hi, floor(t) fl from t),
p2 as (select level, case when fl = 8 then 1.0::double else f end f, lo from p)
select level, floor(a.r + f * (b.r - a.r))::int red, floor(a.g + f * (b.g - a.g))::int green, floor(a.b + f * (b.b - a.b))::int blue, 255 alpha from p2 join r a on a.i = lo join r b on b.i = lo + 1""")
def color_ramp(spark, sf):
    used = X.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("level")).distinct()
    return used.select("level", S.ramp_color("level", 50).alias("c")).select("level", "c.*")


@query(""", g as (select grain, (grain - 1) * 360.0::double / count(*) over () / 60 h from seeds), c as (select grain, h, 1 - abs(h % 2 - 1) x from g)
select grain, floor(255 * case when h < 1 then 1 when h < 2 then x when h < 4 then 0 when h < 5 then x else 1 end)::int red,
floor(255 * case when h < 1 then x when h < 3 then 1 when h < 4 then x else 0 end)::int green,
floor(255 * case when h < 2 then 0 when h < 3 then x when h < 5 then 1 else x end)::int blue, 216 alpha from c""")
def grain_palette(spark, sf):
    seeds = X.seeds(spark, sf)
    return seeds.select("grain", S.grain_color("grain", seeds.count()).alias("c")).select("grain", "c.*")


@query(LIMITS + ", w as (select load_step, case when low = high then low - 0.01 else low end lo, case when low = high then high + 0.01 else high end hi from lim), k as (select unnest(range(10)) k) select load_step, k::int as position, round(hi - k * (hi - lo) / 9, 6) as value from w cross join k")
def legend_levels(spark, sf):
    marks = _limits(X.node_results(spark, sf)).select("load_step", F.explode(S.legend_values("low", "high")).alias("m"))
    return marks.select("load_step", "m.position", F.round("m.value", 6).alias("value"))


ERROR_SQL = "case when {l} = 0 then 0.0 else round(({l} - {a}) / nullif({l}, 0) * 10000) / 100 end"


PAIRS = [("exx", "eps_x"), ("eyy", "eps_y"), ("ezz", "eps_z"), ("exy", "eps_xy"), ("eyz", "eps_yz"), ("exz", "eps_xz")]
AVERAGES = ", ".join(f"round(avg({c}){' / 2' if '_' in c[4:] or len(c) == 6 else ''}, 9) a{e}" for e, c in PAIRS)


@query(f", a as (select load_step, {AVERAGES} from nodes group by 1) select load_step, " + ", ".join(ERROR_SQL.format(l=e, a=f"a{e}") + f" err_{e[1:]}" for e, _ in PAIRS) + " from a join loads using (load_step)")
def strain_error_pct(spark, sf):
    # the averaged shears are halved first
    avg = X.node_results(spark, sf).groupBy("load_step").agg(*(F.round(F.avg(c) / (2 if len(c) == 6 else 1), 9).alias(f"a{e}") for e, c in PAIRS))
    return avg.join(X.load_cases(spark, sf), "load_step").select("load_step", *(S.strain_error_pct(e, f"a{e}").alias(f"err_{e[1:]}") for e, _ in PAIRS))


MOVED = ", ".join(f"round(({e}) * 1e4, 6) {u}" for u, e in (("ux", "exx*x + exy*y + exz*z"), ("uy", "exy*x + eyy*y + eyz*z"), ("uz", "exz*x + eyz*y + ezz*z")))


def _displaced(spark, sf, points):
    u = S.displacement("x", "y", "z", "exx", "eyy", "ezz", "exy", "eyz", "exz")
    both = results.every_load(points, X.load_cases(spark, sf))
    return both.select("load_step", "x", "y", "z", *(F.round(c * 1e4, 6).alias(n) for n, c in zip(("ux", "uy", "uz"), u, strict=True)))


# the corners of the filled cells
@query(f", c8 as (select * from (values (0,0,0),(1,0,0),(1,1,0),(0,1,0),(0,0,1),(1,0,1),(1,1,1),(0,1,1)) t(dx,dy,dz)), p as (select distinct x + dx x, y + dy y, z + dz z from porous cross join c8 where grain > 0) select load_step, x, y, z, {MOVED} from p cross join loads")
def strain_displacement(spark, sf):
    steps = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(o, ("dx", "dy", "dz"), strict=True))) for o in CORNERS))
    spread = X.voxels_porous(spark, sf).where("grain > 0").withColumn("o", F.explode(steps))
    points = spread.select("set_id", *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "xyz")).distinct()
    return _displaced(spark, sf, points)


@query(f"select load_step, x, y, z, {MOVED} from lat cross join loads")
def strain_displacement_all(spark, sf):
    return _displaced(spark, sf, X.cells(spark, sf).select(F.lit(1).cast("long").alias("set_id"), "x", "y", "z"))


FACE = "(least(x, y, z) <= 0.25 or greatest(x, y, z) >= n - 1.25)"


@query(f"select x, y, z, {FACE} on_face from lat")
def is_face_node(spark, sf):
    return X.cells(spark, sf).select("x", "y", "z", S.is_face_node("x", "y", "z", X.size(spark, sf) - 1).alias("on_face"))


@query("select event_type, value from events where value is not null and not isnan(value) and value <> 0 and abs(value) < 'inf'::double")
def finite_nonzero(spark, sf):
    return X.table(spark, sf, "events").where(S.finite_nonzero("value")).select("event_type", "value")


PARAMS = "par as (select p_partkey::bigint id, p_size::bigint size, p_retailprice::double / 100 c, p_partkey::bigint - 5 points from part)"


def _params(spark, sf):
    c = F.col
    return X.table(spark, sf, "part").select(c("p_partkey").cast("long").alias("id"), c("p_size").cast("long").alias("size"), (c("p_retailprice").cast("double") / 100).alias("c"), (c("p_partkey").cast("long") - 5).alias("points"))


@query(f"with {PARAMS} select id, floor(c / 100 * size * size * size)::bigint seeds, round(sqrt(c * size * size / pi() / 100))::bigint radius from par")
def seed_count(spark, sf):
    return _params(spark, sf).select("id", S.seed_count("c", "size").alias("seeds"), S.fibre_radius("c", "size").alias("radius"))


@query(f"with {PARAMS} select id, size, points, not (size <= 0 or points <= 0 or points > size*size*size) valid, case when size <= 0 then 'size' when points <= 0 then 'points' when points > size*size*size then 'too many points' end reason from par")
def parameter_check(spark, sf):
    fault = S.parameter_fault("size", "points")
    return _params(spark, sf).select("id", "size", "points", fault.isNull().alias("valid"), fault.alias("reason"))


HIST = """with ok as (select event_type, value v from events where value is not null and not isnan(value) and value <> 0 and abs(value) < 'inf'::double),
sh as (select event_type, count(*) total, min(v) low, max(v) high, cast(floor(round(sqrt(count(*))) / 2) as bigint) bins from ok group by 1),
s2 as (select *, (high - low) / bins width from sh where bins > 0),
pl as (select o.event_type, case when width = 0 then 0 else cast(floor((v - low) / nullif(width, 0)) as bigint) end bin, bins from ok o join s2 using (event_type)),
cn as (select event_type, {bin} bin, count(*) n from pl where {bin} < bins group by 1, 2),
ev as (select event_type, low, width, unnest(range(bins)) bin from s2),
hist as (select ev.event_type, ev.bin, round(low + ev.bin * width, 6) low, coalesce(n, 0) n from ev left join cn on cn.event_type = ev.event_type and cn.bin = ev.bin)"""


@query(HIST.replace("{bin}", "bin") + " select * from hist")
def property_histogram(spark, sf):
    return r6(results.histogram(X.table(spark, sf, "events"), "event_type", "value"), "low")


@query(HIST.replace("{bin}", "least(bin, bins - 1)") + " select * from hist")
def property_histogram_closed(spark, sf):
    return r6(results.histogram(X.table(spark, sf, "events"), "event_type", "value", mode="closed"), "low")


@query(HIST.replace("{bin}", "bin") + " select s2.event_type, round(greatest(0.0, low - width), 6) x_min, round(high + width, 6) x_max, least(10, bins)::bigint ticks, cast(floor((floor(high) + 9) / 10) * 10 + 10 as bigint) y_top, cast(floor((most + 9) / 10) * 10 + 10 as bigint) y_top_counts from s2 join (select event_type, max(n) most from hist group by 1) m using (event_type)")
def histogram_axis(spark, sf):
    return r6(results.histogram_axis(X.table(spark, sf, "events"), "event_type", "value"), "x_min", "x_max")


ALL = S.STORED[1:] + S.DERIVED
STATS = ", ".join(f"round({f}({c}), 6) {f}_{c}" for c in ALL for f in ("avg", "min", "max"))


@query(f", d as (select *, {USUM} usum, {VM} seqv, {EVM} epseqv from nodes) select set_id, load_step, {STATS} from d group by 1, 2")
def loadstep_stats(spark, sf):
    found = results.loadstep_stats(results.with_derived(X.node_results(spark, sf)), ALL)
    return r6(found, *found.columns[2:])


TENSORS = {"s": ["sx", "sy", "sz", "sxy", "syz", "sxz"], "e": ["eps_x", "eps_y", "eps_z", "eps_xy", "eps_yz", "eps_xz"], "l": ["exx", "eyy", "ezz", "exy", "eyz", "exz"]}
# places of the six components, as listed above, in a symmetric tensor
PLACES = {"11": 0, "22": 1, "33": 2, "12": 3, "21": 3, "23": 4, "32": 4, "13": 5, "31": 5}


@query(", a as (select load_step, " + ", ".join(f"avg({c}) {c}" for c in TENSORS["s"] + TENSORS["e"]) + " from nodes group by 1) select a.load_step, " + ", ".join(f"round({cells[k]}, 6) {t}{at}" for t, cells in TENSORS.items() for at, k in PLACES.items()) + " from a join loads using (load_step)")
def loadstep_tensors(spark, sf):
    t = results.loadstep_tensors(X.node_results(spark, sf), X.load_cases(spark, sf))
    return t.select("load_step", *(F.round(F.col(name)[i][j], 6).alias(f"{short}{i + 1}{j + 1}") for short, name in (("s", "stress"), ("e", "strain"), ("l", "load")) for i in range(3) for j in range(3)))


@query("with t as (select p_size::bigint size, p_retailprice::double v from part) select size, round(coalesce(avg(v), 0.0), 6) mean from t group by size")
def safe_mean(spark, sf):
    own = X.table(spark, sf, "part").select(F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").cast("double").alias("v"))
    return own.groupBy("size").agg(F.round(S.safe_mean("v"), 6).alias("mean"))


@query("select event_type, round(coalesce(avg(value::double), 0.0), 6) mean from events group by event_type")
def safe_mean_events(spark, sf):
    return X.table(spark, sf, "events").groupBy("event_type").agg(F.round(S.safe_mean(F.col("value").cast("double")), 6).alias("mean"))


@query("select l.load_step, x, y, z, round(coalesce(m.sx, 0), 6) as value from (select load_step, lat.* from lat cross join (select distinct load_step from nodes) s) l left join nodes m using (load_step, x, y, z)")
def value_at_coord(spark, sf):
    nodes = X.node_results(spark, sf)
    steps = F.array(*(F.lit(i) for i in range(1, 8)))  # line numbers are 1 to 7
    points = X.cells(spark, sf).select(F.lit(1).cast("long").alias("set_id"), F.explode(steps).alias("load_step"), "x", "y", "z")
    return r6(results.value_at(points, nodes, "sx"), "value").drop("set_id")


@query(""", c8 as (select * from (values (1,0,0,0),(2,1,0,0),(3,1,1,0),(4,0,1,0),(5,0,0,1),(6,1,0,1),(7,1,1,1),(8,0,1,1)) t(corner,dx,dy,dz)),
one as (select * from nodes where load_step = 1), lim as (select min(sx) low, max(sx) high from one),
v as (select p.x cell_x, p.y cell_y, p.z cell_z, corner, coalesce(o.sx, 0) v from porous p cross join c8 left join one o on o.x = p.x + dx and o.y = p.y + dy and o.z = p.z + dz where p.grain > 0),
s as (select *, case when high = low then 1.0 else (v - low) / nullif(high - low, 0) end s from v cross join lim)
select cell_x, cell_y, cell_z, corner, round(v, 6) as value, round(s, 6) scaled, floor(s * 8)::int as level from s""")
def voxel_corner_values(spark, sf):
    found = results.corner_values(X.voxels_porous(spark, sf), X.node_results(spark, sf), "sx", 1)
    return r6(found, "value", "scaled").drop("set_id")


@query("select row_number() over () * 0 as zero, load_step, id, sx from nodes where false union all select 0, l_linenumber::int, l_orderkey::bigint, max_by(l_extendedprice::double, l_partkey * 100000 + l_suppkey)::double from (select l_linenumber, l_orderkey, l_partkey, l_suppkey, max(l_extendedprice) l_extendedprice from lineitem group by all) group by 2, 3")
def last_wins(spark, sf):
    li = X.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("load_step"), F.col("l_orderkey").cast("long").alias("id"), (F.col("l_partkey").cast("long") * 100000 + F.col("l_suppkey")).alias("row_no")).agg(F.max(F.col("l_extendedprice").cast("double")).alias("sx"))
    return results.last_wins(li, ["load_step", "id"], "row_no").select(F.lit(0).cast("long").alias("zero"), "load_step", "id", "sx")


NODES = ", nd as (select 1::bigint set_id, k + 1 id, x, y, z, n - 1 m from lat)"


def _nodes(spark, sf):
    return X.cells(spark, sf).select(F.lit(1).cast("long").alias("set_id"), (F.col("k") + 1).alias("id"), "x", "y", "z")


@query(NODES + ", b as (select load_step, id node, exx*x + exy*y + exz*z UX, exy*x + eyy*y + eyz*z UY, exz*x + eyz*y + ezz*z UZ from nd cross join loads where least(x, y, z) = 0 or greatest(x, y, z) = m) select load_step, node, 'UX' dof, round(UX * 1e4, 6) as value from b union all select load_step, node, 'UY', round(UY * 1e4, 6) from b union all select load_step, node, 'UZ', round(UZ * 1e4, 6) from b")
def strain_bc(spark, sf):
    found = results.strain_bc(_nodes(spark, sf), X.load_cases(spark, sf), X.size(spark, sf) - 1)
    return found.select("load_step", "node", "dof", F.round(F.col("value") * 1e4, 6).alias("value"))


TENSION = [("x", "UX", 0.001), ("y", "UY", 0.002), ("z", "UZ", 0.003)]


@query(NODES + ", t as (" + " union all ".join(f"select id node, '{d}' dof, case when {a} = 0 then 0.0::double else round(m * {e}::double, 6) end as value from nd where {a} = 0 or {a} = m" for a, d, e in TENSION) + ") select node, dof, value from t")
def tension_bc(spark, sf):
    return r6(results.tension_bc(_nodes(spark, sf), X.size(spark, sf) - 1, (0.001, 0.002, 0.003)).drop("set_id"), "value")


# for each plane: the axis that drives, the one that slides under it, and the free one
def shear_sql(drive, slide, free):
    rows = [f"select id node, 'U{drive.upper()}' dof, case when {slide} = 0 then 0.0::double else round(m * 0.001::double, 6) end as value from nd where {slide} = 0 or {slide} = m"]
    rows.append(f"select id, 'U{free.upper()}', 0.0 from nd where {slide} = 0 or {slide} = m")
    rows += [f"select id, 'U{a.upper()}', 0.0 from nd where {drive} = 0 or {drive} = m" for a in (slide, free)]
    return NODES + f", t as ({' union '.join(rows)}) select node, dof, value from t"


def _shear(spark, sf, plane):
    return r6(results.shear_bc(_nodes(spark, sf), X.size(spark, sf) - 1, plane, 0.001).drop("set_id"), "value")


@query(shear_sql("x", "z", "y"))
def shear_bc(spark, sf):
    return _shear(spark, sf, "XZ")


@query(shear_sql("x", "y", "z"))
def shear_bc_xy(spark, sf):
    return _shear(spark, sf, "XY")


@query(shear_sql("y", "z", "x"))
def shear_bc_yz(spark, sf):
    return _shear(spark, sf, "YZ")


@query(NODES + " select id, x, y, z from nd where least(x, y, z) = 0 or greatest(x, y, z) = m")
def face_node_union(spark, sf):
    return results.face_node_union(_nodes(spark, sf), X.size(spark, sf) - 1).drop("set_id")
