"""Queries that go through files, the result store and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from latticeframe.functions import scalar as S
from latticeframe.operators import lattice, results
from latticeframe.plans import fixtures as X
from latticeframe.plans import queries_grains as G
from latticeframe.plans import queries_nodes as N
from latticeframe.plans.lineage import materialise, shared_dir
from latticeframe.plans.registry import query
from latticeframe.sources import files, store
from latticeframe.streaming import ingest


#: How the queries write load steps: packed, in files that one task reads.
PACKED = {"file_ids": 250_000, "compression": "lz4"}


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(", v as (select * from vox) select x, y, z, grain from v")
def voxel_csv_roundtrip(spark, sf):
    path = _folder(spark, "voxel-csv")
    files.write_voxel_csv(X.voxels(spark, sf), path)
    return files.read_voxel_csv(spark, path)


SHOWN = "load_step, id, x::double x, y::double y, z::double z, round(ux, 6) ux, round(sx, 6) sx, round(sz, 4) sz"


def _shown(nodes):
    return nodes.select("load_step", "id", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.round("ux", 6).alias("ux"), F.round("sx", 6).alias("sx"), F.round("sz", 4).alias("sz"))


@query(f"select {SHOWN} from nodes")
def loadstep_text_scan(spark, sf):
    path = _folder(spark, "loadsteps")
    files.write_loadsteps(X.node_results(spark, sf), path, **PACKED)
    return _shown(files.read_loadsteps(spark, path))


# a tenth of the lines is cut off, another has a field of stars
@query("""select load_step, id, case when id % 10 = 3 then 'short' else 'sx' end reason from nodes where id % 10 in (3, 7)""")
def loadstep_rejects(spark, sf):
    sound, damaged = _folder(spark, "loadsteps"), _folder(spark, "damaged")
    files.write_loadsteps(X.node_results(spark, sf), sound, **PACKED)
    lines = spark.read.option("recursiveFileLookup", True).text(sound).select("value", F.col("_metadata.file_path").alias("path"))
    number, field = F.trim(F.substring("value", 1, 16)).try_cast("double") % 10, 17 * 7 + 1
    stars = F.concat(F.substring("value", 1, field - 1), F.lit("*" * 16), F.expr(f"substring(value, {field + 16})"))
    value = F.when(number == 3, F.substring("value", 1, 160)).when(number == 7, stars).otherwise(F.col("value"))
    step = F.regexp_extract("path", r"ls=(\d+)", 1).alias("ls")
    lines.select(value.alias("value"), step).write.option("compression", PACKED["compression"]).partitionBy("ls").text(damaged)
    return files.rejected_loadsteps(spark, damaged).select("load_step", "id", "reason")


def _filled_store(spark, sf):
    root = _folder(spark, "store")
    nodes, loads = X.node_values(materialise(X.node_base(spark, sf), "nodes")), X.load_cases(spark, sf)
    own = X.table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("grain"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("phi1", "phi", "phi2"))))
    store.append_set(root, X.voxels(spark, sf), own, nodes.where("load_step <= 3"), loads)
    store.append_set(root, X.voxels_porous(spark, sf), own, nodes.where("load_step > 3"), loads)
    return root


@query(""", s as (select 1 set_id, x, y, z, grain from vox union all select 2, x, y, z, grain from porous),
v as (select set_id, count(*) cells, cast(sum(grain) as bigint) grains, cast(greatest(max(x), max(y), max(z)) + 1 as bigint) cube_size, max(grain) num_points from s group by 1),
o as (select count(*) orientations, round(sum(embedding[1]::double), 4) phi1 from embeddings),
r as (select case when load_step <= 3 then 1 else 2 end set_id, count(*) n_results, count(distinct load_step) n_steps from nodes group by 1),
st as (select case when load_step <= 3 then 1 else 2 end set_id, load_step, max(sx) top, avg(sx) mean from nodes group by 1, 2),
st2 as (select set_id, round(sum(top), 4) max_sx, round(sum(mean), 4) avg_sx from st group by 1),
ld as (select count(*) n_loads, round(sum(exx + eyy + ezz + exy + eyz + exz) * 1e4, 4) strain from loads)
select v.*, orientations, phi1, n_results, n_steps, max_sx, avg_sx, n_loads, strain from v join r using (set_id) join st2 using (set_id) cross join o cross join ld""")
def result_store_append(spark, sf):
    root = _filled_store(spark, sf)
    kept = lambda name: store.scan(spark, root, name).groupBy("set_id")
    one = F.count(F.lit(1))
    parts = [
        kept("voxels").agg(one.alias("cells"), F.sum("grain").alias("grains")),
        store.scan(spark, root, "geometry_sets").select("set_id", F.col("cube_size").cast("long").alias("cube_size"), "num_points"),
        kept("orientations").agg(one.alias("orientations"), F.round(F.sum("phi1"), 4).alias("phi1")),
        kept("results").agg(one.alias("n_results"), F.count_distinct("load_step").alias("n_steps")),
        kept("result_stats").agg(F.round(F.sum("max_sx"), 4).alias("max_sx"), F.round(F.sum("avg_sx"), 4).alias("avg_sx")),
        kept("load_cases").agg(one.alias("n_loads"), F.round(F.sum(F.expr("exx + eyy + ezz + exy + eyz + exz")) * 1e4, 4).alias("strain")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "set_id")
    return out


@query(f"select {SHOWN} from nodes where load_step = 5")
def result_store_scan(spark, sf):
    return _shown(store.scan(spark, _filled_store(spark, sf), "results", 2, 5))


# the nodes of a box in the middle
@query(f"select {SHOWN} from nodes where load_step = 5 and x between n // 3 and n // 2 and y between n // 4 and n // 2 and z between n // 3 and n // 2")
def result_store_box(spark, sf):
    n = X.size(spark, sf)
    return _shown(store.box(spark, _filled_store(spark, sf), (n // 3, n // 4, n // 3), (n // 2, n // 2, n // 2), 2, 5))


# coloured by the limits that the store holds: one pass over the nodes
@query(N.LIMITS + " select load_step, id, round(case when high = low then 1.0 else (sx - low) / nullif(high - low, 0) end, 6) scaled, floor(case when high = low then 1.0 else (sx - low) / nullif(high - low, 0) end * 8)::int as level from nodes join lim using (set_id, load_step)")
def result_store_color(spark, sf):
    root = _filled_store(spark, sf)
    coloured = results.scaled(store.scan(spark, root, "results"), "sx", store.limits(spark, root, "sx"))
    return coloured.select("load_step", "id", F.round("scaled", 6).alias("scaled"), S.color_level("scaled").alias("level"))


@query("select distinct case when load_step <= 3 then 1 else 2 end set_id, load_step from nodes")
def result_catalog(spark, sf):
    return store.catalog(spark, _filled_store(spark, sf))


@query(", e as (select vec_id, unnest(range(64))::int p, unnest(embedding)::double v from embeddings) select vec_id, p // 16 x, p // 4 % 4 y, p % 4 z, round(v, 6) as value from e")
def dense_array_unpack(spark, sf):
    cube = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda y: F.slice("embedding", x * 16 + y * 4 + 1, 4)))
    arrays = X.table(spark, sf, "embeddings").select("vec_id", cube.alias("cube"))
    return files.dense_array_unpack(arrays, "cube").withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(", e as (select vec_id, unnest(range(64))::int p, unnest(embedding)::double v from embeddings) select vec_id, p // 16 x, p // 4 % 4 y, string_agg(round(v * 1000)::bigint::varchar, ',' order by p) \"values\" from e group by 1, 2, 3")
def dense_array_pack(spark, sf):
    cells = files.flat_array_unpack(X.table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 4, 4)
    packed = files.dense_array_pack(cells, ["vec_id"], "value")
    return packed.withColumn("values", F.array_join(F.transform("values", lambda v: F.round(v.cast("double") * 1000).cast("long").cast("string")), ","))


@query("""with e as (select vec_id, unnest(range(64))::int p, unnest(embedding)::double v from embeddings)
select vec_id, string_agg(case when p = 0 then '' when p % 16 = 0 then '|' when p % 4 = 0 then ';' else ',' end || round(v * 1000)::bigint::varchar, '' order by p) cube from e group by 1""")
def dense_cube_pack(spark, sf):
    cells = files.flat_array_unpack(X.table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 4, 4)
    text = lambda a, gap: F.array_join(a, gap)
    line = lambda values: text(F.transform(values, lambda v: F.round(v.cast("double") * 1000).cast("long").cast("string")), ",")
    cube = files.dense_cube_pack(cells, ["vec_id"], "value").select("vec_id", F.transform("cube", lambda plane: text(F.transform(plane, line), ";")).alias("planes"))
    return cube.select("vec_id", text("planes", "|").alias("cube"))


@query(G.CC + f""", {G.VOLUME}, {G.SURFACE} select round(norm_area, 6) norm_area, perimeter, round(shape_factor, 6) shape_factor, ecr, volume,
round(volume / (select max(volume) from vol), 6) norm_volume, surface_area, round(0.4 * pow(3 * volume / (4 * pi()), 2.0 / 3), 6) inertia, round(pow(3 * volume / (4 * pi()), 1.0 / 3), 6) esr
from full_sg join vol using (set_id, grain) join surf using (set_id, grain)""")
def grain_property_csv(spark, sf):
    """A row for each component of a slice, with the properties of its grain."""
    path = _folder(spark, "properties")
    slices = lattice.slice_grains(X.voxels_porous(spark, sf), X.size(spark, sf))
    files.write_property_csv(slices.join(lattice.grain_properties(X.voxels(spark, sf)), ["set_id", "grain"]), path)
    read = files.read_csv(spark, path, ", ".join(f"`{c}` {'long' if c in ('Perimeter', 'Volume', 'SurfaceArea') else 'double'}" for c in files.PROPERTY_HEADER.values()))
    read = read.select(*(F.col(name).alias(c) for c, name in files.PROPERTY_HEADER.items())).withColumn("shape_factor", F.col("shape_factor") + 1e-9)
    return G.r6(read, "norm_area", "shape_factor", "ecr", "norm_volume", "inertia", "esr")


@query(G.TURNED + G.OCCUPANCY.replace("{f}", "floor").replace("{inside}", G.INSIDE).replace("{where}", "where p.x < 3 and p.y < 3 and p.z < 3"))
def probability_csv(spark, sf):
    path = _folder(spark, "probability")
    files.write_probability_csv(G.cell_occupancy(spark, sf), path)
    read = files.read_csv(spark, path, "X int, Y int, Z int, Probability double")
    return read.select(F.col("X").alias("i"), F.col("Y").alias("j"), F.col("Z").alias("k"), F.col("Probability").alias("probability"))


LONG = "unpivot (select load_step, x::double x, y::double y, z::double z, " + ", ".join(f"{c}::double {c}" for c in ingest.COMPONENTS[3:]) + f" from nodes) on {', '.join(ingest.COMPONENTS)} into name component value v"


@query(f"select load_step, component, count(*) n, round(avg(v) + 1e-9, 4) avg, round(min(v) + 1e-9, 4) low, round(max(v) + 1e-9, 4) high from ({LONG}) group by 1, 2")
def loadstep_stream_ingest(spark, sf):
    source, kept, marks = (_folder(spark, f"stream-{x}") for x in ("in", "store", "marks"))
    nodes = X.node_results(spark, sf)
    for part in (nodes.where("load_step <= 4"), nodes.where("load_step > 4")):  # files arrive in two goes
        files.write_loadsteps(part, f"{source}/{uuid.uuid4().hex}", **PACKED)
        ingest.ingest_loadsteps(spark, source, kept, marks)
    found = ingest.running_stats(spark, kept)
    return found.select("load_step", "component", "n", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("avg", "low", "high")))


TITLES = {**results.SLICE_TITLES, **results.GRAIN_TITLES}
PROPERTIES = G.CC + f""", {G.VOLUME}, {G.SURFACE}, gp as (select v.set_id, v.grain, volume, volume / max(volume) over (partition by v.set_id) norm_volume, surface_area,
  pow(3 * volume / (4 * pi()), 1.0 / 3) esr, 0.4 * pow(3 * volume / (4 * pi()), 2.0 / 3) inertia from vol v join surf using (set_id, grain)),
named as ({' union all '.join([f"select set_id, '{t}' title, grain, z, component, {c}::double v from full_sg" for t, c in results.SLICE_TITLES.items()] + [f"select set_id, '{t}', grain, null::bigint, null::bigint, {c}::double from gp" for t, c in results.GRAIN_TITLES.items()])})"""


def _properties(spark, sf):
    slices = G.r6(lattice.slice_grains(X.voxels_porous(spark, sf), X.size(spark, sf)).withColumn("shape_factor", F.col("shape_factor") + 1e-9), "norm_area", "ecr", "shape_factor")
    return results.grain_properties_long(slices, lattice.grain_properties(X.voxels(spark, sf)))


@query(PROPERTIES + ' select set_id, title, grain, z, component, round(v, 6) as "value" from named')
def grain_property_select(spark, sf):
    return G.r6(_properties(spark, sf), "value")


# the distribution of every property that has a title; limits of bins are the only places where rounding counts, so values are rounded first
@query(PROPERTIES + N.HIST[4:].replace("ok as (select event_type, value v from events where value is not null and not isnan(value) and value <> 0 and abs(value) < 'inf'::double)", ", ok as (select title event_type, round(v, 6) v from named where v is not null and round(v, 6) <> 0)").replace("{bin}", "bin") + " select event_type title, bin, low, n from hist")
def grain_property_histogram(spark, sf):
    return G.r6(results.histogram(G.r6(_properties(spark, sf), "value"), "title", "value"), "low")
