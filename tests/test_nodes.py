"""Nodal operators, generators, files and the store by hand."""

import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from latticeframe.functions import scalar as S
from latticeframe.operators import generate, results
from latticeframe.sources import files, store
from latticeframe.streaming import ingest


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("v")).first().v


@pytest.mark.parametrize("values,bins", [([], 0), ([1.0], 0), ([1.0, 2.0], 0), ([1.0, 2.0, 3.0], 1), ([4.0] * 20, 2), ([0.0, float("inf"), float("nan"), None] + [float(i) for i in range(1, 17)], 2)])
def test_histogram(spark, values, bins):
    t = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    rows = results.histogram(t, "k", "v").collect()
    assert len(rows) == bins
    good = [v for v in values if v and math.isfinite(v)]
    closed = sum(r.n for r in results.histogram(t, "k", "v", "closed").collect())
    assert closed == (len(good) if bins else 0)
    if bins and min(good) < max(good):
        assert sum(r.n for r in rows) == len([v for v in good if v < max(good)])


@pytest.mark.parametrize("q,expected", [((1, 0, 0, 0), (0, 0, 0)), ((0, 1, 0, 0), (0, 180, 0)), ((0, 0, 0, 0), (0, 0, 0)), ((math.cos(0.3), 0, 0, math.sin(0.3)), None)])
def test_euler(spark, q, expected):
    e = one(spark, S.euler_from_quaternion("w", "x", "y", "z"), **dict(zip("wxyz", map(float, q), strict=True)))
    assert not any(map(math.isnan, e))
    if expected:
        assert tuple(e) == pytest.approx(expected, abs=1e-6)
    else:
        assert e.phi == pytest.approx(0, abs=1e-6) and e.phi2 == 0 and abs(e.phi1) == pytest.approx(math.degrees(0.6))


def test_patch(spark):
    loads = spark.createDataFrame([(1, 1, 1e-3, 2e-3, 3e-3, 4e-4, 5e-4, 6e-4)], "set_id long, load_step int, exx double, eyy double, ezz double, exy double, eyz double, exz double")
    corners = [(1, i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)] + [(1, 8, 0.5, 0.5, 0.5)]
    nodes = spark.createDataFrame(corners, "set_id long, id long, x double, y double, z double")
    found = {(r.node, r.dof): r.value for r in results.strain_bc(nodes, loads, 1).collect()}
    assert len(found) == 24
    for _, i, x, y, z in corners[:8]:
        assert found[i, "UX"] == pytest.approx(1e-3 * x + 4e-4 * y + 6e-4 * z)
        assert found[i, "UZ"] == pytest.approx(6e-4 * x + 5e-4 * y + 3e-3 * z)
    with pytest.raises(ValueError):
        results.shear_bc(nodes, 1, "YX", 0.1)
    assert results.face_node_union(nodes, 1).count() == 8 == nodes.where(S.is_face_node("x", "y", "z", 1)).count()


def test_missing_coordinate_and_last_row(spark):
    nodes = spark.createDataFrame([(1, 1, 1, 0, 0, 0, 5.0), (1, 1, 2, 0, 0, 0, 7.0)], "set_id long, load_step int, id long, x long, y long, z long, sx double")
    points = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 1, 9, 9, 9)], "set_id long, load_step int, x long, y long, z long")
    assert sorted(r.value for r in results.value_at(points, nodes, "sx").collect()) == [0.0, 7.0]


@pytest.mark.parametrize("parts", [1, 16])
def test_generators_do_not_depend_on_layout(spark, parts):
    keys = spark.range(40).withColumnRenamed("id", "i").repartition(parts)
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    same = spark.range(40).withColumnRenamed("id", "i").coalesce(1)
    assert plain(generate.seed_sample(keys, 4, 1)) == plain(generate.seed_sample(same, 4, 1))
    assert plain(generate.random_orientations(keys, 1)) == plain(generate.random_orientations(same, 1))
    assert len({r[1:] for r in plain(generate.seed_sample(keys, 4, 1))}) == len(plain(generate.seed_sample(keys, 4, 1)))
    assert generate.load_case_grid(spark, 2, 0.0, 1.0, keys).count() == 64 + 40


def nodes(spark, steps):
    rows = [(1, s, i, float(i), 1.0, 2.0, *(round(0.1 * k + s + i, 3) for k in range(15))) for s in steps for i in range(1, 5)]
    return spark.createDataFrame(rows, "set_id long, load_step int, id long, " + ", ".join(f"{c} double" for c in S.STORED[1:]))


def test_loadstep_text(spark, tmp_path):
    made = nodes(spark, [1, 12])
    files.write_loadsteps(made, str(tmp_path / "ls"), file_ids=3)
    held = [p for p in (tmp_path / "ls").rglob("*.txt")]
    assert len(held) == 4 and all(p.read_text().split(";")[0].strip() == "id" for p in held)  # two ranges of ids a step, a header each
    read = files.read_loadsteps(spark, str(tmp_path / "ls"))
    assert sorted(map(tuple, read.select(made.columns[1:]).collect())) == sorted(map(tuple, made.drop("set_id").collect()))


CELLS = "x long, y long, z long, grain long"
TURNS = "grain long, phi1 double, phi double, phi2 double"


@pytest.fixture
def given(spark):
    return spark.createDataFrame([(0, 0, 0, 1), (1, 1, 1, 2)], CELLS), spark.createDataFrame([(1, 0.0, 0.0, 0.0)], TURNS)


def test_store(spark, tmp_path, given):
    root = str(tmp_path / "store")
    assert [store.append_set(root, *given, nodes(spark, [s])) for s in (2, 10)] == [1, 2]
    assert [tuple(r) for r in store.catalog(spark, root).collect()] == [(1, 2), (2, 10)]
    pruned = store.scan(spark, root, "results", 2, 10)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 4 and "load_step" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    limits = {(r.set_id, r.load_step): (r.low, r.high) for r in store.limits(spark, root, "seqv").collect()}
    made = results.with_derived(nodes(spark, [10])).agg(F.min("seqv"), F.max("seqv")).first()
    assert limits[2, 10] == pytest.approx(tuple(made), rel=1e-9)


def test_empty_store(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.catalog(spark, root).count() == 0 and store.version(spark, root) == 0 and store.committed(spark, root) == []
    assert store.scan(spark, root, "voxels") is None and store.limits(spark, root, "sx") is None and store.sweep(spark, root, 0) == []


def test_writers_that_stop(spark, tmp_path, given):
    root = str(tmp_path / "store")
    store.append_set(root, *given)
    assert store.catalog(spark, root).count() == 0  # a set without results
    first, second = store.claim_set_id(spark, root), store.claim_set_id(spark, root)
    assert (first, second) == (2, 3)
    # the later claim is committed first; a reader keeps the version that it began with
    store.write_set(root, second, *given, nodes(spark, [4]))
    seen = store.version(spark, root)
    assert store.commit(spark, root, second) == seen + 1 == 2
    assert store.committed(spark, root) == [1, 3] and store.committed(spark, root, seen) == [1]
    assert store.scan(spark, root, "voxels", upto=seen).count() == 2 and store.scan(spark, root, "voxels").count() == 4
    # one stops between its data and the commit: nobody sees it, and a sweep removes it, but not while it may go on
    store.write_set(root, first, *given, nodes(spark, [4]))
    assert store.scan(spark, root, "voxels", 2) is None and store.sweep(spark, root, 3600) == []
    assert store.sweep(spark, root, -1) == [2] and not (tmp_path / "store/voxels/set_id=2").exists()
    with pytest.raises(RuntimeError, match="swept"):
        store.commit(spark, root, 2)
    # one stops between its fate and the log: the sweep enters it, once
    late = store.claim_set_id(spark, root)
    store.write_set(root, late, *given)
    assert store._settle(spark, root, late, store.COMMITTED) == store.COMMITTED
    assert store.committed(spark, root) == [1, 3]
    assert store.sweep(spark, root, -1) == [] and store.committed(spark, root) == [1, 3, 4]
    assert store.commit(spark, root, late) == 3 == store.version(spark, root)


def test_two_writers_take_different_ids(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "store")
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda _: store.claim_set_id(spark, root), range(12)))
        assert sorted(ids) == list(range(1, 13))
        versions = list(pool.map(lambda i: store.commit(spark, root, i), ids))
    assert sorted(versions) == list(range(1, 13)) and store.committed(spark, root) == sorted(ids)


def test_a_box_leaves_row_groups_unread(spark, tmp_path, given):
    root, n = str(tmp_path / "store"), 24
    i = F.col("id")
    place = [F.floor(i / (n * n)).alias("x"), (F.floor(i / n) % n).alias("y"), (i % n).alias("z")]
    many = spark.range(n**3).select(F.lit(1).alias("load_step"), "id", *place, *(F.lit(1.0).alias(c) for c in S.STORED[4:]))
    old = spark._jsc.hadoopConfiguration().get("parquet.block.size")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    try:
        store.append_set(root, *given, many)
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.block.size") if old is None else spark._jsc.hadoopConfiguration().set("parquet.block.size", old)
    found = store.box(spark, root, (2, 3, 4), (5, 6, 7), 1, 1)
    execution = found._jdf.queryExecution()
    assert found.count() == 64
    plan = execution.executedPlan()
    execution.toRdd().count()
    scans = plan.collectLeaves()
    read = sum(scans.apply(k).metrics().apply("numOutputRows").value() for k in range(scans.size()))
    assert 64 <= read < n**3 / 4


def test_morton_keeps_neighbours_together(spark):
    at = spark.createDataFrame([(x / 2, y / 2, z / 2) for x in range(4) for y in range(4) for z in range(4)], "x double, y double, z double")
    keys = {(2 * r.x, 2 * r.y, 2 * r.z): r.k for r in at.withColumn("k", S.morton("x", "y", "z")).collect()}
    assert sorted(keys.values()) == list(range(64)) and keys[1, 0, 0] == 1 and keys[0, 1, 0] == 2 and keys[0, 0, 2] == 32


def test_damaged_lines_are_told(spark, tmp_path):
    files.write_loadsteps(nodes(spark, [3]), str(tmp_path / "ls"))
    path = next((tmp_path / "ls").rglob("*.txt"))
    lines = path.read_text().splitlines()
    lines[1] = lines[1][: 17 * 10]  # 10 of 19 fields
    lines[2] = lines[2][: 17 * 4] + "*" * 16 + lines[2][17 * 4 + 16 :]
    path.write_text("\n".join([*lines, "", "rubbish"]) + "\n")
    path.with_name(f".{path.name}.crc").unlink()
    counts = Observation("lines")
    read = files.read_loadsteps(spark, str(tmp_path / "ls"), counts)
    assert sorted(r.id for r in read.collect()) == [3, 4]
    assert counts.get == {"nodes": 2, "headers": 1, "rejected": 4}
    told = files.rejected_loadsteps(spark, str(tmp_path / "ls")).collect()
    assert sorted((r.id or 0, r.reason) for r in told) == [(0, "short"), (0, "short"), (1, "short"), (2, "ux")]
    assert {r.load_step for r in told} == {3}


def test_grain_properties_by_title(spark):
    slices = spark.createDataFrame([(1, 0, 7, 3, 4, 4, 0.25, 0.3, 1.0)], "set_id long, z long, grain long, component long, area long, perimeter long, norm_area double, ecr double, shape_factor double")
    grains = spark.createDataFrame([(1, 7, 9, 1.0, 30, 1.2, 0.6)], "set_id long, grain long, volume long, norm_volume double, surface_area long, esr double, inertia double")
    every = {r.title: (r.grain, r.z, r.component, r.value) for r in results.grain_properties_long(slices, grains).collect()}
    assert set(every) == {*results.SLICE_TITLES, *results.GRAIN_TITLES} and len(every) == 10
    for title, values in every.items():
        one_title = results.grain_property(title, slices, grains)
        assert [tuple(r) for r in one_title.select("title", "grain", "z", "component", "value").collect()] == [(title, *values)]
    assert every["Area"] == (7, 0, 3, 4.0) and every["Surface Area"] == (7, None, None, 30.0)
    with pytest.raises(ValueError, match="title"):
        results.grain_property("Weight", slices, grains)


def test_stream_takes_each_file_once(spark, tmp_path):
    assert ingest.running_stats(spark, str(tmp_path / "nothing")).count() == 0
    source, kept, marks = (str(tmp_path / x) for x in ("in", "store", "marks"))
    for k, steps in enumerate(([1, 2], [3], [])):
        if steps:
            files.write_loadsteps(nodes(spark, steps), f"{source}/{k}")
        ingest.ingest_loadsteps(spark, source, kept, marks)
    assert spark.read.parquet(f"{kept}/rows").count() == 12
    found = {(r.load_step, r.component): r for r in ingest.running_stats(spark, kept).collect()}
    made = {r.load_step: r for r in results.loadstep_stats(nodes(spark, [1, 2, 3]), ingest.COMPONENTS).collect()}
    assert set(found) == {(s, c) for s in (1, 2, 3) for c in ingest.COMPONENTS}
    for (step, c), r in found.items():
        assert r.n == 4 and (r.avg, r.low, r.high) == pytest.approx((made[step][f"avg_{c}"], made[step][f"min_{c}"], made[step][f"max_{c}"]), abs=1e-6)


def test_statistics_of_many_batches_are_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FAN", 3)
    kept = str(tmp_path / "store")
    assert ingest.running_stats(spark, kept).count() == 0
    for b in range(29):
        part = spark.createDataFrame([(1, "sx", 1, float(b), float(b), float(b)), (b, "sy", 2, 1.0, 1.0, 1.0)], ingest.STATS)
        ingest._put_stats(part, kept, b)
        if b in (8, 17):
            ingest._put_stats(part, kept, b)  # a batch that runs twice
        if b in (0, 8, 9, 28):
            found = {(r.load_step, r.component): r for r in ingest.running_stats(spark, kept).collect()}
            assert (found[1, "sx"].n, found[1, "sx"].avg, found[1, "sx"].high) == (b + 1, b / 2, b)
            assert sum(r.n for (_, c), r in found.items() if c == "sy") == 2 * (b + 1)
    assert len(ingest.stats_parts(spark, kept)) == 3  # 27, 1 and 1
    assert len(list((tmp_path / "store/stats").glob("*/*"))) <= 2 * 3 * 4


def test_many_load_cases_are_salted(spark):
    made = nodes(spark, [1]).select("set_id", "x", "y", "z")
    loads = spark.range(30).select(F.lit(1).cast("long").alias("set_id"), F.col("id").cast("int").alias("load_step"))
    for most in (30, 5):
        assert results.every_load(made, loads, most).groupBy("load_step").count().where("count = 4").count() == 30


def test_mean_of_nothing(spark):
    assert spark.range(3).select(F.lit(None).cast("double").alias("v")).agg(S.safe_mean("v")).first()[0] == 0.0
