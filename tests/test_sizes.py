"""Steps that must not grow faster than their input."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from latticeframe.operators import lattice as L
from latticeframe.operators import mesh
from latticeframe.plans import fixtures, queries_sources
from latticeframe.sources import files, store
from latticeframe.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_cells_do_not_go_through_the_driver(spark):
    points = spark.range(1000).selectExpr("id", "id % 10 x", "id div 10 % 10 y", "id div 100 z")
    assert "Broadcast" not in plan(L.near_cell_pairs(points, 2))


def test_near_cells_of_repeated_points(spark):
    rows = [(k, k * 7 % 5 - 2, k * 3 % 4 - 2, k % 2) for k in range(12)] * 2 + [(50, 0, 0, 0), (50, 1, 0, 0)]
    found = sorted(map(tuple, L.near_cell_pairs(spark.createDataFrame(rows, "id long, x long, y long, z long"), 2).collect()))
    close = lambda a, b: all(abs(p // 2 - q // 2) <= 1 for p, q in zip(a[1:], b[1:], strict=True))
    assert found == sorted((a[0], b[0]) for a, b in itertools.product(rows, rows) if a[0] < b[0] and close(a, b))


def test_near_cells_of_all_filled_cells_do_not_go_through_the_driver(spark):
    assert "Broadcast" not in plan(entry.queries()["near_cell_join_filled"](spark, SF))


def test_near_cells_of_all_filled_cells_do_not_go_through_the_driver_when_sizes_are_known(spark):
    pairs = entry.queries()["near_cell_join_filled"](spark, SF)
    assert len(pairs.collect()) > 0
    final = plan(pairs)
    assert "isFinalPlan=true" in final and "Broadcast" not in final


@pytest.mark.parametrize("name", ["cluster_contacts", "cluster_contacts_periodic"])
def test_contacts_do_not_go_through_the_driver(spark, name):
    contacts = entry.queries()[name](spark, SF)
    assert "Broadcast" not in plan(contacts)
    assert len(contacts.collect()) > 0
    final = plan(contacts)
    assert "isFinalPlan=true" in final and "Broadcast" not in final


def test_sound_lines_are_read_once_and_in_bulk(spark):
    lines = spark.createDataFrame([("x", "ls=1/y")], "value string, path string")
    shown = plan(files.parse_loadsteps(lines))
    assert shown.count("_numbers(") == 1


def test_load_steps_are_written_from_one_reading_of_the_nodes(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    nodes = spark.range(40, numPartitions=2).selectExpr("cast(1 + id % 2 as int) load_step", "id", *(f"double(id) / 7 {c}" for c in files.STORED[1:]))
    counted = nodes.mapInArrow(lambda parts: (reads.add(p.num_rows) or p for p in parts), nodes.schema)
    files.write_loadsteps(counted, str(tmp_path / "ls"), file_ids=16, compression="gzip")
    assert reads.value == 40
    read = files.read_loadsteps(spark, str(tmp_path / "ls"))
    assert sorted((r.load_step, r.id, r.x) for r in read.collect()) == sorted((1 + k % 2, k, float(f"{k / 7:.8E}")) for k in range(40))


def test_odd_lines_are_judged_as_before(spark):
    sound = ";".join(form % (k + 0.5) for k, form in enumerate(files.LINE)) + ";"
    put = lambda k, text: sound[: 17 * k] + text.rjust(16) + sound[17 * k + 16 :]
    odd = {sound: None, sound[:300]: "short", put(3, "*" * 16): files.STORED[3], put(0, "NULL"): files.STORED[0], put(5, "+1.5e3"): None, put(6, "Infinity"): None, put(7, "NaN"): None, put(8, "1e999"): None, put(9, ""): files.STORED[9], put(10, "\t2"): None}
    odd[";".join(c.rjust(16) for c in files.STORED) + ";"] = "header"
    lines = spark.createDataFrame([(v, "ls=1/y") for v in odd], "value string, path string")
    assert {r.value: r.reason for r in files.judged_loadsteps(lines).collect()} == odd


@pytest.mark.parametrize("several", [1, 40])
def test_clusters_over_many_bricks(spark, monkeypatch, several):
    n, rng = 11, random.Random(several)
    places = [p for p in itertools.product(range(n), repeat=3) if rng.random() < 0.45]
    rows = [(rng.randrange(several * 20) if several > 1 else 500 - k, *p) for k, p in enumerate(places)]
    rows += [(c + 1, *p) for c, *p in rows[:9]] + [(1000, n, 3, 3), (1001, n + 1, 3, 3), (7, None, 1, 1), (None, 1, 1, 1)]
    root = {c: c for c, *_ in rows if c is not None}
    at = {}
    for c, *p in rows[:-4]:
        at.setdefault(tuple(p), []).append(c)
    met = [(a, b) for (x, y, z), ids in at.items() for q in ((x + 1, y, z), (x, y + 1, z), (x, y, z + 1)) for a in ids for b in at.get(q, [])]
    while any(root[a] != root[b] for a, b in met):
        for a, b in met:
            root[a] = root[b] = min(root[a], root[b])
    links = []
    whole = L.connected_components
    monkeypatch.setattr(L, "connected_components", lambda edges, u, v: whole(links.append(edges.count()) or edges, u, v))
    found = L.cluster_merge(spark.createDataFrame(rows, "cluster long, x long, y long, z long"), n, 4)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, found.select("cluster", "x", "y", "z", "merged").collect()), key=key) == sorted(((*r, root.get(r[0])) for r in rows), key=key)
    assert several > 1 or links[0] < len(met) / 3


def test_results_of_a_load_step_are_sorted_and_written_by_several_tasks(spark, tmp_path):
    spot = spark.range(600_000).selectExpr("cast(1 as int) load_step", "id", "id % 90 x", "id div 90 % 90 y", "id div 8100 z")
    nodes = spot.select("*", *(F.col("id").cast("double").alias(c) for c in files.STORED[4:]))
    own = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "grain long, phi1 double, phi double, phi2 double")
    voxels = spark.createDataFrame([(0, 0, 0, 1)], "x long, y long, z long, grain long")
    store.append_set(str(tmp_path), voxels, own, nodes)
    assert len(list(tmp_path.glob("results/set_id=1/load_step=1/*.parquet"))) > 1
    assert store.scan(spark, str(tmp_path), "results").agg(F.count("id"), F.sum("sx")).first()[:] == (600_000, 600_000 * 599_999 / 2)


def test_mesh_does_not_carry_lists_of_nodes_between_its_passes(spark, monkeypatch):
    written = []
    whole = mesh.materialise
    monkeypatch.setattr(mesh, "materialise", lambda df, name: written.append((name, dict(df.dtypes))) or whole(df, name))
    voxels = spark.range(27).selectExpr("1L set_id", "id div 9 x", "id div 3 % 3 y", "id % 3 z", "id % 4 grain")
    assert mesh.mesh8(voxels, 2)[1].count() == 20
    assert not [t for name, types in written if name == "mesh8" for t in types.values() if t.startswith("array")]


def test_nodes_are_dealt_once_and_not_sent_through_the_driver(spark):
    made = plan(fixtures.node_results(spark, SF))
    assert "Broadcast" not in made and made.count("Exchange hashpartitioning") == 2


def hard_values():
    rng, n = np.random.default_rng(5), 400
    signs = rng.choice([-1.0, 1.0], n)
    powers = 10.0 ** rng.integers(-18, 33, n)
    middle = (rng.integers(10**8, 10**9, n) + 0.5) * 10.0 ** rng.integers(-16, 10, n)
    values = [signs * 10 ** rng.uniform(-20, 35, n), signs * 10 ** rng.uniform(-320, 308, n), powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), signs * middle, np.nextafter(middle, 0)]
    values += [(rng.integers(10**8, 10**9, n) * 8 + 4) / 8, 999999999.5 / powers, rng.choice([0.0, -0.0, 5e-324, np.inf, np.nan], n), rng.integers(0, 100, n) / 100]
    ids = np.where(rng.random(n) < 0.8, np.floor(10 ** rng.uniform(0, 15, n)), rng.choice([0.0, 0.5, 1.5, -3.0, 1e16, 2.0**53], n))
    return [ids, *(values * 2)[: len(files.STORED) - 1]]


def test_lines_and_numbers_in_bulk_are_those_one_by_one(monkeypatch):
    columns = [pa.array([None if k == 7 * j else v for k, v in enumerate(c.tolist())], pa.float64()) for j, c in enumerate(hard_values())]
    rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
    lines = files._line(*columns)
    assert lines.to_pylist() == [";".join(" " * 12 + "NULL" if v is None else form % v for form, v in zip(files.LINE, row, strict=True)) + ";" for row in rows]
    rng = random.Random(2)
    damaged = [v[:k] + rng.choice("0123456789 .;+-Eé/:") + v[k + 1 :] for v in lines.to_pylist() for k in [rng.randrange(len(v))]]
    for text in (lines, lines.slice(3, 90), pa.array([*damaged, None, "", "x"]), pa.array([], pa.string())):
        one_by_one = files._plain_numbers(text)
        sound = np.isfinite(one_by_one).all(axis=1)
        assert files._numbers(text).to_pylist() == [row if fine else None for row, fine in zip(one_by_one.tolist(), sound.tolist(), strict=True)]
    reached = []
    whole = files._plain_numbers
    monkeypatch.setattr(files, "_plain_numbers", lambda text: reached.append(len(text)) or whole(text))
    simple = files._line(*(pa.array(np.arange(500) / (1 if j == 0 else 7)) for j in range(len(files.STORED))))
    assert files._numbers(simple).null_count == 0 and not reached


def test_statistics_of_a_batch_do_not_multiply_its_rows(spark):
    rows = spark.range(60).selectExpr("if(id % 9 = 8, null, int(id % 2)) load_step", *(f"if(id % {k + 3} = 0, null, double(id * {k} % 11)) {c}" for k, c in enumerate(ingest.COMPONENTS)), "double(null) nothing").withColumn("uz", F.col("nothing")).drop("nothing")
    found = ingest.partial_stats(rows)
    made = plan(found)
    assert made.index("Generate explode") < made.index("HashAggregate")
    held, want = [r.asDict() for r in rows.collect()], {}
    for r in held:
        for c in ingest.COMPONENTS:
            values = want.setdefault((r["load_step"], c), [])
            values += [] if r[c] is None else [r[c]]
    want = {key: (len(v), sum(v) if v else None, min(v, default=None), max(v, default=None)) for key, v in want.items()}
    assert {(r.load_step, r.component): (r.n, r.total, r.low, r.high) for r in found.collect()} == want
    assert found.schema.simpleString() == "struct<load_step:int,component:string,n:bigint,total:double,low:double,high:double>"


def test_the_store_keeps_no_values_that_follow_from_others(spark, monkeypatch):
    written = []
    whole = queries_sources.materialise
    monkeypatch.setattr(queries_sources, "materialise", lambda df, name: written.append(len(df.columns)) or whole(df, name))
    assert entry.queries()["result_store_append"](spark, SF).count() == 2
    assert written == [9]
