"""Invariants, hand-built lattices and brute force for the lattice operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from latticeframe.operators import generate, growth, mesh
from latticeframe.operators import lattice as L
from latticeframe.operators.components import connected_components

VOXELS = "set_id long, x long, y long, z long, grain long"


def cube(n, grain):
    return [(1, x, y, z, grain(x, y, z)) for x, y, z in itertools.product(range(n), repeat=3)]


@pytest.fixture(scope="module")
def porous():
    rng = random.Random(3)
    return cube(5, lambda x, y, z: rng.choice([0, 1, 1, 2, 3]))


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, VOXELS).repartition(parts)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_one_grain(spark, n):
    v = table(spark, cube(n, lambda *_: 1))
    g = L.grain_properties(v).first()
    assert (g.volume, g.norm_volume, g.surface_area) == (n**3, 1.0, 6 * n * n)
    assert L.exposed_faces(v).count() == 6 * n * n
    assert L.surface_voxels(v).count() == n**3 - max(0, n - 2) ** 3
    assert mesh.mesh8(v)[0].count() == (n + 1) ** 3
    assert mesh.mesh20(v)[0].count() == 4 * n**3 + 9 * n**2 + 6 * n + 1
    assert L.fill_fraction(v).first().fill_fraction == 1.0


def test_checkerboard(spark):
    v = table(spark, cube(4, lambda x, y, z: 1 + (x + y + z) % 2))
    assert {(r.volume, r.surface_area) for r in L.grain_properties(v).collect()} == {(32, 192)}
    assert L.slice_grains(v, 4).agg(F.min("area"), F.max("area"), F.count("*")).first()[:] == (1, 1, 64)


def test_slices_by_hand(spark):
    u = ["10001", "10001", "10001", "10001", "11111"]
    rows = [(1, x, y, 0, int(u[y][x])) for x in range(5) for y in range(5)] + [(1, x, y, 1, int(u[y][x]) if y < 2 else 0) for x in range(5) for y in range(5)]
    rows += [(1, x, 0, 2, 7 if x < 2 else 0) for x in range(5)]
    found = L.slice_grains(table(spark, rows), 5).collect()
    assert sorted((r.z, r.component, r.area) for r in found) == [(0, 0, 13), (1, 0, 2), (1, 4, 2), (2, 0, 2)]
    pair = next(r for r in found if r.z == 2)
    assert pair.perimeter == 2 and pair.shape_factor_compat is None
    last = L.slice_last_component(L.slice_grains(table(spark, rows), 5))
    assert sorted((r.z, r.component) for r in last.collect()) == [(0, 0), (1, 4), (2, 0)]


def flood(cells, near):
    label = {}
    for start in sorted(cells):
        if start in label:
            continue
        label[start], queue = start, [start]
        while queue:
            at = queue.pop()
            for o in near:
                to = tuple(a + b for a, b in zip(at, o, strict=True))
                if to in cells and cells[to] == cells[at] and to not in label:
                    label[to] = start
                    queue.append(to)
    return label


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_slice_components_by_flood(spark, porous, parts):
    cells = {(z, y, x): g for _, x, y, z, g in porous if g}
    plain = flood(cells, [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0)])
    edges = {at: any(cells.get((at[0], at[1] + a, at[2] + b)) != cells[at] for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))) for at in cells}
    for tile in (512, 3, 2):  # one tile for a slice, or many
        found = {(r.z, r.y, r.x): (r.lbl, r.edge) for r in L.slice_cells(table(spark, porous, parts), 6, tile).collect()}
        assert found == {at: (s[1] * 1000 + s[2], edges[at]) for at, s in plain.items()}
    areas = L.slice_grains(table(spark, porous, parts), 5).groupBy("grain").agg(F.sum("area")).collect()
    assert sorted(map(tuple, areas)) == sorted((r.grain, r.volume) for r in L.grain_volume(table(spark, porous)).collect())


@pytest.mark.parametrize("brick", [2, 3, 32])
def test_neighbours_across_bricks(spark, porous, brick):
    cells = {(x, y, z): g for _, x, y, z, g in porous if (x + 2 * y + z) % 5}
    rows = spark.createDataFrame([(1, *at, g) for at, g in cells.items()], "set_id long, x long, y long, z long, grain long")
    found = {(r.x, r.y, r.z): r.sides for r in L.with_neighbours(rows, brick).collect()}
    assert found == {at: [cells.get(tuple(a + b for a, b in zip(at, o, strict=True))) for o in L.SIDES] for at in cells}


def test_slices_beyond_the_edge_are_an_error(spark):
    far = spark.createDataFrame([(1, 1500, 0, 0, 1)], "set_id long, x long, y long, z long, grain long")
    with pytest.raises(Exception, match="beyond the lattice's edge"):
        L.slice_components(far, 5).collect()
    assert L.slice_components(far, 1501).first().lbl == 1500


def test_surface_equals_faces(spark, porous):
    v = table(spark, porous)
    faces = dict(map(tuple, L.exposed_faces(v).groupBy("grain").count().collect()))
    assert {r.grain: r.surface_area for r in L.grain_surface(v).collect()} == faces
    holes = v.where("(x + 2 * y + z) % 4 <> 0")  # rows that are missing count as outside
    assert {r.grain: r.surface_area for r in L.grain_surface(holes).collect()} == dict(map(tuple, L.exposed_faces(holes).groupBy("grain").count().collect()))


def nearest(n, seeds, kind, periodic=False):
    plain = {}
    for at in itertools.product(range(n), repeat=3):
        best = None
        for g, *s, t0 in seeds:
            d = [abs(a - b) for a, b in zip(at, s, strict=True)]
            if periodic:
                d = [min(v, n - v) for v in d]
            steps = {6: sum(d), 26: max(d), 18: max(max(d), -(-sum(d) // 2))}[kind]
            best = min(best or (10**6, 0), (t0 + steps, g))
        plain[at] = best
    return plain


SEEDS = "grain long, sx long, sy long, sz long, t0 long"


@pytest.mark.parametrize("kind", [6, 18, 26])
@pytest.mark.parametrize("periodic", [False, True])
@pytest.mark.parametrize("edge", [32, 3, 2])
def test_nearest_seed_by_growth(spark, kind, periodic, edge):
    n, rng = 7, random.Random(kind)
    seeds = [(i * 10**12 + 1, rng.randrange(n), rng.randrange(n), rng.randrange(n), rng.randrange(-2, 3)) for i in range(5)]
    seeds += [(9, *seeds[0][1:]), (8, *seeds[1][1:4], 40)]  # places that repeat
    cells = L.lattice(spark, n).select("x", "y", F.lit("kept").alias("more"), "z")
    found = growth.labelled(cells.unionByName(cells.where("x = 1")), spark.createDataFrame(seeds, SEEDS).repartition(3), n, kind, periodic, edge)
    assert found.columns == ["x", "y", "more", "z", "grain", "d"] and found.count() == n**3 + n * n
    assert {(r.x, r.y, r.z): (r.d, r.grain) for r in found.collect()} == nearest(n, seeds, kind, periodic)


def test_growth_without_places(spark):
    cells = spark.createDataFrame([(1, 1, 1), (9, 0, 0), (None, 1, 1)], "x long, y long, z long")
    seeds = spark.createDataFrame([(5, 1, 1, 2, 0), (1, 9, 9, 9, 0), (None, 1, 1, 1, 0), (2, None, 1, 1, 0)], SEEDS)
    found = {(r.x, r.y): (r.grain, r.d) for r in L.nearest_seed_label(cells, seeds, 4).collect()}
    assert found == {(1, 1): (5, 1), (9, 0): (None, None), (None, 1): (None, None)}
    assert {r.grain for r in L.nearest_seed_label(cells, seeds.where("grain = 1"), 4).collect()} == {None}
    assert L.nearest_seed_label(cells.where("false"), seeds, 4).count() == 0


@pytest.mark.parametrize("kind", [6, 26])
def test_clustered_seeds_cost_what_the_lattice_does(spark, monkeypatch, kind):
    """Seeds in one corner: bricks are grown a few times each, however many the seeds are."""
    rng, runs, plain = random.Random(4), [], growth.materialise

    def counted(df, name):
        table = plain(df, name)
        runs.append(table.where("not told").count())
        return table

    monkeypatch.setattr(growth, "materialise", counted)
    for n in (12, 24):
        runs.clear()
        seeds = [(i + 1, rng.randrange(3), rng.randrange(3), rng.randrange(3), rng.randrange(4)) for i in range(200)]
        found = growth.labelled(L.lattice(spark, n).select("x", "y", "z"), spark.createDataFrame(seeds, SEEDS), n, kind, False, 4)
        assert {(r.x, r.y, r.z): (r.d, r.grain) for r in found.collect()} == nearest(n, [s for s in seeds if s[0] < 10**9], kind)
        assert sum(runs) <= 4 * (n // 4) ** 3


def test_clusters(spark):
    rng = random.Random(8)
    cells = {p: rng.randint(1, 30) for p in rng.sample(list(itertools.product(range(6), repeat=3)), 70)}
    rows = [(c, *p) for p, c in cells.items()]
    t = spark.createDataFrame(rows, "cluster long, x long, y long, z long")
    near = lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1
    plain = {(min(cells[p], cells[q]), max(cells[p], cells[q])) for p in cells for q in cells if near(p, q) and cells[p] != cells[q]}
    assert {tuple(r) for r in L.cluster_contacts(t, 6).collect()} == plain
    root = {c: c for c in cells.values()}
    for _ in range(40):
        for a, b in plain:
            root[a] = root[b] = min(root[a], root[b])
    assert {(r.x, r.y, r.z): r.merged for r in L.cluster_merge(t, 6).collect()} == {p: root[c] for p, c in cells.items()}
    points = [(i, rng.randrange(20), rng.randrange(20), rng.randrange(20)) for i in range(60)]
    pairs = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and all(abs(u // 4 - v // 4) <= 1 for u, v in zip(a[1:], b[1:], strict=True))}
    assert {tuple(r) for r in L.near_cell_pairs(spark.createDataFrame(points, "id long, x long, y long, z long"), 4).collect()} == pairs


def plain_fill(now):
    while True:
        new = dict(now)
        for at, g in now.items():
            if not g:
                for o in L.offsets(26):
                    other = now.get(tuple(a + b for a, b in zip(at, o, strict=True)), 0)
                    if other:
                        new[at] = other
                        break
        if new == now:
            return now
        now = new


@pytest.mark.parametrize(("brick", "rim"), [(32, 8), (4, 2), (3, 3), (2, 1)])
def test_void_fill(spark, porous, brick, rim):
    now = {(x, y, z): g for _, x, y, z, g in porous if (x + y * z) % 7}
    found = growth.voids_filled(table(spark, [(1, *at, g) for at, g in now.items()]), 5, brick, rim)
    assert {(r.x, r.y, r.z): r.grain for r in found.collect()} == plain_fill(now)
    empty = table(spark, cube(2, lambda *_: 0))
    assert L.void_fill(empty, 2).where("grain = 0").count() == 8
    assert L.void_fill(empty.where("false"), 2).count() == 0


def test_wide_voids_take_an_exchange_for_a_rim(spark, monkeypatch):
    """A void of radius 9 under a rim of 2: exchanges are rounds over the rim, and one that finds nothing more at most."""
    now = {(x, y, z): 0 if x < 10 else 1 + (y + z) % 3 for x in range(11) for y in range(4) for z in range(4)}
    runs, plain = [], growth.materialise
    monkeypatch.setattr(growth, "materialise", lambda df, name: runs.append(name) or plain(df, name))
    found = growth.voids_filled(table(spark, [(1, *at, g) for at, g in now.items()]), 11, 4, 2)
    assert {(r.x, r.y, r.z): r.grain for r in found.collect()} == plain_fill(now)
    assert len(runs) <= 6


def test_repeated_voids(spark):
    rows = [(1, 0, 0, 0, 0)] * 3 + [(1, 1, 0, 0, 4), (1, 1, 0, 0, 6), (1, 2, 0, 0, 0), (1, 2, 0, 0, 5), (1, 7, 0, 0, 9), (1, 6, 0, 0, 0)]
    found = sorted((r.x, r.grain) for r in L.void_fill(table(spark, rows), 7).collect())
    assert found == [(0, 6), (1, 4), (1, 6), (2, 5), (6, 0), (7, 9)]  # a cell beyond the lattice fills none


@pytest.mark.parametrize(("parts", "edge"), [(1, 32), (16, 2), (3, 3)])
def test_mesh_by_hand(spark, porous, parts, edge):
    nodes, elements = {}, []
    for x, y, z in sorted((x, y, z) for _, x, y, z, g in porous if g):
        ids = []
        for o in L.CORNERS:
            ids.append(nodes.setdefault((x + o[0], y + o[1], z + o[2]), len(nodes) + 1))
        elements.append(ids)
    n, e = mesh.mesh8(table(spark, porous, parts), edge)
    assert {(r.x, r.y, r.z): r.id for r in n.collect()} == nodes
    assert [list(r.nodes) for r in e.orderBy("element").collect()] == elements


@pytest.mark.parametrize("edge", [32, 2])
def test_mesh20_by_hand(spark, porous, edge):
    local, nodes, elements = mesh.CORNERS_2 + mesh.EDGES_2, {}, []
    for e, (x, y, z) in enumerate(sorted((x, y, z) for _, x, y, z, g in porous if g)):
        elements.append([nodes.setdefault((x + o[0] / 2, y + o[1] / 2, z + o[2] / 2), 20 * e + k + 1) for k, o in enumerate(local)])
    n, e = mesh.mesh20(table(spark, porous), edge)
    assert {(r.x, r.y, r.z): r.id for r in n.collect()} == nodes and n.count() == len(nodes)
    assert [list(r.nodes) for r in e.orderBy("element").collect()] == elements
    assert all(t.count() == 0 for t in (*mesh.mesh20(table(spark, porous).where("grain < 0")), *mesh.mesh8(table(spark, porous).where("grain < 0"))))


def test_repeated_cells_count_once(spark):
    v = table(spark, [(1, 0, 0, 0, 1), (1, 0, 0, 0, 1), (1, 1, 0, 0, 1), (1, 5, 0, 0, 2), (1, 5, 0, 0, 3)])
    found = {r.grain: (r.volume, r.surface_area) for r in L.grain_properties(v).collect()}
    assert found == {1: (2, 10), 3: (1, 6)}
    assert L.exposed_faces(v).count() == 16 and L.surface_voxels(v).count() == 3


@pytest.mark.parametrize("k", [0, 1, 7, 250, 499, 500, 900])
def test_smallest_rows_by_digits(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([5, 70_000, 70_001, rng.getrandbits(31)]), rng.choice([i, i + (1 << 40), 3])) for i in range(500)]
    found = generate.smallest(spark.createDataFrame(rows, "h long, i long").repartition(3), k)
    assert sorted((r.h, r.i) for r in found.collect()) == sorted(rows)[:k]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, x) for x in range(401, 460)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
