"""Queries over all cells against brute force on the smallest tables."""

import itertools
import math

import __spark_entry__ as entry
from latticeframe.plans import fixtures as X
from tests.test_lattice import flood

SF = "/root/testdata/sf0.001"


def filled(spark):
    return {(r.x, r.y, r.z): r.k for r in X.labelled(spark, SF).collect() if r.ck % 10}


def test_near_cells_of_all_filled_cells(spark):
    blocks = {}
    for at, k in filled(spark).items():
        blocks.setdefault(tuple(c // 3 for c in at), []).append(k)
    near = list(itertools.product((-1, 0, 1), repeat=3))
    plain = {(a, b) for at, ids in blocks.items() for o in near for a in ids for b in blocks.get(tuple(map(sum, zip(at, o, strict=True))), []) if a < b}
    rows = [tuple(r) for r in entry.queries()["near_cell_join_filled"](spark, SF).select("id_a", "id_b").collect()]
    assert len(rows) == len(plain) and set(rows) == plain


def test_merge_of_all_filled_cells(spark):
    cells = filled(spark)
    plain = flood(dict.fromkeys(cells, 1), [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)])
    found = {(r.x, r.y, r.z): r.merged for r in entry.queries()["cluster_merge_filled"](spark, SF).collect()}
    assert found == {at: cells[first] + 1 for at, first in plain.items()}


def test_displacements_under_every_load_case(spark):
    cells = [(r.x, r.y, r.z) for r in X.cells(spark, SF).collect()]
    loads = {r.load_step: r for r in X.load_cases(spark, SF).collect()}
    rows = {(r.load_step, r.x, r.y, r.z): r for r in entry.queries()["strain_displacement_all"](spark, SF).collect()}
    assert set(rows) == {(s, *at) for s in loads for at in cells}
    for (step, x, y, z), r in rows.items():
        e = loads[step]
        assert math.isclose(r.uy, (e.exy * x + e.eyy * y + e.eyz * z) * 1e4, abs_tol=1e-6)


def test_mean_of_all_event_values(spark):
    values = {}
    for r in X.table(spark, SF, "events").select("event_type", "value").collect():
        values.setdefault(r.event_type, []).append(r.value)
    found = dict(entry.queries()["safe_mean_events"](spark, SF).select("event_type", "mean").collect())
    plain = {k: [v for v in vs if v is not None] for k, vs in values.items()}
    assert set(found) == set(plain)
    assert all(math.isclose(found[k], sum(v) / len(v) if v else 0.0, abs_tol=1e-6) for k, v in plain.items())
