"""Growth over the lattice in bricks: nearest-seed labels and the filling of voids.

Both go in exchanges. Inside an exchange a task has one brick as a dense array and grows it as far as what it knows
reaches; between exchanges bricks tell each other what changed at their borders. So exchanges are counted in bricks
or rims, not in cells, and only bricks that learn something new take part.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeframe.operators import bricks
from latticeframe.plans.lineage import materialise

#: Edge of a brick, cells that a brick's rim has for the filling of voids; a later time than any.
EDGE, RIM, NEVER = 32, 8, np.int64(1) << 62
BRICK = ["bx", "by", "bz"]
AROUND = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def _near(values: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """For each place the least value among it and its neighbours along the axes, diagonals included."""
    for axis in axes:
        low, high = (tuple(slice(s, e) if a == axis else slice(None) for a in range(3)) for s, e in ((0, -1), (1, None)))
        out = values.copy()
        np.minimum(out[high], values[low], out=out[high])
        np.minimum(out[low], values[high], out=out[low])
        values = out
    return values


#: The axes along which a step of growth goes at once: one, two or all three.
STEPS = {6: [(0,), (1,), (2,)], 18: [(0, 1), (1, 2), (0, 2)], 26: [(0, 1, 2)]}


def grown(time: np.ndarray, grain: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrival times and grains once growth over 6, 18 or 26 neighbours has come to rest: earliest first, then smallest."""
    known = time < NEVER
    if not known.any():
        return time, grain
    names, rank = np.unique(grain[known], return_inverse=True)
    base, stride = time[known].min(), np.int64(len(names))
    key = np.full(time.shape, NEVER)
    key[known] = (time[known] - base) * stride + rank
    while True:
        least = key
        for axes in STEPS[kind]:
            least = np.minimum(least, _near(key, axes) + stride)
        if np.array_equal(least, key):
            break
        key = least
    reached = key < NEVER
    time, grain = np.full(key.shape, NEVER), np.zeros(key.shape, np.int64)
    time[reached], grain[reached] = key[reached] // stride + base, names[key[reached] % stride]
    return time, grain


def _state(rows: pa.Table, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Times and grains of a brick with a rim of one cell, from its state and what its neighbours and seeds tell."""
    time, grain = np.full(shape, NEVER), np.zeros(shape, np.int64)
    for place, times, grains in zip(*(rows.column(c).to_pylist() for c in ("place", "times", "grains")), strict=True):
        times, grains = np.frombuffer(times, "<i8"), np.frombuffer(grains, "<i8")
        at = np.frombuffer(place, "<i8") if place is not None else np.arange(time.size)
        at, times, grains = _earliest(at, times, grains)
        old, names = time.flat[at], grain.flat[at]
        better = (times < old) | (times == old) & (grains < names)
        time.flat[at[better]], grain.flat[at[better]] = times[better], grains[better]
    return time, grain


def _earliest(at: np.ndarray, times: np.ndarray, grains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each place: the earliest, then the one of the smallest grain."""
    order = np.lexsort((grains, times, at))
    at, times, grains = at[order], times[order], grains[order]
    first = np.r_[True, at[1:] != at[:-1]][: len(at)]
    return at[first], times[first], grains[first]


class Bricks:
    """A lattice of edge n cut along each axis into bricks of nearly equal edges, `edge` at most."""

    def __init__(self, n: int, edge: int, periodic: bool):
        self.n, self.count, self.periodic = n, -(-n // edge), periodic

    def start(self, k: int) -> int:
        return k * self.n // self.count

    def size(self, at: list[int]) -> tuple[int, ...]:
        return tuple(self.start(k + 1) - self.start(k) for k in at)

    def home(self, place):
        """The brick of a place, for columns and arrays alike."""
        last = (place + 1) * self.count - 1
        return F.floor(last / self.n).cast("long") if isinstance(last, Column) else last // self.n

    def beside(self, at: list[int], o: tuple[int, ...]) -> list[int] | None:
        to = [k + d for k, d in zip(at, o, strict=True)]
        if self.periodic:
            return [k % self.count for k in to]
        return to if all(0 <= k < self.count for k in to) else None

    def rim(self, at: list[int], to: list[int], o: tuple[int, ...]) -> tuple[tuple[slice, ...], np.ndarray]:
        """A brick's border towards a neighbour, and the places of that in the neighbour's array with its rim."""
        own, other = self.size(at), self.size(to)
        mine = tuple({-1: slice(1, 2), 0: slice(1, s + 1), 1: slice(s, s + 1)}[d] for d, s in zip(o, own, strict=True))
        theirs = [{-1: np.array([s + 1]), 0: np.arange(1, s + 1), 1: np.array([0])}[d] for d, s in zip(o, other, strict=True)]
        return mine, np.ravel_multi_index(np.meshgrid(*theirs, indexing="ij"), tuple(s + 2 for s in other))


STATE = "bx long, by long, bz long, told boolean, place binary, times binary, grains binary"
KINDS = pa.schema([*((c, pa.int64()) for c in BRICK), ("told", pa.bool_()), *((c, pa.binary()) for c in ("place", "times", "grains"))])


def _packed(*values: np.ndarray) -> list[bytes]:
    return [v.astype("<i8").tobytes() for v in values]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(KINDS)], schema=KINDS)


def _grow_brick(rows: pa.Table, lattice: Bricks, kind: int) -> pa.Table:
    """The brick's new state, and for each neighbour the border cells that are better than before; nothing where what
    the brick was told is no news."""
    at = [rows.column(c)[0].as_py() for c in BRICK]
    shape = tuple(s + 2 for s in lattice.size(at))
    before, after = _state(rows.filter(pc.invert(rows.column("told"))), shape), _state(rows, shape)
    if all(map(np.array_equal, before, after)):
        return _table([])
    time, grain = grown(*after, kind)
    better = (time < before[0]) | (time == before[0]) & (grain < before[1])
    out: list[tuple] = [(*at, False, None, *_packed(time, grain))]
    for o in AROUND:
        if (to := lattice.beside(at, o)) is not None:
            mine, theirs = lattice.rim(at, to, o)
            if (news := better[mine]).any():
                out.append((*to, True, *_packed(theirs[news], time[mine][news], grain[mine][news])))
    return _table(out)


def _seeded(seeds: DataFrame, lattice: Bricks) -> DataFrame:
    """Seeds as what bricks are told, packed by brick: a row or several for each."""
    placed = seeds.select("grain", "t0", *(F.col(f"s{c}").alias(c) for c in "xyz"), *(lattice.home(F.col(f"s{c}")).alias(f"b{c}") for c in "xyz"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.stack([batch.column(c).to_numpy() for c in BRICK], axis=1)
            edges = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]).any(axis=1), True]) if len(home) else np.zeros(1, int)
            rows = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                some, at = batch.slice(a, b - a), home[a].tolist()
                xyz = tuple(some.column(c).to_numpy() - lattice.start(k) + 1 for c, k in zip("xyz", at, strict=True))
                place = np.ravel_multi_index(xyz, tuple(s + 2 for s in lattice.size(at)))
                rows.append((*at, True, *_packed(*_earliest(place, some.column("t0").to_numpy(), some.column("grain").to_numpy()))))
            yield from _table(rows).to_batches()

    return placed.sort(*BRICK).mapInArrow(work, STATE)


def _last(states: list[DataFrame]) -> DataFrame:
    """For each brick the state that was written last."""
    every = [s.withColumn("round", F.lit(i)) for i, s in enumerate(states)]
    held = functools.reduce(DataFrame.unionByName, every).groupBy(*BRICK)
    return held.agg(F.max_by(F.struct("told", "place", "times", "grains"), "round").alias("s")).select(*BRICK, "s.*")


def arrivals(seeds: DataFrame, lattice: Bricks, kind: int) -> DataFrame | None:
    """Packed times and grains of every brick once growth from the seeds (grain, sx, sy, sz, t0) has come to rest: for each
    cell when it is first reached, and by which seed, ties to the smallest grain. No seeds, no table.

    A brick grows from its seeds and from what its neighbours tell of their borders, and tells its own border where that
    came to be better. A path through k bricks takes k exchanges, each with the bricks that were told something."""
    news, states = materialise(_seeded(seeds, lattice), "growth"), []
    while not news.isEmpty():
        rows = news
        if states:
            touched = news.select(BRICK).distinct()
            rows = rows.unionByName(_last([s.join(touched, BRICK, "left_semi") for s in states]))
        made = materialise(rows.groupBy(*BRICK).applyInArrow(lambda t: _grow_brick(t, lattice, kind), STATE), "growth")
        states.append(made.where("not told"))
        news = made.where("told")
    return _last(states) if states else None


def labelled(cells: DataFrame, seeds: DataFrame, n: int, kind: int, periodic: bool = False, edge: int = EDGE) -> DataFrame:
    """The cells (x, y, z, ...) with the grain that reaches them first and its arrival time d, both null outside the lattice
    of edge n and where there are no seeds. Seeds outside the lattice or without a place do not grow."""
    lattice = Bricks(n, edge, periodic)
    inside = " and ".join(f"s{c} between 0 and {n - 1}" for c in "xyz")
    seeds = seeds.where(inside).where("grain is not null and t0 is not null")
    found = arrivals(seeds.select(*(F.col(c).cast("long").alias(c) for c in ("grain", "sx", "sy", "sz", "t0"))), lattice, kind)
    if found is None:
        return cells.select("*", *(F.lit(None).cast("long").alias(c) for c in ("grain", "d")))
    names, keys = cells.columns, [f"brick_{c}" for c in "xyz"]
    dealt = cells.select("*", *(lattice.home(F.col(c)).alias(k) for c, k in zip("xyz", keys, strict=True)))
    packed = found.select(*(F.col(b).alias(k) for b, k in zip(BRICK, keys, strict=True)), "times", "grains")

    def look_up(own: pa.Table, state: pa.Table) -> pa.Table:
        at = [own.column(k)[0].as_py() for k in keys] if len(own) else [None]
        values = [np.zeros(len(own), np.int64)] * 2
        known = np.zeros(len(own), bool)
        if None not in at and len(state):
            size = lattice.size(at)
            place = [own.column(c).to_numpy() - lattice.start(k) for c, k in zip("xyz", at, strict=True)]
            held = [np.frombuffer(state.column(c)[0].as_py(), "<i8").reshape([s + 2 for s in size]) for c in ("grains", "times")]
            values = [h[tuple(p + 1 for p in place)] for h in held]
            known = values[1] < NEVER
        columns = [pa.array(v, pa.int64(), mask=~known) for v in values]
        return pa.table([*(own.column(c) for c in names), *columns], names=[*names, "grain", "d"])

    schema = T.StructType([*cells.schema.fields, T.StructField("grain", T.LongType()), T.StructField("d", T.LongType())])
    return dealt.groupBy(*keys).cogroup(packed.groupBy(*keys)).applyInArrow(look_up, schema)


def _fill_brick(rows: pa.Table, n: int, brick: int, rim: int) -> pa.Table:
    """The brick's own open cells after `rim` rounds: filled or not, and whether the last round filled them."""
    first, wide = [f - 1 for f in bricks.corner(rows, brick, rim)], brick + 2 * rim + 2
    place = np.ravel_multi_index(bricks.places(rows, first), (wide,) * 3)
    given = bricks.column(rows, "grain").astype(np.int64)
    inside = np.all([(bricks.column(rows, c) >= 0) & (bricks.column(rows, c) < n) for c in "xyz"], axis=0)
    grain = np.zeros(wide**3, np.int64)
    np.maximum.at(grain, place[inside], given[inside])
    still = np.unique(place[given == 0])
    still = still[grain[still] == 0]
    own = np.intersect1d(np.unique(place[(given == 0) & bricks.column(rows, "own")]), still)
    steps = np.array([(x * wide + y) * wide + z for x, y, z in AROUND])
    last = np.zeros(0, np.int64)
    for _ in range(rim if len(own) else 0):
        near = grain[still[:, None] + steps]
        some = (near > 0).any(axis=1)
        if not some.any():
            last = still[:0]
            break
        last = still[some]
        grain[last] = near[some, (near[some] > 0).argmax(axis=1)]
        still = still[~some]
    xyz = [a + f for a, f in zip(np.unravel_index(own, (wide,) * 3), first, strict=True)]
    fixed = np.full(len(own), rows.column("set_id")[0].as_py(), np.int64)
    return pa.table([fixed, *(v.astype(np.int64) for v in xyz), grain[own], np.isin(own, last)], names=["set_id", "x", "y", "z", "grain", "last"])


def voids_filled(cells: DataFrame, n: int, brick: int = EDGE, rim: int = RIM) -> DataFrame:
    """Open cells (set_id, x, y, z, grain; grain 0) take the id of their first filled neighbour inside the lattice of edge n,
    in the order of the 26 offsets, round by round, until none can. Filled cells stay as they are; of open cells that
    repeat one is left, and none where a filled one is at the same place.

    A brick with a rim of `rim` cells knows enough for as many rounds, so there is one exchange for each of these. A cell
    with a filled neighbour is filled in the next round: after an exchange only what its last round filled can fill others,
    so exchanges carry those and the open cells, never the whole lattice."""
    schema = "set_id long, x long, y long, z long, grain long, last boolean"
    still, front, parts = cells.where("grain = 0"), cells.where("grain > 0"), [cells.where("grain > 0")]
    while True:
        dealt = bricks.dealt(still.unionByName(front), brick, rim)
        made = dealt.groupBy(*bricks.BRICK).applyInArrow(lambda rows: _fill_brick(rows, n, brick, rim), schema)
        made = materialise(made, "filled")
        some = made.select("set_id", "x", "y", "z", F.col("grain").cast(cells.schema["grain"].dataType).alias("grain"), "last")
        still, front = some.where("grain = 0").drop("last"), some.where("last").drop("last")
        parts.append(some.where("grain > 0").drop("last"))
        if front.isEmpty() or still.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, [*parts, still])
