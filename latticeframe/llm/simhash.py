"""SimHash near-duplicates by the generalised pigeonhole principle.

Every text has a 64-bit fingerprint. Bits that vary together are grouped into m partitions, and thresholds
T1..Tm (each -1 or more) that sum to limit - m + 1 are given to them by dynamic programming over estimated probes and
candidates: two fingerprints within the limit must differ in at most Ti bits of some partition i. Each fingerprint
is entered under its own value of a partition and under those up to Ti bits away, by which it probes for the others' own; fingerprints that meet are compared in full. In a large
cell only links that join something new are written, n - 1 of n fingerprints at most, and a cell with more than
`block` fingerprints is dealt out as pairs of blocks.

Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node, so repeated rows
and rows without an id cost nothing; a component's id is its smallest id that is not null. Long texts are read a
megabyte at a time. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, rows_of, text_bytes, word_lists
from latticeframe.operators.components import connected_components
from latticeframe.plans.lineage import materialise

BITS, SEED, SHINGLE = 64, 42, 3
#: Cost of one entry under a key, in comparisons.
PROBE_COST = 400.0
#: Fingerprints up to which a cell is compared pair by pair, and rows of the cells that are taken at a time.
SMALL_CELL, CHUNK = 16, 1 << 17


def fingerprint(raw: bytes) -> int:
    """Majority of the shingles' 64-bit hashes, bit by bit, as an unsigned integer."""
    ones, n = np.zeros(BITS, np.int64), 0
    for words in word_lists(raw, SHINGLE):
        if not words:
            return 0
        text = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(SHINGLE, len(words))
        hashes = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
        for at in range(0, len(hashes), 4096):
            ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for doc, raw in rows_of(batches, "doc_id", "content"):
            out.add((doc, signed(fingerprint(raw))))
            if out.full():
                yield out.take()
        yield from out.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content")).mapInArrow(work, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits i and j, over all of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            fps = batch.column(0).to_numpy()
            x = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)
            n += len(fps)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], ["k", "n"])

    counts = nodes.select("fp").mapInArrow(work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    held = np.zeros(BITS * BITS + 1, np.int64)
    for k, n in counts.collect():  # 4,097 rows for any input
        held[k] = n
    return int(held[-1]), held[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each starts with the free bit that varies most with other free ones and takes those that vary most with it."""
    p = both / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    related = np.abs(p - np.outer(one, one)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, groups))) // (m - i)
        pool = sorted(free)
        group = [max(pool, key=lambda b: (related[b, pool].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in pool if b not in group), key=lambda b: (related[b, group].mean(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, limit: int, block: int = 8192, meet: float = 1.0) -> tuple[float, list[tuple[list[int], int]]]:
    """The cheapest partitions and thresholds over numbers of partitions: (cost, [(bits, threshold)]); -1 leaves a partition
    out. A few fingerprints are costed as a thousand, for which probes of many bits do not pay either. meet: share of all
    pairs that could meet by their sizes."""
    n, both = (n, both) if n >= 1000 else (1000, np.full((BITS, BITS), 250) + np.diag(np.full(BITS, 250)))
    one = np.diag(both) / max(n, 1)
    differ = 2 * one * (1 - one)
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, limit + 2):
        groups = group_bits(n, both, m)
        costs = []
        for bits in groups:
            near = np.zeros(limit + 2)  # chance that so many of the group's bits differ in a random pair
            near[0] = 1
            for b in bits:
                near[1:] = near[1:] * (1 - differ[b]) + near[:-1] * differ[b]
                near[0] *= 1 - differ[b]
            cost = [0.0]
            for t in range(limit + 1):
                probes = sum(math.comb(len(bits), k) for k in range(t + 1))
                met = meet * near[: t + 1].sum()
                copies = max(1.0, n * met / block)  # entries of a cell that is dealt out by blocks
                cost.append(n * probes * PROBE_COST * copies + n * (n - 1) / 2 * met)
            costs.append(cost)
        table = {0: (0.0, [])}
        for cost in costs:
            table = {s: min((table[s - t][0] + cost[t + 1], [*table[s - t][1], t]) for t in range(-1, limit + 1) if s - t in table) for s in {a + t for a in table for t in range(-1, limit + 1)}}
        if (found := table.get(limit - m + 1)) and found[0] < best[0]:
            best = found[0], list(zip(groups, found[1], strict=True))
    return best


def _entered(part: int, own: Column, flips: list[int]) -> Column:
    steps = F.lit([signed(f) for f in flips]).cast("array<bigint>")
    return F.transform(steps, lambda f: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(f).alias("value"), (f == 0).alias("own")))


def keys(partitions: list[tuple[list[int], int]]) -> Column:
    """All (partition, value, own) under which a fingerprint is entered: its own value, and those that probe for others."""
    entries = []
    for i, (bits, threshold) in enumerate(partitions):
        if threshold < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        flips = [0]
        for _ in range(threshold):
            flips = sorted({f ^ (1 << b) for f in flips for b in bits} | set(flips))
        entries.append(_entered(i, own, flips))
    return F.flatten(F.array(*entries))


class Nearness:
    """Which fingerprints of a cell link: at most `limit` differing bits, and as many of a second fingerprint, and sizes
    whose ratio is `ratio` at least."""

    def __init__(self, limit: int, limit2: int, ratio: float):
        self.limit, self.limit2, self.ratio = limit, limit2, ratio

    def among(self, at: int, others: np.ndarray, fp: np.ndarray, fp2: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Those of the rows `others` that link with the row `at`."""
        found = others[np.bitwise_count(fp[others] ^ fp[at]) <= self.limit]
        return found[self._rest(at, found, fp2, size)] if len(found) else found

    def pairs(self, a: np.ndarray, b: np.ndarray, fp: np.ndarray, fp2: np.ndarray, size: np.ndarray) -> np.ndarray:
        near = np.bitwise_count(fp[a] ^ fp[b]) <= self.limit
        near[near] = self._rest(a[near], b[near], fp2, size)
        return near

    def _rest(self, a, b, fp2: np.ndarray, size: np.ndarray) -> np.ndarray:
        alike = np.minimum(size[a], size[b]) >= self.ratio * np.maximum(size[a], size[b]) - 1e-9
        return alike & (np.bitwise_count(fp2[a] ^ fp2[b]) <= self.limit2)


def links_in_cell(rows: np.ndarray, own: np.ndarray, near: Nearness, *values: np.ndarray) -> list[tuple[int, int]]:
    """Links that span each connected part of a cell, from each row reached on to those not yet reached. A row that only
    probes links to rows that have the cell's value."""
    links = []
    free_own, free_probe = rows[own[rows]], rows[~own[rows]]
    while len(free_own):
        queue, free_own = [int(free_own[0])], free_own[1:]
        while queue and (len(free_own) or len(free_probe)):
            at = queue.pop()
            reached = near.among(at, free_own, *values)
            if len(reached):
                free_own = np.setdiff1d(free_own, reached, assume_unique=True)
            if own[at]:
                probes = near.among(at, free_probe, *values)
                if len(probes):
                    free_probe = np.setdiff1d(free_probe, probes, assume_unique=True)
                    reached = np.concatenate([reached, probes])
            links += [(at, x) for x in reached.tolist()]
            queue += reached.tolist()
    return links


def cell_links(cell: np.ndarray, own: np.ndarray, near: Nearness, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places of the links of all cells; rows of a cell stand together. Small cells are compared pair by pair."""
    edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    sizes = np.diff(edge)
    some = np.logical_or.reduceat(own, edge[:-1])
    left, right = [], []
    alive = np.flatnonzero(np.repeat(some & (sizes > 1) & (sizes <= SMALL_CELL), sizes))
    for d in range(1, SMALL_CELL):
        alive = alive[alive + d < len(cell)]
        alive = alive[cell[alive] == cell[alive + d]]
        if not len(alive):
            break
        a = alive[own[alive] | own[alive + d]]
        a = a[near.pairs(a, a + d, *values)]
        left.append(a)
        right.append(a + d)
    for k in np.flatnonzero(some & (sizes > SMALL_CELL)).tolist():
        found = links_in_cell(np.arange(edge[k], edge[k + 1]), own, near, *values)
        if found:
            a, b = np.array(found, np.int64).T
            left.append(a)
            right.append(b)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def near_links(nodes: DataFrame, limit: int, block: int = 8192, limit2: int = BITS, ratio: float = 0.0) -> DataFrame:
    """(u, v) links of nodes that connect exactly what pairs within the limits connect. nodes: (node, fp), node not null,
    and where limit2 or ratio are given also fp2, a second fingerprint, and n, a size."""
    n, both = bit_counts(nodes)
    more = [F.col(c) if c in nodes.columns else F.lit(0).cast("long").alias(c) for c in ("fp2", "n")]
    nodes, meet = nodes.select("node", "fp", *more), 1.0
    if ratio:  # sizes of that ratio are of one class or of two next to each other: a node is entered in its own and probes the next
        nodes = nodes.withColumn("size", F.floor(F.log(F.col("n") + 1.0) / F.lit(-math.log(ratio))).cast("int"))
        counts = dict(nodes.groupBy("size").count().collect())  # a row for each class of sizes
        meet = sum(c * (c + counts.get(k + 1, 0)) for k, c in counts.items()) / max(1, n) ** 2
    partitions = allocate(n, both, limit, block, meet)[1]
    entered = nodes.withColumn("k", F.explode(keys(partitions)))
    if ratio:
        entered = entered.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
        entered = entered.select("node", "fp", "fp2", "n", F.xxhash64("k.part", F.col("size") + F.col("up")).alias("part"), "k.value", (F.col("k.own") & (F.col("up") == 0)).alias("own"))
    else:
        entered = entered.select("node", "fp", "fp2", "n", F.col("k.part").cast("long").alias("part"), "k.value", "k.own")
    large = materialise(entered.groupBy("part", "value").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block), "large-cells")
    blocks = F.coalesce(F.ceil(F.col("rows") / block), F.lit(1)).cast("int")
    dealt = entered.join(large, ["part", "value"], "left").withColumn("blocks", blocks).withColumn("of", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("node", "fp", "fp2", "n", "own", F.xxhash64("part", "value", F.least("of", "other"), F.greatest("of", "other")).alias("cell"))
    names, near = ("cell", "node", "fp", "fp2", "n", "own"), Nearness(limit, limit2, ratio)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def close(columns: list[np.ndarray]) -> pa.RecordBatch:
            cell, node, fp, fp2, size, own = columns
            a, b = cell_links(cell, own, near, fp.view(np.uint64), fp2.view(np.uint64), size)
            pairs = np.unique(np.stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            if sum(len(h[0]) for h in held) >= CHUNK:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.argmax(columns[0] == columns[0][-1]))  # the last cell may go on in the next batch
                if cut:
                    yield close([c[:cut] for c in columns])
                held = [[c[cut:] for c in columns]]
        if held:
            yield close([np.concatenate(c) for c in zip(*held, strict=True)])

    return cells.select(*names).repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): texts whose fingerprints differ in at most `limit` bits link; component_id is the
    smallest id reachable, null where no text reachable has an id."""
    own = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected_components(near_links(nodes.select("fp", F.col("fp").alias("node")), limit))
    parts = materialise(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part")), "parts")
    least = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    named = materialise(parts.join(least, "part").select("fp", "component_id"), "components")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")
