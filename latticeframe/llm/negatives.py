"""Hard negatives by exact inner products in a residue number system.

Components are whole numbers. Their residues modulo several small primes are multiplied as float32 matrices, which is
exact as long as no sum passes 2^24; longer vectors are multiplied a stretch of dimensions at a time, with a reduction
after each. The scores modulo the primes are joined by Chinese remaindering to exact signed scores. The primes are as
many as the longest vectors ask for: no score is larger than the product of two lengths.

Anchors are multiplied with all rows, a block of anchors of bounded size at a time: a block is broadcast, every task
multiplies it with the rows that it reads, and keeps for each anchor only what may still win. A first pass finds the
anchors' best rows of the same label, the positives; they set the windows of scores in which a second pass finds the
best rows of other labels. Tasks' winners are joined by anchor; there are a few for each task.

Rows with a null id or label, or a vector that is null or holds a null or a component that is not finite, take no part.
Shorter vectors count as filled up with zeros. Higher scores come first, ties by the smaller id. An anchor takes no row of
its own id. Of anchors that share an id the one of smallest label and vector counts; other repeated rows count
as often as they stand. Scores that may reach 2^48 are an error. Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticeframe.plans.lineage import materialise

#: Bytes of a block's anchors, rows and anchors that are multiplied at a time, and sums that float32 holds exactly.
BLOCK_BYTES, ROWS, ANCHORS, EXACT = 16 << 20, 4096, 512, 1 << 24
#: Dimensions that are multiplied before a reduction, where there are so many.
STRETCH = 64


def primes_for(bound: int, dims: int) -> list[int]:
    """The largest primes whose residues can be multiplied exactly, as many as tell whole numbers of -bound to bound apart."""
    most = 2 * math.isqrt(EXACT // max(1, min(dims, STRETCH))) + 1
    found, product = [], 1
    candidate = most
    while product <= 2 * bound or not found:
        if candidate > 1 and all(candidate % k for k in range(2, math.isqrt(candidate) + 1)):
            found.append(candidate)
            product *= candidate
        candidate -= 1
    return found


def residues(vectors: np.ndarray, prime: int) -> np.ndarray:
    """Signed residues of whole numbers as float32."""
    r = np.fmod(vectors, prime)
    half = prime // 2
    return np.where(r > half, r - prime, np.where(r < -half, r + prime, r)).astype(np.float32)


class Residues:
    """The matrices of some vectors modulo every prime."""

    def __init__(self, vectors: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [residues(vectors, p) for p in primes]

    def scores(self, other: Residues, a: slice, b: slice) -> np.ndarray:
        """Exact inner products of rows a with the other's rows b as whole numbers."""
        value, product = None, 1
        for p, mine, yours in zip(self.primes, self.parts, other.parts, strict=True):
            left, right = mine[a], yours[b]
            total = left[:, :STRETCH] @ right[:, :STRETCH].T
            for at in range(STRETCH, left.shape[1], STRETCH):
                total = np.fmod(total, p) + np.fmod(left[:, at : at + STRETCH] @ right[:, at : at + STRETCH].T, p)
            digit = total.astype(np.int64) % p
            if value is None:
                value = digit
            else:  # the next mixed-radix digit: what is missing to the residue, over the primes so far
                digit -= value % p
                digit *= pow(product, -1, p)
                digit %= p
                value += digit * product
            product *= p
        value[value > product // 2] -= product
        return value


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, label, vector): the rows that take part, components as the whole numbers floor(scale * x)."""
    vector = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    sound = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    named = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
    return named.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as the rows of a matrix, filled up with zeros."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims) < ends[:, None]] = flat
    return out


class Best:
    """For each of some slots the first `most` (score, id) seen: higher scores first, then smaller ids."""

    def __init__(self, slots: int, most: int):
        self.score = np.full((slots, most), -(1 << 62))
        self.id = np.full((slots, most), np.iinfo(np.int64).max)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Rows with `ids` come with a row of scores for every slot of `at`; those not allowed stay out."""
        last, last_id = self.score[at, -1][:, None], self.id[at, -1][:, None]
        allowed = allowed & (scores >= last)
        slot, row = np.nonzero(allowed)
        value = scores[slot, row]
        wins = (value > last[slot, 0]) | (ids[row] < last_id[slot, 0])
        slot, row, value = slot[wins], row[wins], value[wins]
        if not len(slot):
            return
        order = np.lexsort((ids[row], -value, slot))
        slot, row, value = slot[order], row[order], value[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = rank < self.score.shape[1]
        slot, row, value = slot[first], row[first], value[first]
        for s, begin, end in zip(*_runs(slot), strict=True):
            both = np.r_[self.score[at[s]], value[begin:end]], np.r_[self.id[at[s]], ids[row[begin:end]]]
            keep = np.lexsort((both[1], -both[0]))[: self.score.shape[1]]
            self.score[at[s]], self.id[at[s]] = both[0][keep], both[1][keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of all that were kept."""
        slot, place = np.nonzero(self.id != np.iinfo(np.int64).max)
        return slot, self.score[slot, place], self.id[slot, place]


def _runs(sorted_keys: np.ndarray) -> tuple[list, list, list]:
    edge = np.flatnonzero(np.r_[True, np.diff(sorted_keys) != 0, True])
    return sorted_keys[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()


Block = dict  # id, label: arrays; vectors: matrix; and for the second pass low, high: an entry for each anchor and positive


def _search(rows: DataFrame, block: Block, primes: list[int], dims: int, most: int, windows: bool) -> DataFrame:
    """(anchor, slot, score, id): what each task finds best for the block's anchors."""
    send = rows.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = send.value
        n = len(held["id"])
        slots = held["low"].shape[1] if windows else 1
        anchors, best = Residues(held["vectors"], primes), [Best(n, most) for _ in range(slots)]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, labels = (part.column(c).to_numpy() for c in ("id", "label"))
                mine = Residues(matrix(part.column("vector"), dims), primes)
                for a in range(0, n, ANCHORS):
                    at = np.arange(a, min(n, a + ANCHORS))
                    scores = anchors.scores(mine, slice(a, a + ANCHORS), slice(None))
                    same = held["label"][at][:, None] == labels
                    if not windows:
                        best[0].offer(at, scores, ids, same & (held["id"][at][:, None] != ids))
                        continue
                    for k in range(slots):
                        inside = ~same & (scores <= held["high"][at, k][:, None]) & (scores >= held["low"][at, k][:, None])
                        best[k].offer(at, scores, ids, inside)
        for k, b in enumerate(best):
            slot, score, found = b.rows()
            columns = [held["id"][slot], np.full(len(slot), k), score, found]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["anchor", "slot", "score", "other"])

    return rows.mapInArrow(work, "anchor long, slot long, score long, other long")


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first `most` of each anchor and slot over all tasks, with their rank from 1."""
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("other"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _blocks(anchors: DataFrame, dims: int) -> Iterator[Block]:
    """The anchors in blocks of BLOCK_BYTES, in the order of their ids; one block is in memory at a time."""
    size = max(1, BLOCK_BYTES // (8 * max(1, dims)))
    after = None
    while True:
        left = anchors if after is None else anchors.where(F.col("id") > after)
        some = left.orderBy("id").limit(size).toArrow()
        if not some.num_rows:
            return
        ids = some.column("id").to_numpy()
        yield {"id": ids, "label": some.column("label").to_numpy(), "vectors": matrix(some.column("vector").combine_chunks(), dims)}
        after = int(ids[-1])


def windows_of(block: Block, positives: pa.Table, most: int, low: int, high: int) -> Block:
    """The block with, for each anchor and positive, the window low..high percent of the positive's score; empty where
    there is no positive."""
    anchor, rank, score = (positives.column(c).to_numpy() for c in ("anchor", "rank", "score"))
    at = np.searchsorted(block["id"], anchor), rank - 1
    least, largest = (np.full((len(block["id"]), most), v, np.int64) for v in (1, 0))
    least[at], largest[at] = -(-low * score // 100), high * score // 100
    return block | {"low": least, "high": largest}


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row for which
    is_anchor (over id) holds, and each of its first `positives` rows of the same label, the first `negatives` rows of
    other labels whose score is between low and high percent of the positive's."""
    own = usable(rows, id_col, label_col, vector_col, scale)
    squares = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    dims, longest = own.agg(F.max(F.size("vector")), F.max(squares)).first()
    dims, bound = dims or 0, math.ceil((longest or 0.0) * (1 + 1e-9))
    if bound >= 1 << 48:
        raise ValueError(f"inner products of up to {bound} are too large to be exact in 64 bits")
    primes = primes_for(bound, dims)
    anchors = own.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.*")
    anchors = materialise(anchors, "anchors")
    found = []
    for block in _blocks(anchors, dims):
        best = _first(materialise(_search(own, block, primes, dims, positives, False), "positives"), positives)
        wide = windows_of(block, best.select("anchor", "rank", "score").toArrow(), positives, low, high)
        picked = materialise(_first(_search(own, wide, primes, dims, negatives, True), negatives), "negatives")
        named = best.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        found.append(picked.join(materialise(named, "named"), ["anchor", "slot"]))
    if not found:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
