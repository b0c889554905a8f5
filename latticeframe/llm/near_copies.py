"""Near copies: SimHash candidates verified by the Jaccard similarity of five-word shingles.

Texts are fingerprinted by their sets of shingles. simhash.near_links searches the fingerprints with a limit wide enough
for a Jaccard similarity of `share` (at 0.8 two fingerprints differ in about ten of 64 bits), screens what meets by a
second fingerprint and by size, and so gives families of texts that may be similar. Inside a family the sets themselves
are compared: links are those of exact similarity `share` or more, and a group is what links connect.

A family of some size is dealt out in blocks. First every block is searched together with the family's most copied text;
then the texts outside the largest group so found are compared, block by block, with each other and with that group.
Only links that join something new are written.

Shingles are split and lower-cased as in containment.py and compared by 64-bit hashes. Texts of equal sets are one node;
texts without words (null, empty) are copies of each other. Rows are told apart by all their columns, so repeated ids or
rows without one do no harm. One row of a group stays: of the smallest id, rows without an id last, ties by a hash of the
row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, bloom_filter, maybe_among, row_keys, rows_of, text_bytes, word_lists
from latticeframe.llm.containment import WORDS, shingle_hashes
from latticeframe.llm.simhash import near_links
from latticeframe.operators.components import connected_components
from latticeframe.plans.lineage import materialise

#: Differing bits up to which the two fingerprints make a candidate, and shingles of a block of a family.
LIMIT, LIMIT2, WEIGHT = 12, 18, 40_000
ODD = np.uint64(0x9E3779B97F4A7C15)
KEY = ["k1", "k2"]


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate([shingle_hashes(words) for words in word_lists(raw, WORDS)]))


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def set_fingerprint(shingles: np.ndarray, seed: int) -> int:
    """Majority of the hashes' bits over a set, as a signed integer; the seed picks one of independent fingerprints."""
    mixed = (shingles ^ np.uint64(seed)) * ODD
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(mixed), 4096):
        ones += np.unpackbits(mixed[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(mixed), bitorder="little").view("<i8")[0])


def describe(keyed: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, node, n, fp, fp2) of every row of (k1, k2, doc_id, content)."""
    names = ("k1", "k2", "doc_id")
    schema = pa.schema([(c, pa.int64()) for c in (*names, "node", "n", "fp", "fp2")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for *known, raw in rows_of(batches, *names, "content"):
            shingles = shingle_set(raw)
            out.add((*known, node_of(shingles), len(shingles), set_fingerprint(shingles, 1), set_fingerprint(shingles, 2)))
            if out.full():
                yield out.take()
        yield from out.rest()

    return keyed.mapInArrow(work, ", ".join(f"{c} long" for c in schema.names))


class Family:
    """Shingle sets of some texts as one array, for exact comparison of one with many."""

    def __init__(self, sets: list[np.ndarray], share: float):
        self.share, self.size = share, np.array([len(s) for s in sets])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
        self.kinds = int(self.flat.max()) + 1 if len(self.flat) else 0

    def similar(self, at: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have the share with text `at`."""
        sizes = self.size[others]
        able = np.minimum(sizes, self.size[at]) >= self.share * np.maximum(sizes, self.size[at]) - 1e-9
        out = np.zeros(len(others), bool)
        picked = others[able]
        if not len(picked):
            return out
        mark = np.zeros(self.kinds, np.int32)
        mark[self.flat[self.start[at] : self.start[at + 1]]] = 1
        size = self.size[picked]
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        both = np.add.reduceat(mark[self.flat[np.repeat(self.start[picked], size) + step]], first)
        out[able] = both * (1 + self.share) >= self.share * (self.size[at] + size) - 1e-9
        return out


def spanning(family: Family, first: int) -> list[tuple[int, int]]:
    """Links that connect what similar pairs of a family connect, starting from text `first`."""
    links, free = [], np.arange(len(family.size))
    at = first
    while len(free):
        queue, free = [at], free[free != at]
        while queue and len(free):
            a = queue.pop()
            near = family.similar(a, free)
            reached = free[near].tolist()
            links += [(a, b) for b in reached]
            queue += reached
            free = free[~near]
        at = int(free[0]) if len(free) else -1
    return links


def joining(family: Family, group: np.ndarray, active: np.ndarray) -> list[tuple[int, int]]:
    """Links between texts of different groups, one at most for each text and group it meets."""
    links, group = [], np.unique(group, return_inverse=True)[1]
    for a in active.tolist():
        others = np.flatnonzero(group != group[a])
        if not len(others):
            break
        near = others[family.similar(a, others)]
        if len(near):
            met, at = np.unique(group[near], return_index=True)
            links += [(a, int(b)) for b in near[at]]
            group[np.isin(group, met)] = group[a]
    return links


PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(nodes: list[int], links: list[tuple[int, int]]) -> pa.Table:
    out = [(max(nodes[a], nodes[b]), min(nodes[a], nodes[b])) for a, b in links]
    return pa.table([[u for u, _ in out], [v for _, v in out]], schema=PAIRS)


def _family(rows: pa.Table, share: float) -> tuple[list[int], Family]:
    return rows.column("node").to_pylist(), Family([np.frombuffer(s, "<u8") for s in rows.column("shingles").to_pylist()], share)


def block_links(sets: DataFrame, share: float) -> DataFrame:
    """Links inside every block of a family, its most copied text in each."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("node", "ascending")])
        nodes, family = _family(rows, share)
        return _links(nodes, spanning(family, rows.column("leader").to_pylist().index(True) if True in rows.column("leader").to_pylist() else 0))

    far = F.expr("filter(sequence(0, blocks - 1), b -> b <> block)")
    copies = sets.where("leader and blocks > 1").withColumn("block", F.explode(far)).select(sets.columns)
    rows = sets.unionByName(copies).select("node", "leader", "shingles", "family", "block")
    return rows.groupBy("family", "block").applyInArrow(work, "u long, v long")


def cross_links(sets: DataFrame, grouped: DataFrame, share: float, weight: int) -> DataFrame:
    """Links between the groups of families of several blocks; grouped: (node, family, n, grp) of their texts."""
    sizes = grouped.groupBy("family", "grp").agg(F.count(F.lit(1)).alias("texts"))
    main = sizes.groupBy("family").agg(F.max_by("grp", F.struct("texts", "grp")).alias("main"))
    sided = grouped.join(main, "family").withColumn("rest", F.col("grp") != F.col("main"))
    parts = lambda c: F.ceil(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) / weight).cast("int")
    counts = sided.groupBy("family").agg(parts(F.col("rest")).alias("rests"), parts(~F.col("rest")).alias("mains")).where("rests > 0")
    dealt = sided.join(counts, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    # a pair of blocks is (i, j) of the rest with i <= j, or (i, -1 - j) of the rest and the main group
    pairs = F.when(F.col("rest"), F.expr("concat(transform(sequence(0, rests - 1), i -> struct(least(i, own) as i, greatest(i, own) as j)), transform(sequence(0, mains - 1), j -> struct(own as i, -1 - j as j)))"))
    pairs = pairs.otherwise(F.expr("transform(sequence(0, rests - 1), i -> struct(i as i, -1 - own as j))"))
    rows = dealt.select("node", "family", "grp", "rest", F.explode(pairs).alias("p")).select("node", "family", "grp", "rest", "p.i", "p.j")

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("node", "ascending")])
        nodes, family = _family(rows, share)
        return _links(nodes, joining(family, rows.column("grp").to_numpy(), np.flatnonzero(rows.column("rest").to_numpy(zero_copy_only=False))))

    return rows.join(sets.select("node", "shingles"), "node").groupBy("family", "i", "j").applyInArrow(work, "u long, v long")


def shingle_sets(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, shingles) of the rows of (k1, k2, content) that have a wanted key, and of a few more that a join by key
    drops; rows that repeat as a whole, and so share a key, give one."""
    table = contents.sparkSession.sparkContext.broadcast(bloom_filter(wanted.select(F.col("k1").alias("hash"))))
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("shingles", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bits = Sink(schema), table.value
        for batch in batches:
            hit = maybe_among(bits, batch.column("k1").to_numpy().view(np.uint64))
            for k1, k2, raw in rows_of(iter([batch.take(pa.array(hit))]), *KEY, "content"):
                held = shingle_set(raw).astype("<u8").tobytes()
                out.add((k1, k2, held), len(held))
                if out.full():
                    yield out.take()
        yield from out.rest()

    sets = contents.mapInArrow(work, "k1 long, k2 long, shingles binary")
    return sets.groupBy(*KEY).agg(F.first("shingles").alias("shingles"))


def similar_links(nodes: DataFrame, contents: DataFrame, share: float, weight: int = WEIGHT) -> DataFrame:
    """(u, v) links of nodes that connect what candidate pairs of the share connect. nodes: (node, n, fp, fp2, copies, k1,
    k2), the keys of a row that holds the text; contents: (k1, k2, content)."""
    found = materialise(connected_components(near_links(nodes, LIMIT, limit2=LIMIT2, ratio=share)), "families")
    members = nodes.join(found.withColumnRenamed("component", "family"), "node")
    whole = members.groupBy("family").agg(F.max_by("node", F.struct("copies", "node")).alias("first"), F.ceil(F.sum("n") / weight).cast("int").alias("blocks"))
    placed = members.join(whole, "family").select(*KEY, "node", "n", "family", (F.col("node") == F.col("first")).alias("leader"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    placed = materialise(placed, "family-members")
    sets = materialise(shingle_sets(contents, placed).join(placed, KEY), "shingle-sets")
    links = materialise(block_links(sets, share), "block-links")
    several = placed.where("blocks > 1")
    if several.isEmpty():
        return links
    groups = materialise(connected_components(links), "block-groups").withColumnRenamed("component", "grp")
    grouped = materialise(several.join(groups, "node", "left").select("node", "family", "n", F.coalesce("grp", "node").alias("grp")), "grouped")
    more = materialise(cross_links(sets.where("blocks > 1"), grouped, share, weight), "cross-links")
    return links.unionByName(more)


def keep_one(docs: DataFrame, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts that similar pairs connect, with all its columns."""
    keyed = docs.select(*row_keys(docs), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content"))
    own = materialise(describe(keyed), "described")
    first = F.min(F.struct(*KEY)).alias("key")
    nodes = own.groupBy("node").agg(*(F.max(c).alias(c) for c in ("n", "fp", "fp2")), F.count(F.lit(1)).alias("copies"), first)
    nodes = materialise(nodes.select("node", "n", "fp", "fp2", "copies", "key.k1", "key.k2"), "nodes")
    found = materialise(connected_components(similar_links(nodes, keyed.select(*KEY, "content"), share)), "groups")
    grouped = own.join(found, "node", "left").select(*KEY, "doc_id", F.coalesce("component", "node").alias("grp"))
    best = grouped.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("best"))
    repeats = own.groupBy(*KEY).agg((F.count(F.lit(1)) > 1).alias("repeated"))
    best = materialise(best.select("best.k1", "best.k2").join(repeats, KEY), "kept-rows")
    names = [f"kept_{c}" for c in KEY]
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(k.alias(n) for k, n in zip(row_keys(docs), names, strict=True)))
    # the kept keys grow with the input, so both sides are always dealt by key
    kept = marked.join(best.hint("merge").toDF(*names, "repeated"), names)
    once = kept.where("repeated").groupBy(*names).agg(F.first("doc").alias("doc")).select("doc.*")
    return kept.where("not repeated").select("doc.*").unionByName(once)
