"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams is that of their 64-bit hashes, which every task knows without a count over the corpus.
Fragments are equal ranges of it, and each document's set is cut into a segment for each fragment.

Candidates: sets are classed by size, and a class is cut into more fragments than two similar sets of it can differ in,
so some segment of the two is the same. Documents enter their segments' digests under their own class and the next
one. To rest on segments of substance a class has a few fragments more than that, and as many weak segments (under
LEAST n-grams) stay out; a set with more weak ones enters them all. So no similar pair is lost, and documents meet only
where a whole segment of some ten n-grams agrees. What meets in any way is a family.

Overlaps: inside a family the sets are cut into PARTS fragments. A task has one fragment's segments of a block of
documents, counts their partial overlaps as one matrix product, and hands on a packed matrix; the matrices of a block are
summed over its fragments, which gives every pair's overlap, and only links that join something new are written. Small
families share blocks. A large one is cut into blocks, first with the documents that met most others in every block;
then the documents outside the family's largest group are compared with all its blocks. The number of matrices grows with
the documents that stay outside, not with the square of a group of copies.

Texts of equal sets are one node. A-Z count as lower case; fewer words than an n-gram has are one n-gram. Null and
empty texts have an empty set and link with nothing. Rows without an id link like others but name no component: the
component of such rows alone is null. Repeated rows count once; long texts are read a megabyte at a time; further
columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, bloom_filter, maybe_among, rows_of, text_bytes, text_keys, word_lists
from latticeframe.llm.containment import shingle_hashes
from latticeframe.operators.components import connected_components
from latticeframe.plans.lineage import materialise

WORDS = 3
#: N-grams of a segment below which it is weak, fragments in which overlaps are counted, n-grams and documents of a block,
#: and documents of a family that stand in all its blocks.
LEAST, PARTS, WEIGHT, MOST, LEADERS = 3, 4, 60_000, 256, 4
ODD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = ["family", "i", "j"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD
    return h ^ (h >> np.uint64(29))


def gram_set(raw: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    return np.unique(np.concatenate([shingle_hashes(words, size) for words in word_lists(raw, size)]))


class Classes:
    """Classes of sizes, each so wide that similar sets are of one class or of two next to each other."""

    def __init__(self, percent: int):
        self.percent, self.first, self.known = percent, [1], {}

    def _more(self) -> None:
        self.first.append(self.first[-1] * 100 // self.percent + 1)  # no set of this size or more is similar to one of the last first

    def of(self, n: int) -> int:
        while self.first[-1] <= n:
            self._more()
        return bisect.bisect_right(self.first, n) - 1

    def edges(self, k: int) -> tuple[np.ndarray, int]:
        """Where the fragments of class k begin but for the first, and how many weak segments may stay out."""
        while len(self.first) < k + 2:
            self._more()
        if k not in self.known:
            largest = self.first[k + 1] - 1
            differ = 2 * largest * (100 - self.percent) // (100 + self.percent)  # n-grams in one of two similar sets only
            spare = (differ + 1) // 16 + 1 if differ else 0
            self.known[k] = edges_of(differ + 1 + spare), spare
        return self.known[k]


def edges_of(parts: int) -> np.ndarray:
    """Where all fragments but the first begin, of `parts` equal ranges of the order."""
    return np.array([((k << 64) + parts - 1) // parts for k in range(1, parts)], np.uint64)


def cut(grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the fragments of a sorted set begin and end."""
    return np.r_[0, np.searchsorted(grams, edges), len(grams)]


def digests(grams: np.ndarray, classes: Classes) -> np.ndarray:
    """Digests of a set's segments in its own class and the next one."""
    if not len(grams):
        return np.zeros(0, np.int64)
    mixed, own, out = np.cumsum(_mix(grams)), classes.of(len(grams)), []
    sums = np.r_[np.uint64(0), mixed]
    for k in (own, own + 1):
        edges, spare = classes.edges(k)
        edges = cut(grams, edges)
        size = np.diff(edges)
        weak = size < LEAST
        entered = np.arange(len(size)) if weak.sum() > spare else np.flatnonzero(~weak)
        held = (sums[edges[1:]] - sums[edges[:-1]])[entered]
        out.append(_mix(_mix(held) + entered.astype(np.uint64) * ODD + np.uint64(k)))
    return np.concatenate(out).view(np.int64)


def describe(keyed: DataFrame, percent: int) -> DataFrame:
    """(doc_id, t1, node, n, digests) of every row of (doc_id, t1, content)."""
    names = ("doc_id", "t1")
    schema = pa.schema([*((c, pa.int64()) for c in (*names, "node", "n")), ("digests", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, classes = Sink(schema), Classes(percent)
        for *known, raw in rows_of(batches, *names, "content"):
            grams = gram_set(raw)
            held = digests(grams, classes).astype("<i8").tobytes()
            out.add((*known, node_of(grams), len(grams), held), len(held))
            if out.full():
                yield out.take()
        yield from out.rest()

    return keyed.mapInArrow(work, "doc_id long, t1 long, node long, n long, digests binary")


def entered(described: DataFrame) -> DataFrame:
    """(hash, node): every digest of the node of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = [np.frombuffer(d, "<i8") for d in batch.column("digests").to_pylist()]
                node = np.repeat(batch.column("node").to_numpy(), [len(d) for d in held])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(node)], ["hash", "node"])

    return described.select("node", "digests").mapInArrow(work, "hash long, node long")


def meetings(described: DataFrame) -> DataFrame:
    """(node, least, met): for each digest that different nodes have, each of them with the least and the number of other
    rows that have it."""
    held = F.count(F.lit(1)).alias("c"), F.min("node").alias("least"), F.max("node").alias("most")
    counted = materialise(entered(described).groupBy("hash").agg(*held).where("least < most").drop("most"), "shared-digests")
    table = described.sparkSession.sparkContext.broadcast(bloom_filter(counted))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(maybe_among(table.value, batch.column("hash").to_numpy().view(np.uint64))))

    some = materialise(entered(described).mapInArrow(work, "hash long, node long").distinct(), "met-digests")
    return some.join(counted, "hash").select("node", "least", (F.col("c") - 1).alias("met"))


def node_of(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64))


def gram_sets(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, part, grams): the segments of the texts of (t1, content) that have a wanted key t1, and of a few more that a
    join by node drops; each once."""
    table = contents.sparkSession.sparkContext.broadcast(bloom_filter(wanted.select(F.col("t1").alias("hash"))))
    schema = pa.schema([("node", pa.int64()), ("part", pa.int32()), ("grams", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bits, parts = Sink(schema), table.value, edges_of(PARTS)
        for batch in batches:
            hit = maybe_among(bits, batch.column("t1").to_numpy().view(np.uint64))
            for (raw,) in rows_of(iter([batch.take(pa.array(hit))]), "content"):
                grams = gram_set(raw)
                node, edges = node_of(grams), cut(grams, parts)
                for k in range(PARTS):
                    held = grams[edges[k] : edges[k + 1]].astype("<u8").tobytes()
                    out.add((node, k, held), len(held))
                if out.full():
                    yield out.take()
        yield from out.rest()

    found = contents.select("t1", "content").mapInArrow(work, "node long, part int, grams binary")
    return found.groupBy("node", "part").agg(F.first("grams").alias("grams"))


def partial_overlaps(segments: list[np.ndarray], active: np.ndarray) -> np.ndarray:
    """N-grams that each active segment shares with each segment, as an (active, all) matrix."""
    size = np.array([len(s) for s in segments])
    owner = np.repeat(np.arange(len(segments)), size)
    kinds, gram, times = np.unique(np.concatenate(segments), return_inverse=True, return_counts=True)
    shared = times > 1  # the others can add to a set's overlap with itself only
    column = np.cumsum(shared) - 1
    kept = shared[gram]
    owner, gram = owner[kept], column[gram[kept]]
    total = np.zeros((int(active.sum()), len(segments)), np.uint32)
    for at in range(0, int(shared.sum()), 8192):
        inside = (gram >= at) & (gram < at + 8192)
        one = np.zeros((len(segments), min(8192, int(shared.sum()) - at)), np.float32)
        one[owner[inside], gram[inside] - at] = 1
        total += np.rint(one[active] @ one.T).astype(np.uint32)
    return total


def count_parts(rows: DataFrame) -> DataFrame:
    """(family, i, j, nodes, overlaps): one packed matrix of partial overlaps for each block and fragment, from (family,
    i, j, part, node, n, active, grams)."""

    def work(block: pa.Table) -> pa.Table:
        block = block.sort_by([("node", "ascending")])
        active = block.column("active").to_numpy(zero_copy_only=False)
        segments = [np.frombuffer(g, "<u8") for g in block.column("grams").to_pylist()]
        one = block.slice(0, 1).select(BLOCK)
        told = np.stack([block.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("node", "n", "active")]).tobytes()
        packed = zlib.compress(partial_overlaps(segments, active).astype("<u4").tobytes(), 1)
        return one.append_column("documents", pa.array([told], pa.binary())).append_column("overlaps", pa.array([packed], pa.binary()))

    return rows.groupBy(*BLOCK, "part").applyInArrow(work, "family long, i int, j int, documents binary, overlaps binary")


def spanning(near: np.ndarray, active: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a boolean (active, all) matrix connects; rows are the places `active` of the columns."""
    n = near.shape[1]
    whole = np.zeros((n, n), bool)
    whole[active] = near
    whole |= whole.T
    free, links = np.ones(n, bool), []
    for start in range(n):
        if not free[start]:
            continue
        free[start], queue = False, [start]
        while queue:
            at = queue.pop()
            reached = np.flatnonzero(whole[at] & free)
            free[reached] = False
            links += [(at, b) for b in reached.tolist()]
            queue += reached.tolist()
    return links


def sum_parts(parts: DataFrame, percent: int) -> DataFrame:
    """(u, v): links of the blocks, from their overlaps summed over the fragments."""

    def work(block: pa.Table) -> pa.Table:
        node, n, active = np.frombuffer(block.column("documents")[0].as_py(), "<i8").reshape(3, -1)
        rows = np.flatnonzero(active)
        both = np.zeros((len(rows), len(node)), np.int64)
        for packed in block.column("overlaps").to_pylist():
            both += np.frombuffer(zlib.decompress(packed), "<u4").reshape(both.shape)
        union = n[rows][:, None] + n - both
        near = (100 * both >= percent * union) & (rows[:, None] != np.arange(len(node)))
        links = [(max(node[a], node[b]), min(node[a], node[b])) for a, b in spanning(near, rows)]
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["u", "v"])

    return parts.groupBy(*BLOCK).applyInArrow(work, "u long, v long")


def _links(placed: DataFrame, segments: DataFrame, percent: int, name: str) -> DataFrame:
    """Links of blocks (family, i, j, node, n, active), with the nodes' segments (node, part, grams)."""
    rows = placed.join(segments, "node")
    return materialise(sum_parts(materialise(count_parts(rows), f"{name}-overlaps"), percent), f"{name}-links")


def first_blocks(members: DataFrame) -> DataFrame:
    """(family, i, j, node, n, active, blocks): families in blocks, small ones several in a block, and the leaders of
    larger ones in each of theirs. members: (node, n, met, family)."""
    sums = members.groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("docs") / MOST), F.ceil(F.col("grams") / WEIGHT)).cast("int")
    sums = materialise(sums.withColumn("blocks", blocks), "family-sizes")
    small = sums.where("blocks = 1").agg(F.sum("docs"), F.sum("grams")).first()
    shared = 1 + max(int((small[0] or 0) // (MOST // 2)), int((small[1] or 0) // (WEIGHT // 2)))
    placed = members.join(sums, "family").withColumn("i", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.lit(-1)).cast("int"))
    home = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(shared))).otherwise(F.col("family"))
    placed = materialise(placed.select(home.alias("family"), "i", F.col("i").alias("j"), "node", "n", "met", "blocks"), "placed")
    large = placed.where("blocks > 1")
    order = W.partitionBy("family").orderBy(F.desc("met"), F.asc("node"))
    heads = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)
    everywhere = heads.withColumn("to", F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b <> i)"))).select("family", F.col("to").alias("i"), F.col("to").alias("j"), "node", "n", "blocks")
    return placed.drop("met").unionByName(everywhere).withColumn("active", F.lit(True))


def rest_blocks(large: DataFrame, groups: DataFrame) -> DataFrame:
    """(family, i, j, node, n, active): pairs of blocks of documents outside their family's largest group, and of those
    with blocks of that group. large: (family, node, n) of families of several blocks; groups: (node, grp)."""
    grouped = materialise(large.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node")), "grouped")
    sizes = grouped.groupBy("family", "grp").agg(F.count(F.lit(1)).alias("docs"))
    main = sizes.groupBy("family").agg(F.max_by("grp", F.struct("docs", "grp")).alias("main"))
    sided = grouped.join(main, "family").withColumn("rest", F.col("grp") != F.col("main"))
    half = lambda c: F.greatest(F.ceil(F.count_if(c) / (MOST // 2)), F.ceil(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) / (WEIGHT // 2))).cast("int")
    counts = sided.groupBy("family").agg(half(F.col("rest")).alias("rests"), half(~F.col("rest")).alias("mains")).where("rests > 0")
    dealt = sided.join(counts, "family").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    # a pair of blocks is (i, j) of the rest with i <= j, or (i, -1 - j) of the rest and the main group
    pairs = F.when(F.col("rest"), F.expr("concat(transform(sequence(0, rests - 1), i -> struct(least(i, own) as i, greatest(i, own) as j)), transform(sequence(0, mains - 1), j -> struct(own as i, -1 - j as j)))"))
    pairs = pairs.otherwise(F.expr("transform(sequence(0, rests - 1), i -> struct(i as i, -1 - own as j))"))
    spread = dealt.select("family", "node", "n", F.col("rest").alias("active"), F.explode(pairs).alias("p"))
    return spread.select("family", "p.i", "p.j", "node", "n", "active")


def similar_links(described: DataFrame, nodes: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect what similar pairs of nodes connect. nodes: (node, n, t1)."""
    met = materialise(meetings(described), "meetings")
    edges = met.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    families = materialise(connected_components(edges).withColumnRenamed("component", "family"), "families")
    most = met.groupBy("node").agg(F.sum("met").alias("met"))
    members = materialise(nodes.join(families, "node").join(most, "node"), "members")
    sets = materialise(gram_sets(contents, members), "segments")
    placed = materialise(first_blocks(members.select("node", "n", "met", "family")), "first-blocks")
    links = _links(placed.drop("blocks"), sets, percent, "first")
    large = placed.where("blocks > 1").select("family", "node", "n").distinct()
    if large.isEmpty():
        return links
    groups = materialise(connected_components(links), "first-groups").withColumnRenamed("component", "grp")
    return links.unionByName(_links(materialise(rest_blocks(large, groups), "rest-blocks"), sets, percent, "rest"))


def jaccard_join(docs: DataFrame, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when their sets' intersection has `percent` of their union or
    more; component_id is the smallest id reachable."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_keys(text_col)[0], text_bytes(text_col).alias("content"))
    own = materialise(describe(keyed, percent), "described")
    nodes = own.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("t1").alias("t1"), F.min("doc_id").alias("smallest"))
    nodes = materialise(nodes, "nodes")
    found = materialise(connected_components(similar_links(own, nodes.drop("smallest"), keyed, percent)), "groups")
    parts = materialise(nodes.select("node", "smallest").join(found, "node", "left").select("node", "smallest", F.coalesce("component", "node").alias("part")), "parts")
    least = parts.groupBy("part").agg(F.min("smallest").alias("component_id"))
    named = materialise(parts.join(least, "part").select("node", "component_id"), "components")
    linked = own.where("n > 0").select("doc_id", "n", "node").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
