"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked up inside long documents, whose Jaccard similarity is near nothing, so the sketches are of
the kind that keeps containment: a shingle is in a sketch where its hash is below a threshold. Items are partitioned by
their number of shingles (powers of two) and each partition has its own threshold, so that an item keeps about
`SKETCH` to twice as many shingles, and all of them where it has no more than that. A document's sketch for a partition
is its shingles below that partition's threshold.

Search: the document sketches probe the item sketches; a pair is a candidate where the share of the item's sketch that is
met is at most four standard errors below the asked share. A candidate that must meet m of s sketch shingles meets one of any
s - m + 1 of them, so only that many, those that the fewest texts hold, bring texts and items together: a line that many
items and many texts share pairs nothing, unless it is most of the item and the pairs are results. Pairs are then
counted over the sketch, pair by pair. Verification: items that are whole in their sketch are counted by that; of the others
candidate pairs alone are counted in full, by the exact shingles of the candidate items and texts. A pair is lost only
where sampling is off by four standard errors (one in 30,000 at the limit); items of up to SKETCH shingles lose none.

Shingles are five words (split at ASCII white space, A-Z lower-cased), compared as text. A text of one to four words
is one shingle; one without words (null, empty) has none and matches nothing. Rows without an id, and rows that share
one, are told apart by their texts; a pair of (id, item) from one text is given once. Equal texts, of documents or of items,
are searched as one. Long texts are read a megabyte at a
time. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, bloom_filter, maybe_among, rows_of, text_bytes, text_keys, word_lists
from latticeframe.plans.lineage import materialise, small_side

WORDS, SKETCH = 5, 32


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """A 64-bit hash of every shingle, in order."""
    k = min(size, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def threshold(n: int) -> int:
    """Hashes below it are in the sketch of an item of n shingles."""
    return min(1 << 64, (SKETCH << 64) >> max(0, n.bit_length() - 1))


def least_met(n: int, share: float) -> int:
    """Sketch shingles of n that a candidate must meet; n is the sketch's size."""
    return max(1, int(np.ceil((share - 4 * np.sqrt(share * (1 - share) / n)) * n - 1e-9)))


def item_key(text_col: str) -> Column:
    return F.xxhash64(F.lit(5), text_bytes(text_col)).alias("item")


def item_shingles(items: DataFrame, share: float, text_col: str) -> DataFrame:
    """(item, n_shingles, hash, shingle, in_sketch, n_sketch, need), each distinct shingle of an item's text once. item is the
    key of that text, n_sketch the shingles in its sketch, need the number of those that a candidate must meet."""
    fields = [("item", pa.int64()), ("n_shingles", pa.int64()), ("hash", pa.int64()), ("shingle", pa.binary())]
    schema = pa.schema([*fields, ("in_sketch", pa.bool_()), ("n_sketch", pa.int64()), ("need", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for key, raw in rows_of(batches, "item", "content"):
            found: dict[bytes, int] = {}
            for words in word_lists(raw, WORDS):
                for i, h in enumerate(shingle_hashes(words).tolist()):
                    found[b" ".join(words[i : i + WORDS])] = h
            limit = threshold(len(found))
            sketch = sum(h < limit for h in found.values())
            if not sketch:
                limit, sketch = 1 << 64, len(found)
            need = int(np.ceil(share * sketch - 1e-9)) if sketch == len(found) else least_met(sketch, share)
            for s, h in found.items():
                out.add((key, len(found), h - (1 << 64) if h >> 63 else h, s, h < limit, sketch, need), len(s))
            if out.full():
                yield out.take()
        yield from out.rest()

    base = items.select(item_key(text_col), text_bytes(text_col).alias("content")).dropDuplicates(["item"])
    return base.mapInArrow(work, "item long, n_shingles long, hash long, shingle binary, in_sketch boolean, n_sketch long, need long")


def met_shingles(contents: DataFrame, hashes: DataFrame) -> DataFrame:
    """(t1, t2, hash, shingle): the distinct shingles of each text of (t1, t2, content) that may be among the hashes."""
    table = contents.sparkSession.sparkContext.broadcast(bloom_filter(hashes))
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("hash", pa.int64()), ("shingle", pa.binary())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, out = table.value, Sink(schema)
        for t1, t2, raw in rows_of(batches, "t1", "t2", "content"):
            found: dict[bytes, int] = {}
            for words in word_lists(raw, WORDS):
                hashes = shingle_hashes(words)
                found |= {b" ".join(words[i : i + WORDS]): int(hashes[i].view(np.int64)) for i in maybe_among(bits, hashes).tolist()}
            for s, h in found.items():
                out.add((t1, t2, h, s), len(s))
            if out.full():
                yield out.take()
        yield from out.rest()

    return contents.mapInArrow(look_up, "t1 long, t2 long, hash long, shingle binary")


def ranked_sketches(shingles: DataFrame, probes: DataFrame) -> DataFrame:
    """(item, hash, shingle, n_shingles, n_sketch, need, searches): sketch shingles that some text holds, of items that can be
    met often enough; searches marks those that bring texts and items together, the rarest of all in the sketch."""
    holders = probes.groupBy("hash", "shingle").agg(F.count(F.lit(1)).alias("holders"))
    sketch = shingles.where("in_sketch").join(holders, ["hash", "shingle"], "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("item").orderBy("holders", "hash", "shingle"))
    held = F.sum((F.col("holders") > 0).cast("int")).over(Window.partitionBy("item"))
    ranked = sketch.withColumn("searches", place <= F.col("n_sketch") - F.col("need") + 1).withColumn("held", held)
    return ranked.where("holders > 0 and held >= need").select("item", "hash", "shingle", "n_shingles", "n_sketch", "need", "searches")


def meetings(probes: DataFrame, ranked: DataFrame) -> DataFrame:
    """(t1, t2, item), once for each searching shingle that a text and an item share."""
    return probes.join(ranked.where("searches").select("item", "hash", "shingle"), ["hash", "shingle"]).select("t1", "t2", "item")


def contaminated_texts(docs: DataFrame, items: DataFrame, share: float = 0.8, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """(t1, t2, item, n_shared, n_shingles): texts, by their keys, that hold at least `share` of the shingles of an item's text."""
    shingles = materialise(item_shingles(items, share, item_text_col), "item-shingles")
    contents = docs.select(*text_keys(text_col), text_bytes(text_col).alias("content"))
    pair, met = ["t1", "t2", "item"], ["t1", "t2", "hash", "shingle"]
    # copies of a text are one: their rows are combined before they are dealt
    probes = materialise(met_shingles(contents, shingles.where("in_sketch").select("hash")).distinct(), "probes")
    ranked = small_side(ranked_sketches(shingles, probes), "item-sketches")
    # each pair is counted over its own item's sketch, so that rows go with the pairs, whatever else the two texts share
    asked = meetings(probes, ranked).distinct().join(ranked.drop("searches"), "item")
    counted = asked.join(probes, met).groupBy(*pair, "n_shingles", "n_sketch", "need").agg(F.count(F.lit(1)).alias("n_shared"))
    candidates = materialise(counted.where("n_shared >= need").select(*pair, "n_shared", "n_shingles", "n_sketch"), "candidates")
    sampled = candidates.where("n_sketch < n_shingles").select(*pair)
    wanted = shingles.join(sampled.select("item").distinct(), "item", "left_semi").select("item", "n_shingles", "hash", "shingle")
    held = met_shingles(contents.join(sampled.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi"), wanted.select("hash")).distinct()
    full = sampled.join(wanted, "item").join(held, met).groupBy(*pair, "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    columns = [*pair, "n_shared", "n_shingles"]
    found = candidates.where("n_sketch = n_shingles").select(*columns).unionByName(full.select(*columns))
    return found.where(F.col("n_shared") / F.col("n_shingles") >= share)


def contained_items(docs: DataFrame, items: DataFrame, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment): documents that hold at least `share` of an item's distinct shingles."""
    found = small_side(contaminated_texts(docs, items, share, text_col, item_text_col), "contaminated")
    names = small_side(items.select(item_key(item_text_col), F.col(item_id_col).cast("long").alias("item_id")).distinct(), "item-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text_col)).join(found, ["t1", "t2"])
    both = rows.distinct().join(names, "item")
    return both.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, share: float = 0.8, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows and columns of documents whose text holds no item."""
    found = contaminated_texts(docs, items, share, text_col, item_text_col).select("t1", "t2").distinct()
    found = small_side(found.toDF("bad_t1", "bad_t2"), "contaminated")
    t1, t2 = text_keys(text_col)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), t1.alias("bad_t1"), t2.alias("bad_t2"))
    return row.join(found, ["bad_t1", "bad_t2"], "left_anti").select("doc.*")
