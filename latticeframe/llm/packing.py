"""Packing token ids into rows of a fixed length, best fit decreasing.

Documents are encoded, texts longer than a row are split without loss into row-long pieces and a rest, and pieces are
dealt by a hash of (document, piece, ids) to shards of bounded size. In each shard the pieces, longest first, go to the
open row with the least room that is enough; a segment tree over room sizes finds it in logarithmic time.

Null and empty texts have no ids and so no piece. Rows with the same id, or with none, are packed one by one. Ties in
length go by document (none last), then piece, then ids. A text of any length is encoded whole. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeframe.llm import vocab
from latticeframe.llm.bpe import codec
from latticeframe.llm.common import Sink, rows_of, text_bytes

PACKS = "shard long, pack int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"
PACKS_ARROW = pa.schema([("shard", pa.int64()), ("pack", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])


class RoomTree:
    """Segment tree over room sizes 0..most: how many open rows have each size; finds the least size that is enough."""

    def __init__(self, most: int):
        self.width = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, need: int) -> int | None:
        node = need + self.width
        if self.count[node]:
            return need
        while node > 1:  # up to the first right-hand neighbour that holds a row, then down its left edge
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes for lengths in the order given (longest first); each length is 1..capacity."""
    tree, open_rows, rows = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for i, n in enumerate(lengths):
        room = tree.least(n)
        if room is None:
            row, left = len(rows), capacity - n
            rows.append([])
        else:
            tree.add(room, -1)
            row, left = open_rows[room].pop(), room - n
        rows[row].append(i)
        if left:
            open_rows[left].append(row)
            tree.add(left, 1)
    return rows


def pack_tokens(docs: DataFrame, capacity: int = 2048, ranks_path: str = vocab.BYTE_RANKS, pattern: str = vocab.PATTERN, pad_id: int = 0, shard_bytes: int = 2_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row: its ids (capacity of them, padded with pad_id; little-endian, 16-bit where the
    vocabulary has at most 65,536 ids, else 32-bit), cumulative segment lengths from 0, the offsets at which
    positions start again from 0, and each segment's document and piece number. shard_bytes: text bytes per shard."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content"))
    total = base.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    parts = min(-(-shards // 8), max(10_000, shards // 200))  # tasks take their shards one after the other
    dtype = "<u2" if max(vocab.read_ranks(ranks_path).values()) < 1 << 16 else "<u4"
    changes = vocab.class_changes()
    cut = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, out = vocab.rank_encoding(ranks_path, pattern), Sink(cut)
        for doc, raw in rows_of(batches, "doc_id", "content"):
            text = raw.decode("utf-8", "replace")
            if vocab.LONG_GAP.search(text):
                splitter, table, _ = codec(ranks_path, pattern, changes)
                ids = np.frombuffer(b"".join(map(table.__getitem__, splitter.pieces(text))), "<u4").astype(dtype)
            else:
                ids = encoding.encode_to_numpy(text, disallowed_special=()).astype(dtype)
            for piece, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity].tobytes()
                out.add((doc, piece, part), len(part))
            if out.full():
                yield out.take()
        yield from out.rest()

    def pack(shard: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.append_column("n", pa.array([-len(x) for x in pieces.column("ids").to_pylist()])).sort_by([("n", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        doc, number, ids = (pieces.column(c).to_pylist() for c in ("doc_id", "piece", "ids"))
        width, out = np.dtype(dtype).itemsize, Sink(PACKS_ARROW)
        blank = np.full(capacity, pad_id, dtype).tobytes()
        for k, row in enumerate(best_fit([len(x) // width for x in ids], capacity)):
            filled = b"".join(ids[i] for i in row)
            ends = np.cumsum([0, *(len(ids[i]) // width for i in row)]).tolist()
            out.add((shard[0].as_py(), k, ends[-1], filled + blank[len(filled) :], ends, ends[:-1], [doc[i] for i in row], [number[i] for i in row]))
        return pa.Table.from_batches([out.take()])

    pieces = base.mapInArrow(encode, "doc_id long, piece int, ids binary")
    # repeated ids, or rows without one, are told apart by what they hold, and equal pieces by which of so many each is: a
    # task that runs again deals as before
    counted = pieces.groupBy("doc_id", "piece", "ids").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    single = counted.select("doc_id", "piece", "ids", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    own = F.xxhash64("doc_id", "piece", "ids", "copy")
    dealt = single.withColumn("shard", F.pmod(own, F.lit(shards)).cast("long")).drop("copy").repartition(parts, "shard")
    return dealt.groupBy("shard").applyInArrow(pack, PACKS)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrices as files: one folder per run, rows in order of (shard, pack) within each file."""
    packed.repartition("shard").sortWithinPartitions("shard", "pack").write.mode("overwrite").parquet(path)
