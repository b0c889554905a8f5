"""Shared helpers of the training-data operators: tables and Arrow batching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are turned into Python objects at a time, and bytes after which an output batch is sent.
SLICE_ROWS, FLUSH_BYTES = 256, 4 << 20
WHITE = re.compile(rb"[ \t-\r]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows as tuples of the named columns, a few hundred at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def word_lists(raw: bytes, k: int, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words of a text, about a megabyte of it at a time, for shingles of k words: each list starts with
    the last k - 1 words of the one before, so every shingle is in one list. A text of fewer words is one list."""
    at, kept, told = 0, [], False
    while at < len(raw) or not told:
        gap = WHITE.search(raw, at + size) if at + size < len(raw) else None
        end = gap.start() if gap else len(raw)
        words = kept + raw[at:end].lower().split()
        at, kept = end, words[-(k - 1) :]
        if len(words) >= k or (end == len(raw) and not told):
            told = True
            yield words
        if end == len(raw):
            break


class Sink:
    """Collects output rows and hands them on as batches of a few megabytes."""

    def __init__(self, schema: pa.Schema, flush_bytes: int = FLUSH_BYTES, flush_rows: int = 8192):
        self.schema, self.flush_bytes, self.flush_rows = schema, flush_bytes, flush_rows
        self.columns: list[list] = [[] for _ in schema]
        self.held = 0

    def add(self, row: tuple, weight: int = 0) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.held += weight

    def full(self) -> bool:
        return self.held >= self.flush_bytes or len(self.columns[0]) >= self.flush_rows

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns, self.held = [[] for _ in self.schema], 0
        return batch

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()


def _hashable(df: DataFrame, name: str) -> Column:
    """A column as Spark can hash it: maps, which it cannot, as JSON."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    return column if isinstance(kind, T.AtomicType) else F.to_json(F.struct(column.alias("v")))


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns of a row, named k1 and k2."""
    columns = [_hashable(df, c) for c in df.columns]
    # nulls do not count in the hash, so each column says whether it is one
    columns += [F.concat_ws("", *(F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns))]
    return [F.xxhash64(F.lit(k), *columns).alias(f"k{k}") for k in (1, 2)]


def text_keys(column: str = "text") -> list[Column]:
    """Two 64-bit hashes of a text, named t1 and t2; null counts as empty."""
    return [F.xxhash64(F.lit(k), text_bytes(column)).alias(f"t{k}") for k in (1, 2)]


#: Bits of a Bloom filter for each hash in it, its probes, and its most bits (32 MB): with more hashes it passes more, which
#: the join after it then drops.
FILTER_SHARE, PROBES, FILTER_BITS, BITMAP_BITS = 16, 4, 1 << 28, 8 * 4096


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """Byte table for the 64-bit hashes in column `hash`, sized by their number; it comes to the driver in rows of 4 KB."""
    size = min(FILTER_BITS, max(BITMAP_BITS, 1 << (FILTER_SHARE * max(1, hashes.count()) - 1).bit_length()))
    turned = [F.col("hash"), *(F.shiftrightunsigned("hash", 16 * k).bitwiseOR(F.shiftleft("hash", 64 - 16 * k)) for k in range(1, PROBES))]
    places = hashes.select(F.explode(F.array(*(t.bitwiseAND(F.lit(size - 1)) for t in turned))).alias("place"))
    maps = places.groupBy(F.shiftright("place", BITMAP_BITS.bit_length() - 1).alias("part"))
    table = np.zeros(size // 8, np.uint8)
    for part, bits in maps.agg(F.bitmap_construct_agg(F.pmod("place", F.lit(BITMAP_BITS)))).collect():
        table[part * 4096 : part * 4096 + len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return table


def maybe_among(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the unsigned hashes that may be in the filter."""
    mask, at = np.uint64(8 * len(table) - 1), np.arange(len(hashes))
    for k in range(PROBES):
        h = hashes[at]
        turned = h if not k else (h >> np.uint64(16 * k)) | (h << np.uint64(64 - 16 * k))
        spot = turned & mask
        at = at[(table[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return at
