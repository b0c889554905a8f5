"""Byte-level BPE encoding and decoding of whole texts.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. The pattern looks only forward, so two
scans that share one boundary share all later ones: chunks are stitched at the first boundary inside the overlap that
both scans found, and where a piece outruns the overlap the scan goes on over the joined text until they meet. Then
the pieces are encoded. Decoding joins the tokens' raw bytes.

Pieces are cut as the rank library cuts them, whatever versions of Unicode it and the splitter here follow (vocab.py).

Null text is empty: no ids and no bytes. Rows without an id are encoded like others. Repeated rows give repeated
results. A text of any length is one row; beyond chunk_chars it is cut, and a piece may be as long as the text. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeframe.llm import vocab
from latticeframe.llm.common import Sink, rows_of

#: A boundary found in a chunk holds in the whole text if so many characters after it were in sight: the pattern's
#: longest alternative that a chunk's end could cut short has three characters.
SIGHT = 3
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


class PieceIds(dict):
    """Piece to its ids as little-endian 32-bit integers, filled as pieces are met; starts anew at a fixed size."""

    def __init__(self, encoding, most: int = 400_000):
        super().__init__()
        self.encode_piece, self.most = encoding.encode_to_numpy, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.encode_piece(piece, disallowed_special=()).astype("<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str, changes: tuple):
    """(splitter, piece table, token bytes by id) for this process."""
    by_id = {rank: token for token, rank in vocab.read_ranks(ranks_path).items()}
    return vocab.Splitter(pattern, changes), PieceIds(vocab.piece_encoding(ranks_path)), by_id


def decode_ids(ids: bytes, by_id: dict[int, bytes]) -> bytes:
    return b"".join(map(by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def scan(rx, chunk: str, last: bool) -> np.ndarray:
    """Ends of the chunk's pieces that also hold in the whole text if the chunk's start is a boundary."""
    lengths = np.fromiter(map(len, rx.findall(chunk)), np.int64)
    ends = np.cumsum(lengths)
    return ends if last else ends[ends <= len(chunk) - SIGHT]


def stitch(rx, text: str, starts: list[int], found: list[np.ndarray]) -> np.ndarray:
    """All piece ends of the text, from each chunk's own ends (as positions in the text)."""
    kept, at = [], 0  # at: the last certain boundary
    for i, (start, ends) in enumerate(zip(starts, found, strict=True)):
        while at < len(text) and at != start and not _has(ends, at):  # scan on until this chunk agrees
            if at > start and (not len(ends) or at > ends[-1]):
                break  # a piece ran past this chunk: the next one may agree
            at = rx.match(text, at).end()
            kept.append(np.array([at]))
        else:
            ends = ends[ends > at]
            if i + 1 < len(starts):
                ends = _until_next(ends, starts[i + 1], found[i + 1])
            if len(ends):
                kept.append(ends)
                at = int(ends[-1])
    while at < len(text):
        at = rx.match(text, at).end()
        kept.append(np.array([at]))
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _has(ends: np.ndarray, at: int) -> bool:
    i = np.searchsorted(ends, at)
    return bool(i < len(ends) and ends[i] == at)


def _until_next(ends: np.ndarray, start: int, following: np.ndarray) -> np.ndarray:
    """Ends up to the first that the next chunk has too; all where there is none."""
    common = ends[(ends >= start) & ((ends == start) | np.isin(ends, following))]
    return ends[ends <= common[0]] if len(common) else ends


def encode_decode(docs: DataFrame, ranks_path: str = vocab.BYTE_RANKS, pattern: str = vocab.PATTERN, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, and the bytes they stand for."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spec = "doc_id long, ids binary, decoded binary"
    changes = vocab.class_changes()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (splitter, table, by_id), out = codec(ranks_path, pattern, changes), Sink(ENCODED)
        for doc, text in rows_of(batches, "doc_id", "text"):
            ids = b"".join(map(table.__getitem__, splitter.pieces(text)))
            out.add((doc, ids, decode_ids(ids, by_id)), len(ids) + len(text))
            if out.full():
                yield out.take()
        yield from out.rest()

    pieces = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
    names = ("doc_id", "row", "start", "last", "copies", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(pieces)
        for doc, row, text in rows_of(batches, "doc_id", "row", "text"):
            for start in range(0, len(text), chunk_chars):
                chunk = text[start : start + chunk_chars + overlap]
                out.add((doc, row, start, start + chunk_chars >= len(text), chunk), len(chunk))
                if out.full():
                    yield out.take()
        yield from out.rest()

    scanned = pa.schema([*pieces.remove(4), ("copies", pa.int64()), ("text", pa.string()), ("ends", pa.binary())])

    def scan_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (splitter, _, _), out = codec(ranks_path, pattern, changes), Sink(scanned)
        for doc, row, start, last, copies, text in rows_of(batches, *names):
            out.add((doc, row, start, last, copies, text, (start + scan(splitter.rx, splitter.shadow(text), last)).astype("<i8").tobytes()), len(text) * 3)
            if out.full():
                yield out.take()
        yield from out.rest()

    def join_chunks(chunks: pa.Table) -> pa.Table:
        splitter, table, by_id = codec(ranks_path, pattern, changes)
        rows = sorted(zip(*(chunks.column(c).to_pylist() for c in ("start", "text", "ends")), strict=True))
        starts = [r[0] for r in rows]
        text = "".join(r[1][:chunk_chars] for r in rows)
        ends = stitch(splitter.rx, splitter.shadow(text), starts, [np.frombuffer(r[2], "<i8") for r in rows])
        ids = b"".join(table[text[a:b]] for a, b in pairwise([0, *ends.tolist()]))
        one = [[chunks.column("doc_id")[0].as_py()], [ids], [decode_ids(ids, by_id)], [chunks.column("copies")[0].as_py()]]
        return pa.table(one, schema=ENCODED.append(pa.field("copies", pa.int64())))

    short = base.where(F.length("text") <= chunk_chars).mapInArrow(whole, spec)
    long = base.where(F.length("text") > chunk_chars)
    # a row is named by what it holds, so a task that runs again names it as before; equal rows are encoded once
    long = long.withColumn("row", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text"), 256))
    chunks = long.mapInArrow(cut, "doc_id long, row string, start long, last boolean, text string").groupBy("row", "start")
    chunks = chunks.agg(*(F.first(c).alias(c) for c in ("doc_id", "last", "text")), F.count(F.lit(1)).alias("copies")).select(*names)
    scanned_spec = "doc_id long, row string, start long, last boolean, copies long, text string, ends binary"
    joined = chunks.mapInArrow(scan_chunks, scanned_spec).groupBy("row").applyInArrow(join_chunks, f"{spec}, copies long")
    every = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids", "decoded")
    return short.unionByName(every)
