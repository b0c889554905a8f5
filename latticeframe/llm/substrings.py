"""Removal of repeated substrings: every byte under a 50-byte string that also starts in a document with a smaller id.

Candidates. The 50-byte windows of a text fall into runs that share the smallest hash of their 16-byte strings. Equal
windows have equal smallest hashes, so windows can only repeat under a hash that two documents have. Texts are packed
into chunks; each chunk tells, for each (hash, digest of the run's bytes), its smallest document. Where a run's bytes
as a whole occur in a smaller document, all its windows go; where a hash has several runs, one copy of each goes on.

Shards. Those runs, a hash's all to one shard, are searched with suffix arrays: a shard's blocks have one each
(Larsson-Sadakane refinement, Kasai's common prefixes), and the blocks' strings are merged by binary search. A hash with
very many different runs is dealt out window by window instead, each to the shard of its own bytes.

A row without an id comes after all rows that have one: it loses what they hold and takes nothing from others. Null and
empty texts have no bytes; texts under 50 bytes lose none. Rows that share an id, or have none, do not make each other
repeats. Long texts are hashed a megabyte at a time. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, rows_of, text_bytes
from latticeframe.llm.suffixes import all_words, smallest_owners
from latticeframe.plans.lineage import materialise

LENGTH, GRAM = 50, 16
WIDE = LENGTH - GRAM + 1
#: Different runs of one hash in a chunk from which the hash is dealt out by windows.
MANY = 64
#: Text bytes of a chunk, entries of a bucket, text bytes of a shard, and of a block with a suffix array of its own.
CHUNK, BUCKET, SHARD, BLOCK = 6 << 20, 400_000, 2_500_000, 1_250_000
#: Stands for the id of rows without one.
NO_ID = (1 << 63) - 1
KEEP, WHOLE, SEND, DEAL = 0, 1, 2, 3
#: Bytes that are hashed at a time.
PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def scramble(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


def zipped(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: their sizes, then their bytes."""
    sizes = np.array([a.nbytes for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(a.tobytes() for a in arrays))


def unzipped(raw: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at = 4 * len(dtypes)
    out = []
    for size, dtype in zip(np.frombuffer(raw, "<u4", len(dtypes)).tolist(), dtypes, strict=True):
        out.append(np.frombuffer(raw[at : at + size], dtype))
        at += size
    return out


def digests_of(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A cryptographic digest of 64 bits of every stretch of a text."""
    raw, held = text.tobytes(), functools.partial(hashlib.blake2b, digest_size=8)
    return np.frombuffer(b"".join([held(raw[a:b]).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.uint64)


def runs_of(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, digest, document number, first window, number of windows) of all runs; ends: where each document ends."""
    n = len(text)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    words = all_words(np.concatenate([text, np.zeros(16, np.uint8)]), n)
    h = scramble(words[: n - GRAM + 1] * ODD + words[8 : n - 7] * np.uint64(0xC2B2AE3D27D4EB4F))
    m, w = h, 1
    while 2 * w <= WIDE:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < WIDE:
        m = np.minimum(m[: len(m) - (WIDE - w)], m[WIDE - w :])
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[: len(m)]
    inside = np.arange(len(m)) + LENGTH <= ends[doc]
    label = np.where(inside, doc, -1)
    edge = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (label[1:] != label[:-1]), True])
    first, last = edge[:-1], edge[1:]
    used = inside[first]
    first, last = first[used], last[used]
    return m[first], digests_of(text, first, last + LENGTH - 1), doc[first], first, last - first


class Chunk:
    """A chunk's texts with its runs, and its entries: one for each different (hash, digest), in that order."""

    def __init__(self, packed: bytes, many: int = MANY):
        self.most = many
        self.ids, self.ends, self.none, self.text = unzipped(packed, "<i8", "<i8", "u1", "u1")
        parts, at = [], 0
        while at < len(self.ends):  # documents of about a megabyte together; a longer one in pieces that share no window
            begin = int(self.ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(self.ends, begin + PIECE)))
            end = int(self.ends[to - 1])
            for a in range(begin, end, PIECE) if to == at + 1 else [begin]:
                b = min(end, a + PIECE + LENGTH - 1) if to == at + 1 else end
                found = runs_of(self.text[a:b], self.ends[at:to] - a if to > at + 1 else np.array([b - a]))
                parts.append((*found[:2], found[2] + at, found[3] + a, found[4]))
            at = to
        key, digest, self.doc, self.first, self.size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else runs_of(self.text, self.ends)
        order = np.lexsort((digest, key))
        k, d = key[order], digest[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
        edge = np.flatnonzero(new)
        self.entry = np.empty(len(k), np.int64)  # of each run
        self.entry[order] = np.cumsum(new) - 1
        self.key, self.digest = k[edge], d[edge]
        self.owner = np.minimum.reduceat(self.ids[self.doc[order]], edge) if len(edge) else np.zeros(0, np.int64)
        self.example = order[edge]  # a run of each entry
        own = self.ids[self.doc] == self.owner[self.entry]
        self.example[self.entry[own]] = np.flatnonzero(own)  # of its smallest document
        # hashes with many different runs, each with one entry to tell
        start = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
        self.key_at, self.per_key = start, np.diff(np.r_[start, len(self.key)])

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, hash, many): the entries that are told to the buckets, one for a hash with many."""
        many = np.repeat(self.per_key > self.most, self.per_key)
        lead = np.zeros(len(self.key), bool)
        lead[self.key_at] = True
        entry = np.flatnonzero(~many | lead)
        return entry, self.key[entry], many[entry]


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """(chunk, packed): documents as they come, a few megabytes together, in order of id within a chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0

        def close() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is None, r[0]))
            ids, none = np.array([NO_ID if r[0] is None else r[0] for r in held], "<i8"), np.array([r[0] is None for r in held], "u1")
            packed = zipped(ids, np.cumsum([len(r[1]) for r in held]).astype("<i8"), none, np.frombuffer(b"".join(r[1] for r in held), np.uint8))
            name = hashlib.sha256(packed).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed], pa.binary())], ["chunk", "packed"])

        for row in rows_of(batches, "doc_id", "content"):
            held.append(row)
            weight += len(row[1])
            if weight >= chunk_bytes:
                yield close()
                held, weight = [], 0
        if held:
            yield close()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content"))
    return base.mapInArrow(work, "chunk string, packed binary")


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((scramble(key * ODD) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def parted(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, places) of the parts that have any."""
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True]) if len(part) else np.zeros(1, np.int64)
    for a, b in pairwise(edge.tolist()):
        yield int(part[order[a]]), order[a:b]


TOLD = pa.schema([("bucket", pa.int64()), ("chunk", pa.string()), ("entries", pa.binary())])
ROLES = pa.schema([("chunk", pa.string()), ("roles", pa.binary()), ("sent_bytes", pa.int64())])


def tell(chunks: DataFrame, buckets: int, many: int = MANY) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(TOLD)
        for name, packed in rows_of(batches, "chunk", "packed"):
            c = Chunk(packed, many)
            entry, key, dealt = c.told()
            bucket = bucket_of(key, buckets)
            for b, e in parted(bucket):
                at = entry[e]
                digest = c.digest[at]
                low, high = digest.astype("<u4"), (digest >> np.uint64(32)).astype("<u4")
                width = np.minimum(c.size[c.example[at]], 255).astype("u1")
                out.add((b, name, zipped(at.astype("<u4"), key[e], low, high, c.owner[at], dealt[e].astype("u1"), width)), 16 * len(e))
                if out.full():
                    yield out.take()
        yield from out.rest()

    return chunks.mapInArrow(work, "bucket long, chunk string, entries binary")


def assign(told: pa.Table) -> pa.Table:
    """What each chunk does with each of its entries in one bucket."""
    names, parts = told.column("chunk").to_pylist(), [unzipped(x, "<u4", "<u8", "<u4", "<u4", "<i8", "u1", "u1") for x in told.column("entries").to_pylist()]
    sizes = [len(p[0]) for p in parts]
    entry, key, low, high, owner, many, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    source = np.repeat(np.arange(len(parts)), sizes)
    digest = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    order = np.lexsort((source, owner, digest, key))
    k, d = key[order], digest[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new = new_key | np.r_[True, d[1:] != d[:-1]]
    of_key = np.cumsum(new_key) - 1
    different = np.bincount(of_key, weights=new)[of_key] > 1
    dealt = np.bincount(of_key, weights=many[order])[of_key] > 0
    least = owner[order][np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    role = np.where(owner[order] > least, WHOLE, np.where(different, SEND, KEEP))
    role = np.where(dealt, DEAL, role).astype(np.uint8)
    back = np.empty(len(k), np.uint8)
    back[order] = role
    out, at = Sink(ROLES), 0
    for name, (e, *_, width), n in zip(names, parts, sizes, strict=True):
        r = back[at : at + n]
        used = r != KEEP
        sent = (width[r == SEND].astype(np.int64) + LENGTH - 1).sum() + 20 * LENGTH * (r == DEAL).sum()
        if used.any():
            out.add((name, zipped(e[used], r[used]), int(sent)))
        at += n
    return pa.Table.from_batches([out.take()])


def roles_of(c: Chunk, rows: list[bytes]) -> np.ndarray:
    role = np.zeros(len(c.key), np.uint8)
    for raw in rows:
        entry, r = unzipped(raw, "<u4", "u1")
        role[entry] = r
    # a hash that is dealt out is so in all its entries
    lead = role[c.key_at] == DEAL
    role[np.repeat(lead, c.per_key)] = DEAL
    return role


def window_bytes(c: Chunk, at: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(c.text, size)[at] if len(at) else np.zeros((0, size), np.uint8)


def dealt_windows(c: Chunk, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, number of each window's string, a first window of each string by its smallest document) of dealt hashes."""
    runs = np.flatnonzero(role[c.entry] == DEAL)
    at = np.repeat(c.first[runs], c.size[runs]) + (np.arange(c.size[runs].sum()) - np.repeat(np.cumsum(c.size[runs]) - c.size[runs], c.size[runs]))
    at = np.sort(at)  # documents stand in order of id, so the first of equal windows is of the smallest
    strings = np.ascontiguousarray(window_bytes(c, at, LENGTH)).view(f"V{LENGTH}").ravel()
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(s, len(number)) for s in map(bytes, strings)), np.int64, len(at))
    first = np.full(len(number), len(c.text), np.int64)
    np.minimum.at(first, of, at)
    return at, of, first


SENT = pa.schema([("shard", pa.int64()), ("chunk", pa.string()), ("runs", pa.binary())])
FOUND = pa.schema([("chunk", pa.string()), ("windows", pa.binary())])


def send(name: str, c: Chunk, role: np.ndarray, shards: int, out: Sink) -> None:
    """Rows of runs for the shards: (position, owner, number of windows) and the bytes under them."""
    entry = np.flatnonzero(role == SEND)
    run = c.example[entry]
    at, size, owner, shard = c.first[run], c.size[run], c.owner[entry], bucket_of(c.key[entry], shards)
    if (role == DEAL).any():
        _, _, first = dealt_windows(c, role)
        words = np.ascontiguousarray(window_bytes(c, first, 48)).view("<u8").astype(np.uint64)
        mixed = np.zeros(len(first), np.uint64)
        for i in range(words.shape[1]):
            mixed = scramble((mixed ^ words[:, i]) * ODD)
        doc = np.searchsorted(c.ends, first, side="right")
        at, size, owner, shard = np.r_[at, first], np.r_[size, np.ones(len(first), np.int64)], np.r_[owner, c.ids[doc]], np.r_[shard, bucket_of(mixed, shards)]
    for s, e in parted(shard):
        text = np.concatenate([c.text[a : a + n + LENGTH - 1] for a, n in zip(at[e].tolist(), size[e].tolist(), strict=True)])
        out.add((s, name, zipped(at[e].astype("<i8"), owner[e].astype("<i8"), size[e].astype("<i8"), text)), len(text))


def search(sent: pa.Table, block_bytes: int = BLOCK) -> pa.Table:
    """The windows of a shard's runs that also stand in a smaller document, by chunk."""
    names, parts = sent.column("chunk").to_pylist(), [unzipped(x, "<i8", "<i8", "<i8", "u1") for x in sent.column("runs").to_pylist()]
    texts, starts, owners, places = [], [], [], []
    block: list[tuple] = []
    held = 0

    def close() -> None:
        size = np.concatenate([b[3] for b in block])
        begin = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        texts.append(np.concatenate([b[4] for b in block]))
        starts.append(np.repeat(begin, size) + step)
        owners.append(np.repeat(np.concatenate([b[2] for b in block]), size))
        source = np.repeat(np.concatenate([np.full(len(b[1]), b[0]) for b in block]), size)
        places.append((source, np.repeat(np.concatenate([b[1] for b in block]), size) + step))

    for i, (at, owner, size, text) in enumerate(parts):
        cut = np.r_[0, np.cumsum(size + LENGTH - 1)]
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + block_bytes - held, side="right")) - 1)
            block.append((i, at[a:b], owner[a:b], size[a:b], text[cut[a] : cut[b]]))
            held += cut[b] - cut[a]
            a = b
            if held >= block_bytes - LENGTH * 4:
                close()
                block, held = [], 0
    if block:
        close()
    out = Sink(FOUND)
    hits: dict[int, list[np.ndarray]] = {}
    for least, owner, (source, at) in zip(smallest_owners(texts, starts, owners, LENGTH), owners, places, strict=True):
        won = least < owner
        for i in np.unique(source[won]).tolist():
            hits.setdefault(i, []).append(at[won & (source == i)])
    for i, found in hits.items():
        out.add((names[i], zipped(np.sort(np.concatenate(found)).astype("<i8"))))
    return pa.Table.from_batches([out.take()])


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def finish(c: Chunk, role: np.ndarray, found: list[bytes], out: Sink) -> None:
    """Each document of a chunk without the bytes under repeated windows."""
    change = np.zeros(len(c.text) + 1, np.int32)
    whole = (c.ids[c.doc] > c.owner[c.entry]) | (role[c.entry] == WHOLE)
    np.add.at(change, c.first[whole], 1)
    np.add.at(change, c.first[whole] + c.size[whole] + LENGTH - 1, -1)
    hits = np.concatenate([unzipped(x, "<i8")[0] for x in found]) if found else np.zeros(0, np.int64)
    single = [hits]
    # other runs of an entry that was sent, by the same document, follow the one that was
    again = np.flatnonzero((role[c.entry] == SEND) & ~whole)
    again = again[c.example[c.entry[again]] != again]
    if len(again) and len(hits):
        hit = np.zeros(len(c.text), bool)
        hit[hits] = True
        size = c.size[again]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = hit[np.repeat(c.first[c.example[c.entry[again]]], size) + step]
        single.append((np.repeat(c.first[again], size) + step)[same])
    if (role == DEAL).any():
        at, of, first = dealt_windows(c, role)
        doc = np.searchsorted(c.ends, at, side="right")
        least = np.searchsorted(c.ends, first, side="right")
        elsewhere = np.isin(first, hits)
        single.append(at[elsewhere[of] | (c.ids[doc] > c.ids[least[of]])])
    single = np.concatenate(single)
    np.add.at(change, single, 1)
    np.add.at(change, single + LENGTH, -1)
    gone = np.cumsum(change)[:-1] > 0
    begin = 0
    for doc, none, end in zip(c.ids.tolist(), c.none.tolist(), c.ends.tolist(), strict=True):
        part = gone[begin:end]
        spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum())
        out.add((None if none else doc, end - begin, int(part.sum()), spans, c.text[begin:end][~part].tobytes()), end - begin)
        begin = end


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, bucket_entries: int = BUCKET, shard_bytes: int = SHARD, block_bytes: int = BLOCK, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes."""
    chunks = materialise(pack_chunks(docs, id_col, text_col, chunk_bytes), "chunks")
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, n_bytes // 18 // bucket_entries + 1)  # about one run in eighteen bytes
    roles = materialise(tell(chunks, buckets, many).groupBy("bucket").applyInArrow(assign, "chunk string, roles binary, sent_bytes long"), "roles")
    shards = max(1, (roles.agg(F.sum("sent_bytes")).first()[0] or 0) // shard_bytes + 1)
    by_chunk = chunks.groupBy("chunk")

    def ship(packed: pa.Table, told: pa.Table) -> pa.Table:
        out = Sink(SENT)
        # chunks with the same texts have the same name; each row is one chunk
        for name, raw in zip(packed.column("chunk").to_pylist(), packed.column("packed").to_pylist(), strict=True):
            c = Chunk(raw, many)
            send(name, c, roles_of(c, told.column("roles").to_pylist()), shards, out)
        return pa.Table.from_batches([out.take()])

    def close(packed: pa.Table, told: pa.Table) -> pa.Table:
        out, told_rows = Sink(RESULT), told.column("roles").to_pylist()
        roles_in, found = [x for x, k in zip(told_rows, told.column("kind").to_pylist(), strict=True) if k == 0], [x for x, k in zip(told_rows, told.column("kind").to_pylist(), strict=True) if k == 1]
        for raw in packed.column("packed").to_pylist():
            c = Chunk(raw, many)
            finish(c, roles_of(c, roles_in), found, out)
        return pa.Table.from_batches([out.take()])

    sent = by_chunk.cogroup(roles.groupBy("chunk")).applyInArrow(ship, "shard long, chunk string, runs binary")
    found = sent.groupBy("shard").applyInArrow(lambda runs: search(runs, block_bytes), "chunk string, windows binary")
    told = roles.select("chunk", "roles", F.lit(0).alias("kind")).unionByName(found.select("chunk", F.col("windows").alias("roles"), F.lit(1).alias("kind")))
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(close, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
