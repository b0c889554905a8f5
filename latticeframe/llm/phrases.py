"""Phrase mining by stripes.

A stripe is a prefix of 0 to 4 words with an associative counter of the words that follow it. Tasks make stripes of the
texts they read, and stripes of one prefix are merged elementwise. The merged stripes are the one structure from which
all else is read: the count of every phrase (prefix and word); the total of a prefix (the stripe of no word sums to a
language's words, that of a word also counts, as `rest`, where no frequent word follows, and a longer prefix is an entry of
a shorter one's stripe); and for each phrase the largest count of a phrase longer by a word on the right (the largest
entry of its own stripe) or on the left (the largest entry whose last words it is).

Four passes make stripes of no word, of one, of two, and of three words and more. A phrase is frequent only where all its
words, all its pairs of neighbours and all its triples are: what is frequent after a pass goes as a Bloom filter of bounded
size into the next one; what the filter lets through wrongly is counted and dropped. A prefix of more than SLICE_WORDS
occurrences is cut into slices by the hash of the next word, so no stripe gathers in one task; at most SLICED prefixes
can be that frequent, since the bound grows with the number of words.

Texts: A-Z in lower case, null counts as empty; pieces end at . , ; : ! ? and line ends, words at blanks and tabs. Long texts are
read a megabyte at a time. A row without a language is of `und`. Repeated rows count as often as they stand; further
columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, bloom_filter, maybe_among, rows_of, text_bytes
from latticeframe.plans.lineage import materialise, small_side

#: Words of a task's buffer, and bytes of a text split at a time.
BUFFER, CHUNK = 3 << 19, 1 << 20
#: Stripes travel in packets by the hash of their prefix: the least number of these, and words of the corpus for each.
PACKETS, PACKET_WORDS = 256, 2_000_000
#: Slices of the stripe of the empty prefix, least occurrences of a slice of others, most prefixes that are sliced.
FIRST_SLICES, SLICE_WORDS, SLICED = 1024, 20_000, 2_000
GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
#: A-Z in lower case; everything that ends a piece becomes a full stop.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz.........")
ODD = np.uint64(0x9E3779B97F4A7C15)
STRIPES = "lang string, packet int, prefixes binary, sizes binary, nexts binary, counts binary, rests binary"
MERGED = "lang string, prefix string, nexts array<string>, counts array<bigint>, total bigint"


#: Hash of what stands for the end of a piece.
STOP = np.uint64(xxhash.xxh64_intdigest(b"."))


def chunks_of_words(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, a full stop wherever a piece ends, about a megabyte of text at a time."""
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + CHUNK) if at + CHUNK < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end].translate(LOWER).replace(b".", b" . ").split()
        at = end


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD
    return h ^ (h >> np.uint64(29))


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases from those of their words, position by position."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = _mix(h * ODD + w)
    return h


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word of a language; 0 for a full stop."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    hashes[hashes == STOP] = 0
    return np.where(hashes, hashes ^ _mix(np.array([seed], np.uint64)), np.uint64(0))


class Buffer:
    """Words of one language that wait to be told, with their hashes; 0 ends all phrases."""

    def __init__(self):
        self.words, self.hashes = [], []

    def add(self, words: list[bytes], hashes: np.ndarray) -> None:
        self.words += words
        self.hashes.append(hashes)

    def rest(self, most: int) -> Buffer:
        """The last words, for what follows them."""
        kept = Buffer()
        kept.add(self.words[max(0, len(self.words) - most) :], np.concatenate(self.hashes)[max(0, len(self.words) - most) :])
        return kept

    def marked(self, longest: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """The words' hashes, for prefixes of one word 0 for those that are not frequent; and, for longer prefixes, where a
        phrase of two words (three, for prefixes of three and more) that is frequent begins. `frequent` has those."""
        ids = np.concatenate(self.hashes)
        at = np.flatnonzero(ids)
        if longest == 1:
            ids[np.delete(at, maybe_among(frequent, phrase_hash([ids[at]])))] = 0
        if longest < 2:
            return ids, None
        padded = np.r_[ids, np.zeros(2, np.uint64)]
        for k in (1, 2)[: longest - 1]:
            at = at[padded[at + k] > 0]
            at = at[maybe_among(frequent, phrase_hash([padded[at + i] for i in range(k + 1)]))]
        begins = np.zeros(len(padded), bool)
        begins[at] = True
        return ids, begins

    def stripes(self, lang: str, sizes: range, frequent: np.ndarray | None, sliced: dict) -> Iterator[tuple]:
        """Stripe rows of the prefixes of `sizes` words that begin before the last max(sizes) words."""
        if len(self.words) > max(sizes):
            ids, begins = self.marked(max(sizes), frequent)
            for size in sizes:
                yield from self._stripes(lang, size, len(ids) - max(sizes), min(3, max(sizes)), ids, begins, sliced)

    def _stripes(self, lang: str, size: int, last: int, known: int, ids: np.ndarray, begins: np.ndarray | None, sliced: dict) -> Iterator[tuple]:
        words = self.words
        if size < 2:
            starts = np.flatnonzero(ids[:last]) if size else np.arange(last)
        else:  # all phrases of `known` words in the prefix and the next word are frequent
            starts = np.flatnonzero(begins[:last])
            for k in range(1, size + 2 - known):
                starts = starts[begins[starts + k]]
        nexts = ids[starts + size]
        if not size:
            starts, nexts = starts[nexts > 0], nexts[nexts > 0]
        if not len(starts):
            return
        prefix = phrase_hash([ids[starts + k] for k in range(size)]) if size else np.zeros(len(starts), np.uint64)
        entry = _mix(prefix * ODD + nexts)
        order = np.argsort(entry)
        new = np.flatnonzero(np.r_[True, np.diff(entry[order]) > 0])
        counts, order = np.diff(np.r_[new, len(order)]), order[new]
        by = np.lexsort((nexts[order], prefix[order]))
        counts, order = counts[by], order[by]
        prefix, nexts, starts = prefix[order], nexts[order], starts[order]
        edge = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1], True]).tolist()
        follow = [words[i] for i in (starts + size).tolist()]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            at = int(starts[a])
            before = words[at : at + size]
            slices = sliced.get((lang, *before[:2]), 1) if size else FIRST_SLICES
            rest, first = (int(counts[a]), a + 1) if nexts[a] == 0 else (0, a)
            text = b" ".join(before).decode()
            if slices == 1:
                yield lang, text, 0, b" ".join(follow[first:b]), counts[first:b].astype("<i8").tobytes(), rest
                continue
            if rest:
                yield lang, text, 0, b"", b"", rest
            of = _mix(nexts[first:b]) % np.uint64(slices)
            by = np.argsort(of, kind="stable")
            cut = np.flatnonzero(np.diff(of[by], prepend=slices, append=slices)).tolist()
            for c, d in zip(cut[:-1], cut[1:], strict=True):
                part = (by[c:d] + first).tolist()
                yield lang, text, int(of[by[c]]), b" ".join([follow[i] for i in part]), counts[part].astype("<i8").tobytes(), 0


def make_stripes(texts: DataFrame, sizes: range, frequent: np.ndarray | None, sliced: dict, packets: int) -> DataFrame:
    """Partial stripes of the prefixes of `sizes` words, from texts (lang, content), in packets."""
    send = texts.sparkSession.sparkContext.broadcast((frequent, sliced))
    kinds = (pa.string(), pa.int32(), *[pa.binary()] * 5)
    schema = pa.schema(list(zip(("lang", "packet", "prefixes", "sizes", "nexts", "counts", "rests"), kinds, strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered, split = send.value
        out, held, waiting, longest = Sink(schema), {}, 0, max(sizes)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, buffer in held.items():
                packed: dict[int, list[tuple]] = {}
                for stripe in buffer.stripes(lang, sizes, filtered, split):
                    packed.setdefault(xxhash.xxh32_intdigest(stripe[1], stripe[2]) % packets, []).append(stripe)
                for packet, some in packed.items():
                    _, prefixes, _, nexts, counts, rests = zip(*some, strict=True)
                    sizes_of, rests = (np.array(v, "<i8").tobytes() for v in ([len(c) // 8 for c in counts], rests))
                    words = b" ".join(n for n in nexts if n)
                    out.add((lang, packet, "\n".join(prefixes).encode(), sizes_of, words, b"".join(counts), rests), 3 * len(words))
                    if out.full():
                        yield out.take()

        for lang, raw in rows_of(batches, "lang", "content"):
            own = held.setdefault(lang, Buffer())
            for words in chunks_of_words(raw):
                own.add(words, word_hashes(lang, words))
                waiting += len(words)
                if waiting >= BUFFER:
                    yield from flush()
                    own = own.rest(longest)
                    held, waiting = {lang: own}, 0
            own.add([b"."] * longest, np.zeros(longest, np.uint64))  # phrases end with their text
        yield from flush()
        yield from out.rest()

    return texts.mapInArrow(work, STRIPES)


def merge_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes of one prefix (and slice of it) summed elementwise: (lang, prefix, nexts, counts, total); only words that
    follow `least` times or more are named, all are in the total."""
    key = ["lang", "packet"]
    named = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("total", pa.int64())])

    def numbers(rows: pa.Table, name: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), "<i8")

    def merged(rows: pa.Table) -> pa.RecordBatch:
        """All stripes of one packet."""
        split = lambda name, gap: [w for r in rows.column(name).to_pylist() if r for w in r.decode().split(gap)]
        prefixes = pa.array([p for r in rows.column("prefixes").to_pylist() for p in r.decode().split("\n")], pa.string()).dictionary_encode()
        of = prefixes.indices.to_numpy()
        many, size = numbers(rows, "counts"), numbers(rows, "sizes")
        owner, count = np.repeat(of, size), len(prefixes.dictionary)
        total = np.bincount(of, numbers(rows, "rests"), count) + np.bincount(owner, many, count)
        table = pa.table({"of": owner.astype(np.int64), "word": pa.array(split("nexts", " "), pa.string()), "n": many})
        sums = table.group_by(["of", "word"]).aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("n_sum"), least)).sort_by([("of", "ascending"), ("word", "ascending")])
        ends = pa.array(np.searchsorted(sums.column("of").to_numpy(), np.arange(count + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, sums.column(c).combine_chunks()) for c in ("word", "n_sum")]
        lang = pa.array([rows.column("lang")[0].as_py()] * count, pa.string())
        return pa.RecordBatch.from_arrays([lang, prefixes.dictionary, *lists, pa.array(np.rint(total).astype(np.int64))], schema=named)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in key]
            edges = [0, *(np.flatnonzero(new[0] | new[1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in key):
                    yield merged(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield merged(pa.Table.from_batches(held))

    return stripes.repartition(*key).sortWithinPartitions(*key).mapInArrow(work, MERGED)


def entries(merged: DataFrame) -> DataFrame:
    """(lang, phrase, size, f) of the named entries of merged stripes."""
    each = merged.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.nexts")).otherwise(F.concat_ws(" ", "prefix", "e.nexts"))
    return each.select("lang", phrase.alias("phrase"), "e.counts").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), F.col("counts").alias("f"))


def _gram_hashes(found: DataFrame) -> DataFrame:
    """(hash) of phrases (lang, phrase) of one size, as the next pass makes it from the words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, phrases in ((k, b.filter(pc.equal(b.column("lang"), k))) for b in batches for k in b.column("lang").unique()):
            words = zip(*(p.encode().split(b" ") for p in phrases.column("phrase").to_pylist()), strict=True)
            hashes = phrase_hash([word_hashes(lang.as_py(), list(w)) for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    return found.select("lang", "phrase").mapInArrow(work, "hash long")


def all_stripes(texts: DataFrame, longest: int, least: int) -> list[DataFrame]:
    """Merged stripes of the prefixes of no word, of one, of two, and of three to longest - 1, as far as there can be any."""
    frequent, hashes, sliced, bound, merged, packets = None, None, {}, SLICE_WORDS, [], FIRST_SLICES
    for sizes in [range(1), range(1, 2), range(2, 3), range(3, longest)]:
        if not sizes or not longest > sizes[0]:
            break
        merged.append(materialise(merge_stripes(make_stripes(texts, sizes, frequent, sliced, packets), least), "stripes"))
        found = materialise(entries(merged[-1]), "frequent")
        if sizes[0] == 3 or found.isEmpty():
            break
        if not sizes[0]:
            n = merged[0].agg(F.sum("total")).first()[0]
            bound, packets = max(SLICE_WORDS, n // SLICED), max(PACKETS, n // PACKET_WORDS)
        own = materialise(_gram_hashes(found), "frequent-hashes")
        hashes = own if hashes is None else hashes.unionByName(own)
        frequent = bloom_filter(hashes)
        # no more than SLICED phrases of one size can lie above the bound; longer prefixes go by their first two words
        if sizes[0] < 2:
            sliced = {(r.lang, *r.phrase.encode().split(b" ")): -(-r.f // bound) for r in found.where(F.col("f") > bound).collect()}
    return merged


def _words(phrase: str, first: str, length: str) -> Column:
    return F.expr(f"array_join(slice(split({phrase}, ' '), {first}, {length}), ' ')")


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by the lowest score of their cuts,
    floor(1000 * a * n / (l * r)), without those inside a longer one that has `share` percent of their count or more."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_bytes(text_col).alias("content"))
    merged = all_stripes(texts, longest, least)
    stripes = _union(merged)
    phrases = materialise(entries(stripes).where("size > 1"), "phrases")
    totals = stripes.where("prefix not like '% %'").groupBy("lang", "prefix").agg(F.sum("total").alias("total"))
    counts = materialise(totals.unionByName(phrases.select("lang", F.col("phrase").alias("prefix"), F.col("f").alias("total"))), "totals")
    # a phrase inside one longer by several words is inside one longer by one, which has as many occurrences at least
    right = stripes.select("lang", F.col("prefix").alias("phrase"), F.array_max("counts").alias("f"))
    left = phrases.where("size > 2").select("lang", _words("phrase", "2", "size - 1").alias("phrase"), "f")
    around = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    free = phrases.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("around") * 100 < F.col("f") * share, F.lit(True)))
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), "size", F.expr("explode(sequence(1, size - 1))").alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("phrase", "1", "k").alias("first"), _words("phrase", "k + 1", "size - k").alias("second"))
    part = lambda name, total: counts.select("lang", F.col("prefix").alias(name), F.col("total").alias(total))
    words = small_side(counts.where("prefix = ''").select("lang", F.col("total").alias("n")), "words")
    known = cuts.join(part("first", "l"), ["lang", "first"]).join(part("second", "r"), ["lang", "second"]).join(words, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    known = known.withColumns({"above": wide("a") * wide("n"), "below": wide("l") * wide("r")}).withColumn("score", F.expr("cast(1000 as decimal(4,0)) * above div below"))
    best = known.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then the first of those: no language is sorted in one task
    dealt = best.select("lang", "phrase", "b.*").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = dealt.withColumn("own", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("own") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
