"""Language identification by mixture inference.

Byte trigrams of the lower-cased text are hashed into a fixed number of bins, and each language has a smoothed
distribution over them from all its training documents. For a document, expectation-maximisation finds the language
proportions under which its trigrams are most likely; the set of languages is the one of the most likely k, for each
k, whose likelihood less a penalty per language is best. The language with the largest proportion is the answer and
that proportion its score. With many languages the bins are fewer, so that the model every task gets keeps its size.

Null texts and texts without a letter are `und` with score 0. Ties go to the language that comes first. Repeated rows
count as often as they come in training, and rows without an id like others. Texts are read whole. Extra columns are
ignored. An empty table gives no rows; without any training row every answer is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, rows_of

BINS, UNDETERMINED = 1 << 15, "und"
#: Overlapping trigrams are not independent: a document's likelihood counts as that of a third of them.
DEPENDENCE, ROUNDS, STILL, LEAST_SHARE = 3.0, 40, 1e-3, 0.02
LETTER = regex.compile(r"\p{L}")
#: Entries of a model (languages x bins) that is sent to all tasks, 52 MB; and cells of the arrays for a batch of texts.
MOST_ENTRIES, BATCH_CELLS = 400 * BINS, 1_600_000


def bins_for(languages: int) -> int:
    """Bins of a model: BINS, halved until the model has its size, 256 at least."""
    bins = BINS
    while bins > 256 and bins * languages > MOST_ENTRIES:
        bins //= 2
    return bins


def bins_of(raw: bytes, bins: int = BINS) -> np.ndarray:
    """Bins of the trigrams of a text with a space at both ends."""
    x = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    gram = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((gram * np.uint32(2654435769)) >> np.uint32(33 - bins.bit_length())).astype(np.int64)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not trained on; one without an id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", pseudo: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages in order, log distribution over bins for each) from all given rows with a language and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, held in sums.items():
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(held[at])], ["lang", "bin", "n"])
            sums.clear()

        for lang, text in rows_of(batches, "lang", "text"):
            if lang not in sums:
                if len(sums) * bins >= MOST_ENTRIES:
                    yield from told()
                sums[lang] = np.zeros(bins, np.int64)
            sums[lang] += np.bincount(bins_of(text.lower().encode(), bins), minlength=bins)
        yield from told()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    bins = bins_for(rows.select("lang").distinct().count())
    counts = rows.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()  # languages x bins
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((len(langs), bins), pseudo)
    index = {x: i for i, x in enumerate(langs)}
    np.add.at(table, ([index[x] for x in counts.column("lang").to_pylist()], counts.column("bin").to_numpy()), counts.column("n").to_numpy())
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(model: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the chosen languages, number chosen) for each text; all texts of a batch advance together."""
    doc, at, n = [], [], []
    for d, raw in enumerate(texts):
        bins, counts = np.unique(bins_of(raw, model.shape[1]), return_counts=True)
        doc.append(np.full(len(bins), d))
        at.append(bins)
        n.append(counts)
    doc, at, n = np.concatenate(doc), np.concatenate(at), np.concatenate(n).astype(np.float64)
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    total = np.add.reduceat(n, edge)
    logs = model[:, at].astype(np.float64)
    top = logs.max(axis=0)
    like = np.exp(logs - top)  # scaled by each trigram's best language

    def fit(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM for the texts in `of`: proportions and log likelihoods (less the common scale)."""
        use = np.isin(doc, of) if len(of) < len(texts) else slice(None)
        d, l, c = doc[use], like[:, use], n[use]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        local = np.repeat(np.arange(len(of)), np.diff(np.r_[first, len(d)]))
        share = start.copy()
        for _ in range(ROUNDS):
            mix = share[:, local] * l
            before, share = share, np.add.reduceat(mix * (c / np.maximum(mix.sum(axis=0), 1e-300)), first, axis=1) / total[of]
            if np.abs(share - before).max() < STILL:
                break
        return share, np.add.reduceat(c * np.log(np.maximum((share[:, local] * l).sum(axis=0), 1e-300)), first)

    k, everyone = len(model), np.arange(len(texts))
    full, _ = fit(np.full((k, len(texts)), 1 / k), everyone)
    order = np.argsort(-full, axis=0, kind="stable")
    single = np.add.reduceat(np.log(np.maximum(like, 1e-300)) * n, edge, axis=1)
    first = single.argmax(axis=0)
    best_share = np.zeros((k, len(texts)))
    best_share[first, everyone] = 1
    price = np.log(np.maximum(total / DEPENDENCE, 2))
    best = 2 * single[first, everyone] / DEPENDENCE - price
    chosen = np.ones(len(texts), np.int64)
    for size in range(2, k + 1):
        of = np.flatnonzero(np.take_along_axis(full, order[size - 1 : size], 0)[0] >= LEAST_SHARE)
        if not len(of):
            break
        start = np.zeros((k, len(of)))
        np.put_along_axis(start, order[:size, of], 1 / size, 0)
        share, fitness = fit(start, of)
        value = 2 * fitness / DEPENDENCE - size * price[of]
        won = value > best[of]
        best[of[won]], chosen[of[won]] = value[won], size
        best_share[:, of[won]] = share[:, won]
    return best_share, chosen


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_languages, proportions): proportions maps each chosen language to its share."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_languages", pa.int32()), ("proportions", pa.map_(pa.string(), pa.float64()))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, weight = Sink(schema), [], 0

        def settle() -> None:
            known = [(doc, text.lower().encode()) for doc, text in held if langs and text and LETTER.search(text)]
            ids = {i for i, (_, text) in enumerate(held) if langs and text and LETTER.search(text)}
            shares, sizes = mixtures(sent.value, [raw for _, raw in known]) if known else (None, None)
            j = 0
            for i, (doc, _) in enumerate(held):
                if i not in ids:
                    out.add((doc, UNDETERMINED, 0.0, 0, []))
                    continue
                share = shares[:, j]
                win = int(share.argmax())
                out.add((doc, langs[win], float(min(1.0, share[win])), int(sizes[j]), [(langs[x], float(share[x])) for x in np.flatnonzero(share).tolist()]))
                j += 1

        for doc, text in rows_of(batches, "doc_id", "text"):
            held.append((doc, text))
            weight += len(text or "")
            if weight * max(1, len(langs)) > BATCH_CELLS or len(held) >= 256:
                settle()
                held, weight = [], 0
                if out.full():
                    yield out.take()
        settle()
        yield from out.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, n_languages int, proportions map<string,double>")
