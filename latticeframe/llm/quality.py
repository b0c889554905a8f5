"""Quality rules with host-level verdicts.

Each document gets its rule measures. Failures are summed by host. Hosts' rates scatter more than chance would have it;
what is left after the binomial part is taken off gives a beta prior around the rate of all documents, so that hosts of
one or two documents, whose rates are 0 or 1 by luck, do not pass for a wide prior. A host's rate is shrunk towards that
rate, and the host is rejected with all its documents where the shrunk rate is above a limit by 1.645 standard deviations
of its posterior (95 percent).

Null and empty texts have no words and fail the base rule. A null host is a host of its own. Rows without an id and
repeated rows count as often as they come. Texts are measured whole. Extra columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeframe.llm.common import Sink, rows_of, text_bytes
from latticeframe.plans.lineage import materialise

# White space between words, and the characters that count as symbols.
WHITE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of five that occurs at least twice, its first place included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):  # equal windows mix alike; those that mix alike are compared below
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    maybe = order[np.r_[same, False] | np.r_[False, same]]
    seen: dict[tuple, list[int]] = {}
    for i in maybe.tolist():
        seen.setdefault(tuple(ids[i : i + WINDOW].tolist()), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, np.array(places) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
    return len(words), len(b"".join(words).decode("utf-8", "replace")), len(raw.translate(None, NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, measures) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in MEASURES)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for doc, host, raw in rows_of(batches, "doc_id", "host", "content"):
            out.add((doc, host, *measures(raw)))
            if out.full():
                yield out.take()
        yield from out.rest()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_bytes(text_col).alias("content"))
    return base.mapInArrow(work, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed():
    """The failures that count against a host: the base rule, many symbols, or many repeated lines."""
    return base_failed() | (10 * F.col("n_symbols") > 3 * F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_words"))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """(weight, mean) of the beta prior. The sum of squares between hosts is what chance alone gives, but for the part that
    goes with the correlation rho inside hosts; the weight is 1 / rho - 1. With one host, one document a host, or without
    failures or their opposite there is nothing to fit: the prior is uniform on (0, 1)."""
    n, f = F.col("n_docs"), F.col("n_failed")
    h, docs, failed, squares, between = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(f), F.sum(n * n), F.sum(f * f / n)).first()
    free = docs - squares / docs - (h - 1) if h else 0
    if not free or not 0 < failed < docs:
        return 2.0, 0.5
    mean = failed / docs
    rho = ((between - failed * mean) / (mean * (1 - mean)) - (h - 1)) / free
    return 1 / min(max(rho, 1e-6), 0.999) - 1, mean


def host_rates(measured: DataFrame, host_limit: float) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, rejected)."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(rule_failed().cast("long")).alias("n_failed"))
    weight, mean = prior(hosts)
    rate, total = (F.col("n_failed") + F.lit(weight * mean)) / (F.col("n_docs") + F.lit(weight)), F.col("n_docs") + F.lit(weight + 1)
    shrunk = F.col("shrunk_rate")
    return hosts.withColumn("shrunk_rate", rate).withColumn("rejected", shrunk - 1.645 * F.sqrt(shrunk * (1 - shrunk) / total) > host_limit)


def quality_rules(docs: DataFrame, host_limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, measures, base_failed, kept, host_rate). host_limit: a host goes whose rate of failed documents is above it
    for certain."""
    measured = materialise(measure(docs, id_col, text_col, host_col), "quality")
    verdicts = host_rates(measured, host_limit).select(F.col("host").alias("of"), "shrunk_rate", "rejected")
    # every document meets its host's verdict: hosts are few beside documents, but one may have a third of them
    joined = measured.join(materialise(verdicts, "hosts"), F.col("host").eqNullSafe(F.col("of")))
    return joined.select("doc_id", *MEASURES, base_failed().alias("base_failed"), (~base_failed() & ~F.col("rejected")).alias("kept"), F.col("shrunk_rate").alias("host_rate"))


def keep_documents(docs: DataFrame, host_limit: float = 0.5, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows and columns of documents that quality_rules keeps. The texts are measured once and written with their
    measures, so that only hosts, never texts, are joined where the rejected hosts are few."""
    own = T.StructType([T.StructField("doc", docs.schema), T.StructField("host", T.StringType()), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                doc = pa.StructArray.from_arrays(part.columns, part.schema.names)
                found = list(zip(*(measures((t or "").encode()) for t in part.column(text_col).to_pylist()), strict=True))
                host = part.column(host_col).cast(pa.string())
                yield pa.RecordBatch.from_arrays([doc, host, *(pa.array(c, pa.int64()) for c in found)], ["doc", "host", *MEASURES])

    measured = materialise(docs.mapInArrow(work, own), "measured")
    rejected = materialise(host_rates(measured, host_limit).where("rejected").select(F.col("host").alias("of")), "rejected-hosts")
    return measured.where(~base_failed()).join(rejected, F.col("host").eqNullSafe(F.col("of")), "left_anti").select("doc.*")
