"""Token counts with a digest cache.

A text's count depends only on its normalised content and on the tokenizer's file, so counts are stored under the two
digests. A run joins the documents' digests to the store, encodes each distinct miss once and appends it.

Null text counts as empty (0 tokens). Rows without an id are counted like others. Repeated rows and copies share one
entry. A text of any length is counted whole. Extra columns are ignored. An empty table gives an empty result and adds
no entry to the store.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.llm import vocab
from latticeframe.llm.common import Sink, rows_of, text_bytes
from latticeframe.plans.lineage import materialise

STORE = "digest binary, n_tokens long, version string"


@functools.lru_cache(maxsize=4)
def counter(path: str):
    """A function from text to its number of tokens, as the file's own library counts.

    A plain byte-level BPE .json goes through the rank form of the same vocabulary, which gives the same ids several
    times faster, but for texts with very long white space, which the rank library cannot take. Any other .json goes
    through its own library, and a .model through the sentence-piece one.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def plain(text: str) -> int:
        return len(tokenizer.encode(text, add_special_tokens=False))

    if not (fast := vocab.byte_level_json(path)):
        return plain
    encoding, special = fast

    def count(text: str) -> int:
        if vocab.LONG_GAP.search(text):
            return plain(text)
        if any(s in text for s in special):
            return len(encoding.encode(text, allowed_special=set(special)))
        return len(encoding.encode_to_numpy(text, disallowed_special=()))

    return count


def stored_counts(spark: SparkSession, store_path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty where there is no store yet. An entry that two runs added counts once."""
    try:
        store = spark.read.schema(STORE).parquet(store_path)
    except AnalysisException:
        store = spark.createDataFrame([], STORE)
    return store.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, store_path: str, tokenizer_path: str = vocab.BYTE_JSON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. The normalised content is the text itself with null as empty: the
    tokenizer's own normaliser, if it has one, runs inside its library."""
    spark, version = docs.sparkSession, vocab.file_digest(tokenizer_path)
    content = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("content"))
    digest = F.unhex(F.sha2("content", 256)).alias("digest")
    misses = (
        content.groupBy(digest).agg(F.first("content").alias("content"))  # combined before the shuffle: a task sends a copy once
        .join(stored_counts(spark, store_path, version), "digest", "left_anti")
    )
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64()), ("version", pa.string())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, out = counter(tokenizer_path), Sink(schema)
        for key, raw in rows_of(batches, "digest", "content"):
            out.add((key, count(raw.decode("utf-8", "replace")), version))
            if out.full():
                yield out.take()
        yield from out.rest()

    misses.mapInArrow(encode, STORE).write.mode("append").parquet(store_path)
    keyed = content.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), digest)
    # a digest may stand for a third of all rows: a join of two plain tables is one whose large keys Spark can split
    counts = materialise(stored_counts(spark, store_path, version), "counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
