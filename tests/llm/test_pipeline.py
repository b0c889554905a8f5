"""The pipeline against a plain version on a small folder with nulls, copies, leaks and secrets."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from latticeframe.llm import near_copies, secrets, vocab
from tests.llm.test_near_copies import everything, plain_kept
from tests.llm.test_operators import plain_quality


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_against_plain_version(spark, tmp_path, monkeypatch):
    """All pairs are candidates of near-dedup here; test_near_copies has its candidates."""
    monkeypatch.setattr(near_copies, "near_links", everything)
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioubdklmst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(6, 40))) for i in range(12)]
    rows = [(i, text(rng.randint(3, 120)), "en", f"s{i % 5}", 1) for i in range(150)]
    for i in range(150, 260):
        t = rows[rng.randrange(150)][1]
        if i % 3 == 0:
            t += " " + rng.choice(items)[1]
        if i % 4 == 0:
            t = t + f" token = {rng.getrandbits(80):020x} end"
        if i % 5 == 0:
            t = (t + "\n") * 3
        rows.append((i, t, None, None, 1))
    rows += [(300, None, "en", "s1", None), (301, "", "en", "s1", 0), rows[7]]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [(i, t) for i, t, *_ in rows if not plain_quality(t or "")[-1]]
    kept = plain_kept(left)
    left = [(i, t) for i, t in dict(left).items() if i in kept]
    bench = [shingles(t) for _, t in items]
    left = [(i, t) for i, t in left if not any(len(shingles(t) & b) >= 0.8 * len(b) for b in bench)]
    encoding = vocab.rank_encoding(vocab.BYTE_RANKS)
    expected = []
    for i, t in left:
        t = secrets.masked(t)
        ids = encoding.encode_ordinary(t)
        expected.append((i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(t.encode()).hexdigest()))

    found = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids", "decoded_sha256").collect()
    assert sorted((r[0], r[1], bytes(r[2]), r[3]) for r in found) == sorted(expected)
    assert 0 < len(expected) < len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns and kept.count() > 0
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_rows_are_judged_as_rows(spark, tmp_path):
    """Shared, repeated and missing ids, and columns named like inner ones, in every stage."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    item, clean, other = text(12), text(60), text(50)
    leaked = text(30) + " " + item
    rows = [(1, clean), (1, leaked), (None, other), (None, leaked), (2, clean), (2, clean), (3, None), (None, "")]
    rows = [(i, t, "en", "s", 1, "x", 5, {"a": 1}) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc string, host int, t1 map<string,int>").repartition(2)
    spark.createDataFrame([(1, item), (1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    quality, near, leaks, secret, code = (f for _, f in corpus_pipeline.STAGES)
    long = lambda t: len(t.split()) >= 10
    assert key(quality(spark, docs, str(tmp_path))) == sorted((r[0] or 0, r[1]) for r in rows if r[1] and long(r[1]))
    assert key(near(spark, docs, str(tmp_path))) == sorted([(1, clean), (1, leaked), (0, other), (3, "")])
    assert key(leaks(spark, docs, str(tmp_path))) == sorted((r[0] or 0, r[1] or "") for r in rows if r[1] != leaked)
    assert key(secret(spark, docs, str(tmp_path))) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert code(spark, docs, str(tmp_path)).count() == len(rows)
    for stage in (quality, near, leaks, secret):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for stage in (quality, near, leaks, secret, code):
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
