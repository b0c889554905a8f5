"""Near-dedup of the pipeline against all pairs by plain sets."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from latticeframe.llm import near_copies


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return not (a or b) or 5 * len(a & b) >= 4 * len(a | b)


def plain_kept(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in sets:
        for j, b in sets:
            if i < j and similar(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def made(rng):
    words = ["".join(rng.choice("aeioubdklmst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = [rng.choice(words) for _ in range(14)]
    texts = []
    for _ in range(60):  # many texts hold a common passage
        t = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        texts.append(t + line if rng.random() < 0.5 else t)
    for _ in range(240):  # edits of random strength, of copies too, on both sides of 0.8
        t = list(rng.choice(texts[:40] if rng.random() < 0.5 else texts[-60:]))
        for _ in range(rng.randint(0, max(1, len(t) // 30))):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 2)] = [rng.choice(words)]
        texts.append(t or ["x"])
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n")]


def everything(nodes, *limits, **more):
    """All pairs as candidates, for the exact part."""
    return nodes.select(F.col("node").alias("u")).crossJoin(nodes.select(F.col("node").alias("v"))).where("u > v")


@pytest.mark.parametrize("weight", [100_000, 400])
def test_exact_part_joins_what_similar_pairs_connect(spark, monkeypatch, weight):
    monkeypatch.setattr(near_copies, "near_links", everything)
    monkeypatch.setattr(near_copies.similar_links, "__defaults__", (weight,))
    rows = made(random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == plain_kept(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_lose_few(spark, seed):
    rows = made(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, plain = {r.doc_id for r in near_copies.keep_one(docs).collect()}, plain_kept(rows)
    assert plain <= found  # nothing goes that no similar text stands for
    assert len(found - plain) <= 0.05 * (len(rows) - len(plain))


def test_one_row_of_each_group(spark):
    """Repeated rows, shared ids, no ids, and columns named like inner ones."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(9, a), (9, a), (5, a), (5, b), (1, b), (None, b), (None, None), (None, None), (7, ""), (None, "c d e f g h"), (None, "c d e f g h")]
    rows = [(i, t, "x", {"k": 1}, 3, [1, None]) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, k1 map<string,int>, n int, node array<int>").repartition(3)
    kept = near_copies.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "c d e f g h"), (1, b), (5, a), (7, "")]
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_stage_takes_a_tenth_of_words_changed(spark, tmp_path):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    near, far = list(base), list(base)
    near[10], near[100] = "changed", "altered"  # 10 of 196 shingles: Jaccard 0.90
    for at in range(5, 200, 20):
        far[at] = "other"  # 50 of 196: below 0.8
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((base, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)).collect()} == {0, 2}
