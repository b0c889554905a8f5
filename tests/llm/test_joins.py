"""Phrases, the n-gram join and hard negatives against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeframe.llm import negatives, ngram_join, phrases

TEXTS = "doc_id long, text string, lang string, phrase string, node long, n string, hash string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# phrases


def phrase_texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "éta", "x", "new", "york", "city"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
        text = text.replace("x", "new york city hall") if i % 3 else text.replace("new", "New, ")
        rows.append((i, text + rng.choice([".", "!\t", "\nnew york city hall", "; "]), rng.choice(["en", "en", "fr", None])))
    rows += [(1000, None, "en"), (1001, "", None), (1002, " \t\n.,;", "fr"), (None, "new york city hall", "en")]
    rows += [(7, "alpha beta gamma", "en")] * 30 + [(2000, "york new " * 3000, "fr"), (2001, "a" * 5000, "zz")]
    return [(*r, "p", 1, "n", "h") for r in rows]


def plain_phrases(rows, longest, least, share, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    inside = collections.defaultdict(int)
    for (lang, p), c in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], c)
    rows = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * inside[lang, p] >= share * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, found in rows.items():
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "share", "top", "small"), [(5, 20, 100, 2000, False), (5, 5, 60, 7, True), (3, 10, 100, 50, True), (2, 10, 100, 50, False)])
def test_phrases(spark, monkeypatch, longest, least, share, top, small):
    if small:  # buffers end inside texts, and stripes are sliced
        for name, value in (("BUFFER", 50), ("CHUNK", 64), ("SLICE_WORDS", 40), ("FIRST_SLICES", 3)):
            monkeypatch.setattr(phrases, name, value)
    rows = phrase_texts()
    docs = spark.createDataFrame(rows, TEXTS).repartition(3)
    found = sorted(tuple(r) for r in phrases.collocations(docs, longest, least, share, top).collect())
    assert found == plain_phrases(rows, longest, least, share, top)


def test_stripe_totals_are_counts(spark):
    docs = spark.createDataFrame(phrase_texts(), TEXTS)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    stripes = phrases._union(phrases.all_stripes(texts, 4, 10))
    counts = {(r.lang, r.phrase): r.f for r in phrases.entries(stripes).collect()}
    totals = {(r.lang, r.prefix): r.total for r in stripes.groupBy("lang", "prefix").agg(F.sum("total").alias("total")).collect()}
    words = {k: c for k, c in counts.items() if " " not in k[1]}
    assert words and {k: totals[k] for k in words} == words


def test_phrase_scores_past_64_bits(spark):
    wide = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_000, 9_200_000_000_000_000, 9_223_372_036_854_775_000)], "a long, l long, r long, n long")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    found = wide.withColumns({"above": big("a") * big("n"), "below": big("l") * big("r")}).select(F.expr("cast(1000 as decimal(4,0)) * above div below")).first()[0]
    assert found == 1000 * 9_000_000_000_000_000 * 9_223_372_036_854_775_000 // (9_100_000_000_000_000 * 9_200_000_000_000_000)


# the join


def join_texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def near(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    found = [None, "", " \n", "one", "ONE", "one two", "one two three", "one two three four"]
    for n in (8, 12, 25, 60, 150, 700, 3000):
        base = sentence(n)
        found.append(" ".join(base))
        found += [" ".join(near(base, e)) for e in (0, 1, 1, 2, 3, n // 30, n // 60)]
        found += [" ".join(base[: n - n // 12]), " ".join(base[n // 20 :]).upper()]
    base = sentence(90)  # a group held together by its first text: copies differ too much from each other
    found += [" ".join(near(base, e)) for e in [0] + [1] * 60 + [2] * 20]
    common = sentence(20)  # passages that many share
    found += [" ".join(sentence(5) + common + sentence(5)) for _ in range(30)]
    return found + ["word " * 100_000, "word " * 99_000]


def plain_join(rows, percent):
    sets = []
    for doc, text in rows:
        w = re.findall("[^ \t-\r]+", lower(text))
        sets.append((doc, {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i))) for i, (doc, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("percent", "small"), [(90, False), (90, True), (70, True)])
def test_join(spark, monkeypatch, percent, small):
    if small:  # families in many blocks
        for name, value in (("MOST", 8), ("WEIGHT", 900), ("LEADERS", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    texts = join_texts()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += rows[10:14] + [(None, texts[20]), (None, "nothing like it at all"), (None, None), ((1 << 60) + 1, texts[30])]
    docs = spark.createDataFrame([(*r, "en", "p", 1, "n", "h") for r in rows], TEXTS).repartition(5)
    found = sorted((tuple(r) for r in ngram_join.jaccard_join(docs, percent).collect()), key=str)
    assert found == plain_join(rows, percent)


def test_fragments_leave_no_pair_out():
    rng = random.Random(1)
    for percent in (50, 80, 90, 97):
        classes = ngram_join.Classes(percent)
        for n in (*range(1, 60), 100, 333, 1000, 5000):
            for _ in range(4):
                a = {rng.getrandbits(64) for _ in range(n)}
                b = set(a)
                while True:  # as different as a link allows
                    c = set(b)
                    if rng.random() < 0.5 and len(c) > 1:
                        c.remove(rng.choice(sorted(c)))
                    else:
                        c.add(rng.getrandbits(64))
                    if 100 * len(a & c) < percent * len(a | c):
                        break
                    b = c
                one, two = (ngram_join.digests(np.array(sorted(s), np.uint64), classes) for s in (a, b))
                assert set(one.tolist()) & set(two.tolist()), (percent, n, len(b))


def test_a_hub_costs_no_square(spark, monkeypatch):
    """Copies that only their original links: matrices grow with the group, not with its square."""
    counted = []
    plain = ngram_join.count_parts
    monkeypatch.setattr(ngram_join, "count_parts", lambda rows: counted.append(rows.count()) or plain(rows))
    monkeypatch.setattr(ngram_join, "MOST", 32)
    for copies in (300, 600):
        rng = random.Random(3)
        base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        rows = [(0, " ".join(base))]
        for i in range(copies):
            words = list(base)
            at = rng.randrange(100)
            words[at : at + 2] = [f"v{i}", f"u{i}"]
            rows.append((i + 1, " ".join(words)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.component_id for r in ngram_join.jaccard_join(docs, 94).collect()} == {0}
    assert counted[-1] < 3 * counted[0]


@pytest.mark.parametrize("run", [ngram_join.jaccard_join, phrases.collocations])
def test_empty_texts(spark, run):
    assert run(spark.createDataFrame([], TEXTS)).count() == 0


# hard negatives


def plain_negatives(rows, positives, negatives_, low, high, scale, every):
    sound = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    own = {}
    for i, label, v in sound:
        if i % every == 0:
            own[i] = min(own.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in own.items():
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: B023,B905,E731
        same = sorted((-score(w), i) for i, k, w in sound if k == label and i != a)
        other = sorted((-score(w), i) for i, k, w in sound if k != label)
        for s, p in same[:positives]:
            inside = [(-t, i) for t, i in other if low * -s <= 100 * -t <= high * -s]
            out += [(a, p, r, i, -s, t) for r, (t, i) in enumerate(inside[:negatives_], 1)]
    return sorted(out)


def vectors(seed, dims, n, size=1.0):
    rng = np.random.default_rng(seed)
    made = (rng.normal(size=(n, dims)) + 0.7) * size
    rows = [(i, int(i * 7 % 4), made[i].tolist()) for i in range(n)]
    rows += [(n + i, i % 3, made[3].tolist()) for i in range(40)]  # ties
    rows += [(10, 1, made[4].tolist()), (10, 0, made[5].tolist()), rows[12], rows[12]]
    rows += [(None, 1, made[0].tolist()), (900, None, made[0].tolist()), (901, 1, None), (902, 1, [float("nan")] * dims), (903, 1, [None] * dims), (904, 2, [float("inf")]), (910, 2, []), (920, 3, made[6][:2].tolist())]
    return rows


@pytest.mark.parametrize(("dims", "size", "scale", "block", "every"), [(5, 1.0, 256.0, 16 << 20, 10), (64, 0.2, 256.0, 16 << 20, 5), (150, 1.0, 256.0, 4000, 10), (3, 3000.0, 256.0, 100, 10)])
def test_hard_negatives(spark, monkeypatch, dims, size, scale, block, every):
    for name, value in (("BLOCK_BYTES", block), ("ROWS", 37), ("ANCHORS", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(dims, dims, 150, size)
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, label int, embedding array<double>, id string, score int").repartition(4)
    found = negatives.hard_negatives(table, F.col("id") % every == 0, 5, 3, 50, 95, scale)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    plain = plain_negatives(rows, 5, 3, 50, 95, scale, every)
    assert len(plain) > 50 and sorted(tuple(r) for r in found.collect()) == plain


def test_residue_products_are_exact():
    rng = np.random.default_rng(4)
    for dims, most in ((1, 3), (64, 200), (70, 5000), (300, 20_000)):
        v = rng.integers(-most, most + 1, (40, dims)).astype(float)
        primes = negatives.primes_for(dims * most * most, dims)
        assert math.prod(primes) > 2 * dims * most * most
        held = negatives.Residues(v, primes)
        assert (held.scores(held, slice(None), slice(None)) == v.astype(np.int64) @ v.astype(np.int64).T).all()


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    anchor = F.col("id") % 50 == 0
    assert negatives.hard_negatives(spark.createDataFrame([], schema), anchor).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, 1, [1.0])], schema), anchor).count() == 0
    with pytest.raises(ValueError, match="too large"):
        negatives.hard_negatives(spark.createDataFrame([(50, 1, [1e30])], schema), anchor)
