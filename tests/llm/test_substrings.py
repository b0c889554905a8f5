import random

import numpy as np
import pytest

from latticeframe.llm import substrings as S
from latticeframe.llm import suffixes as X


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc\0", bytes(range(256))])
def test_suffix_array_and_prefixes(letters):
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 8, 9, 60, 300):
        raw = bytes(rng.choice(letters) for _ in range(n))
        text = np.frombuffer(raw, np.uint8)
        sa, rank = X.suffix_array(text)
        expected = sorted(range(n), key=lambda i: raw[i:])
        assert sa.tolist() == expected
        assert [rank[i] for i in expected] == list(range(n))
        lcp = [0] * n
        for k in range(1, n):
            a, b = raw[expected[k - 1] :], raw[expected[k] :]
            while lcp[k] < min(len(a), len(b)) and a[lcp[k]] == b[lcp[k]]:
                lcp[k] += 1
        assert X.common_prefixes(text, sa, rank).tolist() == lcp


def test_smallest_owner_across_shards():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(80)) for _ in range(4)]
    at = [np.arange(80 - 6 + 1)] * 4
    owners = [np.array([rng.randrange(50) for _ in a]) for a in at]
    found = X.smallest_owners([np.frombuffer(t, np.uint8) for t in texts], at, owners, 6)
    least = {}
    for t, o in zip(texts, owners, strict=True):
        for i, x in enumerate(o.tolist()):
            least[t[i : i + 6]] = min(x, least.get(t[i : i + 6], x))
    for t, f in zip(texts, found, strict=True):
        assert f.tolist() == [least[t[i : i + 6]] for i in range(75)]


def brute(rows):
    seen = {}
    rows = [(S.NO_ID if i is None else i, raw) for i, raw in rows]
    for i, raw in sorted(rows):
        for p in range(len(raw) - 49):
            seen.setdefault(raw[p : p + 50], i)
    out = []
    for i, raw in rows:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if seen[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(9, 40)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 20))]
        rows.append([i, " ".join(parts)])
    for i in range(120, 160):  # copies, near copies and long equal bytes
        rows.append([i, rows[rng.randrange(120)][1]])
        if i % 3 == 0:
            rows[-1][1] = rows[-1][1][:50] + "x" + rows[-1][1][51:]
        if i % 7 == 0:
            rows[-1][1] = "z" * rng.randint(40, 300)
    rows += [[200, None], [201, ""], [202, "short"], [203, passages[0] + " " + passages[0]], [5, rows[5][1]], [160, rows[159][1]], [160, rows[159][1]]]
    rows += [[None, rows[7][1]], [None, "only rows without an id hold this " * 4], [None, "only rows without an id hold this " * 4], [None, None]]
    return rows


@pytest.mark.parametrize("limits", [{}, {"chunk_bytes": 4000, "bucket_entries": 300, "shard_bytes": 900, "block_bytes": 1200, "many": 64}, {"chunk_bytes": 3000, "bucket_entries": 500, "shard_bytes": 2000, "block_bytes": 700, "many": 1}])
def test_against_brute_force(spark, limits):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(3)
    found = sorted((S.NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(docs, **limits).collect())
    assert found == brute([(i, (t or "").encode()) for i, t in rows])


def test_long_documents_in_pieces(monkeypatch):
    """Pieces cut runs but change no window's hash."""
    rng = random.Random(4)
    raw = bytes(rng.choice(b"abc ") for _ in range(5000))
    packed = S.zipped(np.array([1], "<i8"), np.array([len(raw)], "<i8"), np.zeros(1, "u1"), np.frombuffer(raw, np.uint8))
    windows = lambda c: {p: int(c.key[e]) for e, f, n in zip(c.entry, c.first, c.size, strict=True) for p in range(f, f + n)}
    whole = windows(S.Chunk(packed))
    monkeypatch.setattr(S, "PIECE", 700)
    assert windows(S.Chunk(packed)) == whole and len(whole) == len(raw) - 49


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(docs).count() == 0
