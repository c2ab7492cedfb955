import random
from fractions import Fraction

import brute
import numpy as np
import pytest

from tally.llm import embedding_dedup, ngram_jaccard
from tally.llm.components import components
from tally.llm.queries import op2_ngram_jaccard, op3_embedding_dedup

SF_SMALL = "/root/testdata/sf0.001"



def corpus(seed, n, vocabulary=400):
    """Originals of very different lengths and their edited copies."""
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(vocabulary)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(word) for _ in range(rng.choice([3, 5, 7, 9, 12, 16, 20, 40, 90, 200]))]
        texts.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy) + 1)
                copy[at:at + rng.randint(0, 1)] = [rng.choice(word)] * rng.randint(0, 1)
            texts.append(copy)
    return {i: " ".join(w) for i, w in enumerate(rng.sample(texts, len(texts)))}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    df = spark.createDataFrame([*links, (None, 3), (500, 500)], "x long, y long")
    got = {r.node: r.component for r in components(df, "x", "y").collect()}
    want = brute.components({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if n in got} and 500 not in got
    assert all(want[n] == n for n in want if n not in got)
    assert components(df.limit(0), "x", "y").count() == 0


@pytest.mark.parametrize("seed,n,p,q", [(1, 4, 85, 100), (2, 5, 4, 5), (3, 2, 1, 2), (4, 1, 9, 10)])
def test_jaccard_equals_all_pairs(spark, monkeypatch, seed, n, p, q):
    if seed % 2:  # also through blocks and sketches
        monkeypatch.setattr(ngram_jaccard, "FEW", 2)
        monkeypatch.setattr(ngram_jaccard, "BLOCK", 3)
    rows = corpus(seed, 300)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in ngram_jaccard.jaccard_components(df, "doc_id", "text", n, Fraction(p, q)).collect()}
    want, links = brute.jaccard_components(rows, n, p, q)
    assert links > 50
    assert got == want


def test_linked_sets_share_a_piece():
    """What exactness rests on: every linked pair sends a common piece."""
    rng = np.random.default_rng(4)
    levels = ngram_jaccard.Levels(17, 20)
    for _ in range(3000):
        size = int(rng.choice([6, 7, 9, 12, 17, 18, 25, 40, 80, 300]))
        base = np.unique(rng.integers(0, 2**63, size * 2, dtype=np.uint64))
        both, rest = base[:size], base[size:]
        cut, add = rng.integers(0, 1 + size // 5, 2)
        other = np.unique(np.concatenate([both[cut:], rest[:add]]))
        same = len(np.intersect1d(both, other))
        if same * 20 >= 17 * (len(both) + len(other) - same) and len(other):
            a, b = ngram_jaccard._pieces(both, levels), ngram_jaccard._pieces(other, levels)
            assert (both.tolist() == other.tolist()) or len(np.intersect1d(a, b))


def test_copies_that_the_hub_does_not_reach(spark, monkeypatch):
    """Chains and scattered copies of one text, most of them too far from
    every hub: links between them are found all the same."""
    monkeypatch.setattr(ngram_jaccard, "FEW", 3)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(160)]
    rows = {}
    for i in range(150):
        copy = list(rows[rng.randrange(i)].split(" ")) if i and rng.random() < 0.5 else list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows[i] = " ".join(copy)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in ngram_jaccard.jaccard_components(df, "doc_id", "text", 3, Fraction(4, 5)).collect()}
    want, links = brute.jaccard_components(rows, 3, 4, 5)
    assert links > 30 and 5 < len(set(c for _, c in want.values())) < 140
    assert got == want


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.integers(0, 9):], rng.integers(0, 2**63, 5, dtype=np.uint64)]))
        a, b = (np.frombuffer(ngram_jaccard._sketch(x), np.uint64) for x in (base, other))
        wide = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(x.reshape(-1, wide), axis=0) for x in (a, b))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(base, other))


def test_jaccard_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One TWO three"), (5, "one two three"), (6, "one two"), (7, long),
            (8, long), (8, long), (None, "alone here"), (None, long)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    out = ngram_jaccard.jaccard_components(df, "doc_id", "text").collect()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in out}
    assert len(out) == len(rows)
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 19996, 7), (8, 19996, 7),
                   (None, 1, None), (None, 19996, 7)}
    assert ngram_jaccard.jaccard_components(df.limit(0), "doc_id", "text").count() == 0
    kept = ngram_jaccard.keep_representatives(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "2", "3", "4", "6", "7", "None"]


def test_op2_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_ngram_jaccard(spark, SF_SMALL).collect()}
    assert got == brute.jaccard_components(rows, 4, 85, 100)[0]


def vectors(seed, groups, size, dimension=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.standard_normal(dimension)
        for _ in range(rng.integers(1, size)):
            out.append(base + rng.standard_normal(dimension) * rng.choice([0.02, 0.1, 0.3]))
    return np.array(out)


def exact(x, ids, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)]
    return near.sum(axis=1), brute.components(ids, links), len(links)


def test_embedding_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # several blocks per bucket
    x = vectors(2, 60, 60)
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, "vec_id", "v").collect()}
    count, label, links = exact(x, ids, 0.95)
    found = np.array([got[i].n_links for i in ids])
    assert links > 2000 and (found <= count).all()
    assert found.sum() >= 0.98 * count.sum()
    assert np.mean([got[i].component_id == label[i] for i in ids]) > 0.99
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_embedding_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (None, [1.0, 0.0]),
            (12, [1e300, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "k") for i, v in rows], "vec_id long, v array<double>, kept string")
    out = embedding_dedup.near_duplicates(df, "vec_id", "v").collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    for i in (1, 2, 3, 12):
        assert got[i] == (5, 1, i == 1)
    assert got[None] == (5, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 10, 11):
        assert got[i] == (0, i, True)
    assert embedding_dedup.near_duplicates(df.limit(0), "vec_id", "v").count() == 0


def test_op3_query(spark):
    v = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    ids = [r.vec_id for r in v]
    count, label, _ = exact(np.array([r.embedding for r in v], np.float64), ids, 0.95)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op3_embedding_dedup(spark, SF_SMALL).collect()}
    assert got == {i: (n, label[i]) for i, n in zip(ids, count, strict=True)}
