"""Gestalt matching against the standard library's matcher, pair by pair."""

import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tally.functions import similarity as sim

TEXT = st.text(alphabet="abcß é𝄞", max_size=14)


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=40), st.sampled_from([0.0, 0.6, 0.8, 1.0]))
def test_ratios_equal_the_matcher(pairs, cutoff):
    got = sim.gestalt_ratios([a for a, _ in pairs], [b for _, b in pairs], cutoff)
    for (a, b), x in zip(pairs, got, strict=True):
        want = _ratio(a, b)
        assert x == want if want >= cutoff else x < cutoff


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_with_common_characters(seed):
    pick = random.Random(seed)
    pairs = [("".join(pick.choices("abcdefghij   ", k=pick.randrange(1, 420))),
              "".join(pick.choices("abcdefghijklmnopqrstuvwxyz  ", k=pick.choice((199, 200, 201, 350))))) for _ in range(8)]
    pairs += [("aaa" + "x" * 90, "aaa" + "y" * 250), ("q" * 300, "q" * 300)]
    got = sim.gestalt_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [_ratio(a, b) for a, b in pairs]


def test_blocks_change_nothing(monkeypatch):
    pick = random.Random(7)
    a = ["".join(pick.choices("abcd", k=pick.randrange(12))) for _ in range(300)]
    b = ["".join(pick.choices("abcd", k=pick.randrange(12))) for _ in range(300)]
    want = sim.gestalt_ratios(a, b)
    monkeypatch.setattr(sim, "BLOCK_CELLS", 50)
    assert np.array_equal(sim.gestalt_ratios(a, b), want)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=12), st.lists(TEXT, min_size=1, max_size=6), st.sampled_from([0.5, 0.8]))
def test_best_is_the_closest_match(values, candidates, cutoff):
    got = sim._best(values, candidates, cutoff)
    for v, i in zip(values, got.tolist(), strict=True):
        want = difflib.get_close_matches(v, candidates, n=1, cutoff=cutoff)
        assert i == (candidates.index(want[0]) if want else -1)


def test_score_and_cascade_on_rows(spark):
    rows = [("palm oil", "plam oil"), (None, "x"), ("", ""), ("a", None), ("sun flower", "sunflower")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", sim.gestalt_score(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {(a, b): None if a is None or b is None else _ratio(a, b) for a, b in rows}
    out = df.select("a", sim.gestalt_cascade(F.col("a") == "", F.col("a"), F.col("b"), ["palmoil", "sunflower"],
                                             ["palm oil", "sunflower"]).alias("i")).collect()
    assert {r.a: r.i for r in out} == {"palm oil": 0, None: None, "": None, "a": None, "sun flower": 1}
    assert df.where("false").select(sim.gestalt_score(F.col("a"), F.col("b"))).collect() == []
