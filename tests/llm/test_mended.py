"""Cases that earlier versions got wrong or were slow on."""

import random
from fractions import Fraction

import brute
import numpy as np
import pytest

from tally.llm import decontaminate, license_scan, ngram_jaccard
from tally.llm.memory import lean

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("", "na", "so", "vi") for c in
         ("ban", "dor", "fel", "gim", "hul", "jap", "kes", "lom")]


# -- licences ------------------------------------------------------------------

@pytest.mark.parametrize("text", [
    "This license expression is broken.", "the license expression that follows", "our license expression: see below",
    "A license expression: and then some", "SPDX License Identifier is a tag"])
def test_prose_about_licences_is_no_find(text):
    assert license_scan.scan_text(text.encode())[1] == []


def test_unknown_identifiers_are_reported_without_a_label():
    for text in ("SPDX-License-Identifier: hello", "SPDX-License-Identifier: MIT OR hello",
                 "SPDX-License-Identifier: LicenseRef-Own"):
        _, finds = license_scan.scan_text(text.encode())
        assert [(x[0], x[1]) for x in finds] == [("", "unknown")]
    for text, labels in (("license expression: MIT", ["mit"]), ("SPDX-License-Identifier= ISC", ["isc"]),
                         ("SPDX-License-Identifier : CC-BY-NC-SA-4.0 OR 0BSD", ["0bsd", "cc-by-nc-sa"]),
                         ("SPDX-License-Identifier: GPL-2.0-or-later WITH Own-exception", ["gpl-2"]),
                         ("SPDX-License-Identifier: BSD-2-Clause-Patent AND MPL-2.0", ["bsd", "mpl-2"])):
        assert sorted(x[0] for x in license_scan.scan_text(text.encode())[1] if x[1] != "base") == labels


def test_known_identifiers():
    known = license_scan.known_identifier
    assert all(map(known, ["MIT", "mit-0", "Apache-2.0", "GPL-3.0-only", "LGPL-2.1+", "CC0-1.0", "CC-BY-4.0", "0BSD",
                           "BSD-3-Clause", "PHP-3.01", "MS-PL", "Zlib"]))
    assert not any(map(known, ["is", "that", "see", "hello", "cc-by-what", "mitigate", "apache-two", ""]))


# -- decontamination -------------------------------------------------------------

def test_short_items_are_unsearchable(spark):
    docs = spark.createDataFrame([(i, "Yes. many of many words stand here " + " ".join(WORDS[i:i + 40])) for i in range(21)],
                                 "doc_id long, text string")
    long_item = " ".join(WORDS[10:35])
    bench = spark.createDataFrame([(0, "Yes."), (1, "of many"), (2, None), (3, long_item), (4, "one two three four five six seven")],
                                  "item_id int, text string")
    out = decontaminate.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()
    holds = {i for i in range(21) if long_item in " ".join(WORDS[i:i + 40])}
    assert holds and {r.item_id for r in out} == {3} and holds <= {r.doc_id for r in out}
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, "text", bench, "text").collect()}
    assert kept == set(range(21)) - {r.doc_id for r in out}
    short = decontaminate.unsearchable(bench, "item_id", "text").collect()
    assert {r.item_id: r.n_words for r in short} == {0: 1, 1: 2, 2: 0, 4: 7}
    few = bench.where("item_id < 3")
    assert decontaminate.drop_contaminated(docs, "text", few, "text").count() == 21


def test_paraphrases_without_a_common_run_are_found(spark):
    """Every fourth word is another: no five words in a row are shared, so only
    the latent search can bring document and item together."""
    rng = random.Random(4)
    items = [[f"item{k}word{j}" for j in range(40)] for k in range(30)]
    rows = []
    for i in range(300):
        prose = [rng.choice(WORDS) for _ in range(160)]
        if i % 5 == 0:
            changed = [w if j % 4 else rng.choice(WORDS) for j, w in enumerate(items[i // 5 % 30])]
            prose[60:60] = changed
        rows.append((i, " ".join(prose)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id int, text string")
    grams = lambda w: {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
    texts = [t.split(" ") for _, t in rows]
    assert not set.union(*map(grams, items)) & set.union(*map(grams, texts))
    # brute force over all windows: the subsequence alone
    want = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if set(item) & set(t)
            and decontaminate.common_subsequence(np.array([hash(w) for w in item]), np.array([hash(w) for w in t])) >= 30}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, "doc_id", "text", bench, "item_id", "text").collect()}
    assert len(want) == 60 and got <= want and len(got) >= 0.9 * len(want)


def test_sample_holds_a_text_once(spark, monkeypatch):
    """Copies of a text, however many, are one text of the learning sample."""
    sizes = []
    plain = decontaminate.cut_lineage

    def seen(df):
        out = plain(df)
        sizes.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(decontaminate, "cut_lineage", seen)
    rows = [(i, " ".join(WORDS[:60]) if i % 3 else f"text {i} " * 20) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(WORDS[90:120]))], "item_id int, text string")
    assert decontaminate.drop_contaminated(df, "text", bench, "text").count() == 600
    assert [n for columns, n in sizes if "_query" in columns] == [201]


# -- n-gram Jaccard ----------------------------------------------------------------

def test_strays_among_joined_copies(spark, monkeypatch):
    """Near copies of one text, and versions of it that miss the similarity
    but link with one another or with some copies only."""
    rng = random.Random(6)
    base = [rng.choice(WORDS) + str(j) for j in range(120)]
    rows = {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 2])):
            words[rng.randrange(120)] = f"new{rng.randrange(10 ** 6)}"
        rows[i] = " ".join(words)
    for i in range(200, 230):  # strays: further away
        words = list(base)
        for j in rng.sample(range(120), rng.choice([5, 6, 8, 12])):
            words[j] = f"far{rng.randrange(12)}"
        rows[i] = " ".join(words)
    order = list(rows.items())
    rng.shuffle(order)
    df = spark.createDataFrame(order, "doc_id long, text string")
    want, _ = brute.jaccard_components(rows, 3, 85, 100)
    assert len({c for _, c in want.values()}) > 3
    for few, block in ((8, 512), (2, 16)):
        monkeypatch.setattr(ngram_jaccard, "FEW", few)
        monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
        out = ngram_jaccard.jaccard_components(df, "doc_id", "text", n=3, similarity=Fraction(85, 100)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_pairs_that_are_compared():
    """A stray among m joined members is compared m times, not m * m."""
    import pyarrow as pa

    def compared(members, strays):
        side = np.array([0] * strays + [1] * members + [2] * strays)
        names = np.concatenate([np.arange(strays), np.arange(members) + strays, np.arange(strays)])
        n = len(side)
        label = np.where(side == 1, 10 ** 6, names)
        table = pa.table({"_piece": np.zeros(n, np.int64), "_i": np.zeros(n, np.int32), "_j": np.zeros(n, np.int32),
                          "_side": side.astype(np.int32), "_class": names, "_n": np.full(n, 32, np.int32),
                          "_label": label, "_sketch": [b"\0" * 8] * n})
        return ngram_jaccard._apart_pairs(table, [(0, n)], 4, 5).num_rows

    # with equal sketches every compared pair is a candidate
    assert compared(200, 3) == 3 * 200 + 3 and compared(400, 3) == 3 * 400 + 3


def test_hot_piece_stands_aside():
    piece = np.array([5, 7, 5, 5, 9, 5, 7])
    assert ngram_jaccard._third(piece).tolist() == [False, False, False, True, False, True, False]
    assert ngram_jaccard._third(np.zeros(0, np.int64)).tolist() == []


def test_lean_clears_at_the_end():
    done = []
    run = lean(lambda batches: (b + 1 for b in batches), lambda: done.append(1))
    out = run(iter([1, 2]))
    assert next(out) == 2 and not done and list(out) == [3] and done == [1]
