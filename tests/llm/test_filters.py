import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa

from tally.llm import decontaminate, language_id, substring_dedup, toxicity
from tally.llm.queries import op4_decontaminate, op5_substring_dedup, op6_toxicity, op10_language_id

SF_SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- substring dedup -------------------------------------------------------

def removed(spark, rows, width, gram=5, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in extra:
        df = df.selectExpr("*", f"'x' as {name}")
    out = substring_dedup.remove_repeated(df, "doc_id", "text", width, gram).collect()
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out]


def test_substring_equals_brute_force(spark):
    rng = random.Random(3)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(3, 30))] for k in range(20)]
    rows = {}
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 8)):
            w += rng.choice(passages) if rng.random() < 0.4 else [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 9))]
        rows[i] = " \n".join(w)
    rows[150] = rows[3]
    for width, gram in ((6, 3), (12, 5), (3, 1)):
        want = {(i, len(w), len(w) - len(k), sha(" ".join(k)))
                for i, (w, k) in brute.remove_repeated(rows, width).items()}
        assert set(removed(spark, list(rows.items()), width, gram)) == want


def test_substring_defined_cases(spark):
    text = " ".join(f"a{i}" for i in range(25))
    again = "go " * 60
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, text), (6, text), (6, text), (None, text),
            (7, again.strip()), (None, "fresh words only")]
    got = removed(spark, rows, 20, extra=("n_words", "_id"))
    assert len(got) == len(rows)
    kept = {(i, n, x) for i, n, x, _ in got}
    assert kept >= {(1, 0, 0), (2, 0, 0), (3, 2, 0), (4, 2, 0), (5, 25, 0), (6, 25, 25), (None, 25, 25), (None, 3, 0)}
    first = brute.remove_repeated({7: again.strip()}, 20)[7]
    assert (7, 60, 60 - len(first[1]), sha(" ".join(first[1]))) in got
    assert removed(spark, [(1, "x")], 20)[0][2] == 0
    assert spark.createDataFrame([], "doc_id long, text string").transform(
        lambda d: substring_dedup.remove_repeated(d, "doc_id", "text")).count() == 0


def test_sketch_never_loses_a_window():
    """Equal windows have equal anchors, wherever they stand."""
    rng = np.random.default_rng(8)
    body = rng.integers(0, 30, 400)
    from tally.llm.words import NON_SPACE, Words, windows

    text = " ".join(f"t{x}" for x in np.concatenate([body, rng.integers(30, 99, 50), body]))
    data = np.frombuffer(text.encode(), np.uint8)
    found = Words(data, np.array([0, len(data)]), 0, 1, NON_SPACE)
    h = found.hashes()
    start, at, runs = substring_dedup._anchors(found, h, 12, 4)
    whole = windows(h, 12)[start]
    anchor = {}
    for w, a, s in zip(whole.tolist(), at, start, strict=True):
        assert anchor.setdefault(w, (runs[a], a - s)) == (runs[a], a - s)
    assert len(np.unique(at)) < 0.4 * len(start)


def test_op5_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5_substring_dedup(spark, SF_SMALL).collect()}
    assert got == {i: (len(w), len(w) - len(k), sha(" ".join(k))) for i, (w, k) in brute.remove_repeated(rows, 20).items()}
    assert sum(x[1] for x in got.values())


# -- decontamination -------------------------------------------------------

def test_subsequence_is_the_textbook_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 90)).astype(np.uint64) for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == brute.subsequence(a.tolist(), b.tolist())


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(4)
    word = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("", "na", "so", "vi") for c in
            ("ban", "dor", "fel", "gim", "hul", "jap", "kes", "lom")]
    prose = lambda n: [rng.choice(word) for _ in range(n)]
    items = [prose(rng.randint(14, 60)) for _ in range(30)]
    docs, want = [], {}
    for i in range(300):
        text = prose(rng.randint(0, 300))
        if i % 10 == 0:
            k = i // 10
            part = list(items[k])
            if i % 20:  # a paraphrase keeps three words of four, and the ending
                part = [w for j, w in enumerate(part[:-5]) if j % 4 != 1] + part[-5:]
            at = rng.randint(0, len(text))
            text[at:at] = part
            want[i] = k
        docs.append((i, " ".join(text)))
    docs += [(900, None), (901, ""), (None, " ".join(items[0])), (902, " ".join(items[0]) + " " + " ".join(prose(50000)))]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([(k, " ".join(w[:-5]) + ". " + " ".join(w[-5:])) for k, w in enumerate(items)]
                                  + [(50, None), (51, ""), (52, "?!")], "item_id int, text string")
    out = decontaminate.contaminated(df, "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in out} == {*want.items(), (None, 0), (902, 0)}
    clean = decontaminate.drop_contaminated(df, "text", bench, "text")
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - set(want) - {None, 902}
    assert decontaminate.contaminated(df.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0
    assert decontaminate.contaminated(df, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0


def test_op4_query_holds_every_verbatim_copy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    exact = {(d.doc_id, b.item_id) for d in docs for b in items if b.text and d.text and b.text in d.text}
    got = {(r.doc_id, r.item_id): r for r in op4_decontaminate(spark, SF_SMALL).collect()}
    assert exact and exact <= set(got)
    assert all(r.covered >= decontaminate.PARAPHRASED for r in got.values())


def test_candidates_reach_brute_force_beyond_the_sample(spark, monkeypatch):
    """Recall of a space fitted on few of the documents."""
    monkeypatch.setattr(decontaminate, "SAMPLE_DOCS", 20)
    rng = random.Random(8)
    word = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [[rng.choice(word) for _ in range(rng.randint(16, 40))] for _ in range(20)]
    docs = []
    for i in range(400):
        body = [rng.choice(word) for _ in range(120)]
        if i % 4 == 0:  # leaked with words exchanged, so that runs of common words are short
            leak = [w if rng.random() < 0.85 else rng.choice(word) for w in texts[i % 20]]
            body[50:50] = leak
        docs.append((i, " ".join(body)))
    bench = [(k, " ".join(t)) for k, t in enumerate(texts)]
    items = decontaminate.items_of([t for _, t in bench])
    want = set()
    for i, text in docs:
        h = decontaminate._word_hashes(text)
        for item in items:
            m = len(item.words)
            for a in range(0, max(1, len(h) - 2 * m), m):
                part = h[a:a + 4 * m]
                covered = decontaminate.common_subsequence(item.words, part) / m
                if covered >= decontaminate.COPIED or (
                        covered >= decontaminate.PARAPHRASED and decontaminate.contains(part, item.answer)):
                    want.add((i, item.key))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text",
        spark.createDataFrame(bench, "item_id int, text string"), "item_id", "text").collect()}
    assert len(want) > 50 and len(got & want) >= 0.9 * len(want)


# -- toxicity --------------------------------------------------------------

def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(7)
    bad = [f"bad{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(3000):
        toxic = rng.random() < 0.2
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), 9))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    rows += [(-1, None, 9), (-2, "", 9), (None, "bad1 bad2 bad3", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, "doc_id", "text", "toxic")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, "doc_id", "text", model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    truth = {i: any(w.startswith("bad") for w in t.split()) for i, t, _ in rows[:3000]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i][1] == truth[i] for i in held]) > 0.97
    assert got[-1] == got[-2] and got[-1][1] == 0 and got[None][1] == 1
    nothing = toxicity.fit(docs, marks.limit(0), "doc_id", "text", "toxic")
    assert {r.predicted for r in toxicity.score(docs, "doc_id", "text", nothing).collect()} == {0}
    assert toxicity.score(docs.limit(0), "doc_id", "text", model).count() == 0


def test_toxicity_of_repeated_ids_in_any_order(spark):
    """Which text of a repeated id is learnt from does not hang on the order
    of the rows, and a text of a megabyte is a text like others."""
    rng = random.Random(9)
    rows = [(i % 600, " ".join(("bad" if i % 600 < 120 else "w") + str(rng.randrange(9)) for _ in range(3)), i % 3)
            for i in range(1800)] + [(601, "w1 w2 " * 170_000, 0), (602, None, 0), (602, "w3", 1)]
    marks = spark.createDataFrame([(i, int(i < 120)) for i in range(603)], "doc_id long, toxic int")
    models = []
    for parts, given in ((1, rows), (7, rows[::-1])):
        docs = spark.createDataFrame(given, "doc_id long, text string, positive int").repartition(parts)
        models.append(toxicity.fit(docs, marks, "doc_id", "text", "toxic"))
        got = toxicity.score(docs, "doc_id", "text", models[-1])
        assert got.count() == len(rows)
    assert models[0].words.size and all(np.array_equal(a, b) for a, b in zip(*models, strict=True))


def test_risk_estimate_stays_above_zero():
    """With all texts positive the unlabelled part is reversed, not driven
    below zero: weights stay finite and small."""
    texts = [np.array([1, 2], np.int32)] * 20
    model = toxicity.train(texts, texts, 0.5)
    assert np.isfinite(model.weights).all() and np.abs(model.bias).max() < 20


def test_op6_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    out = [r for r in op6_toxicity(spark, big).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    hit = [p for t, p in held if t]
    assert np.mean(hit) > 0.8 and np.mean([p for t, p in held if not t]) < 0.02


# -- language --------------------------------------------------------------

def test_phrases_equal_a_greedy_parse():
    rng = random.Random(9)
    sample = "".join(rng.choice("abc ") for _ in range(600))
    text = "".join(rng.choice("abcd ") for _ in range(700))
    who = language_id.Identifier((("x", sample.encode()),))
    data = np.frombuffer(text.encode(), np.uint8)
    sym, at = language_id.symbols(data, np.array([0, len(data)]))
    known = bytes(language_id.symbols(np.frombuffer(sample.encode(), np.uint8), np.array([0, len(sample)]))[0]).decode()
    got = who.entropies(data, np.array([0, len(data)]))[0, 0] * len(sym) / who.parsers[0].bits
    plain = bytes(sym).decode()
    cut = [plain[i:i + language_id.SEGMENT] for i in range(0, len(plain), language_id.SEGMENT)]
    assert round(got) == sum(brute.phrases(c, known) for c in cut)


def test_language_defined_cases(spark):
    samples = {"a": b"the cat sat on the mat and the dog ran " * 5, "b": b"les chats et le chien sont dans la maison " * 5}
    long = "the cat and the dog " * 20000
    rows = [(1, None), (2, ""), (3, "12 !? 3"), (4, "the dog and the cat"), (5, "le chien et la maison"), (6, long),
            (None, "the mat"), (7, "Жук")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, "doc_id", "text", samples).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (4, 5, 6, None)] == ["a", "b", "a", "a"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language_id.identify(df, "doc_id", "text", {}).collect()} == {"und"}
    kept = language_id.keep_identified(df, "text", samples, 7.0)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, None}
    assert language_id.identify(df.limit(0), "doc_id", "text", samples).count() == 0
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert language_id.sample(none, "doc_id", "lang", "text") == {}


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op10_language_id(spark, sf).collect()
    held = [truth[r.doc_id] == r.lang_pred for r in out if r.held_out]
    assert len(out) == len(truth) and np.mean(held) > 0.95


def test_suffix_automaton_of_arrow_slices():
    """Offsets of a sliced array are honoured."""
    who = language_id.Identifier((("a", b"abcabcabc"), ("b", b"xyzxyzxyz")))
    column = pa.array(["zzz", None, "abc", "xyz"]).slice(2)
    assert who.predict(column)[0] == ["a", "b"]
