import hashlib
import random
import re
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tally.llm import decontaminate, language_id, sentencepiece_codec, substring_dedup
from tally.llm.queries import PIECE_MODEL, op1_sentencepiece, op10_language_id

SF_SMALL = "/root/testdata/sf0.001"

VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("", "na", "so", "vi") for c in
              ("ban", "dor", "fel", "gim", "hul", "jap", "kes", "lom")]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


# -- decontamination -------------------------------------------------------

def test_item_in_a_third_of_all_documents(spark):
    rng = random.Random(12)
    items = [[f"item{k}word{j}" for j in range(30)] for k in range(20)]
    docs = []
    for i in range(300):
        rare = [f"rare{i}x{j}" for j in range(60)]  # outweighs words of a third of all documents
        docs.append((i, rare[:30] + (items[0] if i % 3 == 0 else prose(rng, 30)) + rare[30:]))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id int, text string")
    out = decontaminate.contaminated(df, "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(i, 0) for i in range(0, 300, 3)}
    assert all(r.covered == 1.0 and r.cosine > 0 for r in out)
    clean = decontaminate.drop_contaminated(df, "text", bench, "text")
    assert {r.doc_id for r in clean.collect()} == {i for i in range(300) if i % 3}


def test_copy_beside_a_better_looking_place(spark):
    rng = random.Random(13)
    items = [prose(rng, 15) + [f"item{k}word{j}" for j in range(10)] + prose(rng, 15) for k in range(10)]
    decoy, copy = [items[0][20]] * 40, items[0]  # one rare word again and again
    docs = [(0, decoy + prose(rng, 45) + copy), (1, copy + prose(rng, 45) + decoy), (2, decoy),
            (3, decoy + (prose(rng, 30) + decoy) * 20 + prose(rng, 45) + copy)]
    docs += [(i, prose(rng, 200)) for i in range(4, 100)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id int, text string")
    out = decontaminate.contaminated(df, "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id, r.covered) for r in out} == {(0, 0, 1.0), (1, 0, 1.0), (3, 0, 1.0)}


# -- codec -----------------------------------------------------------------

def test_digests_are_of_encoded_spans_and_decoded_ids(spark):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pieces = sentencepiece_codec.encode(docs, "doc_id", "text", PIECE_MODEL)
    text = sentencepiece_codec.decode(pieces, "doc_id", "ids", PIECE_MODEL)
    back = {r.doc_id: sha(r.text.encode()) for r in text.collect()}
    want = {r.doc_id: (sha(np.array(r.begins + r.ends, "<i8").tobytes()), back[r.doc_id]) for r in pieces.collect()}
    got = {r.doc_id: (r.spans_sha256, r.decoded_sha256) for r in op1_sentencepiece(spark, SF_SMALL).collect()}
    assert got == want
    odd = docs.select("doc_id", F.lit("a \u2581 b  \u00e9\U00010348").alias("text")).limit(1)
    row = sentencepiece_codec.encode(odd, "doc_id", "text", PIECE_MODEL).first()
    both = sentencepiece_codec.round_trip(odd, "doc_id", "text", PIECE_MODEL, with_ids=True).first()
    assert both.ids == row.ids and both.spans_sha256 == sha(np.array(row.begins + row.ends, "<i8").tobytes())


# -- language ID -----------------------------------------------------------

def test_workers_forget_codec_and_models_after_a_task(spark):
    rng = random.Random(19)
    rows = [(i, "xy"[i % 2], " ".join(prose(rng, 30))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(16)
    assert sentencepiece_codec.round_trip(docs, "doc_id", "text", PIECE_MODEL, with_ids=True).count() == 800
    models = language_id.learn(docs, "doc_id", "lang", "text")
    assert language_id.keep_identified(docs, "text", models, corpus_pipeline.MAX_BITS).count() == 800

    def held(batches):
        for batch in batches:
            n = sentencepiece_codec._codec.cache_info().currsize + language_id._identifier.cache_info().currsize
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 32, 1, 32).mapInArrow(held, "n long").collect()} == {0}


def test_short_clean_documents_stay(spark):
    rng = random.Random(14)
    sample = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(8000))[:39000]
    rows = [(1, "A."), (2, "Be."), (3, "ab. c"), (4, "Жук"), (5, "жxqжzq" * 50), (6, "12"), (7, None), (8, sample[:3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = language_id.keep_identified(df, "text", {"a": sample.encode()}, corpus_pipeline.MAX_BITS)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 8}


def test_sample_holds_long_texts_and_different_ones(spark):
    rows = [(i, "long", f"é{i} " * 2000) for i in range(9)]
    rows += [(i, "copied", "the same text " * 9) for i in range(500)] + [(i, "copied", f"other {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language_id.sample(df, "doc_id", "lang", "text")
    held_out = {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {x for x in got["copied"].decode().split("\n") if x} == {
        "the same text " * 9, *(f"other {i}" for i in range(30) if i not in held_out)}
    long = [x for x in got["long"].decode().split("\n") if x]
    assert len(long) == len({i for i in range(9)} - held_out)
    assert all(4090 < len(x.encode()) <= language_id.SAMPLE_TEXT_BYTES for x in long)


def test_models_count_every_text_whole(spark):
    rng = random.Random(16)
    rows = [(i, "x" if i % 2 else "y", " ".join(prose(rng, 30))) for i in range(400)]
    # what stands behind the first 4 KB of one text, and words that no single text repeats
    rows += [(1001, "x", "filler " * 700 + "Behind " * 500), (1002, "y", "a1Béc--d " + "漢字" * 9 + "漢")]
    rows += [(1003, None, "unlabelled"), (None, "x", "nameless"), (1004, "x", None), (1005, "z", "12 !?")]
    rows += [(i, "z", "heldout") for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = {}
    for i, lang, text in rows:
        if i is None or lang is None or not text or zlib.crc32(str(i).encode()) % 5 == 0:
            continue
        for word in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())):
            chars = word.decode()
            for x in [word] if len(word) <= 32 else [chars[k:k + 2].encode() for k in range(0, len(chars), 2)]:
                want[lang, x] = want.get((lang, x), 0) + 1
    got = language_id.word_counts(df.where(language_id.fold("doc_id") != 0), "lang", "text").collect()
    assert {(r.lang, bytes(r.word)): r.n for r in got} == want and len(got) == len(want)
    models = language_id.learn(df, "doc_id", "lang", "text")
    assert set(models) == {lang for lang, _ in want}
    for lang, model in models.items():
        ranked = sorted((-n, w) for (k, w), n in want.items() if k == lang)
        assert model == b" " + b"".join(w + b" " for _, w in ranked)
    assert b" behind " in models["x"]


def test_model_of_many_words_keeps_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL_WORDS", 20)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(i, "x", " ".join(words[:1 + i % 100])) for i in range(1000)]  # the first words are the most frequent
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert language_id.learn(df, "doc_id", "lang", "text")["x"].split() == [w.encode() for w in words[:20]]
    monkeypatch.setattr(language_id, "MODEL_BYTES", 21)
    assert language_id.learn(df, "doc_id", "lang", "text")["x"].split() == [w.encode() for w in words[:5]]


def test_language_of_words_outside_any_sample(spark, tmp_path):
    """Texts whose beginnings say nothing: a model of their first 4 KB does
    not tell the languages apart."""
    rng = random.Random(17)
    own = {"x": [w + "x" for w in VOCABULARY[:60]], "y": [w + "y" for w in VOCABULARY[60:120]]}
    rows = [(i, lang, "same words first " * 260 + " ".join(rng.choices(own[lang], k=40)))
            for i, lang in enumerate(rng.choices("xy", k=200))]
    rows += [(1000 + i, lang, " ".join(rng.choices(own[lang], k=40))) for i, lang in enumerate("xy" * 40)
             if zlib.crc32(str(1000 + i).encode()) % 5 == 0]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    truth = {r[0]: r[1] for r in rows}
    got = op10_language_id(spark, str(tmp_path)).collect()
    short = [r for r in got if r.doc_id >= 1000]
    assert short and all(r.held_out and r.lang_pred == truth[r.doc_id] for r in short)


def test_parse_holds_little_beside_its_texts():
    rng = random.Random(18)
    texts = [" ".join(prose(rng, 400)) for _ in range(2000)]
    identifier = language_id.Identifier((("x", texts[0].encode()), ("y", b"0 else")))
    column = pa.array(texts + ["", None, "12 !?"])
    tracemalloc.start()
    try:
        keep = identifier.explained(column, corpus_pipeline.MAX_BITS)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert keep.tolist() == [True] * len(texts) + [False] * 3
    assert peak < 24 << 20


def test_unseen_symbols_are_counted_per_text():
    identifier = language_id.Identifier((("x", b" abc abd "), ("y", b" xyz ")))
    texts = ["abc", "", "xqx abz", "zzz" * 200, "q"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    _, unseen, _ = identifier.parse(np.frombuffer(data, np.uint8), bounds)
    assert unseen.tolist() == [[sum(c not in model for c in t) for model in (" abcd", " xyz")] for t in texts]


# -- line dedup ------------------------------------------------------------

def test_source_a_third_of_which_is_one_document(spark):
    one = "first line of it\nsecond line\nthird line"
    rows = [(i, one if i % 3 == 0 else f"menu\ntext {i}", "en", "s", 0) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_site_lines(spark, df, SF_SMALL).collect()}
    assert out == {i: one if i % 3 == 0 else f"text {i}" for i in range(30)}


# -- substring dedup -------------------------------------------------------

def test_repeated_id_whose_other_text_is_a_copy(spark):
    rng = random.Random(15)
    a, b = prose(rng, 40), prose(rng, 30)
    # id 2 is a copy of 1 and a text of its own, which repeats 1 at its end and which 3 repeats
    rows = [(1, a), (2, a), (2, b + a[:25]), (3, b)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_removed
           for r in substring_dedup.remove_repeated(df, "doc_id", "text", 20).collect()}
    assert got == {(1, 40): 0, (2, 40): 40, (2, 55): 25, (3, 30): 30}
