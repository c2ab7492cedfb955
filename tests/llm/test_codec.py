import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tally.llm import sentencepiece_codec as codec_module
from tally.llm.queries import op1_sentencepiece

SF_SMALL = "/root/testdata/sf0.001"


MODEL = public_tokenizers.path("piece_bpe_32k.model")
ATOMS = ["a", "b", " ", "  ", "\n", "the", "é", "中", "𐍈", "▁", "\x00", "<s>", "</s>", "\t", "ﬁ", "�", "ing", "=", "1",
         "<0x41>", "\xa0", "　"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return codec_module.Codec(f.read())


def texts(n):
    rng = random.Random(5)
    fixed = ["", " ", "  ", "▁", "\n", " a ", "a ", "\x00", "x" * 3000, "word " * 2000]
    return fixed + ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_text_equal_the_library(codec, library):
    for text in texts(2000):
        table = codec.learn([codec.chunks(text)])
        ids = codec.ids(text, table).tolist()
        assert ids == library.encode(text)
        assert codec.decode(ids) == library.decode(ids)


def test_decode_of_any_ids(codec, library):
    rng = random.Random(6)
    for top in (32000, 259):
        for _ in range(1000):
            ids = [rng.randrange(3, top) for _ in range(8)]
            assert codec.decode(ids) == library.decode(ids)
    assert codec.decode([1, 2]) == ""
    with pytest.raises(ValueError):
        codec.decode([32000])


def test_spans_cover_the_source(codec):
    for text in texts(1000):
        raw = text.encode("utf-8")
        table = codec.learn([codec.chunks(text)])
        ids, begins, ends = codec.spans(text, table)
        slow = codec._aligned(text, ids) if len(ids) else (begins, ends)
        assert (list(begins), list(ends)) == (list(slow[0]), list(slow[1]))
        at = 0
        for i, b, e in zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True):
            assert b <= at or b == at
            if codec.byte_values[i] < 0 and b < e:
                surface = raw[b:e].decode("utf-8").replace("▁", " ")
                assert codec.surfaces[i].endswith(surface)
            at = e
        assert at == len(raw)


def test_character_map_longest_prefix():
    """A hand-made double array with the keys "a" -> "x" and "ab" -> "yz"."""
    pool = b"x\0yz\0"
    units = [0] * 1024

    def link(place, label, offset, leaf):
        units[place] = (offset << 10) | (leaf << 8) | label

    units[0] = 1 << 10  # root's children from 1
    a = 1 ^ ord("a")
    link(a, ord("a"), a ^ 256, True)  # value at 256, child b at 256 ^ b
    units[256] = 0x80000000 | 0
    b = 256 ^ ord("b")
    link(b, ord("b"), b ^ 600, True)
    units[600] = 0x80000000 | 2
    blob = (len(units) * 4).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + pool
    table = codec_module.CharacterMap(blob)
    assert table.longest(b"ab", 0) == (2, b"yz")
    assert table.longest(b"ac", 0) == (1, b"x")
    assert table.longest(b"cab", 1) == (2, b"yz")
    assert table.longest(b"c", 0) is None
    assert codec_module.CharacterMap(b"").longest(b"a", 0) is None


def test_alignment_through_a_map(codec):
    class Fake:
        units = (1,)

        def longest(self, raw, at):
            return (3, b"fi") if raw[at:at + 3] == "ﬁ".encode() else None

    with open(MODEL, "rb") as f:
        other = codec_module.Codec(f.read())
    other.map = Fake()
    text = "ﬁnd é"
    table = other.learn([other.chunks(text)])
    ids, begins, ends = other.spans(text, table)
    assert ids.tolist() == codec.ids("find é", codec.learn([codec.chunks("find é")])).tolist()
    assert begins[0] == 0 and ends[-1] == len(text.encode())


def test_encode_decode_dataframe(spark, library):
    rows = [(1, "Hello  wörld\n中", "x"), (2, None, "y"), (3, "", "z"), (None, "a", "n"), (1, "Hello  wörld\n中", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("begins", F.lit(1))
    out = sorted(codec_module.encode(df, "doc_id", "text", MODEL).collect(), key=str)
    got = {r.doc_id: r for r in out}
    assert len(out) == 5
    assert got[1].ids == library.encode("Hello  wörld\n中", add_eos=True)
    assert got[2].ids == got[3].ids == [library.eos_id()] and got[3].ends == [0]
    back = codec_module.decode(spark.createDataFrame([(1, got[1].ids), (2, None), (3, [])], "k long, v array<int>"),
                               "k", "v", MODEL).collect()
    assert {r.k: r.text for r in back} == {1: "Hello  wörld\n中", 2: None, 3: ""}
    assert codec_module.encode(df.limit(0), "doc_id", "text", MODEL).count() == 0


def test_query_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in op1_sentencepiece(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        sha = hashlib.sha256
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids)).encode()).hexdigest(), sha(library.decode(ids).encode()).hexdigest())
