"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix replacement through the model's
compiled character map (a double-array trie; empty for identity models).
Every normalised character remembers the bytes of the source it came from,
so each piece is projected back to a byte span of the original text.  BPE
models never join a piece across the start of a white-space run, so the
normalised text is cut there and every different chunk is segmented once
per worker by the sentencepiece library; chunks repeat far more often than
texts.  Nothing is shuffled: one Arrow pass over the rows.

Defined results: a null text encodes like the empty text (end id only); a
null id list decodes to null; ids of the control and unknown kind decode as
the model defines (nothing, and its unknown surface); other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import lean, pieces

MARK = "▁"
#: Different chunks, and characters in them, that a worker keeps before the
#: older generation is forgotten (a cache: results do not depend on it).
CACHE_CHUNKS, CACHE_CHARS = 50_000, 2_000_000
#: Rows of a batch that are encoded and sent on at once.
ROWS = 500
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

PIECES = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("begins", T.ArrayType(T.LongType(), False), False),
    T.StructField("ends", T.ArrayType(T.LongType(), False), False),
])


class CharacterMap:
    """Compiled character map of a model: longest prefix to replacement.

    The blob holds the byte length of a double-array trie, the trie's
    32-bit units and a pool of zero-terminated replacements.
    """

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at`` and what replaces
        it, or None."""
        units = self.units
        if not units:
            return None
        node, best = units[0], None
        place = _offset(node)
        for i in range(at, len(text)):
            place ^= text[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != text[i]:
                break
            place ^= _offset(unit)
            if unit >> 8 & 1:
                start = units[place] & 0x7FFFFFFF
                best = (i + 1 - at, start)
        if best is None:
            return None
        return best[0], self.pool[best[1]:self.pool.index(b"\0", best[1])]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Codec:
    """One model: normaliser, chunk segmentation and piece surfaces."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE:
            raise ValueError("only BPE models are supported")
        if model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("white space must be an escaped prefix")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        if any(MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type == NORMAL):
            raise ValueError("a piece joins two words: chunks cannot be cut at spaces")
        if model.HasField("denormalizer_spec") and model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("denormaliser maps are not supported")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        # The library segments; its own normaliser is switched to identity,
        # as chunks come normalised already.
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix, spec.remove_extra_whitespaces = True, False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.kinds = [p.type for p in model.pieces]
        self.byte_values = [int(p.piece[3:5], 16) if p.type == BYTE else -1 for p in model.pieces]
        unknown_surface = model.trainer_spec.unk_surface
        self.surfaces = ["" if p.type == CONTROL else unknown_surface if p.type == UNKNOWN
                         else p.piece.replace(MARK, " ") for p in model.pieces]
        self.byte_ids = frozenset(i for i, b in enumerate(self.byte_values) if b >= 0)
        #: Bytes of source text that a piece stands for where spaces are the
        #: only thing normalised.
        self.widths = np.array([1 if b >= 0 else len(x.encode("utf-8"))
                                for b, x in zip(self.byte_values, self.surfaces, strict=True)])
        self.spelt = self.widths < 0  # by id: is it a byte piece
        self.spelt[list(self.byte_ids)] = True
        self.decimals = [str(i) for i in range(len(self.kinds))]
        self.mark_id = self.library.piece_to_id(MARK)
        self.end_id = self.library.eos_id()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.weight = 0

    # -- normalisation -----------------------------------------------------

    def plain(self, text: str) -> bool:
        """Whether normalising ``text`` only escapes its spaces."""
        return not self.map.units and not self.squeeze and MARK not in text

    def normalise(self, text: str) -> tuple[str, list[int], list[int]]:
        """Normalised text (spaces still spaces, dummy prefix included) and,
        for each of its characters, the source byte span it stands for.  The
        dummy prefix stands for no bytes."""
        raw = text.encode("utf-8")
        chars: list[str] = []
        begins: list[int] = []
        ends: list[int] = []
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit:
                size, new = hit[0], hit[1].decode("utf-8")
            else:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at:at + size].decode("utf-8")
            for char in new:
                chars.append(" " if char == MARK else char)
                begins.append(at)
                ends.append(at + size)
            at += size
        if self.squeeze:
            keep = [i for i, c in enumerate(chars) if c != " " or (i and chars[i - 1] != " ")]
            if keep and chars[keep[-1]] == " ":
                keep.pop()
            chars, begins, ends = ([x[i] for i in keep] for x in (chars, begins, ends))
        if self.dummy and chars:
            chars.insert(0, " ")
            begins.insert(0, 0)
            ends.insert(0, 0)
        return "".join(chars), begins, ends

    def chunks(self, text: str) -> list[str]:
        """Chunks of the normalised text, each without the one space that
        every chunk starts with."""
        if self.plain(text) and self.dummy:
            if not text:
                return []
            if "  " not in text and text[0] != " " and text[-1] != " ":
                return text.split(" ")
            normal = " " + text
        else:
            normal = self.normalise(text)[0]
        if normal and normal[0] != " ":
            raise ValueError("models without a dummy prefix are not supported")
        return [c[1:] for c in re.findall(" +[^ ]*", normal)]

    # -- segmentation ------------------------------------------------------

    def learn(self, cut: list[list[str]]) -> dict[str, bytes]:
        """Segment the chunks not yet known; entries are the ids as packed
        32-bit numbers.  Returns the table that holds every chunk of ``cut``;
        what was used least lately is forgotten between calls."""
        if len(self.young) > CACHE_CHUNKS or self.weight > CACHE_CHARS:
            self.old, self.young = (self.young if self.weight <= CACHE_CHARS else {}), {}
            self.weight = 0
        young, old = self.young, self.old
        needed = set().union(*cut).difference(young)
        missing = []
        for chunk in needed:
            entry = old.get(chunk)
            if entry is None:
                missing.append(chunk)
                self.weight += len(chunk)
            else:
                young[chunk] = entry
        for chunk, ids in zip(missing, self.library.encode(missing, num_threads=1), strict=True):
            ids = ids or [self.mark_id]  # a lone space at the end of a text
            young[chunk] = np.array(ids, np.int32).tobytes()
        return young

    def surface(self, ids: list[int]) -> str:
        """Concatenated surfaces; runs of byte pieces are UTF-8, each broken
        byte the replacement character."""
        if self.byte_ids.isdisjoint(ids):
            return "".join(map(self.surfaces.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if self.byte_values[i] >= 0:
                run.append(self.byte_values[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.surfaces[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of an id list; the dummy prefix of the first piece goes."""
        for i in (min(ids, default=0), max(ids, default=0)):
            if not 0 <= i < len(self.kinds):
                raise ValueError(f"id {i} is outside the vocabulary")
        text = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if self.dummy and first is not None and self.surfaces[first].startswith(" ") \
                and self.byte_values[first] < 0:
            text = text[1:]
        return text

    def ids(self, text: str, table: dict[str, bytes], chunks: list[str] | None = None) -> np.ndarray:
        """Ids of a text (``chunks``, where they are known already)."""
        chunks = self.chunks(text) if chunks is None else chunks
        return np.frombuffer(b"".join(map(table.__getitem__, chunks)), np.int32)

    def spans(self, text: str, table: dict[str, bytes],
              chunks: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text and each piece's byte span in the original.  Byte
        pieces of one character share that character's span."""
        ids = self.ids(text, table, chunks)
        if not self.plain(text) or (ids == self.library.unk_id()).any():
            return ids, *self._aligned(text, ids)
        end = np.cumsum(self.widths[ids]) - int(self.dummy)
        begin = np.maximum(end - self.widths[ids], 0)
        spelt = np.flatnonzero(self.spelt[ids])
        if len(spelt):
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            leads = np.flatnonzero((raw & 0xC0) != 0x80)
            char = np.searchsorted(leads, begin[spelt], side="right") - 1
            begin[spelt], end[spelt] = leads[char], np.append(leads, len(raw))[char + 1]
        return ids, begin, end

    def _aligned(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans through the normaliser's character alignment."""
        normal, begin, end = self.normalise(text)
        begins, ends = [], []
        at = run = 0  # run: bytes still to come of a character spelt in bytes
        for i in ids.tolist():
            if self.byte_values[i] >= 0:
                run = run or len(normal[at].encode("utf-8"))
                begins.append(begin[at])
                ends.append(end[at])
                run -= 1
                at += run == 0
                continue
            size = len(self.surfaces[i]) if self.kinds[i] != UNKNOWN else 1
            begins.append(begin[at])
            ends.append(end[at + size - 1])
            at += size
        return np.array(begins, np.int64), np.array(ends, np.int64)


def _utf8(run: bytearray) -> str:
    out, at = [], 0
    while at < len(run):
        for size in (4, 3, 2, 1):
            part = bytes(run[at:at + size])
            if len(part) == size:
                try:
                    char = part.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if len(char) == 1:
                    out.append(char)
                    at += size
                    break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def _codec(proto: bytes) -> Codec:
    return Codec(proto)


def _shared(df: DataFrame, model_path: str):
    """The model file's bytes (a fixed, small vocabulary) for all executors."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _groups(texts: list[str], limit: int = 1 << 21) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _encoded(codec: Codec, texts: list[str]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Ids, begins and ends of every text, group by group, the end id last."""
    for group in _groups(texts):
        cut = [codec.chunks(t) for t in group]
        table = codec.learn(cut)
        out = []
        for text, chunks in zip(group, cut, strict=True):
            last = (codec.end_id, *[len(text.encode("utf-8"))] * 2)
            out.append(tuple(np.append(x, z) for x, z in zip(codec.spans(text, table, chunks), last, strict=True)))
        yield out


def encode(df: DataFrame, id_col: str, text_col: str, model_path: str) -> DataFrame:
    """One row per input row: the id column, ``ids`` with the end id last,
    and ``begins``/``ends``, each piece's byte span in the original text (the
    end id has the empty span behind the last byte)."""
    proto = _shared(df, model_path)
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], *PIECES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(proto.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            done = 0
            for out in _encoded(codec, texts):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(done, len(out)),
                    *[_lists([x[k] for x in out], kind) for k, kind in enumerate((np.int32, np.int64, np.int64))],
                ], names=[id_col, "ids", "begins", "ends"])
                done += len(out)

    return rows.mapInArrow(run, schema)


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    flat = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def decode(df: DataFrame, id_col: str, ids_col: str, model_path: str) -> DataFrame:
    """One row per input row: the id column and ``text``."""
    proto = _shared(df, model_path)
    rows = df.select(F.col(id_col), F.col(ids_col).alias("_ids"))
    schema = T.StructType([rows.schema[0], T.StructField("text", T.StringType())])

    def run(batches):
        codec = _codec(proto.value)
        for batch in batches:
            out = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())],
                                             names=[id_col, "text"])

    return rows.mapInArrow(run, schema)


def round_trip(df: DataFrame, id_col: str, text_col: str, model_path: str, with_ids: bool = False) -> DataFrame:
    """:func:`encode`, and :func:`decode` of its ids, in one pass:
    ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space),
    ``decoded_sha256`` (of the text decoded from the ids), ``spans_sha256``
    (begins, then ends, as little-endian 64-bit numbers), and on request the
    ``ids`` themselves; the end id counts."""
    proto = _shared(df, model_path)
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType(), False),
                           T.StructField("ids_sha256", T.StringType(), False),
                           T.StructField("decoded_sha256", T.StringType(), False),
                           T.StructField("spans_sha256", T.StringType(), False)]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(proto.value)
        spell = codec.decimals.__getitem__
        for batch in (part for whole in batches for part in pieces(whole, ROWS)):
            done = 0
            for out in _encoded(codec, [t or "" for t in batch.column(1).to_pylist()]):
                digests: list[list[str]] = [[], [], []]
                for ids, begins, ends in out:
                    plain = ids.tolist()
                    parts = (" ".join(map(spell, plain)).encode(), codec.decode(plain).encode("utf-8"),
                             np.concatenate([begins, ends]).astype("<i8").tobytes())
                    for digest, part in zip(digests, parts, strict=True):
                        digest.append(hashlib.sha256(part).hexdigest())
                columns = [batch.column(0).slice(done, len(out)), pa.array([len(x[0]) for x in out], pa.int64()),
                           *[pa.array(x, pa.string()) for x in digests]]
                if with_ids:
                    columns.append(_lists([x[0] for x in out], np.int32))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                done += len(out)

    return rows.mapInArrow(lean(run, _codec.cache_clear), schema)
