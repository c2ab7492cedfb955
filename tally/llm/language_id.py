"""Language identification by cross-parsing entropy.

For every language the words of all its labelled texts are counted, each text
whole (:func:`learn`).  The most frequent words, one after the other, are what
the language is known by: a suffix automaton is built over them.  A text is
parsed greedily into the longest phrases that occur there; few phrases mean
that the words predict the text well.  The number of phrases times the bits of
one pointer into the words, per symbol, estimates the cross entropy, and the
language with the lowest estimate wins.

Symbols are the text's UTF-8 bytes with A-Z in lower case and every run of
ASCII non-letters as one blank.  Phrases end at segment borders
(``SEGMENT`` symbols, counted from the text's start), so all segments of a
batch are parsed in lockstep through dense transition tables: a text of any
length costs the same per byte, and nothing is shuffled.

The size of a model is fixed, what it is learnt from is not: every word of
every labelled text is counted by the executors, and only the ``MODEL_WORDS``
most frequent words of a language reach the driver (equal counts in byte
order), of which the first ``MODEL_BYTES`` make the model.  A run of letters
longer than ``WORD_BYTES``, as in scripts without blanks, is counted by its
pieces of ``PIECE_CHARS`` characters.

Defined results: a null text or one without a letter is ``und`` with score 0;
with nothing to learn from everything is ``und``; equal estimates go to the
language first in order; a text of no known symbol has score 0 as well; rows
with a null id or language are never learnt from, and a null id is not held
out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import lean, pieces, release
from .words import LOWER, Words, byte_class, slices, text_buffers

#: Size of a language's model, not of what it is learnt from.
MODEL_WORDS, MODEL_BYTES = 1 << 13, 40_000
WORD_BYTES, PIECE_CHARS = 32, 2
#: Parts of a language's words, ranked by themselves before they meet.
PARTS = 32
SAMPLE_TEXTS, SAMPLE_TEXT_BYTES, SAMPLE_BYTES = 64, 4096, 40_000
SEGMENT = 256
#: Phrases that any text may take: the first, and one where two words of the model meet.
FREE = 2
UNDETERMINED = "und"
#: Bytes per lockstep pass, and rows of a batch that are parsed and sent on at
#: once: with the models' tables they are what a worker holds beside its input.
_PASS, _ROWS = 1 << 20, 500
_BLANK = 0x20
_LETTER = byte_class(rb"[A-Za-z\x80-\xFF]")
_SYMBOL = np.where(_LETTER, LOWER, _BLANK).astype(np.uint8)


def fold(id_col: str) -> Column:
    """Remainder of the id's checksum by which rows are held out (0)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _learnt_words(found: Words) -> None:
    """Cut the long words of ``found`` into pieces (in place; order is lost)."""
    long = found.ends - found.starts > WORD_BYTES
    if not long.any():
        return
    starts, ends = found.starts[long], found.ends[long]
    leads = np.flatnonzero((found.data & 0xC0) != 0x80)  # first bytes of characters
    lo, hi = np.searchsorted(leads, starts), np.searchsorted(leads, ends)
    per = -(-(hi - lo) // PIECE_CHARS)
    owner = np.repeat(np.arange(len(starts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = leads[lo[owner] + nth * PIECE_CHARS]
    end = ends[owner]
    inner = nth + 1 < per[owner]
    end[inner] = begin[1:][inner[:-1]]
    found.starts = np.concatenate([found.starts[~long], begin])
    found.ends = np.concatenate([found.ends[~long], end])


def word_counts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``lang``, ``word`` (bytes of letters, A-Z in lower case) and ``n``, how
    often it stands in all texts of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                found = Words(data, offsets, lo, hi, _LETTER, LOWER)
                _learnt_words(found)
                if not len(found.starts):
                    continue
                lang = code[lo + np.searchsorted(found.bounds, found.starts, side="right") - 1]
                order = np.lexsort((h := found.hashes(), lang))
                h, lang = h[order], lang[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])))
                at = order[first]
                size = found.ends[at] - found.starts[at]
                ends = np.cumsum(size)
                place = np.repeat(found.starts[at] - (ends - size), size) + np.arange(ends[-1])
                words = pa.Array.from_buffers(pa.binary(), len(at), [
                    None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(found.data[place])])
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(lang[first])), words,
                    pa.array(np.diff(np.append(first, len(h))).astype(np.int64))], names=["lang", "word", "n"])

    return (df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
            .mapInArrow(lean(count), "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def learn(df: DataFrame, id_col: str, lang_col: str, text_col: str) -> dict[str, bytes]:
    """The models: language to its most frequent words, counted over all
    labelled texts that are not held out."""
    counts = word_counts(df.where(fold(id_col) != 0), lang_col, text_col)
    # parts first, so that no task ranks more than PARTS * MODEL_WORDS words of a language
    first = [F.col("n").desc(), "word"]
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS))
    top = (counts.withColumn("part", part)
           .withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*first)))
           .where(F.col("r") <= MODEL_WORDS)
           .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*first)))
           .where(F.col("r") <= MODEL_WORDS).select("lang", "r", "word").toArrow())
    ranked: dict[str, list[tuple[int, bytes]]] = {}
    for lang, r, word in zip(*(top.column(c).to_pylist() for c in ("lang", "r", "word")), strict=True):
        ranked.setdefault(lang, []).append((r, word))
    out = {}
    for lang, words in ranked.items():
        text = b" "
        for _, word in sorted(words):
            if len(text) + len(word) >= MODEL_BYTES:
                break
            text += word + b" "
        out[lang] = text
    return out


def sample(df: DataFrame, id_col: str, lang_col: str, text_col: str) -> dict[str, bytes]:
    """A bounded sample in place of the models, for a quick look: at most
    ``SAMPLE_TEXTS`` different beginnings of texts a language, of
    ``SAMPLE_TEXT_BYTES`` bytes at most (shorter texts whole, a character cut
    in two left out), in hash order, and of these up to ``SAMPLE_BYTES``.  No
    registered query learns from it."""
    rows = (df.where((fold(id_col) != 0) & F.col(lang_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
            .select("lang", F.substring("text", 1, SAMPLE_TEXT_BYTES).alias("text"))
            .where(F.octet_length("text") > 0).withColumn("h", F.xxhash64("text")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = rows.select("lang", "h").distinct().withColumn("r", turn).where(F.col("r") <= SAMPLE_TEXTS)
    # copies of what was picked are combined before they move
    picked = (rows.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "r")
              .agg(F.min("text").alias("text")).orderBy("lang", "r").collect())
    out: dict[str, bytes] = {}
    for row in picked:
        have = out.get(row["lang"], b"")
        new = bytes(row["text"]).decode("utf-8", "ignore").encode("utf-8")
        if len(have) + len(new) < SAMPLE_BYTES:
            out[row["lang"]] = have + b"\n" + new
    return out


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a buffer of texts and the texts' new bounds."""
    sym = _SYMBOL[data]
    blank = sym == _BLANK
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[starts] = True
    at = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return sym[keep], at[bounds]


class Parser:
    """Suffix automaton of one model's text as a dense table.

    ``table[state * width + class]`` is the next state; 0 means that no
    phrase of that text goes on that way.  Class 0 pads and stays.
    """

    def __init__(self, text: np.ndarray, classes: np.ndarray, width: int):
        step: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in classes[text].tolist():
            cur = len(step)
            step.append({})
            link.append(1)
            length.append(length[last] + 1)
            p = last
            while p and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        # two bytes a state where they do: the tables are most of what a worker holds
        table = np.zeros((len(step), width), np.uint16 if len(step) <= 1 << 16 else np.int32)
        for state, edges in enumerate(step):
            if edges:
                table[state, list(edges)] = list(edges.values())
        table[:, 0] = np.arange(len(step))
        self.first = table[1].astype(np.int64)  # padding stays at the root
        self.unseen = (self.first == 0).astype(np.int64)  # such a symbol is a phrase of its own
        self.first[self.first == 0] = 1
        self.table, self.width = table.ravel(), width
        self.bits = float(np.log2(max(len(text), 2)))

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Phrases of each segment; ``columns[t]`` holds the t-th class of all
        segments."""
        n = columns.shape[1]
        state = np.ones(n, np.int64)
        count = np.zeros(n, np.int64)
        for symbol in columns:
            symbol = symbol.astype(np.int64)
            new = self.table[state * self.width + symbol]
            stop = new == 0
            count += (stop & (state != 1)) + self.unseen[symbol]
            state = np.where(stop, self.first[symbol], new)
        return count + (state != 1)  # the phrase that the segment's end closes


class Identifier:
    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in samples]
        texts = []
        for _, raw in samples:
            data = np.frombuffer(raw, np.uint8)
            texts.append(symbols(data, np.array([0, len(data)]))[0])
        used = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint8)
        width = len(used) + 2  # padding, and one class for unseen symbols
        self.classes = np.full(256, width - 1, np.uint8)  # at most 255 byte values occur in UTF-8
        self.classes[used] = np.arange(1, len(used) + 1)
        self.parsers = [Parser(t, self.classes, width) for t in texts]

    def entropies(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits per symbol, one row per text and one column per language."""
        found, _, size = self.parse(data, bounds)
        return found * [p.bits for p in self.parsers] / np.maximum(size, 1)[:, None]

    def parse(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases, and of these the unseen symbols, one row per text and one
        column per language; symbols of each text."""
        sym, at = symbols(data, bounds)
        size = np.diff(at)
        out = np.zeros((len(size), len(self.langs)))
        unseen = np.zeros_like(out)
        per = -(-size // SEGMENT)  # segments of each text
        total = int(per.sum())
        if not total or not self.langs:
            return out, unseen, size
        owner = np.repeat(np.arange(len(size)), per)
        start = at[:-1][owner] + (np.arange(total) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
        length = np.minimum(at[1:][owner] - start, SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        classes = np.append(self.classes[sym], np.uint8(0))
        columns = np.zeros((SEGMENT, total), np.uint8)
        for t in range(int(length[0])):
            live = int(np.searchsorted(-length, -t, side="left"))
            columns[t, :live] = classes[start[:live] + t]
        for k, parser in enumerate(self.parsers):
            out[:, k] = np.bincount(owner, parser.phrases(columns[:int(length[0])]), len(size))
            places = np.flatnonzero(parser.unseen.astype(bool)[classes[:-1]])
            unseen[:, k] = np.diff(np.searchsorted(places, at))
        return out, unseen, size

    def explained(self, column: pa.Array, max_bits: float) -> np.ndarray:
        """Whether a text is in a learnt language: it has a letter, and its
        phrases cost at most ``max_bits`` per symbol in one of the languages,
        not counting the first ``FREE`` phrases (of known symbols).  A pointer
        costs more than a few symbols may, whatever they are, so only phrases
        beyond these are evidence."""
        data, offsets = text_buffers(column)
        keep = np.zeros(len(column), bool)
        if not self.langs:
            return keep
        bits = np.array([p.bits for p in self.parsers])
        for lo, hi in slices(offsets, _PASS):
            found, unseen, size = self.parse(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            cost = (found - np.minimum(found - unseen, FREE)) * bits
            keep[lo:hi] = (cost <= max_bits * size[:, None]).any(axis=1)
        for i in np.flatnonzero(keep).tolist():
            text = column[i].as_py()
            keep[i] = bool(text) and any(map(str.isalpha, text))
        return keep

    def predict(self, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """Language, score and the winner's bits per symbol of each text."""
        data, offsets = text_buffers(column)
        langs: list[str] = []
        scores: list[float] = []
        bits: list[float] = []
        for lo, hi in slices(offsets, _PASS):
            part = data[offsets[lo]:offsets[hi]]
            rates = self.entropies(part, offsets[lo:hi + 1] - offsets[lo])
            for i in range(hi - lo):
                text = column[lo + i].as_py()
                if not text or not self.langs or not any(map(str.isalpha, text)):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    bits.append(0.0)
                    continue
                order = np.argsort(rates[i], kind="stable")
                best = rates[i, order[0]]
                other = rates[i, order[1]] if len(order) > 1 else self.parsers[0].bits
                langs.append(self.langs[order[0]])
                scores.append(float(np.clip(1 - best / other, 0, 1)) if other > 0 else 0.0)
                bits.append(float(best))
        return langs, scores, bits


@lru_cache(maxsize=1)
def _identifier(samples: tuple[tuple[str, bytes], ...]) -> Identifier:
    return Identifier(samples)


def identify(df: DataFrame, id_col: str, text_col: str, samples: dict[str, bytes]) -> DataFrame:
    """One row per input row: the id, ``lang_pred``, ``score`` (how much
    cheaper the winner is than the runner-up) and ``bits`` per symbol."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))  # MODEL_BYTES per language
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType(), False),
                           T.StructField("score", T.DoubleType(), False),
                           T.StructField("bits", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = _identifier(shared.value)
        for batch in batches:
            langs, scores, bits = identifier.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                pa.array(bits, pa.float64())], names=[id_col, "lang_pred", "score", "bits"])

    return rows.mapInArrow(run, schema)


def keep_identified(df: DataFrame, text_col: str, samples: dict[str, bytes], max_bits: float) -> DataFrame:
    """Rows of ``df``, all columns, whose text is in a learnt language (see
    :meth:`Identifier.explained`).  One pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = _identifier(shared.value)
        release()  # what building the tables took
        for batch in batches:
            for part in pieces(batch, _ROWS):
                yield part.filter(pa.array(identifier.explained(part.column(at), max_bits)))
        del identifier

    return df.mapInArrow(lean(run, _identifier.cache_clear), df.schema)
