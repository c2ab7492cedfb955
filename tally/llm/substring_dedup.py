"""Exact substring de-duplication with a count-min prefilter.

A window is ``width`` consecutive words of one document.  A word goes if a
window that covers it starts earlier too (in a document with a smaller id, or
earlier in the same one).

1. Documents whose whole word sequence occurs under a smaller id are settled
   at once by their fingerprints: all their windows start earlier.
2. Every window is represented by its anchor, the smallest-hashing of its
   ``gram``-word runs: equal windows have equal anchors, and neighbouring
   windows mostly share one, so a text has far fewer anchors than windows.
   Each task counts its anchors in a partition sketch; sketches are merged by
   adding their counters.  A merged counter never underestimates, so a window
   whose anchor is counted once occurs once and is dropped, and no repeated
   window is lost.
3. The second pass hashes only windows with an anchor estimated repeated and
   groups them exactly (by 64-bit hashes of the 20 words and a second,
   independent 32-bit one).

The sketch is a table with one counter per occupied cell, spread over the
executors, and its width follows the number of words, so its error rate is
the same at every input size; no task holds it whole.  Copies within a batch
are combined before every shuffle, so a passage that stands in a third of
all documents reaches its group once per batch, not once per document.

Defined results: a null text has no words; documents with fewer words than
the window lose nothing; null ids are later than all others, in the order of
their texts' hashes; ids below 2**62 are expected to name one text each: rows
that repeat id and text are one document, returned as often as given, and of
rows that repeat an id with other texts a start repeated in one is cut from
all; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .documents import given, numbered
from .words import Words, mix, ngrams, signed, slices, text_buffers, windows

#: Cells of the sketch per word of the input.
CELLS_PER_WORD = 16
_U = np.uint64


def _per_document(batch: pa.RecordBatch):
    """Slices of a batch: (first row, words, word hashes)."""
    data, offsets = text_buffers(batch.column(1))
    for lo, hi in slices(offsets):
        found = Words(data, offsets, lo, hi)
        yield lo, hi, found, found.hashes()


def _kept(found: Words, i: int, keep: np.ndarray | None = None) -> str:
    """Digest of a document's kept words joined by one space."""
    a, b = int(found.first[i]), int(found.first[i + 1])
    words = bytes(found.data[found.bounds[i]:found.bounds[i + 1]]).split()
    assert len(words) == b - a
    if keep is not None:
        words = [words[j] for j in np.flatnonzero(keep).tolist()]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for lo, hi, found, h in _per_document(batch):
            n = np.diff(found.first)
            prints = np.zeros((2, hi - lo), np.uint64)
            order = np.arange(int(n.max(initial=0)), dtype=np.uint64)
            for seed in (0, 1):
                weight = mix(order * _U(2) + _U(seed))
                for i in range(hi - lo):
                    part = h[found.first[i]:found.first[i + 1]]
                    prints[seed, i] = np.sum(mix(part + weight[:len(part)])) + _U(len(part))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[lo:hi]), pa.array(n.astype(np.int64)), pa.array(signed(mix(prints[0]))),
                pa.array(signed(mix(prints[1]))),
                pa.array([_kept(found, i) for i in range(hi - lo)]), batch.column(2).slice(lo, hi - lo),
            ], names=["_id", "n_words", "_p", "_q", "_whole", "_t"])


def _anchors(found: Words, h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts that lie within one document, the position of each one's
    anchor (positions count the slice's words) and all run hashes."""
    runs = ngrams(h, gram)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    least = runs[:n].copy()
    at = np.arange(n)
    for i in range(1, width - gram + 1):
        step = runs[i:i + n]
        less = step < least
        least[less] = step[less]
        at[less] = np.flatnonzero(less) + i
    stop = np.repeat(found.first[1:], np.diff(found.first))  # each word's document end
    start = np.flatnonzero(np.arange(n) + width <= stop[:n])
    return start, at[start], runs


def _owner(found: Words, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(found.first, positions, side="right") - 1


def remove_repeated(df: DataFrame, id_col: str, text_col: str, width: int = 20, gram: int = 5) -> DataFrame:
    """Columns: the id, ``n_words``, ``n_removed`` and ``kept_sha256`` (of the
    kept words joined by one space)."""
    if not 1 <= gram <= width:
        raise ValueError("an anchor is no longer than a window")
    docs = numbered(df, id_col, text_col)
    prints = cut_lineage(docs.select("_id", "_text", F.xxhash64("_text").alias("_t")).mapInArrow(
        _fingerprints, "_id long, n_words long, _p long, _q long, _whole string, _t long"))
    # One document per word sequence goes on: the first.  Counting words on
    # the way gives the sketch its width.
    first = prints.groupBy("_p", "_q", "n_words").agg(F.min("_id").alias("_first"))
    judged = prints.join(first, ["_p", "_q", "n_words"])
    total = prints.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    copies = judged.where("_id <> _first").select("_id", "_t").distinct()
    cells = 1 << max(20, int(total * CELLS_PER_WORD).bit_length())

    # -- first pass: partition sketches, merged by sums
    def count(batches):
        for batch in batches:
            parts = []
            for _, _, found, h in _per_document(batch):
                _, at, runs = _anchors(found, h, width, gram)
                parts.append(runs[np.unique(at)] & _U(cells - 1))
            cell, n = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(cell)), pa.array(n.astype(np.int64))],
                                             names=["_cell", "_n"])

    # Of a repeated id only the texts that are copies stay out.
    unique = docs.withColumn("_t", F.xxhash64("_text")).join(copies, ["_id", "_t"], "left_anti").drop("_t")
    # Frozen, so that the join below is a plain one whose skewed cells (a very
    # common passage) Spark can split.
    sketch = cut_lineage(unique.mapInArrow(count, "_cell long, _n long").groupBy("_cell")
                         .agg(F.sum("_n").alias("_n")).where("_n > 1").select("_cell"))

    # -- second pass: anchors in repeated cells, then their windows
    def place(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, found, h in _per_document(batch):
                _, at, runs = _anchors(found, h, width, gram)
                at = np.unique(at)
                own = _owner(found, at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(runs[at] & _U(cells - 1))), pa.array(ids[lo + own]),
                    pa.array((at - found.first[own]).astype(np.int32))], names=["_cell", "_id", "_at"])

    suspects = (unique.mapInArrow(place, "_cell long, _id long, _at int").join(sketch, "_cell", "left_semi")
                .groupBy("_id").agg(F.collect_set("_at").alias("_ats")))
    held = cut_lineage(unique.join(suspects, "_id"))

    def exact(batches):
        for batch in batches:
            ids, ats = batch.column(0).to_numpy(), batch.column(2)
            got: list[tuple[np.ndarray, ...]] = []
            for lo, hi, found, h in _per_document(batch):
                start, at, _ = _anchors(found, h, width, gram)
                wanted = [found.first[i] + np.asarray(ats[lo + i].as_py(), np.int64) for i in range(hi - lo)]
                start = start[np.isin(at, np.concatenate(wanted))]
                own = _owner(found, start)
                one = windows(h, width)
                two = windows(mix(h ^ _U(0x5851F42D4C957F2D)), width)
                got.append((one[start], two[start] & _U(0xFFFFFFFF), ids[lo + own], start - found.first[own],
                            np.full(len(start), lo) + own))
            one, two, doc, start, row = (np.concatenate(x) for x in zip(*got, strict=True)) if got else \
                (np.zeros(0, np.int64),) * 5
            # the first occurrence in this batch stands for the batch; the
            # others are known to be repeated
            order = np.lexsort((start, row, doc, two, one))
            same = np.zeros(len(order), bool)
            a, b = one[order], two[order]
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            # (a row given twice is no repetition of itself)
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            d, at = doc[order], start[order]
            known = np.zeros(len(order), bool)
            known[order] = same & ((d != d[lead]) | (at != at[lead]))
            # a row known to be repeated joins a group of its own
            salt = mix(np.arange(len(order), dtype=np.uint64) + mix(doc.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(np.where(known, salt, one).astype(np.uint64))),
                pa.array(np.where(known, -1, two.astype(np.int64))), pa.array(doc),
                pa.array(start.astype(np.int32))], names=["_one", "_two", "_id", "_start"])

    found = held.mapInArrow(exact, "_one long, _two long, _id long, _start int")
    place_ = F.struct("_id", "_start")
    group = Window.partitionBy("_one", "_two")
    again = (found.withColumn("_least", F.min(place_).over(group))
             .where((F.col("_two") < 0) | (place_ > F.col("_least")))
             .groupBy("_id").agg(F.collect_list("_start").alias("_starts")))

    def cut(batches):
        for batch in batches:
            ids, starts = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi, found, _ in _per_document(batch):
                removed, digests = [], []
                whole = [_kept(found, i) for i in range(hi - lo)]
                for i in range(hi - lo):
                    n = int(found.first[i + 1] - found.first[i])
                    edge = np.zeros(n + 1, np.int64)
                    begin = np.unique(np.asarray(starts[lo + i].as_py(), np.int64))
                    begin = begin[begin + width <= n]  # a longer text of the same id has others
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + width, -1)
                    keep = np.cumsum(edge[:n]) == 0
                    removed.append(n - int(keep.sum()))
                    digests.append(_kept(found, i, keep))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[lo:hi]), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                    pa.array(whole, pa.string())], names=["_id", "_removed", "_kept", "_whole"])

    changed = held.select("_id", "_text").join(again, "_id").mapInArrow(
        cut, "_id long, _removed long, _kept string, _whole string").dropDuplicates(["_id", "_whole"])
    empty = hashlib.sha256(b"").hexdigest()
    gone = (F.col("_id") > F.col("_first")) & (F.col("n_words") >= width)
    return judged.join(changed, ["_id", "_whole"], "left").select(
        given(F.col("_id")).alias(id_col), "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, empty).otherwise(F.coalesce("_kept", "_whole")).alias("kept_sha256"))
