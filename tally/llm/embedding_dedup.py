"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised, so a cosine is a Euclidean distance.  A table hashes a
vector by ``k`` quantised random projections ``floor((a.v + b) / w)``; near
vectors share all ``k`` numbers in some of the tables.  ``k`` grows with the
logarithm of the number of vectors, so that the unrelated vectors in a bucket
stay few, and the number of tables follows from ``k`` and the wanted recall
at the threshold itself (nearer pairs are found more often).  Every pair
that shares a bucket is checked by its exact cosine in double precision;
nothing below the threshold links.

Equal vectors are one weighted vector from the start.  A bucket is compared
in blocks of about ``BLOCK`` rows, every pair of blocks in a group of its own,
so a bucket that holds a third of all vectors is spread over many tasks, and
pairs are counted where they are found and not emitted: a block pair returns
one count per vector and a spanning forest of its links.  A pair is counted
only in the first table it shares.

What moves per table is a vector in its own element type (single precision
stays so until the cosine, taken in double) and its codes of the tables before
(32 bits each; the buckets are made of the same codes, so two vectors of equal
codes do meet).

Defined results: vectors that are null, empty, all zero, or hold null or
non-finite components link with nothing; vectors of different dimension do
not link; rows that repeat an id count as vectors each and form one
component; a null id keeps its row, null as its component's name unless a
linked vector has an id.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .documents import given, number
from .groups import whole_groups

#: Width of a projection's cells.
CELL = 1.0
#: Unrelated vectors expected in a bucket.
CROWD = 16
#: Rows of a block.
BLOCK = 1024
SEED = 41


def _same_cell(distance: float) -> float:
    """Chance that a projection puts two vectors at this distance in one
    cell."""
    if distance <= 0:
        return 1.0
    x = CELL / distance
    tail = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """Projections per table and number of tables."""
    apart = _same_cell(math.sqrt(2))
    near = _same_cell(math.sqrt(max(0.0, 2 - 2 * threshold)))
    k = max(2, math.ceil(math.log(max(vectors, CROWD) / CROWD) / -math.log(apart)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-near ** k))) if near < 1 else 1


def _hasher(dimension: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dimension])
    return (rng.standard_normal((dimension, k * tables)), rng.uniform(0, CELL, k * tables),
            rng.integers(1, 2**62, (tables, k), dtype=np.int64) * 2 + 1)


def near_duplicates(df: DataFrame, id_col: str, vector_col: str, threshold: float = 0.95,
                    recall: float = 0.99) -> DataFrame:
    """Columns: the id, ``n_links``, ``component_id`` and ``kept``."""
    element = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(number(id_col, vector_col).alias("_id"), F.col(vector_col).cast(f"array<{element}>").alias("_vec"))
    # Infinity and NaN times zero is not zero; a null makes the test null.
    sound = F.forall("_vec", lambda x: x.isNotNull() & (x * 0 == 0)) & F.exists("_vec", lambda x: x != 0)
    usable = F.coalesce(sound, F.lit(False))
    # Equal vectors become one, named by the smallest id.
    classes = cut_lineage(rows.where(usable).groupBy("_vec").agg(F.min("_id").alias("_rep"),
                                                                F.count("*").alias("_weight")))
    k, tables = plan(classes.count(), threshold, recall)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            vectors = [np.asarray(x, np.float64) for x in batch.column(0).to_pylist()]
            codes = np.zeros((len(vectors), tables), np.int32)
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                if d not in known:
                    known[d] = _hasher(int(d), k, tables)
                spread, shift, mixer = known[d]
                at = np.flatnonzero(sizes == d)
                x = np.stack([vectors[i] for i in at])
                x /= np.max(np.abs(x), axis=1, keepdims=True)  # no overflow in the norm
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                cell = np.floor((x @ spread + shift) / CELL).astype(np.int64).reshape(len(at), tables, k)
                mixed = ((cell * mixer).sum(axis=2) + int(d)) * 0x1E3779B97F4A7C15
                codes[at] = mixed >> 32
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), flat],
                                             names=["_rep", "_weight", "_vec", "_codes"])

    hashed = cut_lineage(classes.select("_vec", "_rep", "_weight").mapInArrow(
        hash_, f"_rep long, _weight long, _vec array<{element}>, _codes array<int>"))
    held = hashed.select("_rep", F.posexplode("_codes").alias("_table", "_code"))
    crowded = held.groupBy("_table", "_code").agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    placed = (held.join(crowded, ["_table", "_code"]).withColumn("_blocks", blocks).withColumn("_own", own)
              .select("*", other.alias("_other"))
              .select("_rep", "_table", "_code", F.least("_own", "_other").alias("_i"),
                      F.greatest("_own", "_other").alias("_j"), "_own"))
    groups = ["_table", "_code", "_i", "_j"]
    before = F.slice("_codes", 1, F.col("_table")).alias("_codes")
    work = (placed.join(hashed, "_rep").select(*groups, "_own", "_rep", "_weight", "_vec", before)
            .repartition(*groups).sortWithinPartitions(*groups))

    def compare(batches):
        for table, ranges in whole_groups(batches, 4):
            yield from _compare_groups(table, ranges, threshold)

    found = cut_lineage(work.mapInArrow(compare, "_rep long, _links long, _with long"))
    links = found.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    joined = components(found.where("_with is not null"), "_rep", "_with")
    whole = (classes.join(links, "_rep", "left").join(joined.withColumnRenamed("node", "_rep"), "_rep", "left")
             .select("_vec", (F.coalesce("_links", F.lit(0)) + F.col("_weight") - 1).alias("_links"),
                     F.coalesce("component", "_rep").alias("_component")))
    alone = F.col("_component").isNull()
    component = F.coalesce("_component", "_id")
    return rows.withColumn("_usable", usable).join(whole, "_vec", "left").select(
        given(F.col("_id")).alias(id_col), F.when(alone, 0).otherwise(F.col("_links")).cast("long").alias("n_links"),
        given(component).alias("component_id"), (F.col("_id") == component).alias("kept"))


def _compare_groups(table: pa.Table, ranges: list[tuple[int, int]], threshold: float) -> Iterator[pa.RecordBatch]:
    """Counts and spanning links of consecutive groups of rows."""
    number, side_i, side_j, own = (table.column(c).to_numpy() for c in (0, 2, 3, 4))
    rep, weight = table.column(5).to_numpy(), table.column(6).to_numpy()
    vec, codes = (table.column(c).chunk(0) for c in (7, 8))
    flat, starts = vec.flatten().to_numpy(), vec.offsets.to_numpy() - vec.offsets[0].as_py()
    code_starts = codes.offsets.to_numpy() - codes.offsets[0].as_py()
    codes = codes.flatten().to_numpy()
    size = np.diff(starts)
    out_rep, out_links, out_with = [], [], []
    for lo, hi in ranges:
        if hi - lo < 2:
            continue
        # (codes of different dimensions do not collide but by chance)
        dimension = int(size[lo])
        if (size[lo:hi] != dimension).any():
            continue_at = [np.flatnonzero(size[lo:hi] == d) + lo for d in np.unique(size[lo:hi])]
        else:
            continue_at = [np.arange(lo, hi)]
        for at in continue_at:
            x = np.stack([flat[starts[i]:starts[i + 1]] for i in at]) if len(continue_at) > 1 else \
                flat[starts[lo]:starts[hi]].reshape(hi - lo, dimension)
            x = x.astype(np.float64)
            x = x / np.max(np.abs(x), axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if side_i[lo] != side_j[lo]:
                near &= own[at][:, None] != own[at][None, :]
            if not near.any():
                continue
            a, b = np.nonzero(np.triu(near))
            for t in range(int(number[lo])):  # shared an earlier table: counted there
                fresh = codes[code_starts[at[a]] + t] != codes[code_starts[at[b]] + t]
                a, b = a[fresh], b[fresh]
                if not len(a):
                    break
            if not len(a):
                continue
            count = np.bincount(a, weight[at[b]], len(at)) + np.bincount(b, weight[at[a]], len(at))
            label = np.arange(len(at))
            while True:
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            hit = np.flatnonzero(count)
            out_rep.append(rep[at[hit]])
            out_links.append(count[hit].astype(np.int64))
            out_with.append(rep[at[label[hit]]])
    if out_rep:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_rep, out_links, out_with)],
                                         names=["_rep", "_links", "_with"])
