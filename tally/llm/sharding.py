"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells.  A row's key hashes to a cell; every
shard owns several cells (its virtual nodes).  A row goes to the first shard
clockwise that is not full, so with the capacities below the loads are
bounded by construction, and a row only ever leaves its home shard when that
one is full.

All rows of a cell prefer the shards in the same order, so the assignment is
worked out on per-cell counts (at most ``RING`` rows, whatever the input's
size): in round *r* each cell offers what is still unplaced to its *r*-th
shard, which takes it in ring order until it is full.  After as many rounds
as there are shards all is placed.  The rows then find their place by their
rank within the cell, so the only shuffle of rows is by cell, without texts,
and the largest group is a cell's share.

DataFrame functions only; no Python runs on the executors.  Capacities are
``rows // shards`` and one more for the first ``rows % shards`` shards: the
counts of two shards differ by one at most.

Defined results: a null key hashes like the empty string; a null text has no
bytes; rows with equal keys share a cell and are ranked by size and checksum;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Cells of the ring: four hexadecimal digits of a key's MD5.
RING = 1 << 16


def ring_cell(key: str) -> int:
    return int(hashlib.md5(key.encode("utf-8")).hexdigest()[:4], 16)


def preferences(shards: int, virtual_nodes: int) -> list[tuple[int, int, list[int]]]:
    """Arcs of the ring as (first cell, last cell, shards in clockwise order
    of their nearest virtual node).  Depends on the shard count alone."""
    nodes = [sorted({ring_cell(f"shard-{s}-{v}") for v in range(virtual_nodes)}) for s in range(shards)]
    borders = sorted({cell for own in nodes for cell in own})

    def distance(shard: int, cell: int) -> int:
        own = nodes[shard]
        i = bisect.bisect_left(own, cell)
        return own[i] - cell if i < len(own) else own[0] + RING - cell

    arcs, low = [], 0
    for high in [*borders, RING - 1]:
        if low <= high:
            # ties (two shards on one cell) go to the smaller shard number
            arcs.append((low, high, sorted(range(shards), key=lambda s: (distance(s, high), s))))
        low = high + 1
    return arcs


def assign(df: DataFrame, key_col: str, text_col: str, shards: int,
           virtual_nodes: int = 64) -> DataFrame:
    """Columns: the key, ``size`` (UTF-8 bytes plus one), ``text_crc32``,
    ``shard``, ``slot`` (gapless from 0 within the shard) and ``home`` (the
    shard the ring alone would give)."""
    if shards < 1 or virtual_nodes < 1:
        raise ValueError("at least one shard and one virtual node")
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    cell = F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int")
    rows = df.select(F.col(key_col).alias("_key"),
                     (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                     F.crc32(text).alias("text_crc32"), cell.alias("_cell"))
    counts = df.select(cell.alias("_cell")).groupBy("_cell").agg(F.count("*").alias("_left"))

    arcs = spark.createDataFrame(preferences(shards, virtual_nodes), "low int, high int, prefer array<int>")
    cells = arcs.select(F.explode(F.sequence("low", "high")).alias("_cell"), "prefer")
    offers = cut_lineage(counts.join(cells, "_cell").withColumn("_done", F.lit(0).cast("long")))
    total = offers.agg(F.coalesce(F.sum("_left"), F.lit(0))).first()[0]
    room = [total // shards + (s < total % shards) for s in range(shards)]

    turn = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("_left"), F.col("_free") - F.col("_ahead")))
    pieces = None
    for r in range(shards):
        free = F.element_at(F.array(*[F.lit(x).cast("long") for x in room]), F.col("_shard") + 1)
        asked = cut_lineage(
            offers.withColumn("_shard", F.element_at("prefer", r + 1)).withColumn("_free", free)
            .withColumn("_ahead", F.coalesce(F.sum("_left").over(turn), F.lit(0)))
            .select("_cell", "prefer", "_left", "_done", "_shard", taken.alias("_taken")))
        got = asked.where("_taken > 0").select("_cell", "_shard", F.lit(r).alias("_round"),
                                               F.col("_done").alias("_from"), "_taken")
        pieces = got if pieces is None else pieces.unionByName(got)
        # one row per shard comes back
        state = asked.groupBy("_shard").agg(F.sum("_taken").alias("n"), F.sum("_left").alias("m")).collect()
        for x in state:
            room[x["_shard"]] -= x["n"]
        if sum(x["m"] - x["n"] for x in state) == 0:
            break
        offers = asked.where("_left > _taken").select(
            "_cell", "prefer", (F.col("_left") - F.col("_taken")).alias("_left"),
            (F.col("_done") + F.col("_taken")).alias("_done"))
    # A piece is a range of ranks of one cell that goes to one shard; its
    # slots follow those of the pieces before it.
    before = Window.partitionBy("_shard").orderBy("_cell", "_round").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_slot", F.coalesce(F.sum("_taken").over(before), F.lit(0)))
    pieces = pieces.join(cells.select("_cell", F.element_at("prefer", 1).alias("home")), "_cell")

    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_key", "size", "text_crc32")) - F.lit(1)
    ranked = rows.withColumn("_rank", rank)
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_taken"))
    return (ranked.join(pieces, "_cell").where(inside)
            .select(F.col("_key").alias(key_col), "size", "text_crc32", F.col("_shard").alias("shard"),
                    (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot"), "home"))
