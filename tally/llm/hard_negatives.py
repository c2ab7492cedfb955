"""Hard negatives from lists that the anchors of a cluster share.

Rows are vectors of whole numbers with a label; a score is an inner product.
For an anchor, its positives are the best rows of its own label, and a
positive's negatives the best rows of other labels whose scores lie between
two shares of the positive's.

The anchors are clustered by direction.  With the cluster's centre ``c`` and
the widest angle ``w`` between it and a member, no member ``u`` scores a row
``v`` higher than ``|u| |v| cos(max(0, angle(v, c) - w))``.  For each cluster
all rows are sorted by that bound once, the largest first, and cut into
segments; every member walks this list, segment by segment and in steps
inside a segment, until the bound certifies that nothing behind it can matter:
the walk for positives ends when the bound falls below the last wanted
positive's score, the walk for negatives when it falls below the last wanted
negative of every positive (or the lower share, while some are missing).

As Spark jobs: the sorted list is a distributed sort of (cluster, bound, row
number) without vectors; a round takes the next segments of each list
(``GROWTH`` times as many each round), and only for blocks of members that
still walk.  A cell (block of members, segment) is one bounded group: at most
``BLOCK`` members and ``SEGMENT`` rows, whatever cluster, label or copy holds
most of the rows.  Rounds end with the longest walk; what they found is frozen
in the shared checkpoint folder, so a lost executor repeats one round at most.
Where all directions are alike (random vectors) the bound says little and the
walk visits the list to its end: a stated query set against all rows, in
blocks.

The centres are fitted on a bounded sample: the ``SAMPLE`` anchors of the
smallest hash.  They decide only how long a walk is, never its result.

Defined results: rows with a null label or vector, an empty vector, a null or
non-finite component, or components whose squares sum to 2**62 or more (a
score might not fit a long) take no part; rows equal in id, label and vector
count once; rows that repeat an id with another label or vector take part as
rows of their own (each an anchor, equal scores in an order of its own); rows
without an id come after all others among equal scores, are no anchors and are
reported as null; vectors of different length have no score.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ..session import cut_lineage
from .documents import given, number
from .groups import whole_groups

#: Most members of a block and rows of a segment of a list.
BLOCK, SEGMENT = 1024, 4096
#: Rows taken at a time inside a segment.
STEP = 512
#: Anchors per cluster, most clusters, and anchors their centres are fitted on.
PER_CLUSTER, MOST_CLUSTERS, SAMPLE = 512, 64, 4096
#: Segments of the first round; each further round takes ``GROWTH`` times as many.
FIRST, GROWTH = 1, 4
#: Slack of angles and bounds, far above their rounding errors.
_ANGLE, _SLACK = 1e-6, 1e-9


def quantised(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of every component, null for unusable vectors."""
    wide = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    # Infinity and NaN times zero is not zero; a null makes the test null.
    sound = F.forall(wide, lambda x: x.isNotNull() & (x * 0 == 0) & (F.abs(x) < 2.0**31 - 1)) & (F.size(wide) > 0)
    whole = F.transform(wide, lambda x: F.floor(x).cast("int"))
    square = F.aggregate(wide, F.lit(0.0), lambda a, x: a + F.floor(x) * F.floor(x).cast("double"))
    return F.when(F.coalesce(sound, F.lit(False)), F.when(square < 2.0**62, whole))


def _matrix(column: pa.ListArray) -> list[np.ndarray]:
    return [np.asarray(x, np.float64) for x in column.to_pylist()]


def fit_centres(sample: list[np.ndarray], clusters: int, rounds: int = 8) -> dict[int, np.ndarray]:
    """Unit centres per vector length: spherical k-means, farthest-first."""
    out: dict[int, np.ndarray] = {}
    by_length: dict[int, list[np.ndarray]] = {}
    for v in sample:
        if np.any(v):
            by_length.setdefault(len(v), []).append(v / np.linalg.norm(v))
    for length, group in sorted(by_length.items()):
        x = np.stack(group)
        k = max(1, min(len(x), round(clusters * len(x) / len(sample))))
        chosen, near = [0], x @ x[0]
        while len(chosen) < k:
            chosen.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[chosen[-1]])
        centres = x[chosen]
        for _ in range(rounds):
            own = np.argmax(x @ centres.T, axis=1)
            for j in range(k):
                total = x[own == j].sum(axis=0)
                if np.linalg.norm(total) > 0:
                    centres[j] = total / np.linalg.norm(total)
        out[length] = centres
    return out


def _angles(vectors: list[np.ndarray], centres: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Angle of each vector to each centre of its length (none: empty)."""
    out = []
    for v in vectors:
        c = centres.get(len(v))
        size = np.linalg.norm(v)
        if c is None:
            out.append(np.zeros(0))
        else:
            out.append(np.arccos(np.clip(c @ v / size, -1, 1)) if size else np.zeros(len(c)))
    return out


def mine(df: DataFrame, id_col: str, vector_col: str, label_col: str, is_anchor: Column, positives: int = 5,
         negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """Columns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score`` and ``negative_score``.  ``is_anchor`` is a condition on
    the columns of ``df``; a negative's score lies between ``low`` and
    ``high`` percent of the positive's."""
    rows = df.select(number(id_col, vector_col).alias("_id"), F.col(label_col).cast("string").alias("_label"),
                     quantised(F.col(vector_col), scale).alias("_vec"),
                     F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("_anchor"))
    rows = rows.where("_vec is not null and _label is not null").withColumn(
        "_row", F.xxhash64("_id", "_label", "_vec")).dropDuplicates(["_id", "_row"])
    rows = cut_lineage(rows.select("_id", "_row", F.xxhash64("_label").alias("_label"), "_vec", "_anchor"))
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                  "positive_score long, negative_score long")
    anchors = rows.where("_anchor")
    count = anchors.count()
    if not count:
        return empty
    clusters = min(MOST_CLUSTERS, -(-count // PER_CLUSTER))
    sample = anchors.orderBy(F.xxhash64("_row"), "_row").limit(SAMPLE).select("_vec").toArrow().column(0)
    centres = fit_centres(_matrix(sample), clusters)
    first = {n: sum(len(centres[m]) for m in sorted(centres) if m < n) for n in centres}  # cluster numbers

    # Members: the cluster of the nearest centre; its width is the widest angle.
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(3))
            cluster, angle = [], []
            for v, a in zip(vectors, _angles(vectors, centres), strict=True):
                # a length without a centre makes a list by norm alone
                cluster.append(first[len(v)] + int(np.argmin(a)) if len(a) else -len(v))
                angle.append(float(a.min()) if len(a) else 4.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()),
                                              pa.array(angle, pa.float64())],
                                             names=[*batch.schema.names, "_cluster", "_angle"])

    names = "_id long, _row long, _label long, _vec array<int>"
    held = anchors.select("_id", "_row", "_label", "_vec").mapInArrow(
        place, names + ", _cluster int, _angle double")
    members = _blocks(held)
    width = members.groupBy("_cluster").agg(F.max("_angle").alias("_width"))
    widths = {r[0]: r[1] for r in width.where("_cluster >= 0").collect()}  # at most MOST_CLUSTERS rows

    # The lists: every row's bound in every cluster that has members.
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2))
            out_cluster, out_bound, times = [], [], []
            for v, a in zip(vectors, _angles(vectors, centres), strict=True):
                size = float(np.linalg.norm(v))
                if len(a):
                    own = [(first[len(v)] + j, size * np.cos(max(0.0, x - widths[first[len(v)] + j] - _ANGLE)))
                           for j, x in enumerate(a) if first[len(v)] + j in widths]
                else:
                    own = [(-len(v), size)]
                times.append(len(own))
                out_cluster += [x[0] for x in own]
                out_bound += [float(x[1]) for x in own]
            at = np.repeat(np.arange(batch.num_rows), times)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                pa.array(out_cluster, pa.int32()), pa.array(out_bound, pa.float64())],
                names=["_id", "_row", "_cluster", "_bound"])

    lists = rows.select("_id", "_row", "_vec").mapInArrow(bound, "_id long, _row long, _cluster int, _bound double")
    lists = lists.join(width.select("_cluster"), "_cluster", "left_semi").withColumn("_down", -F.col("_bound"))
    ranked = cut_lineage(global_row_number(lists, ["_cluster", "_down", "_id", "_row"], "_place").drop("_down"))
    start = ranked.groupBy("_cluster").agg((F.min("_place")).alias("_start"))
    listed = cut_lineage(ranked.join(start, "_cluster").select(
        "_cluster", "_id", "_row", "_bound",
        F.floor((F.col("_place") - F.col("_start")) / SEGMENT).cast("int").alias("_segment"))
        .join(rows.select("_id", "_row", "_label", "_vec"), ["_id", "_row"]))
    heads = cut_lineage(listed.groupBy("_cluster", "_segment").agg(F.max("_bound").alias("_head")))

    best = _walk(members, listed, heads, _positive_cells(positives), positives, ["_a", "_ar"])
    if best is None:
        return empty
    # A positive's range of negative scores, in whole numbers.
    wanted = cut_lineage(best.select(
        "_a", "_ar", F.col("_id").alias("_p"), F.col("_row").alias("_pr"), F.col("_score").alias("_ps"),
        F.ceil(F.col("_score") * F.lit(low).cast("decimal(20,0)") / 100).cast("long").alias("_low"),
        F.floor(F.col("_score") * F.lit(high).cast("decimal(20,0)") / 100).cast("long").alias("_high"))
        .where("_low <= _high"))
    seekers = members.join(wanted.groupBy("_a", "_ar").agg(
        F.sort_array(F.collect_list(F.struct("_p", "_pr", "_low", "_high"))).alias("_ranges")), ["_a", "_ar"])
    found = _walk(seekers, listed, heads, _negative_cells(negatives, positives), negatives, ["_a", "_ar", "_p", "_pr"])
    if found is None:
        return empty
    order = Window.partitionBy("_a", "_ar", "_p", "_pr").orderBy(F.desc("_score"), "_id", "_row")
    return found.join(wanted, ["_a", "_ar", "_p", "_pr"]).select(
        F.col("_a").alias("anchor_id"), given(F.col("_p")).alias("positive_id"),
        F.row_number().over(order).cast("int").alias("rank"), given(F.col("_id")).alias("negative_id"),
        F.col("_ps").alias("positive_score"), F.col("_score").alias("negative_score"))


def _blocks(held: DataFrame) -> DataFrame:
    """Members with the block of at most about ``BLOCK`` that walks with them."""
    held = cut_lineage(held.withColumns({"_a": F.col("_id"), "_ar": F.col("_row")}).drop("_id", "_row"))
    sizes = held.groupBy("_cluster").agg(F.ceil(F.count("*") / (BLOCK // 2)).alias("_blocks"))
    block = F.pmod(F.xxhash64("_a", "_ar"), F.col("_blocks")).cast("int")
    norm = F.sqrt(F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return cut_lineage(held.join(sizes, "_cluster").withColumns({"_block": block, "_norm": norm}).drop("_blocks"))


def _walk(members: DataFrame, listed: DataFrame, heads: DataFrame, cell, keep: int, keys: list[str]):
    """Rounds over the lists until every member's walk has ended.  ``cell``
    maps the sorted rows of cells to finds (``keys``, ``_id``, ``_row``,
    ``_score``); the ``keep`` best finds of each key stay.  Returns the finds."""
    last = heads.agg(F.max("_segment")).first()[0]
    ranges = "_ranges" in members.columns
    found, begin, take = None, 0, FIRST
    base = members.withColumn("_wants", F.size("_ranges") if ranges else F.lit(1))
    while last is not None and begin <= last:
        if found is None:
            need = base.select("_a", "_ar", F.lit(None).cast("long").alias("_need"))
            if ranges:
                need = base.select("_a", "_ar", F.array_min(F.transform("_ranges", lambda r: r["_low"])).alias("_need"))
        else:
            full = found.groupBy(*keys).agg(F.min("_score").alias("_worst"), F.count("*").alias("_n"))
            if ranges:  # the lower share where a positive still lacks negatives
                own = base.select("_a", "_ar", F.explode("_ranges").alias("_r")).select(
                    "_a", "_ar", F.col("_r._p").alias("_p"), F.col("_r._pr").alias("_pr"), F.col("_r._low").alias("_low"))
                need = (own.join(full, keys, "left").groupBy("_a", "_ar").agg(F.min(
                    F.when(F.col("_n") >= keep, F.col("_worst")).otherwise(F.col("_low"))).alias("_need")))
            else:
                need = base.select("_a", "_ar").join(full, keys, "left").select(
                    "_a", "_ar", F.when(F.col("_n") >= keep, F.col("_worst")).alias("_need"))
        end = begin + take - 1
        reach = heads.where(F.col("_segment").between(begin, end))
        near = reach.groupBy("_cluster").agg(F.max("_head").alias("_top"))
        # Who still walks: the bound at the round's first segment reaches the need.
        ceiling = F.col("_top") * F.col("_norm")
        still = (base.join(need, ["_a", "_ar"]).join(near, "_cluster")
                 .where(F.col("_need").isNull() | (ceiling + F.abs(ceiling) * _SLACK + _ANGLE >= F.col("_need"))))
        still = cut_lineage(still.drop("_top", "_angle", "_wants"))
        if still.isEmpty():
            break
        blocks = still.select("_cluster", "_block").distinct()
        cells = ["_cluster", "_block", "_segment"]
        every = blocks.join(reach.select("_cluster", "_segment"), "_cluster")
        # Members and rows of a cell meet in one sorted group, members first.
        extra = F.col("_ranges") if ranges else F.lit(None).cast(
            "array<struct<_p:bigint,_pr:bigint,_low:bigint,_high:bigint>>")
        walkers = every.join(still, ["_cluster", "_block"]).select(
            *cells, F.lit(0).alias("_side"), F.col("_norm").alias("_order"), F.col("_a").alias("_id"),
            F.col("_ar").alias("_row"), "_label", "_vec", "_need", extra.alias("_ranges"))
        listed_now = every.join(listed.where(F.col("_segment").between(begin, end)), ["_cluster", "_segment"]).select(
            *cells, F.lit(1).alias("_side"), F.col("_bound").alias("_order"), "_id", "_row", "_label", "_vec",
            F.lit(None).cast("long").alias("_need"), F.lit(None).cast(walkers.schema["_ranges"].dataType).alias("_ranges"))
        work = (walkers.unionByName(listed_now).repartition(*cells)
                .sortWithinPartitions(*cells, "_side", F.desc("_order"), "_id", "_row"))

        def run(batches, cell=cell):
            for table, bounds in whole_groups(batches, 3):
                for lo, hi in bounds:
                    yield from cell(table.slice(lo, hi - lo))

        schema = ", ".join(f"{k} long" for k in [*keys, "_id", "_row", "_score"])
        new = work.mapInArrow(run, schema)
        merged = new if found is None else found.unionByName(new)
        rank = Window.partitionBy(*keys).orderBy(F.desc("_score"), "_id", "_row")
        found = cut_lineage(merged.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= keep)
                            .drop("_rank"))
        begin, take = end + 1, take * GROWTH
    return found


# -- one cell ------------------------------------------------------------------

class _Cell:
    """Members and rows of a cell as arrays; rows by falling bound."""

    def __init__(self, table: pa.Table):
        side = table.column("_side").to_numpy()
        m = int(np.searchsorted(side, 1))
        column = lambda name: table.column(name).to_numpy()
        self.id, self.row, self.label = (column(c) for c in ("_id", "_row", "_label"))
        self.a, self.ar, self.la = self.id[:m], self.row[:m], self.label[:m]
        self.id, self.row, self.label = self.id[m:], self.row[m:], self.label[m:]
        order = column("_order")
        self.norm, self.bound = order[:m], order[m:]
        vec = table.column("_vec").combine_chunks()
        if isinstance(vec, pa.ChunkedArray):
            vec = vec.chunk(0)
        flat = vec.flatten().to_numpy().reshape(table.num_rows, -1)
        # Products are exact in doubles up to 2**53, else in 64-bit integers.
        top = float(np.abs(flat).max(initial=0)) ** 2 * flat.shape[1]
        self.kind = np.float64 if top < 2.0**53 else np.int64
        flat = flat.astype(self.kind)
        self.u, self.v = flat[:m], flat[m:]
        need = table.column("_need").slice(0, m)
        self.need = need.fill_null(-(1 << 62)).to_numpy().astype(np.int64)
        self.ranges = table.column("_ranges").slice(0, m)

    def steps(self):
        """Members that still walk, and the rows of the next step."""
        for lo in range(0, len(self.id), STEP):
            ceiling = self.bound[lo] * self.norm
            going = np.flatnonzero(ceiling + np.abs(ceiling) * _SLACK + _ANGLE >= self.need)
            if not len(going):
                return
            yield going, slice(lo, lo + STEP)


def _first(key: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best of each key: larger score, smaller id."""
    order = np.lexsort((row, id_, -score, key))
    sorted_ = key[order]
    fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order[place < keep]


def _merge(held, key, score, id_, row, keep: int):
    parts = [np.concatenate(x) for x in zip(held, (key, score, id_, row), strict=True)]
    best = _first(*parts, keep)
    return [x[best] for x in parts]


def _nothing() -> list[np.ndarray]:
    return [np.zeros(0, np.int64) for _ in range(4)]


def _positive_cells(keep: int):
    def cell(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c = _Cell(table)
        held = _nothing()
        for going, rows in c.steps():
            score = (c.u[going] @ c.v[rows].T).astype(np.int64)
            fit = (score >= c.need[going][:, None]) & (c.la[going][:, None] == c.label[rows][None, :])
            fit &= (c.a[going][:, None] != c.id[rows][None, :]) | (c.ar[going][:, None] != c.row[rows][None, :])
            i, j = np.nonzero(fit)
            if not len(i):
                continue
            held = _merge(held, going[i], score[i, j], c.id[rows][j], c.row[rows][j], keep)
            full = np.bincount(held[0], minlength=len(c.a)) >= keep
            worst = np.full(len(c.a), np.iinfo(np.int64).max)
            np.minimum.at(worst, held[0], held[1])
            c.need[full] = np.maximum(c.need, worst)[full]
        m, score, id_, row = held
        if len(m):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c.a[m], c.ar[m], id_, row, score)],
                                             names=["_a", "_ar", "_id", "_row", "_score"])
    return cell


def _negative_cells(keep: int, positives: int):
    def cell(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c = _Cell(table)
        n = len(c.a)
        # ranges[m, j]: positive, its row, lowest and highest score; none: empty
        low = np.full((n, positives), np.iinfo(np.int64).max)
        high = np.full((n, positives), np.iinfo(np.int64).min)
        p, pr = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
        for m, own in enumerate(c.ranges.to_pylist()):
            for j, r in enumerate(own):
                p[m, j], pr[m, j], low[m, j], high[m, j] = r["_p"], r["_pr"], r["_low"], r["_high"]
        floor, top = low.min(axis=1), high.max(axis=1)
        want = low.copy()  # what a new negative must reach
        held = _nothing()
        for going, rows in c.steps():
            score = (c.u[going] @ c.v[rows].T).astype(np.int64)
            least = np.maximum(floor, c.need)[going][:, None]
            fit = (score >= least) & (score <= top[going][:, None]) & (c.la[going][:, None] != c.label[rows][None, :])
            i, j = np.nonzero(fit)
            if not len(i):
                continue
            who, what, id_, row = going[i], score[i, j], c.id[rows][j], c.row[rows][j]
            for k in range(positives):
                inside = np.flatnonzero((what >= want[who, k]) & (what <= high[who, k]))
                if len(inside):
                    held = _merge(held, who[inside] * positives + k, what[inside], id_[inside], row[inside], keep)
            full = np.bincount(held[0], minlength=n * positives) >= keep
            worst = np.full(n * positives, np.iinfo(np.int64).max)
            np.minimum.at(worst, held[0], held[1])
            flat = want.ravel()
            flat[full] = np.maximum(flat, worst)[full]
            c.need = np.maximum(c.need, want.min(axis=1))
        key, score, id_, row = held
        if len(key):
            m, k = key // positives, key % positives
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (c.a[m], c.ar[m], p[m, k], pr[m, k], id_, row, score)],
                names=["_a", "_ar", "_p", "_pr", "_id", "_row", "_score"])
    return cell
