"""Exact n-gram Jaccard join by vertical partitioning.

All n-grams have one global order (that of their 64-bit hashes).  The order
is cut into fragments, and a document's set into the pieces that fall into
them.

*Candidates.*  Two sets that reach the similarity differ in at most ``k``
n-grams, ``k`` following from their sizes.  With ``f > k`` fragments at least
``f - k`` pieces are equal, and among the equal pieces the one with the
greatest (size, digest) is found even if both documents leave out their
``f - k - 1`` smallest pieces.  So each document sends the digests of its
``k + 1`` greatest pieces, and a pair that shares none of them cannot reach
the similarity.  Pieces hold several n-grams, so a frequent n-gram alone
brings no two documents together.  Documents are compared at *levels*,
overlapping ranges of set sizes chosen so that every possible pair has a level
in common.

*Overlaps.*  The sets of the documents that share a piece are cut into
fragments as well; each fragment's partial overlap of a pair is counted in its
own row, wherever that fragment lives, and the partial overlaps are summed
per pair.  The threshold is tested in whole numbers.

*Groups.*  Equal sets are one class from the start.  Of the documents of one
piece, the one that shares most with others (as an original does with its
copies) is the hub, and only the links to it are counted first.  Classes
connected by them need no further comparison, so a large group of near copies
costs one pair per member and not all pairs.  What is left are documents that
share a piece across different components.  Groups of up to ``FEW`` pair them
directly; in larger ones the members outside the piece's main component (the
one with the most of its members) are compared with all members of other
components, in blocks, every two blocks in a task of their own, by parity
sketches of two bits per n-gram whose difference never exceeds that of the
sets, and only pairs that the sketches cannot rule out are counted.  A few
strays among many joined copies so cost strays times members.  No link between
different components is lost.

Defined results: a text without words, or null, has an empty set, links with
nothing and is its own component; rows that repeat an id are in one component
if their sets link; a null id is reported as null and gives its name to a
component only where nobody in it has an id.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .documents import given, number, numbered
from .groups import whole_groups
from .memory import lean, pieces as parts_of
from .words import LOWER, NON_SPACE, Words, mix, ngrams, signed, slices, text_buffers

_U = np.uint64
#: Documents of a piece that are paired directly, and rows of a block beyond.
FEW, BLOCK = 8, 512
#: Texts whose pieces or sets a task holds at a time.
TEXTS = 512
#: Fragments of the n-gram order in which partial overlaps are counted.
FRAGMENTS = 4
#: Up to this many differences all sets with that many n-grams left out are
#: sent: exact for small sets, whose pieces would hold one n-gram or none.
_DELETIONS = 2


class Levels:
    """Overlapping ranges of set sizes for one similarity ``p / q``.  A set
    too small to link with any but an equal set has no level."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.spread = max(1.8, (q / p) ** 3)
        least = -(-p // (q - p)) if p < q else 1 << 62  # s / (s + 1) >= p / q
        self.low, self.high = [least], [int(least * self.spread)]

    def of(self, size: int) -> list[tuple[int, int]]:
        """Levels of a set size: (level, largest number of differences)."""
        while self.high[-1] < size or self.low[-1] <= size:
            # the smallest partner of the first size that does not fit here
            low = -(-self.p * (self.high[-1] + 1) // self.q)
            self.low.append(low)
            self.high.append(max(int(low * self.spread), self.high[-1] + 1))
        # |difference| <= (q - p) / (q + p) * (sum of sizes)
        return [(i, 2 * high * (self.q - self.p) // (self.q + self.p))
                for i, (low, high) in enumerate(zip(self.low, self.high, strict=True)) if low <= size <= high]


@lru_cache(maxsize=8)
def _levels(p: int, q: int) -> Levels:
    return Levels(p, q)


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a batch."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        found = Words(data, offsets, lo, hi, NON_SPACE, LOWER)
        h = found.hashes()
        for i in range(hi - lo):
            part = h[found.first[i]:found.first[i + 1]]
            yield np.unique(ngrams(part, min(n, len(part)))) if len(part) else part


def _class(grams: np.ndarray) -> int:
    """Digest of a whole set."""
    return int(signed(mix(np.sum(mix(grams ^ _U(0xA0761D6478BD642F)), keepdims=True) + _U(len(grams))))[0])


def _pieces(grams: np.ndarray, levels: Levels) -> np.ndarray:
    """Digests of the pieces that a set sends."""
    out = [np.zeros(0, np.uint64)]
    for level, k in levels.of(len(grams)):
        if k <= _DELETIONS:
            part = mix(grams)
            left = [np.sum(part, keepdims=True)]
            for _ in range(k):
                left.append(np.unique(np.subtract.outer(left[-1], part)))
            out.append(mix(np.unique(np.concatenate(left)) + mix(np.array([level], np.uint64))))
            continue
        fragments = k + 1 + max(2, k // 4)
        borders = _borders(fragments)
        for turn in range(16):
            order = grams if not turn else np.sort(mix(grams + _U(turn)))
            run = np.zeros(len(order) + 1, np.uint64)
            np.cumsum(mix(order), out=run[1:])
            at = np.concatenate([[0], np.searchsorted(order, borders), [len(order)]])
            own = _U((level << 40) + (turn << 32)) + np.arange(fragments, dtype=np.uint64)
            digest = mix(run[at[1:]] - run[at[:-1]] + mix(own))
            size = np.diff(at)
            best = np.lexsort((digest, size))[fragments - k - 1:]
            # Empty pieces say nothing: a set that would have to send one
            # sends those of the order of another hash instead.
            full = best[size[best] > 0]
            out.append(digest[full] if turn < 15 else digest[best])
            if len(full) == len(best):
                break
    return np.concatenate(out)


def _third(piece: np.ndarray) -> np.ndarray:
    """Which rows are the third or a later one of their piece."""
    order = np.argsort(piece, kind="stable")
    sorted_ = piece[order]
    out = np.zeros(len(piece), bool)
    out[order[2:]] = sorted_[2:] == sorted_[:-2]
    return out


@lru_cache(maxsize=4096)
def _borders(fragments: int) -> np.ndarray:
    return np.array([i * 2**64 // fragments for i in range(1, fragments)], np.uint64)


def _sketch(grams: np.ndarray) -> bytes:
    """Parities of two bits per n-gram (a power of two of them).  Folding a
    sketch in half gives that of the smaller size."""
    bits = 1 << max(6, int(2 * len(grams) - 1).bit_length())
    odd = np.bincount((mix(grams) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart_pairs(table: pa.Table, ranges: list[tuple[int, int]], p: int, q: int) -> pa.RecordBatch:
    """Pairs of each group that the sketches allow: members outside the
    piece's main component (side 0) with members of other components (1: main,
    2: other, where the smaller of two asks)."""
    side, class_, size, label = (table.column(c).to_numpy() for c in range(3, 7))
    sketches = table.column(7)
    out = []
    for lo, hi in ranges:
        asking = int(np.searchsorted(side[lo:hi], 1))
        if not 0 < asking < hi - lo:
            continue
        raw = [np.frombuffer(x.as_py(), np.uint64) for x in sketches.slice(lo, hi - lo)]
        wide = min(map(len, raw))
        part = np.stack([np.bitwise_xor.reduce(x.reshape(-1, wide), axis=0) for x in raw])
        n, who, name = size[lo:hi].astype(np.int64), label[lo:hi], class_[lo:hi]
        to, once = slice(asking, None), side[lo + asking:hi] == 1
        step = max(1, (1 << 19) // ((hi - lo) * wide))  # a few megabytes at a time
        for a in range(0, asking, step):
            rows = slice(a, min(a + step, asking))
            both = n[rows, None] + n[None, to]
            apart = np.bitwise_count(part[rows, None, :] ^ part[None, to, :]).sum(axis=2, dtype=np.int64)
            fit = (apart * (p + q) <= both * (q - p)) & (who[rows, None] != who[None, to])
            fit &= np.minimum(n[rows, None], n[None, to]) * q >= np.maximum(n[rows, None], n[None, to]) * p
            fit &= once[None, :] | (name[rows, None] < name[None, to])
            x, y = np.nonzero(fit)
            out.append((name[rows][x], n[rows][x], name[to][y], n[to][y]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.RecordBatch.from_arrays([
        pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]),
        pa.array(columns[3].astype(np.int32))], names=["a", "na", "b", "nb"])


def _plausible(batch: pa.RecordBatch, p: int, q: int) -> np.ndarray:
    """Which pairs (a, na, b, nb and both sketches) the sketches allow."""
    na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in (1, 3))
    wide = np.stack([pc.binary_length(batch.column(c)).to_numpy() for c in (4, 5)])
    out = np.zeros(batch.num_rows, bool)
    for x, y in np.unique(wide, axis=1).T.tolist():
        at = np.flatnonzero((wide[0] == x) & (wide[1] == y))
        least = min(x, y) // 8
        sides = []
        for c, size in ((4, x), (5, y)):
            flat = np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), np.uint64)
            sides.append(np.bitwise_xor.reduce(flat.reshape(len(at), size // 8 // least, least), axis=1))
        apart = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
        out[at] = apart * (p + q) <= (na[at] + nb[at]) * (q - p)
    return out


def jaccard_components(df: DataFrame, id_col: str, text_col: str, n: int = 5,
                       similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """Columns: the id, ``n_shingles`` and ``component_id`` (the smallest id
    reachable by links, the row's own included)."""
    return _components(numbered(df, id_col, text_col), n, similarity).select(
        given(F.col("_id")).alias(id_col), "n_shingles", given(F.col("_component")).alias("component_id"))


def keep_representatives(df: DataFrame, id_col: str, text_col: str, n: int = 5,
                         similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """Rows of ``df``, all columns, without near duplicates: of each component
    the row with the smallest id stays (once, if it is given several times),
    and all rows with an empty set."""
    held = df.withColumns({"_tally_id": number(id_col, text_col), "_tally_copy": F.xxhash64(F.col(text_col))})
    found = cut_lineage(_components(numbered(df, id_col, text_col), n, similarity))
    first = found.where((F.col("_id") == F.col("_component")) | (F.col("n_shingles") == 0)).select("_id", "n_shingles")
    repeated = bool(found.groupBy("_id").count().where("count > 1").limit(1).count())
    stay = first.groupBy(F.col("_id").alias("_tally_id")).agg(F.max("n_shingles").alias("_tally_n"))
    out = held.join(stay, "_tally_id")
    if repeated:
        turn = Window.partitionBy("_tally_id", "_tally_copy").orderBy("_tally_copy")
        out = out.withColumn("_tally_turn", F.row_number().over(turn)).where("_tally_turn = 1 or _tally_n = 0")
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def _components(docs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """``_id``, ``n_shingles`` and ``_component`` of numbered documents."""
    p, q = similarity.numerator, similarity.denominator
    if not 0 < p <= q:
        raise ValueError("the similarity lies in (0, 1]")
    def classify(batches):
        for batch in batches:
            sizes, prints = [], []
            for grams in _sets(batch.column(1), n):
                sizes.append(len(grams))
                prints.append(_class(grams) if len(grams) else 0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64())],
                names=["_id", "n_shingles", "_class"])

    members = cut_lineage(docs.mapInArrow(lean(classify), "_id long, n_shingles long, _class long"))
    classes = (members.where("n_shingles > 0").groupBy("_class", "n_shingles").agg(F.min("_id").alias("_rep")))

    def send(batches):
        levels, sent = _levels(p, q), set()
        for batch in (x for whole in batches for x in parts_of(whole, TEXTS)):
            parts, prints, sizes = [], [], []
            for grams in _sets(batch.column(1), n):
                if len(grams) and (print_ := _class(grams)) not in sent:
                    sent.add(print_)  # a copy of a set sends nothing new
                    parts.append(_pieces(grams, levels))
                    prints.append(print_)
                    sizes.append(len(grams))
            each = [len(x) for x in parts]
            piece = signed(np.concatenate(parts or [np.zeros(0, np.uint64)]))
            class_ = np.repeat(np.array(prints, np.int64), each)
            yield pa.RecordBatch.from_arrays([
                pa.array(piece), pa.array(class_), pa.array(np.repeat(np.array(sizes, np.int32), each)),
                pa.array(np.where(_third(piece), class_, 0))], names=["_piece", "_class", "_n", "_aside"])

    # Two sets of a group of texts with the same piece prove it shared; all
    # others stand aside under numbers of their own, so a piece that a third
    # of all documents send does not meet in one task.
    group = Window.partitionBy("_piece", "_aside")
    pieces = docs.mapInArrow(lean(send), "_piece long, _class long, _n int, _aside long")
    shared = cut_lineage(pieces.withColumn("_least", F.min("_class").over(group))
                         .withColumn("_last", F.max("_class").over(group))
                         .where("_least <> _last or _aside <> 0").select("_piece", "_class", "_n").distinct())
    # How much a document shares: the other members of all its pieces.
    members_of = cut_lineage(shared.groupBy("_piece").agg(F.count("*").alias("_m")))
    sized = shared.join(members_of, "_piece")
    score = sized.groupBy("_class").agg(F.sum(F.col("_m") - 1).alias("_score"))
    scored = cut_lineage(sized.join(score, "_class"))
    best = F.max(F.struct("_score", "_class", "_n")).alias("_hub")
    hubs = cut_lineage(scored.groupBy("_piece").agg(best).select(
        "_piece", F.col("_hub._score").alias("_lead"), F.col("_hub._class").alias("a"), F.col("_hub._n").alias("na")))

    # Sets of the documents involved, one row per fragment.
    involved = shared.select("_class").distinct().join(classes, "_class").select("_class", F.col("_rep").alias("_id"))

    def cut(batches):
        done = set()
        for batch in (x for whole in batches for x in parts_of(whole, TEXTS)):
            prints, parts, pieces_, sketches = [], [], [], []
            for print_, grams in zip(batch.column(2).to_pylist(), _sets(batch.column(1), n), strict=True):
                if not len(grams) or _class(grams) != print_ or print_ in done:
                    continue  # the row given twice, or another text under the same id
                done.add(print_)
                at = np.searchsorted(grams, np.arange(1, FRAGMENTS, dtype=np.uint64) * _U(2**64 // FRAGMENTS))
                for j, piece in enumerate(np.split(grams, at)):
                    prints.append(print_)
                    parts.append(j)
                    pieces_.append(signed(piece))
                    sketches.append(None if j else _sketch(grams))
            sizes = np.array([len(x) for x in pieces_], np.int64)
            values = pa.array(np.concatenate(pieces_) if pieces_ else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(parts, pa.int32()), lists,
                                              pa.array(sketches, pa.binary())],
                                             names=["_class", "_part", "_grams", "_sketch"])

    wanted = docs.join(involved, "_id").select("_id", "_text", "_class")
    sets = cut_lineage(wanted.mapInArrow(lean(cut), "_class long, _part int, _grams array<long>, _sketch binary"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, na, b, nb) that reach the similarity."""
        left = sets.select(F.col("_class").alias("a"), "_part", F.col("_grams").alias("_ga"))
        right = sets.select(F.col("_class").alias("b"), "_part", F.col("_grams").alias("_gb"))
        partial = (pairs.join(left, "a").join(right, ["b", "_part"])
                   .select("a", "b", "na", "nb", "_part", F.size(F.array_intersect("_ga", "_gb")).alias("_both")))
        once = partial.groupBy("a", "b", "na", "nb", "_part").agg(F.max("_both").alias("_both"))
        total = once.groupBy("a", "b", "na", "nb").agg(F.sum("_both").alias("_both"))
        return total.where(F.col("_both") * (p + q) >= (F.col("na") + F.col("nb")) * p).select("a", "b")

    def sizes_fit(na, nb):
        return F.least(na, nb) * q >= F.greatest(na, nb) * p

    def ordered(pairs: DataFrame) -> DataFrame:
        """Different pairs, the smaller class first."""
        turn = F.col("a") < F.col("b")
        either = lambda x, y: F.when(turn, F.col(x)).otherwise(F.col(y))
        return pairs.select(either("a", "b").alias("a"), either("na", "nb").alias("na"),
                            either("b", "a").alias("b"), either("nb", "na").alias("nb")).distinct()

    sketches = cut_lineage(sets.where("_part = 0").select("_class", "_sketch"))

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs that the sketches allow: sets move for few others."""
        side = lambda c, name: sketches.select(F.col("_class").alias(c), F.col("_sketch").alias(name))
        both = pairs.join(side("a", "_sa"), "a").join(side("b", "_sb"), "b").select("a", "na", "b", "nb", "_sa", "_sb")

        def allow(batches):
            for batch in (x for whole in batches for x in parts_of(whole, TEXTS)):
                yield batch.filter(pa.array(_plausible(batch, p, q))).select(["a", "na", "b", "nb"])

        return cut_lineage(both.mapInArrow(lean(allow), "a long, na int, b long, nb int"))

    # Of its pieces' hubs, each document is compared with the leading one.
    lead = F.max(F.struct("_lead", "a", "na")).alias("_hub")
    first = cut_lineage(ordered(
        scored.join(hubs, "_piece").where(F.col("_class") != F.col("a"))
        .where(sizes_fit(F.col("na"), F.col("_n")))
        .groupBy("_class", "_n").agg(lead)
        .select(F.col("_hub.a").alias("a"), F.col("_hub.na").alias("na"), F.col("_class").alias("b"),
                F.col("_n").alias("nb"))))
    links = cut_lineage(linked(plausible(first)))
    joined = cut_lineage(components(links))

    # Second round: documents of one piece that are still apart.
    labelled = scored.join(joined.withColumnRenamed("node", "_class"), "_class", "left").select(
        "_piece", "_class", "_n", "_m", F.coalesce("component", "_class").alias("_label"))
    labelled = cut_lineage(labelled)
    # Pieces with the same members are one; of the components in a piece the
    # one with the most members is its main one.
    alike = labelled.groupBy("_piece").agg(
        F.min("_label").alias("_min"), F.max("_label").alias("_max"),
        F.bit_xor(F.xxhash64("_class")).alias("_s"), F.bit_xor(F.xxhash64(F.lit(1), "_class")).alias("_t"),
        F.count("*").alias("_k")).where("_min <> _max").groupBy("_s", "_t", "_k").agg(F.min("_piece").alias("_piece"))
    open_ = cut_lineage(alike.select("_piece"))
    apart = cut_lineage(labelled.join(open_, "_piece"))
    main = (apart.groupBy("_piece", "_label").agg(F.count("*").alias("_c"))
            .groupBy("_piece").agg(F.max(F.struct("_c", "_label")).alias("_main"))
            .select("_piece", F.col("_main._label").alias("_home"), F.col("_main._c").alias("_at_home")))
    apart = apart.join(main, "_piece")
    one = apart.where(F.col("_m") <= FEW).select(
        "_piece", F.col("_class").alias("a"), F.col("_n").alias("na"), F.col("_label").alias("_la"))
    two = one.select("_piece", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("_la").alias("_lb"))
    meet = (F.col("a") < F.col("b")) & (F.col("_la") != F.col("_lb")) & sizes_fit(F.col("na"), F.col("nb"))
    few = one.join(two, "_piece").where(meet).select("a", "na", "b", "nb")

    # Larger groups: members outside the main component against all others.
    many = (apart.where(F.col("_m") > FEW)
            .withColumn("_out", F.col("_label") != F.col("_home"))
            .withColumn("_i", F.greatest(F.lit(1), F.ceil((F.col("_m") - F.col("_at_home")) / BLOCK)).cast("int"))
            .withColumn("_j", F.ceil(F.col("_m") / BLOCK).cast("int")))
    here = lambda c: F.pmod(F.xxhash64("_class"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asking = many.where("_out").select("_piece", here("_i").alias("_i"), every("_j").alias("_j"), F.lit(0).alias("_side"),
                                       "_class", "_n", "_label")
    asked = many.select("_piece", every("_i").alias("_i"), here("_j").alias("_j"),
                        F.when(F.col("_out"), 2).otherwise(1).alias("_side"), "_class", "_n", "_label")
    cells = ["_piece", "_i", "_j"]
    work = (asking.unionByName(asked).join(sketches, "_class")
            .select(*cells, "_side", "_class", "_n", "_label", "_sketch")
            .repartition(*cells).sortWithinPartitions(*cells, "_side"))

    def compare(batches):
        for table, ranges in whole_groups(batches, 3):
            yield _apart_pairs(table, ranges, p, q)

    met = work.mapInArrow(lean(compare), "a long, na int, b long, nb int")
    untried = lambda pairs: pairs.join(first.select("a", "b"), ["a", "b"], "left_anti")
    rest = plausible(untried(ordered(few))).unionByName(untried(cut_lineage(ordered(met)))).distinct()
    links = links.unionByName(cut_lineage(linked(cut_lineage(rest))))

    rep = classes.select("_class", "_rep")
    by_id = (links.join(rep.withColumnRenamed("_class", "a").withColumnRenamed("_rep", "_x"), "a")
             .join(rep.withColumnRenamed("_class", "b").withColumnRenamed("_rep", "_y"), "b").select("_x", "_y"))
    found = components(by_id, "_x", "_y")
    whole = classes.join(found.withColumnRenamed("node", "_rep"), "_rep", "left").select(
        "_class", "n_shingles", F.coalesce("component", "_rep").alias("_component"))
    label = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("_id"))
    return members.join(whole, ["_class", "n_shingles"], "left").select(
        "_id", "n_shingles", label.alias("_component"))
