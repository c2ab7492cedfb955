"""String similarity for label standardisation.

``gestalt_cascade`` and ``gestalt_score`` are the only Python functions in
this part of the library: Ratcliff / Obershelp ("gestalt") matching, worked
out here for a whole Arrow batch of pairs at a time in numpy
(:func:`gestalt_ratios`).  Pairs whose lengths or shared characters cannot
reach the cutoff are ruled out before they are matched.  Callers feed the
cascade DISTINCT values only, so its cost is distinct labels x vocabulary, not
rows; it is declared non-deterministic so that the optimizer cannot move a
filter on its result below that distinct, onto raw rows.  ``levenshtein_match`` is the all-native alternative (JVM
``levenshtein`` inside a higher-order function, no Python at all).
Both return the 0-based index of the best vocabulary entry whose score
reaches the cutoff, or NULL; ties go to the lexicographically larger
candidate string, as ``difflib.get_close_matches`` orders them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

#: Characters of one block of pairs that are matched together.
BLOCK_CELLS = 1 << 21
#: From this length on, very common characters of a text begin no match.
LONG_TEXT = 200


def levenshtein_score(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings score 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(F.lit(1.0) - F.try_divide(F.levenshtein(a, b).cast("double"), longest.cast("double")),
                      F.lit(1.0))


def levenshtein_match(values: Column, candidates: Sequence[str], cutoff: float = 0.8) -> Column:
    cand = F.array(*[F.struct(F.lit(c).alias("k"), F.lit(i).alias("i")) for i, c in enumerate(candidates)])
    best = F.array_max(F.transform(
        cand, lambda c: F.struct(levenshtein_score(values, c["k"]).alias("s"), c["k"].alias("k"),
                                 (-c["i"]).alias("neg_i"))))
    # (score, key) decide; equal keys resolve to the first index, like list.index.
    return F.when(best["s"] >= F.lit(cutoff), -best["neg_i"])


def _codes(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points (rows padded to the longest) and lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), max(int(size.max(initial=0)), 1)), pad, np.int32)
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def _starters(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where a match may begin: everywhere, but for characters that make up
    more than a hundredth (and one) of a long text."""
    able = codes >= 0
    for row in np.flatnonzero(size >= LONG_TEXT):
        _, which, n = np.unique(codes[row, :size[row]], return_inverse=True, return_counts=True)
        able[row, :size[row]] = (n <= size[row] // 100 + 1)[which]
    return able


def _longest(a, b, able, seg):
    """Longest common run of every segment (pair, from and to in the first,
    from and to in the second text): the earliest in the first text, then in
    the second, widened by equal characters on both sides."""
    pair, alo, ahi, blo, bhi = seg.T
    column = np.arange(b.shape[1])
    text = b[pair]
    open_ = able[pair] & (column >= blo[:, None]) & (column < bhi[:, None])
    run = np.zeros(text.shape, np.int32)
    size, at, bt = np.zeros(len(seg), np.int64), alo.copy(), blo.copy()
    every = np.arange(len(seg))
    for i in range(int(alo.min()), int(ahi.max())):
        equal = open_ & (text == a[pair, i][:, None]) & ((alo <= i) & (i < ahi))[:, None]
        before = np.zeros_like(run)
        before[:, 1:] = run[:, :-1]
        run = np.where(equal, before + 1, 0)
        end = run.argmax(axis=1)
        length = run[every, end]
        longer = length > size
        size[longer] = length[longer]
        at[longer] = i + 1 - length[longer]
        bt[longer] = end[longer] + 1 - length[longer]
    while True:
        wider = (at > alo) & (bt > blo)
        wider[wider] = a[pair[wider], at[wider] - 1] == text[wider, bt[wider] - 1]
        if not wider.any():
            break
        at[wider] -= 1
        bt[wider] -= 1
        size[wider] += 1
    while True:
        wider = (at + size < ahi) & (bt + size < bhi)
        wider[wider] = a[pair[wider], (at + size)[wider]] == text[wider, (bt + size)[wider]]
        if not wider.any():
            return at, bt, size
        size[wider] += 1


def gestalt_ratios(first: Sequence[str], second: Sequence[str], cutoff: float = 0.0) -> np.ndarray:
    """Twice the matched characters over the characters of both texts, pair
    by pair (1 for two empty texts); pairs that stay below ``cutoff`` may get
    any value below it.

    All pairs go in step: each round finds the longest common run of every
    open segment and leaves the parts before and behind it to the next."""
    out = np.ones(len(first))
    # Only lengths and shared characters first: upper bounds of the ratio.
    total = np.array([len(x) + len(y) for x, y in zip(first, second, strict=True)], np.int64)
    bound = np.array([min(len(x), len(y)) for x, y in zip(first, second, strict=True)], np.int64)
    some = total > 0
    out[some] = 2.0 * bound[some] / total[some]
    todo = np.flatnonzero(some & (out >= cutoff))
    # texts of similar length share a block, so that padding stays small
    todo = todo[np.argsort(total[todo], kind="stable")]
    lo = 0
    while lo < len(todo):
        hi = lo + 1
        while hi < len(todo) and (hi + 1 - lo) * total[todo[hi]] <= BLOCK_CELLS:
            hi += 1
        rows = todo[lo:hi]
        out[rows] = _block([first[i] for i in rows], [second[i] for i in rows], total[rows], cutoff)
        lo = hi
    return out


def _block(first: Sequence[str], second: Sequence[str], total: np.ndarray, cutoff: float) -> np.ndarray:
    a, na = _codes(first, -2)
    b, nb = _codes(second, -1)
    if cutoff > 0:
        shared = np.zeros(len(a), np.int64)
        for ch in np.unique(a[a >= 0]):
            shared += np.minimum((a == ch).sum(axis=1), (b == ch).sum(axis=1))
        ratio = 2.0 * shared / total
        live = np.flatnonzero(ratio >= cutoff)
    else:
        ratio = np.zeros(len(a))
        live = np.arange(len(a))
    able = _starters(b, nb)
    matched = np.zeros(len(a), np.int64)
    seg = np.stack([live, np.zeros_like(live), na[live], np.zeros_like(live), nb[live]], axis=1)
    while True:
        seg = seg[(seg[:, 1] < seg[:, 2]) & (seg[:, 3] < seg[:, 4])]
        if not len(seg):
            break
        at, bt, size = _longest(a, b, able, seg)
        np.add.at(matched, seg[:, 0], size)
        hit = size > 0
        seg, at, bt, size = seg[hit], at[hit], bt[hit], size[hit]
        left, right = seg.copy(), seg.copy()
        left[:, 2], left[:, 4] = at, bt
        right[:, 1], right[:, 3] = at + size, bt + size
        seg = np.concatenate([left, right])
    ratio[live] = 2.0 * matched[live] / total[live]
    return ratio


def gestalt_score(a: Column, b: Column) -> Column:
    """Gestalt ratio of two texts (NULL if either is NULL); the second text
    is the one whose common characters begin no match when it is long."""
    @F.pandas_udf(DoubleType())
    def _score(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), None, object)
        out[both] = gestalt_ratios(x[both].tolist(), y[both].tolist())
        return pd.Series(out, dtype="Float64")

    return _score(a, b)


def _best(values: Sequence[str], candidates: Sequence[str], cutoff: float) -> np.ndarray:
    """Index of each value's best candidate, -1 where none reaches the cutoff."""
    score = np.full(len(values), -1.0)
    best = np.full(len(values), -1)
    # from the greatest text down, so that a tie keeps the greater; equal
    # texts keep the first index
    for i in sorted(range(len(candidates)), key=lambda i: (candidates[i], -i), reverse=True):
        got = gestalt_ratios([candidates[i]] * len(values), values, cutoff)
        better = (got >= cutoff) & (got > score)
        score[better], best[better] = got[better], i
    return best


def gestalt_cascade(skip: Column, first: Column, second: Column, first_cands: Sequence[str],
                    second_cands: Sequence[str], cutoff: float = 0.8) -> Column:
    """One Python pass for the two-stage match: best of ``first_cands`` for
    ``first``, else best of ``second_cands`` for ``second``; rows flagged
    ``skip`` (already settled) are not scored.  Returns the index (the two
    candidate lists are aligned) or NULL."""
    c1, c2 = list(first_cands), list(second_cands)

    @F.pandas_udf(IntegerType())
    def _cascade(sk: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        found = np.full(len(sk), -1)
        for values, cands in ((a, c1), (b, c2)):
            rows = np.flatnonzero(~sk.fillna(False).to_numpy(bool) & values.notna().to_numpy() & (found < 0))
            found[rows] = _best(values.iloc[rows].tolist(), cands, cutoff)
        return pd.Series(found, dtype="Int32").where(found >= 0)

    return _cascade.asNondeterministic()(skip, first, second)
