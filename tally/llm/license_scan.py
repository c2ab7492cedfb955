"""Licence scan: Aho-Corasick for tags and notices, shunting-yard for
licence expressions.

One automaton holds every notice phrase and identifier tag as blank-separated
words; one pass over a text's words finds them all.  Behind an identifier tag
the rest of the line is a licence expression, whose and/or/with grammar a
shunting-yard parser turns into postfix order and evaluates.  Rows are
independent, so the scan is one Arrow pass without a shuffle.

A tag counts only with its separator (a colon or equals sign behind it): "this
license expression is broken" is prose.  An operand gives a label only if it
is a known identifier (``known_identifier``); others, and whatever stands in
an expression with one, are reported as kind ``unknown`` with the identifier
in the place's span and an empty label.  Behind the tag "license expression",
which prose may use with a colon as well, an expression without any known
identifier is no find at all.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in
lower case.  Defined results: a null text scans like the empty one (no words,
no finds); a broken expression is reported as such and gives no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import byte_class

#: Phrases whose places are counted (fixed values).
BASE_NOTICES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices and titles of common licences.
MORE_NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "eclipse public license v 2": "epl-2",
    "boost software license version 1": "bsl-1",
    "creative commons attribution 4": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
}
#: Tags that announce a licence expression.
TAGS = ("spdx license identifier", "license expression")
PERMISSIVE = frozenset({"mit", "apache-2", "bsd", "isc", "cc0", "cc-by", "bsl-1", "zlib", "unlicense"})

FINDS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType(), False), T.StructField("kind", T.StringType(), False),
    T.StructField("first_word", T.LongType(), False), T.StructField("words", T.IntegerType(), False),
    T.StructField("begin", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)

_MEMBER = byte_class(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_FOLD = bytes(ord(bytes([i]).lower()) if _MEMBER[i] else 0x20 for i in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    entries = [(p, "base", label) for p, label in BASE_NOTICES.items()]
    entries += [(p, "notice", label) for p, label in MORE_NOTICES.items()]
    entries += [(p, "tag", "") for p in TAGS]
    for phrase, kind, label in entries:
        found.add_word(f" {phrase} ", (len(phrase) + 1, phrase.count(" ") + 1, kind, label))
    found.make_automaton()
    return found


#: Names (families) of licence identifiers; versions and endings follow by rule.
FAMILIES = frozenset(
    "0bsd afl agpl apache apsl artistic bsd bsl cc0 cddl cecill ecl epl eupl gfdl gpl isc lgpl lppl mit mit-0 mpl "
    "ms-pl ms-rl ncsa ofl openssl osl php postgresql psf python ruby unlicense upl vim w3c wtfpl x11 zlib".split())
_CREATIVE = re.compile(r"cc-by(-nc)?(-sa|-nd)?")
_VERSION = re.compile(r"-v?\d+(\.\d+)*")


def known_identifier(identifier: str) -> bool:
    """Whether a word is a licence identifier: a family's name, a version that
    follows it, and an ending."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    if re.fullmatch(r"bsd-\d-clause(-[a-z-]+)?", name):
        return True
    name = _VERSION.sub("", name, count=1) if not name.startswith(("0", "mit-0")) else name
    return name in FAMILIES or _CREATIVE.fullmatch(name) is not None


# -- licence expressions ---------------------------------------------------

_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_RANK = {"or": 1, "and": 2, "with": 3}


def licence_label(identifier: str) -> str:
    """Label of a licence identifier: without its version's zeros and its
    "only"/"or later" endings; Creative Commons without any version."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    if name.startswith("cc"):
        return re.sub(r"-\d+(\.\d+)*$", "", name)
    if re.fullmatch(r"bsd-\d-clause.*", name):
        return "bsd"
    return re.sub(r"(-\d+)\.0(\.0)?$", r"\1", name)


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: postfix order of an and/or/with expression, or None if
    it is broken.  What stands behind the expression is left alone."""
    out: list[str] = []
    stack: list[str] = []
    operand, at, depth = True, 0, 0
    while m := _TOKEN.match(expression, at):
        bracket, word = m.groups()
        low = (word or "").lower()
        if operand:
            if bracket == "(":
                stack.append("(")
                depth += 1
            elif word and low not in _RANK:
                out.append(word.rstrip(".:"))
                operand = False
            else:
                return None
        elif bracket == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            break  # plain text goes on
        at = m.end()
    if operand or depth:
        return None
    return out + stack[::-1]


def evaluate(order: list[str]) -> tuple[frozenset[str], bool]:
    """Labels an expression names and whether its user can choose permissive
    terms: "or" needs one permissive side, "and" both; an exception ("with")
    keeps the licence's own answer."""
    stack: list[tuple[frozenset[str], bool]] = []
    for token in order:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            else:
                free = left[1] or right[1] if token == "or" else left[1] and right[1]
                stack.append((left[0] | right[0], free))
        else:
            label = licence_label(token)
            stack.append((frozenset({label}), label in PERMISSIVE))
    return stack.pop()


def licences(order: list[str]) -> list[str]:
    """The operands that name licences (not the exceptions behind "with")."""
    stack: list[list[str]] = []
    for token in order:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left + right)
        else:
            stack.append([token])
    return stack.pop()


# -- scan ------------------------------------------------------------------

def scan_text(raw: bytes) -> tuple[int, list[tuple]]:
    """Number of words and all finds of one UTF-8 text."""
    words = raw.translate(_FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("utf-8") if words else " "
    hits = list(_automaton().iter(line))
    if not hits:
        return len(words), []
    places = [m.span() for m in _WORD.finditer(raw)]
    finds, seen, counted = [], 0, 0
    for end, (size, n, kind, label) in sorted(hits, key=lambda h: h[0] - h[1][0]):
        start = end - size  # the blank before the first word
        counted += line.count(" ", seen, start)
        seen, first = start, counted
        begin, stop = places[first][0], places[first + n - 1][1]
        if kind != "tag":
            finds.append((label, kind, first, n, begin, stop))
            continue
        rest = raw[stop:].split(b"\n", 1)[0].decode("utf-8")
        separator = re.match(r"[ \t]*[:=][ \t]*", rest)
        if separator is None:
            continue  # prose
        order = postfix(rest[separator.end():])
        terms = [x for x in order or () if x not in _RANK]
        if n < 3 and not any(map(known_identifier, terms)):
            continue  # "license expression: see below"
        if order is None:
            finds.append(("", "broken", first, n, begin, stop))
            continue
        if not all(map(known_identifier, licences(order))):
            finds.append(("", "unknown", first, n, begin, stop))
            continue
        labels, free = evaluate(order)
        kind = "permissive" if free else "expression"
        finds += [(x, kind, first, n, begin, stop) for x in sorted(labels)]
    return len(words), finds


#: How sure one find of each kind makes the scan.
_TRUST = {"base": 0.9, "notice": 0.8, "expression": 0.97, "permissive": 0.97, "broken": 0.3, "unknown": 0.3}


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``finds`` (label, kind,
    first word, words, byte span; kinds: base, notice, expression, permissive
    expression, broken expression, unknown identifiers), ``labels`` and ``score`` in 0..1."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_words", T.LongType(), False),
                           T.StructField("finds", FINDS, False),
                           T.StructField("labels", T.ArrayType(T.StringType(), False), False),
                           T.StructField("score", T.DoubleType(), False)])
    kinds = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()),
                       ("words", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
    names = [f.name for f in FINDS.elementType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, finds, labels, scores = [], [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                n, found = scan_text(text.as_py() or b"")
                counts.append(n)
                finds.append([dict(zip(names, x, strict=True)) for x in found])
                labels.append(sorted({x[0] for x in found if x[0]}))
                doubt = {x[0]: 1 - _TRUST[x[1]] for x in found}
                scores.append(1 - float(np.prod(list(doubt.values()))) if doubt else 0.0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(finds, pa.list_(kinds)),
                pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64()),
            ], names=[id_col, "n_words", "finds", "labels", "score"])

    return rows.mapInArrow(run, schema)
