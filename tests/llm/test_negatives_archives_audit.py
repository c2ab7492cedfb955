"""Hard negatives, archives and the filter audit against plain Python."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tally.llm import filter_audit, hard_negatives, warc
from tally.llm.queries import ORACLES, QUERIES
from tally.operators.ranking import global_row_number

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_warc", "op13_filter_audit"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    at = [list(rel.columns).index(c) for c in columns]
    assert columns == sorted(rel.columns)
    want = Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want


# -- hard negatives ----------------------------------------------------------

def mined(rows, positives=5, negatives=3, low=50, high=95):
    """rows: (id, vector, label), ids given and different."""
    whole = [(i, [math.floor(256 * x) for x in v], t) for i, v, t in rows
             if t is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, u, label in whole:
        if a % 50:
            continue
        scores = [(sum(x * y for x, y in zip(u, v, strict=True)), i, t) for i, v, t in whole if i != a and len(v) == len(u)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            fit = [x for x in scores if x[2] != label and low * s <= 100 * x[0] <= high * s][:negatives]
            out |= {(a, p, r + 1, n, s, score) for r, (score, n, _) in enumerate(fit)}
    return out


def mine(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int, _id int, _segment int")
    out = hard_negatives.mine(df, "vec_id", "v", "label", F.col("vec_id") % 50 == 0, **kw)
    return [tuple(r) for r in out.collect()]


def vectors(seed, n, d=6):
    """Clusters, ties and copies; a third of the rows is one vector."""
    rng = random.Random(seed)
    ways = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    out = []
    for i in range(n):
        way = ways[rng.randrange(4)]
        v = ways[0] if i % 3 == 0 else [x + rng.gauss(0, 0.4) for x in way]
        out.append((i, [round(x, 1) for x in v], rng.randrange(3)))
    return out


def test_walks_find_what_brute_force_finds(spark, monkeypatch):
    """Small segments, blocks and steps, so that walks take several rounds."""
    rows = vectors(3, 700)
    rows += [(1000, None, 1), (1050, [], 1), (1100, [1.0] * 6, None), (1150, [math.inf] * 6, 1),
             (1200, [None] + [1.0] * 5, 1), (1250, [math.nan] * 6, 1), (1300, [0.0] * 6, 1),
             (1350, [1.0, 2.0], 2), (1351, [2.0, 4.0], 2), (1352, [2.0, 3.0], 1), (1353, [0.5, 1.5], 0)]
    want = mined(rows)
    assert any(a == 1350 for a, *_ in want) and len(want) > 100
    full = [(*r, 1, 1) for r in rows]
    assert Counter(mine(spark, full)) == Counter(want)
    for name, value in (("SEGMENT", 64), ("STEP", 16), ("BLOCK", 8), ("PER_CLUSTER", 3), ("FIRST", 1), ("GROWTH", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert Counter(mine(spark, full)) == Counter(want)
    assert Counter(mine(spark, full + full)) == Counter(want)  # equal rows count once


def test_bound_is_never_below_a_score():
    rng = random.Random(5)
    sample = [hard_negatives.np.array([rng.gauss(0, 90) for _ in range(8)]) for _ in range(60)]
    centres = hard_negatives.fit_centres(sample, 5)[8]
    angle = hard_negatives.np.array(hard_negatives._angles(sample, {8: centres}))
    own = angle.argmin(axis=1)
    for j in range(len(centres)):
        members = [v for v, o in zip(sample, own, strict=True) if o == j]
        width = max((angle[i, j] for i in range(60) if own[i] == j), default=0)
        for i, v in enumerate(sample):
            bound = hard_negatives.np.linalg.norm(v) * math.cos(max(0.0, angle[i, j] - width - 1e-6))
            assert all(u @ v <= bound * hard_negatives.np.linalg.norm(u) * (1 + 1e-9) + 1e-6 for u in members)


def test_wide_numbers_and_repeated_ids(spark):
    big = 2.0**21  # 256 times: 2**29, products beyond 2**53
    rows = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big * 0.75, 3.0], 2), (3, [big * 0.75, 3.0 + 2**-8], 2),
            (4, [2.0**23, 2.0**23], 1), (5, [1e300, 1.0], 2)]
    assert Counter(mine(spark, [(*r, 0, 0) for r in rows])) == Counter(mined(rows[:4]))  # 4 and 5: too large
    again = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (2, [0.6, 0.0], 2), (None, [0.9, 0.0], 3)]
    out = mine(spark, [(*r, 0, 0) for r in again])
    assert sorted((r[0], r[1], r[2], r[3] is None, r[4], r[5]) for r in out) == [
        (0, 1, 1, False, 65536, 230 * 256), (0, 1, 2, True, 65536, 230 * 256), (0, 1, 3, False, 65536, 153 * 256)]
    assert mine(spark, []) == [] and mine(spark, [(1, [1.0], 1, 0, 0)]) == []
    assert mine(spark, [(0, [1.0], 1, 0, 0)]) == []


# -- archives ------------------------------------------------------------------

def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def round_trip(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _key int, _sha string")
    folder = warc.write_archives(df, "page_id", "url", "html", **kw)
    return folder, warc.read_archives(spark, folder).collect()


def archives(spark, folder):
    files = spark.read.format("binaryFile").load(folder).collect()
    return [bytes(r.content) for r in files]


def test_archives_round_trip(spark):
    rng = random.Random(2)
    texts = ["", "same", "same", "é\r\n\r\nWARC/1.1\r\n", "x" * 300_000, None,
             "".join(rng.choice("abc \0\n") for _ in range(5000))]
    rows = [(i, f"http://h/{i}", rng.choice(texts), 0, "") for i in range(200)]
    rows += [(300 + i, "http://h/ a\r\nX: y", "hot", 0, "") for i in range(100)] + [(400, None, "hot", 0, "")]
    folder, out = round_trip(spark, rows, archive_bytes=200_000)
    first = {}
    for i, _, t, *_ in rows:
        first.setdefault(t or "", i)
    got = {r.record_key: r for r in out}
    assert len(got) == len(out) == len(rows) and all(r.error is None for r in out)
    for i, url, t, *_ in rows:
        data, r = (t or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), b32(data))
        if first[t or ""] == i:
            assert (r.record_type, r.refers_to) == ("response", None) and bytes(r.payload) == data
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first[t or ""], None)
    assert got[300].uri == "http://h/%20a%0D%0AX:%20y" and got[400].uri.startswith("urn:record:")
    stored = archives(spark, folder)
    assert len(stored) > 1
    # Any gzip reader reads them whole: one member per record, and one ahead.
    records = [m for a in stored for m, error in warc.members(a) if m]
    assert all(gzip.decompress(a) == b"".join(m for m, _ in warc.members(a)) for a in stored)
    assert len(records) == len(rows) + len(stored) and all(m.startswith(b"WARC/1.1\r\n") for m in records)
    names = [line for m in records for line in m.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    refers = {line.split(b": ")[1] for m in records for line in m.split(b"\r\n") if line.startswith(b"WARC-Refers-To:")}
    assert len(set(names)) == len(rows) + 1 and refers <= {n.split(b": ")[1] for n in names}


def test_archives_of_odd_tables(spark):
    assert round_trip(spark, [])[1] == []
    rows = [(1, "u", "a", 0, ""), (1, "u", "a", 0, ""), (1, "v", "b", 0, ""), (None, "w", "a", 0, ""),
            (None, "x", "c", 0, ""), (None, "y", "c", 0, ""), (2, "u", "long text", 0, ""), (3, "u", "long text", 0, "")]
    _, out = round_trip(spark, rows)
    kinds = Counter((r.record_key, r.payload_digest, r.record_type, r.refers_to) for r in out)
    assert kinds == Counter([
        (1, b32(b"a"), "response", None), (1, b32(b"a"), "revisit", 1), (1, b32(b"b"), "response", None),
        (None, b32(b"a"), "revisit", 1), (None, b32(b"c"), "response", None), (None, b32(b"c"), "revisit", None),
        (2, b32(b"long text"), "response", None), (3, b32(b"long text"), "revisit", 2)])
    _, out = round_trip(spark, rows, min_revisit_bytes=5)
    assert Counter(r.record_type for r in out) == {"response": 7, "revisit": 1}


def test_long_record_ends_in_a_zero():
    record = warc.content_record(1, "u", b"x" * (1 << 24), "D", None, False, 0, "text/plain")
    packed = warc.member(record)
    assert packed[-1] == 0 and [m for m, _ in warc.members(packed)] == [record, b""]


def test_damage_is_reported_and_passed(spark):
    def record(i, text):
        return warc.content_record(i, "u", text, b32(text), None, False, 0, "text/plain")

    good = [record(i, f"text {i}".encode()) for i in range(4)]
    packed = [warc.member(r) for r in good]
    cut = bytearray(packed[1])
    cut[len(cut) // 2] ^= 0xFF  # damaged inside the member
    archive = packed[0] + bytes(cut) + packed[2] + packed[3][:-9]  # and one cut short
    found = [(m, e is not None) for m, e in warc.members(archive)]
    assert [m for m, e in found if not e] == [good[0], good[2]] and any(e for _, e in found[1:2]) and found[-1][1]
    assert warc.parse(good[0].replace(b"text 0", b"text 9"))["error"] == "block digest"
    assert "frame" in warc.parse(good[0][:-1])["error"] and "frame" in warc.parse(good[0] + b"x")["error"]
    assert warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")["error"] == "no version line"
    swapped = good[0].replace(b32(b"text 0").encode(), b32(b"text 1").encode())
    assert warc.parse(swapped)["error"] == "payload digest"
    assert [list(warc.members(b"")), list(warc.members(zlib.compress(b"x") * 2))[0][1] is not None] == [[], True]
    row = warc.parse(good[3])
    assert (row["record_key"], bytes(row["payload"]), row["error"]) == (3, b"text 3", None)


# -- filter audit --------------------------------------------------------------

def audited(rows, good, bad):
    """rows: (id, text, source), ids given."""
    def fails(i, t):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        out = ""
        out += "A" if len(words) < 50 else ""
        out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        out += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else ""
        out += "D" if any(c in "#$%&*|" for c in t) else ""
        return out + ("E" if any(j < i and (u or "") == t for j, u, _ in rows) else "")

    judged = [(i, s or "", fails(i, t or "")) for i, t, s in rows]
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    out = {}
    for part in {s for _, s, _ in judged}:
        here = [(i, f) for i, s, f in judged if s == part]
        for order in orders:
            left = here
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                out[part, order, step] = [len(left), len(gone), sum(x in f for _, f in here) - len(gone),
                                          sum(f == x for _, f in here), sum(i in good for i, _ in gone),
                                          sum(i in bad for i, _ in gone)]
        total = Counter()
        for order in orders:
            for step, x in enumerate(order, 1):
                total[x] += out[part, order, step][1]
        for order in orders:
            for step, x in enumerate(order, 1):
                out[part, order, step].append(total[x])
    return {(*k, *v) for k, v in out.items()}


def audit(spark, rows, marks):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {"part": F.lit(1), "_mask": F.lit(2), "quality": F.lit(3)})
    labels = spark.createDataFrame(marks, "doc_id long, g boolean, b boolean").withColumn("text", F.lit("x"))
    out = filter_audit.audit_documents(docs, "doc_id", "text", "source", labels, {"g": "good_lost", "b": "toxic_lost"})
    return [tuple(r) for r in out.collect()]


def test_audit_equals_applying_the_filters(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "Gamma", "DELTA", "x$", "é", " ", "naïve "] + [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        n = rng.choice([0, 1, 30, 49, 50, 80])
        pool = rng.choice([words[-60:], words, words[:4]])
        rows.append((i, rng.choice([" ", "\n\t", "\x0b"]).join(rng.choice(pool) for _ in range(n)), rng.choice(["a", "b", None, ""])))
    hot = " ".join(words[-60:])
    rows += [(200 + i, hot, rng.choice("ab")) for i in range(80)]
    rows += [(300, None, "c"), (301, "", "a"), (302, "word " * 200_000, "a")]
    good, bad = {3, 200, 205, 301}, {4, 206, 300}
    marks = [(i, i in good, i in bad) for i in good | bad] + [(3, False, None), (None, True, True), (9999, True, True)]
    got = audit(spark, rows, marks)
    assert len(got) == 4 * 600 and set(got) == audited(rows, good, bad)


def test_audit_of_odd_tables(spark):
    assert audit(spark, [], []) == []
    rows = [(1, "a", "s"), (1, "a", "s"), (2, "a", "s"), (None, "a", "s"), (None, "b", "s"), (None, "b", "s")]
    got = {r[1:3]: r for r in audit(spark, rows, [(1, True, False)])}
    # E alone: 2 and the row without an id are copies of 1; equal ids are not
    assert got["EABCD", 1][3:9] == (4, 2, 0, 0, 0, 0) and got["AEBCD", 1][3:9] == (0, 6, 0, 4, 2, 0)


def test_global_row_number_orders_the_lists(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as k")
    out = sorted((r.row_number, r.k, r.id) for r in global_row_number(df, ["k", "id"]).collect())
    assert [x[1:] for x in out] == sorted((i % 3, i) for i in range(100))
