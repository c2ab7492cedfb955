import random
import zlib
from collections import Counter

import brute
from pyspark.sql import functions as F

from tally.llm import license_scan, line_dedup, sharding
from tally.llm.queries import op7_sharding, op8_license_scan, op9_line_dedup

SF_SMALL = "/root/testdata/sf0.001"


# -- sharding --------------------------------------------------------------

def ring(keys, shards, virtual_nodes):
    """Row by row: rows in rank order within a cell, cells in rounds."""
    arcs = sharding.preferences(shards, virtual_nodes)
    prefer = {}
    for low, high, order in arcs:
        for cell in range(low, high + 1):
            prefer[cell] = order
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    left = sorted((sharding.ring_cell("" if k is None else str(k)), i) for i, k in enumerate(keys))
    place = {}
    for r in range(shards):
        rest = []
        for cell, i in left:
            s = prefer[cell][r]
            if room[s]:
                room[s] -= 1
                place[i] = s
            else:
                rest.append((cell, i))
        left = rest
    return place


def test_ring_counts_and_slots(spark):
    keys = [*range(997), None]
    rows = [(k, f"text {k}", 1) for k in keys]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    for shards in (1, 3, 8):
        out = sharding.assign(df, "doc_id", "text", shards).collect()
        assert len(out) == len(rows)
        want = ring(keys, shards, 64)
        assert {r.doc_id: r.shard for r in out} == {keys[i]: s for i, s in want.items()}
        for s in range(shards):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(x == s for x in want.values())))
    moved = sum(r.shard != r.home for r in out)
    assert moved < 0.35 * len(rows)


def test_one_more_shard_moves_little():
    """Without full shards a ring moves keys into the new shard only."""
    cells = {}
    for shards in (8, 9):
        for low, high, order in sharding.preferences(shards, 64):
            for cell in range(low, high + 1):
                cells[shards, cell] = order[0]
    moved = [cells[9, c] for c in range(sharding.RING) if cells[9, c] != cells[8, c]]
    assert set(moved) == {8} and len(moved) < 0.2 * sharding.RING


def test_sharding_defined_cases(spark):
    df = spark.createDataFrame([(5, None), (5, None), (5, "é"), (None, ""), (None, "x" * 100000)],
                               "doc_id long, text string").withColumn("shard", F.lit("clash"))
    out = sharding.assign(df, "doc_id", "text", 2).collect()
    assert sorted(r.size for r in out) == [1, 1, 1, 3, 100001]
    assert sorted(Counter(r.shard for r in out).values()) == [2, 3]
    assert sharding.assign(df.limit(0), "doc_id", "text", 2).count() == 0


def test_op7_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = op7_sharding(spark, SF_SMALL).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    for r in out:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1


# -- licences --------------------------------------------------------------

def test_expressions():
    parse = license_scan.postfix
    assert parse("MIT") == ["MIT"]
    assert parse("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert parse("(MIT or Apache-2.0) and GPL-2.0-only WITH Classpath-exception-2.0") == [
        "MIT", "Apache-2.0", "or", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and"]
    assert parse("MIT and some text") is not None and parse("MIT some text") == ["MIT"]
    for broken in ("", "and MIT", "(MIT", "MIT or", "()", "MIT or )"):
        assert parse(broken) is None
    value = lambda e: license_scan.evaluate(parse(e))
    assert value("MIT OR GPL-3.0-only") == ({"mit", "gpl-3"}, True)
    assert value("MIT AND GPL-3.0-or-later") == ({"mit", "gpl-3"}, False)
    assert value("GPL-2.0+ WITH Classpath-exception-2.0") == ({"gpl-2"}, False)
    deep = "(" * 3000 + "MIT" + ")" * 3000
    assert value(deep) == ({"mit"}, True)


def base_scan(text):
    folded = (text or "").translate(brute.ASCII_LOWER)
    words = "".join(c if (c > "\x7f" or c.isalnum()) else " " for c in folded).split(" ")
    words = [w for w in words if w]
    places = [(i, label) for phrase, label in license_scan.BASE_NOTICES.items() for i in range(len(words))
              if words[i:i + phrase.count(" ") + 1] == phrase.split(" ")]
    return len(words), places


def test_scan_defined_cases(spark):
    texts = ["Released under the MIT License. Under  the\nMIT-license", "Apache License, Version 2.0", None, "", "CC BY-NC 4.0",
             "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nmore", "SPDX-License-Identifier: MIT AND",
             "unterthe mit license", "ünder the mit license x", "filler é " * 30000 + "under the mit license",
             "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scan(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        n, places = base_scan(t)
        assert got[i].n_words == n
        assert sorted((f.first_word, f.label) for f in got[i].finds if f.kind == "base") == sorted(places)
        for f in got[i].finds:
            assert (t or "").encode()[f.begin:f.end].decode()
    assert got[5].labels == ["apache-2", "bsd", "mit"] and {f.kind for f in got[5].finds} == {"permissive"}
    assert got[6].labels == [] and got[6].finds[0].kind == "broken"
    assert got[10].labels == ["gpl-2"] and got[10].finds[0].kind == "expression"
    assert got[2].score == got[3].score == 0 and 0.8 < got[0].score <= 1
    assert license_scan.scan(df.limit(0), "doc_id", "text").count() == 0


def test_op8_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = op8_license_scan(spark, SF_SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        n, places = base_scan(docs[r.doc_id])
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            n, len(places), min(starts, default=None), max(starts, default=None))
        base = sorted({label for _, label in places})
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) | {""}


# -- lines -----------------------------------------------------------------

def test_lines_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        host = rng.choice(["big"] * 6 + ["a", "b", "c", None])
        lines = [rng.choice(["menu", "  menu ", "login", "news", "", "\t", f"own {i}", f"topic {rng.randrange(50)}"])
                 for _ in range(rng.randint(0, 12))]
        rows.append((i, host, "\n".join(lines)))
    rows += [(400, "big", None), (401, "big", "menu\n" * 20000), (402, None, "menu"), (402, "solo", "menu\nmenu")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "id long, host string, text string, n_dropped string")
    out = line_dedup.drop_boilerplate(df, "host", "text", 0.2, 3)
    assert out.columns == ["id", "host", "text", "n_lines", "n_dropped"]
    want = brute.drop_lines([(h, t) for _, h, t in rows], 0.2, 3)
    got = sorted(((r.id, r.host or "", r.text) for r in out.collect()), key=str)
    assert got == sorted(((r[0], r[1] or "", w) for r, w in zip(rows, want, strict=True)), key=str)
    assert any(r.n_dropped for r in out.collect())
    assert line_dedup.drop_boilerplate(df.limit(0), "host", "text", 0.2).count() == 0


def test_lines_run_no_python(spark):
    plan = op9_line_dedup(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_visible_text(spark):
    html = ("<html><head><title>T &amp;lt;</title><style>p{}</style><script>var t='</p>';\n</script></head><body><!-- a\n -->"
            "<p>one <b>two</b></p>\n\n<ul><li>x</li><li>y &lt;z&gt;</li></ul></body></html>")
    row = spark.createDataFrame([(html, "HTTPS://u@WWW.Example.com:80/x?y")], "html string, url string").select(
        line_dedup.visible_text(F.col("html")).alias("t"), line_dedup.url_host(F.col("url")).alias("h")).first()
    assert row.t == "T &lt;\none two\nx\ny <z>" and row.h == "www.example.com"
