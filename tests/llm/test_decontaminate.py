"""FM-index decontamination against brute force."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from leafspan.llm import decontaminate
from tests.llm.same import differ

SF = "/root/testdata/sf0.001"


def brute(docs, items):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= {*range(i, i + n)}
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("items"))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    long = items[0][1]
    more = [(None, long), (-1, None), (-2, ""), (-3, "..."), (-4, long.upper() + " " + long), (-5, "x é 日本 " * 300 + "tail of item"), (-5, "x é 日本 " * 300 + "tail of item"), (-6, "zq")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("items", F.lit("y")))
    odd = [(900, "tail of item"), (901, "zq"), (902, ""), (903, None), (None, "é 日本 x"), (904, long), (904, long), (905, "é 日本")]
    bench = spark.createDataFrame(items + odd, "item_id long, text string")
    key = lambda r: (r[0] is None, str(r))
    want = sorted(brute([tuple(r) for r in docs.select("doc_id", "text").collect()], items + odd), key=key)
    assert sum(w[2] > 0 for w in want) > 5
    got = sorted((tuple(r) for r in decontaminate.digest(decontaminate.find_overlap(docs, bench)).collect()), key=key)
    assert not differ(got, want)
    monkeypatch.setattr(decontaminate, "BLOCK", 1000)
    for blocks in (1000, 4):  # all blocks in one pass, and several passes
        monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
        got = sorted((tuple(r) for r in decontaminate.digest(decontaminate.find_overlap(docs, bench)).collect()), key=key)
        assert not differ(got, want)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert decontaminate.find_overlap(docs.limit(0), bench).count() == 0
    assert decontaminate.digest(decontaminate.find_overlap(docs, bench.limit(0))).where("n_hit > 0 or contaminated").count() == 0


def test_index():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        s = rng.integers(0, 4, n)
        index = decontaminate.FMIndex(s, 3)
        phrases = np.array([[a, b, c] for a in range(1, 4) for b in range(1, 4) for c in range(1, 4)] + [[0, 0, a] for a in range(1, 4)])
        lengths = np.array([3] * 27 + [1] * 3)
        which, low, high = index.search(phrases, lengths)
        got = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which.tolist(), low, high)}
        want = {}
        for k, p in enumerate(phrases.tolist()):
            p = p[3 - lengths[k] :]
            if at := [i for i in range(n - len(p) + 1) if s[i : i + len(p)].tolist() == p]:
                want[k] = at
        assert got == want


def test_a_block_stays_small():
    """A full block is eight bytes a word, and a second one only adds its own search."""
    import time
    import tracemalloc

    rng = np.random.default_rng(2)
    block = lambda: decontaminate.Block([str(k) for k in range(400)], rng.integers(1, 2**63, 400_000, np.int64).astype(np.uint64), np.full(400, 1000))
    one, two = block(), block()
    text = "some words that no benchmark has " * 20_000
    took = []
    for blocks in ([one], [one, two]):
        pairs = decontaminate.Pairs(blocks)
        tracemalloc.start()
        began = time.time()
        n, spans, items = decontaminate._search([text, None], pairs, blocks)
        took.append(time.time() - began)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()
        assert n == [120_000, 0] and spans == [[], []] and items == [[], []]
    assert took[1] < 2 * took[0] + 1
