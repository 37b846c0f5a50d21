"""Pseudonyms, the quality model and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import pseudonyms, quality_model
from tests.llm.same import differ

SF = "/root/testdata/sf0.01"
KEY = b"k"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 5041])
def test_feistel_permutes(size):
    f = pseudonyms.Feistel(KEY, "x", size)
    image = [f(x) for x in range(size)]
    assert sorted(image) == list(range(size)) and [f(y, True) for y in image] == list(range(size))
    assert size < 90 or image != list(range(size))


def test_kinds():
    make = pseudonyms.Pseudonyms(KEY)
    rng = random.Random(2)
    card = "".join(rng.choice("0123456789") for _ in range(14))
    card = f"4{card}{pseudonyms.luhn('4' + card)}"
    good = {"card": [card, f"{card[:4]} {card[4:8]}-{card[8:12]} {card[12:]}"], "phone": ["+1 (743) 555-3824", "212-555-0199"], "ip": ["193.195.198.107", "0.0.0.0"], "ssn": ["123-45-6789", "899-99-9999"], "date": ["2024-02-29", "3/9/1999", "31.12.2001", "03/9/1999"], "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]}
    for kind, values in good.items():
        for v in values:
            text, n, spans = make(f"see {v}, {v}.")
            new = re.fullmatch(r"see (.*), (.*)\.", text)
            assert n[kind] == 2 and new[1] == new[2] != v, (kind, v, text)
            assert kind == "ip" or re.sub("[0-9]", "0", re.sub("[A-Z]", "A", new[1])) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", v))
            assert make(new[1])[1][kind] == 1 and make.restore(text, spans) == f"see {v}, {v}."
    for v in ("4785380592391138", "2024-02-30", "999.1.1.1", "666-12-1234", "123-00-1234", "GB82 WEST 1234 5698 7654 33", "x4785", "1.2.3.4.5", ""):
        assert make(v) == (v, dict.fromkeys(pseudonyms.KINDS, 0), []), v
    assert make(None)[0] is None
    text, n, _ = make("a.b@x.example.com A.B@X.EXAMPLE.COM")
    assert n["email"] == 2 and len(set(text.split())) == 1


def test_every_date_in_every_format():
    """A day keeps its pseudonym however it is written, and the map of the written forms is one to one and inverted by the key."""
    import datetime

    make = pseudonyms.Pseudonyms(KEY)
    day, seen = datetime.date(1900, 1, 1), set()
    while day.year < 2100:
        y, m, d = day.year, day.month, day.day
        forms = [f"{y}-{m:02d}-{d:02d}", f"{m:02d}/{d:02d}/{y}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{d}.{m}.{y}"]
        new = [make.date(f) for f in forms]
        year, month, of = map(int, new[0].split("-"))
        assert new == [f"{year}-{month:02d}-{of:02d}", f"{month:02d}/{of:02d}/{year}", f"{of:02d}.{month:02d}.{year}", f"{month}/{of}/{year}", f"{of}.{month}.{year}"]
        assert [len(f) for f in new] == [len(f) for f in forms] and make.restore(new[3], [(0, len(new[3]), "date")]) == forms[3]
        seen.add(new[0])
        day += datetime.timedelta(1)
    assert len(seen) == 73049


def test_pseudonymise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_found", F.lit("x"))
    docs = docs.unionByName(spark.createDataFrame([(None, "ip 1.2.3.4"), (5, None), (5, None)], "doc_id long, text string"), allowMissingColumns=True)
    out = pseudonyms.pseudonymise(docs, KEY)
    got = {(r.doc_id, r.n_found > 0): r for r in out.collect()}
    assert out.count() == docs.count() and sum(r.n_card + r.n_ip + r.n_phone + r.n_email > 0 for r in got.values()) >= 50
    email = re.compile(r"@mail\d+\.example\.com")
    assert not any(r.text and email.search(r.text) for r in got.values())
    assert pseudonyms.pseudonymise(docs.limit(0), KEY).count() == 0


def test_quality_model(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    model = quality_model.train(docs, seen)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = quality_model.score(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rows if r.toxic == 1 or r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert all(0 <= r.tail <= r.expected_grade <= 2 for r in rows)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "w " * 100000, 3)], "doc_id long, text string, tail int")
    assert quality_model.score(odd, model).count() == 4
    none = quality_model.train(docs, labels.limit(0))
    assert quality_model.score(odd, none).where("kept").count() == 4 and quality_model.score(odd.limit(0), none).count() == 0
    assert quality_model.keep_good(odd, none).columns == odd.columns


def test_gradient():
    """The gradient of the fit against differences of a plainly written likelihood."""
    import math

    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 6, 4)) for _ in range(30)]
    at, row = np.concatenate(rows), np.repeat(np.arange(30), [len(r) for r in rows])
    value, y, weight = rng.random(len(at)), rng.integers(0, 4, 30), rng.random(30)
    point = rng.normal(size=9)

    def loss(p):
        w, t = p[:6], [p[6], p[6] + math.exp(p[7]), p[6] + math.exp(p[7]) + math.exp(p[8])]
        out = 0.05 * sum(x * x for x in w) / 2
        for i in range(30):
            score = sum(w[a] * v for a, v, r in zip(at, value, row) if r == i)
            above = [1.0, *(1 / (1 + math.exp(x - score)) for x in t), 0.0]
            out -= weight[i] * math.log(above[y[i]] - above[y[i] + 1])
        return out

    got = quality_model.gradient(point[:6], point[6:], at, value, row, y, weight, 0.05)
    for k in range(9):
        step = np.zeros(9)
        step[k] = 1e-5
        assert abs((loss(point + step) - loss(point - step)) / 2e-5 - got[k]) < 1e-6


def test_scores_against_plain_features(spark):
    """op6 against a model applied with features written plainly."""
    import math
    import zlib
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.train(docs, labels, least_chi2=3.0)

    def plain(text):
        data = (text or "").encode()
        words = re.findall(rb"[a-z\x80-\xff]+", data.lower())
        shape = re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[0-9]", b"0", data)))
        shapes = [re.sub(rb"(.)\1+", rb"\1", t) for t in re.findall(rb"[^\x09-\x0d ]+", shape)]
        score = 0.0
        for mark, tokens in ((0, words), (1, shapes)):
            for token, n in Counter(tokens).items():
                score += float(model.weights[zlib.crc32(token, mark) % 2**quality_model.BITS]) * math.sqrt(n / len(tokens))
        if echoes := sum(a == b for a, b in zip(words, words[1:])):
            score += float(model.weights[zlib.crc32(b"echoes", 2) % 2**quality_model.BITS]) * math.sqrt(echoes / len(words))
        return [1 / (1 + math.exp(t - score)) for t in model.thresholds.tolist()]

    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: plain(r.text) for r in rows}
    got = quality_model.score(docs, model).collect()
    assert len(got) == len(rows) and np.count_nonzero(model.weights)
    for r in got:
        tails = want[r.doc_id]
        assert abs(r.expected_grade - sum(tails)) < 1e-4 and abs(r.tail - tails[-1]) < 1e-4 and (abs(tails[-1] - 0.5) < 1e-4 or r.kept == (tails[-1] >= 0.5))


def test_pipeline_odd_rows_and_columns(spark, tmp_path):
    """Every stage on nulls, repeats, empty texts, an empty table, and columns whose names are odd or those of the operators' own."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None), (None, "one two three"), (-1, ""), (-1, ""), (-2, " \n"), (-3, "x" * 200_000), (-4, "the same words again and again here"), (-4, "the same words again and again here")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), allowMissingColumns=True)
    docs = docs.select("*", F.lit(1).alias("a.b"), F.lit("s").alias("sig"), F.lit("r").alias("row"), F.lit("c").alias("carry"), F.lit("g").alias("gone"), F.lit(3).alias("ba`ck"))
    for k, own in enumerate((docs, docs.limit(0))):
        here = own.count()
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, own, sf)
            assert out.columns == own.columns, name
            own = spark.createDataFrame(out.collect(), own.schema)
        assert own.count() <= here
        left = pipeline.STAGES[-1][1](spark, own, sf)
        assert left.count() == own.count()
        if not k:
            texts = [(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()]
            assert texts.count((None, None)) == 1 and texts.count((-4, "the same words again and again here")) in (0, 2) and all(r["a.b"] == 1 and r["ba`ck"] == 3 for r in own.collect())


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.fieldNames() == docs.schema.fieldNames(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert n * 0.5 < docs.count() <= n
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == ids
