"""Alignment against both libraries and all pairs inside groups."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import alignment, common
from leafspan.llm.pretokens import byte_letters
from tests.llm.same import differ
from tests.llm.test_tokens import ODD

public = pytest.importorskip("public_tokenizers")
MORE = ["a▁b", "▁", "x\r\ny\r z", "a \n b\n  c\t d", "tail \n", "\n", "\n\nfoo", "<0x0A> <s> </s>", "　a　 b", "};\r\n\r\n}\r", " lead", "  two", "1 2  3   4", "é ​‍", "\x1c a \x1d", "ab" * 400 + " " * 300]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def brute(texts):
    first, second = libraries()
    back = {c: b for b, c in enumerate(byte_letters())}
    docs = []
    for text in texts:
        groups = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            own = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
            other = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(own) == b"".join(other) == b" " + text.encode():
                ends = [np.cumsum([len(t) for t in x]).tolist() for x in (own, other)]
                start = 0, 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    to = ends[0].index(end, start[0]) + 1, ends[1].index(end, start[1]) + 1
                    groups.append((a[start[0] : to[0]], b[start[1] : to[1]]))
                    start = to
        docs.append(groups)
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in docs]
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for groups, own in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, count, most


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    rows = [(i, t) for i, t in enumerate(ODD + MORE)] + [(None, "null id"), (5, "twice twice"), (5, "twice twice")]
    if small:
        for name, value in (("CHUNK_ROWS", 3), ("SPELT", 3), ("REMEMBERED", 20), ("LONGEST", 6)):
            monkeypatch.setattr(alignment, name, value)
    rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash")).withColumn("chunk", F.lit(0)).repartition(3)
    figures, count, most = brute([t for _, t in rows])
    want = sorted(((d, *f) for (d, _), f in zip(rows, figures)), key=key)
    got = sorted((tuple(r) for r in alignment.digest(df).collect()), key=key)
    assert not differ(got, want)
    if not small:
        found = {(r.first_id, r.second_id): (r.n_docs, r.best) for r in alignment.vocabulary_map(df).collect()}
        assert found == {p: (n, n == most[p[0]]) for p, n in count.items()}
        assert alignment.digest(df.limit(0)).count() == 0 and alignment.digest(df.where("text is null")).first()["groups_sha256"] == ""


def test_groups_of_align(spark):
    rows = [(1, "Unbelievable tokenization, naïve façade."), (2, None), (3, "日本語 text")]
    first, second = libraries()
    for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r.doc_id]
        if text is None:
            assert not r.first_ids and not r.first_ends
            continue
        assert r.first_ids == first.encode(" " + text, add_special_tokens=False).ids and r.second_ids == second.encode(text)
        assert r.first_ends[-1] == len(r.first_ids) and r.second_ends[-1] == len(r.second_ids) and len(r.first_ends) == len(r.second_ends)


def test_diagonal():
    rng = random.Random(4)
    for _ in range(500):
        n = rng.randrange(1, 200)
        ends = [sorted(set(rng.sample(range(1, n + 1), rng.randrange(n))) | {n}) for _ in range(2)]
        if rng.random() < 0.5:
            at = rng.randrange(n)
            ends[1] = sorted({e for e in ends[0] if e < at} | {e for e in ends[1] if e >= at} | {n})
        a, b = alignment.diagonal(*ends)
        shared = sorted(set(ends[0]) & set(ends[1]))
        assert [ends[0][i - 1] for i in a] == shared == [ends[1][j - 1] for j in b]
    assert alignment.diagonal([*range(1, 1001)], [*range(1, 1001)]) == ([*range(1, 1001)],) * 2


def test_units_are_as_whole():
    tokens = alignment.Tokens(common.tokenizer_file(None, "byte_bpe_50k.json"), common.tokenizer_file(None, "piece_bpe_32k.model"))
    first, second = libraries()
    rng = random.Random(6)
    letters = [" ", " ", "\n", "\t", "\r", "a", "b", "é", "'s", "1", "　", "\xa0", ";", "}", "the", "日", "\x1c", " "]
    assert tokens.by_unit and tokens.ranked
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 14)))
        a, b = ([int(x) for e in tokens.entries([text])[0] for g in e[0].split(";") for x in g.split("|")[k].split(",")] for k in (0, 1))
        assert (a, b) == (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)), repr(text)
