"""Token counts and byte-level BPE against the libraries that define them."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from leafspan.llm import byte_bpe, common, token_counts
from leafspan.llm.pretokens import PATTERN, Splitter
from tests.llm.same import differ

public = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "a<|endoftext|> b", "<|endoftext|><|endoftext|>x", "  \n\n x", "\x85\x1c '’s it's ", "½²³ Ⅷ 12", "é" * 3000 + " " * 5000, "日本語 😀 é", "'S 's 'll'LL", "a b   c", "x" * 70000, "�\u0000\u0001", "ĠĠ Ċ"]


def docs(spark):
    own = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (5, "twice"), (5, "twice")], "doc_id long, text string")
    return own.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")).withColumn("n_tokens", F.lit("clash"))


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text or "") for r in docs(spark).collect()]
    n = [len(e.ids) for e in library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    want = sorted(((d, len(t.encode()), k, k > 512) for (d, t), k in zip(rows, n)), key=key)
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs(spark)).collect()), key=key)
    assert not differ(got, want)
    assert token_counts.count_tokens(docs(spark).limit(0)).count() == 0


def test_whole_tokens_are_whole():
    spec = json.loads(common.tokenizer_file(None, "byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public.path("byte_bpe_50k.json")).model
    whole = token_counts.whole_tokens(spec["model"])
    assert len(whole) > 45_000 and all(len(model.tokenize(token_counts.mapped(w))) == 1 for w in whole)


def test_round_trip(spark):
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(common.tokenizer_file(path, ""))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs(spark).collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((r.text or "").encode())))
    got = [tuple(r) for r in byte_bpe.round_trip(docs(spark)).collect()]
    assert not differ(sorted(got, key=key), sorted(want, key=key))
    coded = byte_bpe.encode(docs(spark))
    back = byte_bpe.decode(coded)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((r.text or "").encode() for r in docs(spark).collect())
    assert byte_bpe.round_trip(docs(spark).limit(0)).count() == 0


def test_fast_splitter():
    import regex

    every, own = regex.compile(PATTERN).findall, Splitter()
    for t in filter(None, ODD):
        assert own(t) == every(t)
    sample = "".join(map(chr, range(0x250))) + " ".join(map(chr, range(0x250))) + "’ “a” – b…"
    assert own(sample) == every(sample)
