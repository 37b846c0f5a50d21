"""In how many documents of a corpus each key occurs, without sending documents or references to them.

Input is a table of chunks, each with the sorted distinct 64-bit keys of some documents and how many of them have each. Keys go to ranges of
the key space, five bytes each beyond the range's own bits; every range answers each chunk with one byte for each key it was sent.
A key that a third of all documents share costs one entry for each chunk, so no key is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys that a range should get, and bytes of a key that are sent beyond its range.
KEYS_A_RANGE, SENT = 1_000_000, 5


def _packed(keys: np.ndarray, bits: int) -> bytes:
    """The SENT bytes that follow the first `bits` bits of each key."""
    return ((keys << np.uint64(bits)).byteswap().view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SENT, 8), np.uint8)
    out[:, 8 - SENT :] = np.frombuffer(data, np.uint8).reshape(-1, SENT)
    return out.view(np.uint64).reshape(-1).byteswap()


def most(n: np.ndarray) -> bytes:
    """Numbers of documents as bytes, 255 for more."""
    return np.minimum(n, 255).astype(np.uint8).tobytes()


def counted(chunks: DataFrame, n_keys: int) -> DataFrame:
    """chunks: chunk bigint, keys binary (sorted distinct uint64), many binary (a byte for each key: how many documents of the chunk have it).

    Returns chunk, answers: array of (part, many), which in order of part joined give a byte for each key of the chunk: how many documents of the
    corpus have it, 255 for more. Keys count as equal by their first 40 bits beyond the range's; more documents for a truncated key are
    then possible by chance, never fewer, and the number of ranges and so of bits compared grows with the corpus. No keys give no answers.
    """
    bits = max(1, math.ceil(math.log2(max(2, n_keys / KEYS_A_RANGE))))
    top = np.uint64(64 - bits)

    def dealt(batches):
        for batch in batches:
            for chunk, keys, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys, many = np.frombuffer(keys, np.uint64), np.frombuffer(many, np.uint8)
                parts = keys >> top
                cut = np.flatnonzero(np.diff(parts, prepend=np.uint64(2**63) if len(parts) else 0))
                ends = [*cut[1:].tolist(), len(keys)]
                rows = [(int(parts[a]), chunk, _packed(keys[a:b], bits), many[a:b].tobytes()) for a, b in zip(cut.tolist(), ends)] if len(keys) else []
                for i in range(0, len(rows), 64):
                    p, c, k, t = zip(*rows[i : i + 64])
                    yield pa.record_batch([pa.array(p, pa.int32()), pa.array(c, pa.int64()), pa.array(k, pa.binary()), pa.array(t, pa.binary())], names=["part", "chunk", "keys", "many"])

    def answered(table: pa.Table) -> pa.Table:
        common.release()
        packed = table.column("keys").to_pylist()
        keys = np.concatenate([_unpacked(k) for k in packed])
        many = np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        total = np.add.reduceat(many[order], first)
        out = np.zeros(len(keys), np.uint8)
        out[order] = np.repeat(np.minimum(total, 255), np.diff(np.append(first, len(keys))))
        ends = np.cumsum([len(k) // SENT for k in packed]).tolist()
        answers = [out[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "many": pa.array(answers, pa.binary())})

    sent = chunks.select("chunk", "keys", "many").mapInArrow(common.thrifty(dealt), "part int, chunk bigint, keys binary, many binary")
    replies = sent.groupBy("part").applyInArrow(answered, "chunk bigint, part int, many binary")
    return replies.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "many"))).alias("answers"))
