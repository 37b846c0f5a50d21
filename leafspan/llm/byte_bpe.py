"""Byte-level BPE encoding and decoding through a sentencepiece model written from the vocabulary.

A rank file is turned into a sentencepiece BPE model, field by field in the protocol-buffer wire format: every token becomes a piece, its bytes
mapped to printable letters, scored by its negative rank; normalisation is the identity. Pre-tokens are encoded one by one with it (those that
are a token at once by look-up), ids are decoded by the inverse mapping. No shuffle; one pass over the rows.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .pretokens import LETTERS, PATTERN, Splitter, mapped

#: Remembered pre-tokens of a worker, and the longest that is remembered.
REMEMBERED, LONGEST = 150_000, 48


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes → rank of a rank file: base64 and rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One field of a protocol-buffer message: int as varint, float as fixed 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece, which cannot occur, comes last."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if len({t for t in ranks if len(t) == 1}) != 256:
        raise ValueError("every byte must be a token")
    letters = lambda token: token.decode("latin-1").translate(LETTERS).encode()
    normal, unknown, bpe = 1, 2, 2  # the wire format's numbers for these kinds
    out = [_field(1, _field(1, letters(t)) + _field(2, -float(r)) + _field(3, normal)) for t, r in by_rank]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    n = len(out)
    # trainer_spec: model_type 3, vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43
    out.append(_field(2, _field(3, bpe) + _field(4, n) + _field(40, n - 1) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    # normalizer_spec: name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """encode(text) → ids, decode(ids) → bytes."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN) -> None:
        import sentencepiece

        ranks = read_ranks(rank_file)
        processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.pre, self.ranks, self.processor = Splitter(pattern), ranks, processor
        self.ids: dict[str, tuple[int, ...]] = {}
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.names = [str(i) for i in range(len(self.tokens))]

    def learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pieces: a token's own id, or what the model makes of the mapped piece."""
        whole = {p: (r,) for p in pieces if (r := self.ranks.get(p.encode())) is not None}
        rest = [p for p in pieces if p not in whole]
        return whole | dict(zip(rest, map(tuple, self.processor.encode([mapped(p) for p in rest], num_threads=1))))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.pre(text)
        if new := [p for p in set(pieces) if p not in self.ids]:
            if len(self.ids) >= REMEMBERED:
                self.ids.clear()
                new = list(set(pieces))
            self.ids |= (found := self.learn(new))
            out = list(chain.from_iterable(map(self.ids.__getitem__, pieces)))
            for p in found:
                if len(p) > LONGEST:
                    del self.ids[p]
            return out
        return list(chain.from_iterable(map(self.ids.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


def _codec(sent) -> Codec:
    rank_file, pattern = sent.value
    return common.kept(("codec", hash((rank_file, pattern))), lambda: Codec(rank_file, pattern))


def _send(docs: DataFrame, vocabulary_path: str | None, pattern: str | None):
    common.ship(docs.sparkSession)
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return docs.sparkSession.sparkContext.broadcast((common.tokenizer_file(vocabulary_path, "byte_bpe_multi_50k.tiktoken"), pattern))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each row of docs: id, ids (array of token ids).

    Null text is empty, no ids; repeated rows stay repeated; a null id stays null; other columns are not read; an empty table gives an empty one. A text's
    ids are one list, so the longest must fit in a worker.
    """
    sent = _send(docs, vocabulary_path, pattern)

    def encoded(batches):
        codec = _codec(sent)
        for batch in batches:
            for part in common.pieces(batch):
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.texts(docs, id_col, text_col).mapInArrow(common.thrifty(encoded), f"`{id_col}` {kind}, ids array<int>")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str | None = None) -> DataFrame:
    """One row for each row of coded: id, data (the bytes that its ids stand for; null ids are none). Rows, nulls and length as of encode()."""
    sent = _send(coded, vocabulary_path, "")

    def decoded(batches):
        codec = _codec(sent)
        for batch in batches:
            for part in common.pieces(batch):
                data = [codec.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(coded[id_col].alias("id"), coded[ids_col].alias("ids")).mapInArrow(decoded, f"`{id_col}` {kind}, data binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode each text in one pass: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes).

    Null text is empty: no tokens, the digests of nothing. Repeated rows stay repeated; a null id stays null; other columns are not read;
    an empty table gives an empty one; the longest text must fit in a worker.
    """
    sent = _send(docs, vocabulary_path, pattern)

    def both(batches):
        codec = _codec(sent)
        for batch in batches:
            for part in common.pieces(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text)
                    rows.append((len(ids), common.hexdigest(codec.joined(ids).encode()), common.hexdigest(codec.decode(ids))))
                n, a, b = zip(*rows) if rows else ((), (), ())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.texts(docs, id_col, text_col).mapInArrow(both, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
