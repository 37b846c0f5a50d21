"""Token counts by the whole-token shortcut.

Offline, on the driver, every string of the vocabulary is merged from its bytes by the merge ranks: those that end as one token are proven
"whole". Online, a pre-token in that table counts 1 at once; only the rest is merged, by the library's own model, and remembered in a
bounded table of each Python worker. There is no shuffle: a row's count depends on its text alone.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common
from .pretokens import LETTERS, Splitter, mapped

#: Remembered pre-tokens of a worker, and the longest that is remembered; beyond them counts are made again, not dropped.
REMEMBERED, LONGEST = 200_000, 48


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, lowest rank first and leftmost among equals; for short strings."""
    symbols = list(symbols)
    while len(symbols) > 1:
        rank, at = min((ranks.get((a, b), len(ranks)), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if rank == len(ranks):
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def whole_tokens(model: dict) -> list[str]:
    """Strings of the vocabulary that are text and provably encode alone as one token."""
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {p: i for i, p in enumerate(pairs)}
    back = {letter: b for b, letter in LETTERS.items()}
    found = []
    for token in model["vocab"]:
        if merged(list(token), ranks) != [token]:
            continue
        try:
            found.append(bytes(back[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            pass
    return found


class Lengths(dict):
    """Token count of each pre-token: 1 for the proven ones, merged on first sight for the rest."""

    def __init__(self, whole: list[str], model) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.model, self.most = whole, model, len(whole) + REMEMBERED

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(mapped(piece)))
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


class Counter:
    """Counts tokens of texts; made once in each Python worker."""

    def __init__(self, spec: bytes, whole: list[str]) -> None:
        from tokenizers import Tokenizer

        read = json.loads(spec)
        self.lengths = Lengths(whole, Tokenizer.from_str(spec.decode()).model)
        self.pre = Splitter()
        added = sorted((t["content"] for t in read["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added.split(text) if self.added else [text]
        count = self.lengths.__getitem__
        return len(parts) - 1 + sum(sum(map(count, self.pre(p))) for p in parts)


def supported(read: dict) -> None:
    """Raise if the file asks for something other than plain byte-level BPE."""
    pre, model = read.get("pre_tokenizer") or {}, read["model"]
    plain = read.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
    if not plain or any(t.get(k) for t in read["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("only byte-level BPE without normalizer, dropout or stripping added tokens is supported")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, limit: int = 512) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The whole text counts; a null text is empty: 0 bytes, 0 tokens. Strings of added tokens inside a text count as that one token, which is the
    library's default. Repeated rows give repeated rows; a null id stays null; other columns are not read; an empty table gives an empty one. The longest text must
    fit in a worker.
    """
    spark = docs.sparkSession
    common.ship(spark)
    spec = common.tokenizer_file(tokenizer_path, "byte_bpe_50k.json")
    read = json.loads(spec)
    supported(read)
    sent = spark.sparkContext.broadcast((spec, whole_tokens(read["model"])))
    key = hash(spec)

    def counted(batches):
        count = common.kept(("counter", key), lambda: Counter(*sent.value))
        for batch in batches:
            for part in common.pieces(batch):
                n = [count(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pc.fill_null(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 0), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    two = common.texts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return two.mapInArrow(counted, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
