"""Alignment of two tokenizers' tokens by diagonal run skipping.

1. Both tokenizers cut a text where a space or new line follows other than white space (proven on the vocabulary, else the text is one unit). What is
   new among the units of a text is coded as one text by both; tokens' byte lengths give two arrays of ends.
2. While both arrays go on equally at the current shift of indices, probes of doubling length jump the one-to-one stretch, and halving ones find its
   end. Where they differ, the group is walked to the next common end, which sets the shift anew. Units' groups are remembered in each worker, as
   no group crosses the end of a unit.
3. Each group links its tokens. A chunk of documents lists its distinct pairs of ids with the number of documents that have each; sums over chunks are the
   corpus's counts. They come back to the chunks' pairs, so a pair that all documents have is one row for each chunk.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pretokens import LETTERS, PATTERN, Splitter, mapped
from .token_counts import supported

#: Documents and bytes of a chunk, units (and ten times as many pairs) remembered by a worker, the longest remembered (others are rare), links of a group that
#: are spelt out, and characters of new units that are coded together.
CHUNK_ROWS, CHUNK_BYTES, REMEMBERED, LONGEST, SPELT, TOGETHER = 8192, 4 << 20, 400_000, 10, 1 << 16, 1 << 15
#: A pair is the first id times this plus the second.
PAIR = 1 << 20
#: Fixed value: white space, and what some libraries take for it.
WHITE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf"[ \n]+[^ \n]*(?:(?<=[{WHITE}])[ \n]+[^ \n]*)*").findall
#: Whether a text has white space other than single spaces and new lines between words.
UNEVEN = re.compile(rf"^[ \n]|[ \n]$|[{WHITE}][ \n]").search
IS_WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{WHITE}]", c))


class Tokens:
    """text → ids of both tokenizers, and whether their bytes are those of the text with a space before it."""

    def __init__(self, first: bytes, second: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        read = json.loads(first)
        back = {letter: b for b, letter in LETTERS.items()}
        vocabulary = sorted(read["model"]["vocab"].items(), key=lambda x: x[1])
        n = max([i for _, i in vocabulary], default=-1) + 1
        self.first = [b""] * n
        for token, i in vocabulary:
            self.first[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.model, self.pre = Tokenizer.from_str(first.decode()).model, Splitter()
        self.ranked = _ranked(read["model"], self.first)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=second)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.second = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.first), len(self.second)) > PAIR:
            raise ValueError("a vocabulary is too large")
        self.space = self.processor.piece_to_id("▁")
        # A cut before a space or a new line is safe if no piece goes on over one.
        plain = [p for i, p in enumerate(pieces) if not self.processor.is_byte(i)]
        odd = "a  b\n c "
        self.by_unit = not any(re.search("[^▁]▁|\n", p) for p in plain) and "".join(pieces[i] for i in self.processor.encode(odd)).replace("<0x0A>", "\n").replace("▁", " ") == " " + odd
        self.first_lengths = np.array([len(t) for t in self.first], np.int64)
        self.second_lengths = np.array([len(t) for t in self.second], np.int64)
        self.names = [list(map(str, range(len(x)))) for x in (self.first, self.second)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple | None] = {}
        self.numbers: dict[int, int] = {}
        self.pairs: list[int] = []

    def first_ids(self, text: str) -> list[int]:
        return self.ranked.encode_ordinary(text) if self.ranked else [t.id for p in self.pre(text) for t in self.model.tokenize(mapped(p))]

    def second_ids(self, text: str) -> list[int]:
        """Of a text with its space before it, which the library puts there; where it begins otherwise, that space stands alone and goes."""
        if text == " ":
            return [self.space]
        return self.processor.encode(text[1:], num_threads=1) if text[0] == " " else self.processor.encode(text, num_threads=1)[1:]

    def same(self, data: bytes, a, b) -> bool:
        return b"".join(map(self.first.__getitem__, a)) == data == b"".join(map(self.second.__getitem__, b))

    def ends(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        return self.first_lengths[a].cumsum(), self.second_lengths[b].cumsum()

    def whole(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both, none where the text is null or empty or its bytes do not come back."""
        if text:
            a, b = self.first_ids(" " + text), self.processor.encode(text, num_threads=1)
            if self.same(b" " + text.encode(), a, b):
                return np.array(a, np.int64), np.array(b, np.int64)
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def units(self, text: str | None) -> list[str]:
        if not text or not self.by_unit:
            return []
        if UNEVEN(text) or "\0" in text:
            return UNIT(" " + text)
        return (" " + text.replace(" ", "\0 ").replace("\n", "\0\n")).split("\0")

    def entries(self, texts: list[str | None]) -> list[list[tuple]]:
        """What is remembered of each text's units: their groups written out, the numbers of their pairs (int32, a link each), counts, and long groups'
        pairs. Numbers hold until the next call, as what is remembered is forgotten only between calls."""
        if len(self.known) >= REMEMBERED or len(self.pairs) >= 10 * REMEMBERED:
            self.forget()
        split = list(map(self.units, texts))
        new = {u for own in split for u in own if u not in self.known}
        together, size = [], 0
        for u in new:
            together.append(u)
            size += len(u)
            if size >= TOGETHER:
                self.learn(together)
                together, size = [], 0
        self.learn(together)
        out = []
        for text, own in zip(texts, split):
            found = list(map(self.known.__getitem__, own))
            if text and (not found or None in found):
                a, b = self.whole(text)
                found = self.made([" " + text], a, b) if len(a) else []
            out.append(found)
        for u in new:
            if len(u) > LONGEST:
                del self.known[u]
        return out

    def learn(self, new: list[str]) -> None:
        """Remember units, None where its bytes do not come back. Those that end in a word may follow one another as in a text, so that they are coded
        together and cut again."""
        joined = [u for u in new if u[-1] not in IS_WHITE]
        rest = set(new).difference(joined)
        text = "".join(joined)
        if joined:
            a, b = self.first_ids(text), self.second_ids(text)
            if self.same(text.encode(), a, b):
                self.known.update(zip(joined, self.made(joined, np.array(a, np.int64), np.array(b, np.int64))))
            else:
                rest = new
        for u in rest:
            a, b = self.first_ids(u), self.second_ids(u)
            self.known[u] = self.made([u], np.array(a, np.int64), np.array(b, np.int64))[0] if self.same(u.encode(), a, b) else None

    def numbered(self, keys: np.ndarray) -> np.ndarray:
        """Pairs as numbers in order of first sight."""
        listed, at = np.unique(keys, return_inverse=True)
        numbers = self.numbers
        for k in listed.tolist():
            if k not in numbers:
                numbers[k] = len(self.pairs)
                self.pairs.append(k)
        return np.array([numbers[k] for k in listed.tolist()], np.int32)[at]

    def made(self, units: list[str], a: np.ndarray, b: np.ndarray) -> list[tuple]:
        """Entries of units that follow one another, from the ids of all."""
        ends = self.ends(a, b)
        to_a, to_b = (np.array(x, np.int64) for x in diagonal(ends[0].tolist(), ends[1].tolist()))
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        n = size_a * size_b
        long = np.flatnonzero(n > SPELT).tolist()  # its distinct ids stand for it
        n[long] = 0
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(size_b, n)
        numbers = self.numbered(a[np.repeat(to_a - size_a, n) + within // width] * PAIR + b[np.repeat(to_b - size_b, n) + within % width]).tobytes()
        own, other = (list(map(names.__getitem__, x.tolist())) for names, x in zip(self.names, (a, b)))
        bounds = [x.tolist() for x in (to_a - size_a, to_a, to_b - size_b, to_b)]
        written = [f"{own[i] if k - i == 1 else ','.join(own[i:k])}|{other[j] if m - j == 1 else ','.join(other[j:m])}" for i, k, j, m in zip(*bounds)]
        cuts = np.searchsorted(ends[0][to_a - 1], np.cumsum([len(u.encode()) for u in units])) + 1
        links = np.concatenate(([0], np.cumsum(n)))[cuts].tolist()
        counts = zip(to_a[cuts - 1].tolist(), to_b[cuts - 1].tolist(), cuts.tolist())
        out, last, link = [], (0, 0, 0), 0
        for now, k in zip(counts, links):
            one = ";".join(written[last[2] : now[2]])
            # Counts side by side in one number, so that they are added at once.
            out.append((one, numbers[4 * link : 4 * k], (now[0] - last[0]) | (now[1] - last[1]) << 40 | (now[2] - last[2]) << 80, None))
            last, link = now, k
        for g in long:
            u = int(np.searchsorted(cuts, g, "right"))
            (x, p), (y, q) = (np.unique(ids[to[g] - k[g] : to[g]], return_counts=True) for ids, to, k in ((a, to_a, size_a), (b, to_b, size_b)))
            more = self.numbered((x[:, None] * PAIR + y).reshape(-1)), (p[:, None] * q).reshape(-1)
            out[u] = (*out[u][:3], [*(out[u][3] or []), more])
        return out


def _ranked(model: dict, tokens: list[bytes]):
    """A faster encoder of the same merges, where ids are the ranks that it goes by; else None."""
    import tiktoken

    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    by_id = {i: t for t, i in model["vocab"].items()}
    if any(by_id.get(256 + k) != t for k, t in enumerate(made)) or any(len(t) != 1 for t in tokens[:256]):
        return None
    return tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(made)])}, special_tokens={})


def diagonal(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """For each group the numbers of tokens up to its end, in both; the last ends are equal."""
    to_a: list[int] = []
    to_b: list[int] = []
    i = j = 0
    n = len(ends_a)
    while i < n:
        if ends_a[i] == ends_b[j]:
            k, step = 1, 4
            while i + k < n and ends_a[i + k : i + k + step] == ends_b[j + k : j + k + step]:
                k += step
                step *= 2
            k = min(k, n - i)
            while step > 1:
                step //= 2
                if i + k + step <= n and ends_a[i + k : i + k + step] == ends_b[j + k : j + k + step]:
                    k += step
            to_a.extend(range(i + 1, i + k + 1))
            to_b.extend(range(j + 1, j + k + 1))
            i += k
            j += k
        else:
            x, y = ends_a[i], ends_b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                else:
                    j += 1
                    y = ends_b[j]
            i += 1
            j += 1
            to_a.append(i)
            to_b.append(j)
    return to_a, to_b


def text_pairs(entries: list[list[tuple]], n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text's distinct pairs, text after text: the text, the pair's number, and how many links it has."""
    joined = [b"".join([e[1] for e in own]) for own in entries]
    numbers = [np.frombuffer(b"".join(joined), np.int32).astype(np.int64)]
    texts = [np.repeat(np.arange(len(joined)), [len(x) // 4 for x in joined])]
    many = [np.ones(len(numbers[0]), np.int64)]
    for text, own in enumerate(entries):
        for e in own:
            for number, n in e[3] or ():
                numbers.append(number.astype(np.int64))
                many.append(n)
                texts.append(np.full(len(number), text))
    codes = np.concatenate(texts) * max(1, n_pairs) + np.concatenate(numbers)
    if len(many) == 1:
        both, n = np.unique(codes, return_counts=True)
    else:
        both, at = np.unique(codes, return_inverse=True)
        n = np.bincount(at, np.concatenate(many))
    return both // max(1, n_pairs), both % max(1, n_pairs), n.astype(np.int64)


def _sent(docs: DataFrame, first_path: str | None, second_path: str | None):
    spark = docs.sparkSession
    common.ship(spark)
    first, second = common.tokenizer_file(first_path, "byte_bpe_50k.json"), common.tokenizer_file(second_path, "piece_bpe_32k.model")
    supported(json.loads(first))
    return spark.sparkContext.broadcast((first, second))


def _tokens(sent) -> Tokens:
    return common.kept(("alignment", hash(sent.value)), lambda: Tokens(*sent.value))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_path: str | None = None, second_path: str | None = None) -> DataFrame:
    """One row for each row of docs: id, first_ids, second_ids, first_ends, second_ends (for each group the numbers of tokens up to its end).

    Whole texts; those that are null or empty, or whose bytes either tokenizer does not give back, have no tokens. Repeated rows stay repeated, a null
    id stays null, other columns are not read, an empty table gives an empty one. A text's tokens are held at once, so the longest must fit in a worker.
    """
    sent = _sent(docs, first_path, second_path)

    def aligned(batches):
        tokens = _tokens(sent)
        for batch in batches:
            for part in common.pieces(batch):
                rows = []
                for a, b in map(tokens.whole, part.column(1).to_pylist()):
                    rows.append((a, b, *diagonal(*[x.tolist() for x in tokens.ends(a, b)])))
                if rows:
                    yield pa.record_batch([part.column(0), *[pa.array(c, pa.list_(pa.int32())) for c in zip(*rows)]], names=[id_col, "first_ids", "second_ids", "first_ends", "second_ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.texts(docs, id_col, text_col).mapInArrow(common.thrifty(aligned), f"`{id_col}` {kind}, first_ids array<int>, second_ids array<int>, first_ends array<int>, second_ends array<int>")


def _scan(docs: DataFrame, id_col: str, text_col: str, sent) -> DataFrame:
    """Chunks of documents: chunk, rows (array of id and figures), refs and many (for each document's pairs, one document after another, where in the
    chunk's list each is, as steps from the one before, and its links), pairs (the chunk's distinct ones) and docs (how many documents have each)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scanned(batches):
        from pyspark import TaskContext

        tokens, low = _tokens(sent), (1 << 40) - 1
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.pieces(batch, CHUNK_BYTES):
                for at in range(0, part.num_rows, CHUNK_ROWS):
                    piece = part.slice(at, CHUNK_ROWS)
                    entries = tokens.entries(piece.column(1).to_pylist())
                    text, number, many = text_pairs(entries, len(tokens.pairs))
                    # Numbers hold in this worker only: the chunk's pairs are listed in order, and its texts refer to that list.
                    used = np.unique(number)
                    listed = np.array(tokens.pairs, np.int64)[used] if len(used) else np.empty(0, np.int64)
                    order = np.argsort(listed)
                    listed = listed[order]
                    rank = np.empty(len(tokens.pairs), np.int64)
                    rank[used[order]] = np.arange(len(used))
                    place = rank[number]
                    again = np.lexsort((place, text))
                    text, place, many = text[again], place[again], many[again]
                    steps = np.diff(place.astype(np.int32), prepend=np.int32(0))
                    counts = [sum([e[2] for e in own]) for own in entries]
                    n_links = np.bincount(text, many, minlength=piece.num_rows).astype(np.int64)
                    n_pairs = np.bincount(text, minlength=piece.num_rows)
                    shas = [common.hexdigest(";".join([e[0] for e in own]).encode()) if own else "" for own in entries]
                    figures = {"id": piece.column(0), **{n: pa.array(x, pa.int64()) for n, x in (("n_a", [c & low for c in counts]), ("n_b", [c >> 40 & low for c in counts]), ("n_groups", [c >> 80 for c in counts]), ("n_links", n_links))}, "groups_sha256": pa.array(shas, pa.string()), "n_pairs": pa.array(n_pairs, pa.int64())}
                    rows = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), pa.StructArray.from_arrays([*figures.values()], names=[*figures]))
                    n_docs = np.bincount(place, minlength=len(listed)).astype(np.int64)
                    yield pa.record_batch([pa.array([chunk], pa.int64()), rows, *[pa.array([x.tobytes()], pa.binary()) for x in (steps, many, listed, n_docs)]], names=["chunk", "rows", "refs", "many", "pairs", "docs"])
                    chunk += 1

    row = f"struct<id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, n_pairs: bigint>"
    return common.texts(docs, id_col, text_col).mapInArrow(common.thrifty(scanned), f"chunk bigint, rows array<{row}>, refs binary, many binary, pairs binary, docs binary")


def _listed(table: DataFrame) -> DataFrame:
    """chunk, pair, docs: the chunks' lists as rows."""

    def rows(batches):
        for batch in batches:
            for chunk, keys, docs in common.rows(batch):
                keys, docs = np.frombuffer(keys, np.int64), np.frombuffer(docs, np.int64)
                yield pa.record_batch([pa.array(np.full(len(keys), chunk)), pa.array(keys), pa.array(docs)], names=["chunk", "pair", "docs"])

    return table.select("chunk", "pairs", "docs").mapInArrow(common.thrifty(rows), "chunk bigint, pair bigint, docs bigint")


def _totals(listed: DataFrame) -> DataFrame:
    """pair, n_docs, best: whether no pair of its first id has more. An id has at most as many pairs as the other vocabulary has entries."""
    totals = common.saved(listed.groupBy("pair").agg(F.sum("docs").alias("n_docs")), "pair-totals")
    first = F.floor(F.col("pair") / PAIR)
    most = totals.groupBy(first.alias("first")).agg(F.max("n_docs").alias("most"))
    return totals.withColumn("first", first).join(most, "first").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def vocabulary_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_path: str | None = None, second_path: str | None = None) -> DataFrame:
    """first_id, second_id, n_docs, best for every pair of ids linked anywhere: how many documents have it, and whether its first id has no commoner one.
    Texts as of align(); rows are documents, repeated ones too."""
    totals = _totals(_listed(_scan(docs, id_col, text_col, _sent(docs, first_path, second_path))))
    return totals.select(F.floor(F.col("pair") / PAIR).alias("first_id"), F.pmod("pair", F.lit(PAIR)).alias("second_id"), "n_docs", "best")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_path: str | None = None, second_path: str | None = None) -> DataFrame:
    """One row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other of its first id outnumbers), count_sum (over links,
    of the documents that have the pair), groups_sha256 (of `a1,a2|b1;a3|b2,b3`; '' without tokens). Texts and odd cases as of align()."""
    sent = _sent(docs, first_path, second_path)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = common.bucketed(_scan(docs, id_col, text_col, sent), "aligned", "chunk", n)
    listed = _listed(table)
    value = (F.col("n_docs") * 2 + F.col("best").cast("long")).alias("value")
    answers = listed.select("chunk", "pair").join(_totals(listed), "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", value)).alias("answers"))

    def judged(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                rows = one.column(0).flatten()
                steps, many = (np.frombuffer(one.column(c)[0].as_buffer(), kind) for c, kind in ((1, np.int32), (2, np.int64)))
                flat = one.column(3).flatten()
                order = np.argsort(flat.field(0).to_numpy(), kind="stable")
                value = flat.field(1).to_numpy()[order][np.cumsum(steps)] if len(steps) else np.empty(0, np.int64)
                figures = dict(zip(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs"], rows.flatten()))
                ends = np.cumsum(figures["n_pairs"].to_numpy())
                summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends], prepend=0)
                yield pa.record_batch([figures["id"], *[figures[c] for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(summed(many * (value & 1)), pa.int64()), pa.array(summed(many * (value >> 1)), pa.int64()), figures["groups_sha256"]], names=names)

    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = docs.schema[id_col].dataType.simpleString()
    out = table.join(answers.hint("shuffle_hash"), "chunk", "left").select("rows", "refs", "many", "answers")
    return out.mapInArrow(common.thrifty(judged), f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
