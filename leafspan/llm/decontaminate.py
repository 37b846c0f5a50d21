"""Benchmark decontamination with an FM-index for each shard of the training text.

A shard is a bounded slice of a partition. Stretches that cannot hold a whole window, because they are shorter or pair words that no window pairs,
are left out; the rest is concatenated, its words numbered, and indexed: suffix order by prefix doubling, its Burrows-Wheeler transform in a wavelet
matrix, every eighth suffix position kept. All windows whose words the shard has are searched backwards at once (rank queries over arrays), occurrences
are located by stepping to sampled positions, and the spans they cover are merged for each document.

The benchmark is hashed on the executors, eight bytes a word, and comes to the workers as it is, in blocks that are searched one after another: windows
are slices of a block, so nothing is built for it. One pass over the documents takes a group of blocks of bounded size; a benchmark beyond that takes
more passes, each of which writes what it found beside the texts. Words count as equal by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS = 13
#: Words of benchmark text in a block, blocks of a pass (so 8 MB each, 128 MB together), and bytes of document text in a shard.
BLOCK, BLOCKS, SHARD = 1 << 20, 16, 6 << 20
SAMPLED = 8
#: Bits of the tables of neighbours for each pair in them, and of a table at most.
ROOM, MOST_BITS = 32, 27

#: bytes → lower-case word bytes, or a space where a byte is in no word: fixed by the words' definition.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.encode().translate(TABLE).split() if text else []


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s in order, by prefix doubling; the end counts as the least."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        k = key[order]
        new[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and locate over a sequence of numbers from 1; a 0 is put at its end."""

    def __init__(self, s: np.ndarray, top: int) -> None:
        s = np.concatenate((s + 1, [0]))  # 1: a break in the sequence, 0: its end
        self.n = n = len(s)
        order = suffix_order(s)
        bwt = s[order - 1]
        self.bwt, self.levels = bwt, max(1, int(top + 1).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=top + 2))))
        self.ones, self.zeros = [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.kept = order % SAMPLED == 0
        self.kept_rank = np.concatenate(([0], np.cumsum(self.kept)))
        self.sample = order[self.kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c comes before position i of the transform."""
        first = np.zeros_like(i)
        for k in range(self.levels):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][first], self.ones[k][i]
            first = np.where(one, self.zeros[k] + a, first - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - first

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases that occur: their numbers, and the first and last row (exclusive) of each. phrases is padded at the left."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = lengths[which] >= back
            c = phrases[which, phrases.shape[1] - back] + 1
            low2, high2 = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            low, high = np.where(on, low2, low), np.where(on, high2, high)
            there = low < high
            which, low, high = which[there], low[there], high[there]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows."""
        out, steps, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            hit = self.kept[rows[left]]
            found = left[hit]
            out[found] = self.sample[self.kept_rank[rows[found]]] + steps[found]
            left = left[~hit]
            c = self.bwt[rows[left]]
            rows[left] = self.before[c] + self.rank(c, rows[left])
            steps[left] += 1
        return out


def hashed(text: str | None, known: dict[bytes, int]) -> list[int]:
    return [known[w] for w in words(text)]


def code(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """A pair of neighbours as a number of so many bits."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xBF58476D1CE4E5B9))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


class Block:
    """Some benchmark items: their ids, hashed words one item after another, and how many each has."""

    def __init__(self, items: list[str | None], words: np.ndarray, sizes: np.ndarray) -> None:
        self.items, self.words, self.sizes = items, words, sizes

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and item of every window."""
        n = np.where(self.sizes > 0, np.maximum(1, self.sizes - WORDS + 1), 0)
        item = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(self.sizes) - self.sizes
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[item]
        return start, np.minimum(self.sizes, WORDS)[item], item


class Pairs:
    """For each length of window, which neighbours some window has, by a hash; single words for length 1."""

    def __init__(self, blocks: list[Block]) -> None:
        self.tables: dict[int, tuple[int, np.ndarray]] = {}
        n = np.concatenate([b.sizes for b in blocks]) if blocks else np.zeros(0, np.int64)
        for size in np.unique(np.minimum(n[n > 0], WORDS)).tolist():
            longer = lambda b: b.sizes >= size if size == WORDS else b.sizes == size  # noqa: B023, E731
            pairs = int(n[n >= size].sum() if size == WORDS else n[n == size].sum())
            bits = min(MOST_BITS, max(16, math.ceil(math.log2(pairs * ROOM))))
            table = np.zeros(1 << bits, bool)
            for b in blocks:
                item = np.repeat(np.arange(len(b.sizes)), b.sizes)
                mine = longer(b)[item]
                if size == 1:
                    table[code(b.words[mine], b.words[mine], bits)] = True
                else:
                    both = mine[:-1] & (item[1:] == item[:-1])
                    table[code(b.words[:-1][both], b.words[1:][both], bits)] = True
            self.tables[size] = bits, np.packbits(table, bitorder="little")

    def likely(self, shard: np.ndarray) -> np.ndarray:
        """Which words of a shard, where 0 breaks the sequence, may lie inside a window: those in long enough runs of pairs that windows have."""
        keep = np.zeros(len(shard), bool)
        inside = shard > 0
        for n, (bits, table) in self.tables.items():
            has = lambda c: (table[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0  # noqa: B023, E731
            if n == 1:
                keep |= inside & has(code(shard, shard, bits))
                continue
            if len(shard) < n:
                continue
            linked = inside[:-1] & inside[1:] & has(code(shard[:-1], shard[1:], bits))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
            for start, end in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= n - 1].tolist():
                keep[start : end + 1] = True
        return keep


class Shard:
    """The FM-index over a shard's likely stretches."""

    def __init__(self, shard: np.ndarray, at: np.ndarray) -> None:
        place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(np.diff(at) > 1)))
        self.vocabulary, number = np.unique(shard[at], return_inverse=True)
        s = np.zeros(place[-1] + 1, np.int64)
        s[place] = number.reshape(-1) + 1
        self.origin = np.zeros(len(s), np.int64)
        self.origin[place] = at
        self.index = FMIndex(s, len(self.vocabulary))

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Number, start and length of every occurrence of a distinct window of a block; and the numbers and items of the windows, by number."""
        place = np.minimum(np.searchsorted(self.vocabulary, block.words), len(self.vocabulary) - 1)
        local = np.where(self.vocabulary[place] == block.words, place + 1, 0)
        start, length, item = block.windows()
        strange = np.concatenate(([0], np.cumsum(local == 0)))
        here = strange[start + length] == strange[start]
        start, length, item = start[here], length[here], item[here]
        back = np.arange(WORDS - 1, -1, -1)
        phrases = np.where(back < length[:, None], local[np.maximum(0, start[:, None] + length[:, None] - 1 - back)], 0)
        phrases, number = np.unique(phrases, axis=0, return_inverse=True)
        number = number.reshape(-1)
        order = np.argsort(number, kind="stable")
        which, low, high = self.index.search(phrases, (phrases > 0).sum(1))
        n = high - low
        rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.repeat(which, n)
        return found, self.origin[self.index.locate(rows)], (phrases > 0).sum(1)[found], (number[order], item[order])


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str):
    """Groups of at most BLOCKS blocks of benchmark items, hashed on the executors; the driver holds one group at a time."""

    def worded(batches):
        known = common.Words()
        for batch in batches:
            for part in common.pieces(batch):
                yield pa.record_batch([part.column(0), pa.array([np.array(hashed(t, known), np.uint64).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["item", "words"])

    own = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")).where("text <> ''")
    group: list[Block] = []
    items, parts, n = [], [], 0

    def block() -> Block:
        return Block(items, np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(p) for p in parts], np.int64))

    for item, data in own.mapInArrow(common.thrifty(worded), "item string, words binary").toLocalIterator():
        own_words = np.frombuffer(bytes(data), np.uint64)
        if items and n + len(own_words) > BLOCK:
            group.append(block())
            items, parts, n = [], [], 0
            if len(group) == BLOCKS:
                yield group
                group = []
        items.append(item)
        parts.append(own_words)
        n += len(own_words)
    yield [*group, block()]


def _search(texts: list[str | None], pairs: Pairs, blocks: list[Block]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """For each text: its number of words, merged hit spans in words, and items found."""
    known = common.kept("words", common.Words)
    split = [hashed(t, known) for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    start = np.concatenate(([0], np.cumsum(n_words + 1)))  # a break after each text
    shard = np.zeros(start[-1], np.uint64)
    for a, w in zip(start.tolist(), split):
        shard[a : a + len(w)] = w
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    at = np.flatnonzero(pairs.likely(shard))
    if len(at):
        index = Shard(shard, at)
        change = np.zeros(start[-1] + 1, np.int64)
        for block in blocks:
            found, begin, length, (number, item) = index.hits(block)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + length, -1)
            pair = np.unique(np.stack((np.searchsorted(start, begin, side="right") - 1, found), 1), axis=0)
            low, high = np.searchsorted(number, pair[:, 1], "left"), np.searchsorted(number, pair[:, 1], "right")
            for d, a, b in zip(pair[:, 0].tolist(), low.tolist(), high.tolist()):
                items[d].update(x for x in (block.items[i] for i in item[a:b].tolist()) if x is not None)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(change) > 0).view(np.int8), [0]))))
        for a, b in edge.reshape(-1, 2).tolist():
            d = int(np.searchsorted(start, a, side="right")) - 1
            spans[d].append({"start": a - int(start[d]), "end": b - int(start[d])})
    return n_words.tolist(), spans, [sorted(x) for x in items]


def _merged(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


SPANS, ITEMS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), T.ArrayType(T.StringType())


def find_overlap(docs: DataFrame, benchmark: DataFrame, carry: Column | str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", name: str = "doc_id") -> DataFrame:
    """One row for each row of docs: carry under name, n_words, spans (array of start, end in words: merged occurrences), items (sorted ids of items with occurring windows).

    Null texts have no words, and items without words have no windows; a repeated item counts once, and an item without an id is searched but not
    listed. Repeated rows stay repeated; other columns are not read; empty tables on either side give rows without hits, or none. A text is never cut
    between shards, so the words of the longest must fit in a worker.
    """
    spark = docs.sparkSession
    common.ship(spark)
    df = docs.select((F.col(common.quoted(carry)) if isinstance(carry, str) else carry).alias("carry"), docs[text_col].alias("text"))
    kind = [df.schema["carry"], T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", ITEMS)]

    def searched(sent, more: bool):
        def run(batches):
            pairs, blocks = sent.value
            for batch in batches:
                for part in common.pieces(batch, SHARD):
                    texts = part.column(1)
                    n, spans, items = _search(texts.to_pylist(), pairs, blocks)
                    if part.num_columns > 2:  # what passes before found
                        spans = [_merged(*s) for s in zip(part.column(2).to_pylist(), spans)]
                        items = [sorted({*a, *b}) for a, b in zip(part.column(3).to_pylist(), items)]
                    found = [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
                    if more:
                        yield pa.record_batch([part.column(0), texts, *found], names=["carry", "text", "spans", "items"])
                    else:
                        yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), *found], names=["carry", "n_words", "spans", "items"])

        return common.thrifty(run)

    before: list[Block] | None = None
    for group in _benchmark(benchmark, item_col, item_text_col):
        if before is not None:
            df = common.saved(df.mapInArrow(searched(spark.sparkContext.broadcast((Pairs(before), before)), True), T.StructType([kind[0], df.schema["text"], *kind[2:]])), "searched")
        before = group
    found = df.mapInArrow(searched(spark.sparkContext.broadcast((Pairs(before), before)), False), T.StructType(kind))
    return found.withColumnRenamed("carry", name)


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word of twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What op7 returns, from find_overlap()."""
    n = _n_hit()
    return found.select(id_col, "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(n, F.col("n_words")).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all its columns, without the contaminated rows.

    Null and empty texts are clean and stay; repeated rows stay repeated; an empty benchmark changes nothing. Columns may have any names, dots too, but
    none that differ by case only, which Spark itself cannot tell apart.
    """
    found = find_overlap(docs, benchmark, common.whole(docs), text_col, item_col, item_text_col, "row")
    return found.where(~contaminated(_n_hit(), F.col("n_words"))).select("row.*")
