"""Suffix dedup: remove bytes covered by a 50-byte string that also starts in a document with a smaller id.

The suffixes of a corpus are sorted by a distributed merge sort that knows common prefixes, but only those that can matter:

1. Texts equal as a whole are one class; a copy with a greater id loses everything.
2. Every 50-byte string contains an anchor: the least hash among its 20-byte substrings, chosen by content, so equal strings have equal
   anchors. `repeats` tells which anchors more than one class has; suffixes at other anchors are unique and go no further.
3. Each chunk of documents sorts its remaining suffixes (50 bytes from the anchor on, then the 30 before it backwards), once each with its
   least id, cuts them at the splitters of a sample into ranges of the order, and sends each range its run, front-coded: the length of the
   prefix shared with the suffix before, and the rest.
4. A loser tree merges the runs of a range. It carries the common prefix of each loser with the last winner, so known prefixes are never compared
   again: unequal lengths decide at once, equal ones compare from there on. Suffixes that share 20 bytes form a group; no range cuts one.
5. In a group, equal suffixes get their least id, and strings around the anchor that different suffixes share get theirs; each chunk is answered
   only where that tells it something new, and turns the answers into covered bytes of its documents.

A suffix that a third of all documents have costs one entry for each chunk. Texts are written once, as chunks in a table bucketed by chunk, and
read again from there: all that is joined to them comes to their buckets, and they are never shuffled. Chunks grow with the corpus within bounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .repeats import counted, most

#: Fixed value: bytes of a string that counts as repeated. Then bytes of an anchor, and suffix bytes before it.
WINDOW = 50
ANCHOR = 20
LEFT = WINDOW - ANCHOR
#: Bytes of a sorted suffix with the two lengths (before and from the anchor) at its end.
KEY = WINDOW + LEFT + 2
CHUNK_ROWS, PART_BYTES, SUFFIXES_A_PART = 8192, 16 << 20, 200_000
#: Bytes of a chunk, at least and at most, and how many chunks there should be between those.
CHUNK_BYTES, MOST_CHUNK_BYTES, CHUNKS = 4 << 20, 64 << 20, 20_000
#: One suffix of so many is in the sample for the splitters; of those, and of splitters, the driver takes so many at most.
SAMPLED, MOST_SAMPLED, MOST_PARTS = 2048, 2_000_000, 65_536
#: Bytes of a text whose anchors are sought at once.
BLOCK = 1 << 20
NO_ID = 2**63 - 1

_LETTER = np.random.default_rng(20).integers(1, 2**63, 256, np.int64).astype(np.uint64)
_TIMES = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in (1, 2, 4, 8)]


def _slid(h: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of every `width` neighbours."""
    done = 1
    out = h
    while done < width:
        step = min(done, width - done)
        out = least(out[:-step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text's anchors and their 64-bit hashes; none for texts shorter than a window. Long texts go block by block: whether a position
    is an anchor depends on less than two windows around it."""
    if len(data) <= BLOCK:
        return _anchors(data)
    at, h = [], []
    for begin in range(0, len(data), BLOCK):
        low = max(0, begin - 2 * WINDOW)
        found, own = _anchors(data[low : begin + BLOCK + 2 * WINDOW])
        mine = (found >= begin - low) & (found < begin - low + BLOCK)
        at.append(found[mine] + low)
        h.append(own[mine])
    return np.concatenate(at), np.concatenate(h)


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _LETTER[data]
    four = None
    for k, times in enumerate(_TIMES):
        step = 1 << k
        h = h[:-step] * times + h[step:]
        if k == 1:
            four = h
    h = h[: len(data) - ANCHOR + 1] * _TIMES[2] + four[16 : 16 + len(data) - ANCHOR + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = WINDOW - ANCHOR + 1
    lowest = _slid(h, width, np.minimum)
    # A position is an anchor if it is the least of some window around it: if the greatest of those windows' least hashes is its own.
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slid(np.concatenate((edge, lowest, edge)), width, np.maximum) == h)
    return at, h[at]


def suffixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sorted form of the suffixes at these anchors: rows of KEY bytes."""
    n = len(data)
    padded = np.concatenate((np.zeros(LEFT, np.uint8), data, np.zeros(WINDOW, np.uint8)))
    out = np.empty((len(at), KEY), np.uint8)
    out[:, :WINDOW] = padded[at[:, None] + np.arange(LEFT, LEFT + WINDOW)]
    out[:, WINDOW : WINDOW + LEFT] = padded[at[:, None] + np.arange(LEFT - 1, -1, -1)]
    out[:, KEY - 2] = np.minimum(at, LEFT)
    out[:, KEY - 1] = np.minimum(n - at, WINDOW)
    return out


class Run:
    """A front-coded sorted run, read one suffix at a time."""

    __slots__ = ("key", "lcp", "place", "shared", "rest", "ids", "at")

    def __init__(self, shared: bytes, rest: bytes, ids: np.ndarray) -> None:
        self.shared, self.rest, self.ids = shared, rest, ids
        self.place, self.at, self.key, self.lcp = -1, 0, b"", 0

    def step(self) -> bool:
        """Go on to the next suffix: key, and lcp, what it shares with the one before."""
        self.place += 1
        if self.place >= len(self.shared):
            self.key, self.lcp = None, -1
            return False
        self.lcp = self.shared[self.place]
        n = KEY - self.lcp
        self.key = self.key[: self.lcp] + self.rest[self.at : self.at + n]
        self.at += n
        return True


def front_coded(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Shared prefix lengths and rests of sorted rows of KEY bytes."""
    same = keys[1:] == keys[:-1]
    shared = np.zeros(len(keys), np.uint8)
    shared[1:] = np.where(same.all(1), KEY, same.argmin(1))
    return shared.tobytes(), keys[np.arange(KEY) >= shared[:, None]].tobytes()


def _differ(p: bytes, q: bytes, known: int) -> int:
    """Where two suffixes that share `known` bytes first differ; KEY if they are equal. Nothing before `known` is looked at."""
    while known < KEY:
        a, b = p[known : known + 8], q[known : known + 8]
        if a != b:
            return known + len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8
        known += 8
    return KEY


def merged(runs: list[Run]):
    """Yields (number of the run, its lcp with the suffix yielded before) in sorted order; the run stands at the suffix when yielded.

    Inner node k of the tree holds the loser of its subtree and what that shares with the winner that passed it last.
    """
    size = 1
    while size < len(runs):
        size *= 2
    losers, shared = [-1] * size, [0] * size
    for run in runs:
        run.step()

    def beaten(a: int, x: int, b: int, y: int) -> tuple[int, int, int, int]:
        """Of two runs and what each shares with the last winner: the lesser and its share, the other and its share with the lesser."""
        if a < 0 or runs[a].key is None:
            return b, y, a, -1
        if b < 0 or runs[b].key is None:
            return a, x, b, -1
        if x != y:
            return (a, x, b, y) if x > y else (b, y, a, x)
        p, q = runs[a].key, runs[b].key
        n = _differ(p, q, x)
        return (a, x, b, n) if n == KEY or p[n] < q[n] else (b, y, a, n)

    def first(node: int) -> tuple[int, int]:
        if node >= size:
            return (node - size if node - size < len(runs) else -1), 0
        a, x = first(2 * node)
        b, y = first(2 * node + 1)
        winner, share, losers[node], shared[node] = beaten(a, x, b, y)
        return winner, share

    winner, share = first(1) if size > 1 else (0 if runs else -1, 0)
    while winner >= 0 and runs[winner].key is not None:
        yield winner, share
        run = runs[winner]
        run.step()
        share, node = run.lcp, (winner + size) // 2
        while node:
            other = losers[node]
            if other >= 0:
                known = shared[node]
                if known > share:  # the waiting suffix shares more with the last winner, so it comes first
                    losers[node], shared[node], winner, share = winner, share, other, known
                elif known == share and known >= 0:
                    winner, share, losers[node], shared[node] = beaten(winner, share, other, known)
            node //= 2


def _shared_strings(group: list[tuple[bytes, int, int]]) -> list[list[tuple[int, int]]]:
    """For each of a group's distinct sorted suffixes (key, least id, bytes shared with the one before): (bytes before the anchor, a lesser id) for
    the strings that others have too."""
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    right = [min(share, WINDOW) for *_, share in group[1:]]
    reach = [max(a, b) for a, b in zip([0, *right], [*right, 0])]
    for left in range(LEFT + 1):
        n = WINDOW - left
        least: dict[bytes, int] = {}
        found = []
        for k, (key, own, _) in enumerate(group):
            if reach[k] >= n and key[KEY - 2] >= left and key[KEY - 1] >= n:
                string = key[:n] + key[WINDOW : WINDOW + left]
                found.append((k, string))
                if own < least.get(string, NO_ID):
                    least[string] = own
        for k, string in found:
            if (x := least.get(string, NO_ID)) < group[k][1]:
                out[k].append((left, x))
    return out


def _merge_part(chunks: list[int], runs: list[Run]):
    """Answers for each run: its places, least ids there, and (place, bytes before the anchor, id) of strings shared with other suffixes."""
    places: list[list[int]] = [[] for _ in runs]
    leasts: list[list[int]] = [[] for _ in runs]
    extra: list[list[tuple[int, int, int]]] = [[] for _ in runs]
    group: list[tuple[bytes, int, int]] = []
    members: list[list[tuple[int, int, int]]] = []

    def close() -> None:
        more = _shared_strings(group) if len(group) > 1 else ([],)
        for (_, least, _), entries, found in zip(group, members, more):
            for run, place, own in entries:
                if least < own:
                    places[run].append(place)
                    leasts[run].append(least)
                extra[run] += [(place, left, x) for left, x in found]

    for number, share in merged(runs):
        run = runs[number]
        own = int(run.ids[run.place])
        if share < ANCHOR and group:
            close()
            group, members = [], []
        if share >= KEY and group:
            members[-1].append((number, run.place, own))
            if own < group[-1][1]:
                group[-1] = (run.key, own, group[-1][2])
        else:
            group.append((run.key, own, share))
            members.append([(number, run.place, own)])
    if group:
        close()
    for k, chunk in enumerate(chunks):
        if places[k] or extra[k]:
            yield chunk, np.array(places[k], np.int64), np.array(leasts[k], np.int64), np.array(extra[k], np.int64).reshape(-1, 3)


def _scan(own: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of documents (id bigint, text): chunk, rows (array of id, n, sig), text (their bytes, one after another)."""

    def scanned(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.pieces(batch, chunk_bytes):
                for i in range(0, part.num_rows, CHUNK_ROWS):
                    piece = part.slice(i, CHUNK_ROWS)
                    data = [(t or "").encode() for t in piece.column(1).to_pylist()]
                    rows = pa.StructArray.from_arrays([piece.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(d).digest() for d in data], pa.binary())], names=["id", "n", "sig"])
                    yield pa.record_batch([pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), rows), pa.array([b"".join(data)], pa.binary())], names=["chunk", "rows", "text"])
                    chunk += 1

    return own.mapInArrow(common.thrifty(scanned), "chunk bigint, rows array<struct<id: bigint, n: bigint, sig: binary>>, text binary")


def _texts(rows: list[dict], text: bytes, own: list[int]) -> list[np.ndarray]:
    ends = np.cumsum([r["n"] for r in rows])
    whole = np.frombuffer(text, np.uint8)
    return [whole[ends[k] - rows[k]["n"] : ends[k]] for k in own]


def _keyed(batches):
    """The distinct anchors of each chunk's classes, and how many of those have them."""
    for batch in batches:
        for chunk, rows, text, own in common.rows(batch):
            parts = [np.unique(anchors(data)[1]) for data in _texts(rows, text, sorted(own))]
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([most(n)], pa.binary())], names=["chunk", "keys", "many"])


def _chosen(batches):
    """Of each chunk, the classes with repeated anchors (places of their rows and numbers of such anchors), those anchors' positions, and a sample of them."""
    kind = pa.list_(pa.struct([("place", pa.int64()), ("anchors", pa.int64())]))
    for batch in batches:
        for chunk, rows, text, own, answers in common.rows(batch):
            own = sorted(own)
            data = _texts(rows, text, own)
            found = [anchors(d) for d in data]
            keys = np.unique(np.concatenate([h for _, h in found]))
            many = np.frombuffer(b"".join(a["many"] for a in answers), np.uint8) > 1
            kept = [(k, d, at[many[np.searchsorted(keys, h)]]) for k, d, (at, h) in zip(own, data, found)]
            kept = [(k, d, at) for k, d, at in kept if len(at)]
            if kept:
                seen = np.random.default_rng(chunk)
                sample = b"".join(d[p : p + ANCHOR].tobytes() for _, d, at in kept for p in at[seen.integers(0, SAMPLED, len(at)) == 0].tolist())
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([[{"place": k, "anchors": len(at)} for k, _, at in kept]], kind), pa.array([np.concatenate([at for *_, at in kept]).astype(np.uint32).tobytes()], pa.binary()), pa.array([sample], pa.binary())], names=["chunk", "chosen", "at", "sample"])


def _sorted(rows: list[dict], text: bytes, chosen: list[dict], at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """A chunk's distinct suffixes in order, the number of each anchor's suffix, each suffix's least id, and positions, ids and bytes by document."""
    positions = np.split(np.frombuffer(at, np.uint32).astype(np.int64), np.cumsum([c["anchors"] for c in chosen])[:-1])
    own = [c["place"] for c in chosen]
    data = _texts(rows, text, own)
    keys = np.concatenate([suffixes(d, p) for d, p in zip(data, positions)])
    ids = np.array([NO_ID if rows[k]["id"] is None else rows[k]["id"] for k in own], np.int64)
    distinct, number = np.unique(keys.view(f"S{KEY}").reshape(-1), return_inverse=True)
    number = number.reshape(-1)
    least = np.full(len(distinct), NO_ID, np.int64)
    np.minimum.at(least, number, np.repeat(ids, [len(p) for p in positions]))
    return np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, KEY), number, least, positions, ids, data


def _starts(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Where in a sorted run each range begins, and its end. Splitters are whole anchors, so that a group meets in one range."""
    first = np.ascontiguousarray(keys[:, :ANCHOR]).view(f"S{ANCHOR}").reshape(-1)
    return np.concatenate(([0], np.searchsorted(first, splitters, "left"), [len(keys)]))


def _splitters(sample: list[bytes], parts: int) -> np.ndarray:
    """At most parts - 1 anchors that cut a sample of them into even ranges."""
    ordered = np.sort(np.frombuffer(b"".join(sample), f"S{ANCHOR}"))
    return np.unique(ordered[np.arange(1, parts) * len(ordered) // parts]) if len(ordered) else ordered


def _covered(rows: list[dict], text: bytes, chosen: list[dict], at: bytes, answers: list[dict], splitters: np.ndarray):
    """sig, bytes removed, runs removed and the digest of what is left of each document of a chunk."""
    keys, number, least, positions, ids, texts = _sorted(rows, text, chosen, at)
    extra: dict[int, list[tuple[int, int]]] = {}
    starts = _starts(keys, splitters)
    for a in answers or ():
        begin = int(starts[a["part"]])
        place = begin + np.frombuffer(a["places"], np.int64)
        least[place] = np.minimum(least[place], np.frombuffer(a["leasts"], np.int64))
        for place, left, x in np.frombuffer(a["extra"], np.int64).reshape(-1, 3).tolist():
            extra.setdefault(begin + place, []).append((left, x))
    begin = 0
    for c, own, data, position in zip(chosen, ids.tolist(), texts, positions):
        mine = number[begin : begin + len(position)]
        begin += len(position)
        change = np.zeros(len(data) + 1, np.int32)
        before, after = keys[mine, KEY - 2].astype(np.int64), keys[mine, KEY - 1].astype(np.int64)
        spare = np.maximum(0, WINDOW - after)
        hit = (least[mine] < own) & (spare <= before)
        np.add.at(change, position[hit] - before[hit], 1)
        np.add.at(change, position[hit] - spare[hit] + WINDOW, -1)
        if extra:
            for p, k in zip(position.tolist(), mine.tolist()):
                for left, x in extra.get(k, ()):
                    if x < own:
                        change[p - left] += 1
                        change[p - left + WINDOW] -= 1
        gone = np.cumsum(change[:-1]) > 0
        n = int(gone.sum())
        if n:
            spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
            yield rows[c["place"]]["sig"], n, spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()


def _numbered(own: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """id bigint, text, and the table of id and own, in which ids that are no whole numbers are numbered in their order."""
    if isinstance(own.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return own.select(F.col("id").cast("bigint"), "text"), None
    # Numbers given within partitions, after a sort by ranges, rise with the order.
    ids = common.saved(own.select(F.col("id").alias("own")).dropna().distinct().orderBy("own").select("own", F.monotonically_increasing_id().alias("id")), "ids")
    return own.join(ids, own["id"] == ids["own"], "left").select(ids["id"], own["text"]), ids


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id (whole numbers as bigint, others as they are), n_bytes, n_removed, n_spans, kept_sha256.

    Ids are of any ordered type. Null texts are empty; texts under 50 bytes lose nothing; rows that share an id never remove from each other; a null
    id counts as greater than all others. Repeated rows stay repeated; other columns are not read, so no name clashes (names that differ by case
    only are ambiguous to Spark itself); an empty table gives an empty one. A text is never cut between chunks: the longest must fit in a worker,
    at about thirty bytes for each of its bytes that repeat.
    """
    spark = docs.sparkSession
    common.ship(spark)
    own, names = _numbered(common.texts(docs, id_col, text_col))
    n_bytes = int(own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, n_bytes // PART_BYTES))  # fewer than Spark's own, and it would shuffle the table after all
    table = common.bucketed(_scan(own, min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, n_bytes // CHUNKS))), "chunks", "chunk", buckets)
    rows = table.select("chunk", F.posexplode("rows").alias("pos", "r")).select("chunk", "pos", "r.*")
    order = F.struct(F.coalesce("id", F.lit(NO_ID)), "chunk", "pos")
    classes = rows.where(F.col("n") >= WINDOW).groupBy("sig").agg(F.min(order).alias("first"))
    classes = common.saved(classes.select("sig", F.col("first.col1").alias("least"), "first.chunk", "first.pos"), "classes")
    firsts = classes.groupBy("chunk").agg(F.collect_list("pos").alias("own")).hint("shuffle_hash")
    mine = table.join(firsts, "chunk").select("chunk", "rows", "text", "own")
    answers = counted(mine.mapInArrow(common.thrifty(_keyed), "chunk bigint, keys binary, many binary"), n_bytes * 2 // (WINDOW - ANCHOR + 2))
    chosen = mine.join(answers.hint("shuffle_hash"), "chunk").mapInArrow(common.thrifty(_chosen), "chunk bigint, chosen array<struct<place: bigint, anchors: bigint>>, at binary, sample binary")
    chosen = common.bucketed(chosen, "anchors", "chunk", buckets)
    n_suffixes, n_sampled = chosen.select(F.aggregate("chosen", F.lit(0).cast("bigint"), lambda n, c: n + c["anchors"]).alias("n"), (F.octet_length("sample") / ANCHOR).alias("s")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    parts = max(1, min(MOST_PARTS, -(-int(n_suffixes) // SUFFIXES_A_PART)))
    taken = chosen.select(F.explode(F.expr(f"transform(sequence(0, greatest(0, octet_length(sample) div {ANCHOR} - 1)), i -> substr(sample, int(i * {ANCHOR} + 1), {ANCHOR}))")).alias("s")).where(F.octet_length("s") == ANCHOR)
    splitters = _splitters([bytes(r[0]) for r in taken.where(F.rand(7) <= min(1.0, MOST_SAMPLED / max(1, n_sampled))).collect()], parts)

    def sent(batches):
        for batch in batches:
            for chunk, rows, text, chosen, at in common.rows(batch):
                keys, _, least, *_ = _sorted(rows, text, chosen, at)
                starts = _starts(keys, splitters)
                for p, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    if a < b:
                        shared, rest = front_coded(keys[a:b])
                        yield pa.record_batch([pa.array([p], pa.int32()), pa.array([chunk], pa.int64()), pa.array([shared], pa.binary()), pa.array([rest], pa.binary()), pa.array([least[a:b].tobytes()], pa.binary())], names=["part", "chunk", "shared", "rest", "ids"])

    def met(run: pa.Table) -> pa.Table:
        common.release()
        part = run.column("part")[0].as_py()
        runs = [Run(s, r, np.frombuffer(i, np.int64)) for s, r, i in zip(*(run.column(c).to_pylist() for c in ("shared", "rest", "ids")))]
        out = [(c, part, p.tobytes(), x.tobytes(), e.tobytes()) for c, p, x, e in _merge_part(run.column("chunk").to_pylist(), runs)]
        names = ["chunk", "part", "places", "leasts", "extra"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([o[k] for o in out], kind) for k, (n, kind) in enumerate(zip(names, kinds))})

    def resolved(batches):
        for batch in batches:
            for rows, text, chosen, at, answers in common.rows(batch):
                if found := [*_covered(rows, text, chosen, at, answers, splitters)]:
                    sig, n, spans, kept = zip(*found)
                    yield pa.record_batch([pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["sig", "removed", "spans", "kept"])

    both = table.join(chosen.select("chunk", "chosen", "at").hint("shuffle_hash"), "chunk")
    replies = both.select("chunk", "rows", "text", "chosen", "at").mapInArrow(common.thrifty(sent), "part int, chunk bigint, shared binary, rest binary, ids binary").groupBy("part").applyInArrow(met, "chunk bigint, part int, places binary, leasts binary, extra binary")
    replies = replies.groupBy("chunk").agg(F.collect_list(F.struct("part", "places", "leasts", "extra")).alias("answers"))
    cut = both.join(replies.hint("shuffle_hash"), "chunk", "left").select("rows", "text", "chosen", "at", "answers").mapInArrow(common.thrifty(resolved), "sig binary, removed bigint, spans bigint, kept string")
    # Of a class, rows with its least id have its result and the others are copies, so that no join has one key for a large group of copies.
    known = classes.select(F.col("sig").alias("class"), "least").join(cut, F.col("class") == cut["sig"], "left").select("class", "least", "removed", "spans", "kept")
    rows = rows.select("id", "n", "sig")
    out = rows.join(known, (rows["sig"] == known["class"]) & (F.coalesce(rows["id"], F.lit(NO_ID)) == known["least"]), "left")
    copy = (F.col("n") >= WINDOW) & F.col("class").isNull()
    pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
    zero = F.lit(0).cast("bigint")
    out = out.select("id", F.col("n").alias("n_bytes"), pick(F.col("n"), F.col("removed"), zero).alias("n_removed"), pick(zero + 1, F.col("spans"), zero).alias("n_spans"), pick(F.sha2(F.lit(b""), 256), F.col("kept"), F.lower(F.hex("sig"))).alias("kept_sha256"))
    if names is not None:
        out = out.join(names, "id", "left").select(F.col("own").alias("id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return out.withColumnRenamed("id", id_col)
