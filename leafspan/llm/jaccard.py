"""Exact n-gram Jaccard join with set-relation skipping.

1. One pass hashes every text's distinct shingles. Texts with equal sets (a 128-bit signature) are one class; the rest works on classes.
2. Linked sets share at least four fifths of either, so, in hash order, at least a known number of their first two fifths
   (prefix filter). `repeats` tells which of those shingles more than one class has; classes with too few cannot link and drop out.
3. The remaining classes' shingles are counted, and each set's prefix is formed anew of its rarest ones, so that widely shared passages chain
   nothing. The lists of those prefixes chain together what may link at all: groups.
4. Within a group, an index list of each shingle names its sets by position in order of size, so that a set skips to the block of sizes that
   matter. A pivot's overlaps are counted from its lists. They answer for every set linked with it too: by the triangle inequality of the Jaccard
   distance, such a set can link only with sets near the pivot; overlaps with those that are not yet in its component are derived from the pivot's
   by adding the lists of shingles only the new set has and taking off those only the pivot had. Copies of one text so cost one pivot.
   Large groups are split into pairs of blocks.
5. Links' components, then classes, give each document its component.

Only a spanning forest of a group's links is ever emitted, so rows stay linear in the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .repeats import counted, most

#: Shingle length and similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Documents and text bytes of a chunk, and shingles of a block in a large group.
CHUNK_ROWS, CHUNK_BYTES, PART_BYTES, BLOCK_SHINGLES = 4096, 4 << 20, 16 << 20, 1_000_000
#: Bytes of a list of ids that may be broadcast.
BROADCAST = 8 << 20
#: More than the sets of a group.
STEP = 1 << 32

#: bytes → itself, with A-Z in lower case and white space as a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    split = text.encode().translate(TABLE).split(b" ") if text else ()
    hashes = common.kept("words", common.Words)
    own = np.array([hashes[w] for w in split if w], np.uint64)
    if not len(own):
        return own
    length = min(SHINGLE, len(own))
    n = len(own) - length + 1
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = h * MULTIPLY + own[k : k + n]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def missing(n: int) -> int:
    """How many shingles of a set of n a linked set can lack."""
    return n - -(-PERCENT * n // 100)


def prefix(n: int) -> int:
    """Shingles of the candidate prefix: as many again as can be missing."""
    return min(n, 2 * missing(n) + 1)


def needed(n: int) -> int:
    """Shingles of its prefix that a set surely shares with each linked set. A linked set of m >= 80 % of n shingles has the first
    missing(m) + missing(m) + 1 in its own prefix; both prefixes then have at least missing(m) + 1 in common for the smaller of the two."""
    least = -(-PERCENT * n // 100)
    return min(missing(m) + 1 for m in {least, n})


def _buckets(spark, n_bytes: int) -> int:
    """Not fewer than Spark's own partitions, or it would shuffle a bucketed table after all."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, n_bytes // PART_BYTES))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks of documents: chunk, rows (array of id, n, sig), tokens (the prefixes' hashes, one after another)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scanned(batches):
        import xxhash
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.pieces(batch, CHUNK_BYTES):
                for i in range(0, part.num_rows, CHUNK_ROWS):
                    piece = part.slice(i, CHUNK_ROWS)
                    n, sig, tokens = [], [], []
                    for text in piece.column(1).to_pylist():
                        own = shingles(text)
                        n.append(len(own))
                        sig.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                        tokens.append(own[: prefix(len(own))])
                    rows = pa.StructArray.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "sig"])
                    rows = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), rows)
                    yield pa.record_batch([pa.array([chunk], pa.int64()), rows, pa.array([np.concatenate(tokens).tobytes()], pa.binary())], names=["chunk", "rows", "tokens"])
                    chunk += 1

    return common.texts(docs, id_col, text_col).mapInArrow(common.thrifty(scanned), f"chunk bigint, rows array<struct<id: {kind}, n: bigint, sig: binary>>, tokens binary")


def _cut(tokens, sizes: list[int]) -> list[np.ndarray]:
    return np.split(np.frombuffer(tokens, np.uint64), np.cumsum([prefix(n) for n in sizes])[:-1]) if sizes else []


def _candidates(table: DataFrame, firsts: DataFrame) -> DataFrame:
    """sig and id of one document of each class that may link: enough of its prefix is in other classes too."""

    def keyed(batches):
        for batch in batches:
            for chunk, rows, tokens, own in common.rows(batch):
                own = set(own)
                parts = [t for k, t in enumerate(_cut(tokens, [r["n"] for r in rows])) if k in own]
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([most(n)], pa.binary())], names=["chunk", "keys", "many"])

    def judged(batches):
        for batch in batches:
            for rows, tokens, own, answers in common.rows(batch):
                own = sorted(own)
                parts = _cut(tokens, [r["n"] for r in rows])
                keys = np.unique(np.concatenate([parts[k] for k in own]))
                many = np.frombuffer(b"".join(a["many"] for a in answers), np.uint8) > 1
                keep = [k for k in own if int(many[np.searchsorted(keys, parts[k])].sum()) >= needed(rows[k]["n"])]
                yield pa.record_batch([pa.array([rows[k]["id"] for k in keep], batch.schema.field(0).type.value_type.field("id").type), pa.array([rows[k]["sig"] for k in keep], pa.binary())], names=["id", "sig"])

    kind = table.schema["rows"].dataType.elementType["id"].dataType.simpleString()
    n_keys = table.select(F.explode("rows.n").alias("n")).agg(F.coalesce(F.sum(F.col("n") * 2 / 5 + 1), F.lit(0))).first()[0]
    chosen = table.join(firsts.hint("shuffle_hash"), "chunk").select("chunk", "rows", "tokens", "own")
    answers = counted(chosen.mapInArrow(common.thrifty(keyed), "chunk bigint, keys binary, many binary"), int(n_keys))
    return chosen.join(answers.hint("shuffle_hash"), "chunk").select("rows", "tokens", "own", "answers").mapInArrow(common.thrifty(judged), f"id {kind}, sig binary")


def _sets(docs: DataFrame, candidates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks of candidate classes, hashed again from one of their texts: chunk, rows (array of sig, n), tokens. Rows that repeat an id may bring a
    class, or one that is no candidate, more than once, which changes no result."""
    ids = candidates.select(F.col("id").alias("own")).distinct()
    own = common.texts(docs, id_col, text_col)
    small = (ids.agg(F.sum(16 + F.octet_length(F.col("own").cast("string")))).first()[0] or 0) <= BROADCAST  # beyond that both sides are shuffled
    chosen = own.join(F.broadcast(ids) if small else ids, own["id"].eqNullSafe(ids["own"]), "left_semi")

    def hashed(batches):
        import xxhash
        from pyspark import TaskContext

        chunk, seen = TaskContext.get().partitionId() << 32, set()
        for batch in batches:
            for part in common.pieces(batch, CHUNK_BYTES):
                sets = {}
                for text in part.column(1).to_pylist():
                    own = shingles(text)
                    sig = xxhash.xxh3_128_digest(own.tobytes())
                    if len(own) and sig not in seen:
                        seen.add(sig)
                        sets[sig] = own
                if sets:
                    rows = pa.StructArray.from_arrays([pa.array([*sets], pa.binary()), pa.array([len(s) for s in sets.values()], pa.int64())], names=["sig", "n"])
                    yield pa.record_batch([pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(sets)], pa.int32()), rows), pa.array([np.concatenate([*sets.values()]).tobytes()], pa.binary())], names=["chunk", "rows", "tokens"])
                    chunk += 1

    return chosen.select("id", "text").mapInArrow(common.thrifty(hashed), "chunk bigint, rows array<struct<sig: binary, n: bigint>>, tokens binary")


def _whole(rows: list[dict], tokens) -> list[np.ndarray]:
    return np.split(np.frombuffer(tokens, np.uint64), np.cumsum([r["n"] for r in rows])[:-1])


def rarest(own: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of a set's shingles with the numbers of sets that have them: its prefix in order of those numbers, without shingles of its own alone."""
    first = np.lexsort((own, many))[: missing(len(own)) + 1]
    return own[first[many[first] > 1]]


def _chains(sets: DataFrame) -> DataFrame:
    """Edges a, b that chain together the classes of each prefix shingle's list, in order of size, while sizes can link."""

    def keyed(batches):
        for batch in batches:
            for chunk, tokens in common.rows(batch):
                keys, n = np.unique(np.frombuffer(tokens, np.uint64), return_counts=True)
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([most(n)], pa.binary())], names=["chunk", "keys", "many"])

    def posted(batches):
        for batch in batches:
            for rows, tokens, answers in common.rows(batch):
                keys = np.unique(np.frombuffer(tokens, np.uint64))
                many = np.frombuffer(b"".join(a["many"] for a in answers), np.uint8)
                parts = [rarest(own, many[np.searchsorted(keys, own)]) for own in _whole(rows, tokens)]
                who = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
                yield pa.record_batch([pa.array(np.concatenate(parts).view(np.int64), pa.int64()), pa.array([r["sig"] for r in rows], pa.binary()).take(who), pa.array([r["n"] for r in rows], pa.int64()).take(who)], names=["token", "sig", "n"])

    n_keys = sets.select(F.explode("rows.n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    answers = counted(sets.select("chunk", "tokens").mapInArrow(common.thrifty(keyed), "chunk bigint, keys binary, many binary"), int(n_keys))
    posts = sets.join(answers.hint("shuffle_hash"), "chunk").select("rows", "tokens", "answers").mapInArrow(common.thrifty(posted), "token bigint, sig binary, n bigint")
    # A shingle that many classes share is dealt by size too: sizes in one bin of a ratio of 5/4 or the next can link, no others.
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.26))))
    binned = common.saved(posts.withColumn("bin", F.explode(F.array(size, size + 1))).withColumn("list", F.xxhash64("token", "bin")).select("list", "sig", "n"), "posts")
    ends = common.saved(binned.groupBy("list").agg(F.min(F.struct("n", "sig"))["sig"].alias("first"), F.count("*").alias("many")).where("many > 1"), "ends")
    pairs = common.join_one(binned, ends, "list", "many", binned.count(), "inner")
    return pairs.where(F.col("sig") != F.col("first")).select(F.col("sig").alias("a"), F.col("first").alias("b")).distinct()


def _blocks(lists: np.ndarray, start: np.ndarray, keys: np.ndarray, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
    """The positions in low .. high-1 of some index lists, one list after another; lists of one set, or with none there, are skipped unread.

    keys are the lists' positions, each with its token before it, so that all lists are bisected at once.
    """
    tokens = tokens[start[tokens + 1] - start[tokens] > 1]
    a, b = (np.searchsorted(keys, tokens * STEP + at) for at in (low, high))
    n = b - a
    return lists[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _forest(sigs: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links among some sets."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sigs[i]))
    sigs, sets = [sigs[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    number, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.reshape(-1)
    member = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    lists, start = member[by], np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(number)))))
    keys = flat[by] * STEP + lists
    own = np.split(flat, np.cumsum(sizes)[:-1])
    # Sets linked with one that is linked with a set lie within twice the distance of it: in the block of sizes of a similarity of 60 %.
    near = 2 * PERCENT - 100
    lows = np.searchsorted(sizes * 100, sizes * near, "left").tolist()
    highs = np.searchsorted(sizes * near, sizes * 100, "right").tolist()
    component = np.arange(len(sets))  # of each set, the least position of what it is known to be connected with
    members = {}
    done = np.zeros(len(sets), bool)
    edges: list[tuple[bytes, bytes]] = []

    def join(i: int, j: int) -> None:
        a, b = component[i], component[j]
        if a == b:
            return
        edges.append((sigs[i], sigs[j]))
        of = [members.pop(x, [x]) for x in (a, b)]
        of.sort(key=len)
        label = component[of[1][0]]
        component[of[0]] = label
        of[1].extend(of[0])
        members[label] = of[1]

    def counts(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        return np.bincount(_blocks(lists, start, keys, tokens, low, high) - low, minlength=high - low)

    for i in range(len(sets)):
        if done[i]:
            continue
        done[i] = True
        low, high = lows[i], highs[i]
        overlap = counts(own[i], low, high)
        overlap[i - low] = 0
        union = sizes[low:high] + len(sets[i]) - overlap
        linked = np.flatnonzero(100 * overlap >= PERCENT * union)
        for j in linked.tolist():
            join(i, j + low)
        distance = 1 - overlap / union
        # What a linked set can still be linked with beyond this component: nothing further off, and nothing that has had its own turn.
        ring = np.flatnonzero((100 * overlap >= near * union) & ~done[low:high])
        mine = linked[~done[linked + low]]
        for j in mine[np.argsort(distance[mine], kind="stable")].tolist():
            if not len(ring := ring[component[ring + low] != component[i]]):
                break
            n = len(sets[j + low])
            near_j = ring[(distance[ring] <= 1 - PERCENT / 100 + distance[j] + 1e-9) & (100 * sizes[ring + low] >= PERCENT * n) & (PERCENT * sizes[ring + low] <= 100 * n)]
            if not len(near_j):
                continue
            a, b = int(near_j[0]) + low, int(near_j[-1]) + low + 1
            change = counts(np.setdiff1d(own[j + low], own[i], assume_unique=True), a, b) - counts(np.setdiff1d(own[i], own[j + low], assume_unique=True), a, b)
            derived = overlap[near_j] + change[near_j - (a - low)]
            for k in near_j[100 * derived >= PERCENT * (sizes[near_j + low] + n - derived)].tolist():
                join(j + low, k + low)
        done[mine + low] = True
    return edges


def _links(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges a, b of a spanning forest of the links in each group."""

    def each(batches):
        for batch in batches:
            for rows, tokens in common.rows(batch):
                yield pa.record_batch([pa.array([r["sig"] for r in rows], pa.binary()), pa.array([r["n"] for r in rows], pa.int64()), pa.array([t.tobytes() for t in _whole(rows, tokens)], pa.binary())], names=["sig", "n", "tokens"])

    own = sets.select("rows", "tokens").mapInArrow(common.thrifty(each), "sig binary, n bigint, tokens binary")
    own = own.join(groups, own["sig"] == groups["node"]).select("sig", "n", "tokens", "label")
    sizes = own.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = own.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, F.col("blocks") - 1).otherwise(0)))
    own = own.withColumn("other", other).where("blocks = 1 or block <> other")
    own = own.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "tokens")

    def linked(table: pa.Table) -> pa.Table:
        common.release()
        edges = _forest(table.column("sig").to_pylist(), [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()])
        return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

    return own.groupBy("label", "i", "j").applyInArrow(linked, "a binary, b binary")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (least id reachable by links of 80 % Jaccard similarity, its own included).

    Whole texts; null or wordless ones are empty sets, linked with nothing. Repeated rows stay repeated and are linked; other columns are not
    read, so no name clashes (names that differ by case only are ambiguous to Spark itself); an empty table gives an empty one. Null ids are allowed
    but are no one's component unless all ids there are null. A text's words are held as one list, so the longest must fit in a worker.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n_bytes = int(docs.agg(F.coalesce(F.sum(F.octet_length(docs[text_col])), F.lit(0))).first()[0])
    buckets = _buckets(spark, n_bytes)
    table = common.bucketed(_scan(docs, id_col, text_col), "shingles", "chunk", buckets)
    rows = table.select("chunk", F.posexplode("rows").alias("pos", "r")).select("chunk", "pos", "r.*").where("sig is not null")
    classes = rows.groupBy("sig").agg(F.min(F.struct("chunk", "pos")).alias("at"), F.min("id").alias("least"), F.count("*").alias("many"))
    classes = common.saved(classes, "classes")
    firsts = classes.groupBy("at.chunk").agg(F.collect_list("at.pos").alias("own"))
    candidates = common.saved(_candidates(table, firsts), "candidates")
    sets = common.bucketed(_sets(docs, candidates, id_col, text_col), "sets", "chunk", buckets)
    groups = components(_chains(sets))
    links = components(_links(sets, groups))
    rows = table.select(F.explode("rows").alias("r")).select("r.*")
    named = common.saved(classes.join(links, classes["sig"] == links["node"], "left").select("sig", "least", "many", F.coalesce("label", "sig").alias("label")), "labels")
    least = common.saved(named.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("sets")), "components")
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("many"), F.lit(0))).first()
    named = common.saved(common.join_one(named, least, "label", "sets", n_classes, "inner").select("sig", "component", "many"), "named")
    linked = common.join_one(rows.where("sig is not null"), named, "sig", "many", n_rows).select("id", "n", "component")
    out = linked.unionByName(rows.where("sig is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all its columns, with one document of each group: the one whose id names it. Rows that repeat an id are kept together, and so are rows
    with a null id; null texts, texts without words and an empty table lose nothing. Other columns are not read, and none clashes."""
    gone = link_documents(docs, id_col, text_col).where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
