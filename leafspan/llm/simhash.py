"""SimHash near-duplicates by tiled exact comparison.

1. A text's fingerprint has a bit where more than half of its shingles' hashes have it; made once, texts are not read again.
2. Rows with equal fingerprints are one class. The 64 bits are cut into radius + 2 blocks; two fingerprints within the radius differ in at most
   `radius` blocks, so they agree in at least two. Each class is dealt under every choice of two blocks, with their bits as the key.
3. What shares a key is laid out in tiles in order of population count. A tile is compared with itself and with later ones by exclusive-or and
   bit counts; pairs of tiles whose population counts differ by more than the radius are skipped, as are tiles already known to be one component.
   A key of very many fingerprints is cut by population count and hash, and pairs of such parts go to tasks of their own.
4. Each task emits a spanning forest of its links; components of those, then classes, give each row its component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile, words hashed at once, and fingerprints of a key beyond which it is cut into parts.
TILE, WORDS, PART = 256, 1 << 16, 8192

#: bytes → itself, with A-Z in lower case and white space as a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """The 64 bits of a text; 0 for a null text or one without words."""
    from xxhash import xxh64_intdigest

    words = [w for w in text.encode().translate(TABLE).split(b" ") if w] if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(SHINGLE, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    n = len(words) - size + 1
    ends = (starts[size:] - 1).tolist()
    starts = starts[:n].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, WORDS):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + WORDS], ends[at : at + WORDS])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id and fp, the fingerprint as a signed long.

    Whole texts; null texts and those without words have 0; a text's words are held as one list, so the longest must fit in a worker. Repeated rows
    stay repeated, a null id stays null, other columns are not read, an empty table gives an empty one.
    """
    common.ship(docs.sparkSession)

    def made(batches):
        for batch in batches:
            for part in common.pieces(batch):
                fp = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64), pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.texts(docs, id_col, text_col).mapInArrow(common.thrifty(made), f"id {kind}, fp bigint")


def block_masks(radius: int) -> list[int]:
    """Masks of radius + 2 blocks of neighbouring bits that make up the 64."""
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def keys(fp: Column, radius: int = RADIUS) -> Column:
    """For every choice of two blocks a number and the bits of those blocks, hashed together: fingerprints within the radius share one at least.
    Keys that collide by chance cost comparisons and change no link."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(a | b)))) for k, (a, b) in enumerate(combinations(block_masks(radius), 2))])


class Forest:
    """Components among numbered rows, and the edges that joined them."""

    def __init__(self, n: int) -> None:
        self.of, self.members, self.edges = np.arange(n), {}, []

    def join(self, i: int, j: int) -> None:
        a, b = int(self.of[i]), int(self.of[j])
        if a == b:
            return
        self.edges.append((i, j))
        less, more = sorted((a, b), key=lambda x: len(self.members.get(x, (x,))))
        gone = self.members.pop(less, [less])
        self.of[gone] = more
        self.members.setdefault(more, [more]).extend(gone)


def tile_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows in order of group and population count, as pairs of positions. Only rows of one group need be compared;
    rows of one group that are both of side 1, or both of side 2, need not either. All found links are true ones."""
    pop = np.bitwise_count(fps).astype(np.int64)
    forest = Forest(len(fps))
    starts = range(0, len(fps), TILE)
    for a in starts:
        end = min(a + TILE, len(fps))
        for b in range(a, len(fps), TILE):
            last = min(b + TILE, len(fps))
            if b > a and group[b] != group[end - 1]:
                break
            one = group[a] == group[last - 1]
            if one and pop[b] - pop[end - 1] > radius:
                break
            if one and side[a] and (side[a:end] == side[a]).all() and (side[b:last] == side[a]).all():
                continue
            own, other = forest.of[a:end], forest.of[b:last]
            if own[0] == other[0] and (own == own[0]).all() and (other == own[0]).all():
                continue
            near = np.bitwise_count(fps[a:end, None] ^ fps[None, b:last]) <= radius
            while True:
                new = near & (forest.of[a:end, None] != forest.of[None, b:last])
                rows = np.flatnonzero(new.any(axis=1))
                if not len(rows):
                    break
                for i, j in zip(rows.tolist(), new[rows].argmax(axis=1).tolist()):
                    forest.join(a + i, b + j)
    return forest.edges


def _parts(keyed: DataFrame, radius: int) -> DataFrame:
    """The rows of `keyed` (key, pop, fp) of which more than PART share a key, once for each pair of parts to be compared: key, side, pop, fp.

    A part is a population count, or one of several by hash where that is still large; its partners are the parts within the radius.
    """
    per = keyed.groupBy("key", "pop").count()
    large = per.groupBy("key").agg(F.sum("count").alias("all"), F.collect_list(F.struct("pop", "count")).alias("pops")).where(F.col("all") > PART)
    # Parts grow with the square root of the key's size, so that a row is copied to no more than as many pairs.
    size = F.greatest(F.lit(PART), F.ceil(F.sqrt(F.col("all").cast("double") * PART)).cast("long"))
    parts = F.flatten(F.transform("pops", lambda p: F.transform(F.sequence(F.lit(0), F.ceil(p["count"] / size).cast("int") - 1), lambda k: F.struct(p["pop"].alias("pop"), k.alias("k"), F.ceil(p["count"] / size).cast("int").alias("of")))))
    large = common.saved(large.select("key", F.array_sort(parts).alias("parts"), "all"), "tile-parts")
    own = F.filter("parts", lambda p: (p["pop"] == F.col("pop")) & (p["k"] == F.pmod(F.xxhash64("fp", F.lit(7)), p["of"])))[0]
    n_bytes = large.agg(F.coalesce(F.sum(F.size("parts") * 16 + 32), F.lit(0))).first()[0]
    rows = keyed.join(F.broadcast(large) if n_bytes <= common.SMALL else large, "key")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.filter("parts", lambda p: F.abs(p["pop"] - F.col("pop")) <= radius)))
    named = lambda p: F.struct(p["pop"], p["k"])
    mine, theirs = named(F.col("own")), named(F.col("other"))
    side = F.when(mine == theirs, 0).when(mine < theirs, 1).otherwise(2)
    return rows.select(F.xxhash64("key", F.least(mine, theirs), F.greatest(mine, theirs)).alias("key"), side.cast("int").alias("side"), "pop", "fp")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp): with them the same are connected as by all pairs that differ in at most `radius` bits."""
    spark = classes.sparkSession
    keyed = classes.select(F.explode(keys(F.col("fp"), radius)).alias("key"), F.bit_count("fp").alias("pop"), "fp")
    sizes = common.saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("key"), "tile-keys")
    if sizes.isEmpty():
        dealt = keyed.withColumn("side", F.lit(0))
    else:  # fewer than one key for every PART rows
        small = sizes.count() * 16 <= common.SMALL
        mark = F.broadcast(sizes) if small else sizes
        dealt = keyed.join(mark, "key", "left_anti").withColumn("side", F.lit(0)).unionByName(_parts(keyed.join(mark, "key", "left_semi"), radius))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key", "pop")

    def compared(batches):
        def found(table: pa.Table):
            fps = table.column("fp").to_numpy().view(np.uint64)
            edges = tile_links(fps, table.column("key").to_numpy(), table.column("side").to_numpy(), radius)
            a, b = (np.array(x, np.int64) for x in (zip(*edges) if edges else ((), ())))
            return pa.record_batch([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1]))  # the last key may go on in the next batch
            open_rows.append(batch.slice(0, cut))
            if cut or open_rows[0].num_rows and open_rows[0].column(0)[0].as_py() != group[0]:
                yield found(pa.Table.from_batches(open_rows))
                open_rows = []
            open_rows.append(batch.slice(cut))
        if open_rows:
            yield found(pa.Table.from_batches(open_rows))

    return dealt.select("key", "side", "fp").mapInArrow(common.thrifty(compared), "a bigint, b bigint").distinct()


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hexadecimal digits), component_id (least id reachable by links of fingerprints that differ in at
    most `radius` bits, its own included).

    Whole texts; null texts and those without words have fingerprint 0 and are linked like any other. Repeated rows stay repeated and are linked; ties
    do not matter; other columns are not read, so no name clashes; an empty table gives an empty one. Null ids are allowed but are no one's component
    unless all ids there are null. The longest text must fit in a worker.
    """
    rows = common.saved(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = common.saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("many")), "fingerprint-classes")
    found = components(links(classes.select("fp"), radius))
    named = common.saved(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", "many", F.coalesce("label", "fp").alias("label")), "fingerprint-labels")
    least = common.saved(named.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("n_fps")), "fingerprint-components")
    n_fps, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("many"), F.lit(0))).first()
    named = common.saved(common.join_one(named, least, "label", "n_fps", n_fps, "inner").select("fp", "component", "many"), "fingerprint-named")
    out = common.join_one(rows, named, "fp", "many", n_rows, "inner")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs, all its columns, with one document of each component: the one whose id names it. Rows that repeat an id are kept together, and so are rows
    with a null id. Null texts and those without words share one fingerprint, so one of them stays; an empty table stays empty; no name clashes."""
    gone = link_documents(docs, id_col, text_col, radius).where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
