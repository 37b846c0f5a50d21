"""What several operators of this subpackage need: code shipping, shared tables, row batches."""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship  # noqa: F401
from ..functions.tables import saved, shared_folder  # noqa: F401


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As saved(), in n buckets by a key: joins by that key do not shuffle the table again. The catalogue forgets it at once; the files stay."""
    spark = df.sparkSession
    table = f"leafspan_{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_folder(spark)}/{table}").option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


#: A key with more than one of so many rows is hot.
HOT = 200
#: Bytes of a table that may be broadcast after they have been counted.
SMALL = 8 << 20


def join_one(many: DataFrame, one: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """many joined to one, a saved table that has each key once, with the number of its rows in many under weight. Keys with more than a share of the
    total rows are hot. They are fewer than HOT, so they are broadcast; the rest is shuffled, and no task gets one key's rows alone."""
    is_hot = F.col(weight) > total // HOT + 1
    if one.where(is_hot).isEmpty():
        return many.join(one, key, how).drop(weight)
    hot = F.broadcast(one.where(is_hot))
    rest = many.join(hot.select(key), key, "left_anti")
    return many.join(hot, key).unionByName(rest.join(one.where(~is_hot), key, how)).drop(weight)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole(df: DataFrame) -> Column:
    """A row as a struct, whatever its columns' names."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other columns cannot clash."""
    return df.select(df[id_col].alias("id"), df[text_col].alias("text"))


def pieces(batch: pa.RecordBatch, most: int = 4 << 20):
    """Slices of a batch of about `most` bytes, so that few very long texts meet in Python at once."""
    size = batch.nbytes
    step = max(1, int(batch.num_rows * most / size)) if size > most else max(1, batch.num_rows)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def rows(batch: pa.RecordBatch):
    """A batch's rows one at a time, as Python values but for binary columns, which stay buffers: chunks are large, so few are copied at once."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for c in batch.columns)


class Words(dict):
    """64-bit hash of each word, never 0; so many are remembered."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) or 1
        return h


_kept: dict = {}


def kept(key, make):
    """What make() returns, made once in a worker and kept until another operator keeps something: workers outlive stages, and memory is short."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give freed memory back to the system, which Arrow and the C library else keep for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def thrifty(work):
    """A function for mapInArrow that gives back freed memory when its partition is done."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each. A later filter is then not pushed into df's projections, where it would be written out from
    the inputs and repeat costly array expressions many times over."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def hexdigest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def tokenizer_file(path: str | None, name: str) -> bytes:
    """A vocabulary file's bytes, read on the driver; its size is bounded by the vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()
