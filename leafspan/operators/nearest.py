"""Exact nearest vectors: each block of queries meets each block of rows, and a product of matrices leaves each query the best few of the block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: Queries and rows of a block, rows multiplied at a time, and digits of a similarity that count in its order.
QUERIES, ROWS, AT_ONCE, DIGITS = 4096, 32768, 1024, 6


def units(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length over their sizes; zero ones stay zero."""
    x = np.stack([np.asarray(v, dtype=float) for v in vectors])
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def best(similar: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, the least id of equals; columns are in order of their ids."""
    if similar.shape[1] <= k:
        return np.broadcast_to(np.arange(similar.shape[1]), similar.shape)
    # The k-th greatest parts what is surely in from what ties with it, of which the first columns fill up.
    edge = -np.partition(-similar, k - 1, axis=1)[:, k - 1 : k]
    above, level = similar > edge, similar == edge
    kept = above | level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True))
    return np.nonzero(kept)[1].reshape(len(similar), k)


def most_alike(queries: DataFrame, rows: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """a, b, similarity: for each query (a, x) the k rows (b, y) but itself of greatest cosine, 0 at least and compared to six digits, the least b of equals.

    within: a column that both must share. Exact: every query meets every row, in blocks of a bounded size that are grouped by key, so that no task's
    memory grows with the table. Vectors that are missing, zero or of another length than the query count 0.
    """
    ship(queries.sparkSession)
    by = F.lit(0) if within is None else F.col(within)
    q = queries.select(by.alias("w"), "a", "x").where(F.col("w").isNotNull() & F.col("a").isNotNull())
    r = rows.select(by.alias("w"), "b", "y").where(F.col("w").isNotNull() & F.col("b").isNotNull())
    blocks = lambda df, size, name: df.groupBy("w").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    shape = blocks(q, QUERIES, "nq").join(blocks(r, ROWS, "nr"), "w")
    own = q.join(shape, "w").withColumn("i", F.pmod(F.xxhash64("a"), "nq")).withColumn("j", F.explode(F.expr("sequence(0L, nr - 1L)")))
    other = r.join(shape, "w").withColumn("j", F.pmod(F.xxhash64("b"), "nr")).withColumn("i", F.explode(F.expr("sequence(0L, nq - 1L)")))
    own = own.select("w", "i", "j", "a", "x")
    other = other.select("w", "i", "j", "b", "y")

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": left["a"][:0], "b": right["b"][:0], "similarity": np.zeros(0)})
        right = right.sort_values("b", kind="stable")
        out = []
        sizes = lambda vs: np.array([-1 if v is None else len(v) for v in vs])
        step = max(k, AT_ONCE)  # all parts but the last have k columns
        n, m, ids = sizes(left["x"]), sizes(right["y"]), right["b"].to_numpy()
        for length in np.unique(n):
            at = np.flatnonzero(n == length)
            x = units(left["x"].iloc[at]) if length > 0 else None
            a = left["a"].to_numpy()[at]
            top = None
            for start in range(0, len(right), step):
                part = slice(start, start + step)
                b = ids[part]
                similar = np.zeros((len(at), len(b)))
                fits = np.flatnonzero(m[part] == length)
                if length > 0 and len(fits):
                    similar[:, fits] = x @ units(right["y"].iloc[part].iloc[fits]).T
                    np.maximum(similar, 0.0, out=similar)
                itself = np.flatnonzero(np.isin(a, b))
                similar[itself] = np.where(a[itself, None] == b[None], -1.0, similar[itself])
                # Later ids lose ties, so only what is greater than a query's last matters.
                hit = np.arange(len(at)) if top is None else np.flatnonzero(np.floor(similar.max(1) * 10**DIGITS + 0.5) > top[0].min(1))
                new = [np.floor(similar[hit] * 10**DIGITS + 0.5), similar[hit], np.broadcast_to(b, (len(hit), len(b)))]
                both = new if top is None else [np.concatenate((t[hit], z), axis=1) for t, z in zip(top, new)]
                found = best(both[0], k)
                kept = [np.take_along_axis(z, found, 1) for z in both]
                if top is None:
                    top = kept
                for t, z in zip(top, kept):
                    t[hit] = z
            out.append(pd.DataFrame({"a": np.repeat(a, top[0].shape[1]), "b": top[2].ravel(), "similarity": top[1].ravel()}))
        found = pd.concat(out)
        return found[found["similarity"] >= 0]

    types = f"a {queries.schema['a'].dataType.simpleString()}, b {rows.schema['b'].dataType.simpleString()}, similarity double"
    found = own.groupBy("w", "i", "j").cogroup(other.groupBy("w", "i", "j")).applyInPandas(met, types)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("similarity", DIGITS)), "b"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")
