"""Exact nearest neighbours. Ties go to the smaller id; rows without a distance come last and are left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

DIGITS = 6
#: Bytes of queries that a worker holds at once; beyond, they are taken in blocks.
QUERY_BYTES = 32_000_000
#: Distances that a worker holds at once.
CELLS = 2_000_000


def nearest(base: DataFrame, query: Column | list, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows of one vector, as (id, distance); a filter goes to the scan."""
    if isinstance(query, list):
        query = F.array(*[F.lit(float(x)) for x in query])
    df = base if where is None else base.filter(where)
    d = F.round(V.distance(metric, F.col(vector), query), DIGITS)
    return df.select(id_col, d.alias("distance")).filter("distance is not null").orderBy("distance", id_col).limit(k)


def nearest_of_subquery(base: DataFrame, one: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As ``nearest``, for the vector of a one-row DataFrame."""
    q = one.select(F.col(vector).alias("_q")).limit(1)
    d = F.round(V.distance(metric, F.col(vector), F.col("_q")), DIGITS)
    return base.join(F.broadcast(q)).select(id_col, d.alias("distance")).filter("distance is not null").orderBy("distance", id_col).limit(k)


def scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices, by one product."""
    dot = q @ x.T
    if metric in ("ip", "negative_ip"):
        return -dot
    qq, xx = (q * q).sum(axis=1)[:, None], (x * x).sum(axis=1)[None, :]
    if metric in ("cosine", "spherical"):
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = 1 - dot / np.sqrt(qq * xx)
        return cos if metric == "cosine" else np.arccos(np.clip(1 - cos, -1, 1)) / np.pi
    squared = np.maximum(qq + xx - 2 * dot, 0)
    return np.sqrt(squared) if metric == "l2" else squared


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of one length as rows of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def query_blocks(queries: DataFrame, query_id: str, vector: str, each: int = 1):
    """The queries in blocks of bounded bytes: a stated query set against all rows, of which a worker keeps ``each`` for every query."""
    ids, rows, size = [], [], 0
    for r in queries.select(query_id, V.doubles(vector).alias("v")).toLocalIterator():
        if r.v is None:
            continue
        ids.append(r[0]), rows.append(np.array(r.v, np.float64))
        size += 8 * len(r.v)
        if size >= QUERY_BYTES or len(ids) * each >= CELLS:
            yield ids, np.vstack(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield ids, np.vstack(rows)


def least(d: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (row, column) of the ``k`` least values of each row by (value, the column's tie), row by row in this order; NaN and infinity are left out."""
    k = min(k, d.shape[1])
    if k < d.shape[1]:
        d = np.where(np.isnan(d), np.inf, d)
        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, col = np.nonzero(np.isfinite(d))
    good = np.isfinite(d[row, col])
    row, col = row[good], col[good]
    order = np.lexsort((tie[col], d[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(d)))[row] < k
    return row[keep], col[keep]


def ties(ids: pa.Array) -> np.ndarray:
    """The places of ids, numbers or texts, in their order."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    return np.unique(np.array(ids.to_pylist(), object), return_inverse=True)[1]


def pieces(n: int, width: int):
    """Slices of ``n`` rows of which each has about ``CELLS`` cells at most."""
    step = max(1, CELLS // max(1, width))
    return (slice(a, a + step) for a in range(0, n, step))


class Best:
    """The k best rows of each query so far, by the first of their values and the id, from pieces of any order; in memory k a query."""

    def __init__(self, k: int, kind: pa.DataType, values: int) -> None:
        self.k = k
        self.row, self.id, self.values = np.empty(0, np.int64), pa.array([], kind), [np.empty(0) for _ in range(values)]

    def add(self, row: np.ndarray, ids: pa.Array, *values: np.ndarray) -> None:
        row, ids = np.concatenate([self.row, row]), pa.concat_arrays([self.id, ids])
        values = [np.concatenate(v) for v in zip(self.values, values)]
        order = np.lexsort((ties(ids), values[0], row))
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < self.k
        self.row, self.values, self.id = row[keep], [v[order[keep]] for v in values], ids.take(pa.array(order[keep]))


def best_of(batches, asked: pa.Array, k: int, found, names: tuple = ("d",)):
    """The ``k`` best rows of each query in a task, as batches of q, i and ``names``; ``found`` gives (query places, column places, values) of a batch, piece by piece."""
    best = None
    for batch in batches:
        batch = batch.filter(batch.column(1).is_valid())
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        best = best or Best(k, ids.type, len(names))
        parts = [p for p in found(batch, ties(ids)) if len(p[0])]
        if parts:
            row, col, *values = (np.concatenate(c) for c in zip(*parts))
            best.add(row, ids.take(pa.array(col)), *values)
    if best:
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(best.row)), best.id, *map(pa.array, best.values)], names=["q", "i", *names])


def nearest_batch(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query id, id, distance, rank) of the ``k`` nearest rows of each query.

    Each task multiplies its rows with a block of queries, ``CELLS`` distances at a time, and passes on its own k best of each, so
    the one shuffle has k rows a query and task.
    """
    spark = base.sparkSession
    kind, qkind = base.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    out = None
    for ids, q in query_blocks(queries, query_id, vector, k):
        shared = spark.sparkContext.broadcast((pa.array(ids), q))  # a block: at most QUERY_BYTES

        def run(batches, shared=shared):
            asked, q = shared.value

            def found(batch, tie):
                x = matrix(batch.column(1))
                for some in pieces(len(q), len(x)):
                    d = np.round(scores(metric, q[some], x), DIGITS)
                    row, col = least(d, tie, k)
                    yield row + some.start, col, d[row, col]

            yield from best_of(batches, asked, k, found)

        part = base.select(id_col, V.doubles(vector).alias("v")).mapInArrow(run, f"q {qkind}, i {kind}, d double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"q {qkind}, i {kind}, d double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "i"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("i").alias(id_col), F.col("d").alias("distance"), "rank")


def recall(found: DataFrame, truth: DataFrame, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """The share of the true neighbours that were found."""
    hit = truth.select(query_id, id_col).join(found.select(query_id, id_col, F.lit(1).alias("hit")), [query_id, id_col], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
