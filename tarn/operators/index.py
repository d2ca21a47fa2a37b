"""A stored vector index: inverted lists under a path, with insert, delete, vacuum and search.

Folders: ``centres`` (list_id, centre), ``rows/list_id=…`` (batch, id, vector), ``deleted`` (id, batch). Each change is a batch of
a number of its own; a row is live unless a later batch deleted its id. A search reads the folders of the lists that its queries
probe, and no others; every row is indexed, centres are fitted on a bounded sample.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ann import SAMPLE, _top, assign, kmeans, sample_matrix
from .knn import DIGITS, matrix, query_blocks, scores


class Index:
    """The inverted lists under ``path``."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector: str = "embedding") -> None:
        self.spark, self.path, self.id_col, self.vector = spark, path.rstrip("/"), id_col, vector

    @classmethod
    def build(cls, base: DataFrame, path: str, n_lists: int = 16, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> Index:
        """Fits the centres and writes every row that has a vector to its list."""
        out = cls(base.sparkSession, path, id_col, vector)
        centres = kmeans(sample_matrix(base, id_col, vector, sample), n_lists)
        held = out.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list_id int, centre array<double>")
        held.coalesce(1).write.parquet(f"{out.path}/centres")
        out._add(base, centres, 0)
        out.spark.createDataFrame([], f"{id_col} {base.schema[id_col].dataType.simpleString()}, batch bigint").write.parquet(f"{out.path}/deleted/batch-0")
        return out

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("list_id").collect()  # one row a list
        return np.array([r.centre for r in rows])

    def _add(self, rows: DataFrame, centres: np.ndarray, batch: int) -> None:
        placed = assign(rows.select(self.id_col, self.vector), centres, self.vector).withColumn("batch", F.lit(batch).cast("bigint"))
        # a list is written by as many tasks as its bytes need, small ones by one
        placed.hint("rebalance", "list_id").write.mode("append").partitionBy("list_id").parquet(f"{self.path}/rows")

    def _last(self) -> int:
        batches = self.spark.read.parquet(f"{self.path}/rows").agg(F.max("batch")).first()[0], self._deleted().agg(F.max("batch")).first()[0]
        return max((b for b in batches if b is not None), default=0)

    def _deleted(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/deleted/*")

    def insert(self, rows: DataFrame) -> None:
        """Adds rows to the lists of their nearest centres."""
        self._add(rows, self.centres(), self._last() + 1)

    def delete(self, ids: DataFrame) -> None:
        """Deletes the rows of these ids; searches see them gone at once, ``vacuum`` drops them."""
        batch = self._last() + 1
        ids.select(self.id_col).distinct().withColumn("batch", F.lit(batch).cast("bigint")).write.parquet(f"{self.path}/deleted/batch-{batch}-{uuid.uuid4().hex}")

    def rows(self) -> DataFrame:
        """(id, vector, list_id) of the live rows."""
        gone = self._deleted().groupBy(self.id_col).agg(F.max("batch").alias("_gone"))
        held = self.spark.read.parquet(f"{self.path}/rows").join(gone, self.id_col, "left")
        return held.filter("_gone IS NULL OR batch > _gone").select(self.id_col, self.vector, "list_id")

    def vacuum(self, path: str) -> Index:
        """The live rows as an index under another path, with the same centres."""
        out = Index(self.spark, path, self.id_col, self.vector)
        self.spark.read.parquet(f"{self.path}/centres").write.parquet(f"{out.path}/centres")
        self.rows().withColumn("batch", F.lit(0).cast("bigint")).hint("rebalance", "list_id").write.partitionBy("list_id").parquet(f"{out.path}/rows")
        self._deleted().limit(0).write.parquet(f"{out.path}/deleted/batch-0")
        return out

    def search(self, queries: DataFrame, k: int = 10, probes: int = 4, metric: str = "l2", where: Column | None = None, query_id: str = "query_id") -> DataFrame:
        """(query id, id, distance, rank): the best ``k`` live rows of each query in its nearest lists; ``where`` holds on the id.

        The queries are taken in blocks; each task compares its rows with those queries that probe their list.
        """
        centres, spark = self.centres(), self.spark
        live = self.rows() if where is None else self.rows().filter(where)
        kind, qkind = live.schema[self.id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
        out = None
        for ids, q in query_blocks(queries, query_id, self.vector):
            near = np.argsort(scores("l2_squared", q, centres), axis=1, kind="stable")[:, :probes]
            asks = {int(i): np.flatnonzero((near == i).any(axis=1)) for i in np.unique(near)}
            shared = spark.sparkContext.broadcast((ids, q, asks))  # a block of queries

            def run(batches, shared=shared):
                ids, q, asks = shared.value
                for batch in batches:
                    own, lists = np.array(batch.column(0).to_pylist(), object), np.asarray(batch.column(2))
                    x = matrix(batch.column(1))
                    found: list[tuple] = []
                    for i in np.unique(lists):
                        at, who = np.flatnonzero(lists == i), asks[int(i)]
                        d = np.round(scores(metric, q[who], x[at]), DIGITS)
                        for row, w in enumerate(who.tolist()):
                            keep = np.argsort(d[row], kind="stable")
                            last = d[row][keep[min(k, len(keep)) - 1]]
                            found += [(ids[w], own[at[j]], float(d[row][j])) for j in keep if d[row][j] <= last]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["q", "i", "d"])

            picked = live.filter(F.col("list_id").isin([*asks])).select(self.id_col, V.doubles(self.vector).alias("v"), "list_id")
            part = picked.mapInArrow(run, f"q {qkind}, i {kind}, d double")
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = spark.createDataFrame([], f"q {qkind}, i {kind}, d double")
        found = out.select(F.col("q").alias(query_id), F.col("i").alias(self.id_col), F.col("d").alias("distance"))
        return _top(found, k, ["distance", self.id_col], query_id)

    def hybrid(self, queries: DataFrame, where: Column, k: int = 10, probes: int = 4, metric: str = "l2", few: int = 20_000, query_id: str = "query_id") -> DataFrame:
        """As ``search`` under a filter: one that leaves few rows is answered from all lists, so that none of its rows is missed."""
        left = self.rows().filter(where).select(self.id_col).limit(few + 1).count()
        return self.search(queries, k, len(self.centres()) if left <= few else probes, metric, where, query_id)

    def inspect(self) -> DataFrame:
        """Live rows of each list."""
        return self.rows().groupBy("list_id").agg(F.count("*").alias("points"))
