"""A stored graph over base vectors whose links come from queries of another distribution.

Training queries are clustered; the base rows nearest to a query are linked through the nearest of them, under the tag of the
query's cluster; each cluster has an entry. A search walks the links of the clusters nearest to its query only.

Folders: ``centres`` (cluster, centre), ``rows`` (shard, id, vector), ``links-N`` (shard, src, cluster, all dst) of the N-th change. A
shard has about ``ROWS`` rows, held by one task when searched and by one for each cluster when links are learnt; queries of any number
stream past them, by id, a batch at a time, and distances are taken ``knn.CELLS`` at a time. Centres are fitted on at most ``ann.SAMPLE``
training queries; every training, repair and search query is taken. Null vectors, and queries of another dimension, are left out; of rows that share an id one carries the links; an empty base gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ann import SAMPLE, SHARD, _shards, _top, kmeans, prune, sample_matrix, walk
from .knn import DIGITS, matrix, pieces, scores

#: Rows of a shard, about.
ROWS = SHARD
#: What a row of the stream is, in the order in which a shard's task reads them.
BASE, LINK, TRAIN, TRUTH, ASK = range(5)


class Graph:
    """One shard's rows and their links: those of one cluster while it learns, packed ones of all clusters for a search."""

    def __init__(self, ids: pa.Array, x: np.ndarray, centres: np.ndarray, degree: int = 40, metric: str = "l2") -> None:
        self.ids, self.x, self.centres, self.degree, self.metric = ids, x, centres, degree, metric
        self.learnt: dict[int, dict[int, set[int]]] = {}
        self.packed: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in centres]  # (sources, targets) of links as they were read
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # where each source's targets begin, and all targets
        self.entries = scores(metric, centres, x).argmin(axis=1).tolist()
        self._backwards = ids.take(pa.array(np.arange(len(ids))[::-1]))

    def places(self, ids: pa.Array) -> np.ndarray:
        """The rows of ids, of equal ones the last; -1 without one."""
        at = pc.index_in(ids, value_set=self._backwards).fill_null(len(self.ids)).to_numpy(zero_copy_only=False)
        return len(self.ids) - 1 - at

    def nearest(self, q: np.ndarray, near: int) -> Iterator[list[int]]:
        """Each query's nearest rows in their order; ``CELLS`` distances at a time."""
        near = min(near, len(self.x))
        for some in pieces(len(q), len(self.x)):
            d = scores(self.metric, q[some], self.x)
            found = np.sort(np.argpartition(d, near - 1, axis=1)[:, :near], axis=1)
            for rows, line in zip(found, d):
                yield rows[np.argsort(line[rows], kind="stable")].tolist()

    def clusters(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(scores("l2_squared", q, self.centres), axis=1, kind="stable")

    def hold(self, part: pa.RecordBatch) -> None:
        """Takes stored links."""
        known = part.column("known")
        size = pc.list_value_length(known).to_numpy(zero_copy_only=False)
        src, to = np.repeat(self.places(part.column("id")), size).astype(np.int32), self.places(known.flatten()).astype(np.int32)
        cluster = np.repeat(part.column("cluster").to_numpy(), size)
        for c in np.unique(cluster):
            self.packed[c].append((src[cluster == c], to[cluster == c]))

    def stored(self, c: int, i: int) -> np.ndarray:
        if c not in self.ranges:
            src, to = (np.concatenate([p[n] for p in self.packed[c]] or [np.empty(0, np.int32)]) for n in (0, 1))
            self.packed[c], order = [], np.argsort(src, kind="stable")
            self.ranges[c] = np.searchsorted(src[order], np.arange(len(self.ids) + 1)), to[order]
        starts, to = self.ranges[c]
        return to[starts[i] : starts[i + 1]]

    def recall(self, c: int) -> dict[int, set[int]]:
        """A cluster's links, unpacked to be learnt on."""
        if c not in self.learnt:
            links: dict[int, set[int]] = {}
            for src, to in self.packed[c]:
                for s, t in zip(src.tolist(), to.tolist()):
                    links.setdefault(s, set()).add(t)
            self.learnt[c], self.packed[c] = links, []
        return self.learnt[c]

    def learn(self, cluster: int, rows: list[int]) -> None:
        """Links a query's nearest rows, in their order, under its cluster."""
        if not rows:
            return
        links = self.recall(cluster)
        self.link(links, self.entries[cluster], rows[0])
        for a, b in zip(rows, rows[1:]):
            self.link(links, rows[0], b)
            self.link(links, a, b)

    def link(self, links: dict[int, set[int]], a: int, b: int) -> None:
        if a != b:
            for s, t in ((a, b), (b, a)):
                own = links.setdefault(s, set())
                own.add(t)
                if len(own) > 4 * self.degree:
                    links[s] = set(prune(self.x, s, np.array(sorted(own)), self.degree)) | {t}

    def search(self, q: np.ndarray, on: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The places, the distances, and how many rows were visited."""

        class Links:
            def __getitem__(_, i):  # noqa: N805
                return np.unique(np.concatenate([self.stored(c, i) for c in on])).tolist()

        near, d, seen = walk(self.x, Links(), q, [self.entries[c] for c in on], max(ef, k), self.metric)
        return near[:k], d[:k], seen


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The stream in runs of one shard and kind."""
    for b in batches:
        s, k = b.column("shard").to_numpy(), b.column("kind").to_numpy()
        cuts = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1
        for a, z in zip([0, *cuts], [*cuts, len(s)]):
            if z > a:
                yield int(s[a]), int(k[a]), b.slice(a, z - a)


def _fitting(part: pa.RecordBatch, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The queries that have the dimension of the rows, and their vectors."""
    fits = part.filter(pc.equal(pc.list_value_length(part.column("v")), dim))
    return fits, matrix(fits.column("v")).reshape(len(fits), dim)


def _graphs(batches: Iterator[pa.RecordBatch], centres: np.ndarray, degree: int, metric: str, near: int) -> Iterator[tuple[int, Graph, pa.RecordBatch | None]]:
    """Each shard's graph with each batch of its search queries, and at its end with None; what comes before those shapes the graph."""
    now, held, graph = None, [], None

    def made() -> Graph:
        return Graph(pa.concat_arrays([p.column("id") for p in held]), np.vstack([matrix(p.column("v")) for p in held]), centres, degree, metric)

    for shard, kind, part in _runs(batches):
        if shard != now:
            if held:
                yield now, graph or made(), None
            now, held, graph = shard, [], None
        if kind == BASE:
            held.append(part)
            continue
        if not held:  # queries of a shard without rows
            continue
        graph = graph or made()
        if kind == LINK:
            graph.hold(part)
        elif kind == TRAIN:
            fits, q = _fitting(part, graph.x.shape[1])
            for c, rows in zip(fits.column("cluster").to_pylist(), graph.nearest(q, near)):
                graph.learn(c, rows)
        elif kind == TRUTH:
            known = part.column("known")
            places, size = graph.places(known.flatten()), pc.list_value_length(known).to_numpy(zero_copy_only=False)
            for c, a, n in zip(part.column("cluster").to_pylist(), np.cumsum(size) - size, size):
                graph.learn(c, [i for i in places[a : a + n].tolist() if i >= 0])
        else:
            yield shard, graph, part
    if held:
        yield now, graph or made(), None


class CrossModal:
    """The index under ``path``."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", degree: int = 40, metric: str = "l2") -> None:
        self.spark, self.path, self.id_col, self.query_id, self.vector, self.degree, self.metric = spark, path.rstrip("/"), id_col, query_id, vector, degree, metric

    @classmethod
    def build(cls, base: DataFrame, train: DataFrame, path: str, clusters: int = 20, near: int = 30, rows: int = ROWS, **settings) -> CrossModal:
        """Writes the rows by shard and the links that all training queries give."""
        out = cls(base.sparkSession, path, **settings)
        centres = kmeans(sample_matrix(train, out.query_id, out.vector, SAMPLE), clusters)
        if not len(centres):
            raise ValueError("no training query has a vector")
        out.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>").coalesce(1).write.parquet(f"{out.path}/centres")
        held = _shards(base.filter(F.col(out.vector).isNotNull()), out.id_col, rows)
        held.select("shard", F.col(out.id_col).alias("id"), V.doubles(out.vector).alias("v")).write.parquet(f"{out.path}/rows")
        out._change(out._asked(train, TRAIN), near, 0)
        return out

    def repair(self, queries: DataFrame, near: int = 100) -> None:
        """Adds the links that further queries give, every one of them."""
        last = self._last()
        self._change(self._asked(queries, TRAIN).unionByName(self._links(last), allowMissingColumns=True), near, last + 1)

    def repair_from_truth(self, truth: DataFrame, most: int = 0) -> None:
        """Adds links from known answers: rows of (a query's number, ``neighbours`` as ids of rows, nearest first), the first ``most`` of each if that is above zero.

        No query's vector is needed: its cluster is that of its first neighbour. Ids that the index doesn't hold are passed over.
        """
        known = F.slice("neighbours", 1, most) if most > 0 else F.col("neighbours")
        ids = truth.select(F.col(self.query_id).alias("asked"), F.transform(known, lambda i: i.cast(self._kind())).alias("known")).filter("size(known) > 0")
        first = self._rows().select(F.col("id").alias("first"), self._cluster("v").alias("cluster")).dropDuplicates(["first"])
        placed = ids.join(first.filter("cluster IS NOT NULL"), F.element_at("known", 1) == F.col("first")).drop("first")
        last = self._last()
        told = self._to_shards(placed.withColumn("kind", F.lit(TRUTH)))
        self._change(told.unionByName(self._links(last), allowMissingColumns=True), 1, last + 1)

    def search(self, queries: DataFrame, k: int = 10, ef: int = 100, active: int = 4) -> DataFrame:
        """(query id, id, distance, rank, visited): every shard is walked for every query, and the answers merged."""
        shared, degree, metric = self._centres(), self.degree, self.metric
        qkind = queries.schema[self.query_id].dataType.simpleString()

        def answers(batches):
            for _, graph, part in _graphs(batches, shared.value, degree, metric, 1):
                if part is None:
                    continue
                fits, q = _fitting(part, graph.x.shape[1])
                found = [graph.search(v, on, k, ef) for v, on in zip(q, graph.clusters(q)[:, :active] if len(q) else [])]
                if not found:
                    continue
                count = np.array([len(f[0]) for f in found], int)
                asked = fits.column("asked").take(pa.array(np.repeat(np.arange(len(q)), count)))
                near = graph.ids.take(pa.array(np.concatenate([f[0] for f in found]).astype(np.int64)))
                d = np.round(np.concatenate([f[1] for f in found]), DIGITS)
                seen = np.repeat(np.array([f[2] for f in found], np.int64), count)
                yield pa.RecordBatch.from_arrays([asked, near, pa.array(d), pa.array(seen, pa.int64())], ["q", "i", "d", "visited"])

        stream = self._stream(self._asked(queries, ASK).unionByName(self._links(self._last()), allowMissingColumns=True), qkind)
        found = stream.mapInArrow(answers, f"q {qkind}, i {self._kind()}, d double, visited long").select(F.col("q").alias(self.query_id), F.col("i").alias(self.id_col), F.col("d").alias("distance"), "visited")
        return _top(found, k, ["distance", self.id_col], self.query_id)

    def links(self) -> DataFrame:
        """(shard, src, dst, cluster) as they are now."""
        return self.spark.read.parquet(f"{self.path}/links-{self._last()}").select("shard", "src", F.explode("dst").alias("dst"), "cluster")

    # ------------------------------------------------------------ parts

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _kind(self) -> str:
        return self._rows().schema["id"].dataType.simpleString()

    def _last(self) -> int:
        """The number of the newest change that was written whole."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        n = 0
        while files.exists(jvm.org.apache.hadoop.fs.Path(root, f"links-{n + 1}/_SUCCESS")):
            n += 1
        return n

    def _centres(self):
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cluster").collect()  # one row a cluster
        return self.spark.sparkContext.broadcast(np.array([r.centre for r in rows]))

    def _cluster(self, column: str):
        """The nearest cluster's number, null for a vector of another dimension."""
        shared = self._centres()

        @F.pandas_udf("int")
        def nearest_cluster(v: pd.Series) -> pd.Series:
            out = pd.Series(np.full(len(v), None), dtype="Int32")
            fits = np.array([x is not None and len(x) == shared.value.shape[1] for x in v], bool)
            if fits.any():
                out[fits] = scores("l2_squared", np.vstack(v[fits].to_numpy()).astype(np.float64), shared.value).argmin(axis=1)
            return out

        return nearest_cluster(column)

    def _to_shards(self, rows: DataFrame) -> DataFrame:
        """Each row once for every shard that holds any row."""
        n = self._rows().agg(F.max("shard")).first()[0]
        return rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n or 0))))

    def _asked(self, queries: DataFrame, kind: int) -> DataFrame:
        held = queries.filter(F.col(self.vector).isNotNull()).select(F.col(self.query_id).alias("asked"), V.doubles(self.vector).alias("v"), F.lit(kind).alias("kind"))
        return self._to_shards(held.withColumn("cluster", self._cluster("v")).filter("cluster IS NOT NULL") if kind == TRAIN else held)

    def _links(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/links-{number}").select("shard", F.col("src").alias("id"), F.col("dst").alias("known"), "cluster", F.lit(LINK).alias("kind"))

    def _stream(self, rest: DataFrame, qkind: str, by_cluster: bool = False) -> DataFrame:
        """Each shard's rows, links and queries in this order, in one partition, or in one for each cluster, with the rows in all of them."""
        shards = (self._rows().agg(F.max("shard")).first()[0] or 0) + 1
        rows, task, parts = self._rows().withColumn("kind", F.lit(BASE)), F.col("shard"), shards
        if by_cluster:
            n = self.spark.read.parquet(f"{self.path}/centres").count()
            rows = rows.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            task, parts = F.col("shard") * n + F.col("cluster"), shards * n
        rows = rows.unionByName(rest, allowMissingColumns=True)
        kind = self._kind()
        types = {"shard": "int", "kind": "int", "id": kind, "v": "array<double>", "asked": qkind, "cluster": "int", "known": f"array<{kind}>"}
        full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        return full.repartitionById(parts, task.cast("int")).sortWithinPartitions("shard", "kind", "id", "asked", "cluster")

    def _change(self, rest: DataFrame, near: int, number: int) -> None:
        """Writes the links of a change. Clusters don't share links, so each cluster of a shard is a task of its own."""
        shared, degree, metric = self._centres(), self.degree, self.metric
        qkind = rest.schema["asked"].dataType.simpleString()

        def links(batches):
            for shard, graph, _ in _graphs(batches, shared.value, degree, metric, near):
                for c in range(len(graph.centres)):
                    tagged = graph.recall(c)
                    for some in batched(tagged, 10_000):
                        size = [len(tagged[s]) for s in some]
                        to = np.fromiter((j for s in some for j in sorted(tagged[s])), np.int64, sum(size))
                        dst = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), graph.ids.take(pa.array(to)))
                        fixed = [pa.array(np.full(len(some), n, np.int32)) for n in (shard, c)]
                        yield pa.RecordBatch.from_arrays([fixed[0], graph.ids.take(pa.array(some, pa.int64())), fixed[1], dst], ["shard", "src", "cluster", "dst"])

        kind = self._kind()
        self._stream(rest, qkind, True).mapInArrow(links, f"shard int, src {kind}, cluster int, dst array<{kind}>").write.mode("overwrite").parquet(f"{self.path}/links-{number}")
