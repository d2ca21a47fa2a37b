"""What the operators share: written intermediate tables, row ids, word hashes, components.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which all
machines of a cluster share; a machine-local folder serves only where it is unset on one machine (tests).
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

_left: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: its folder goes with the cluster's clean-up
        pass


@atexit.register
def _clean() -> None:
    while _left:
        _remove(*_left.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and returns a reader of it: lineage ends here, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _left.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tarn_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table of ``written`` that nothing will read again."""
    path = getattr(df, "_tarn_path", None)
    if path:
        _remove(df.sparkSession, path)
        _left[:] = [x for x in _left if x[1] != path]


def steady(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it only reads files, so that its rows come in the same order each time; else a written copy."""
    nodes = [line.lstrip(" :+-").split("[")[0].split("(")[0].split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return df if {x for x in nodes if x} <= {"Project", "Filter", "Relation", "RelationV2"} else written(df, name)


def id_text(column: str):
    """doc_id as text, the empty string for null: the input of the crc32 folds."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, mod: int):
    """crc32(doc_id as text) mod ``mod``."""
    return F.crc32(id_text(column).cast("binary")) % mod


# ---------------------------------------------------------------- words of many texts at once

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 6364136223846793005
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base and of its inverse, wrapping at 64 bits."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX)


class Powers:
    """Grows the tables of powers to the longest text met."""

    def __init__(self) -> None:
        self.up, self.down = powers(1 << 16)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(1 << (n - 1).bit_length())
        return self.up, self.down


def prefix_hash(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] times the inverse power of i: the hash of bytes i to j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values[data] * up[: len(data)], out=out[1:])
    return out


def chunks(texts: list, size: int):
    """Slices (from, to) of a batch of about ``size`` characters each; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an undirected edge list.

    Alternating large-star and small-star rounds; each round is a few shuffles of the edge
    list and the list only shrinks in distinct (node, smaller node) pairs. A hub is aggregated
    by map-side minimum and its links re-enter a join that adaptive execution may split.
    """
    spark = edges.sparkSession
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    seen = None
    while True:
        # large star: every larger neighbour of u is linked to the least neighbour of u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            now.select(F.col("v").alias("u"), F.col("u").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        # small star: u and its smaller neighbours are linked to the least of these
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        new = written(small, "small")
        discard(large)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if tuple(state) == seen:
            break
        seen = tuple(state)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots)
