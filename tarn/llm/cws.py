"""Document fingerprints by consistent weighted sampling.

Every word of a text is a term weighted by its count. For sample k a term draws, from a hash of
the word and k alone, r and c from Gamma(2, 1) and b from the unit interval; with
t = floor(ln w / r + b) its key is ln c - r (t - b + 1), and the term of the least key, with
its t, is the sample. Two texts agree in a sample with the probability of the generalised Jaccard
similarity of their weights. A fingerprint holds 16 bits of each sample in hexadecimal digits.

A worker keeps the draws of at most ROOM words, whatever a text holds; a text's words and counts are held whole.

Defined cases: a null or empty text, and one of white space alone, has the fingerprint of all
zeros, alike (1) only to another such; equal texts have equal fingerprints; rows with
equal ids follow each other by text; null ids come first; words whose keys tie give way to the first of the text; an empty table gives an empty result; a table
of one row is its own next; ids are numbers, or texts that are, and columns play no part but those named.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MIX, chunks, mix

SAMPLES = 64
SEED = 42
#: Words whose draws a worker keeps; beyond, it starts anew.
ROOM = 60_000
#: Rows of a task, about.
ROWS = 20_000


def draws(seeds: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b for each word (by its hash) and sample: from the halves of three mixed numbers."""
    steps = (np.arange(3 * samples, dtype=np.uint64) + np.uint64(1)) * _MIX
    halves = mix(seeds[:, None] + steps).view(np.uint32).reshape(len(seeds), 3, samples, 2)
    u = (halves.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
    np.minimum(u, np.float32(1 - 2.0**-24), out=u)
    r = -np.log(u[:, 0, :, 0] * u[:, 0, :, 1])
    log_c = np.log(-np.log(u[:, 1, :, 0] * u[:, 1, :, 1]))
    return r, log_c, u[:, 2, :, 0]


class Sampler:
    """Fingerprints of texts; keeps the draws of the words met last."""

    def __init__(self, samples: int = SAMPLES, room: int = ROOM) -> None:
        self.samples, self.room = samples, room
        self._forget(room)

    def _forget(self, room: int) -> None:
        self.at: dict[bytes, int] = {}
        self.uses = np.zeros(room, np.int32)
        self.seeds = np.empty(room, np.uint64)
        self.r, self.log_c, self.b, self.once = (np.empty((room, self.samples), np.float32) for _ in range(4))

    def learn(self, words) -> None:
        """Makes draws for the words that have none, of which there is room for."""
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.room:
            self._keep_used()
            new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.room:
            self._forget(self.room)
            new = list(islice(words, self.room))
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            a = len(self.at)
            seeds = np.array([xxhash.xxh64_intdigest(w, SEED) for w in part], np.uint64)
            r, log_c, b = draws(seeds, self.samples)
            z = slice(a, a + len(part))
            self.seeds[z], self.r[z], self.log_c[z], self.b[z], self.once[z] = seeds, r, log_c, b, log_c - r * (1 - b)
            self.at.update(zip(part, range(a, a + len(part))))

    def _keep_used(self) -> None:
        """Keeps the third of the words that most texts had."""
        names = list(self.at)
        keep = np.sort(np.argsort(-self.uses[: len(names)], kind="stable")[: self.room // 3])
        for held in (self.seeds, self.r, self.log_c, self.b, self.once):
            held[: len(keep)] = held[keep]
        self.uses[: len(keep)] = self.uses[keep] // 2
        self.uses[len(keep) :] = 0
        self.at = {names[i]: j for j, i in enumerate(keep.tolist())}

    def sample(self, counts: Counter) -> np.ndarray:
        """16 bits of each sample. Words are taken in slices of what there is room for, so memory doesn't follow the words of one text."""
        if not counts:
            return np.zeros(self.samples, np.uint16)
        least, code = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64)
        each = iter(counts.items())
        while part := dict(islice(each, self.room)):
            if not part.keys() <= self.at.keys():
                self.learn(part)
            keys, codes = self._best(part)
            better = keys < least
            least, code = np.where(better, keys, least), np.where(better, codes, code)
        return np.maximum(code >> np.uint64(48), np.uint64(1)).astype(np.uint16)

    def _best(self, counts: dict) -> tuple[np.ndarray, np.ndarray]:
        """The least key of each sample and the hash of its word and level; the words must have been learnt."""
        rows = np.fromiter(map(self.at.__getitem__, counts), np.int64, len(counts))
        self.uses[rows] += 1
        weights = np.fromiter(counts.values(), np.int64, len(counts))
        keys, t = self.once[rows], None
        more = np.flatnonzero(weights > 1)
        if len(more):
            at = rows[more]
            r, b = self.r[at], self.b[at]
            t = np.floor(np.log(weights[more].astype(np.float32))[:, None] / r + b)
            keys[more] = self.log_c[at] - r * (t + 1 - b)
        best = keys.argmin(axis=0)
        level = np.zeros(self.samples, np.int64)
        if t is not None:
            place = np.full(len(rows), -1)
            place[more] = np.arange(len(more))
            of = place[best]
            several = of >= 0
            level[several] = t[of[several], np.flatnonzero(several)].astype(np.int64)
        return keys[best, np.arange(self.samples)], mix(self.seeds[rows[best]] ^ (level + 1).astype(np.uint64) * _MIX)


def count_words(text: str) -> Counter:
    return Counter(text.encode("utf-8", "surrogatepass").lower().split())


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples that agree."""
    return float(np.mean(a == b))


def in_order(docs: DataFrame, id_col: str, text_col: str, rows: int = ROWS) -> DataFrame:
    """(id, text, copy): tasks of rows by ascending id; behind its own rows each task has copies of those next in order.

    The bounds of the tasks are approximate quantiles of the ids, so their number and the
    list of each task's least id are bounded by the number of tasks.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    picked = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    keyed = picked.withColumn("place", F.col("key").cast("double"))
    n = picked.count()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows)))
    cuts = keyed.approxQuantile("place", [i / tasks for i in range(1, tasks)], 0.25 / tasks) if n and tasks > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(keyed)
    else:
        cut = keyed.withColumn("bucket", F.lit(0))
    cut = cut.withColumn("bucket", F.col("bucket").cast("int")).drop("place")
    heads = sorted((r.bucket, r.least) for r in cut.groupBy("bucket").agg(F.min("key").alias("least")).collect())
    targets = [(least, heads[i - 1][0]) for i, (_, least) in enumerate(heads)]
    before = spark.createDataFrame(targets, "least bigint, target int")
    both = cut.join(F.broadcast(before), F.col("key") == F.col("least"), "left").select(
        "id",
        "key",
        "text",
        F.explode(
            F.when(F.col("target").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("copy")))).otherwise(
                F.array(
                    F.struct(F.col("bucket").alias("b"), F.lit(0).alias("copy")),
                    F.struct(F.col("target").alias("b"), F.lit(1).alias("copy")),
                )
            )
        ).alias("to"),
    )
    dealt = both.select("id", "key", "text", "to.b", "to.copy").repartitionById(len(splits) - 1, F.col("b"))
    return dealt.sortWithinPartitions("b", "copy", "key", "text").select("id", "text", "copy")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and its likeness to the edited and the next text."""
    ordered = in_order(docs, id_col, text_col)
    kind = ordered.schema["id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            ids, texts, copies = (batch.column(i).to_pylist() for i in range(3))
            for a, b in chunks(texts, 400_000):
                yield ids[a:b], texts[a:b], copies[a:b]

    def run(batches):
        sampler, held = Sampler(samples), None  # held: the row whose next is still to come
        for ids, texts, copies in rows(batches):
            counts = [count_words(x) for x in texts]
            chain = ([held] if held else []) + list(zip(ids, texts, copies, counts))
            pairs = [(x, y) for x, y in zip(chain, chain[1:]) if not x[2]]
            held = chain[-1]
            changed = [edited(x[1], y[1]) for x, y in pairs]
            changed_counts = [count_words(x) for x in changed]
            sampler.learn(dict.fromkeys(w for c in [*(x[3] for x in chain), *changed_counts] for w in c))
            prints = {id(x): sampler.sample(x[3]) for x in chain}
            out = []
            for (x, y), text, c in zip(pairs, changed, changed_counts):
                own, new, after = prints[id(x)], sampler.sample(c), prints[id(y)]
                sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((x[0], len(x[1]), sha, own.tobytes().hex(), new.tobytes().hex(), likeness(own, new), likeness(own, after)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    names = "id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    return ordered.mapInArrow(
        run,
        f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprints of every document and its edited text."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
