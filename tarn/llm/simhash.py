"""SimHash near-duplicate detection by pigeonhole blocks.

Each text gets one 64-bit fingerprint. A fingerprint is cut into m blocks; two fingerprints
that differ in at most r bits agree on at least m - r whole blocks, so a join on every
choice of m - r blocks meets every close pair. m follows from the number of distinct
fingerprints so that a key has some bits more than that number needs: chance meetings stay few
at any size, and no pair is lost. Within a block the Hamming distance is verified.

For similarity of 0.8 over five-word shingles 64 bits won't do: such texts differ in 10 of them on average, which leaves no
selective blocks. ``near_texts`` therefore takes 512 bits, in which 0.8 is a difference of 78 on average, and splits
the shingles, not the bits: by hash into more parts than two such texts have shingles unlike, so that some parts agree whole (pigeonhole); each
part's digest is a block. Of the parts the first BLOCKS serve: each of them agrees and isn't empty with probability 0.3 or more,
so a pair at 0.8 shares none once in 100,000 cases. Pairs that share a block are verified by the Hamming distance of their 512 bits.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other;
repeated rows share a fingerprint; rows with a null id keep their row and count for no smallest
id; of rows with the smallest id of a group one stays, the one least by a hash of all its columns; a long text is held whole, with some numbers a word; an empty
table gives an empty result. Columns other than the id and the text play no part, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MIX, chunks, components, mix, steady, written

SEED = 42
MAX_BITS = 3
WORDS = 3
#: Fingerprints of one block that a task compares at once; a block with more is dealt out as pairs of tiles.
TILE = 8192
_FLUSH = 200_000


def _shingle_hashes(text: str | None, width: int):
    """Lists of shingle hashes of one text, a bounded number at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line = b" ".join(words)
    if len(words) < width:
        yield [xxhash.xxh64_intdigest(line, SEED)]
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _FLUSH):
        yield [digest(line[s:e], SEED) for s, e in zip(starts[i : i + _FLUSH].tolist(), ends[i : i + _FLUSH].tolist())]


def fingerprint_texts(texts: list, width: int = WORDS) -> np.ndarray:
    """The fingerprints of ``texts``, unsigned."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.array(held, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            np.add.at(ones, owners, sums)
            np.add.at(total, owners, sizes)
        held.clear(), owners.clear(), sizes.clear()

    for i, text in enumerate(texts):
        for hashes in _shingle_hashes(text, width):
            held.extend(hashes)
            owners.append(i)
            sizes.append(len(hashes))
            if len(held) >= _FLUSH:
                flush()
    flush()
    most = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """(id, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in chunks(texts.to_pylist(), 2_000_000):
                fp = fingerprint_texts(texts[a:b].to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(fp)], ["id", "fp"])

    return picked.mapInArrow(run, f"id {kind}, fp bigint")


def block_masks(distinct: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of the choices of blocks, as signed longs; every pair within ``max_bits`` agrees under one of them."""
    wanted, m = log2(max(distinct, 2)) + 4, max_bits + 1
    while m < 16 and 64 * (m - max_bits) // m < wanted:
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(x) for x in combinations(blocks, m - max_bits)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def spanning_links(values: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``max_bits``: it joins what all these pairs join."""
    left, a, b = np.unique(values), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue[-1]) <= max_bits
            at = queue.pop()
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), at, np.uint64))
                b.append(found)
                queue.extend(found)
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def close_links(distinct_fp: DataFrame, count: int, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within ``max_bits``."""
    masks = block_masks(count, max_bits)
    keyed = distinct_fp.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).cast("smallint").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
        ).alias("key"),
    ).select("fp", "key.c", "key.k")
    # written, so that both sides of the join are exchanges and a hot block's partition can be split
    many = written(keyed.groupBy("c", "k").count().filter("count > 1"), "blocks")
    # a block of more than `tile` fingerprints: its chunks meet in pairs, each pair in a group of its own
    dealt = (
        keyed.join(many, ["c", "k"])
        .withColumn("n", F.ceil(F.col("count") / tile).cast("int"))
        .withColumn("i", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int"))
        .withColumn(
            "t",
            F.explode(
                F.expr("transform(sequence(0, n - 1), j -> if(j < i, struct(j AS x, i AS y), struct(i AS x, j AS y)))")
            ),
        )
    )
    groups = dealt.groupBy("c", "k", "t").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            for i in range(len(column)):
                a, b = spanning_links(np.asarray(column[i].values).view(np.uint64), max_bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return groups.mapInArrow(run, "a bigint, b bigint")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, width: int = WORDS
) -> DataFrame:
    """(id, fp, component): the smallest id among all rows that a chain of close fingerprints reaches."""
    prints = written(fingerprints(docs, id_col, text_col, width), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    links = close_links(classes.select("fp"), classes.count(), max_bits)
    roots = components(links)
    placed = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(lowest, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


# ---------------------------------------------------------------- similarity of 0.8 over five words

PRINT_WORDS = 5
SIMILAR = 0.8
PRINT_BITS = 512
#: Differing bits of 512 up to which texts are near: at a similarity of 0.8 on average 78, with a deviation of 8; at 0.6 118.
PRINT_NEAR = 94
#: Words of 64 rows' bits that are sent to all workers: about 48 bytes each, 128 million rows in all.
WORDS_HELD = 2_000_000
#: Blocks of one text at one number of parts.
BLOCKS = 32
_SALTS = mix((np.arange(PRINT_BITS // 64, dtype=np.uint64) + np.uint64(1)) * _MIX)
_PART_SALT, _BLOCK_SALT = mix(np.array([77, 78], np.uint64) * _MIX)


def _levels(n: int) -> tuple[int, ...]:
    """Logarithms of the numbers of parts for ``n`` shingles: more parts than it and the larger of a similar pair may have unlike."""
    unlike = 2 * (1 - SIMILAR) / (1 + SIMILAR)
    return tuple(sorted({int(np.ceil(np.log2(unlike * m + 1))) for m in (n, n / SIMILAR)}))


def long_print(text: str | None, width: int = PRINT_WORDS) -> tuple[int, bytes, int, list[int]]:
    """(distinct shingles, 512 bits, digest of the whole, blocks) of a text."""
    found = list(_shingle_hashes(text, width))
    if not found:
        return 0, bytes(PRINT_BITS // 8), 0, [0]
    h = np.unique(np.concatenate([np.array(x, np.uint64) for x in found]))
    ones = np.zeros(PRINT_BITS, np.int64)
    for i in range(0, len(h), 20_000):
        some = mix(h[i : i + 20_000, None] ^ _SALTS)
        ones += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    spread = mix(h + _PART_SALT)
    digests = mix(h ^ _BLOCK_SALT)
    blocks = []
    for level in _levels(len(h)):
        part = spread >> np.uint64(64 - level) if level else np.zeros(len(h), np.uint64)
        low = part < BLOCKS
        of, first = np.unique(part[low], return_index=True)  # the parts of sorted hashes aren't sorted
        total = np.zeros(BLOCKS, np.uint64)
        np.add.at(total, part[low].astype(np.int64), digests[low])
        blocks += mix(total[of.astype(np.int64)] + (of + np.uint64(64 * level + 1)) * _MIX).tolist()
    return len(h), np.packbits(2 * ones > len(h), bitorder="little").tobytes(), int(digests.sum(dtype=np.uint64)), blocks


def _long_prints(rows: DataFrame) -> DataFrame:
    """(row, id, n, whole, print, blocks) of (row, id, text)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts, 2_000_000):
                n, bits, whole, blocks = zip(*(long_print(x) for x in texts[a:b]))
                signed = lambda x: np.array(x, np.uint64).view(np.int64)
                data = [pa.array(n, pa.int64()), pa.array(signed(whole)), pa.array(bits, pa.binary()), pa.array([signed(x) for x in blocks], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *data], names=["row", "id", "n", "whole", "print", "blocks"])

    return rows.mapInArrow(run, f"row bigint, id {kind}, n bigint, whole bigint, print binary, blocks array<bigint>")


def spanning_rows(prints: np.ndarray, sizes: np.ndarray, most: int = PRINT_NEAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of near prints (rows of 64-bit numbers) of like sizes."""
    left, links = np.arange(len(prints)), []
    least = SIMILAR * 0.95  # as much slack as the distance has
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            like = np.minimum(sizes[left], sizes[at]) >= least * np.maximum(sizes[left], sizes[at])
            near = like & (np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1, dtype=np.int64) <= most)
            if near.any():
                found = left[near]
                left = left[~near]
                links += [(at, int(x)) for x in found]
                queue.extend(found.tolist())
    return links


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(row, id, group): groups of texts that a chain of pairs of similarity 0.8 or more over five-word shingles joins; row as ``numbered`` gives it."""
    rows = numbered(docs).select("row", F.col(f"kept.`{id_col}`").alias("id"), F.col(f"kept.`{text_col}`").cast("string").alias("text"))
    prints = written(_long_prints(rows), "prints")
    # texts of the same shingles are one class, by its least row; only classes are compared
    same = ["n", "whole", "print"]
    classes = written(prints.groupBy(*same).agg(F.min("row").alias("class"), F.first("blocks").alias("blocks")), "classes")
    # blocks travel alone; only those of several classes are given their prints. Sorted joins at every size: the blocks grow with the texts
    keyed = classes.select("class", F.explode("blocks").alias("k"))
    many = written(keyed.groupBy("k").count().filter("count > 1"), "blocks")
    shared = keyed.join(many.hint("merge"), "k")
    dealt = (
        shared.join(classes.select("class", "n", "print").hint("merge"), "class")
        .withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
        .withColumn("i", F.pmod(F.xxhash64("class", F.lit(7)), F.col("tiles")).cast("int"))
        .withColumn("t", F.explode(F.expr("transform(sequence(0, tiles - 1), j -> if(j < i, struct(j AS x, i AS y), struct(i AS x, j AS y)))")))
    )
    met = dealt.groupBy("k", "t").agg(F.collect_list(F.struct("class", "n", "print")).alias("m")).filter("size(m) > 1").select("m")

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            for i in range(len(column)):
                held = column[i].values
                ids = np.asarray(held.field("class"))
                order = np.argsort(ids)  # so that the links are the same whenever a task runs again
                bits = np.frombuffer(b"".join(held.field("print").to_pylist()), np.uint64).reshape(len(ids), -1)[order]
                links = spanning_rows(bits, np.asarray(held.field("n"))[order])
                if links:
                    a, b = (ids[order][list(x)] for x in zip(*links))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    roots = components(met.mapInArrow(run, "a bigint, b bigint"))
    placed = classes.join(roots, F.col("class") == F.col("node"), "left").select(*same, F.coalesce("component", "class").alias("group"))
    return prints.join(placed, same).select("row", "id", "group")


def numbered(docs: DataFrame) -> DataFrame:
    """(row, kept): the rows of ``docs``, which must come in the same order each time, numbered."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of ``near_texts``, that of the smallest id.

    Rows with a null id stay, as no id names them. Of several rows with the group's smallest id
    the first by row number stays; rows of one id in different groups are judged each for itself.
    """
    source = steady(docs, "input")
    # a row without an id is a group of its own
    alone = F.when(F.col("id").isNull(), F.col("row")).alias("alone")
    firsts = near_texts(source, id_col, text_col).groupBy("group", alone).agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
    return keep_rows(source, firsts)


def keep_rows(source: DataFrame, rows: DataFrame, most: int = WORDS_HELD) -> DataFrame:
    """The rows of ``source`` whose numbers, as ``numbered`` gives them, are in ``rows``.

    The numbers travel as words of 64 rows' bits. Up to ``most`` words, 100 MB, go to all workers, so that the
    texts stay where they are; beyond that both sides are sorted by word.
    """
    bit = F.expr("shiftleft(1L, CAST(row & 63 AS INT))")
    words = written(rows.groupBy(F.expr("row >> 6").alias("word")).agg(F.bit_or(bit).alias("bits")), "words")
    held = words.hint("broadcast" if words.count() <= most else "merge")
    kept = numbered(source).withColumn("word", F.expr("row >> 6")).join(held, "word").filter("getbit(bits, CAST(row & 63 AS INT)) = 1")
    return kept.select(*[F.col(f"kept.`{c}`").alias(c) for c in source.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document's fingerprint and the smallest doc_id of its group."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
