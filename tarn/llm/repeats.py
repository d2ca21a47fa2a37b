"""Removal of long repeated substrings by suffix sorting.

Every 200-byte string of a text has an anchor, the place of its least hash of 48 bytes, which
depends on the string alone. Neighbouring starts with one anchor form a zone. Equal strings have equal
anchors, so only zones whose anchor hash occurs twice can hold repeats, and all their bytes are
sorted together: distinct zones, copies counted, are dealt to shards by anchor, and each shard's suffixes
are sorted by induction (see ``suffix``). A start is repeated if its zone has copies or if it shares 200 bytes
with a neighbour in suffix order.

An anchor whose variants hold more than HOT bytes, such as a passage of very many texts, isn't sorted in one task: its zones are cut
where the anchor's place in the string passes a multiple of 20, and dealt anew by the bytes that all strings of such a piece share; what
is still hot then, string by string. Equal strings meet whichever way, so this is exact, and no task has more than a shard.

Defined cases: a null or empty text has no bytes; strings overlap freely and never cross texts; repeated
rows repeat each other's strings; a long text is held whole, its hashes by pieces; of zones, which tie when they are equal, one is sorted for
all; an empty table gives an empty result; columns play no part but those named, whatever the others are called.
"""

from __future__ import annotations

import hashlib
from struct import unpack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, chunks, mix, prefix_hash, steady, written
from .suffix import ROOM, suffix_array

LENGTH = 200
ANCHOR = 48
#: Bytes of zones in a shard, about.
SHARD = 4_000_000
#: Bytes of zones of one anchor beyond which they are cut, and the widths of the cuts.
HOT = 250_000
WIDTHS = (20, 1)
#: Hot anchors that are sent to all tasks, at most (8 bytes each).
BUSY_MOST = 500_000
#: Bytes of a long text that are hashed at once.
_PIECE = 2_000_000

_powers = Powers()


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the first place of its least one."""
    n = len(h) - width + 1
    order = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # 40 bits of hash, then the place
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[: len(h)] = order
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def zones(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor hash) of a text's zones, in order."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < length:
        return none
    out = []
    width = length - anchor + 1
    for a in range(0, len(data) - length + 1, _PIECE):
        part = data[a : a + _PIECE + length - 1]
        up, down = _powers.to(len(part) + 1)
        total = prefix_hash(part, up)
        n = len(part) - anchor + 1
        h = mix((total[anchor:] - total[:n]) * down[:n])
        at = _sliding_argmin(h, width)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out.append((a + first, a + np.append(first[1:], len(at)) - 1, h[at[first]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _all_zones(batches):
    """(row, s0, s1, fp) of each zone of each text."""
    for batch in batches:
        rows, texts = np.asarray(batch.column(0)), batch.column(2).to_pylist()
        for a, b in chunks(texts, 1_000_000):
            found = [zones(np.frombuffer(_bytes(t), np.uint8)) for t in texts[a:b]]
            counts = [len(x[0]) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(rows[a:b], counts)),
                    pa.array(np.concatenate([x[0] for x in found]).astype(np.int32)),
                    pa.array(np.concatenate([x[1] for x in found]).astype(np.int32)),
                    pa.array(np.concatenate([x[2] for x in found]).view(np.int64)),
                ],
                names=["row", "s0", "s1", "fp"],
            )


def _windows(batches, length: int = LENGTH):
    """(row, s0, n, fp, h1, h2, body) of the zones of each text; body is null where the task has passed the same zone on before."""
    sent: set[bytes] = set()
    for batch in batches:
        rows, texts, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for row, text, i in zip(rows, texts, range(len(rows))):
            data = _bytes(text)
            held = lists[i].values
            out = []
            for s0, s1, fp in zip(held.field("s0").to_pylist(), held.field("s1").to_pylist(), held.field("fp").to_pylist()):
                body = data[s0 : s1 + length]
                digest = xxhash.xxh3_128_digest(body)
                h1, h2 = unpack("<qq", digest)
                out.append((row, s0, s1 - s0 + 1, fp, h1, h2, None if digest in sent else body))
                sent.add(digest)
            if len(sent) > 300_000:
                sent.clear()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])],
                    names="row s0 n fp h1 h2 body".split(),
                )


def repeated_starts(bodies: list[bytes], starts: list[int], length: int = LENGTH, room: int = ROOM) -> list[np.ndarray]:
    """For each zone a mask over its starts: whether their string starts at another place of the shard too."""
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    text = np.frombuffer(b"\xff".join([*bodies, b""]), np.uint8) + np.uint8(2)  # UTF-8 has no byte of 254 or more: 1 parts the zones
    order, shared = suffix_array(np.append(text, np.uint8(0)), length, room)
    most = shared.copy()
    most[:-1] = np.maximum(most[:-1], shared[1:])
    twice = np.zeros(len(text) + 1, bool)
    twice[order[most >= length]] = True
    begins = np.cumsum(sizes) - sizes
    return [twice[b : b + n] for b, n in zip(begins.tolist(), starts)]


def _sorted(batches, shard: int = SHARD):
    """(h1, h2, spans) of distinct zones: the runs of repeated starts, as pairs (from, to).

    The zones come sorted by anchor. A task's zones are taken a shard at a time, cut only
    between two anchors: equal strings have one anchor.
    """

    def done(keys, counts, bodies, starts):
        masks = repeated_starts(bodies, starts)
        first, second, spans = [], [], []
        for (h1, h2), count, mask in zip(keys, counts, masks):
            if count > 1:
                mask = np.ones(len(mask), bool)
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            if len(edges):
                first.append(h1), second.append(h2), spans.append(edges.tolist())
        return pa.RecordBatch.from_arrays(
            [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["h1", "h2", "spans"]
        )

    keys, counts, bodies, starts, size, last = [], [], [], [], 0, None
    for batch in batches:
        fps, h1, h2, copies, n, body = (batch.column(i).to_pylist() for i in range(6))
        for fp, a, b, c, k, x in zip(fps, h1, h2, copies, n, body):
            if size > shard and fp != last:
                yield done(keys, counts, bodies, starts)
                keys, counts, bodies, starts, size = [], [], [], [], 0
            keys.append((a, b)), counts.append(c), bodies.append(x), starts.append(k)
            size, last = size + len(x) + 1, fp
    if keys:
        yield done(keys, counts, bodies, starts)


def _cut(batches, width: int, length: int = LENGTH, anchor: int = ANCHOR):
    """(fp, anchor, o1, o2, a, n, h1, h2, body): pieces of zones (anchor, fp, h1, h2, body), cut by the place of the anchor in the string; fp: what the strings of a piece share."""
    for batch in batches:
        out = []
        for mark, fp, o1, o2, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
            data = np.frombuffer(body, np.uint8)
            up, down = _powers.to(len(data) + 1)
            total = prefix_hash(data, up)
            h = mix((total[anchor:] - total[: len(data) - anchor + 1]) * down[: len(data) - anchor + 1])
            place = int(np.flatnonzero(h == np.array(mark, np.int64).view(np.uint64))[0])  # the first is the anchor of every start
            starts = len(data) - length + 1
            block = (place - np.arange(starts)) // width
            edges = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1 if starts else 0))
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                part = body[a : b - 1 + length]
                # all strings of the block, whether this piece has them or not, hold these bytes around the anchor
                low = place - (int(block[a]) * width)
                common = body[max(low, 0) : min(low - width + 1 + length, len(body))] if width > 1 else part
                key = xxhash.xxh3_64_intdigest(common, (fp ^ int(block[a])) & (2**64 - 1))
                h1, h2 = unpack("<qq", xxhash.xxh3_128_digest(part))
                out.append((key - (1 << 64) if key >> 63 else key, mark, o1, o2, a, b - a, h1, h2, part))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names="fp anchor o1 o2 a n h1 h2 body".split())


def repeated_runs(zones_: DataFrame, hot: int = HOT, shard: int = SHARD, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(h1, h2, spans): the runs of repeated starts of each distinct zone; ``zones_``: (anchor, fp, h1, h2, n, body), a row for each place, body null where another row of the zone has it."""
    spark = zones_.sparkSession
    key = ["anchor", "fp", "h1", "h2"]
    sizes = zones_.groupBy(*key).agg((F.first("n") + LENGTH).alias("bytes")).groupBy("fp").agg(F.sum("bytes").alias("bytes"))
    sizes = written(sizes, "sizes")
    busy = sizes.filter(F.col("bytes") > hot).select("fp")
    count = busy.count() if widths else 0
    split = count > 0
    distinct = lambda df: df.groupBy(*key).agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("body", ignorenulls=True).alias("body"))
    # few hot anchors are known to all tasks; else the zones are added up before the join, so that copies of a hot one never meet in it
    few = count <= BUSY_MOST
    pick = lambda how: distinct(zones_.join(F.broadcast(busy), "fp", how)) if few else distinct(zones_).join(busy, "fp", how)
    # shards by hash of anchors, of bounded bytes each
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // shard)
    calm = pick("left_anti") if split else distinct(zones_)
    dealt = calm.repartition(parts, "fp").sortWithinPartitions("fp")
    runs = dealt.select("fp", "h1", "h2", "copies", "n", "body").mapInArrow(_sorted, "h1 bigint, h2 bigint, spans array<int>")
    if not split:
        return runs
    own = written(pick("left_semi"), "hot")
    fields = "fp bigint, anchor bigint, o1 bigint, o2 bigint, a int, n int, h1 bigint, h2 bigint, body binary"
    width = widths[0]
    cut = written(own.select("anchor", "fp", "h1", "h2", "body").mapInArrow(lambda b: _cut(b, width), fields), "pieces")
    twice = written(cut.groupBy("fp").count().filter("count > 1").select("fp"), "twice")
    inner = written(repeated_runs(cut.join(twice, "fp", "left_semi").select("anchor", "fp", "h1", "h2", "n", "body"), hot, shard, widths[1:]), "inner")
    moved = cut.select("o1", "o2", "a", "h1", "h2").join(inner, ["h1", "h2"]).select(F.col("o1").alias("h1"), F.col("o2").alias("h2"), F.transform("spans", lambda x: x + F.col("a")).alias("spans"))
    single = own.filter("copies = 1").select("h1", "h2").join(moved, ["h1", "h2"]).groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    several = own.filter("copies > 1").select("h1", "h2", F.array(F.lit(0), F.col("n")).alias("spans"))
    return runs.unionByName(single).unionByName(several)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``.

    The texts are read more than once under one numbering: what isn't a plain reading of files is written first.
    """
    source = steady(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "input")
    picked = source.select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce("text", F.lit("")).alias("text"))
    every = written(picked.mapInArrow(_all_zones, "row bigint, s0 int, s1 int, fp bigint"), "zones")
    # written, so that both sides of the join are exchanges and a hot anchor's partition can be split
    twice = written(every.groupBy("fp").count().filter("count > 1").select("fp"), "twice")
    by_row = every.join(twice, "fp", "left_semi").groupBy("row").agg(F.collect_list(F.struct("s0", "s1", "fp")).alias("zones"))
    some = written(picked.select("row", "text").join(by_row, "row"), "texts")
    found = written(some.mapInArrow(_windows, "row bigint, s0 int, n int, fp bigint, h1 bigint, h2 bigint, body binary"), "windows")
    runs = written(repeated_runs(found.select(F.col("fp").alias("anchor"), "fp", "h1", "h2", "n", "body"), hot), "runs")
    cuts = (
        found.select("row", "s0", "h1", "h2")
        .join(runs, ["h1", "h2"])
        .select("row", F.struct("s0", "spans").alias("cut"))
        .groupBy("row")
        .agg(F.collect_list("cut").alias("cuts"))
    )

    def run(batches):
        for batch in batches:
            rows, texts, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out = []
            for i, row in enumerate(rows):
                data = _bytes(texts[i])
                edge = np.zeros(len(data) + 1, np.int64)
                held = lists[i].values
                spans = held.field("spans")
                base = np.repeat(np.asarray(held.field("s0")), np.asarray(spans.value_lengths()))
                places = base.astype(np.int64) + np.asarray(spans.flatten())
                np.add.at(edge, places[::2], 1)
                np.add.at(edge, places[1::2] - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                runs_ = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((row, int(gone.sum()), runs_, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["row", "n_removed", "n_spans", "sha"])

    changed = some.select("row", "text").join(cuts, "row").mapInArrow(run, "row bigint, n_removed bigint, n_spans bigint, sha string")
    whole = picked.select(
        "row", "id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole")
    )
    zero = F.lit(0).cast("bigint")
    return whole.join(changed, "row", "left").select(
        "id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what repeated strings of 200 bytes leave of every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
