"""Benchmark decontamination: rare n-gram seeds, then local alignment.

The n-grams of the test items are counted over the training texts; each item is seeded by its
rarer ones, weighted by rarity (the logarithm of texts over texts that hold it, always above zero, so a
passage that very many texts share still seeds). Seeds join texts to items on their diagonals: a band of
a text whose distinct seeds reach a share of the item's weight is aligned with the item by
Smith-Waterman over words, which scores copies that were edited or paraphrased too.

The items are taken in blocks of bounded size, each held by every worker; the texts are only ever
scanned, never shuffled.

An alignment scores 2 for a like word and -1 for an unlike, dropped or added one; SCORE is the least share of an item's own score that is reported. A share x of
words replaced leaves 1 - 1.5 x: items with up to a third of their words replaced reach the limit of 0.5, beyond that they count as texts of their own.

Defined cases: null and empty texts match nothing; an item without words matches nothing, one of fewer
words than a seed is seeded by all its words at once; repeated items and repeated rows are reported each for
itself; a text shows each item once, at its best place, the first of equals; a long text is held whole, with some numbers a word; empty tables give an
empty result; columns play no part but those named, whatever the others are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Powers, chunks, mix, prefix_hash

SEED_WORDS = 3
#: Items' characters that a worker holds at once.
BLOCK_CHARS = 8_000_000
#: The share of an item's n-grams, from the rarest, that seed it; the share of their weight that a band must reach.
RARE, REACHED = 0.75, 0.1
#: Least alignment score, as a share of the item's own with itself.
SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
_JOIN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers = Powers()


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text of each word): runs of letters, digits and characters beyond ASCII, in lower case."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raw])
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = _is_word[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, stops = edges[::2], edges[1::2]  # the last byte is a separator
    up, down = _powers.to(len(data) + 1)
    total = prefix_hash(data, up)
    return mix((total[stops] - total[starts]) * down[starts]), np.searchsorted(ends, starts, side="right")


def grams_of(words: np.ndarray, of: np.ndarray, n: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, its first word); none crosses two texts."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
    h = words[at] * _JOIN[0]
    for i in range(1, n):
        h = mix(h + words[at + i] * _JOIN[i % 3])
    return h, at


class Items:
    """A block of test items: their words and the n-grams that may seed them."""

    def __init__(self, ids: list, texts: list) -> None:
        self.ids = ids
        words, of = words_of(texts)
        cuts = np.searchsorted(of, np.arange(len(ids) + 1))
        self.words = [words[a:b] for a, b in zip(cuts, cuts[1:])]
        self.short = {}  # length -> items of fewer words than a seed
        g, at = grams_of(words, of)
        item, place = of[at], at - cuts[of[at]]
        for i, w in enumerate(self.words):
            if 0 < len(w) < SEED_WORDS:
                self.short.setdefault(len(w), []).append(i)
                h, _ = grams_of(w, np.zeros(len(w), np.int64), len(w))
                g, item, place = np.append(g, h), np.append(item, i), np.append(place, 0)
        self.grams, self.gram = np.unique(g, return_inverse=True)
        self.item, self.place = item, place
        self._table()

    def _table(self) -> None:
        bits = max(16, int(len(self.grams)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.grams >> self.shift).astype(np.int64)] = True

    def find(self, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram's number, first word) of the block's n-grams in some texts."""
        found = []
        for n in [SEED_WORDS, *self.short]:
            h, at = grams_of(words, of, n)
            likely = np.flatnonzero(self.maybe[(h >> self.shift).astype(np.int64)])
            h, at = h[likely], at[likely]
            number = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            same = self.grams[number] == h
            found.append((number[same], at[same]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def weigh(self, texts: int, held: np.ndarray) -> None:
        """Chooses the seeds, given in how many texts each n-gram occurs."""
        weight = np.log1p(texts / np.maximum(held, 1))
        keep = np.zeros(len(self.item), bool)
        self.mass = np.zeros(len(self.ids))
        order = np.lexsort((held[self.gram], self.item))
        cuts = np.searchsorted(self.item[order], np.arange(len(self.ids) + 1))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own = order[a:b]
            if len(own):
                counts = held[self.gram[own]]
                seeds = own[counts <= counts[int(np.ceil(RARE * len(own))) - 1]]  # ties with the last stay
                keep[seeds] = True
                self.mass[i] = weight[np.unique(self.gram[seeds])].sum()
        kept = np.flatnonzero(keep)
        kept = kept[np.argsort(self.gram[kept], kind="stable")]
        self.weight = weight
        self.seed_item, self.seed_place = self.item[kept], self.place[kept]
        self.first = np.searchsorted(self.gram[kept], np.arange(len(self.grams) + 1))


def align_many(a: np.ndarray, regions: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Smith-Waterman of one word sequence with several, all at once: of each the best score, and from where to where it lies there (end exclusive)."""
    count, n = len(regions), max(map(len, regions))
    b, inside = np.zeros((count, n), np.uint64), np.zeros((count, n), bool)
    for i, x in enumerate(regions):
        b[i, : len(x)], inside[i, : len(x)] = x, True
    steps = np.arange(n + 1, dtype=np.int32)
    row = np.zeros((count, n + 1), np.int32)
    begin = np.broadcast_to(steps, row.shape).copy()
    best, low, high = (np.zeros(count, np.int32) for _ in range(3))
    every = np.arange(count)
    for x in a:
        cell = np.zeros_like(row)
        source = np.broadcast_to(steps, row.shape).copy()
        diagonal = row[:, :-1] + np.where((b == x) & inside, np.int32(MATCH), np.int32(MISMATCH))
        above = row[:, 1:] + np.int32(GAP)
        cell[:, 1:] = np.maximum(np.maximum(diagonal, above), 0)
        source[:, 1:] = np.where(cell[:, 1:] == 0, steps[1:], np.where(diagonal >= above, begin[:, :-1], begin[:, 1:]))
        # gaps along b: the best earlier cell less the steps from it
        lifted = cell - GAP * steps
        top = np.maximum.accumulate(lifted, axis=1)
        new = top + GAP * steps
        at = np.maximum.accumulate(np.where(lifted == top, steps, 0), axis=1)
        begin = np.where(new > cell, np.take_along_axis(source, at, 1), source)
        row = np.maximum(new, cell)
        j = row.argmax(axis=1).astype(np.int32)
        score = row[every, j]
        better = score > best
        best, low, high = np.where(better, score, best), np.where(better, begin[every, j], low), np.where(better, j, high)
    return list(zip(best.tolist(), low.tolist(), high.tolist()))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of two word sequences: the best score, and from where to where it lies in ``b`` (end exclusive)."""
    return align_many(a, [b])[0]


#: Seeds met that are looked at at once, and cells of the alignments made at once.
HITS, CELLS = 2_000_000, 1_000_000


def _bands(items: Items, words: np.ndarray, of: np.ndarray, cuts: np.ndarray):
    """(text, item, band, weight reached) of the bands of diagonals whose seeds reach enough."""
    number, at = items.find(words, of)
    many = items.first[number + 1] - items.first[number]
    size = np.array([len(w) for w in items.words], np.int64)
    met = []
    # seeds that many items share give many hits: they are taken in slices, of which only distinct (text, item, band, n-gram) are kept
    edges = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + 1, HITS), side="left") if len(many) else []
    for a, b in zip(edges, [*edges[1:], len(number)]):
        own = many[a:b]
        hit = np.repeat(np.arange(a, b), own)
        if not len(hit):
            continue
        seed = items.first[number[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(own) - own, own)
        item, doc = items.seed_item[seed], of[at[hit]]
        band = np.floor_divide(at[hit] - cuts[doc] - items.seed_place[seed], np.maximum(16, size[item] // 2))
        # bands overlap by half: a run of seeds that drifts by less than a band lies whole in one of two
        part = np.stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(number[hit], 2)])
        part = part[:, np.lexsort(part[::-1])]
        met.append(part[:, np.r_[True, (np.diff(part) != 0).any(axis=0)]])
    if not met:
        return []
    whole = np.concatenate(met, axis=1) if len(met) > 1 else met[0]
    if len(met) > 1:
        whole = whole[:, np.lexsort(whole[::-1])]
        whole = whole[:, np.r_[True, (np.diff(whole) != 0).any(axis=0)]]
    doc, item, band, gram = whole
    starts = np.flatnonzero(np.r_[True, (np.diff(whole[:3]) != 0).any(axis=0)])
    reached = np.add.reduceat(items.weight[gram], starts)
    good = reached >= REACHED * items.mass[item[starts]]
    return list(zip(doc[starts][good].tolist(), item[starts][good].tolist(), band[starts][good].tolist(), reached[good].tolist()))


def matches(items: Items, texts: list) -> list[tuple]:
    """(text, item, score, first word, end word, weight reached): the best place of an item in a text, if good enough; of equally good ones the first."""
    words, of = words_of(texts)
    if not len(words):
        return []
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    by_item: dict[int, list] = {}
    for d, i, band, mass in _bands(items, words, of, cuts):
        n = len(items.words[i])
        w, length = max(16, n // 2), int(cuts[d + 1] - cuts[d])
        low, high = max(0, band * w - n // 4 - 4), min(length, (band + 2) * w + n + n // 4 + 4)
        by_item.setdefault(i, []).append((d, low, high, mass))
    out: dict[tuple, tuple] = {}
    for i, regions in by_item.items():
        own = items.words[i]
        step = max(1, CELLS // max(h - a for _, a, h, _ in regions))
        for k in range(0, len(regions), step):
            some = regions[k : k + step]
            for (d, low, _, mass), (score, s, e) in zip(some, align_many(own, [words[cuts[d] + a : cuts[d] + h] for d, a, h, _ in some])):
                share = score / (MATCH * len(own))
                if share >= SCORE and share > out.get((d, i), (0,))[0]:
                    out[d, i] = (share, low + s, low + e, float(mass))
    return [(d, i, *x) for (d, i), x in sorted(out.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int):
    """The items, in blocks of about ``most`` characters."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        ids.append(row[0]), texts.append(row[1] or "")
        size += len(texts[-1]) + 1
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _seeded(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, block_chars: int):
    """The items in blocks, with seeds chosen by their n-grams' counts over all of ``docs``; as broadcasts."""
    context = docs.sparkSession.sparkContext
    texts_only = docs.select(F.col(text_col).cast("string").alias("text"))
    for ids, texts in _blocks(benchmark, item_col, "text", block_chars):
        items = Items(ids, texts)
        if not len(items.grams):
            continue
        shared = context.broadcast(items)  # a block: bounded by block_chars

        def held(batches, shared=shared):
            items = shared.value
            total = np.zeros(len(items.grams) + 1, np.int64)
            for batch in batches:
                column = batch.column(0).to_pylist()
                for a, b in chunks(column, 1_000_000):
                    words, of = words_of(column[a:b])
                    number, at = items.find(words, of)
                    pairs = np.unique(of[at] * len(items.grams) + number)
                    total[:-1] += np.bincount(pairs % len(items.grams), minlength=len(items.grams))
                total[-1] += len(column)
            where = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], ["gram", "n"])

        counts = np.zeros(len(items.grams) + 1, np.int64)
        for gram, n in texts_only.mapInArrow(held, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n")).collect():
            counts[gram] = n  # a row an n-gram of the block
        items.weigh(int(counts[-1]), counts[:-1])
        yield context.broadcast(items)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(id, item_id, score, first_word, end_word, seed_weight): a row for each text and item that it holds, at its best place."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = picked.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, score double, first_word bigint, end_word bigint, seed_weight double"
    empty = spark.createDataFrame([], schema)
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    names, out = empty.columns, empty
    for shared in _seeded(docs, benchmark, text_col, item_col, block_chars):

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                column = batch.column(1).to_pylist()
                for a, b in chunks(column, 1_000_000):
                    found = list(zip(*matches(items, column[a:b])))
                    if found:
                        rows = pa.array([a + d for d in found[0]])
                        data = [batch.column(0).take(rows), pa.array([items.ids[i] for i in found[1]], item_type)]
                        data += [pa.array(found[2], pa.float64()), pa.array(found[3], pa.int64()), pa.array(found[4], pa.int64()), pa.array(found[5], pa.float64())]
                        yield pa.RecordBatch.from_arrays(data, names=names)

        part = picked.mapInArrow(run, schema)
        out = part if out is empty else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the texts that hold an item; all other rows stay as they are, where they are."""
    place = docs.columns.index(text_col)
    out = docs
    for shared in _seeded(docs, benchmark, text_col, item_col, block_chars):

        def run(batches, shared=shared):
            for batch in batches:
                column = batch.column(place).to_pylist()
                for a, b in chunks(column, 1_000_000):
                    bad = {x[0] for x in matches(shared.value, column[a:b])}
                    yield batch.slice(a, b - a).filter(pa.array([i not in bad for i in range(b - a)]))

        out = out.mapInArrow(run, docs.schema)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the documents that hold benchmark items, each with the item and its alignment."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).withColumnRenamed("id", "doc_id")
