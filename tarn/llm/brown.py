"""A class-based bigram model of word sequences (Brown classes).

Classes grow from a core: exchange clustering over the commonest words, each for itself, and the
endings of all others, so that the mutual information of neighbouring classes grows. Then every other training
word is moved, in one sweep of the exchange over sparse counts of its left and right neighbours' classes, to
the class that it fits best; these counts lie in a partitioned table, so no word is too rare to take part.
The core's own words are about the square root of the vocabulary. A text's probability is the product of smoothed
class transitions, counted with the final class of every word, and of word emissions: a word's discounted
share of its class; an unknown word takes the class of its ending, and its discounted mass.

Counts come from all training texts. The workers share the head of the vocabulary, whose size
is a parameter; the counts and classes of all rarer words meet the texts in a join on the word. In the sweep
alone, a neighbour's class is that of its unit of the core.

Tokens are lower-cased words and one end for each text. Rows of fold 1 (crc32 of the id, mod 5) are held
out. Defined cases: a null or empty text is its end alone; repeated rows are learnt and scored each for itself;
without training texts scores rest on the smoothing alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import islice, repeat
from math import isqrt, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, fold, written

FOLDS, HELD_OUT = 5, 1
#: Words whose counts every worker holds, at most.
HEAD = 250_000
#: Words of the core that are units of their own, at least; units of endings, classes, and sweeps of the exchange.
WORDS, ENDINGS, CLASSES, SWEEPS = 767, 255, 64, 6
#: Entries after which a worker passes its counts on.
_ROOM = 400_000
#: Keys after which a worker adds its counts up, and counts after which it passes them on.
_PENDING, _CELLS = 4_000_000, 2_000_000
_DISCOUNT = 0.5
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A to Z only), then the end."""
    return [*(text or b"").lower().split(), END]


def _utf8(column: str):
    """A column of texts as bytes, so that workers needn't decode and encode them."""
    return F.col(column).cast("string").cast("binary").alias("text")


def _line(texts: list) -> list[bytes]:
    """The tokens of several texts; an end also stands before the first."""
    line = [END]
    for text in texts:
        line += tokens(text)
    return line


def _numbers() -> defaultdict:
    """Numbers words in the order in which they are met."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    return ids


def _blobs(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The runs of ``data`` between offsets, a binary value each."""
    where = (offsets * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(where) - 1, [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs of a column in a row, and how many each holds."""
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.asarray(pc.binary_length(column)) // np.dtype(kind).itemsize


def summed(keys: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(ns[order], starts) if len(starts) else ns


class Tally:
    """Counts keys (none below zero); what it holds is bounded by what waits and by the keys that it says to pass on."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = self.ns = np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.pending = 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to pass the counts on."""
        self.waiting.append(keys)
        self.pending += len(keys)
        return self.pending > _PENDING and len(self.merged()[0]) > _CELLS

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys, ns = np.unique(np.concatenate(self.waiting), return_counts=True)
            if len(self.keys):
                keys, ns = summed(np.concatenate([self.keys, keys]), np.concatenate([self.ns, ns]))
            self.keys, self.ns, self.waiting, self.pending = keys, ns, [], 0
        return self.keys, self.ns


def _ending(word: bytes) -> bytes:
    """The last letters of a word without its closing marks; digits are all alike."""
    core = word.rstrip(b".,;:!?\"')]}%$&*#|")
    if not core:
        return b"\x00mark"
    if core[-1:].isdigit():
        return b"\x00digit"
    return core[-2:] + (b"." if len(core) < len(word) else b"")


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over a column of texts; the end is the empty word."""

    def run(batches):
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > _ROOM:
                    yield rows()
        if held:
            yield rows()

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head of the vocabulary, and the unit of every word in the core."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int) -> None:
        self.total, self.distinct = total, distinct
        self.counts = dict(head)
        ranked = sorted(self.counts, key=lambda w: (-self.counts[w], w))
        most = max(WORDS, isqrt(distinct)) + 1
        units = [END, *(w for w in ranked[:most] if w != END)][:most]
        self.unit = {w: i for i, w in enumerate(units)}
        self.own = len(units)
        self.end_with([])

    def end_with(self, endings: list[bytes]) -> None:
        """Takes the units of endings."""
        self.ending = {e: self.own + i for i, e in enumerate(endings)}
        self.other = self.own + len(self.ending)
        self.size = self.other + 1
        self._memory = dict(self.unit)

    def units(self, words: list[bytes]) -> np.ndarray:
        memory = self._memory
        if len(memory) > 2 * HEAD:
            memory = self._memory = dict(self.unit)
        out = np.fromiter(map(memory.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            w = words[i]
            u = memory.get(w)
            if u is None:
                u = memory[w] = self.ending.get(_ending(w), self.other)
            out[i] = u
        return out


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[list[tuple[bytes, int]], int]:
    """The words of at least some count, ``most`` of them or fewer, and that count."""
    spread = counts.groupBy("c").count().orderBy(F.desc("c"))  # words by count; few rows: the counts that occur
    least, taken = None, 0
    for row in spread.toLocalIterator():
        if taken + row["count"] > most:
            break
        least, taken = row["c"], taken + row["count"]
    if least is None:
        return [], 1 << 62
    return [(bytes(r.word), r.c) for r in counts.filter(F.col("c") >= least).collect()], least


def endings_of(counts: DataFrame, own: dict, most: int = ENDINGS) -> list[bytes]:
    """The endings of the most tokens over all words but ``own``."""

    def run(batches):
        mass: Counter = Counter()
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w not in own:
                    mass[_ending(w)] += c
        yield pa.RecordBatch.from_arrays([pa.array(mass.keys(), pa.binary()), pa.array(mass.values(), pa.int64())], ["ending", "c"])

    mass = counts.select("word", "c").mapInArrow(run, "ending binary, c bigint").groupBy("ending").agg(F.sum("c").alias("c"))
    return [bytes(r.ending) for r in mass.orderBy(F.desc("c"), "ending").limit(most).collect()]


def count_pairs(texts: DataFrame, vocabulary) -> DataFrame:
    """(cell, n): pairs of neighbouring units; the end also stands before a text's first word."""

    def run(batches):
        v, tally = vocabulary.value, Tally()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in tally.merged()], ["cell", "n"])
            tally.clear()
            return out

        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in chunks(column, 500_000):
                u = v.units(_line(column[a:b]))
                if tally.add(u[:-1] * v.size + u[1:]):
                    yield rows()
        yield rows()

    return texts.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _information(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each unit: each in turn moves where the mutual information of neighbouring classes is highest."""
    n = len(pairs)
    size = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = np.argsort(-size, kind="stable")
    k = min(classes, n)
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % k
    one = np.zeros((n, k))
    one[np.arange(n), of] = 1
    table = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            home = of[u]
            one[u, home] = 0
            out, into = pairs[u] @ one, pairs[:, u] @ one  # counts with the classes of the others
            self_ = pairs[u, u]
            table[home] -= out
            table[:, home] -= into
            table[home, home] -= self_
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            a = out.sum() + self_
            b = into.sum() + self_
            # entering class j changes its row, its column, their crossing and its two sums
            gain = (_information(table + out) - _information(table)).sum(axis=1)
            gain += (_information(table + into[:, None]) - _information(table)).sum(axis=0)
            d = np.diag(table)
            gain += _information(d + out + into + self_) - _information(d + out) - _information(d + into) + _information(d)
            gain -= _information(rows + a) - _information(rows) + _information(cols + b) - _information(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[home] + 1e-9:
                best = int(home)
            moved += best != home
            of[u] = best
            one[u, best] = 1
            table[best] += out
            table[:, best] += into
            table[best, best] += self_
        if not moved:
            break
    return of


def neighbours(texts: DataFrame, vocabulary, unit_class: np.ndarray, k: int) -> DataFrame:
    """(word, cells): counts of the classes before (cells below ``k``) and after each word that is no unit of its own; several rows a word.

    ``cells`` holds eight bytes an entry: 2 ``k`` times the count, plus the cell.
    """

    def run(batches):
        v, tally = vocabulary.value, Tally()
        ids, unit = _numbers(), np.empty(0, np.int64)

        def rows():
            keys, ns = tally.merged()
            word, cell = np.divmod(keys, 2 * k)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            names = pa.array(list(ids), pa.binary()).take(pa.array(word[starts]))
            whole = pa.RecordBatch.from_arrays([names, _blobs(ns * (2 * k) + cell, np.append(starts, len(keys)))], names=["word", "cells"])
            for i in range(0, whole.num_rows, 20_000):
                yield whole.slice(i, 20_000)

        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in chunks(column, 500_000):
                line = _line(column[a:b])
                met = len(ids)
                word = np.fromiter(map(ids.__getitem__, line), np.int64, len(line))
                unit = np.concatenate([unit, v.units(list(islice(reversed(ids), len(ids) - met))[::-1])])
                u = unit[word]
                c = unit_class[u]
                at = np.flatnonzero(u >= v.own)  # never an end, so both neighbours are in the text
                word = word[at] * (2 * k)
                if tally.add(np.concatenate([word + c[at - 1], word + k + c[at + 1]])):
                    yield from rows()
                    tally.clear()
                    ids.clear()
                    unit = unit[:0]
        yield from rows()

    return texts.mapInArrow(run, "word binary, cells binary")


def _rise(now: np.ndarray, more: np.ndarray) -> np.ndarray:
    return _information(now + more) - _information(now)


def place(table: np.ndarray, homes: np.ndarray, word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class of each word, given (word, cell, n) sorted by word and cell, each pair once; at home the word's own counts are taken out first.

    What a count adds is worked out once for all words of the same cell and count; only at home does each have its own.
    """
    k = len(table)
    both = np.concatenate([table, table.T])  # [cell]: the counts that a word of each class joins
    gain = np.zeros((len(homes), k))
    for a in range(0, len(word), 20_000):
        w, c, m = word[a : a + 20_000], cell[a : a + 20_000], n[a : a + 20_000]
        kinds, which = np.unique(m * (2 * k) + c, return_inverse=True)
        part = _rise(both[kinds % (2 * k)], (kinds // (2 * k))[:, None])[which]
        home = homes[w]
        part[np.arange(len(w)), home] = _rise(np.maximum(both[c, home] - m, 0.0), m)
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[starts]] += np.add.reduceat(part, starts, axis=0)
    total = np.bincount(word[cell < k], weights=n[cell < k], minlength=len(homes))  # as many before as after
    at = np.arange(len(homes))
    kinds, which = np.unique(total, return_inverse=True)
    for side in (table.sum(axis=0), table.sum(axis=1)):
        part = _rise(side[None, :], kinds[:, None])[which]
        part[at, homes] = _rise(np.maximum(side[homes] - total, 0.0), total)
        gain -= part
    best = gain.argmax(axis=1)
    return np.where(gain[at, best] > gain[at, homes] + 1e-9, best, homes)


def assign(found: DataFrame, vocabulary, unit_class: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, c, class) of the rows of ``neighbours``."""
    k = len(table)

    def placed(part, starts):
        words = part.column(0).take(pa.array(starts))
        entries, held = _joined(part.column(1), np.int64)
        of = np.searchsorted(starts, np.arange(part.num_rows), side="right") - 1
        keys, n = summed(np.repeat(of, held) * (2 * k) + entries % (2 * k), entries // (2 * k))
        of, cell = np.divmod(keys, 2 * k)
        c = np.bincount(of[cell < k], weights=n[cell < k], minlength=len(words)).astype(np.int64)
        classes = place(table, unit_class[vocabulary.value.units(words.to_pylist())], of, cell, n)
        return pa.RecordBatch.from_arrays([words, pa.array(c), pa.array(classes, pa.int32())], ["word", "c", "class"])

    def run(batches):
        rest = None  # rows of the last word, which may go on in the next batch
        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(rest.columns, batch.columns)], ["word", "cells"])
            if not batch.num_rows:
                continue
            word = batch.column(0)
            starts = np.append(0, np.flatnonzero(pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)) + 1)
            if len(starts) > 1:
                yield placed(batch.slice(0, starts[-1]), starts[:-1])
            rest = batch.slice(starts[-1])
        if rest is not None:
            yield placed(rest, np.zeros(1, np.int64))

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, c bigint, class int")


class Brown:
    """Classes, emissions and, once fitted, smoothed transitions."""

    def __init__(self, vocabulary: Vocabulary, unit_class: np.ndarray, classes: dict, mass: np.ndarray, kinds: np.ndarray) -> None:
        """classes: of the head's words; mass, kinds: training tokens and distinct training words of each class."""
        self.vocabulary, self.unit_class, self.classes, self.mass, self.kinds = vocabulary, unit_class, classes, mass, kinds
        self.end = int(unit_class[0])
        self.step = np.zeros((len(mass), len(mass)))
        self._head = None

    def head(self) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        """Number of each word of the head; class, emission and base by number, and a last row of zeros for other words."""
        if self._head is None:
            c = np.array([self.vocabulary.counts[w] for w in self.classes], np.int64)
            of = np.fromiter(self.classes.values(), np.int64, len(c))
            self._head = {w: i for i, w in enumerate(self.classes)}, np.append(of, 0), np.append(self.emission(of, c), 0.0), np.append(self.base(c), 0.0)
        return self._head

    def fit(self, tagged: DataFrame) -> Brown:
        """Counts the transitions of tagged training texts."""
        k, end = len(self.mass), self.end

        def run(batches):
            total = np.zeros(k * k, np.int64)
            for batch in batches:
                line = np.frombuffer(b"".join(bytes([end]) + x for x in batch.column(0).to_pylist()), np.uint8).astype(np.int64)
                ends = np.cumsum([len(x) + 1 for x in batch.column(0).to_pylist()])
                inside = np.ones(len(line), bool)
                inside[ends - 1] = False  # no step from a text's end to the next text
                at = np.flatnonzero(inside)
                total += np.bincount(line[at] * k + line[at + 1], minlength=k * k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], ["cell", "n"])

        table = np.zeros(k * k)
        for cell, n in tagged.select("classes").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
            table[cell] = n
        table = table.reshape(k, k)
        after = table.sum(axis=0)
        share = (after + 0.5) / (after + 0.5).sum()
        several = (table > 0).sum(axis=1, keepdims=True) + 1.0  # Witten-Bell: back to the class's own share
        #: log10 of a class after a class.
        self.step = np.log10((table + several * share) / (table.sum(axis=1, keepdims=True) + several))
        return self

    def emission(self, classes: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word of count ``c`` within its class; the discounted mass for an unknown one."""
        share = np.where(c > 0, np.maximum(c - _DISCOUNT, _DISCOUNT), _DISCOUNT * self.kinds[classes] + 1.0)
        return np.log10(share / (self.mass[classes] + 1.0))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10(c + 0.5) - log10(self.vocabulary.total + 0.5 * (self.vocabulary.distinct + 1))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD):
    """(model without transitions, count and class of every training word, least count of the shared head)."""
    spark = docs.sparkSession
    texts = docs.filter(fold(id_col, FOLDS) != HELD_OUT).select(_utf8(text_col))
    counts = written(count_words(texts), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, least = head_of(counts, head)
    v = Vocabulary(words, total, distinct)
    v.end_with(endings_of(counts, v.unit))
    shared = spark.sparkContext.broadcast(v)  # at most `head` words
    pairs = np.zeros(v.size * v.size)
    met = count_pairs(texts, shared).toArrow()  # a row for a pair of units: bounded by their number
    pairs[met["cell"].to_numpy()] = met["n"].to_numpy()
    pairs = pairs.reshape(v.size, v.size)
    k = min(CLASSES, v.size)
    of = exchange(pairs)
    one = np.zeros((v.size, k))
    one[np.arange(v.size), of] = 1
    table = one.T @ pairs @ one
    ends = counts.filter(F.length("word") == 0).first()
    own = [(bytearray(w), v.counts.get(w, ends.c if ends and w == END else 0), int(of[i])) for w, i in v.unit.items()]
    own = spark.createDataFrame([x for x in own if x[1]], "word binary, c bigint, class int")
    classed = written(assign(neighbours(texts, shared, of, k), shared, of, table).unionByName(own), "classes")
    discard(counts)
    mass, kinds = np.zeros(k), np.zeros(k)
    for c, m, n in classed.groupBy("class").agg(F.sum("c"), F.count("*")).collect():
        mass[c], kinds[c] = m, n
    classes = {bytes(r.word): r["class"] for r in classed.filter(F.col("c") >= least).select("word", "class").collect()}
    return Brown(v, of, classes, mass, kinds), classed, least


def tag(docs: DataFrame, model: Brown, counts: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, base, emitted, classes) of each row: classes holds a byte a token."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), _utf8(text_col))
    kind = picked.schema["id"].dataType.simpleString()
    done = ["n_tokens", "n_known", "base", "emitted", "classes"]

    def run(batches):
        m = shared.value
        number, class_of, emitted_of, base_of = m.head()
        for batch in batches:
            column = batch.column(3).to_pylist()
            for a, b in chunks(column, 500_000):
                flat, ends = [], []
                for text in column[a:b]:
                    flat += tokens(text)
                    ends.append(len(flat))
                ends = np.array(ends)
                first = np.append(0, ends[:-1])
                docs = np.arange(len(ends) + 1)
                at = np.fromiter(map(number.get, flat, repeat(-1)), np.int64, len(flat))
                rare = np.flatnonzero(at < 0)
                ids = _numbers()
                word = np.fromiter(map(ids.__getitem__, map(flat.__getitem__, rare.tolist())), np.int64, len(rare))
                of = class_of[at].astype(np.uint8)
                of[rare] = m.unit_class[m.vocabulary.units(list(ids))][word]  # of the ending, unless the join finds a class
                doc = np.searchsorted(ends, rare, side="right")
                pairs, index = np.unique(doc * (len(ids) + 1) + word, return_inverse=True)  # the rare words of each text, once
                pair_doc, pair_word = np.divmod(pairs, len(ids) + 1)
                held, spots = np.searchsorted(pair_doc, docs), np.searchsorted(doc, docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i)[a:b] for i in range(3)),
                        pa.array(ends - first, pa.int64()),
                        pa.array(np.add.reduceat((at >= 0).astype(np.int64), first)),
                        pa.array(np.add.reduceat(base_of[at], first)),
                        pa.array(np.add.reduceat(emitted_of[at], first)),
                        _blobs(of, np.append(0, ends)),
                        pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.array(list(ids), pa.binary()).take(pa.array(pair_word))),
                        pa.array(np.diff(held), pa.int32()),
                        _blobs((rare - first[doc]).astype(np.int32), spots),
                        _blobs((index - held[doc]).astype(np.int32), spots),
                    ],
                    names=["row", "id", "held_out", *done, "words", "n_rare", "places", "numbers"],
                )

    fixed = "n_tokens bigint, n_known bigint, base double, emitted double, classes binary"
    part = written(
        picked.mapInArrow(run, f"row bigint, id {kind}, held_out boolean, {fixed}, words array<binary>, n_rare int, places binary, numbers binary"), "tagged"
    )
    rare = part.select("row", F.posexplode("words").alias("i", "word"))
    met = rare.join(counts.filter(F.col("c") < least), "word").groupBy("row").agg(F.collect_list(F.struct("i", "c", F.col("class").alias("k"))).alias("met"))
    late = part.filter("n_rare > 0").drop("words").join(met, "row", "left")

    def finish(batches):
        m = shared.value
        for batch in batches:
            n_tokens, n_known, base, emitted, n_rare = (np.asarray(batch.column(n)) for n in [*done[:4], "n_rare"])
            met = batch.column("met")
            found = met.flatten()
            first, held = np.append(0, np.cumsum(n_tokens)), np.append(0, np.cumsum(n_rare))
            at = np.repeat(held[:-1], np.asarray(pc.fill_null(pc.list_value_length(met), 0))) + np.asarray(found.field("i"))
            c, own = np.zeros(held[-1], np.int64), np.full(held[-1], -1, np.int64)
            c[at], own[at] = np.asarray(found.field("c")), np.asarray(found.field("k"))
            of = _joined(batch.column("classes"), np.uint8)[0].copy()
            places, spots = _joined(batch.column("places"), np.int32)
            doc = np.repeat(np.arange(len(spots)), spots)
            places, word = first[doc] + places, held[doc] + _joined(batch.column("numbers"), np.int32)[0]
            known = own[word] >= 0
            of[places[known]] = own[word[known]]
            c = c[word]

            def add(x, docs=doc, rows=len(spots)):
                return np.bincount(docs, weights=x, minlength=rows)

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("held_out"),
                    batch.column("n_tokens"),
                    pa.array(n_known + add(known).astype(np.int64)),
                    pa.array(base + add(m.base(c))),
                    pa.array(emitted + add(m.emission(of[places].astype(np.int64), c))),
                    _blobs(of, first),
                ],
                names=["id", "held_out", *done],
            )

    return late.mapInArrow(finish, f"id {kind}, held_out boolean, {fixed}").unionByName(part.filter("n_rare = 0").select("id", "held_out", *done))


def add_up(tagged: DataFrame, model: Brown) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of tagged rows."""
    step, end, total = model.step, model.end, model.vocabulary.total
    kind = tagged.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            score = []
            for x in batch.column("classes").to_pylist():
                line = np.frombuffer(bytes([end]) + x, np.uint8)
                score.append(float(step[line[:-1], line[1:]].sum()))
            score = np.array(score) + np.asarray(batch.column("emitted"))
            kept = [batch.column(n) for n in ("id", "held_out", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.full(len(score), total, np.int64)), batch.column("base"), pa.array(score, pa.float64())],
                names="id held_out n_tokens n_known train_tokens base_score score".split(),
            )

    return tagged.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD):
    """(model, count and class of every training word, least count of the shared head)."""
    model, counts, least = learn(docs, id_col, text_col, head)
    texts = docs.filter(fold(id_col, FOLDS) != HELD_OUT)
    return model.fit(tag(texts, model, counts, least, id_col, text_col)), counts, least


def score(docs: DataFrame, model: Brown, counts: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``."""
    return add_up(tag(docs, model, counts, least, id_col, text_col), model)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document's log-probability by the base and by the class model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counts, least = learn(docs)
    tagged = written(tag(docs, model, counts, least), "classed")  # serves the transitions and the scores
    model.fit(tagged.filter("not held_out"))
    return add_up(tagged, model).withColumnRenamed("id", "doc_id").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
