"""Language identification as a mixture of languages, by expectation-maximisation.

Character trigrams of labelled texts give each language a likelihood of any word. A document's
words come from a mixture of languages; expectation-maximisation estimates the proportions, and the
set of languages is the one of the best likelihood less a penalty for each language more (BIC)
along the order of the proportions.

The score is the leading language's share within the chosen set. ``keep_known`` sets the chosen languages against a
background in which every trigram is as likely as any other: a text that the background explains better
(by the same penalised likelihood) has no language that was learnt.

The model is fitted on a sample of about ``per_language`` labelled rows a language, a documented
bound; predictions read whole texts. Rows of fold 1 (crc32 of the id, mod 3) are never learnt from.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing could be learnt; of languages that fit equally well the first by name leads; repeated rows get equal answers; a long text is
held whole, with some numbers a letter; an empty table gives an empty result; columns play no part but those named, and one of
the name of a column that is added gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, id_text

PER_LANGUAGE = 3000
#: Trigram buckets, as a power of two: the model has as many numbers for each language.
BITS = 18
FOLDS, HELD_OUT = 3, 1
ROUNDS = 10
UNKNOWN = "und"
_SMOOTH = 0.05

_alphabet: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _alphabet:
        _alphabet.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alphabet[0]


def word_grams(texts: list, bits: int):
    """(bucket of each letter's trigram, first letter of each word, document of each word) of some texts."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    letter = _is_letter()[points]
    at = np.flatnonzero(letter)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none
    kept = np.where(letter, points, np.uint32(0))
    before = np.where(at > 0, kept[at - 1], np.uint32(0))
    after = kept[at + 1]  # a separator ends the last text
    h = before * np.uint32(0x9E3779B1) ^ kept[at] * np.uint32(0x85EBCA77) ^ (after + np.uint32(1)) * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    grams = (h >> np.uint32(32 - bits)).astype(np.int64)
    starts = np.flatnonzero(before == 0)
    return grams, starts, np.searchsorted(ends, at[starts], side="right")


class Model:
    """Log-likelihoods of trigram buckets by language."""

    def __init__(self, languages: list[str], table: np.ndarray, bits: int) -> None:
        self.languages, self.table, self.bits = languages, table, bits

    def _proportions(self, lik: np.ndarray, of: np.ndarray, first: np.ndarray, start: np.ndarray):
        """EM from ``start`` (documents by languages; zero: not in the set): proportions and log of each word's mixed likelihood."""
        pi = start
        for _ in range(ROUNDS):
            share = pi[of] * lik
            share /= share.sum(axis=1, keepdims=True)
            pi = np.add.reduceat(share, first, axis=0)
            pi /= pi.sum(axis=1, keepdims=True)
        return pi, np.add.reduceat(np.log((pi[of] * lik).sum(axis=1)), first)

    def predict(self, texts: list):
        """For each text: its language (or ``und``), the language's share, the chosen set with shares, and by how much its penalised likelihood exceeds the background's."""
        out = [(UNKNOWN, 0.0, "", -np.inf)] * len(texts)
        n = len(self.languages)
        grams, starts, docs = word_grams(texts, self.bits)
        if not n or not len(starts):
            return out
        ll = np.add.reduceat(self.table[grams], starts, axis=0).astype(np.float64)
        present, first, of = np.unique(docs, return_index=True, return_inverse=True)
        top = ll.max(axis=1, keepdims=True)
        lik = np.exp(np.maximum(ll - top, -300.0))
        words = np.diff(np.append(first, len(docs)))
        alone = np.add.reduceat(ll - top, first, axis=0)
        pi, mixed = self._proportions(lik, of, first, np.full((len(present), n), 1.0 / n))
        best = alone.max(axis=1)  # log-likelihood less that of each word's best language
        chosen = np.zeros((len(present), n), bool)
        chosen[np.arange(len(present)), alone.argmax(axis=1)] = True
        share = chosen.astype(np.float64)
        score = 2 * best
        rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1, kind="stable")
        # no subset beats the whole mixture, so others than these stay with one language
        open_ = np.flatnonzero(2 * mixed - np.log(words) > score) if n > 1 else np.empty(0, np.int64)
        for k in range(2, n + 1):
            if not len(open_):
                break
            sel = np.isin(of, open_)
            at = np.searchsorted(open_, of[sel])
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            inside = rank[open_] < k
            p, m = self._proportions(lik[sel] + 1e-300, at, begin, inside / k)
            value = 2 * m - (k - 1) * np.log(words[open_])
            better = value > score[open_]
            rows = open_[better]
            score[rows], chosen[rows], share[rows] = value[better], inside[better], p[better]
            open_ = open_[2 * mixed[open_] - k * np.log(words[open_]) > score[open_]]
        letters = np.add.reduceat(np.diff(np.append(starts, len(grams))), first)
        margin = score + 2 * np.add.reduceat(top[:, 0], first) + 2 * letters * self.bits * np.log(2.0)
        for i, doc in enumerate(present):
            lead = int(np.argmax(share[i]))
            order = sorted(np.flatnonzero(chosen[i]), key=lambda j: (-share[i, j], j))
            out[doc] = (
                self.languages[lead],
                float(min(1.0, max(0.0, share[i, lead]))),
                ",".join(f"{self.languages[j]}:{share[i, j]:.3f}" for j in order),
                float(margin[i]),
            )
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits the trigram model on a sample of rows outside the held-out fold."""
    id_col, text_col, lang_col = (f"`{c}`" for c in (id_col, text_col, lang_col))
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), fold(id_col, FOLDS).alias("fold"), F.pmod(F.xxhash64(id_text(id_col)), F.lit(1 << 20)).alias("lot")
    ).filter(f"fold <> {HELD_OUT} and lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty((0, 0), np.float32), BITS)
    bits = BITS
    spark = docs.sparkSession
    limits = spark.createDataFrame(
        [(k, i, int(min(1.0, per_language / sizes[k]) * (1 << 20)) + 1) for i, k in enumerate(languages)], "lang string, number int, below bigint"
    )
    # one row a language, whose number the model's size already bounds
    sample = rows.join(F.broadcast(limits), "lang").filter("lot < below").select("number", "text")
    count = len(languages)

    def run(batches):
        total = np.zeros((count, 1 << bits), np.int64)
        for batch in batches:
            numbers, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for a, b in chunks(texts, 1_000_000):
                grams, starts, of = word_grams(texts[a:b], bits)
                if len(starts):
                    sizes_ = np.diff(np.append(starts, len(grams)))
                    by = np.repeat(numbers[a:b][of], sizes_)
                    total += np.bincount(by.astype(np.int64) << bits | grams, minlength=count << bits).reshape(total.shape)
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total.ravel()[where])], ["cell", "n"])

    table = np.zeros(count << bits)
    for cell, n in sample.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[cell] = n
    table = table.reshape(count, 1 << bits) + _SMOOTH
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(), bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages`` (the chosen set with shares); its text column is read only."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2^BITS numbers a language
    added = ["lang_pred", "score", "languages"]
    kept = [f for f in docs.schema.fields if f.name not in added]
    picked = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    place = picked.columns.index(text_col)
    schema = picked.drop(text_col).schema.add("lang_pred", "string").add("score", "double").add("languages", "string")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            rest = [c for i, c in enumerate(batch.columns) if i != place]
            for a, b in chunks(texts, 500_000):
                found = list(zip(*shared.value.predict(texts[a:b])))[:3]
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in rest), pa.array(found[0]), pa.array(found[1], pa.float64()), pa.array(found[2])], names=schema.names)

    return picked.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, unchanged; those that are ``und`` go, and those that the background explains better than the languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers a language
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in chunks(texts, 500_000):
                known = [x[0] != UNKNOWN and x[3] >= 0 for x in shared.value.predict(texts[a:b])]
                yield batch.slice(a, b - a).filter(pa.array(known))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    rows = docs.select("doc_id", "text", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages")
