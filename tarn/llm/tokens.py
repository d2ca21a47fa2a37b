"""Token counts that follow edits.

A document is cut into pre-tokens; groups of them are the leaves of a segment tree that
holds sums of code points and tokens. An edit re-cuts only from the last pre-token that the edit can
reach back to, up to the first cut behind the edit that the old text had too; only these pre-tokens are
encoded anew, and the sums above their leaves are updated.

Pre-tokens are encoded by the vocabulary file at ``path``, read on each machine. A pre-token's match
depends on the text from its start to three characters behind its end, hence the context.

Defined cases: a null or empty text has no tokens; repeated rows are counted each for itself; a long text is held whole, with two
numbers a pre-token; an empty table gives an empty result; columns play no part but those named, and nothing is ranked, so there are no ties.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

VOCABULARY = os.environ.get("TARN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
REACH = 3
_KEPT = 200_000


class Counter:
    """Tokens of pre-tokens, with a bounded memory of the last ones."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.encoding._core_bpe.encode_single_piece
        self.cut = regex.compile(PATTERN)
        self.memory: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        memory = self.memory
        new = [p for p in set(pieces) if p not in memory]
        if len(memory) + len(new) > _KEPT:
            memory.clear()
            new = set(pieces)
        for p in new:
            memory[p] = len(self.piece(p.encode("utf-8", "surrogatepass")))
        return [memory[p] for p in pieces]


class TokenTree:
    """A text's pre-tokens in leaves under a tree of sums."""

    def __init__(self, text: str, count: Counter) -> None:
        self.count, self.text = count, text
        pieces = count.cut.findall(text)
        self._group(np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(count(pieces), np.int64))

    def _group(self, lengths: np.ndarray, tokens: np.ndarray) -> None:
        """Leaves and sums over pre-tokens that are counted."""
        n = max(1, -(-len(lengths) // LEAF))
        self.leaves = [[lengths[i * LEAF : (i + 1) * LEAF], tokens[i * LEAF : (i + 1) * LEAF]] for i in range(n)]
        self.width = 1 << (n - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = a.sum(), b.sum()
        at = self.width
        while at > 1:
            half = at // 2
            for sums in (self.chars, self.tokens):
                sums[half:at] = sums[at : 2 * at : 2] + sums[at + 1 : 2 * at : 2]
            at = half

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_pieces(self) -> int:
        return sum(len(a) for a, _ in self.leaves)

    def _set(self, leaf: int, lengths, tokens) -> None:
        self.leaves[leaf] = [lengths, tokens]
        at = self.width + leaf
        self.chars[at], self.tokens[at] = lengths.sum(), tokens.sum()
        while at > 1:
            at //= 2
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the code point at ``place``, and that leaf's first code point."""
        at, before = 1, 0
        while at < self.width:
            at *= 2
            if place >= before + self.chars[at] and self.chars[at + 1]:
                before += self.chars[at]
                at += 1
        return at - self.width, int(before)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` for the code points ``start`` to ``end``; returns how many pre-tokens were encoded."""
        old_size, shift = len(self.text), len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        if not old_size:
            pieces = self.count.cut.findall(new)
            self._group(np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(self.count(pieces), np.int64))
            return len(pieces)
        first, begin = self._find(max(0, start - REACH))
        ends = begin + np.cumsum(self.leaves[first][0])
        keep = int(np.searchsorted(ends, start - REACH, side="right"))  # these end out of reach
        cut = int(ends[keep - 1]) if keep else begin
        # cut anew until a cut behind the edit is one of the old cuts
        last, last_begin = self._find(min(end, old_size - 1))
        cuts = last_begin + np.concatenate([[0], np.cumsum(self.leaves[last][0])])
        pieces, at, rest = [], cut, None
        for match in self.count.cut.finditer(self.text, cut):
            pieces.append(match.group())
            at = match.end()
            if at < start + len(new):
                continue
            old = at - shift
            while old > cuts[-1] and last + 1 < len(self.leaves):
                last += 1
                cuts = cuts[-1] + np.concatenate([[0], np.cumsum(self.leaves[last][0])])
            k = int(np.searchsorted(cuts, old))
            if old >= end and k < len(cuts) and cuts[k] == old:
                rest = k
                break
        tail = [x[rest:] for x in self.leaves[last]] if rest is not None else [np.empty(0, np.int64)] * 2
        lengths, tokens = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(self.count(pieces), np.int64)
        head = [x[:keep] for x in self.leaves[first]]
        none = np.empty(0, np.int64)
        for leaf in range(first + 1, (last if rest is not None else len(self.leaves) - 1) + 1):
            self._set(leaf, none, none)
        self._set(first, np.concatenate([head[0], lengths, tail[0]]), np.concatenate([head[1], tokens, tail[1]]))
        if len(self.leaves[first][0]) > 8 * LEAF:  # a leaf that has grown is split: pre-tokens are dealt to leaves again, none is encoded
            self._group(*(np.concatenate([x[i] for x in self.leaves]) for i in (0, 1)))
        return len(pieces)


def sample_edit(text: str) -> tuple[int, int, str]:
    """The query's edit: an eighth of the text, from its third on, gives way to the text's last sixteenth."""
    n = len(text)
    return n // 3, n // 3 + n // 8, text[n - n // 16 :]


def count_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit=sample_edit, path: str = VOCABULARY) -> DataFrame:
    """Tokens of each text before and after ``edit`` (text -> start, end, new), and how much was encoded for the latter."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    names = "id n_chars n_pretokens n_tokens edited_n_chars edited_n_tokens n_reencoded".split()

    def run(batches):
        count = Counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, 500_000):
                out = []
                for text in texts[a:b]:
                    tree = TokenTree(text or "", count)
                    row = [len(tree.text), tree.n_pieces, tree.n_tokens]
                    done = tree.replace(*edit(tree.text)) if tree.text else 0
                    out.append((*row, len(tree.text), tree.n_tokens, done))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(c, pa.int64()) for c in zip(*out))], names=names)

    return picked.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: token counts of every document, before and after the sample edit."""
    return count_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
