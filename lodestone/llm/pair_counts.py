"""Cross-tokenizer alignment: groups and links of two tokenizers' tokens, and the links' corpus-wide counts.

A is a byte-level BPE (a ``tokenizers`` file), B a SentencePiece BPE.  A text is encoded as space + text (B adds the
space itself).  Byte offsets where tokens of both end cut them into groups; the A and B token that end there are linked.

* **First pass.**  Every task aligns its texts and adds up the links of each distinct id pair; it hands on one row a
  pair.  Two linked tokens end together, so one's bytes end with the other's: a token is linked to at most as many
  tokens as it has bytes, and there are never more pairs than all tokens have bytes (some 600,000 for vocabularies
  of 50,000 and 32,000), however large the corpus.  The pairs, unlike their rows, may so be gathered and broadcast.
* **Minimal perfect hash** of the distinct pairs (``PairHash``): in each round the pairs that meet no other in a bit
  array take their bit, the rest go to the next, smaller array; a pair's place is the rank of its bit.  The pair itself
  is kept at its place, so that a pair that was never counted is told apart from one that was.
* **Dense vectors.**  Every task adds the counts of its rows to a vector indexed by the hash; the vectors, in slices,
  are summed along a tree of ``FAN`` branches.
* **Second pass.**  Every text is aligned again and its links' counts are looked up by the hash.

Texts part where neither tokenizer's tokens can reach across: at a space between two characters that aren't white
space (checked against B's pieces when it is loaded).  So each distinct part of a window of texts is encoded and aligned once.

Defined results.  Texts that are null or empty, and those whose joined token bytes differ from space + text (such as
texts with U+2581, which B's pieces use for the space), have no tokens: no groups, zeros.  Texts are taken whole; a very long
one without a space is one part.  Rows are counted as they come: repeated rows count each time.  Rows keep their order
of nothing: one comes out for each that goes in, null ids too.  An empty table gives an empty table.  Columns besides the
text are not read; the added column's name is a parameter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, by_value, discard, materialize

SPACE = "▁"
#: Characters of texts, and distinct parts, that a task takes together; parts that are encoded at once.
WINDOW_CHARS, WINDOW_PARTS, ENCODED = 24_000_000, 600_000, 50_000
#: Counts in a slice, and vectors that are summed at once.
SLICE, FAN = 8192, 16
ALIGNED = "groups string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"

_WORDS = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = re.compile(r"\s\s")
#: How a byte-level tokenizer cuts texts before it merges (a fixed value).
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Aligner:
    """Both tokenizers.  ``a``: the text of a tokenizers file, ``b``: the bytes of a model file."""

    def __init__(self, a: str, b: bytes):
        import json

        import sentencepiece

        self.encode_a = self._byte_level(json.loads(a)) or self._library(a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of B has a space inside: parts can't be encoded one at a time")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def _byte_level(self, told: dict):
        """A's encoder by ``tiktoken``, where ids are in the order of the merges (then both libraries give the same ids)."""
        # a byte-level token has one character a byte: printable ones stand for themselves, the others for 256 and up in order
        shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
        byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(shown))}
        vocab, special = told["model"]["vocab"], {t["content"] for t in told["added_tokens"]}
        self.a_bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        step, model = told["pre_tokenizer"], told["model"]
        plain = told["normalizer"] is None and step["type"] == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"] and not model.get("dropout") and not model.get("ignore_merges")
        made = [vocab.get(x + y) for x, y in merges]
        if not plain or None in made or made != sorted(made) or len(set(made)) < len(made) or max(vocab[c] for c in byte_of) > made[0]:
            return None
        import tiktoken

        ranks = {self.a_bytes[i]: i for token, i in vocab.items() if token not in special}
        one = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda parts: [one(p) for p in parts]

    @staticmethod
    def _library(a: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(a)
        tokenizer.encode_special_tokens = True
        return lambda parts: [x.ids for x in tokenizer.encode_batch(parts, add_special_tokens=False)]

    def most_pairs(self) -> int:
        return int(self.a_len.sum() + self.b_len.sum())

    def align(self, parts: list[str]) -> Iterator[Links]:
        """The links of some parts at a time, in their order."""
        for at in range(0, len(parts), ENCODED):
            yield self._align(parts[at : at + ENCODED])

    def _align(self, parts: list[str]) -> Links:
        spaced = [" " + p for p in parts]
        a, b = self.encode_a(spaced), self.b.encode(parts, num_threads=1)
        data = [p.encode("utf-8", "surrogatepass") for p in spaced]
        for ids, named in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join([named[i] for x in ids for i in x]) == b"".join(data) and [sum([len(named[i]) for i in x]) for x in ids] == list(map(len, data)):
                continue
            for k, x in enumerate(ids):
                if b"".join([named[i] for i in x]) != data[k]:
                    a[k], b[k] = [], []
        return Links(a, b, self.a_len, self.b_len)


def opened(held: dict) -> Aligner:
    """The tokenizers of a broadcast {a, b}; a worker keeps them in it from task to task."""
    if "open" not in held:
        held["open"] = Aligner(held["a"], held["b"])
    return held["open"]


class Links:
    """Groups and links of parts, end to end; a part without tokens is one that failed."""

    def __init__(self, a: list[list[int]], b: list[list[int]], a_len: np.ndarray, b_len: np.ndarray):
        self.n_a, self.n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends = [np.cumsum(n[x]) for n, x in ((a_len, self.a), (b_len, self.b))]
        common, self.at_a, self.at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        last = np.cumsum(self.n_a)
        upto = np.where(last > 0, ends[0][np.maximum(last - 1, 0)], 0) if len(ends[0]) else np.zeros(len(last), np.int64)
        self.ends = np.searchsorted(common, upto, side="right")  # links of the parts so far
        self.n = np.diff(self.ends, prepend=0)
        self.pairs = self.a[self.at_a] << 32 | self.b[self.at_b]
        self.good = self.n_a > 0

    def groups(self) -> list[str]:
        """Each part's groups as text."""
        a, b, out, p, q = self.a.tolist(), self.b.tolist(), [], 0, 0
        for x, y in zip(self.at_a.tolist(), self.at_b.tolist(), strict=True):
            out.append(f"{a[x]}|{b[y]}" if x == p and y == q else ",".join(map(str, a[p : x + 1])) + "|" + ",".join(map(str, b[q : y + 1])))
            p, q = x + 1, y + 1
        ends = self.ends.tolist()
        return [";".join(out[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def cut(text: str | None) -> list[str]:
    """The parts of a text, each without the space before it (the first one's is the added one)."""
    if not text:
        return []
    if SPACE in text:
        return [SPACE]  # never aligned: B's pieces write the space so
    # a space beside white space, or at an edge, parts nothing
    return _WORDS.split(text) if text[0].isspace() or text[-1].isspace() or _BLANKS.search(text) else text.split(" ")


def windows(batches: Iterable[Iterable[str | None]]) -> Iterator[tuple[list[list[str | None]], Counter]]:
    """Batches of texts taken together, and how often each part occurs in them."""
    held, parts, size = [], Counter(), 0
    for texts in batches:
        held.append(list(texts))
        for text in held[-1]:
            parts.update(cut(text))
            size += len(text or "")
        if size >= WINDOW_CHARS or len(parts) >= WINDOW_PARTS:
            yield held, parts
            held, parts, size = [], Counter(), 0
    if held:
        yield held, parts


class PairHash:
    """A minimal perfect hash of distinct whole numbers (uint64)."""

    ROOM = 1.5

    def __init__(self, keys: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]] | None = None):
        """Of the keys, in any order; or of the keys in their places and the levels of an earlier hash."""
        if levels is not None:
            self.keys, self.levels = keys, levels
            return
        self.levels = []
        left, taken = np.unique(np.asarray(keys, np.uint64)), 0
        self.keys = np.zeros(len(left), np.uint64)
        while len(left):
            at = self._hash(left, len(self.levels), size := max(2, int(len(left) * self.ROOM)))
            alone = np.bincount(at, minlength=size) == 1
            rank = taken + np.cumsum(alone) - 1
            mine = alone[at]
            self.keys[rank[at[mine]]] = left[mine]
            self.levels.append((alone, rank.astype(np.int64)))
            taken += int(mine.sum())
            left = left[~mine]

    @staticmethod
    def _hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; -1 for those that it was not made of."""
        keys = np.asarray(keys, np.uint64)
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._hash(keys[left], level, len(alone))
            mine = alone[at]
            found[left[mine]] = rank[at[mine]]
            left = left[~mine]
        known = found >= 0
        known[known] = self.keys[found[known]] == keys[known]
        return np.where(known, found, -1)


def link_counts(texts: Column, docs: DataFrame, a: str, b: bytes) -> DataFrame:
    """(pair, n): the links of each id pair (A's id in the upper half), summed within tasks, not yet beyond."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({"a": a, "b": b})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, sums = opened(shared.value), Counter()
        for held, parts in windows(pdf["text"] for pdf in batches):
            bad, each = set(), list(parts)
            aligned = list(aligner.align(each))
            good = np.concatenate([x.good for x in aligned]) if each else np.zeros(0, bool)
            if not good.all():  # a text of which one part fails has no tokens at all
                bad = {each[k] for k in np.flatnonzero(~good).tolist()}
                for text in chain.from_iterable(held):
                    if not bad.isdisjoint(own := cut(text)):
                        parts.subtract(own)
            n = np.array([parts[p] for p in each], np.int64)
            at = 0
            for x in aligned:
                pairs, where = np.unique(x.pairs, return_inverse=True)
                totals = np.zeros(len(pairs), np.int64)
                np.add.at(totals, where, np.repeat(n[at : at + len(x.n)], x.n))
                at += len(x.n)
                for pair, total in zip(pairs.tolist(), totals.tolist(), strict=True):
                    if total:
                        sums[pair] += total
        if sums:
            yield pd.DataFrame({"pair": np.fromiter(sums.keys(), np.int64, len(sums)), "n": np.fromiter(sums.values(), np.int64, len(sums))})

    return docs.select(texts.alias("text")).mapInPandas(count, "pair long, n long")


def tree_sum(rows: DataFrame, index: PairHash) -> np.ndarray:
    """Dense counts, by place, of (pair, n) rows."""
    spark, size = rows.sparkSession, len(index.keys)
    shared = spark.sparkContext.broadcast((index.keys, index.levels))

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = PairHash(*shared.value), np.zeros(size, np.int64)
        for pdf in batches:
            at = held.place(pdf["pair"].to_numpy(np.int64).view(np.uint64))
            np.add.at(total, at[at >= 0], pdf["n"].to_numpy(np.int64)[at >= 0])
        mine = TaskContext.get().partitionId()
        for k in range(0, size, SLICE):
            if (part := total[k : k + SLICE]).any():
                yield pd.DataFrame({"slice": [k // SLICE], "branch": [mine], "counts": [part.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"][:1], "branch": pdf["branch"][:1], "counts": [total.tobytes()]})

    kind = "slice int, branch int, counts binary"
    branches, level = rows.rdd.getNumPartitions(), rows.mapInPandas(dense, kind)
    while branches > 1:
        level = level.withColumn("branch", (F.col("branch") / FAN).cast("int")).groupBy("slice", "branch").applyInPandas(added, kind)
        branches = -(-branches // FAN)
    counts = np.zeros(size, np.int64)
    for r in level.collect():  # one vector, bounded as the pairs are
        part = np.frombuffer(r["counts"], np.int64)
        counts[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] += part
    return counts


class PairCounts:
    """Distinct pairs by a perfect hash, their counts, and whether a pair's count is the highest of its B id."""

    def __init__(self, index: PairHash, counts: np.ndarray):
        b = (index.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        most = np.zeros(int(b.max()) + 1 if len(b) else 1, np.int64)
        np.maximum.at(most, b, counts)
        self.index, self.counts, self.best = index, counts, (counts == most[b]) & (counts > 0)

    @classmethod
    def of(cls, keys: np.ndarray, levels: list, counts: np.ndarray, best: np.ndarray) -> PairCounts:
        out = cls.__new__(cls)
        out.index, out.counts, out.best = PairHash(keys, levels), counts, best
        return out

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether best) of each pair; zero and False where it was never counted."""
        at = self.index.place(pairs)
        return (np.where(at >= 0, self.counts[at], 0), (at >= 0) & self.best[at]) if len(self.counts) else (np.zeros(len(at), np.int64), np.zeros(len(at), bool))


def pair_counts(docs: DataFrame, a: str, b: bytes, *, text_col: str = "text") -> PairCounts:
    """Count the links of a whole corpus."""
    rows = materialize(link_counts(F.col(text_col), docs, a, b), "pairs-counted")
    pairs = rows.select("pair").distinct().toPandas()["pair"].to_numpy(np.int64)
    if len(pairs) > (most := Aligner(a, b).most_pairs()):
        raise RuntimeError(f"{len(pairs)} pairs where {most} are possible")
    index = PairHash(pairs.view(np.uint64))
    counts = PairCounts(index, tree_sum(rows, index))
    discard(rows)
    return counts


def aligned_column(counts: PairCounts, text: Column, a: str, b: bytes, spark: SparkSession) -> Column:
    """A struct of a text's groups and figures (``ALIGNED``)."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast({"a": a, "b": b, "counts": (counts.index.keys, counts.index.levels, counts.counts, counts.best)})

    def aligned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        aligner, known = opened(shared.value), PairCounts.of(*shared.value["counts"])
        for texts, parts in windows(batches):
            place = {p: k for k, p in enumerate(parts)}
            groups, figures, bad = [], [], set()
            for x in aligner.align(list(parts)):
                n, best = known.look_up(x.pairs.view(np.uint64))
                upto = lambda v: np.concatenate([[0], np.cumsum(v)])
                sums = [np.diff(upto(v)[np.concatenate([[0], x.ends])]) for v in (best.astype(np.int64), n)]  # noqa: B023
                bad.update((np.flatnonzero(~x.good) + len(groups)).tolist())
                groups += x.groups()
                figures.append(np.stack([x.n_a, x.n_b, x.n, x.n, *sums], axis=1))
            table = np.concatenate(figures) if figures else np.zeros((0, 6), np.int64)
            for some in texts:
                out = []
                for text in some:
                    at = [place[p] for p in cut(text)]
                    if at and (not bad or bad.isdisjoint(at)):
                        out.append((";".join([groups[k] for k in at]), *table[at].sum(axis=0).tolist()))
                    else:
                        out.append(("",) + (0,) * 6)
                yield pd.DataFrame(out, columns=["groups", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"])

    return F.pandas_udf(aligned, ALIGNED).asNondeterministic()(text)


def align_documents(docs: DataFrame, a: str, b: bytes, *, text_col: str = "text", into: str = "aligned") -> DataFrame:
    """``docs`` and a struct of each text's groups (`a1,a2|b1;a3|b2,b3`) and figures, the counts taken over all of ``docs``."""
    counts = pair_counts(docs, a, b, text_col=text_col)
    return docs.withColumn(into, aligned_column(counts, F.col(text_col), a, b, docs.sparkSession))


by_value(__name__)
