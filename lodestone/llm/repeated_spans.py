"""Removal of repeated passages: every word covered by a window of words whose sequence also starts elsewhere.

Reference text is held in suffix automata, documents' words are streamed through them, and maximal spans of
at least ``WINDOW`` words that occur twice or more go.  Here the reference is the corpus itself, so it must be cut into
shards that grow in number, and a document must meet only those that can match it:

* **Anchors.**  Of a window's runs of ``GRAM`` words, that with the least hash (the leftmost of equals) is the window's anchor.
  Equal windows have equal anchors.  Neighbouring windows mostly share one; a text so falls into *segments*, the
  words of all windows of one anchor's place.  Every window lies in exactly one segment.
* Anchors counted once in the whole corpus are out: none of their windows repeats.  Texts with others are made distinct
  (copies are counted), and their segments, distinct and counted too, are dealt to shards by anchor.
* **Automata.**  A shard's segments make one suffix automaton (``Automaton``); a state's weight is the number of places
  where its words end, copies included.  The segments are then streamed through it: the longest run of words
  ending at each place that has a weight of two or more (matching statistics).  Since no window lies in two segments,
  weights of runs of ``WINDOW`` words or more are exact; automata hold the words themselves, not hashes.
* Spans go back to the texts by the segments' digests.

Automata are not broadcast: those of a whole corpus grow with it, and no bound on them can be proved.  Instead the
shuffle brings each shard's reference and the documents' segments that can match it to one task; a shard holds
``SHARD`` words or one anchor.  An anchor with more than ``HOT`` distinct segments (a common passage between ever other words) is
not put into one shard: the windows of its segments are counted by digest, which no key can crowd, as only equal windows meet.

Defined results.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none.  Texts of fewer words than a window lose
nothing.  A text that stands in two rows loses everything; so do windows that overlap their own copies.  Texts are
read whole, however long.  Repeated rows are as many documents; ids are not read.  An empty table gives an empty table.
Columns besides the text go through under any name but that of the added one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_value, discard, materialize, quoted, word_count

#: Words of a window and of an anchor; words of a shard; distinct segments of an anchor beyond which its windows are counted.
WINDOW, GRAM, SHARD, HOT = 35, 8, 60_000, 2_000
#: Bytes of a text whose words are hashed at once.
PIECE = 1 << 22
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def text_key(text: Column) -> Column:
    """16 bytes of a text."""
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), text)), 16, "0") for seed in (5, 11)]))


def plain(text: Column) -> Column:
    """A text's words joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            found = _BLANK.search(data, end)
            end = found.start() if found else len(data)
        words = data[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def segments(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first window, last window) of each segment of a text."""
    words, gram = word_hashes(data), min(GRAM, window)
    windows, wide = len(words) - window + 1, window - gram + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(words) - gram + 1
    mixed = np.zeros(size, np.uint64)
    for k in range(gram):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[k : k + size]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(mixed[a] <= mixed[b], a, b)

    least, length = np.arange(size), 1  # the place of the least of so many
    while 2 * length <= wide:
        least = better(least[: len(least) - length], least[length:])
        length *= 2
    least = better(least[:windows], least[wide - length : wide - length + windows])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [windows - 1]])
    return mixed[least[first]].view(np.int64), first, last


class Automaton:
    """The suffix automaton of several sequences of words, with the number of places where a state's words end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.weight = [-1], [0], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        self.weight.append(0)
        return len(self.len) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state reached from ``p`` by ``c``, made the exact continuation of ``p``'s longest."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, weight: int) -> None:
        last, nxt, link, length = 0, self.next, self.link, self.len
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                cur, p = self._state(length[last] + 1, {}, 0), last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    link[cur] = self._split(p, c, nxt[p][c])
                last = cur
            self.weight[last] += weight

    def weigh(self) -> None:
        """Once all is added: what ends with a state's words ends with those of its link too."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.weight[self.link[s]] += self.weight[s]

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """The maximal spans of ``least`` words or more that end at two places at least."""
        nxt, link, length, weight = self.next, self.link, self.len, self.weight
        out, state, size = [], 0, 0
        for i, c in enumerate(words):
            to = nxt[state].get(c)
            while state and (to is None or weight[to] < 2):
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None or weight[to] < 2:
                size = 0
                continue
            state, size = to, size + 1
            if size >= least:
                a, b = i - size + 1, i + 1
                if out and a <= out[-1][1]:
                    out[-1] = (min(a, out[-1][0]), b)
                else:
                    out.append((a, b))
        return out


def _shards(window: int, shard: int):
    """Rows (anchor, segment, n, words) sorted by anchor: spans of each segment."""

    def found(rows: list[tuple]) -> pd.DataFrame:
        automaton, texts = Automaton(), [(d, w.split(" ")) for d, w, _ in rows]
        for (_, words), (_, _, n) in zip(texts, rows, strict=True):
            automaton.add(words, n)
        automaton.weigh()
        told = [(d, a, b) for d, words in texts for a, b in automaton.spans(words, window)]
        return pd.DataFrame(told, columns=["segment", "a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for pdf in batches:
            for anchor, segment, n, words in zip(pdf["anchor"].tolist(), pdf["segment"], pdf["n"].tolist(), pdf["words"], strict=True):
                if size >= shard and anchor != last:
                    yield found(held)
                    held, size = [], 0
                held.append((segment, words, n))
                size += words.count(" ") + 1
                last = anchor
        if held:
            yield found(held)

    return run


def _segment_rows(docs: DataFrame, window: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, rows): distinct texts with anchors that repeat (key, text, n), and their segments (key, start, anchor, segment, words, n)."""
    spark = docs.sparkSession
    bound_batches(spark)

    def anchors(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            found = [segments(_encoded(t), window)[:2] for t in some]
            yield pd.DataFrame({"anchor": [h for h, _ in found], "start": [s.astype(np.int32) for _, s in found]})

    told = F.pandas_udf(anchors, "anchor array<long>, start array<int>").asNondeterministic()(F.col(text_col))
    rows = docs.select(text_key(F.col(text_col)).alias("key"), told.alias("x")).select("key", F.explode(F.arrays_zip("x.anchor", "x.start")).alias("x"))
    placed = materialize(rows.select("key", "x.anchor", "x.start"), "repeats-anchors")
    # written, so that the join's sides are plain shuffles and a hot anchor's rows can be split
    often = materialize(placed.groupBy("anchor").count().where("count > 1").select("anchor"), "repeats-often")
    wanted = placed.join(often, "anchor").groupBy("key").agg(F.collect_set("start").alias("starts"))
    distinct = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    texts = materialize(distinct.join(wanted, "key"), "repeats-texts")
    discard(placed)
    discard(often)

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for some, starts in batches:
            out = []
            for text, mine in zip(some, starts, strict=True):
                data = _encoded(text)
                anchor, first, last = segments(data, window)
                mine = np.flatnonzero(np.isin(first, mine))
                words = data.split()
                out.append((anchor[mine], first[mine].astype(np.int32), [b" ".join(words[first[k] : last[k] + window]).decode("utf-8", "surrogatepass") for k in mine.tolist()]))
            yield pd.DataFrame(out, columns=["anchor", "start", "words"])

    told = F.pandas_udf(cut, "anchor array<long>, start array<int>, words array<string>").asNondeterministic()(F.col("text"), F.col("starts"))
    zipped = texts.select("key", "n", told.alias("x")).select("key", "n", F.explode(F.arrays_zip("x.anchor", "x.start", "x.words")).alias("x"))
    return texts, materialize(zipped.select("key", "n", "x.anchor", "x.start", "x.words", F.unhex(F.md5("x.words")).alias("segment")), "repeats-segments")


def _spans(rows: DataFrame, window: int) -> DataFrame:
    """(segment, a, b): the repeated spans of each distinct segment, in words from its start."""
    spark = rows.sparkSession
    distinct = materialize(rows.groupBy("anchor", "segment").agg(F.first("words").alias("words"), F.sum("n").alias("n")), "repeats-distinct")
    hot = materialize(distinct.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "repeats-hot")
    crowded = bool(hot.head(1))
    cold = distinct.join(hot, "anchor", "left_anti") if crowded else distinct
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cold.select("anchor", "segment", "n", "words").repartition(n, "anchor").sortWithinPartitions("anchor")
    found = dealt.mapInPandas(_shards(window, SHARD), "segment binary, a int, b int")
    if crowded:
        words = F.split("words", " ")
        each = F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda k: F.unhex(F.md5(F.array_join(F.slice("w", k, window), " "))))
        listed = distinct.join(hot, "anchor", "left_semi").select("segment", "n", words.alias("w")).select("segment", "n", F.posexplode(each).alias("a", "window"))
        again = materialize(listed.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"), "repeats-again")
        found = found.unionByName(listed.join(again, "window").select("segment", "a", (F.col("a") + window).alias("b")))
    return materialize(found, "repeats-spans")


def removals(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The distinct texts that lose words: ``key`` (``text_key``), ``n_removed``, ``kept`` (the other words, joined by one space)."""
    texts, rows = _segment_rows(docs, window, text_col)
    spans = _spans(rows, window)
    placed = rows.select("key", "start", "segment").join(spans, "segment")
    gathered = placed.groupBy("key").agg(F.collect_set(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("spans"))

    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for some, gone in batches:
            out = []
            for text, mine in zip(some, gone, strict=True):
                words = _encoded(text).split()
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, [s["a"] for s in mine], 1)
                np.add.at(edges, [s["b"] for s in mine], -1)
                keep = np.cumsum(edges[:-1]) == 0
                out.append((int((~keep).sum()), b" ".join([words[k] for k in np.flatnonzero(keep).tolist()]).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["n_removed", "kept"])

    told = F.pandas_udf(without, "n_removed long, kept string").asNondeterministic()(F.col("text"), F.col("spans"))
    found = materialize(texts.select("key", "text").join(gathered, "key").select("key", told.alias("x")).select("key", "x.n_removed", "x.kept"), "repeats-removed")
    for done in (texts, rows, spans):
        discard(done)
    return found


def remove_repeats(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW, into: str = "unrepeated") -> DataFrame:
    """``docs`` and a struct of n_words, n_removed and the kept text."""
    gone = removals(docs, text_col=text_col, window=window).select(F.col("key").alias("_key"), F.struct("n_removed", "kept").alias("_gone"))
    joined = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), text_key(F.col(text_col)).alias("_key")).join(gone, "_key", "left")
    text = F.col("row").getField(text_col)
    told = F.struct(word_count(text).alias("n_words"), F.coalesce("_gone.n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_gone.kept", plain(text)).alias("kept"))
    return joined.select("row", told.alias("told")).select("row.*", F.col("told").alias(into))


by_value(__name__)
