"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For a BPE model whose pieces have distinct scores, every prefix of a text has one
encoding, and so one last token.  The table holds that token for each prefix:

* an Aho-Corasick automaton over the pieces reports the pieces that end at a place;
* a piece is the last token of the prefix where the token before it (the table's entry
  at its start) is compatible: the merges, run on the two pieces' text alone, give back
  just these two.  The first compatible one, longest first, is the only one;
* the ids are recovered backwards from the end of the text.

Texts part where no piece can reach across: before a space that follows something else,
between letters and other characters where the model has no piece of both (checked when
it is loaded), and at characters that no piece has (these become byte pieces).  So words
are encoded one at a time, and a worker keeps the ids of words it has met lately.  Runs of several
spaces, whose pieces share one score, break ties by place instead of by piece; those
(and nothing else) are merged directly.

The model file is read with ``sentencepiece`` (pieces, scores, kinds); its encoder is
only used by the tests.  The model reaches the workers as bytes in a broadcast
(half a megabyte, fixed).

Defined results.  Null counts as empty; an empty text has no ids.  Repeated rows keep their rows.  Texts are
encoded whole, however long a word is (only the words that a worker keeps have a bound).  An empty table gives an empty
table.  Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_value

SPACE = "▁"
#: Words (in each of two generations) and pairs of pieces that a worker keeps, and the longest word it keeps.
CACHE_WORDS, CACHE_PAIRS, CACHE_WORD_CHARS = 250_000, 300_000, 64


class PieceBPE:
    """Encoder and decoder of one model; ``model`` is the model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids, self.rank, self.ids, self.bytes = [0] * 256, {}, {}, {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                value = int(p[3:5], 16)
                self.byte_ids[value] = i
                self.bytes[i] = value
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
                self.rank[p] = -sp.get_score(i)
        self.control = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.runs = {p for p in self.ids if len(p) > 1 and not p.strip(SPACE)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space inside: words can't be encoded one at a time")
        scores = [r for p, r in self.rank.items() if len(p) > 1 and p not in self.runs]
        if len(set(scores)) < len(scores):
            raise ValueError("two pieces share a score: a prefix's last token is not unique")
        self.chars = {c for p in self.ids for c in p}
        # letters, without those word characters of the model (superscripts and the like) that aren't
        odd = "".join(re.escape(c) for c in sorted(self.chars) if c.isalnum() and not c.isalpha() and not c.isdecimal())
        letter = f"[^\\W\\d_{odd}]"
        mixed = re.compile(f"{letter}(?!{letter}).|(?!{letter}).{letter}", re.S)
        by_class = not any(mixed.search(p.lstrip(SPACE)) for p in self.ids)
        self.parts = re.compile(f"{SPACE}*(?:{letter}+|(?:(?!{letter})[^{SPACE}])+)|{SPACE}+" if by_class else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.words: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.whole: dict[str, str] = {}  # words between single spaces that decode to themselves: their ids
        self.whole_older: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            # a piece that the merges never make is never a token
            if p not in self.runs and (len(p) == 1 or self.merge(p) == [p]):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """The merges themselves: best score first, leftmost among equals."""
        n, part = len(text), list(text)
        nxt, prv, live, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := self.rank.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if j >= n or part[i] != a or part[j] != b:
                continue
            part[i], live[j], nxt[i] = a + b, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [part[i] for i in range(n) if live[i]]

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def tokens(self, text: str) -> list[str]:
        """The encoding of a text of known characters without runs of spaces."""
        size = len(text)
        last: list[str | None] = [None] * (size + 1)  # the prefix table
        last[0] = ""
        pairs = self.pairs
        for end, piece in self.automaton.iter(text):  # by end, longest first
            end += 1
            if last[end] is not None:
                continue
            before = last[end - len(piece)]
            if before is None:
                continue
            if before == "":
                last[end] = piece
            elif (ok := pairs.get((before, piece))) or ok is None and self.compatible(before, piece):
                last[end] = piece
        out, end = [], size
        while end:
            out.append(last[end])
            end -= len(out[-1])
        out.reverse()
        return out

    def segment(self, word: str) -> list[int]:
        """Ids of one word with the spaces before it."""
        if self.chars.issuperset(word) and not word.startswith(SPACE * 2):
            return [self.ids[t] for t in self.tokens(word)]
        ids: list[int] = []
        at, n = 0, len(word)
        while at < n:
            if word[at] not in self.chars:
                ids.extend(self.byte_ids[b] for b in word[at].encode("utf-8", "replace"))
                at += 1
                continue
            end = at
            while end < n and word[end] in self.chars:
                end += 1
            known = word[at:end]
            tokens = self.merge(known) if known.startswith(SPACE * 2) else self.tokens(known)
            ids.extend(self.ids.get(t, self.unknown) for t in tokens)
            at = end
        return ids

    def words_of(self, text: str) -> list[str]:
        """The text with its dummy prefix and its spaces marked, parted where no piece reaches across."""
        return self.parts(SPACE + text.replace(" ", SPACE))

    def entry(self, word: str) -> tuple[str, int, str]:
        """(ids joined by commas, how many, what they decode to)."""
        got = self.older.get(word)
        if got is None:
            ids = self.segment(word)
            got = (",".join(map(str, ids)), len(ids), self.decode_raw(ids))
        if len(word) <= CACHE_WORD_CHARS:
            if len(self.words) >= CACHE_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = got
        return got

    def entries_of(self, parts: list[str]) -> list[tuple[str, int, str]]:
        out = list(map(self.words.get, parts))
        return [e if e is not None else self.entry(w) for e, w in zip(out, parts, strict=True)] if None in out else out

    def entries(self, text: str | None) -> list[tuple[str, int, str]]:
        return self.entries_of(self.words_of(text)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for e in self.entries(text) for i in e[0].split(",")]

    def decode_raw(self, ids: list[int]) -> str:
        """Pieces and byte runs as text; the dummy prefix is still there."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(_lenient(bytes(raw)))
                raw.clear()
            if i is not None and i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if text.startswith(" ") else text

    def whole_word(self, word: str) -> str | None:
        """Joined ids of a space and ``word``, or None where they don't decode to just that."""
        got = self.whole_older.get(word)
        if got is None:
            entries = self.entries_of(self.parts(SPACE + word))
            if "".join([e[2] for e in entries]) != " " + word:
                return None
            got = ",".join([e[0] for e in entries])
        if len(word) <= CACHE_WORD_CHARS:
            if len(self.whole) >= CACHE_WORDS:
                self.whole_older, self.whole = self.whole, {}
            self.whole[word] = got
        return got

    def whole_text(self, text: str | None) -> tuple[str, int, bytes]:
        """(ids joined by commas, how many, what they decode to) of a whole text."""
        if not text:
            return "", 0, b""
        if text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            words = text.split(" ")
            ids = list(map(self.whole.get, words))
            if None in ids:
                ids = [x if x is not None else self.whole_word(w) for x, w in zip(ids, words, strict=True)]
            if None not in ids:  # every word decodes to itself, so the text does
                joined = ",".join(ids)
                return joined, joined.count(",") + 1, text.encode()
        entries = self.entries(text)
        joined, whole = ",".join([e[0] for e in entries]), "".join([e[2] for e in entries])
        whole = whole[1:] if whole.startswith(" ") else whole
        return joined, sum([e[1] for e in entries]), whole.encode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, sha256 of the joined ids, sha256 of the decoded text) of a whole text."""
        joined, n, decoded = self.whole_text(text)
        return n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def ids_and_digest(self, text: str | None) -> tuple[np.ndarray, int, str, str]:
        joined, n, decoded = self.whole_text(text)
        ids = np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32)
        return ids, n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _lenient(raw: bytes) -> str:
    """UTF-8; each byte that is no part of a character becomes U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _held(model: bytes) -> PieceBPE:
    """One encoder per worker process and model, kept between tasks."""
    store = sys.__dict__.setdefault("_lodestone_models", {})
    key = hashlib.sha256(model).digest()
    if key not in store:
        store[key] = PieceBPE(model)
    return store[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver, where the tokenizer is installed
        return f.read()


def digest_column(text: Column, model: bytes, spark) -> Column:
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _held(shared.value)
        for texts in batches:
            yield pd.DataFrame([bpe.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.pandas_udf(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string").asNondeterministic()(text)


def ids_column(text: Column, model: bytes, spark) -> Column:
    """struct of the ids and their digests."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _held(shared.value)
        for texts in batches:
            yield pd.DataFrame([bpe.ids_and_digest(t) for t in texts], columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return F.pandas_udf(encoded, "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string").asNondeterministic()(text)


def encode_column(text: Column, model: bytes, spark) -> Column:
    """array<int> of the ids."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _held(shared.value)
        for texts in batches:
            yield pd.Series([np.array(bpe.encode(t), np.int32) for t in texts], dtype=object)

    return F.pandas_udf(encoded, "array<int>").asNondeterministic()(text)


def decode_column(ids: Column, model: bytes, spark) -> Column:
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _held(shared.value)
        for rows in batches:
            yield pd.Series([bpe.decode([int(i) for i in r]) if r is not None else None for r in rows], dtype=object)

    return F.pandas_udf(decoded, "string").asNondeterministic()(ids)


def encode_digests(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col), digest_column(F.col(text_col), model, docs.sparkSession).alias("_d"))
    return d.select(id_col, "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")


def encode_documents(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_digests`` with the ids themselves."""
    d = docs.select(F.col(id_col), ids_column(F.col(text_col), model, docs.sparkSession).alias("_d"))
    return d.select(id_col, "_d.ids", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")


by_value(__name__)
