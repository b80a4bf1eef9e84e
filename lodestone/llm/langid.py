"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one blank, and
the n-grams of 1 to ``ORDERS`` characters are hashed into ``2 ** bits`` features.

Training counts every n-gram of every whole training text: each task emits its sparse
(language, feature, count) sums, at most features x languages rows however much text it
read, and Spark adds them up.  The log-probability matrix (features x languages, add-one
smoothed, uniform over languages) is broadcast; its size is fixed by the parameters and
checked against ``MOST_BYTES`` before anything is collected.  Scoring is one sparse product a
batch, documents x features by features x languages, in numpy: the matrix rows of the batch's
n-grams, summed by document.  Log probabilities are held as whole multiples of 2 ** -20, so a
sum is the same in any order and however the batch is cut.

Defined results.  ``und`` with score 0 where the text is null or has no letter, or nothing
was learned.  Equal posteriors go to the language first by code point.  Repeated rows are learned and predicted
each.  Texts are read whole, in pieces that bound memory.  An empty table gives an empty table, and one to learn from
a model that says ``und``.  Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_value

BITS, ORDERS = 15, 3
#: Log probabilities are whole multiples of 1 / SCALE.
SCALE = 1 << 20
#: Languages whose counts a task holds before it hands them on.
HELD = 64
MOST_BYTES = 64 << 20
UNDETERMINED = "und"
#: Code points worked on at once.
PIECE = 1 << 18

_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def letters(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters; beyond U+3000 asked of Python, once per distinct one."""
    out = np.zeros(len(codes), bool)
    low = codes < 0x3000
    out[low] = _LETTER[codes[low]]
    if not low.all():
        distinct, where = np.unique(codes[~low], return_inverse=True)
        out[~low] = np.array([chr(c).isalpha() for c in distinct.tolist()])[where]
    return out


def grams(text: str, bits: int = BITS, orders: int = ORDERS) -> np.ndarray:
    """Hashed n-grams of a whole text, repeats included; empty without a letter."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters(codes)
    if not is_letter.any():
        return np.zeros(0, np.int32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # a blank after each run of letters
    first = int(is_letter.argmax())
    keep[first - 1] = True  # and one before the first
    c = np.where(is_letter, codes, 32)[keep].astype(np.uint32)
    found, h = [], np.zeros(len(c), np.uint32)
    for n in range(orders):
        h = (h[: len(c) - n] if n == 0 else h[:-1]) * np.uint32(0x01000193) + c[n:] + np.uint32(1)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((mixed >> np.uint32(32 - bits)).astype(np.int32) if n else (mixed >> np.uint32(32 - bits)).astype(np.int32)[is_letter[keep]])
    return np.concatenate(found)


@dataclass
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray  # features x languages, log probabilities times SCALE
    bits: int
    orders: int

    def totals(self, found: list[np.ndarray]) -> np.ndarray:
        """Log probabilities (documents x languages, times SCALE) of documents given by their n-grams: a sparse product."""
        out = np.zeros((len(found), len(self.languages)), np.int64)
        sizes = np.array([len(g) for g in found], np.int64)
        features = np.concatenate(found) if len(found) else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(found)), sizes)
        for at in range(0, len(features), PIECE):
            who = owner[at : at + PIECE]
            starts = np.flatnonzero(np.diff(who, prepend=-1))
            out[who[starts]] += np.add.reduceat(self.matrix[features[at : at + PIECE]], starts, axis=0, dtype=np.int64)
        return out

    def predict_batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, their posteriors) of a batch of texts."""
        found = [grams(t, self.bits, self.orders) if t else np.zeros(0, np.int32) for t in texts]
        known = np.array([len(g) > 0 for g in found], bool) & bool(self.languages)
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if known.any():
            total = self.totals(found)[known]
            best = total.argmax(axis=1)
            apart = (total - total[np.arange(len(best)), best][:, None]) / SCALE
            scores[known] = 1.0 / np.exp(np.maximum(apart, -700)).sum(axis=1)
            for k, b in zip(np.flatnonzero(known).tolist(), best.tolist(), strict=True):
                names[k] = self.languages[b]
        return names, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        names, scores = self.predict_batch([text])
        return names[0], float(scores[0])


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, orders: int = ORDERS) -> LanguageModel:
    """Count every n-gram of every row with a language, then take logarithms."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["t"], pdf["l"], strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(size, np.int64)
                if len(g := grams(text, bits, orders)):
                    sums[lang] += np.bincount(g, minlength=size)
                if len(sums) >= HELD:
                    yield from told(sums)
                    sums.clear()
        yield from told(sums)

    def told(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, s in sums.items():
            f = np.flatnonzero(s)
            yield pd.DataFrame({"l": [lang] * (len(f) + 1), "f": np.append(f, -1), "n": np.append(s[f], 0)})

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    most = MOST_BYTES // (size * 4)
    if len(rows.select("l").distinct().limit(most + 1).take(most + 1)) > most:
        raise ValueError(f"more than {most} languages of {size} features are more than {MOST_BYTES} bytes")
    sums = rows.mapInPandas(count, "l string, f int, n long").groupBy("l", "f").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("l").agg(F.collect_list(F.struct("f", "n")).alias("x"))  # at most 2 ** bits + 1 entries a language
    got = {r["l"]: r["x"] for r in packed.collect()}
    names = sorted(got)
    counts = np.zeros((size, len(names)))
    for k, name in enumerate(names):
        pairs = np.array([(e["f"], e["n"]) for e in got[name]], np.int64)
        pairs = pairs[pairs[:, 0] >= 0]
        counts[pairs[:, 0], k] = pairs[:, 1]
    matrix = np.rint(np.log((counts + 1) / (counts + 1).sum(axis=0)) * SCALE).astype(np.int32)
    return LanguageModel(names, matrix, bits, orders)


def predict_column(model: LanguageModel, text: Column, spark) -> Column:
    """struct<lang_pred, score>."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.matrix, model.bits, model.orders))

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = LanguageModel(*shared.value)
        for texts in batches:
            names, scores = m.predict_batch(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(predicted, "lang_pred string, score double").asNondeterministic()(text)


by_value(__name__)
