"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over hashed, binary text features: every distinct word
of the lower-cased text and its opening 4 and 5 letters.  It is fitted with the
non-negative PU risk (Kiryo et al., 2017)

    pi * R_pos(+1)  +  max(0, R_unl(-1) - pi * R_pos(-1))

with the logistic loss: confirmed toxic examples on one side, unlabelled text on
the other, and the class prior ``pi`` correcting for the toxic texts hidden among
the unlabelled.  Where a batch's corrected negative risk falls below zero it is held at
zero, as the estimator asks, and that part has no gradient.

Sizes.  The fit takes a bounded sample of the labelled rows: at most ``max_positive`` confirmed
examples, and as unlabelled text at most ``max_unlabelled`` of all labelled rows, whose labels the
fit doesn't see; both by the smallest hash of the id, both parameters.  The prior is the share of label 1
among the labelled rows, so it is that of the unlabelled sample.  Features are counted and chosen by Spark; what
reaches the driver is the chosen features' ids, a short list a sampled row.  Scoring runs over
every whole text, narrow, without a shuffle; the broadcast is one array of
``2 ** bits`` floats.

Defined results.  Null text counts as empty; an empty text gets the intercept's
score.  Rows with a null id are scored, never learned from.  Repeated label rows
count once; repeated documents are scored each.  Without one confirmed example every score is 0.  Texts are read
whole, in pieces that bound memory.  An empty table gives an empty table.  Columns besides id and text are
not read, so their names may clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_value, discard, materialize

#: Odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Code points hashed at once; longer texts go through in pieces of at least so many that end before a blank, so words stay whole.
PIECE = 1 << 20
_BLANK = re.compile("[ \t\n\r]")
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


_LETTERS = np.array([chr(c).isalnum() or c == 95 for c in range(0x3000)])


def _is_word(codes: np.ndarray) -> np.ndarray:
    out = codes >= 0x3000  # beyond the table: ideographs and the like count as letters
    low = ~out
    out[low] = _LETTERS[codes[low]]
    return out


def text_features(text: str | None, bits: int) -> np.ndarray:
    """Sorted distinct feature ids of a whole text: its words, and their first 4 and 5 letters."""
    text = (text or "").lower()
    found = []
    at = 0
    while at < len(text):
        end = len(text)
        if (blank := _BLANK.search(text, at + PIECE)) is not None:
            end = blank.start()
        codes, at = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32), end
        edges = np.flatnonzero(np.diff(_is_word(codes).astype(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        up, down = _powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        for salt, width in ((1, None), (2, 4), (3, 5)):
            s, e = starts, ends
            if width:
                keep = ends - starts >= width
                s, e = starts[keep], starts[keep] + width
            h = (sums[e] - sums[s]) * down[s] + np.uint64(salt)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            found.append((h >> np.uint64(64 - bits)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class PUModel:
    weights: np.ndarray
    bias: float
    bits: int
    prior: float

    def score(self, features: np.ndarray) -> float:
        if self.bias == -np.inf:  # nothing was confirmed, so nothing is toxic
            return 0.0
        z = self.bias + float(self.weights[features].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0))))


def _pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(lengths)])


def _margins(weights: np.ndarray, bias: float, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[ids], dtype=np.float64)])
    return bias + total[starts[1:]] - total[starts[:-1]]


def select_features(counts: DataFrame, n_p: int, n_u: int, least_z: float = 4.0) -> DataFrame:
    """(f): the features whose document frequencies part the samples, by a two-proportion z; ``counts``: f, p, u."""
    p, u = F.col("p") / n_p, F.col("u") / max(1, n_u)
    pooled = (F.col("p") + F.col("u") + 0.5) / (n_p + n_u + 1)
    z = (p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / max(1, n_u)))
    return counts.where(((F.col("p") >= 3) | (F.col("u") >= 3)) & (F.abs(z) >= least_z)).select("f")


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, kept: np.ndarray, bits: int = 18, epochs: int = 12, batch: int = 512, rate: float = 0.03, l1: float = 1e-3, seed: int = 7, start: bool = True, non_negative: bool = True) -> PUModel:
    """Adam on the non-negative risk over the features ``kept``; an l1 shrinkage keeps chance features near zero.

    ``start=False`` begins at zero instead of at half the log ratio, ``non_negative=False`` leaves the risk
    unbounded below: for comparison.
    """
    size, rng = 1 << bits, np.random.default_rng(seed)
    weights = np.zeros(size, np.float32)
    if not positive:
        return PUModel(weights, -np.inf, bits, prior)
    place = np.full(size, -1, np.int64)
    place[kept] = np.arange(len(kept))
    positive, unlabelled = ([(p := place[x])[p >= 0] for x in rows] for rows in (positive, unlabelled))
    n = len(kept)
    # start: half the log ratio of a feature's rates among toxic and, prior taken out, other texts; last the intercept
    rate_p = (np.bincount(np.concatenate(positive), minlength=n) + 0.5) / (len(positive) + 1)
    rate_u = (np.bincount(np.concatenate(unlabelled or positive[:0] or [np.zeros(0, np.int64)]), minlength=n) + 0.5) / (len(unlabelled) + 1)
    rate_n = np.maximum((rate_u - prior * rate_p) / (1 - prior), 0.5 / (len(unlabelled) + 1))
    w = np.append(np.clip(0.5 * np.log(rate_p / rate_n), -3, 3) * start, np.log(prior / (1 - prior)))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    per_epoch = max(4, -(-len(unlabelled) // batch))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for _ in range(epochs):
        order_u = rng.permutation(len(unlabelled))
        order_p = rng.permutation(len(positive))
        for k in range(per_epoch):
            pos = [positive[i] for i in order_p[k::per_epoch]] or [positive[int(rng.integers(len(positive)))]]
            unl = [unlabelled[i] for i in order_u[k::per_epoch]]
            (pi_, ps), (ui, us) = _pack(pos), _pack(unl)
            zp, zu = _margins(w[:-1], w[-1], pi_, ps), _margins(w[:-1], w[-1], ui, us)
            # logistic losses: l(z, +1) = log(1 + e^-z), l(z, -1) = log(1 + e^z)
            negative = (np.logaddexp(0, zu).mean() if len(unl) else 0.0) - prior * np.logaddexp(0, zp).mean()
            gp, gu = -prior * sigmoid(-zp) / len(pos), sigmoid(zu) / max(1, len(unl))
            if negative >= 0 or not non_negative:
                gp = gp - prior * sigmoid(zp) / len(pos)
            else:  # the estimate fell below zero, its floor: that part is flat, and only the positive risk pulls
                gu = 0 * gu
            grad = np.bincount(pi_, np.repeat(gp, np.diff(ps)), n + 1) + np.bincount(ui, np.repeat(gu, np.diff(us)), n + 1)
            grad[-1] = gp.sum() + gu.sum()
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * l1, 0)
    weights[kept] = w[:-1]
    return PUModel(weights, float(w[-1]), bits, prior)


def samples(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 6000, max_unlabelled: int = 9000, bits: int = 18) -> tuple[list[np.ndarray], list[np.ndarray], float, np.ndarray]:
    """(confirmed, unlabelled, share of label 1, chosen features): the samples as sorted lists of chosen features' ids."""
    bound_batches(docs.sparkSession)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    counts = marks.agg(F.count("_y").alias("n"), F.sum("_y").alias("p")).first()
    if not counts["p"]:
        return [], [], 0.0, np.zeros(0, np.int64)
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen_p = marks.where("_y = 1").orderBy(*order).limit(max_positive).select("_id", F.lit(1).alias("_side"))
    chosen_u = marks.where("_y is not null").orderBy(*order).limit(max_unlabelled).select("_id", F.lit(0).alias("_side"))
    # at most max_positive + max_unlabelled rows of two numbers: small enough to broadcast by construction
    chosen = F.broadcast(chosen_p.unionByName(chosen_u))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").select("_id", "_side", "_text")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["_id"].astype("string"), "side": pdf["_side"], "f": [text_features(t, bits) for t in pdf["_text"]]})

    found = materialize(sample.mapInPandas(featurise, "id string, side int, f array<int>"), "toxic-sample")
    sizes = {r["side"]: r["count"] for r in found.groupBy("side").count().collect()}
    if not sizes.get(1):
        return [], [], 0.0, np.zeros(0, np.int64)
    df = found.select("side", F.explode("f").alias("f")).groupBy("f").agg(F.count_if(F.col("side") == 1).alias("p"), F.count_if(F.col("side") == 0).alias("u"))
    kept = np.array(sorted(r["f"] for r in select_features(df, sizes[1], sizes.get(0, 0)).collect()), np.int64)  # at most 2 ** bits

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "side": pdf["side"], "f": [np.intersect1d(f, kept).astype(np.int32).tobytes() for f in pdf["f"]]})

    rows = sorted(found.mapInPandas(narrow, "id string, side int, f binary").collect(), key=lambda r: (r["side"], r["id"], bytes(r["f"])))
    discard(found)
    of = lambda side: [np.frombuffer(bytes(r["f"]), np.int32) for r in rows if r["side"] == side]
    return of(1), of(0), counts["p"] / counts["n"], kept


def train(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, bits: int = 18, fit: dict | None = None, **options) -> PUModel:
    """Fit on bounded samples: ``labels`` names the rows that may be learned from (see ``samples``).

    Rows with label 1 are confirmed; all labelled rows, theirs among them, are the unlabelled text, and
    their labels only give the class prior.  ``fit``: options of ``fit_nnpu``.
    """
    positive, unlabelled, share, kept = samples(docs, labels, bits=bits, **options)
    pi = prior if prior is not None else min(0.5, max(0.01, share))
    return fit_nnpu(positive, unlabelled, pi, kept, bits, **(fit or {}))


def score_column(model: PUModel, text: Column, spark) -> Column:
    """A column of scores; the model travels as one broadcast array of fixed size."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.bits, model.prior))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = PUModel(*shared.value)
        for texts in batches:
            yield pd.Series([m.score(text_features(t, m.bits)) for t in texts], dtype="float64")

    return F.pandas_udf(scored, "double").asNondeterministic()(text)


def score(docs: DataFrame, model: PUModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col), score_column(model, F.col(text_col), docs.sparkSession).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


by_value(__name__)
