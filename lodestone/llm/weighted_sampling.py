"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words with their counts.  For each of ``SAMPLES``
independent draws k and each term, three numbers belong to (term, k) alone:
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) (Ioffe, 2010).  With weight w

    t = floor(ln w / r + b),   ln a = ln c - r * (t - b + 1)

and the sample is the term with the smallest a, together with its t.  Two texts agree
on a sample with probability equal to their generalised Jaccard similarity,
sum of minima over sum of maxima.  Each sample is kept as 32 hashed bits.

The draws come from one 64-bit hash of (term hash, k): 16 bits of it pick r among the quantiles of its
distribution, 16 bits c, 24 bits are b, so a term has the same draws on every machine.  The smallest c
decide who wins in a text of many terms, so within the lowest quantile c is worked out from 53 further
bits.  Draws are made once for each term of a text, so memory is bounded by the piece, not the vocabulary.

Neighbours.  Each document also meets the next one in descending id order.  Ids are cut
into ranges by quantiles; a text is shuffled once, with its range; a range's last row
needs the first row of the range below, which is sent to both (one extra row a range).

Defined results.  Null text is empty; an empty text has a fingerprint of its own (all
samples of "no term").  Repeated ids follow one another by text.  Null ids come last, by a hash of the
text, then the text; however many they are, they are cut into ranges too.
One document alone is its own next.  Texts count whole, however long.  An empty table gives an empty table.
Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_value

SAMPLES, QUANTILE_BITS = 64, 16
#: (document, term) pairs of which the draws are worked out at once.
PAIRS = 4096


def gamma_quantiles(bits: int = QUANTILE_BITS) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the midpoints of 2**bits equal parts, by Newton's method on 1 - (1 + x) e^-x."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.where(p < 0.5, np.sqrt(2 * p), 2 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x) + 1e-300), x / 4)
    return x


def _mix64(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def low_tail(h: np.ndarray) -> np.ndarray:
    """Logs of Gamma(2, 1) values below the first quantile, from 64 random bits: 1 - (1 + x) e^-x = x^2 (1/2 - x/3 + x^2/8 - ...)."""
    p = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (2.0**-53 / (1 << QUANTILE_BITS))
    x = np.sqrt(2 * p)
    for _ in range(3):
        x = np.sqrt(2 * p / (1 - 2 * x / 3 + x * x / 4))
    return np.log(x)


class Sampler:
    def __init__(self, samples: int = SAMPLES):
        q = gamma_quantiles()
        self.r, self.log_c = q.astype(np.float32), np.log(q).astype(np.float32)
        self.keys = _mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.samples = samples
        self.mask = np.uint64((1 << QUANTILE_BITS) - 1)

    def draws(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(r, ln c, b) of each (term, sample)."""
        h = terms[:, None] ^ self.keys[None, :]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        bits = np.uint64(QUANTILE_BITS)
        r = self.r[h & self.mask]
        at_c = (h >> bits) & self.mask
        log_c = self.log_c[at_c]
        lowest = np.flatnonzero(at_c == 0)
        if len(lowest):
            log_c.ravel()[lowest] = low_tail(_mix64(h.ravel()[lowest] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        b = ((h >> (bits + bits)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(1 / (1 << 24))
        return r, log_c, b

    def sketch(self, terms: np.ndarray, log_weights: np.ndarray) -> np.ndarray:
        """uint32 samples of one weighted set; ``terms`` sorted and distinct."""
        if not len(terms):
            return np.zeros(self.samples, np.uint32)
        best, chosen, level = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        every = np.arange(self.samples)
        for at in range(0, len(terms), PAIRS):
            part = terms[at : at + PAIRS]
            r, log_c, b = self.draws(part)
            t = np.floor(log_weights[at : at + PAIRS, None] / r + b)
            log_a = log_c - r * (t - b + np.float32(1))
            i = log_a.argmin(axis=0)
            low = log_a[i, every]
            better = low < best
            best[better], chosen[better], level[better] = low[better], part[i][better], t[i, every][better].astype(np.int64)
        return (_mix64(chosen + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def weighted_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, sorted; logs of their counts) of a whole text."""
    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").split()
    terms, counts = np.unique(np.fromiter(map(digest, words), np.uint64, len(words)), return_counts=True)
    return terms, np.log(counts).astype(np.float32)


def hex_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(value, bounds: list[int]):
    """How many cut points lie below the value, by binary search in the plan."""
    if not bounds:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")  # folded to one constant
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(cuts, mid) < value, F.lit(False))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(steps, state, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, out, schema: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``out(rows)`` to batches of (id, text, next text), next by descending id, after the last the first.

    ``out`` makes a function from an iterator of lists of such triples to an iterator of frames.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    # ids are cut at their quantiles; rows without one, if many, by the hash that orders them
    seen = base.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 20_000).alias("q"), F.count(F.lit(1)).alias("n"), F.count("id").alias("ids")).first()
    bounds = sorted(set(seen["q"] or []))
    loose = -(-(seen["n"] - seen["ids"]) * parts // max(1, seen["n"]))
    h = F.xxhash64("text", F.lit(5))
    spread = F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * loose), F.lit(max(0, loose - 1))).cast("int")
    base = base.withColumns({"ord": F.coalesce("id", h), "part": F.when(F.col("id").isNull(), spread - loose).otherwise(_range_of(F.col("id"), bounds))})
    # the top of each range: one small row a range, at most twice ``parts``; its text goes to the range above as well
    tops = sorted((r["part"], r["top"]) for r in base.select("part", "ord").groupBy("part").agg(F.max("ord").alias("top")).collect())
    rows = [(p, t, tops[(k + 1) % len(tops)][0]) for k, (p, t) in enumerate(tops)]  # the first range's top closes the last range
    goes = F.broadcast(spark.createDataFrame(rows, "part int, top long, above int"))
    own, ghost = (F.struct(F.col(c).alias("part"), F.lit(n).alias("ghost")) for c, n in (("part", 0), ("above", 1)))
    both = base.join(goes, "part").select("id", "text", "ord", F.explode(F.when(F.col("ord") == F.col("top"), F.array(own, ghost)).otherwise(F.array(own))).alias("x"))
    # a task for each range, so that tasks are as even as the ranges
    dealt = both.select("id", "text", "ord", "x.*").repartitionById(loose + len(bounds) + 1, F.col("part") + loose).sortWithinPartitions("part", "ghost", F.col("ord").desc(), "text")
    work = out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def triples():
            held, closed = None, None  # the row that waits for its next; a range already closed by its ghost
            for pdf in batches:
                out_rows = []
                for ident, text, part, ghost in zip(pdf["id"], pdf["text"], pdf["part"], pdf["ghost"], strict=True):
                    if part == closed:
                        continue  # further ghosts of repeated ids
                    if held is not None:
                        out_rows.append((held[0], held[1], text))
                    if ghost:
                        held, closed = None, part
                    else:
                        held = (ident, text)
                yield out_rows
            assert held is None, "a range without its closing row"

        yield from work(triples())

    return dealt.mapInPandas(run, schema)


SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows):
    """Fingerprints of each text, its edited text and its next one."""
    sampler, known = Sampler(), {}
    for batch in rows:
        out = []
        for ident, text, following in batch:
            own = known.get(text)
            if own is None:
                own = sampler.sketch(*weighted_terms(text))
            nxt = sampler.sketch(*weighted_terms(following))
            known = {following: nxt}  # the next row's own
            changed = edited(text, following)
            sketch = sampler.sketch(*weighted_terms(changed))
            out.append((ident, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hex_of(own), hex_of(sketch), likeness(own, sketch), likeness(own, nxt)))
        frame = pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        frame["id"] = frame["id"].astype("Int64")
        yield frame


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, its edited form, and their likenesses."""
    return with_next(docs, _compare, SCHEMA, id_col=id_col, text_col=text_col).withColumnRenamed("id", id_col)


by_value(__name__)
