"""SimHash near-duplicates by pivot distance tables.

Fingerprints are 64 majority bits over the XXH64 hashes of a text's word shingles.
Two fingerprints are linked at ``radius`` or fewer differing bits; documents of
linked fingerprints form classes.

How pairs are found, exactly and without comparing all of them:

* Equal fingerprints are one item from the start (a class of copies costs one row).
* Blocks.  A pair within ``radius`` bits agrees on at least one of ``radius + 1``
  disjoint bit ranges, so each fingerprint is dealt once per range, keyed by that
  range's bits.  A block with more than ``HOT`` items is dealt again by two ranges
  (and then three): a pair differing in at most ``radius`` bits also agrees on one of
  ``radius + 1`` sub-ranges of the remaining bits, so nothing is lost.
* Pivot table.  In a block, the Hamming distances to ``PIVOTS`` reference
  fingerprints are computed once per item.  By the triangle inequality no coordinate
  of a linked pair differs by more than ``radius``: a block is sorted by its first
  coordinate, only a window of it is looked at, and pairs whose largest coordinate
  difference exceeds ``radius`` are discarded before the bits themselves are compared.
* A block yields a spanning forest of its links, at most one row per item, so dense
  groups never become all their pairs.

A pivot table by itself prunes the pairs but still visits each of them; the bit
ranges are what keeps the visits near linear.

Defined results.  Null and blank texts have fingerprint zero, linked like any other.
Repeated rows keep their rows; a null id is kept, and is no component's smallest id
unless all ids of the component are null.  Texts count whole, in pieces that bound memory.  An empty table gives
an empty table.  Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_value, materialize
from .components import connected_components

SEED, SHINGLE, RADIUS, PIVOTS = 42, 3, 3, 16
#: Items of a block from which on it is dealt again by finer keys.
HOT = 4096
#: Shingles hashed at once; longer texts are summed piece by piece.
PIECE = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, PIECE):
        part = words[at : at + PIECE + width - 1]
        h = np.array([digest(x, SEED) for x in map(join, zip(*(part[k:] for k in range(width)), strict=False))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, spark) -> Column:
    """Signed 64-bit fingerprints, null as the empty text."""
    bound_batches(spark)

    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(prints, "long").asNondeterministic()(text)


def _ranges(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), parts)]


def _dealings(radius: int, depth: int) -> list[list[int]]:
    """Bit sets to deal by at a depth: every choice of one range, one sub-range of the other bits, and so on."""
    out: list[list[int]] = [[]]
    for _ in range(depth):
        out = [chosen + r for chosen in out for r in _ranges([b for b in range(64) if b not in set(chosen)], radius + 1)]
    return out


def _mask(bits: list[int]) -> int:
    m = sum(1 << int(b) for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit values."""
    return np.random.default_rng(2024).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def pivot_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)


def block_links(prints: np.ndarray, radius: int = RADIUS, refs: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one block, as index pairs.

    Items not yet reached are searched breadth first: each item is compared once with
    those still unreached, through the pivot window, the table, then its bits.
    """
    refs = pivots() if refs is None else refs
    n = len(prints)
    if n < 2:
        return []
    table = pivot_table(prints, refs)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    first, links = table[:, 0].copy(), []
    alive, queue, at = np.ones(n, bool), [], 0
    left = np.searchsorted(first, first - radius, "left")
    right = np.searchsorted(first, first + radius, "right")
    while True:
        if not queue:
            while at < n and not alive[at]:
                at += 1
            if at >= n:
                break
            alive[at] = False
            queue.append(at)
        i = queue.pop()
        lo, hi = left[i], right[i]
        near = lo + np.flatnonzero(alive[lo:hi])
        if len(near):
            near = near[np.abs(table[near, 1:4] - table[i, 1:4]).max(axis=1) <= radius]
        if len(near):
            near = near[np.abs(table[near] - table[i]).max(axis=1) <= radius]
            near = near[np.bitwise_count(prints[near] ^ prints[i]) <= radius]
            alive[near] = False
            queue.extend(near.tolist())
            links += [(int(order[i]), int(order[j])) for j in near]
    return links


def small_links(keys: np.ndarray, prints: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small blocks at once; rows come sorted by key."""
    a, b, k = [], [], 1
    while True:
        i = np.flatnonzero(keys[:-k] == keys[k:]) if k < len(keys) else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + k
        ok = np.abs(table[i] - table[j]).max(axis=1) <= radius
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        a.append(prints[i[ok]])
        b.append(prints[j[ok]])
        k += 1
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


#: Blocks up to this size are compared side by side.
SMALL = 12


def _search(radius: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block; blocks may run over several batches."""
        refs, held = pivots(), []

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            deal, key, fp = rows["deal"].to_numpy(), rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            block = np.concatenate([[0], np.cumsum((deal[1:] != deal[:-1]) | (key[1:] != key[:-1]))])
            size = np.bincount(block)
            a, b = [], []
            few = (size[block] > 1) & (size[block] <= SMALL)
            if few.any():
                x, y = small_links(block[few], fp[few], pivot_table(fp[few], refs), radius)
                a.append(x)
                b.append(y)
            starts = np.concatenate([[0], np.cumsum(size)])
            for g in np.flatnonzero(size > SMALL):
                own = fp[starts[g] : starts[g + 1]]
                if pairs := block_links(own, radius, refs):
                    p = np.array(pairs)
                    a.append(own[p[:, 0]])
                    b.append(own[p[:, 1]])
            if not a:
                return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
            return pd.DataFrame({"src": np.concatenate(a).view(np.int64), "dst": np.concatenate(b).view(np.int64)})

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            last = (pdf["deal"].iloc[-1], pdf["key"].iloc[-1])
            if (held[0]["deal"].iloc[0], held[0]["key"].iloc[0]) == last:
                continue  # all one block so far
            rows = pd.concat(held, ignore_index=True)
            cut = ((rows["deal"] == last[0]) & (rows["key"] == last[1])).to_numpy()
            held = [rows[cut]]
            yield found(rows[~cut])
        if held:
            yield found(pd.concat(held, ignore_index=True))

    return links


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (src, dst) among distinct fingerprints (column ``fp``, signed 64-bit)."""
    spark = distinct.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20_000)  # rows of three numbers
    out, todo = None, distinct.select("fp")
    for depth in (1, 2, 3):
        deals = [_mask(x) for x in _dealings(radius, depth)]
        dealt = todo.select("fp", F.posexplode(F.array(*[F.lit(m) for m in deals])).alias("deal", "mask")).select("fp", "deal", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        if depth < 3:
            sizes = dealt.groupBy("deal", "key").count().where(F.col("count") > HOT)
            hot = materialize(sizes.select("deal", "key"), "simhash-hot")
            crowded = bool(hot.head(1))
        else:
            crowded = False
        if crowded:
            searched, rest = dealt.join(hot, ["deal", "key"], "left_anti"), dealt.join(hot, ["deal", "key"], "left_semi").select("fp").distinct()
        else:
            searched, rest = dealt, None
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        part = searched.repartition(n, "deal", "key").sortWithinPartitions("deal", "key", "fp").mapInPandas(_search(radius), "src long, dst long")
        out = part if out is None else out.unionAll(part)
        if rest is None:
            break
        todo = materialize(rest, "simhash-rest")
    return out


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component): the smallest id of each distinct fingerprint's class; ``prints`` has ``id`` and ``fp``."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    classes = connected_components(links(distinct, radius))
    joined = distinct.join(classes, distinct["fp"] == classes["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable)."""
    prints = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), docs.sparkSession).alias("fp")), "simhash-prints")
    found = components(prints, radius)
    return prints.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


by_value(__name__)
