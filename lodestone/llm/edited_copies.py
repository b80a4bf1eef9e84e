"""Classes of near-duplicate texts: five-word shingles, similarity 0.8 or more.

Two texts are linked where

* the SimHash fingerprints of their sets of five-word shingles differ in at most ``simhash.RADIUS`` bits
  (found by ``simhash.links``: pivot distance tables within equal bit ranges), or
* those sets have Jaccard similarity >= 0.8, exactly.

SimHash alone can't find the second kind: at similarity 0.8 about 10 of 64 bits differ, and at a
radius that holds them a pivot table, whose coordinates of unrelated texts differ by some 6 bits,
discards nothing.  So its links come first (most copies, at the price of one number a text), and
what they leave is found by prefixes:

* Equal sets are one item from the start.
* In any order of the shingles that all sets share, two sets of similarity ``t`` have one of their
  first ``n - ceil(t * n) + 1`` shingles in common (``n``: the own size).  Only these are dealt out.
  The order puts shingles that are frequent in a sample last; the sample decides what is cheap, not
  what is found.
* Of a shingle's sets, neighbours by size and by parities come first.  What they and SimHash link makes
  classes; after that only pairs of sets in different classes are still candidates, so a group of
  copies does not become all its pairs.  Sizes and the sets' parities exclude pairs that can't reach
  ``t``: every shingle flips one of so many bits, so two sets differ in at least as many shingles as
  their parities differ in bits, and at similarity 0.8 in at most a ninth of both sizes.  Rows carry
  ``NARROW`` bits, pairs that pass meet ``WIDE`` ones.
* ``NARROW`` bits say nothing of thousands of shingles, so a set of more than ``SPLIT`` is split by hash into parts of
  at most about as many, each with its own prefix and parities.  What two sets differ in is the sum over the parts, so sets of
  similarity ``t`` have a part of similarity ``t`` or more.  A set whose larger partners are split finer is dealt out that way too, as a guest.
* All that two sets share lies at or behind their first common shingle.  Rows carry its place, so a pair is only
  made where enough is left behind it on both sides.
* A shingle of more than ``CROWD`` sets is split: its neighbours are looked for within ``PLACES``, and the rest
  is compared block by block, each pair of blocks of at most some ``CROWD`` sets in a task of its own, by vectors; only pairs that pass
  leave the task.  No exact way is known that spares the comparing where many sets are just below the similarity.
* Candidates are compared on their whole texts: each set with its nearest first, then the others that
  are still in different classes.

Links are transitive: documents of linked sets form classes.

Defined results.  Words are those of ``simhash.fingerprint``; a text of fewer than five is one shingle.
Null and blank texts have the empty set and are one class.  Equal rows share a key, so they are one
item.  A null id counts as the largest.  Texts are read whole, in pieces that bound memory.  An empty table has no class.
Other columns, of any name and type, are only read for the row's key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import bound_batches, by_value, discard, hashable, materialize, row_key
from .components import connected_components

#: Hashes whose bits are counted at once.
PIECE = 1 << 16
#: Similarity PART / WHOLE; shingles are hashed to 64 bits.
WIDTH, PART, WHOLE, SEED = 5, 4, 5, 42
#: Texts that are compared whole are found by a broadcast of their keys, some 50 bytes each, up to this many; beyond, by a shuffle.
FEW = 100_000
#: Orders of a shingle's sets, and how many places on each is compared with in each; besides, all are with the first.
ORDERS, REACH = (("n",), ("x0",), ("x1", "x2")), 10
#: Sets of a shingle beyond which it is split, into places (neighbours) and pairs of blocks of so many sets (the rest).
CROWD, PLACES, TILE = 4096, 64, 512
#: Bits of a set's parities: in every row of a block, and for pairs.
NARROW, WIDE = 512, 8192
#: Shingles beyond which a set is split, into twice as many parts each time.
SPLIT = 512
#: Documents sampled for the order, and the most frequent shingles that it puts last.
SAMPLE, FREQUENT = 10_000, 50_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = [words] if len(words) < width else zip(*(words[k:] for k in range(width)), strict=False)
    return np.unique(np.array([digest(x, SEED) for x in map(join, runs)], np.uint64))


def fingerprint(found: np.ndarray) -> int:
    """Majority bits over a set of shingle hashes, as a signed number; no shingle: zero."""
    if not len(found):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), PIECE):
        ones += np.unpackbits(found[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def parities(found: np.ndarray, bits: int = WIDE) -> np.ndarray:
    """Whether an odd number of the set's hashes fall on each of so many bits, as signed numbers."""
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_column(text: Column, spark) -> Column:
    bound_batches(spark)

    def wide(texts: pd.Series) -> pd.Series:
        return pd.Series([parities(shingles(t)) for t in texts], dtype=object)

    return F.pandas_udf(wide, "array<long>")(text)


def alike_column(a: Column, b: Column, spark) -> Column:
    """Whether two texts' sets reach the similarity."""
    bound_batches(spark)

    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_alike(shingles(x), shingles(y)) for x, y in zip(left, right, strict=True)], dtype=bool)

    return F.pandas_udf(alike, "boolean")(a, b)


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) * (PART + WHOLE) >= (len(a) + len(b)) * PART


def shingle_column(text: Column, spark) -> Column:
    bound_batches(spark)

    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)

    return F.pandas_udf(sets, "array<long>")(text)


def frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; their documents) of the most frequent shingles of a sample."""
    every = max(1, -(-docs.count() // SAMPLE))
    sample = docs.where(F.pmod(F.xxhash64(*hashable(docs)), F.lit(every)) == 0)
    counts = sample.select(F.explode(shingle_column(F.col(text_col), docs.sparkSession)).alias("h")).groupBy("h").count().where("count > 3")
    rows = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    rows = rows.assign(h=rows["h"].to_numpy(np.int64).view(np.uint64)).sort_values("h")
    return rows["h"].to_numpy(np.uint64), rows["count"].to_numpy(np.int64)


def _level(n: int) -> int:
    """How often a set of ``n`` shingles is halved."""
    return (max(0, n - 1) // SPLIT).bit_length()


def dealt_parts(found: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple:
    """A set's number of parts, and of these and then the finer ones that it is a guest in: sizes, parities, and the prefixes' shingles, parts and places.

    A prefix has a part's first shingles, by frequency, then by hash.
    """
    n, own = len(found), _level(len(found))
    order = found
    if len(often) and n:
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        order = found[np.argsort(np.where(often[at] == found, counts[at], 0), kind="stable")]
    before, out = 0, []
    for level in range(own, _level(n * WHOLE // PART) + 1):  # no similar set is larger
        many = 1 << level
        part = (order >> np.uint64(20)).astype(np.int64) & (many - 1)
        sizes = np.bincount(part, minlength=many)
        odd = np.bincount(part * NARROW + (order % np.uint64(NARROW)).astype(np.int64), minlength=many * NARROW) & 1
        by = np.argsort(part, kind="stable")
        part = part[by]
        place = np.arange(n) - (np.cumsum(sizes) - sizes)[part]
        first = place < (sizes + (-PART * sizes // WHOLE) + 1)[part]
        tok = order[by][first] ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))  # shingles of one level don't meet another's
        out.append((sizes, np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), tok.view(np.int64), before + part[first], place[first]))
        before += many
    return 1 << own, *(np.concatenate(x) if len(out) > 1 else x[0] for x in zip(*out, strict=True))


def _signed(text: Column, often: np.ndarray, counts: np.ndarray, spark) -> Column:
    """struct<set: 16 bytes, n, fp, and what ``dealt_parts`` gives>"""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((often, counts))  # at most FREQUENT entries

    def signed(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t) for t in texts]
        own, sizes, odd, tok, part, at = zip(*(dealt_parts(s, *shared.value) for s in found), strict=True)
        return pd.DataFrame({
            "set": [xxhash.xxh3_128_digest(s.tobytes()) for s in found],
            "n": np.array([len(s) for s in found], np.int32),
            "fp": np.array([fingerprint(s) for s in found], np.int64),
            "own": np.array(own, np.int32),
            "sizes": [x.astype(np.int32) for x in sizes],
            "odd": list(odd),
            "tok": list(tok),
            "part": [x.astype(np.int32) for x in part],
            "at": [x.astype(np.int32) for x in at],
        })

    kind = "set binary, n int, fp long, own int, sizes array<int>, odd array<long>, tok array<long>, part array<int>, at array<int>"
    return F.pandas_udf(signed, kind).asNondeterministic()(text)


def _shared(batches):
    """Rows come sorted by shingle: those whose shingle is another set's too."""
    held = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        tok = pdf["tok"].to_numpy()
        same = tok[1:] == tok[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        keep[-1] = False  # whether the last has a fellow shows in the next batch
        yield pdf[keep]
        # the row before it is held too where it is of the same block, marked so that it isn't given twice
        held = pdf.iloc[-1:]
        if len(tok) > 1 and same[-1]:
            yield held
            held = held.assign(id=-1)
    # a last row without a fellow is nobody's


def _blocks(batches):
    """``_shared`` without the place-holders that carry a block from batch to batch."""
    for pdf in _shared(batches):
        yield pdf[pdf["id"] >= 0]


def _room(apart: Column, n: Column, m: Column) -> Column:
    """Whether two sets of ``n`` and ``m`` shingles, ``apart`` or more of them not shared, can reach the similarity."""
    return (apart * (PART + WHOLE) <= (n + m) * (WHOLE - PART)) & (F.least(n, m) * WHOLE >= F.greatest(n, m) * PART)


def _near(a: str, b: str) -> Column:
    """Whether two sets may reach the similarity, by what rows of one shingle say of the part that it is in."""
    apart = sum((F.bit_count(F.col(f"{a}.x{k}").bitwiseXOR(F.col(f"{b}.x{k}"))) for k in range(NARROW // 64)), F.lit(0))
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    behind = F.least(F.col(f"{a}.left"), F.col(f"{b}.left")) * (PART + WHOLE) >= both * PART  # holds at the first common shingle
    sizes = F.least(f"{a}.n", f"{b}.n") * WHOLE >= F.greatest(f"{a}.n", f"{b}.n") * PART
    return ~(F.col(f"{a}.guest") & F.col(f"{b}.guest")) & behind & sizes & _room(apart, F.col(f"{a}.size"), F.col(f"{b}.size"))


def _tiles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of sets of one shingle's two blocks (or one block's own) that may reach the similarity and are of different classes."""
    pdf = pdf.sort_values("n", kind="stable")
    bits = pdf[[f"x{k}" for k in range(NARROW // 64)]].to_numpy(np.int64).view(np.uint64)
    ids, n, group, block, size, left, guest = (pdf[c].to_numpy(np.int64) for c in ("id", "n", "class", "block", "size", "left", "guest"))
    alone, out = (block == block[0]).all(), []
    for a in range(0, len(ids), TILE):
        # sorted by size: beyond this no set is small enough
        most = int(np.searchsorted(n, n[min(a + TILE, len(ids)) - 1] * WHOLE // PART, side="right"))
        for b in range(a, most, TILE):
            x, y = slice(a, a + TILE), slice(b, b + TILE)
            apart = np.zeros((len(ids[x]), len(ids[y])), np.int32)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(bits[x, None, k] ^ bits[None, y, k])
            total = size[x, None] + size[None, y]
            good = (apart * (PART + WHOLE) <= total * (WHOLE - PART)) & (np.minimum(left[x, None], left[None, y]) * (PART + WHOLE) >= total * PART)
            for own in (size, n):
                good &= np.minimum(own[x, None], own[None, y]) * WHOLE >= np.maximum(own[x, None], own[None, y]) * PART
            good &= (group[x, None] != group[None, y]) & (guest[x, None] + guest[None, y] < 2)
            if not alone:
                good &= block[x, None] != block[None, y]
            i, j = np.nonzero(good)
            if a == b:
                i, j = i[i < j], j[i < j]
            out.append(np.stack([ids[x][i], ids[y][j]], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"src": found.min(axis=1), "dst": found.max(axis=1)} if len(found) else {"src": [], "dst": []}).astype("int64")


def _crowded_pairs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(src, dst) of the shingles in ``sizes`` (tok, sets), by pairs of blocks."""
    bits = ["size", "left", "guest", *[f"x{k}" for k in range(NARROW // 64)]]
    blocks = F.ceil(F.col("sets") / CROWD).cast("int")
    own = rows.join(sizes, "tok").select("tok", "id", "n", "class", *bits, blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("tok", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "n", "class", "block", *bits)
    return dealt.groupBy("tok", "low", "high").applyInPandas(_tiles, "src long, dst long").distinct()


def _texts(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(id, n, text, wide) of the sets in ``pairs``, a row each."""
    needed = pairs.select(F.col("src").alias("id")).unionAll(pairs.select(F.col("dst").alias("id"))).distinct()
    rows = materialize(sets.select("id", "n", F.col("least.key").alias("key")).join(needed, "id", "left_semi"), "copies-needed")
    few = rows.count() <= FEW  # then the texts needn't move
    found = docs.select(row_key(docs).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(rows) if few else rows, "key")
    texts = materialize(found.select("id", "n", "text", wide_column(F.col("text"), docs.sparkSession).alias("wide")), "copies-texts")
    discard(rows)
    if not texts.groupBy("id").count().where("count > 1").head(1):
        return texts
    once = materialize(texts.dropDuplicates(["id"]), "copies-texts")  # of rows equal in every column
    discard(texts)
    return once


def _both(pairs: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with structs a and b of columns of ``texts``."""
    side = lambda end, name: texts.select(F.col("id").alias(end), F.struct(*columns).alias(name))
    return pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")


def _proved(pairs: DataFrame, links: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Similar pairs (src, dst) among ``pairs``: enough of them to make, with ``links``, the classes that all of them make."""
    spark = docs.sparkSession
    texts = _texts(pairs, sets, docs, text_col)
    apart = F.aggregate(F.zip_with("a.wide", "b.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    wide = _both(pairs, texts, "n", "wide").withColumn("apart", apart).where(_room(F.col("apart"), F.col("a.n"), F.col("b.n")))
    near = materialize(wide.select("src", "dst", "apart"), "copies-near")
    ends = near.select(F.col("src").alias("id"), F.col("dst").alias("to"), "apart").unionAll(near.select(F.col("dst").alias("id"), F.col("src").alias("to"), "apart"))
    nearest = ends.groupBy("id").agg(F.min(F.struct("apart", "to")).alias("x"))
    lead = materialize(nearest.select(F.least("id", "x.to").alias("src"), F.greatest("id", "x.to").alias("dst")).distinct(), "copies-lead")
    check = lambda some, label: materialize(_both(some, texts, "text").where(alike_column(F.col("a.text"), F.col("b.text"), spark)).select("src", "dst"), label)
    good = check(lead, "copies-good")
    known = materialize(connected_components(links.unionAll(good)), "copies-known")
    name = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_class"))
    rest = near.select("src", "dst").join(lead, ["src", "dst"], "left_anti").join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    rest = materialize(rest.where(~F.coalesce("src_class", "src").eqNullSafe(F.coalesce("dst_class", "dst"))).select("src", "dst"), "copies-rest")
    if rest.head(1):
        more = check(rest, "copies-more")
        both = materialize(good.unionAll(more), "copies-good")
        discard(good)
        discard(more)
        good = both
    for done in (texts, near, lead, known, rest):
        discard(done)
    return good


def _simhash_links(sets: DataFrame) -> DataFrame:
    """Links (src, dst) of set ids: each set to the least set of its SimHash class."""
    prints = materialize(sets.groupBy("fp").agg(F.min("id").alias("least")), "copies-prints")
    found = connected_components(simhash.links(prints))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("src"))
    return sets.select("id", "fp").join(rooted.join(least, "root").select("fp", "src"), "fp").where("id <> src").select("src", F.col("id").alias("dst"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct set: ``id`` (of the set), ``class``, and ``least``, the least (id is null, id, row key) of its rows."""
    spark = docs.sparkSession
    often, counts = frequent(docs, text_col)
    least = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row_key(docs).alias("key"))
    rows = docs.select(least.alias("least"), _signed(F.col(text_col), often, counts, spark).alias("s")).select("least", "s.*")
    distinct = rows.groupBy("set").agg(F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "own", "sizes", "odd", "tok", "part", "at")])
    told = materialize(distinct.drop("set").withColumn("id", F.monotonically_increasing_id()), "copies-told")
    sets = materialize(told.select("id", "least", "n", "fp"), "copies-sets")
    words = NARROW // 64
    each = F.transform("sizes", lambda size, k: F.struct(size.alias("size"), F.slice("odd", k * words + 1, words).alias("odd")))  # exploded without the others' parities
    each = told.select("id", "n", "own", F.posexplode(each).alias("part", "x"))
    bits = [F.get("x.odd", F.lit(k)).alias(f"x{k}") for k in range(words)]
    parts = materialize(each.select("id", "n", "part", "x.size", (F.col("part") >= F.col("own")).alias("guest"), *bits), "copies-parts")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = told.select("id", F.explode(F.arrays_zip("tok", "part", "at")).alias("x")).select("x.tok", "id", "x.part", "x.at").repartition(n, "tok").sortWithinPartitions("tok")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20_000)  # rows of four numbers
    blocks = materialize(dealt.mapInPandas(_blocks, "tok long, id long, part int, at int"), "copies-blocks")
    discard(told)
    bits = ["size", "left", "guest", *[f"x{k}" for k in range(words)]]

    def tagged(known: DataFrame) -> DataFrame:
        """Blocks with the sets' classes; ``known``: (node, component)."""
        named = parts.join(known, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("component", "id")).drop("node", "component")
        return blocks.join(named, ["id", "part"]).withColumn("left", F.col("size") - F.col("at")).select("tok", "id", "n", "class", *bits)

    def pairs(found: DataFrame) -> DataFrame:
        return found.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst")).distinct()

    # neighbours first: what they link needs no comparing of all with all
    links = materialize(_simhash_links(sets), "copies-simhash")  # every set with the least of its class
    me = F.struct("id", "n", "class", *bits)
    crowds = materialize(blocks.groupBy("tok").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > CROWD), "copies-crowds")
    crowded = bool(crowds.head(1))
    near = tagged(links.select(F.col("dst").alias("node"), F.col("src").alias("component"))).withColumn("place", F.lit(0))
    if crowded:
        place = F.when(F.col("sets").isNotNull(), F.pmod(F.xxhash64(F.col("x3").bitwiseAND(F.lit(0x3F3F))), F.lit(PLACES)).cast("int")).otherwise(0)
        near = near.drop("place").join(crowds, "tok", "left").withColumn("place", place).drop("sets").repartition(n, "tok", "place")
    by = lambda *order: Window.partitionBy("tok", "place").orderBy(*order, "id")
    met = [F.lead(me, k).over(by(*order)) for order in ORDERS for k in range(1, REACH + 1)] + [F.first(me).over(by())]
    neighbours = near.select(me.alias("a"), F.array(*met).alias("met")).select("a", F.explode("met").alias("b"))
    first = materialize(pairs(neighbours.where(F.expr("b is not null and a.class <> b.class") & _near("a", "b"))), "copies-first")
    good = _proved(first, links, sets, docs, text_col)

    # then all pairs of a shingle's sets that are still in different classes
    known = materialize(connected_components(links.unionAll(good)), "copies-known")
    rows = tagged(known)
    mixed = rows.groupBy("tok").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("sets")).where("x <> y").select("tok", "sets")
    mixed = materialize(mixed, "copies-mixed")
    open_ = rows.join(mixed.where(F.col("sets") <= CROWD).select("tok"), "tok", "left_semi")
    second = pairs(open_.alias("a").join(open_.alias("b"), F.expr("a.tok = b.tok and a.id < b.id and a.class <> b.class")).where(_near("a", "b")))
    if crowded:
        second = second.unionByName(_crowded_pairs(rows, mixed.where(F.col("sets") > CROWD))).distinct()
    second = materialize(second.join(first, ["src", "dst"], "left_anti"), "copies-second")
    found = known
    if second.head(1):
        more = _proved(second, links.unionAll(good), sets, docs, text_col)
        found = materialize(connected_components(links.unionAll(good).unionAll(more)), "copies-found")
        discard(more)
    for done in (blocks, parts, links, first, good, second, crowds, mixed):
        discard(done)
    return sets.join(found, sets["id"] == found["node"], "left").select(sets["id"], F.coalesce("component", sets["id"]).alias("class"), "least")


by_value(__name__)
