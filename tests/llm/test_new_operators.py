"""Alignment, repeated spans and prefix tries against plain versions; any columns; workers that lack the package."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, edited_copies, mixing, pair_counts, piece_bpe, prefix_trie, queries, repeated_spans, warc

from ..conftest import ROOT, SF
from .test_pipeline import brute_classes

A, B = queries.tokenizer_path(queries.BYTE_TOKENIZER), queries.tokenizer_path()


def files():
    with open(A, encoding="utf-8") as f:
        return f.read(), piece_bpe.model_bytes(B)


# -- 11 alignment ------------------------------------------------------------------------------

ODD_TEXTS = ["", " ", "  two  spaces ", "a\tb \n c", "\n", "x", "don't we'll I'm", "<|endoftext|> <s> </s> <unk>", "é ﬁ \u0000   日本 🎉 \x1c y", "▁x y", "a ▁", "1 2.5,3 ²x x²", "the cat the cat", "word." * 40, "y" * 5000, "a\r\n\r\nb  c   d"]


def library(text):
    """Groups and links by the libraries themselves, on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(library, "a"):
        library.a, library.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        library.a.encode_special_tokens = True
        library.names = pair_counts.Aligner(*files())
    if not text:
        return None
    names, data = library.names, (" " + text).encode()
    a, b = library.a.encode(" " + text, add_special_tokens=False).ids, library.b.encode(text)
    if b"".join(names.a_bytes[i] for i in a) != data or b"".join(names.b_bytes[i] for i in b) != data:
        return None
    ends = [list(itertools.accumulate(len(x[i]) for i in ids)) for x, ids in ((names.a_bytes, a), (names.b_bytes, b))]
    at = [{e: k for k, e in enumerate(es)} for es in ends]
    groups, links, p, q = [], [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        i, j = at[0][e], at[1][e]
        groups.append(",".join(map(str, a[p : i + 1])) + "|" + ",".join(map(str, b[q : j + 1])))
        links.append((a[i], b[j]))
        p, q = i + 1, j + 1
    return a, b, ";".join(groups), links


def aligned_rows(texts):
    found = [library(t) for t in texts]
    counts = Counter(x for f in found if f for x in f[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    none = ("", 0, 0, 0, 0, 0, 0)
    return [(f[2], len(f[0]), len(f[1]), len(f[3]), len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3])) if f else none for f in found]


def test_alignment(spark, documents):
    random.seed(4)
    pool = [c for t in ODD_TEXTS for c in t] + list("  \n.,aet")
    texts = [r["text"] for r in documents.collect()][:60] + ODD_TEXTS + [None] + ["".join(random.choices(pool, k=random.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, groups string").repartition(5)
    got = {r["doc_id"]: tuple(r["aligned"]) for r in pair_counts.align_documents(docs, *files()).collect()}
    assert [got[k] for k in range(len(texts))] == aligned_rows(texts)


def test_alignment_by_the_library_and_in_small_windows(spark, monkeypatch):
    """A byte-level file whose ids don't follow its merges goes through its own library; windows and encoded lots may be of any size."""
    a = pair_counts.Aligner(*files())
    parts = [p for t in ODD_TEXTS for p in pair_counts.cut(t)]
    whole = list(a.align(parts))
    monkeypatch.setattr(pair_counts, "ENCODED", 3)
    small = list(a.align(parts))
    assert [g for x in whole for g in x.groups()] == [g for x in small for g in x.groups()] and len(small) > 5
    a.encode_a = a._library(files()[0])
    assert [g for x in a.align(parts) for g in x.groups()] == [g for x in whole for g in x.groups()]
    monkeypatch.setattr(pair_counts, "WINDOW_CHARS", 10)
    cut = list(pair_counts.windows([ODD_TEXTS, ODD_TEXTS[:3], [None]]))
    assert len(cut) == 3 and sum((p for _, p in cut), Counter()) == Counter(p for t in ODD_TEXTS + ODD_TEXTS[:3] for p in pair_counts.cut(t))


def test_alignment_odd_rows(spark, odd, none):
    got = pair_counts.align_documents(odd, *files()).collect()
    assert len(got) == odd.count() and {r["aligned"]["n_a"] for r in got if not r["text"]} == {0}
    assert pair_counts.align_documents(none, *files()).count() == 0


def test_perfect_hash():
    random.seed(1)
    keys = np.array(sorted({random.getrandbits(63) for _ in range(5000)} | {0, 1, 2**64 - 1}), np.uint64)
    index = pair_counts.PairHash(keys)
    at = index.place(keys)
    assert sorted(at.tolist()) == list(range(len(keys))) and (index.keys[at] == keys).all()
    others = np.array([random.getrandbits(63) | 1 << 62 for _ in range(2000)], np.uint64)
    assert (index.place(others[~np.isin(others, keys)]) == -1).all()
    assert pair_counts.PairHash(np.zeros(0, np.uint64)).place(keys[:3]).tolist() == [-1, -1, -1]


def test_counts_are_summed_along_a_tree(spark, monkeypatch):
    monkeypatch.setattr(pair_counts, "SLICE", 7)
    monkeypatch.setattr(pair_counts, "FAN", 2)
    rows = spark.range(0, 600, 1, 9).selectExpr("id % 50 as pair", "id as n")
    index = pair_counts.PairHash(np.arange(50, dtype=np.uint64))
    got = pair_counts.tree_sum(rows, index)
    assert [int(got[index.place(np.array([k], np.uint64))[0]]) for k in range(50)] == [sum(range(k, 600, 50)) for k in range(50)]


# -- 12 repeated spans ---------------------------------------------------------------------------


def brute_repeats(texts, window):
    """(words, removed, kept) of each text by a table of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("hot", [2000, 0])
def test_repeats(spark, monkeypatch, hot):
    """Shared passages, copies, periods, near misses; shards of a few words; and every anchor as if it were hot."""
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    monkeypatch.setattr(repeated_spans, "SHARD", 50)
    random.seed(9)
    some = lambda n, v=400: [f"w{random.randint(0, v)}" for _ in range(n)]
    passage = some(60)
    texts = [" ".join(some(random.randint(0, 40)) + passage[random.randint(0, 30) :] + some(random.randint(0, 40))) for _ in range(25)]
    texts += [" ".join(passage[:34]), " ".join(passage[:35]), " ".join(some(30, 1)), " ".join(["a"] * 36), " ".join(["b"] * 35), " ".join(["c"] * 34), " ".join(list("xyz") * 40), " ".join(some(300, 3))]
    texts += [texts[0], texts[0] + " end", "\t" + texts[3].replace(" ", " \n ", 9), "", None, "é " * 50, " ".join(some(50))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, key int").repartition(3)
    got = {r["doc_id"]: tuple(r["unrepeated"]) for r in repeated_spans.remove_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, 35)
    short = {r["doc_id"]: tuple(r["unrepeated"]) for r in repeated_spans.remove_repeats(docs, window=3).collect()}
    assert [short[k] for k in range(len(texts))] == brute_repeats(texts, 3)


def test_repeats_in_pieces_and_odd_rows(spark, odd, none, monkeypatch):
    text = ("one  two\nthree " * 50).encode()
    whole = repeated_spans.word_hashes(text).tolist()
    monkeypatch.setattr(repeated_spans, "PIECE", 5)
    assert repeated_spans.word_hashes(text).tolist() == whole and len(whole) == 150
    rows = repeated_spans.remove_repeats(odd).collect()
    want = Counter(map(tuple, brute_repeats([r["text"] for r in odd.collect()], 35)))
    assert Counter(tuple(r["unrepeated"]) for r in rows) == want
    assert repeated_spans.remove_repeats(none).count() == 0


def test_automaton_by_brute_force():
    random.seed(3)
    for _ in range(200):
        texts = [[random.choice("ab") for _ in range(random.randint(1, 12))] for _ in range(random.randint(1, 4))]
        weights = [random.randint(1, 2) for _ in texts]
        a = repeated_spans.Automaton()
        for t, w in zip(texts, weights, strict=True):
            a.add(t, w)
        a.weigh()
        n = lambda s: sum(w for t, w in zip(texts, weights, strict=True) for i in range(len(t)) if t[i : i + len(s)] == s)  # noqa: B023, E731
        for t in texts:
            covered = {k for x, y in a.spans(t, 2) for k in range(x, y)}
            assert covered == {k for i in range(len(t)) for j in range(i + 2, len(t) + 1) if n(t[i:j]) > 1 for k in range(i, j)}


# -- 13 prefix trie ---------------------------------------------------------------------------------


def brute_trie(rows, opening, base):
    """Node rows of (conv_id, turn, role, text) by a dictionary of prefixes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told = (role or "", text or "")
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{told[0]}\0{told[1]}".encode()).hexdigest(), told))
    own = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {c: own.get(base(c), [])[: opening(c)] + own[c][opening(c) :] for c in own}
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, v in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = sorted(c for c in v if len(rebuilt[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), kids[k], sum(not kids[x] for x in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def built(df):
    turns, convs = prefix_trie.with_shared_openings(prefix_trie.numbered(df), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(9)), F.col("conv") - F.col("conv") % 5)
    return prefix_trie.trie(prefix_trie.hashed(turns), convs)


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    random.seed(7)
    rows = [(c, t, random.choice(["user", None]), random.choice(["a", "b", "", None, "é"])) for c in range(0, 70) for t in range(random.randint(1, 11))]
    rows += [(100 + k, t, "user", f"same{t}") for k in range(40) for t in range(6)]  # a crowd that is one conversation
    rows += [(7, t, "user", "long") for t in range(20, 400)] + [(8, None, "x", "first"), (8, None, "x", "first"), (9, 3, "b", "tie"), (9, 3, "a", "tie")]
    rows += [(None, 1, "user", "nobody"), (-7, 0, "user", "minus"), (1003, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).repartition(4)
    opening, base = lambda c: zlib.crc32(str(c).encode()) % 9, lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, built(df).collect()), key=key) == sorted(brute_trie(rows, opening, base), key=key)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert built(none).count() == 0
    assert built(none.unionByName(spark.createDataFrame([(None, 1, "a", "b")], none.schema))).count() == 0


@pytest.mark.parametrize("name", ["op12_repeats", "op13_prefix_trie"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).toLocalIterator())) != [] and Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())


# -- columns of any kind, ids of any kind -------------------------------------------------------------


def test_any_columns(spark, sf_dir):
    texts = ["a few words of one text here", "a few words of one text here", "other words in the other text", None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"m": F.create_map(F.lit("a"), F.lit(1)), "deep": F.array(F.create_map(F.lit("b"), F.lit(2))), "st": F.struct(F.lit(1).alias("x")), "bin": F.lit(b"\x00\xff"), "back`tick": F.lit(1), "dot.ted": F.lit(2), "arr": F.array(F.lit(None).cast("int"))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() >= 3, name
    assert mixing.mix(docs).count() == 5
    flipped = spark.createDataFrame([(1,)], "k int").select(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("m")), spark.createDataFrame([(1,)], "k int").select(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)).alias("m"))
    assert len({bytes(d.select(common.row_key(d)).first()[0]) for d in flipped}) == 1


def test_archive_keeps_any_ids(spark):
    body = "x" * 2000
    ids = ["a>b", "", None, "é %3E\r\n", "z"]
    pages = spark.createDataFrame([(i, "http://a/", body if k % 2 else f"own{k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_report(pages).collect()}
    assert set(got) == set(ids) and got["é %3E\r\n"] == ("response", None) and got[""] == ("revisit", "é %3E\r\n") and got[None] == ("response", None)


def test_crowded_shingles_by_brute_force(spark, sf_dir, monkeypatch):
    """Texts of one template around the similarity, as if every shingle were crowded."""
    monkeypatch.setattr(edited_copies, "CROWD", 3)
    monkeypatch.setattr(edited_copies, "TILE", 4)
    random.seed(5)
    template = [f"t{k}" for k in range(90)]
    rows = [(k, " ".join(template + [f"o{k}x{j}" for j in range(random.choice([2, 8, 12, 20]))])) for k in range(40)]
    rows += [(100 + k, " ".join(template[: 90 - k] + [f"q{k}"])) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == [rows[k][0] for k in sorted(set(brute_classes(rows)))]


@pytest.mark.parametrize("crowd", [3, 4096])
def test_split_sets_by_brute_force(spark, sf_dir, monkeypatch, crowd):
    """Texts around the similarity and around the sizes at which sets are split, a larger one finer."""
    monkeypatch.setattr(edited_copies, "SPLIT", 16)
    monkeypatch.setattr(edited_copies, "CROWD", crowd)
    random.seed(6)
    rows = []
    for group in range(12):
        words = [f"g{group}w{k}" for k in range(random.choice([19, 22, 35, 40, 68, 75, 140, 280]))]
        for _ in range(7):
            cut = random.randint(0, len(words) // 4)
            rows.append((len(rows), " ".join(random.choice([words[cut:], words[: len(words) - cut], words + [f"n{len(rows)}x{k}" for k in range(cut)]]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == [rows[k][0] for k in sorted(set(brute_classes(rows)))]


def test_long_texts_below_the_similarity_make_no_pairs(spark, sf_dir, monkeypatch):
    """At thousands of shingles too, a group of texts that share much but not enough does not become all its pairs."""
    made, write = Counter(), edited_copies.materialize

    def counted(df, label):
        out = write(df, label)
        if label in ("copies-first", "copies-second"):
            made[label] += out.count()
        return out

    monkeypatch.setattr(edited_copies, "materialize", counted)
    template = [f"t{k}" for k in range(2400)]
    rows = [(k, " ".join(template + [f"o{k}x{j}" for j in range(560)])) for k in range(30)]
    rows += [(100 + k, " ".join(template[: 2400 - 200 * k] + [f"q{j}" for j in range(900)])) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == [*range(30), 100] and 1 <= sum(made.values()) <= 10, made


# -- executors without this package ---------------------------------------------------------------------

ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver's alone
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.executorEnv.PYTHONPATH", "").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def lacks(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("lodestone") is not None))
assert spark.range(1).mapInPandas(lacks, "id long").first()[0] == 0
import __spark_entry__ as e
for name, q in e.queries().items():
    if name.startswith("op") or name in ("pipeline", "cascades", "terminal_failures", "blame_reorient", "classify_case"):
        print(name, q(spark, sys.argv[2]).count(), flush=True)
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", ELSEWHERE, ROOT, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert ran.returncode == 0 and "pipeline" in ran.stdout, ran.stderr[-3000:]
