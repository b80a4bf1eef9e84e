"""The pipeline against a version that works through the rows one by one."""

import re

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import mixing, toxicity

from .test_operators import brute_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_hand_on_documents(spark, documents, sf_dir):
    docs = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS, name
        docs = corpus_pipeline.materialize(docs, "test")
        kept[name] = docs.collect()
    # toxicity: what its own model scores below one half stays
    model = toxicity.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r["doc_id"] for r in documents.collect() if model.score(toxicity.text_features(r["text"], model.bits)) < 0.5}
    assert {r["doc_id"] for r in kept["toxicity"]} == want
    # near-duplicates: the first row of each class
    rows = sorted((r["doc_id"], r["text"]) for r in kept["toxicity"])
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == [rows[k][0] for k in sorted(set(brute_classes(rows)))]
    # secrets: none left, other texts untouched
    before = {r["doc_id"]: r["text"] for r in kept["near_duplicates"]}
    for r in kept["secrets"]:
        assert not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r["text"]) and r["n_chars"] == len(r["text"])
        assert "[secret]" in r["text"] or r["text"] == before[r["doc_id"]]
    # mixing: each source near its target
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = {}, {}
    for r in kept["secrets"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    for r in kept["mixing"]:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= max(0.05 * t, 60)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(kept["mixing"])


def test_odd_rows_pass_through(spark, odd, sf_dir):
    """Clashing columns, nulls, repeated rows: what each stage keeps, row by row."""
    clash = odd.selectExpr("*", "'k' as key", "'r' as row", "5 as copies", "'c' as class", "1 as _key", "2 as _n", "3 as _blob", "true as many", "7 as copy")
    rows = lambda df: sorted((str(r["doc_id"]), str(r["text"]), str(r["lang"]), str(r["source"])) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    # no label is given for these ids but by chance: the stage keeps what its model keeps
    kept = stages["toxicity"](spark, clash, sf_dir)
    assert kept.columns == clash.columns and set(rows(kept)) <= set(rows(clash))
    # null and blank texts are one class, so are the two copies and their repeated row
    once = stages["near_duplicates"](spark, clash, sf_dir)
    given = rows(clash)
    dropped = [r for r in given if r[0] in ("1", "2", "7")] + [("None", "None", "None", "None")] + [r for r in given if r[0] == "6"][:1]
    assert once.columns == clash.columns and rows(once) == sorted(r for r in set(given) if r not in set(dropped) or r[0] == "6")
    hidden = stages["secrets"](spark, clash, sf_dir)
    assert hidden.columns == clash.columns
    assert rows(hidden) == sorted((a, "[secret] [secret] [secret]" if a == "9" else b, c, d) for a, b, c, d in given)
    assert [r["n_chars"] for r in hidden.where("doc_id = 9").collect()] == [26] and hidden.where("found = 'z' and blob = 'w' and _blob = 3").count() == len(given)
    mixed = stages["mixing"](spark, clash, sf_dir)
    plan = mixing.mix(clash).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("c")).collect()
    count = lambda df: {(r["doc_id"], r["source"]): r["count"] for r in df.groupBy("doc_id", "source").count().collect()}
    assert mixed.columns == clash.columns and sum(count(mixed).values()) == sum(r["c"] for r in plan)
    assert set(rows(mixed)) <= set(given) and {r for r in given if r[1] in ("None", "")} <= set(rows(mixed))
    assert rows(stages["encoding"](spark, clash, sf_dir).join(clash.select("doc_id", "text", "lang", "source").distinct(), "doc_id", "left"))
    assert stages["encoding"](spark, clash, sf_dir).count() == len(given)


def test_stages_on_nothing(spark, none, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.count() == 0 and (name == "encoding" or out.columns == none.columns), name


def brute_classes(rows):
    """[index of the first row of each row's class], by comparing all pairs of five-word shingle sets."""
    sets, prints = [], []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        own = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        ones = [0] * 64
        for s in own:
            h = xxhash.xxh64_intdigest(s, 42)
            for bit in range(64):
                ones[bit] += h >> bit & 1
        sets.append(own)
        prints.append(sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(own)))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or bin(prints[i] ^ prints[j]).count("1") <= 3 or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_near_duplicates_by_brute_force(spark, documents, sf_dir):
    words = [f"w{k}" for k in range(100)]
    edited = [" ".join(words[:at] + ["new"] + words[at + 1 :]) for at in range(0, 100, 7)]
    extra = [(10_000 + k, t) for k, t in enumerate([" ".join(words), *edited, " ".join(words[:70]), "one", "one", "", None])]
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect()) + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == [rows[k][0] for k in sorted(set(brute_classes(rows)))]


def test_blocks_over_many_batches():
    import pandas as pd

    from lodestone.llm import edited_copies

    tok = [1, 2, 2, 3, 3, 3, 3, 4, 5, 5, 6]
    rows = pd.DataFrame({"tok": tok, "id": range(len(tok))})
    for size in (1, 2, 3, 5, 20):
        got = pd.concat(list(edited_copies._blocks(iter([rows[k : k + size] for k in range(0, len(rows), size)]))))
        assert sorted(got["id"]) == [1, 2, 3, 4, 5, 6, 8, 9], size


def test_null_and_repeated_ids_lose_no_text(spark, sf_dir):
    texts = [" ".join(f"{chr(97 + k)}{n}" for n in range(40)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[4]), (9, texts[4]), (None, texts[5]), (None, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["text"], r["doc_id"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert kept == sorted(zip(texts, [None, None, 7, 7, 8, None], strict=True))
    # one source: every word is wanted once
    mixed = sorted(r["text"] for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect())
    assert mixed == sorted(t for _, t in rows)


def test_the_last_stage_gives_the_ids(spark, documents, sf_dir):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = corpus_pipeline.encode(spark, documents, sf_dir)
    assert dict(out.dtypes)["ids"] == "array<int>"
    for r in out.collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(r["ids"]).encode()).hexdigest()
