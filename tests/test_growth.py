"""What makes queries grow with their input by no more than they must, told by their plans."""

import random
import re

from pyspark.sql import functions as F

from lodestone.functions import states
from lodestone.operators import conflicts, resolver_lines, rules, similarity
from lodestone.plans import catalog

LINES = [
    (1, "Considering a:amd64 4 as a solution to b:i386 -7"), (2, "Package a:amd64 has Depends on c:amd64 < 1.0 @ii K >"), (3, "Holding Back a:amd64 rather than change b:i386"), (4, "Holding Back a:amd64 rather than change b:i386"),
    (5, "Considering a:amd64 4 as a solution to b:i386 -7"), (6, "Removing d:amd64 rather than change b:i386"), (7, "Holding Back e:amd64 rather than change a:amd64"), (8, "Done"),
]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lexed(spark, rows):
    return resolver_lines.lex(spark.createDataFrame([("r", n, x) for n, x in rows], "run_key string, line_no int, line string"))


def test_states_are_worked_out_once(spark):
    body = "1.0 -> 2.0 @ii umU gK Ib zz"
    plan = optimized(states.vocabulary(lexed(spark, [(1, f"MarkKeep p:amd64 < {body} > <none|3@un uH>")])))
    assert plan.count("regexp_extract_all(") == 1 and plan.count("^[ihrpu][incufhwt]$") == 1
    rows = states.vocabulary(lexed(spark, [(1, f"MarkKeep p:amd64 < {body} > <none|3@un uH>"), (2, "no state"), (3, None), (4, f"< {body} > < @ >")])).collect()
    assert {(r["token"], r["known"]): r["n"] for r in rows} == {("ii", True): 2, ("umU", True): 2, ("gK", True): 2, ("Ib", True): 2, ("zz", False): 2, ("un", True): 1, ("uH", True): 1}
    got = lexed(spark, [(1, f"< {body} >")]).select(F.get("states", F.lit(0)).alias("s")).select("s.*").first()
    assert got["mode"] == states.MODES["K"] and got["bits"] == 1 | 1 << states.AUTO_INSTALLED and got["unknown_tokens"] == ["zz"]


def test_an_empty_number_is_not_cast(spark):
    # a failed try_cast costs an exception, and a value taken out of an array the type of all that was made of it
    plan = optimized(catalog.queries()["lex_lines"](spark, "/root/testdata/sf0.001"))
    casts = re.findall(r"(.{30})try_cast\((?!l_)|(.{30})cast\(coalesce", plan)
    assert "= ) THEN" in plan and all("THEN" in a + b for a, b in casts)
    got = {r["line_no"]: (r["score_src"], r["score_dst"], r["broken_count"], r["pass_no"]) for r in lexed(spark, [*LINES, (9, "Starting 2 pkgProblemResolver with broken count: 99999999999"), (10, "\tDone")]).collect()}
    assert got[1] == (4, -7, None, None) and got[8] == (None,) * 4 and got[9] == (None, None, None, 2)
    depth = [r["depth"] for r in lexed(spark, [(1, " \t x"), (2, "  x\ty"), (3, "x"), (4, "   ")]).orderBy("line_no").collect()]
    assert depth == [9, 2, 0, 3]


def test_a_line_is_dispatched_by_one_look_at_its_opening(spark):
    plan = optimized(catalog.queries()["lex_every_phrase"](spark, "/root/testdata/sf0.001"))
    assert plan.count("substring_index(") <= 1
    assert {r["line_no"]: r["verb"] for r in lexed(spark, [(1, "x Depends on y can't be satisfied! (dep)"), (2, "x Depends on y can't be"), (3, "Removing x"), (4, "Removing  x  <none @ii>  "), (5, "Removing x y")]).collect()} == {1: "cant_be_satisfied", 2: "unknown", 3: "removing", 4: "removing", 5: "unknown"}


def test_edges_read_a_parse_once_and_shuffle_once(spark):
    df = conflicts.edges(lexed(spark, LINES))
    assert optimized(df).count("solution") == 1
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["src"], r["dst"], r["kind"]): (r["has_scores"], r["score_src"], r["score_dst"], r["line_no"]) for r in df.collect()}
    # the edge between them doesn't use the scores up, the next decision does
    assert got == {
        ("c:amd64", "a:amd64", conflicts.BREAKS): (False, None, None, 2), ("b:i386", "a:amd64", conflicts.DECISION): (True, -7, 4, 3),
        ("d:amd64", "b:i386", conflicts.DECISION): (False, None, None, 6), ("a:amd64", "e:amd64", conflicts.DECISION): (False, None, None, 7),
    }


def brute(docs, weight, least):
    heads = {d: min(e for e in docs if docs[e] == docs[d]) for d in docs}
    score = lambda a, b: sum(weight[i] for i in a & b) / sum(weight[i] for i in a | b)
    names = sorted(set(heads.values()))
    return heads, {(a, b): (round(score(docs[a], docs[b]), 9), len(docs[a] & docs[b])) for a in names for b in names if a < b and score(docs[a], docs[b]) >= least}


def test_pairs_are_told_within_the_join(spark, monkeypatch):
    rng = random.Random(5)
    docs = {d: set(rng.sample(range(14), rng.randint(1, 8))) for d in range(90)}
    weight = {k: 0.3 + (k * 5 % 14) / 5 for k in range(14)}
    items = spark.createDataFrame([(d, i, weight[i]) for d, s in docs.items() for i in sorted(s)], "doc long, item long, w double")
    told = lambda: similarity.similar_pairs(items, "doc", "item", "w", 0.4 - 1e-9)
    pairs, members = told()
    assert optimized(pairs).count("Join Inner") == 1  # no pair that is too far apart leaves it, so none is joined back to its sets
    heads, want = brute(docs, weight, 0.4 - 1e-9)
    rows = lambda x: {(r["left"], r["right"]): (round(r["score"], 9), r["shared"]) for r in x.collect()}
    assert rows(pairs) == want and {r["doc"]: r["class"] for r in members.collect()} == heads
    monkeypatch.setattr(similarity, "CARRIED", 4)  # sets of more than four items aren't carried
    pairs, members = told()
    assert pairs.count() == len(want) and rows(pairs) == want and {r["doc"]: r["class"] for r in members.collect()} == heads


def dealt_by(df):
    return set(re.findall(r"Exchange hashpartitioning\(((?:\w+#\w+, )+)", df._jdf.queryExecution().executedPlan().toString().replace("\u001b", "")))


def test_roots_are_classified_where_their_runs_lie(spark, sf_dir):
    keys = dealt_by(catalog.queries()["classify_case"](spark, sf_dir))
    assert keys and all(re.fullmatch(r"run_key#\w+, ", k) for k in keys)


def test_roots_are_ranked_where_their_runs_lie(spark, sf_dir):
    keys = dealt_by(catalog.queries()["root_ranks"](spark, sf_dir))
    assert keys and all(re.fullmatch(r"run_key#\w+, ", k) for k in keys)


def test_an_i386_root_has_its_amd64_twin_among_packages_that_are_no_roots(spark):
    root = spark.createDataFrame([("r", "a:i386", ["x"], False, 1), ("r", "b:i386", [], False, 2), ("s", "a:i386", [], True, 3)], "run_key string, pkg string, cascade array<string>, cycle_broken boolean, more int")
    nodes = spark.createDataFrame([("r", "a:amd64", None, None, 0, 0), ("s", "b:amd64", None, None, 0, 0), ("r", "b:i386", "1", "2", conflicts.S.MODES["H"], 0)], "run_key string, pkg string, cur_version string, cand_version string, mode int, bits int")
    none = spark.createDataFrame([], "run_key string, src string, dst string, kind int, dep int, constraint string, decision int, score_src int, score_dst int, has_scores boolean, depth int, line_no int")
    got = {(r["run_key"], r["pkg"]): (r["cause"], r["confidence"], r["rank"]) for r in conflicts.classify(root, none, nodes, none, evidence_complete=F.col("more") > 1).collect()}
    assert got == {("r", "a:i386"): ("unknown", 0, 1), ("r", "b:i386"): ("held_package_blocks_upgrade", 2, 2), ("s", "a:i386"): ("i386_orphan", 2, 1)}


def test_messages_meet_patterns_only_where_their_words_are(spark):
    texts = [("r", 1, "ERROR", "no 'x' not writable but /boot not writable"), ("r", 2, "ERROR", "failed to mark 'a' for install (E:x)"), ("r", 3, "ERROR", "An upgrade from 'a' to b"), ("q", 1, "ERROR", "Held Broken Packages, An upgrade from 'a' to 'b' is not supported")]
    records = spark.createDataFrame(texts, "run_key string, seq long, level string, message string")
    corpus = rules.Corpus(spark.createDataFrame([], "run_key string"), records, spark.createDataFrame([("r", "You have HELD broken Packages")], "run_key string, text string"))
    hits = rules.first_hits(rules.said(corpus))
    assert "CASE WHEN apt" in optimized(hits.select("c0")) and "Contains(message" in optimized(hits.select("m6"))
    got = {r["run_key"]: r for r in hits.collect()}
    assert got["r"]["m2"]["values"] == ["no 'x'"] and got["r"]["m6"] is None and got["q"]["m6"]["values"] == ["a", "b"]
    assert got["r"]["c0"] and not got["q"]["c0"] and not got["r"]["c1"] and got["r"]["unmarked"]["package"] == "a"
