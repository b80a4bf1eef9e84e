"""Every query with SQL gives the rows that DuckDB gives; the others run and give rows."""

import duckdb
import pytest

from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(values, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    flat = lambda v: round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    return order, sorted(str([flat(r[i]) for i in at]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = db.execute(sql)
    assert got == rows_of(cursor.fetchall(), [d[0] for d in cursor.description])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(catalog.queries()["top_blamed"](spark, sf_dir))
    schema = [line for line in plan.split("\n") if "ReadSchema" in line][0]
    assert "l_comment" not in schema and "l_extendedprice" not in schema
    assert "PushedFilters" in plan and "l_returnflag" in plan


def test_no_cross_joins(spark, sf_dir):
    for name, query in catalog.queries().items():
        plan = plan_of(query(spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_partitioning_does_not_change_results(spark, sf_dir):
    query = catalog.queries()["sections_primary"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = set()
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(str(sorted(map(str, query(spark, sf_dir).collect()))))
        assert len(seen) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_long_chain_of_duplicates_has_its_end_as_root(spark):
    from lodestone.operators import corpus

    ring = [(k, 2000 + (k + 1) % 40) for k in range(2000, 2040)]
    links = spark.createDataFrame([(k, k + 1) for k in range(100, 400)] + [(1, 2), (2, 1), (0, 1)] + ring + [(5000 + k, 5001 + k) for k in range(70)] + [(5070, 2017), (7, None), (None, 7)], "bug_id long, duplicate_of long")
    got = {r["bug_id"]: r["root"] for r in corpus.duplicate_roots(links).collect()}
    assert got == {k: 400 for k in range(100, 400)} | {0: 1, 1: 1, 2: 1} | {k: 2000 for k in [*range(2000, 2040), *range(5000, 5071)]}
    assert corpus.duplicate_roots(links.where("false")).count() == 0


def test_similar_pairs_by_brute_force(spark):
    import random

    from lodestone.operators import similarity

    rng = random.Random(3)
    docs = {d: set(rng.sample(range(12), rng.randint(1, 6))) for d in range(120)}
    weight = {k: 0.3 + (k * 7 % 12) / 5 for k in range(12)}
    items = spark.createDataFrame([(d, i, weight[i]) for d, s in docs.items() for i in sorted(s)], "doc long, item long, w double")
    pairs, members = similarity.similar_pairs(items, "doc", "item", "w", 0.55 - 1e-9)
    heads = {d: min(e for e in docs if docs[e] == docs[d]) for d in docs}
    assert {r["doc"]: r["class"] for r in members.collect()} == heads
    score = lambda a, b: sum(weight[i] for i in a & b) / sum(weight[i] for i in a | b)
    want = {(a, b) for a in set(heads.values()) for b in set(heads.values()) if a < b and score(docs[a], docs[b]) >= 0.55 - 1e-9}
    got = {(r["left"], r["right"]): r["score"] for r in pairs.collect()}
    assert set(got) == want and all(abs(v - score(docs[a], docs[b])) < 1e-9 for (a, b), v in got.items())


def test_ranks_of_hot_groups(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import corpus

    rows = [(g, k, k % 10 == 0) for g, n in (("hot", 500), ("small", 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, stay boolean")
    got = {(r["g"], r["k"]): r["rank"] for r in corpus.rank_capped(df, ["g"], [F.desc("k")], 12, F.col("stay")).collect()}
    want = {(g, k): min(n - k, 13) for g, n in (("hot", 500), ("small", 5)) for k in range(n) if n - k <= 12 or k % 10 == 0}
    assert got == want
