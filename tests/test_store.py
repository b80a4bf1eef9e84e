"""State, sources and increments."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus, ordered, similarity, state, worklist
from lodestone.sources import bugs, logs
from lodestone.sources.keyed import KeyedTable
from lodestone.sources.store import Store
from lodestone.streaming import folding, incremental
from lodestone.streaming.membership import Membership

UPDATES = "bug_id long, status string, importance string, title string, duplicate_of long, is_duplicate boolean, assignee string, checked_at timestamp, n int"


def at(day):
    return dt.datetime(2026, 1, day)


def updates(spark):
    rows = [(1, "New", "High", "t", None, None, "", at(1), 1), (1, "", "", "", None, True, None, at(2), 2), (2, "Triaged", "", "", 1, None, None, at(3), 3), (1, "Triaged", "", "", None, None, "me", at(4), 4)]
    return spark.createDataFrame(rows, UPDATES)


def test_unsaid_never_overwrites(spark):
    one = state.fold_updates(updates(spark), "bug_id", ["n"]).where("bug_id = 1").first()
    assert (one["status"], one["importance"], one["title"], one["is_duplicate"], one["assignee"], one["checked_at"]) == ("Triaged", "High", "t", True, "me", at(4))


def test_merge_in_steps_is_merge_at_once(spark):
    u = updates(spark)
    fold = lambda d: state.fold_updates(d, "bug_id", ["n"])
    steps = state.merge(fold(u.where("n <= 2")), fold(u.where("n > 2")), "bug_id")
    assert sorted(map(str, steps.select(*sorted(steps.columns)).collect())) == sorted(map(str, fold(u).select(*sorted(steps.columns)).collect()))


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    row = lambda key, cause, day: {"run_key": key, "bug_id": 7, "is_primary": True, "top_cause": cause, "ingested_at": at(day)}
    schema = s.table("runs").schema
    put = lambda *rows: s.put_runs(spark.createDataFrame([{f.name: r.get(f.name) for f in schema} for r in rows], schema))
    put(row("lp:7#0", "unknown", 1), row("lp:7#1", "x", 1))
    put(row("lp:7#0", "y", 5))
    got = {r["run_key"]: (r["top_cause"], r["ingested_at"]) for r in s.table("runs").collect()}
    assert got == {"lp:7#0": ("y", at(1)), "lp:7#1": ("x", at(1))}
    assert s.advance("sweep", "2026-01-05") == "2026-01-05" and s.advance("sweep", "2026-01-02") == "2026-01-05"
    s.delete_runs(spark.createDataFrame([("lp:7#1",)], "run_key string"))
    assert s.table("runs").count() == 1 and s.known_bugs().count() == 1
    s.put_states(updates(spark), ["n"])
    assert s.table("bug_state").count() == 2
    s.put_meta("schema_version", "99")
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "store"))


def test_streaming_equals_batch(spark, tmp_path):
    u = updates(spark)
    for n in (1, 2, 3, 4):
        u.where(F.col("n") == n).write.parquet(str(tmp_path / "in"), mode="append")
    source = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = KeyedTable(spark, str(tmp_path / "state"), "bug_id", UPDATES.replace(", n int", ""))
    for _ in range(2):  # the second run has nothing to take up
        incremental.collect(spark, source, table, str(tmp_path / "cp"), "bug_id", ["n"])
    got = table.read()
    want = state.fold_updates(u, "bug_id", ["n"])
    assert {r["bug_id"]: r["status"] for r in got.collect()} == {r["bug_id"]: r["status"] for r in want.collect()}


def test_a_batch_rewrites_the_partitions_of_its_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "keyed"), "k", "k long, v string", 64)
    put = lambda ids, v: table.update(ids, lambda old: state.replace_rows(old, ids.select(F.col("id").alias("k"), F.lit(v).alias("v")), "k"))
    put(spark.range(1000).withColumn("k", F.col("id")), "a")
    assert len(table.rewritten) == 64
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "keyed").rglob("*.parquet")}
    ten = spark.range(10).withColumn("k", F.col("id"))
    for _ in range(2):  # a batch that is run again changes nothing
        put(ten, "b")
        assert len(table.rewritten) <= 10
        got = table.read().groupBy("v").count().collect()
        assert {r["v"]: r["count"] for r in got} == {"a": 990, "b": 10}
    still = {p for p in (tmp_path / "keyed").rglob("*.parquet") if written.get(p) == p.stat().st_mtime_ns}
    assert len(still) >= 54
    everything = spark.range(1000).withColumn("k", F.col("id"))
    table.update(everything, lambda old: state.delete_rows(old, everything, "k"))
    assert table.read().count() == 0 and table.of(ten).count() == 0


def test_classes_kept_up_to_date(spark, tmp_path):
    """Batches that bring fellows, change signatures and repeat: the same classes as from all at once."""
    random.seed(2)
    state_of, held = {}, Membership(spark, str(tmp_path / "members"), "long", parts=8)
    for _ in range(4):
        batch = {random.randint(0, 40): (random.choice(["g1", "g2", "g3", "g4", None]), random.choice(["c1", "c2", "c3", "c4", "c5", None])) for _ in range(15)}
        state_of |= batch
        rows = spark.createDataFrame([(k, *v) for k, v in batch.items()], "run_key long, root_graph string, cause_tuple string")
        held.put(rows)
        if len(batch) % 2:
            held.put(rows)  # put again: nothing changes
        whole = spark.createDataFrame([(k, *v) for k, v in state_of.items()], "run_key long, root_graph string, cause_tuple string")
        want = similarity.clusters(whole)
        assert sorted(map(tuple, held.members().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_any_cut_of_logs_into_batches(spark, tmp_path):
    """Records, sections and phases of a stream, lines given twice included, equal those of the whole logs."""
    random.seed(6)
    said = ["Using config files 'x'", "cache.commit() returned False", "openCache()", "nothing"]
    rows = []
    for run in ("a", "b", "c"):
        for n in range(1, 25):
            stamp = f"2026-0{random.choice([2, 9])}-{random.choice([10, 31]):02d} 10:00:{n:02d},{n:03d} INFO {random.choice(said)}"
            rows.append((run, n, stamp if random.random() < 0.5 else random.choice(["  more", "", "Log time: x"])))
    lines = spark.createDataFrame(rows, "run_key string, line_no long, line string")
    cuts = {run: sorted(random.sample(range(1, 25), 2)) for run in "abc"}
    kinds = "run_key string, line_no long, line string"
    table = KeyedTable(spark, str(tmp_path / "records"), "run_key", folding.ROWS.format(kind="string"), 4)
    for k in range(3):
        low, high = {r: (0, *c, 25)[k] for r, c in cuts.items()}, {r: (0, *c, 25)[k + 1] for r, c in cuts.items()}
        part = [r for r in rows if low[r[0]] - 2 < r[1] <= high[r[0]]]  # some lines once more
        random.shuffle(part)
        spark.createDataFrame(part, kinds).write.mode("append").parquet(str(tmp_path / "lines"))
        folding.fold_into(spark.readStream.schema(kinds).parquet(str(tmp_path / "lines")), table, str(tmp_path / "cp"), starts=F.col("line").startswith("Log time"))
    got = folding.records(table.read()).drop("section", "phase")
    want = ordered.fold_records(lines)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    numbered = ordered.running_phase(want, ordered.phase_of(F.col("message")), ["run_key"], ["seq"])
    assert {(r["run_key"], r["seq"]): r["phase"] for r in table.read().collect()} == {(r["run_key"], r["seq"]): r["phase"] for r in numbered.collect()}
    last = {r["run_key"]: r["section"] for r in table.read().groupBy("run_key").agg(F.max_by("section", "seq").alias("section")).collect()}
    assert last == {run: sum(r[2].startswith("Log time") for r in rows if r[0] == run) for run in "abc"}


def test_snapshot_diff_and_refresh(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "n")], "k int, v string")
    got = {r["k"]: (r["change"], r["changed"]) for r in state.snapshot_diff(a, b, "k", ["v"]).collect()}
    assert got == {1: ("changed", ["v"]), 2: ("same", []), 3: ("removed", []), 4: ("added", [])}
    assert incremental.refresh(a, b, True, "k", None, ["v"])[1].count() == 1 and incremental.refresh(a, b, False, "k", None, ["v"])[1].count() == 0


def test_cursor_holds_at_the_oldest_failure(spark):
    t = lambda *days: spark.createDataFrame([(at(d),) for d in days], "created timestamp")
    assert incremental.next_cursor(t(3, 9), t(5), "created", at(1)) == at(5)
    assert incremental.next_cursor(t(3), t(), "created", at(4)) == at(4)


def test_chains_and_worklist(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "bug_id long, duplicate_of long")
    assert {r["bug_id"]: r["root"] for r in corpus.duplicate_roots(links).collect()} == {1: 3, 2: 3, 5: 5, 6: 5}
    rows = spark.createDataFrame([("lp:1#0", 1, "third_party_pin", True, True, "New", None, None, None), ("lp:2#0", 2, None, True, False, "New", None, None, None), ("lp:3#0", 3, "x", True, False, "", None, None, None), ("lp:4#0", 4, "x", True, False, "Invalid", None, None, None), ("lp:5#0", 5, "x", True, False, "Incomplete", None, None, None), ("lp:6#0", 6, "x", True, False, "Confirmed", None, None, None), ("lp:7#0", 7, "x", True, False, "New", 99, None, None), ("lp:8#0", 8, "x", True, False, "New", None, None, None)], "run_key string, bug_id long, top_cause string, evidence_complete boolean, third_party boolean, status string, duplicate_of long, is_duplicate boolean, assignee string")
    members = spark.createDataFrame([("lp:7#0", "lp:8#0", 1), ("lp:8#0", "lp:8#0", 0)], "run_key string, canonical string, tier int")
    got = {r["bug_id"]: r["bucket"] for r in worklist.classify(rows, members, corpus.duplicate_roots(links)).collect()}
    assert got == {1: "candidate-invalid", 2: "needs-read", 3: "status-unknown", 4: "done", 5: "diagnosed-unrecorded", 6: "done", 7: "duplicate-conflict", 8: "diagnosed-unrecorded"}


def test_log_directories(spark, tmp_path):
    for folder, text in (("", "2026-01-01 00:00:00,000 INFO a\n"), ("20260101-1000", "x"), ("20260102-1000", "y")):
        d = tmp_path / "run" / folder
        d.mkdir(parents=True, exist_ok=True)
        (d / "main.log").write_text(text)
    (tmp_path / "run" / "other.txt").write_text("no")
    found = logs.attempts(logs.files(spark, str(tmp_path / "run")))
    assert sorted((r["attempt"], r["stamp"], r["is_primary"]) for r in found.select("attempt", F.coalesce("stamp", F.lit("")).alias("stamp"), "is_primary").collect()) == [(0, "", True), (1, "20260102-1000", False), (2, "20260101-1000", False)]
    assert logs.lines(found).where("line like '%INFO a'").count() == 1


def test_caps_keep_whole_lines_of_the_end(spark):
    df = spark.createDataFrame([(bytearray(b"first line\nsecond\nthird"), "x")], "content binary, source string")
    old = logs.CAPS
    logs.CAPS = {"x": 14}
    try:
        assert df.select(logs.capped(F.col("content"), F.col("source")).alias("t")).first()["t"] == "second\nthird" or df.select(logs.capped(F.col("content"), F.col("source")).alias("t")).first()["t"] == "third"
    finally:
        logs.CAPS = old


def test_titles_and_contents(spark):
    rows = spark.createDataFrame([("apt.log",), ("VarLogDistupgradeAptlog.txt",), ("VarLogDistupgradeMainlog.gz",), ("CurrentDmesg.txt.txt",), ("shot.png",), ("what?",)], "t string")
    got = [(r["s"], r["i"]) for r in rows.select(logs.source_of_title(F.col("t")).alias("s"), logs.is_irrelevant(F.col("t")).alias("i")).collect()]
    assert got == [("apt", False), ("apt", False), ("main", False), (None, True), (None, True), (None, False)]
    texts = spark.createDataFrame([("Start-Date: 2026-01-01  1",), ("2026-01-01 00:00:00,000 INFO x",), ("Setting up a (1) ...",), ("hello",)], "x string")
    assert [r[0] for r in texts.select(logs.sniff(F.col("x"))).collect()] == ["history", "main", "apt_term", None]


def test_report_fields(spark):
    text = "I upgraded.\nProblemType: Crash\nUname: Linux 6.8.0-surface x\nTraceback:\n line one\n\n ValueError: x\nVarLogDistupgradeApttermlog:\nCasperMD5CheckResult: fail"
    got = logs.report_fields(spark.createDataFrame([(1, text)], "bug_id int, description string"))
    row = got.select("preamble", *logs.report_facts(F.col("fields"))).first()
    assert row["preamble"] == "I upgraded." and row["is_crash"] and row["third_party_kernel"] and row["media_check_failed"] and row["dpkg_silent"] and "ValueError: x" in row["traceback"]


def test_series(spark, tmp_path):
    (tmp_path / "s.csv").write_text("version,codename,series,created,release,eol\n22.04 LTS,Jammy,jammy,2021-10-14,2022-04-21,2027-06-01\n23.10,Mantic,mantic,2023-04-20,2023-10-12,2024-07-11\n24.04 LTS,Noble,noble,2023-10-12,2024-04-25,2029-05-31\n")
    t = logs.series_table(spark, str(tmp_path / "s.csv"))
    pairs = spark.createDataFrame([("jammy", "noble"), ("noble", "jammy"), ("jammy", "zz")], "from_series string, to_series string")
    got = {(r["from_series"], r["to_series"]): (r["is_upgrade"], r["is_lts_to_lts"], r["steps"]) for r in logs.upgrade_steps(pairs, t).collect()}
    assert got == {("jammy", "noble"): (True, True, ["mantic"]), ("noble", "jammy"): (False, False, []), ("jammy", "zz"): (False, False, [])}
    assert logs.series_table(spark, str(tmp_path / "none.csv")).count() == 0


def test_pacing_and_paging():
    clock, slept, answers = [0.0], [], [(429, {"Retry-After": "7"}, b""), (503, {}, b""), (200, {}, b"ok")]
    sleep = lambda s: (slept.append(s), clock.__setitem__(0, clock[0] + s))
    assert bugs.Pacer(3.0, 5, lambda: clock[0], sleep)(lambda: answers.pop(0)) == b"ok"
    assert slept == [7, 10]  # as long as told, then the doubled back-off (longer than the pace)
    docs = {"a": {"entries": [{"bug_link": "x/bugs/5"}], "next_collection_link": "b"}, "b": {"entries": []}}
    seen = list(bugs.pages("a", lambda u: json.dumps(docs[u]).encode()))
    assert [end for _, end in seen] == [False, True] and bugs.task_row(seen[0][0][0])[0] == 5


class Answer:
    def __init__(self, status, headers, body):
        self.status, self.headers, self.body = status, headers, body

    def read(self):
        return self.body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def opener(answers, asked):
    """A stand-in for urlopen: statuses of 300 and more are raised, as it does."""
    import io
    import urllib.error

    def open_(request, timeout):
        asked.append((request.full_url, request.get_header("If-none-match")))
        status, headers, body = answers[request.full_url].pop(0)
        if status >= 300:
            raise urllib.error.HTTPError(request.full_url, status, "", headers, io.BytesIO(body))
        return Answer(status, headers, body)

    return open_


def test_raised_statuses_are_retried_and_unmodified_bodies_kept():
    slept, asked = [], []
    answers = {"http://u": [(429, {"Retry-After": "7"}, b""), (503, {}, b""), (200, {"ETag": "t"}, b"ok"), (304, {}, b"")]}
    fetch = bugs.Fetcher(bugs.Pacer(0.0, 5, lambda: 0.0, slept.append), opener=opener(answers, asked))
    assert fetch("http://u") == b"ok" and slept == [7, 10] and fetch("http://u") == b"ok" and asked[-1] == ("http://u", "t")
    with pytest.raises(OSError, match="404"):
        bugs.Fetcher(bugs.Pacer(0.0), opener=opener({"http://v": [(404, {}, b"")]}, []))("http://v")


def test_a_listing_that_is_cut_off_says_so():
    docs = {"a": {"entries": [{"bug_link": "x/bugs/5"}], "next_collection_link": "b"}, "b": {"entries": [{"bug_link": "x/bugs/6"}]}}
    fetch = lambda u: json.dumps(docs[u]).encode()
    assert [bugs.task_row(e, c)[-1] for entries, c in [bugs.listing("a", fetch)] for e in entries] == [True, True]
    assert bugs.listing("a", fetch, most=1)[1] is False


def test_single_bugs():
    docs = {
        "t/bugs/7": {"title": "x", "description": "d", "date_created": "2026-01-01T00:00:00+00:00", "duplicate_of_link": "t/bugs/3", "number_of_duplicates": 2, "bug_tasks_collection_link": "tasks", "attachments_collection_link": "files"},
        "tasks": {"entries": [{"target_link": "t/other", "status": "New"}, {"target_link": "t/tool", "status": "Triaged", "importance": "High", "assignee_link": "t/~me"}]},
        "files": {"entries": [{"title": "main.log", "data_link": "f/1", "type": "Unspecified"}]},
    }
    row = bugs.bug_row("t", 7, lambda u: json.dumps(docs[u]).encode(), "tool")
    assert row[:3] == (7, "x", "d") and row[4:] == (3, 2, "Triaged", "High", "me", [("main.log", "f/1", "Unspecified")])


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from lodestone.sources import scratch

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x"))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.root(far)


def test_json_output_is_whole(spark, capsys):
    from lodestone import cli

    cli.show(spark.range(70), True)
    assert len(capsys.readouterr().out.splitlines()) == 70
    cli.show(spark.range(70), False)
    assert "only the first 50" in capsys.readouterr().out


def test_config(tmp_path):
    from lodestone.sources import config

    (tmp_path / "lodestone.toml").write_text("[dedup]\nambiguous_low = 0.5\n[rules]\ndisabled = ['net.update-failed']\n")
    (tmp_path / "a").mkdir()
    got = config.load(config.find(tmp_path / "a"))
    assert got.dedup.ambiguous_low == 0.5 and got.rules.disabled == ("net.update-failed",) and config.load() == config.Config()
    for bad in ("[dedup]\nambiguous_low = 0.9", "[dedup]\nnope = 1", "[nope]\na = 1", "[title]\nmax_length = 'secret-value'"):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError) as e:
            config.load(tmp_path / "bad.toml")
        assert "secret-value" not in str(e.value)


def test_catalogues(spark):
    from lodestone.functions import catalogues

    df = spark.createDataFrame([("E: Unable to correct problems, you have held broken packages.",), ("bla pkgProblem::Resolve bla",), ("other",)], "x string")
    got = [tuple(r) for r in df.select(catalogues.said(F.col("x"), "held_broken", "de_DE.UTF-8"), catalogues.said(F.col("x"), "resolver_breaks")).collect()]
    assert got == [(True, False), (False, True), (False, False)]
    assert [catalogues.language(x) for x in ("pt_BR.UTF-8", "en_US", "C.UTF-8", None, "de")] == ["pt_BR", None, None, None, "de"]


def test_commands(spark, tmp_path, capsys):
    from lodestone import cli

    d = tmp_path / "logs" / "2150245"
    d.mkdir(parents=True)
    (d / "main.log").write_text("2026-04-25 10:00:00,000 INFO Using config files\n2026-04-25 10:00:02,000 ERROR Not enough free space: 5 GB\n2026-04-25 10:00:03,000 DEBUG abort called\n")
    store = ["--store", str(tmp_path / "store"), "--json"]
    assert cli.main(["--json", "title", str(tmp_path / "logs")]) == 0
    assert "not enough disk space: 5 GB" in capsys.readouterr().out
    assert cli.main([*store, "ingest", str(tmp_path / "logs")]) == 0 and cli.main([*store, "stats"]) == 0
    assert '"cause":"not_enough_disk_space","n":1' in capsys.readouterr().out
    assert cli.main([*store, "queue"]) == 0
    assert "status-unknown" in capsys.readouterr().out
    assert cli.main(["rules"]) == 0 and "env.disk-space" in capsys.readouterr().out
